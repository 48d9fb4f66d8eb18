"""Problem 2: one plain form for text that looks the same but differs in its characters.

Every distinct value is exploded to positioned code points, joined to a broadcast table of compatibility
decompositions and look-alikes, its combining marks are ordered by class within their starter, each starter with its
marks is recomposed by a second broadcast join, and the string is rebuilt. The two tables come from the Unicode data
of the Python library, so their size is bounded by Unicode (about 20,000 short rows) and not by the input.

Results for odd input: null stays null; an empty or wholly invisible text becomes the empty string; texts of any
length are processed whole; repeated values are computed once.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters drawn like an ASCII character whose compatibility decomposition says otherwise.
LOOK_ALIKE = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹⅭ", "E": "ΕЕ", "F": "Ϝ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ",
    "N": "Ν", "O": "ΟО", "P": "ΡР", "Q": "Ԛ", "S": "Ѕ", "T": "ΤТ", "U": "Ս", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ", "o": "οо", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
    "-": "‐‑‒–—―−﹣⁃˗➖", "/": "⁄∕⧸╱", "(": "❨⟮", ")": "❩⟯", ".": "․", "・": "･·•‧⋅∙",
}
# Parts of the CJK Radicals Supplement that carry no decomposition, with the unified ideograph.
RADICALS = dict(zip("⺟⺠⻁⻄⻑⻘⻝⻢⻤⻨⻩⻫⻭⻯⻰⻲⻱", "母民虎西長青食馬鬼麦黄斉歯竜龍亀亀", strict=True))
# Katakana and the ideographs that look like them, for use by context.
KANA_KANJI = dict(zip("エロニカタハトー", "工口二力夕八卜一", strict=True))


def _invisible(ch: str) -> bool:
    """Characters without a shape: format controls, variation selectors and fillers."""
    cp = ord(ch)
    return (
        unicodedata.category(ch) in ("Cf", "Cc")
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0100 <= cp <= 0xE01EF
        or 0x180B <= cp <= 0x180F
        or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
    )


@cache
def _tables() -> tuple[list[tuple[str, str]], list[tuple[str, str]], str]:
    """(character -> decomposed plain form), (starter with marks -> composed character), all combining marks."""
    look = {src: dst for dst, sources in LOOK_ALIKE.items() for src in sources} | RADICALS
    plain, composed, marks = [], {}, []
    for cp in range(0x80, 0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn" and not 0xE0000 <= cp <= 0xE0FFF:
            continue
        if unicodedata.combining(ch):
            marks.append(ch)
        canonical = unicodedata.normalize("NFD", ch)
        if canonical != ch and unicodedata.normalize("NFC", canonical) == ch:
            composed[canonical] = ch
        if ch in look:
            to = unicodedata.normalize("NFD", look[ch])
        elif cp in (0x309B, 0xFF9E):
            to = "゙"
        elif cp in (0x309C, 0xFF9F):
            to = "゚"
        elif _invisible(ch):
            to = ""
        elif kind in ("Zs", "Zl", "Zp"):
            to = " "
        else:
            to = "".join(unicodedata.normalize("NFD", look.get(c, c)) for c in unicodedata.normalize("NFKD", ch))
            to = "".join(" " if unicodedata.category(c) == "Zs" else c for c in to)
        if to != ch:
            plain.append((ch, to))
    plain += [(chr(cp), " " if cp in (9, 10, 11, 12, 13) else "") for cp in [*range(0x01, 0x20), 0x7F]]
    return plain, sorted(composed.items()), "".join(marks)


def _by_context(text: Column, numeric: Column) -> Column:
    """Look-alikes that only their neighbours tell: digits drawn as letters in dates and scores; a lone katakana
    among ideographs, an ideograph inside a katakana word."""
    digits = F.regexp_replace(F.regexp_replace(text, "[lI|]", "1"), "[Oo]", "0")
    digits = F.regexp_replace(digits, "(?<=[0-9])[ー一](?=[0-9])", "-")
    words = text
    kana = "ァ-ヺー"
    for katakana, kanji in KANA_KANJI.items():
        words = F.regexp_replace(words, f"(?<![{kana}ヽヾ]){katakana}(?![{kana}])(?<!^{katakana}$)", kanji)
        words = F.regexp_replace(words, f"(?<=[{kana}]){kanji}(?=[{kana}])", katakana)
    return F.when(numeric, digits).otherwise(words)


def plain_values(values: DataFrame, text: str = "value", numeric: str = "numeric") -> DataFrame:
    """(value, numeric) distinct rows -> the same with a column `plain`. Null values are left out."""
    spark = values.sparkSession
    plain_rows, composed_rows, _ = _tables()
    to_plain = F.broadcast(spark.createDataFrame(plain_rows, "ch string, to string"))
    to_composed = F.broadcast(spark.createDataFrame(composed_rows, "cluster string, one string"))
    marks = spark.createDataFrame([(c, unicodedata.combining(c)) for c in _tables()[2]], "c string, ccc int")
    vals = values.select(F.col(text).alias("v"), F.col(numeric).alias("num")).where("v is not null").distinct()
    exploded = vals.select("v", "num", F.posexplode(F.split("v", "")).alias("pos", "ch"))
    decomposed = (
        exploded.join(to_plain, "ch", "left")
        .select("v", "num", "pos", F.posexplode(F.split(F.coalesce("to", "ch"), "")).alias("sub", "c"))
        .where("c <> ''")
        .join(F.broadcast(marks), "c", "left")
        .withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    )
    # a starter opens a cluster; its marks are ordered by class, equal classes as they stand
    clusters = (
        decomposed.select(
            "v", "num", "c", "ccc", "pos", "sub",
            F.expr("sum(cast(ccc = 0 as int)) over (partition by v, num order by pos, sub rows unbounded preceding)").alias("k"),
        )
        .groupBy("v", "num", "k")
        .agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "c"))).alias("parts"))
        .select("v", "num", "k", F.expr("array_join(transform(parts, x -> x.c), '')").alias("cluster"))
    )
    # the longest beginning that composes; else the second mark with the starter, past a first one that does not
    forms = {"whole": F.col("cluster"), "first3": F.substring("cluster", 1, 3), "first2": F.substring("cluster", 1, 2),
             "past": F.concat(F.substring("cluster", 1, 1), F.substring("cluster", 3, 1))}
    composed = clusters
    for name, form in forms.items():
        one = to_composed.select(F.col("cluster").alias(f"{name}_key"), F.col("one").alias(name))
        composed = composed.withColumn(f"{name}_key", form).join(F.broadcast(one), f"{name}_key", "left").drop(f"{name}_key")
    out = F.coalesce(
        "whole", F.concat("first3", F.expr("substring(cluster, 4)")), F.concat("first2", F.expr("substring(cluster, 3)")),
        F.concat("past", F.expr("substring(cluster, 2, 1)"), F.expr("substring(cluster, 4)")), "cluster",
    )
    composed = composed.select("v", "num", "k", out.alias("out"))
    rebuilt = (
        composed.groupBy("v", "num")
        .agg(F.array_sort(F.collect_list(F.struct("k", "out"))).alias("parts"))
        .select("v", "num", F.expr("array_join(transform(parts, x -> x.out), '')").alias("s"))
    )
    # a value of which nothing remains has no cluster left, hence the outer join
    full = vals.join(rebuilt, ["v", "num"], "left").select("v", "num", F.coalesce("s", F.lit("")).alias("s"))
    return full.select(
        F.col("v").alias(text), F.col("num").alias(numeric), F.trim(_by_context(F.col("s"), F.col("num"))).alias("plain")
    )


FIELDS = {"日付": True, "チームA": False, "スコア": True}


def plain_matches(matches: DataFrame) -> DataFrame:
    """(seq, field, value, plain) of every row and field with a value."""
    pairs = [f"'{f}', `{f}`, {str(numeric).lower()}" for f, numeric in FIELDS.items()]
    long = matches.selectExpr("seq", f"stack({len(pairs)}, {', '.join(pairs)}) as (field, value, numeric)").where("value is not null")
    return long.join(plain_values(long.select("value", "numeric")), ["value", "numeric"]).select("seq", "field", "value", "plain")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and fields whose value is not in plain form."""
    matches = spark.read.parquet(f"{folder}/matches.parquet")
    long = matches.selectExpr(
        "seq", f"stack({len(FIELDS)}, " + ", ".join(f"'{f}', `{f}`, {str(n).lower()}" for f, n in FIELDS.items()) + ") as (field, value, numeric)"
    ).where("value is not null")
    damaged = plain_values(long.select("value", "numeric")).where("value <> plain").select("value", "numeric")
    return long.join(damaged, ["value", "numeric"]).select("seq", "field")


def p2_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The plain form of every value of the three fields."""
    return plain_matches(spark.read.parquet(f"{folder}/matches.parquet")).select("seq", "field", "plain")
