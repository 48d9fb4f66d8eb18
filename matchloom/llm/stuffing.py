"""Problem 8: keyword-stuffed and link-list pages.

1. Each page is reduced, where it lies, to the spectrum of its rank-frequency curve (how many terms occur how often),
   which holds the whole curve in a few numbers, to its shares of kinds of characters (kana, ideographs, letters, digits,
   links, others) and a handful of shapes (units that end alike, number of links).
2. SQL windows over the spectra turn counts into ranks and fit ln frequency against ln rank per page: slope, residual and
   concentration. Divergence is that of the page's kinds of characters from those of prose. All four are held against the
   prose pages of the same script and a comparable length (medians and median deviations over all of them); prose is told
   by the share of what joins words: hiragana, and in Latin script the words that a fifth of its pages use, counted over
   all pages.
3. Only pages extreme in slope, residual, concentration or divergence are flagged. An extreme curve with next to nothing
   that joins words is a case by itself.
4. Every other flagged page is checked by what it is made of: a classifier of character bigrams, fitted on at most
   `SAMPLE` pages with an extreme curve and as many of prose (chosen by hash), gives the share of its characters inside
   stuffing; links, the share of joining words (which an explained link or an honest list keeps) and unit ends (doorway
   pages: place or school names joined to one term) decide with it.

Results for odd input: null, empty and very short pages are no cases; texts are read whole; repeated rows give repeated
results; the columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

SAMPLE = 1500  # most pages of each weak label that fit the bigram classifier
COMMON = 0.2  # least share of the Latin pages that use a joining word
EXTREME = 1.5  # least distance from prose, in deviations, of a flagged page
SHARE = 0.42  # least share of stuffing and links

INVISIBLE = re.compile("[​-‏⁠-⁤﻿\xad᠎︀-️]")
LINK = re.compile(r"(?:https?://|www\.)[^\s、。（）()\]→・|,\"<>]+|[a-z0-9][a-z0-9.\-]*\.[a-z]{2,8}/[^\s、。（）()\]→・|,\"<>]*")
TERM = re.compile("[ァ-ヴー]+|[一-龥々]+|[A-Za-z]{2,}")
KINDS = [re.compile(f"[{kind}]+") for kind in ("ぁ-ゖ", "ァ-ヴー", "一-龥々", "A-Za-zÀ-ɏ", "0-9")]
UNIT = re.compile(r"[\n、,，>＞|｜／/・;；]+")
EDGE = " \t　#＃[](){}:：.。0123456789★円-–"


def plain(text: str) -> str:
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def page_shape(text: str | None) -> tuple:
    """(chars, terms, kinds, spectrum's frequencies and sizes, characters by kind, Latin words and their numbers if the page
    is in Latin script, link share, links, script, units, share of the commonest unit end)."""
    x = plain(text or "")
    y, number = LINK.subn(" ", x)
    links = len(x) - len(y)
    words = TERM.findall(y)
    counts = Counter(words)
    spectrum = sorted(Counter(counts.values()).items(), reverse=True)
    body = len(y) - y.count(" ") - y.count("\n") - y.count("　")
    latin = sum(len(w) for w in words if w[0] < "ɐ")
    script = "latin" if latin * 2 > body else "ja"
    joined = Counter(w.lower() for w in re.findall("[A-Za-z]+", y)) if script == "latin" else {}
    mix = [len("".join(kind.findall(y))) for kind in KINDS]
    units = [u for u in (p.strip(EDGE) for p in UNIT.split(y)) if len(u) >= 2]
    if len(units) < 6:
        units = [u for u in (p.strip(EDGE) for p in y.split()) if len(u) >= 2]
    ends = Counter(u[-2:] for u in units)
    heads = Counter(u[:2] for u in units)
    top, mass = ends.most_common(1)[0] if ends else ("", 0)
    varied = len({u for u in units if u.endswith(top)}) if mass else 0
    end = mass / len(units) if units and varied >= 0.25 * mass and heads.most_common(1)[0][1] < 0.5 * len(units) else 0.0
    return (
        len(x), len(words), len(counts), [f for f, _ in spectrum], [n for _, n in spectrum], body, [*mix, max(body - sum(mix), 0), links],
        list(joined), list(joined.values()), links / max(len(x), 1), number, script, len(units), end,
    )


SHAPE = (
    "doc_id bigint, text_hash bigint, chars int, terms int, kinds int, freqs array<int>, sizes array<int>, body int, mix array<int>,"
    " words array<string>, uses array<int>, links double, number int, script string, units int, ending double"
)


def shapes(docs: DataFrame) -> DataFrame:
    ints, i32, f64 = pa.list_(pa.int32()), pa.int32(), pa.float64()
    types = [i32, i32, i32, ints, ints, i32, ints, pa.list_(pa.string()), ints, f64, i32, pa.string(), i32, f64]
    names = [c.split()[0] for c in SHAPE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[page_shape(t) for t in batch.column(2).to_pylist()], strict=True))
            if not cols:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SHAPE)


def with_joining(shape: DataFrame) -> DataFrame:
    """Adds `functional`, the share of what joins words: hiragana, and in Latin script the words that many of its pages use."""
    latin = shape.where("script = 'latin'")
    used = latin.select("row", F.explode(F.arrays_zip("words", "uses")).alias("u")).select("row", F.col("u.words").alias("word"), F.col("u.uses").alias("n"))
    # each such word takes a share of the pages, so there are at most the words of a page / COMMON of them
    common = used.groupBy("word").agg(F.count("*").alias("pages")).crossJoin(F.broadcast(latin.agg(F.count("*").alias("total")))).where(F.col("pages") >= COMMON * F.col("total"))
    joining = used.join(F.broadcast(common.select("word")), "word").groupBy("row").agg(F.sum(F.length("word") * F.col("n")).alias("joining"))
    return (
        shape.join(joining, "row", "left")
        .withColumn("functional", (F.element_at("mix", 1) + F.coalesce("joining", F.lit(0))) / F.greatest("body", F.lit(1))).drop("joining", "words", "uses")
    )


MEASURES = ("slope", "residual", "spread", "divergence")


def is_prose():
    return F.when(F.col("script") == "latin", F.col("functional") > 0.2).otherwise(F.col("functional") > 0.25) & (F.col("terms") >= 10)


def _nearest(spark: SparkSession, rows: list, columns: list[str]) -> DataFrame:
    """The statistics of each script and length; a length without prose takes those of the nearest with some."""
    out = []
    for script in ("ja", "latin"):
        have = {r.bucket: r for r in rows if r.script == script} or {r.bucket: r for r in rows}
        for bucket in range(33):
            if have:
                near = have[min(have, key=lambda b: (abs(b - bucket), b))]
                out.append((script, bucket, *[float(near[c]) if c != "mix_mid" else [float(v) for v in near[c]] for c in columns]))
    kinds = ", ".join(f"{c} {'array<double>' if c == 'mix_mid' else 'double'}" for c in columns)
    return spark.createDataFrame(out, f"script string, bucket int, {kinds}")


def curves(shape: DataFrame) -> DataFrame:
    """Adds slope, residual, concentration and divergence of each page and how far they lie from prose of the same script
    and a comparable length."""
    spark = shape.sparkSession
    cumulated = shape.select("row", F.posexplode(F.arrays_zip("freqs", "sizes")).alias("k", "p")).select(
        "row", "k", F.col("p.freqs").alias("f"), F.col("p.sizes").alias("n"),
        F.expr("sum(p.sizes) over (partition by row order by k rows unbounded preceding)").alias("upto"),
    )
    # the n terms of one frequency share the middle of their ranks
    points = cumulated.select("row", "n", F.log("f").alias("y"), F.log(F.col("upto") - (F.col("n") - 1) / 2).alias("x"))
    fit = points.groupBy("row").agg(
        F.sum("n").alias("s"), F.sum(F.expr("n * x")).alias("sx"), F.sum(F.expr("n * y")).alias("sy"), F.sum(F.expr("n * x * x")).alias("sxx"),
        F.sum(F.expr("n * x * y")).alias("sxy"), F.sum(F.expr("n * y * y")).alias("syy"),
    )
    fit = (
        fit.withColumn("vx", F.expr("sxx - sx * sx / s")).withColumn("cxy", F.expr("sxy - sx * sy / s")).withColumn("vy", F.expr("syy - sy * sy / s"))
        .select("row", F.expr("case when vx > 1e-9 then cxy / vx else 0 end").alias("slope"),
                F.expr("case when vx > 1e-9 then sqrt(greatest(0, vy - cxy * cxy / vx) / s) else 0 end").alias("residual"))
    )
    full = shape.drop("freqs", "sizes").join(fit, "row", "left").fillna(0.0, ["slope", "residual"])
    full = full.withColumns({
        "spread": F.log(F.greatest("terms", F.lit(1)) / F.greatest("kinds", F.lit(1))),
        "bucket": F.floor(F.log2(F.greatest("chars", F.lit(1)))).cast("int"),
        "mix": F.expr("transform(mix, x -> (x + 0.5d) / (aggregate(mix, 0, (s, y) -> s + y) + 3.5d))"),
    })
    full = checkpointed(full)
    three = MEASURES[:3]
    # at most 66 rows: scripts x log2 lengths
    middle = full.where(is_prose()).groupBy("script", "bucket").agg(
        *[F.percentile_approx(c, 0.5, 1000).alias(f"{c}_mid") for c in three], F.array(*[F.avg(F.element_at("mix", k + 1)) for k in range(7)]).alias("mix_mid")
    ).collect()
    with_mid = full.join(F.broadcast(_nearest(spark, middle, [*[f"{c}_mid" for c in three], "mix_mid"])), ["script", "bucket"], "left") if middle else full.withColumns(
        {f"{c}_mid": F.lit(0.0) for c in three} | {"mix_mid": F.array(*[F.lit(1 / 7)] * 7)}
    )
    with_mid = with_mid.withColumns({"divergence": F.expr("aggregate(zip_with(mix, mix_mid, (p, q) -> p * ln(p / q)), 0d, (s, x) -> s + x)"), "divergence_mid": F.lit(0.0)})
    off = with_mid.where(is_prose()).groupBy("script", "bucket").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_mid")), 0.5, 1000).alias(f"{c}_off") for c in MEASURES]).collect()
    scored = with_mid.join(F.broadcast(_nearest(spark, off, [f"{c}_off" for c in MEASURES])), ["script", "bucket"], "left") if off else with_mid.withColumns(
        {f"{c}_off": F.lit(0.1) for c in MEASURES}
    )
    for c in MEASURES:
        scored = scored.withColumn(f"{c}_z", (F.col(c) - F.col(f"{c}_mid")) / (1.5 * F.col(f"{c}_off") + 0.03))
    return scored.select("doc_id", "text_hash", "chars", "terms", "functional", "links", "number", "script", "units", "ending", *MEASURES, *[f"{c}_z" for c in MEASURES])


def bigrams(text: str) -> set[str]:
    """Character bigrams inside terms and across a single space, words and their pairs in Latin script."""
    y = LINK.sub(" ", plain(text))
    out: set[str] = set()
    for run in re.findall("[ァ-ヴー一-龥々ぁ-ゖ]+", y):
        out |= {run[i : i + 2] for i in range(len(run) - 1)}
    words = re.findall("[A-Za-z]{2,}", y.lower())
    out |= {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    return out


def lexicon(stuffed: list[str], prose: list[str]) -> list[str]:
    """Bigrams found in far more stuffed pages than prose pages; those of a few pages say nothing."""
    s, p = Counter(), Counter()
    for t in stuffed:
        s.update(bigrams(t))
    for t in prose:
        p.update(bigrams(t))
    ns, np_ = len(stuffed) + 1, len(prose) + 1
    return sorted(g for g, c in s.items() if c >= max(3, 0.006 * ns) and log((c + 0.5) / ns) - log((p[g] + 0.5) / np_) >= 1.2)


def stuffing_share(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(doc_id, text_hash, stuffing), each once: share of the characters (links apart) inside bigrams of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for g in grams:
            machine.add_word(g, len(g))
        machine.make_automaton()
        for batch in batches:
            shares = []
            for text in batch.column(2).to_pylist():
                y = LINK.sub(" ", plain(text or "")).lower()
                body = len(y) - y.count(" ") - y.count("\n") - y.count("　")
                covered, last = 0, -1
                for end, size in machine.iter(y):
                    start = max(end - size + 1, last + 1)
                    if end >= start:
                        covered += end - start + 1 - y.count(" ", start, end + 1)
                        last = end
                shares.append(covered / max(body, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["doc_id", "text_hash", "stuffing"])

    shares = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id bigint, text_hash bigint, stuffing double")
    return shares.groupBy("doc_id", "text_hash").agg(F.first("stuffing").alias("stuffing"))


def stuffed_curve():
    """An extreme curve with next to nothing that joins words: a case by itself."""
    odd = (F.col("spread_z") > 3) | (F.col("slope_z") < -3) | (F.col("residual_z") > 3)
    return odd & (F.col("functional") < 0.12) & (F.col("terms") >= 20) & (F.col("spread") > 0.35)


def scored_pages(docs: DataFrame) -> DataFrame:
    # the shapes are read several times: written once, the texts are parsed once for them
    shape = checkpointed(shapes(docs).withColumn("row", F.monotonically_increasing_id()))
    curve = checkpointed(curves(with_joining(shape)))
    ordinary = is_prose() & (F.abs("spread_z") < 2) & (F.abs("slope_z") < 2) & (F.col("functional") > F.when(F.col("script") == "latin", 0.2).otherwise(0.35))
    labelled = []
    for pages in (curve.where(stuffed_curve()), curve.where(ordinary)):
        ids = pages.select("doc_id", "text_hash").orderBy(F.xxhash64("doc_id")).limit(SAMPLE).distinct()
        hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        labelled.append([r.text for r in hashed.join(F.broadcast(ids), ["doc_id", "text_hash"]).select("text").toLocalIterator()])
    share = stuffing_share(docs, lexicon(*labelled))
    keyed = curve.withColumn("key", F.coalesce("doc_id", F.lit(0)))
    return keyed.join(share.withColumn("key", F.coalesce("doc_id", F.lit(0))).drop("doc_id"), ["key", "text_hash"]).drop("key")


def extreme():
    """Far from prose of the same script and a comparable length, by the curve or the kinds of characters."""
    return (F.col("slope_z") < -EXTREME) | (F.col("residual_z") > EXTREME) | (F.col("spread_z") > EXTREME) | (F.col("divergence_z") > EXTREME)


def found_rule():
    """Extreme, and a stuffed curve or made of stuffing, links or doorway units."""
    terms, functional, stuffing, links = F.col("terms"), F.col("functional"), F.col("stuffing"), F.col("links")
    bad = links + (1 - links) * stuffing
    keywords = (terms >= 5) & (
        ((stuffing >= SHARE) & (stuffing > 0.9 * functional)) | ((stuffing >= 0.3) & (functional < 0.15)) | ((stuffing >= 0.3) & (F.col("spread") >= 1.5))
        | ((stuffing >= 0.34) & (F.col("spread") >= 0.6) & (functional < 0.3))
    )
    concentrated = (F.col("spread") >= 1.8) & (functional < 0.3) & (terms >= 30)
    link_list = ((links >= 0.25) & (bad >= 0.5) & (functional < 0.3) & ((functional < 0.16) | (stuffing >= 0.25))) | ((links >= 0.55) & (F.col("number") >= 4))
    doorway = (F.col("ending") >= 0.45) & (F.col("units") >= 6) & (functional < 0.2)
    return extreme() & (stuffed_curve() | keywords | concentrated | link_list | doorway)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are keyword-stuffed or link lists."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return scored_pages(docs).where(found_rule()).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The curve, shares and verdict of every page."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    r = lambda c: F.round(c, 4).alias(c)
    return scored_pages(docs).select("doc_id", *[r(c) for c in ("slope", "residual", "spread", "divergence", "functional", "links", "stuffing", "ending")], "number", found_rule().alias("found"))
