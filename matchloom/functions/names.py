"""Scalar functions on names, labels, dates and numbers, as Column expressions (SURVEY T, N).

Only the compatibility normalisation needs Python (an Arrow UDF over the distinct batch); everything else stays inside
code generation. `\\s` in Java does not match the ideographic space, hence the explicit class.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "[\\s　 ]"
# Prefixes of owners, suffixes of schools, older ideographs.
OWNER = "^(東京都立|都立|都・|国立|国・|私立|私・|区立)(?=.)"
OWNER_SHORT = "^都(?=[^市・])(?=..)"
SCHOOL = "(高等学校|高校|高等科)$"
OLD, NEW = "國學髙﨑", "国学高崎"


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKC", s) if isinstance(s, str) else None)


def normalize(name: Column) -> Column:
    """T1 without aliases: compatibility form, no brackets, spaces, owner or school suffix; ケ between ideographs is ヶ."""
    s = F.regexp_replace(nfkc(F.trim(name)), r"[(（][^()（）]*[)）]", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, SPACE, ""), OWNER, ""), OWNER_SHORT, "")
    s = F.regexp_replace(F.regexp_replace(s, SCHOOL, ""), "(?<=[一-龥])ケ(?=[一-龥])", "ヶ")
    return F.translate(s, OLD, NEW)


def with_aliases(df, name: str, aliases, out: str):
    """The alias of the printed name, else of the cleaned one, else the cleaned one. aliases: (alias, school);
    a dictionary of a few hundred entries, broadcast only while it is small."""
    cleaned = df.withColumn("_clean", normalize(F.col(name)))
    one = aliases.select(F.col("alias").alias(name), F.col("school").alias("_raw_hit"))
    two = aliases.select(F.col("alias").alias("_clean"), F.col("school").alias("_clean_hit"))
    return cleaned.join(one, name, "left").join(two, "_clean", "left").withColumn(out, F.coalesce("_raw_hit", "_clean_hit", "_clean")).drop("_raw_hit", "_clean_hit", "_clean")


FULL_WIDTH, HALF_WIDTH = "ＡＢＣＤＥＦＧＨＩＪ", "ABCDEFGHIJ"


def squad_of(name: Column) -> tuple[Column, Column]:
    """(base, squad A-J), a last letter of either width; clubs ending in FC or SC, names in ASCII alone and U-15..18
    keep their letters."""
    n = F.trim(name)
    pattern = r"^(.+?)[\s・]?([A-JＡ-Ｊ])$"
    base, letter = F.trim(F.regexp_extract(n, pattern, 1)), F.regexp_extract(n, pattern, 2)
    guard = n.rlike(r"(?i)(FC|SC|F\.C)$") | base.rlike(r"^[\x00-\x7F]*$") | base.rlike(r"(?i)(U-?1[5-8]|FC|F\.C)$")
    split = ~guard & (letter != "")
    return F.when(split, base).otherwise(n), F.when(split, F.translate(letter, FULL_WIDTH, HALF_WIDTH)).otherwise("A")


def split_side(name: Column) -> tuple[Column, Column]:
    """T4: another splitter: any letter of either width, a base of at least two characters, empty by default; the base is
    normalised."""
    tail = F.regexp_extract(F.trim(name), r"^(..+?)([A-ZＡ-Ｚ])$", 2)
    base = F.when(tail != "", F.regexp_extract(F.trim(name), r"^(..+?)([A-ZＡ-Ｚ])$", 1)).otherwise(name)
    wide = "".join(chr(c) for c in range(0xFF21, 0xFF3B))
    return normalize(base), F.translate(tail, wide, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def team_key(name: Column, school: Column, squad: Column, known: Column) -> Column:
    """T5: a known school's first side is the school, another squad carries its letter, a club is its name without spaces."""
    return F.when(known, F.when(squad == "A", school).otherwise(F.concat(school, F.lit("（"), squad, F.lit("）")))).otherwise(F.regexp_replace(name, SPACE, ""))


def split_stage(stage: Column) -> tuple[Column, Column]:
    """T7: "第N回 X" -> (N, X); without an edition null and the text."""
    n = F.regexp_extract(stage, r"^第(\d+)回\s*(.*)$", 1)
    return F.when(n != "", n.cast("int")), F.when(n != "", F.regexp_extract(stage, r"^第(\d+)回\s*(.*)$", 2)).otherwise(stage)


def join_stage(edition: Column, rest: Column) -> Column:
    return F.when(edition.isNull(), rest).otherwise(F.concat(F.lit("第"), edition.cast("string"), F.lit("回 "), rest))


def level_of(league: Column, division: Column) -> Column:
    """Tier of a league: プリンス, T1 to T5, 1部 to 3部, else 地区."""
    part = F.regexp_extract(F.coalesce(division, F.lit("")), "^([1-3])部", 1)
    return F.when(league.startswith("プリンス"), "プリンス").when(league.rlike("^T[1-5]$"), league).when(part != "", F.concat(part, F.lit("部"))).otherwise("地区")


def broken(name: Column) -> Column:
    """A digit, bracket, comma, stop, ※ or ・ in a name, or fewer than one or more than twelve characters."""
    return name.rlike("[0-9()（）,、。※・]") | (F.char_length(name) > 12) | (F.char_length(name) < 1)


def score_text(sa: Column, sb: Column, pa: Column, pb: Column, extra: Column) -> Column:
    """A-b (PK p-q) (延長); null without scores."""
    pk = F.when(pa.isNotNull() & pb.isNotNull(), F.concat(F.lit(" (PK "), pa.cast("string"), F.lit("-"), pb.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(sa.cast("string"), F.lit("-"), sb.cast("string"), pk, F.when(extra, " (延長)").otherwise(""))


def parse_score(text: Column) -> tuple[Column, Column]:
    """The inverse, by prefix; null where the text does not start with a score."""
    a, b = F.regexp_extract(text, r"^(\d+)-(\d+)", 1), F.regexp_extract(text, r"^(\d+)-(\d+)", 2)
    return F.when(a != "", a.try_cast("int")), F.when(b != "", b.try_cast("int"))


def clean_notes(note: Column) -> Column:
    """Parts of a remark without technical ones, joined again."""
    parts = F.filter(F.split(note, "／"), lambda x: ~x.rlike("^(extra:|text:|facing)") & (x != "延長"))
    return F.nullif(F.array_join(parts, "／"), F.lit(""))


def source_kind(url: Column) -> Column:
    """T20"""
    return F.when(F.lower(url).endswith(".pdf"), "pdf").otherwise("web")


def document_meta(doc: Column) -> dict[str, Column]:
    """Season, series and stage code from a document's name; the order of the rules matters, unknown names are null."""
    stem = F.regexp_replace(doc, r"^matome_", "")
    code = F.regexp_extract(stem, r"^([a-z]+)(\d\d)_([a-z]+)_(\d+)", 1)
    series = F.when(code == "shin", "新人戦").when(code == "sotai", "総体").when(code == "sen", "選手権").when(code == "kan", "関東")
    yy = F.regexp_extract(stem, r"^([a-z]+)(\d\d)_([a-z]+)_(\d+)", 2)
    return {"doc_series": series, "doc_season": F.when(yy != "", 2000 + yy.try_cast("int")), "doc_stage": F.nullif(F.regexp_extract(stem, r"^([a-z]+)(\d\d)_([a-z]+)_(\d+)", 3), F.lit("")),
            "doc_number": F.regexp_extract(stem, r"^([a-z]+)(\d\d)_([a-z]+)_(\d+)", 4).try_cast("int")}


def season_of(day: Column) -> Column:
    """N2"""
    return F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)


def month_day(text: Column) -> Column:
    """ISO or M/D text to M/D."""
    iso = F.regexp_extract(text, r"^\d{4}-(\d{2})-(\d{2})", 1)
    short = F.regexp_extract(text, r"^(\d{1,2}/\d{1,2})", 1)
    d = F.regexp_extract(text, r"^\d{4}-(\d{2})-(\d{2})", 2)
    return F.when(iso != "", F.concat(iso.try_cast("int").cast("string"), F.lit("/"), d.try_cast("int").cast("string"))).when(short != "", short)


def points(won: Column, drawn: Column, lost: Column) -> dict[str, Column]:
    """Points and games; null when any input is."""
    return {"points": 3 * won + drawn, "played": won + drawn + lost}


# Prose tokens over a fixed list of metrics; nothing is evaluated.
def render_prose(template: str, metrics: dict[str, float | int | str]) -> str:
    """Replaces {{name}} and {{+name}} (signed); an unknown name is an error."""
    import re

    def one(m: re.Match) -> str:
        signed, name = m.group(1), m.group(2)
        if name not in metrics:
            raise KeyError(f"unknown metric {name!r}")
        v = metrics[name]
        return f"{v:+g}" if signed else f"{v:g}" if isinstance(v, float) else str(v)

    return re.sub(r"\{\{(\+?)([a-z_]+)\}\}", one, template)
