"""The normalised dataset: registries, competitions, matches with provenance, standings, merges.

Tables are built from the contests by joins on their own keys; a duplicate record is never discarded, it becomes a
provenance row that points at the survivor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import normalize
from ..plans.ranking import global_rank
from . import reconcile as R
from .perspective import both_sides


def competition_id(season: Column, series: Column, stage: Column) -> Column:
    return F.concat_ws("-", season.cast("string"), series, stage)


def competitions(g: DataFrame) -> DataFrame:
    """I4: one row per season, series and stage with its number of contests and areas."""
    return g.groupBy("season", "series", "stage").agg(F.count("*").alias("n"), F.count_distinct("area").alias("areas")).withColumn("comp_id", competition_id(F.col("season"), F.col("series"), F.col("stage")))


def source_registry(g: DataFrame, existing: DataFrame) -> DataFrame:
    """An id per document, stable across runs; new ones follow in order of first appearance."""
    first = g.where("doc is not null").groupBy("doc").agg(F.min("seq").alias("first_seq"))
    j = first.join(existing, "doc", "left")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = global_rank(j.where("id is null"), F.col("first_seq"), name="k").crossJoin(F.broadcast(top))
    both = j.where("id is not null").select("doc", "id").unionByName(fresh.select("doc", (F.col("k") + F.col("top")).alias("id")))
    return both.select("doc", F.format_string("R%04d", "id").alias("source_id"))


def provenance(g: DataFrame) -> DataFrame:
    """Every record with the survivor of its contest, its role and whether its sides are exchanged."""
    key = ["season", "series", "stage", "round", F.least("a", "b"), F.greatest("a", "b")]
    named = g.where("a is not null and b is not null")
    w = Window.partitionBy(*key).orderBy(R.is_played().desc(), "seq")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = named.select("seq", first("seq").alias("survivor"), F.row_number().over(w).alias("k"), (first("a") != F.col("a")).alias("flipped"))
    return x.select("seq", "survivor", F.when(F.col("k") == 1, "主").otherwise("重複").alias("role"), F.when(F.col("k") == 1, False).otherwise(F.col("flipped")).alias("flipped"))


def collisions(g: DataFrame) -> DataFrame:
    """Contests whose copies with both scores disagree in the oriented scores (collisions_full compares all)."""
    p = provenance(g)
    me = g.select("seq", "a", "sa", "sb")
    flip = F.col("flipped")
    o = p.join(me, "seq").select("survivor", F.when(flip, F.col("sb")).otherwise(F.col("sa")).alias("x"), F.when(flip, F.col("sa")).otherwise(F.col("sb")).alias("y"))
    return o.where("x is not null and y is not null").groupBy("survivor").agg(F.count_distinct("x", "y").alias("scores"), F.count("*").alias("rows")).where("scores > 1")


def collisions_full(g: DataFrame) -> DataFrame:
    """Contests recorded more than once whose oriented scores, penalties, winners or states disagree: they stop an
    export. A missing value differs from a present one. The winner is compared by school, as it is not always written
    as its side is; a winner that is neither side stays as it is cleaned.
    """
    p = provenance(g)
    copies = p.join(p.groupBy("survivor").agg(F.count("*").alias("rows")).where("rows > 1"), "survivor").select("survivor", "rows", "seq", "flipped")
    o = copies.join(g.select("seq", "a", "b", "raw_a", "raw_b", "sa", "sb", "pa", "pb", "winner", "status"), "seq")
    exact = F.when(F.col("winner") == F.col("raw_a"), F.col("a")).when(F.col("winner") == F.col("raw_b"), F.col("b"))
    o = o.withColumn("exact", exact).withColumn("clean", normalize(F.when(F.col("exact").isNull(), F.col("winner"))))
    turned = lambda x, y: F.when(F.col("flipped"), F.col(y)).otherwise(F.col(x))
    score = F.struct(turned("sa", "sb").alias("x"), turned("sb", "sa").alias("y"))
    kicks = F.struct(turned("pa", "pb").alias("x"), turned("pb", "pa").alias("y"))
    t = o.select("survivor", "rows", score.alias("score"), kicks.alias("kicks"), F.struct(F.coalesce("exact", "clean").alias("w")).alias("won"), F.struct("status").alias("state"))
    n = t.groupBy("survivor", "rows").agg(*[F.count_distinct(c).alias(k) for c, k in (("score", "scores"), ("kicks", "penalties"), ("won", "winners"), ("state", "states"))])
    return n.where("scores > 1 or penalties > 1 or winners > 1 or states > 1").select("survivor", "scores", "penalties", "winners", "states", "rows")


def merge_problems(merges: DataFrame, known: DataFrame) -> DataFrame:
    """Merges (variant, canonical) that point at themselves, form chains, repeat a variant or name unknown schools."""
    m = merges.select("variant", "canonical")
    own = m.where("variant = canonical").select(F.lit("self").alias("problem"), F.col("variant").alias("key"))
    chain = m.join(merges.select(F.col("variant").alias("canonical")).distinct(), "canonical", "left_semi").where("variant <> canonical").select(F.lit("chain").alias("problem"), F.col("variant").alias("key"))
    twice = m.groupBy("variant").agg(F.count_distinct("canonical").alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), F.col("variant").alias("key"))
    unknown = m.join(known.select(F.col("name").alias("canonical")), "canonical", "left_anti").select(F.lit("unknown").alias("problem"), F.col("variant").alias("key"))
    return own.unionByName(chain).unionByName(twice).unionByName(unknown)


def apply_merges(g: DataFrame, merges: DataFrame) -> DataFrame:
    """Contests with merged names (one level; merge_problems has ruled out chains)."""
    a = merges.select(F.col("variant").alias("a"), F.col("canonical").alias("_ca"))
    b = merges.select(F.col("variant").alias("b"), F.col("canonical").alias("_cb"))
    return g.join(a, "a", "left").join(b, "b", "left").withColumns({"a": F.coalesce("_ca", "a"), "b": F.coalesce("_cb", "b")}).drop("_ca", "_cb")


def school_attributes(g: DataFrame, roster: DataFrame) -> DataFrame:
    """The roster's kind first; a school seen in a tournament is 不明, a club by its name クラブ."""
    seen = both_sides(g).groupBy(F.col("me").alias("name")).agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    j = seen.join(roster.select(F.col("key").alias("name"), "kind", "city"), "name", "full")
    club = F.col("name").rlike("(FC|SC|ユース|クラブ)$")
    return j.select("name", F.coalesce("kind", F.when(club, "クラブ"), F.lit("不明")).alias("kind"), "city", "first_season", "last_season")


def star_view(g: DataFrame, roster: DataFrame, sources: DataFrame) -> DataFrame:
    """Contests joined to both schools' attributes and their source (N:1 left joins)."""
    side = lambda k: roster.select(F.col("key").alias(k), F.col("kind").alias(f"kind_{k}"), F.col("city").alias(f"city_{k}"))
    return g.join(side("a"), "a", "left").join(side("b"), "b", "left").join(sources, "doc", "left").select("seq", "a", "b", "kind_a", "city_a", "kind_b", "city_b", "source_id")


def legacy_round_trip(g: DataFrame) -> DataFrame:
    """Contests out of the normalised form again, in the original order, with what got lost."""
    codes = R.status_codes(g)
    return g.join(codes, "seq").select("seq", "season", "series", "stage", "a", "b", "sa", "sb", "status", F.col("back").alias("status_back"), (F.col("back") == F.col("status")).alias("same"))


def meeting_probability(adv: DataFrame, rounds: int) -> DataFrame:
    """Probability that two sides of a bracket meet in a round: both reach it, in neighbouring halves of a block."""
    out = None
    for r in range(1, rounds + 1):
        a = adv.where(F.col("round") == r - 1).select(F.shiftright("pos", r).alias("block"), F.shiftright("pos", r - 1).alias("h"), F.col("team").alias("x"), F.col("p").alias("px"))
        b = a.select("block", F.col("h").alias("g"), F.col("x").alias("y"), F.col("px").alias("py"))
        m = a.join(b, "block").where("h < g").select(F.lit(r).alias("round"), "x", "y", (F.col("px") * F.col("py")).alias("p"))
        out = m if out is None else out.unionByName(m)
    return out


def alive(g: DataFrame) -> DataFrame:
    """Sides of a document that have not lost a decided contest in it."""
    side = both_sides(g).where("doc is not null")
    lost = side.where("winner is not null and winner <> raw").select("doc", "me").distinct()
    return side.select("doc", "me").distinct().join(lost, ["doc", "me"], "left_anti")
