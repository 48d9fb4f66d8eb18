"""Standings, records and composites over one-sided views: all partial aggregates on their keys, windows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .perspective import UNPLAYED, WALKOVER, both_sides


def round_rank(col: Column) -> Column:
    """Ordinal of a round's name; unknown rounds are 0."""
    n = F.regexp_extract(col, r"^(\d)回戦$", 1)
    return (
        F.when(col == "決勝", 9).when(col == "準決勝", 8).when(col == "準々決勝", 7).when(col == "ブロック決勝", 6)
        .when(F.length(n) > 0, n.try_cast("int")).otherwise(0)
    )


def stage_tier(col: Column) -> Column:
    """Second stage 2, first stage 1, else 0."""
    return F.when(col.contains("二次") | (col == "東京都予選"), 2).when(col.contains("一次"), 1).otherwise(0)


def series_index(col: Column) -> Column:
    """O3: 総体, 選手権, 新人戦, 関東."""
    return F.when(col == "総体", 0).when(col == "選手権", 1).when(col == "新人戦", 2).when(col == "関東", 3).otherwise(9)


def standings(views: DataFrame, keys: list[str], tie_break: tuple[str, ...]) -> DataFrame:
    """Played, won, drawn, lost, goals, points (3w + d) and rank; ties end with the name."""
    t = views.groupBy(*keys, F.col("me").alias("team")).agg(
        F.count("*").alias("played"), F.count_if(F.expr("res = '○'")).alias("won"), F.count_if(F.expr("res = '△'")).alias("drawn"), F.count_if(F.expr("res = '●'")).alias("lost"),
        F.sum("gf").alias("gf"), F.sum("ga").alias("ga"),
    )
    t = t.withColumn("gd", F.col("gf") - F.col("ga")).withColumn("points", 3 * F.col("won") + F.col("drawn"))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in tie_break], "team")
    return t.withColumn("rank", F.row_number().over(w))


def team_record(g: DataFrame) -> DataFrame:
    """A1: counts per side and stage. Walkovers are no games, unplayed rows are skipped, draws only count as games;
    with the name as first printed, the last round and the path in order of rounds."""
    v = both_sides(g).where(F.col("status") != UNPLAYED)
    won = F.coalesce(F.col("winner") == F.col("raw"), F.lit(False))
    v = v.withColumns({"won": won, "pk": F.col("pf").isNotNull() | F.col("pg").isNotNull(), "wo": F.col("status") == WALKOVER, "rr": round_rank(F.col("round"))})
    step = F.concat(F.coalesce("round", F.lit("?")), F.when(F.col("won"), "○").otherwise("●"))
    return v.groupBy("season", "series", "stage", "area", "me").agg(
        F.count_if(F.expr("not wo")).alias("games"), F.count_if(F.expr("not wo and won and not pk")).alias("wins"), F.count_if(F.expr("not wo and won and pk")).alias("pk_wins"),
        F.count_if(F.expr("not wo and not won and winner is not null and pk")).alias("pk_losses"),
        F.count_if(F.expr("not wo and not won and winner is not null and not pk")).alias("losses"), F.count_if(F.expr("wo and won")).alias("walkovers"),
        F.min_by("raw", F.when(F.col("raw").isNotNull(), F.col("seq"))).alias("raw"),
        F.max_by("round", F.when(F.col("round").isNotNull(), F.struct("rr", "seq"))).alias("last_round"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rr", "seq", step.alias("s")))), lambda x: x["s"]), " → ").alias("path"),
    )


def summary_rollup(views: DataFrame) -> DataFrame:
    """A3, A5: one pass over three groupings: side, side and season, side and series."""
    return views.sparkSession.sql(
        """select me, season, series, count(*) n, count_if(res = '○') w, count_if(res = '△') d, count_if(res = '●') l, sum(gf) gf, sum(ga) ga,
        count_if(ga = 0) clean, count_if(gf = 0) scoreless, count_if(abs(gf - ga) = 1) one_goal, grouping(season) * 2 + grouping(series) level
        from {views} group by grouping sets ((me), (me, season), (me, series))""",
        views=views,
    )


def furthest_run(views: DataFrame) -> DataFrame:
    """The row with the highest tier and round of each side, season and series; the first one wins."""
    v = views.withColumns({"tier": stage_tier(F.col("stage")), "rr": round_rank(F.col("round"))})
    w = Window.partitionBy("season", "series", "me").orderBy(F.col("tier").desc(), F.col("rr").desc(), "seq", "slot")
    return v.withColumn("k", F.row_number().over(w)).where("k = 1").select("season", "series", "me", "stage", "round", "seq")


def fiscal_dates(g: DataFrame) -> DataFrame:
    """Month and day within a season that ends in March; impossible dates are left out."""
    pattern = r"^(\d{1,2})/(\d{1,2})"
    m = g.where(F.col("date_text").rlike(pattern)).withColumns(
        {"mm": F.regexp_extract("date_text", pattern, 1).cast("int"), "dd": F.regexp_extract("date_text", pattern, 2).cast("int")}
    )
    text = F.format_string("%04d-%02d-%02d", F.col("season") + F.when(F.col("mm") < 4, 1).otherwise(0), "mm", "dd")
    m = m.withColumn("date", text.try_cast("date")).where("date is not null")
    return m.withColumn("season_back", F.year("date") - F.when(F.month("date") < 4, 1).otherwise(0))


def composite(t: DataFrame, by: str, parts: dict[str, tuple[float, bool]]) -> DataFrame:
    """Parts scaled 0..100 within a group (a constant part is 50, nulls are skipped), weighted mean of the rest."""
    w = Window.partitionBy(by)
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, (share, up) in parts.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        x = F.when(F.col(c).isNull(), None).when(lo == hi, 50.0).otherwise(100.0 * ((F.col(c) - lo) if up else (hi - F.col(c))) / (hi - lo))
        t = t.withColumn(f"_{c}", x)
        total = total + F.coalesce(share * F.col(f"_{c}"), F.lit(0.0))
        weight = weight + F.when(F.col(f"_{c}").isNull(), 0.0).otherwise(share)
    return t.withColumn("score", total / F.nullif(weight, F.lit(0.0)))
