"""Problem 5: one ranking of all items from pairwise comparisons, by Bayesian Gaussian skill inference.

Every item has a Gaussian skill; a comparison says that winner's performance exceeded loser's. Outcomes are first
pre-aggregated to (winner, loser, count). Each such edge sends each of its ends a Gaussian message; a round computes
all messages from the current marginals with the edge's own message taken out (its cavity), by moment matching of the
truncated difference, and sums them per item with damping (parallel expectation propagation), until the largest change
of any mean in a round is below a tolerance; the ranking goes by mean - 3 deviations, so that items with few comparisons are
not placed by luck. A round is two joins of edges with items and one partial aggregation; an item with a third of all
comparisons has no more edges than there are other items.

Results for odd input: rows without a side, without a winner or with one school on both sides are no comparisons; draws
are left out; contradicting copies of one contest count once, by the latest readable score; items without any decided
comparison keep the prior; ties in the bound go to the smaller name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..session import checkpointed, collect_garbage, release
from .name_variants import school_clusters
from .survivor import _mechanical, with_schools

PRIOR_MEAN, PRIOR_SD, BETA = 25.0, 25.0 / 3, 25.0 / 6
PRECISION = 1 / PRIOR_SD**2
DAMPING = 0.8
TOLERANCE = 0.01  # of a mean in one round, a thousandth of the prior's deviation
CHECK, MOST = 3, 120  # rounds between two looks at the change, rounds in all


# φ(t) / Φ(t) with the rational approximation of the error function (absolute error of Φ below 1e-7), in steps
_STEPS = [
    ["1 / wcp as wv", "1 / lcp as lv"],
    ["wct * wv as wm", "lct * lv as lm", f"sqrt(wv + lv + {2 * BETA**2}d) as cc"],
    ["(wm - lm) / cc as t"],
    ["exp(-t * t / 2) * 0.3989422804014327d as pdf", "1 / (1 + 0.2316419d * abs(t)) as k"],
    ["pdf * k * (0.319381530d + k * (-0.356563782d + k * (1.781477937d + k * (-1.821255978d + k * 1.330274429d)))) as tail"],
    ["case when t < -6 then -t - 1 / t else pdf / greatest(case when t >= 0 then 1 - tail else tail end, 1e-12d) end as v"],
    ["least(0.999999d, greatest(1e-9d, v * (v + t))) as w"],
    ["wv * (1 - wv / (cc * cc) * w) as wn", "lv * (1 - lv / (cc * cc) * w) as ln"],
    ["greatest(1 / wn - wcp, 1e-9d) as wp1", "(wm + wv / cc * v) / wn - wct as wt1", "greatest(1 / ln - lcp, 1e-9d) as lp1", "(lm - lv / cc * v) / ln - lct as lt1"],
]
_MESSAGES = ("wp", "wt", "lp", "lt")
_ENDS = "explode(array(struct(winner as item, {wp} * n as p, {wt} * n as t), struct(loser as item, {lp} * n as p, {lt} * n as t))) as e"


def _sums(sites: DataFrame, suffix: str = "") -> DataFrame:
    """(item, pi, tau) of every item with a comparison: the prior and all messages to it."""
    ends = sites.selectExpr(_ENDS.format(**{m: m + suffix for m in _MESSAGES})).selectExpr("e.item", "e.p", "e.t")
    return ends.groupBy("item").agg(F.expr(f"sum(p) + {PRECISION}d as pi"), F.expr(f"sum(t) + {PRECISION * PRIOR_MEAN}d as tau"))


def _round(sites: DataFrame) -> DataFrame:
    """All messages anew from the marginals, damped; the messages of before stay as wp0, wt0, lp0, lt0."""
    m = _sums(sites)
    both = sites.join(m.selectExpr("item as winner", "pi as w_pi", "tau as w_tau"), "winner").join(m.selectExpr("item as loser", "pi as l_pi", "tau as l_tau"), "loser")
    c = both.selectExpr(
        "winner", "loser", "n", *_MESSAGES, f"greatest(w_pi - wp, {PRECISION * 0.2}d) as wcp", "w_tau - wt as wct", f"greatest(l_pi - lp, {PRECISION * 0.2}d) as lcp", "l_tau - lt as lct"
    )
    for step in _STEPS:
        c = c.selectExpr("*", *step)
    return c.selectExpr("winner", "loser", "n", *[f"{DAMPING}d * {m}1 + {1 - DAMPING}d * {m} as {m}" for m in _MESSAGES], *[f"{m} as {m}0" for m in _MESSAGES])


def infer_skills(edges: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(item, mu, sigma). edges: (winner, loser, n); items: (item). Rounds go on until none of the means moves by the
    tolerance in the last one; more than `MOST` rounds are an error."""
    sites = checkpointed(edges.selectExpr("winner", "loser", "cast(n as double) as n", *[f"0d as {m}" for m in _MESSAGES]))
    for k in range(MOST):
        old, sites = sites, checkpointed(_round(sites))
        release(old)
        if k % CHECK < CHECK - 1:
            continue
        # what the last round moved
        now, before = _sums(sites).selectExpr("item", "tau / pi as mu"), _sums(sites, "0").selectExpr("item", "tau / pi as mu0")
        change = now.join(before, "item").selectExpr("max(abs(mu - mu0)) as c").first().c or 0.0
        if change < tolerance:
            break
    else:
        raise RuntimeError(f"the skills still move by {change} after {MOST} rounds")
    full = items.join(_sums(sites), "item", "left")
    return full.selectExpr("item", f"coalesce(tau / pi, {PRIOR_MEAN}d) as mu", f"1 / sqrt(coalesce(pi, {PRECISION}d)) as sigma")


def outcomes(matches: DataFrame, clusters: DataFrame) -> DataFrame:
    """(winner, loser, n): decided contests between schools, each contest once."""
    a, b = F.col("得点A").try_cast("int"), F.col("得点B").try_cast("int")
    pa, pb = F.col("PK_A").try_cast("int"), F.col("PK_B").try_cast("int")
    # the side that has won is read before any join, so that few columns of a row are shuffled
    by_score = F.when(a > b, "a").when(a < b, "b").when(pa > pb, "a").when(pa < pb, "b")
    named = F.when(F.col("勝者") == F.col("チームA"), "a").when(F.col("勝者") == F.col("チームB"), "b")
    keep = ["年度", "大会", "段階", "ラウンド", "チームA_正規化", "チームB_正規化", "取込日時", "seq"]
    rows = matches.withColumns({"by_score": by_score, "side": F.coalesce(by_score, named)})
    told = rows.where("side is not null").select(*keep, "by_score", "side", F.lit(None).cast("string").alias("looked_up"))
    # winners written otherwise than the sides are looked up by their cleaned spelling
    known = clusters.select(F.col("name").alias("clean"), F.col("cluster").alias("looked_up"))
    open_ = rows.where("side is null and `勝者` is not null").withColumn("clean", _mechanical("勝者")).join(known, "clean").select(*keep, "by_score", "side", "looked_up")
    rows = with_schools(told.unionByName(open_), clusters).where("sa <> sb")
    looked = F.when(F.col("looked_up").isin(F.col("sa"), F.col("sb")), F.col("looked_up"))
    rows = rows.withColumn("winner", F.coalesce(F.when(F.col("side") == "a", F.col("sa")).when(F.col("side") == "b", F.col("sb")), looked)).where("winner is not null")
    rank = F.struct(F.col("by_score").isNotNull().alias("sure"), F.col("取込日時").alias("at"), (-F.col("seq")).alias("tie"))
    once = rows.groupBy("年度", "大会", "段階", "ラウンド", "s1", "s2").agg(F.max_by("winner", rank).alias("winner"))
    return once.select("winner", F.when(F.col("winner") == F.col("s1"), F.col("s2")).otherwise(F.col("s1")).alias("loser")).groupBy("winner", "loser").agg(F.count("*").alias("n"))


def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """(rank, school, mu, sigma, lower, wins, losses) of all schools of matches."""
    matches = spark.read.parquet(f"{folder}/matches.parquet")
    clusters = checkpointed(school_clusters(matches).select("name", "cluster"))
    collect_garbage(spark)
    edges = checkpointed(outcomes(matches, clusters))
    collect_garbage(spark)
    items = checkpointed(clusters.select(F.col("cluster").alias("item")).distinct())
    skills = infer_skills(edges, items)
    tally = (
        edges.select(F.col("winner").alias("item"), F.col("n").alias("wins"), F.lit(0).alias("losses"))
        .unionByName(edges.select(F.col("loser").alias("item"), F.lit(0).alias("wins"), F.col("n").alias("losses")))
        .groupBy("item").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
    )
    full = skills.join(tally, "item", "left").select(
        F.col("item").alias("school"), F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"), F.round(F.col("mu") - 3 * F.col("sigma"), 4).alias("lower"),
        F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("losses", F.lit(0)).alias("losses"),
    )
    return global_rank(full, F.col("lower").desc(), F.col("school"))
