"""Opponent paths and knockout brackets by joins (SURVEY G, B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges(views: DataFrame) -> DataFrame:
    """Oriented edges; parallel edges stay, self-edges go; d is the goal difference clamped to 5, 0 after
    penalties."""
    pk = F.col("pf").isNotNull() & F.col("pg").isNotNull()
    d = F.when(pk, 0).otherwise(F.greatest(F.lit(-5), F.least(F.lit(5), F.col("gf") - F.col("ga"))))
    return views.where("opp is not null and me <> opp").select("seq", "season", F.col("me").alias("x"), F.col("opp").alias("y"), d.alias("d"), "res")


HOP_WEIGHT = {1: 1.0, 2: 0.5, 3: 0.25}


def paths(e: DataFrame, me: str, opp: str, season: int, hops: int = 3) -> DataFrame:
    """Paths of one to `hops` contests between two sides: weight of the length times 0.7 per year of age of each
    contest, rounded to 4 places, implied difference as the sum, intermediates other than the ends.

    The two ends are filtered before any join, so the middle join sees only edges next to one of them.
    """
    age = lambda c: F.pow(F.lit(0.7), F.greatest(F.lit(0), F.lit(season) - F.col(c)))
    w = e.withColumn("w", age("season"))
    first = w.where(F.col("x") == me).select(F.col("y").alias("m1"), F.col("d").alias("d1"), F.col("w").alias("w1"), F.col("seq").alias("s1"))
    last = w.where(F.col("y") == opp).select(F.col("x").alias("m2"), F.col("d").alias("d2"), F.col("w").alias("w2"), F.col("seq").alias("s2"))
    none = F.lit(None).cast("string")
    out = first.where(F.col("m1") == opp).select(F.lit(1).alias("hops"), none.alias("m1"), none.alias("m2"), (F.lit(HOP_WEIGHT[1]) * F.col("w1")).alias("weight"), F.col("d1").alias("implied"), F.col("s1").cast("string").alias("path"))
    f, l = first.where(F.col("m1") != opp), last.where(F.col("m2") != me)
    if hops >= 2:
        two = f.join(l, F.col("m1") == F.col("m2"))
        out = out.unionByName(two.select(F.lit(2).alias("hops"), "m1", none.alias("m2"), (F.lit(HOP_WEIGHT[2]) * F.col("w1") * F.col("w2")).alias("weight"), (F.col("d1") + F.col("d2")).alias("implied"), F.concat_ws("-", "s1", "s2").alias("path")))
    if hops >= 3:
        mid = w.where((F.col("x") != me) & (F.col("x") != opp) & (F.col("y") != me) & (F.col("y") != opp)).select(F.col("x").alias("mx"), F.col("y").alias("my"), F.col("d").alias("dm"), F.col("w").alias("wm"), F.col("seq").alias("sm"))
        three = f.join(mid, F.col("m1") == F.col("mx")).join(l, F.col("my") == F.col("m2"))
        out = out.unionByName(three.select(F.lit(3).alias("hops"), "m1", "m2", (F.lit(HOP_WEIGHT[3]) * F.col("w1") * F.col("wm") * F.col("w2")).alias("weight"), (F.col("d1") + F.col("dm") + F.col("d2")).alias("implied"), F.concat_ws("-", "s1", "sm", "s2").alias("path")))
    return out.withColumn("weight", F.round("weight", 4))


def path_summary(p: DataFrame) -> DataFrame:
    """Numbers by length and direction and the weighted mean of the implied difference."""
    return p.agg(
        F.count("*").alias("n"), F.count_if(F.col("hops") == 1).alias("direct"), F.count_if(F.col("hops") == 2).alias("two"), F.count_if(F.col("hops") == 3).alias("three"),
        F.count_if(F.col("implied") > 0).alias("up"), F.count_if(F.col("implied") < 0).alias("down"), F.count_if(F.col("implied") == 0).alias("even"),
        F.try_divide(F.sum(F.col("weight") * F.col("implied")), F.sum("weight")).alias("mean"), F.sum("weight").alias("total"),
    )


def path_pick(p: DataFrame, n: int = 8) -> DataFrame:
    """The heaviest path of each chain of intermediates, then the n heaviest."""
    w = Window.partitionBy("hops", "m1", "m2").orderBy(F.col("weight").desc(), F.abs("implied").desc(), "path")
    return p.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").orderBy(F.round("weight", 9).desc(), F.abs("implied").desc(), "path").limit(n)


def common_opponents(views: DataFrame, x: str, y: str) -> DataFrame:
    """Opponents of both, with the balance and the latest result of each."""
    v = views.where(F.col("opp").isNotNull())

    def side(name: str, p: str) -> DataFrame:
        return v.where(F.col("me") == name).groupBy("opp").agg(
            F.count("*").alias(f"{p}_n"), F.count_if(F.col("res") == "○").alias(f"{p}_w"), F.max_by("res", F.struct("season", "seq")).alias(f"{p}_last")
        )

    return side(x, "x").join(side(y, "y"), "opp")


def win_prob(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def advance(leaves: DataFrame, rounds: int, decided: DataFrame | None = None) -> DataFrame:
    """Probability of each leaf of a bracket to win its sub-tree after each round, level by level.

    leaves: (pos 0..2^rounds - 1, team, rating). decided (winner, loser): pairs whose result is known count as sure
    when they meet. One self-join on the block number per level.
    """
    now = leaves.select("pos", "team", "rating", F.lit(1.0).alias("p"))
    levels = [now.withColumn("round", F.lit(0))]
    for r in range(1, rounds + 1):
        block = F.shiftright("pos", r)
        half = F.shiftright("pos", r - 1)
        a = now.select(F.col("pos"), "team", "rating", "p", block.alias("block"), half.alias("half"))
        b = now.select(block.alias("block"), half.alias("other"), F.col("team").alias("opp"), F.col("rating").alias("opp_rating"), F.col("p").alias("opp_p"))
        j = a.join(b, "block").where("half <> other")
        chance = win_prob(F.col("rating"), F.col("opp_rating"))
        if decided is not None:
            won = decided.select(F.col("winner").alias("team"), F.col("loser").alias("opp"), F.lit(1.0).alias("sure_w"))
            lost = decided.select(F.col("loser").alias("team"), F.col("winner").alias("opp"), F.lit(0.0).alias("sure_l"))
            j = j.join(won, ["team", "opp"], "left").join(lost, ["team", "opp"], "left")
            chance = F.coalesce("sure_w", "sure_l", chance)
        now = j.groupBy("pos", "team", "rating").agg((F.first("p") * F.sum(F.col("opp_p") * chance)).alias("p"))
        levels.append(now.withColumn("round", F.lit(r)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("round", "pos", "team", "p")


def predicted_winner(leaves: DataFrame, rounds: int) -> DataFrame:
    """The winner of every node when the better rating (ties: the upper half) always wins."""
    now = leaves.select("pos", "team", "rating")
    out = None
    for r in range(1, rounds + 1):
        node = now.withColumn("node", F.shiftright("pos", r))
        now = node.groupBy("node").agg(F.max_by(F.struct("pos", "team", "rating"), F.struct("rating", -F.col("pos"))).alias("w")).select("w.*", "node")
        level = now.select(F.lit(r).alias("round"), "node", "team")
        out = level if out is None else out.unionByName(level)
        now = now.drop("node")
    return out


def round_names(g: DataFrame) -> DataFrame:
    """A round's name by its distance from the last column of its tree (document, page, block)."""
    w = Window.partitionBy("doc", "page", "block")
    left = F.max("col").over(w) - F.col("col")
    name = F.when(F.col("block").isNotNull() & (left == 0), "ブロック決勝").when(left == 0, "決勝").when(F.col("block").isNull() & (left == 1), "準決勝").when(F.col("block").isNull() & (left == 2), "準々決勝").otherwise(F.concat(F.col("col").cast("string"), F.lit("回戦")))
    return g.where("doc is not null").select("seq", name.alias("name"))


def first_round_blocks(g: DataFrame) -> DataFrame:
    """The blocks of a document: their sides in order of appearance, who has lost, how many contests are played."""
    side = g.where("doc is not null and block is not null").select(
        "doc", "block", "seq", "winner", "raw_a", "raw_b", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("t"), F.col("raw_a").alias("raw")), F.struct(F.lit(1).alias("k"), F.col("b").alias("t"), F.col("raw_b").alias("raw")))).alias("s")
    ).where("s.t is not null")
    decided = F.col("winner").isNotNull() & ((F.col("winner") == F.col("raw_a")) | (F.col("winner") == F.col("raw_b")))
    per = side.groupBy("doc", "block", F.col("s.t").alias("team")).agg(F.min(F.struct("seq", F.col("s.k").alias("k"))).alias("first"), F.bool_or(F.coalesce(decided & (F.col("winner") != F.col("s.raw")), F.lit(False))).alias("lost"))
    return per.groupBy("doc", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "team"))), lambda x: x["team"]), "・").alias("teams"), F.count_if(F.col("lost")).alias("lost"), F.count("*").alias("n")
    )
