"""Deduplication and reconciliation of overlapping records, surrogate keys and integrity checks (SURVEY D, I, J, Q).

Every operator is a DataFrame function; what it drops comes back as a second frame or carries a flag, so that nothing
is lost silently. All windows are partitioned by the contest's own key, never by a hot constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ranking import global_rank
from .perspective import PLAYED, both_sides


def is_played() -> Column:
    return F.coalesce(F.col("status").isin(*PLAYED) & F.col("sa").isNotNull() & F.col("sb").isNotNull(), F.lit(False))


def version_dedup(g: DataFrame) -> DataFrame:
    """Per contest (season, series, stage, round, unordered pair) the first row, or the first with both scores.

    Adds `kept`; rows with a blank side are always kept.
    """
    key = ["season", "series", "stage", "round", F.least("a", "b"), F.greatest("a", "b")]
    w = Window.partitionBy(*key).orderBy((F.col("sa").isNotNull() & F.col("sb").isNotNull()).desc(), "seq")
    named = g.where("a is not null and b is not null").withColumn("kept", F.row_number().over(w) == 1)
    blank = g.where("a is null or b is null").withColumn("kept", F.lit(True))
    return named.unionByName(blank)


def feeds_of(g: DataFrame) -> DataFrame:
    """Five overlapping feeds out of all contests: the last feed holds every contest, feed k those whose seq mod 7 is at
    most k, undated every third time, sides exchanged in the even feeds."""
    feeds = g.sparkSession.createDataFrame([(k, f"f{k}") for k in range(5)], "k int, feed string")
    j = g.where(is_played() & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).crossJoin(F.broadcast(feeds)).where("k = 4 or seq % 7 <= k")
    even = F.col("k") % 2 == 0
    return j.select(
        "feed", F.col("seq").alias("src_seq"), "season", F.col("series").alias("league"), F.when(F.col("seq") % 3 != F.col("k") % 3, F.col("date_text")).alias("date"),
        F.when(even, F.col("b")).otherwise(F.col("a")).alias("home"), F.when(even, F.col("a")).otherwise(F.col("b")).alias("away"),
        F.when(even, F.col("sb")).otherwise(F.col("sa")).alias("hs"), F.when(even, F.col("sa")).otherwise(F.col("sb")).alias("as_"),
    )


def multiset_merge(feeds: DataFrame) -> DataFrame:
    """Copies of a result (season, unordered school and score pairs) are kept as often as the feed that has it
    most often; dated rows first, then feed, then file order. Adds `kept`."""
    sides = F.array_sort(F.array(F.struct(F.col("home").alias("t"), F.col("hs").alias("s")), F.struct(F.col("away").alias("t"), F.col("as_").alias("s"))))
    keyed = feeds.withColumn("key", F.to_json(sides))
    per = keyed.groupBy("season", "key", "feed").agg(F.count("*").alias("c")).groupBy("season", "key").agg(F.max("c").alias("allowed"))
    w = Window.partitionBy("season", "key").orderBy(F.col("date").isNull(), "feed", "src_seq")
    return keyed.withColumn("k", F.row_number().over(w)).join(per, ["season", "key"]).withColumn("kept", F.col("k") <= F.col("allowed")).drop("key", "k", "allowed")


def bogus_reads(g: DataFrame, least: int = 8, share: float = 0.30, one_sided: int = 6) -> DataFrame:
    """Per document, scores to retract (one side only; a score pair at least 8 times and 30 % of the complete rows)
    and winners to retract (all on one side, at least six). Adds `drop_score`, `drop_winner` and the remark with what was
    taken back. Rows with a true `corrected`, where that column exists, are counted but not touched."""
    side = F.when(F.col("winner") == F.col("raw_a"), 1).when(F.col("winner") == F.col("raw_b"), 2)
    d = g.where("doc is not null").withColumn("slot", side)
    free = ~F.coalesce(F.col("corrected"), F.lit(False)) if "corrected" in g.columns else F.lit(True)
    by_doc, by_pair = Window.partitionBy("doc"), Window.partitionBy("doc", "sa", "sb")
    whole = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    n_pair = F.when(whole, F.count("*").over(by_pair))
    n_whole = F.count_if(whole).over(by_doc)
    partial = F.col("sa").isNull() != F.col("sb").isNull()
    n_win, lo, hi = F.count("slot").over(by_doc), F.min("slot").over(by_doc), F.max("slot").over(by_doc)
    return d.withColumns({
        "drop_score": free & (partial | F.coalesce((n_pair >= least) & (n_pair >= share * n_whole), F.lit(False))),
        "drop_winner": free & F.coalesce(F.col("slot").isNotNull() & (lo == hi) & (n_win >= one_sided), F.lit(False)),
    }).withColumn("note", F.nullif(F.concat_ws("／", "note", F.when(F.col("drop_score"), "スコアの読み取りを取り消し"), F.when(F.col("drop_winner"), "勝者の読み取りを取り消し")), F.lit("")))


def fill_missing(g: DataFrame, external: DataFrame) -> DataFrame:
    """Scores for rows without one, from external results of the same season, series, stage and unordered pair.

    All candidates have to agree after turning them to the row's sides; a candidate that contradicts the recorded
    winner is a conflict. Outcome: filled, ambiguous, conflict or missing.
    """
    e = external.select("season", "series", "stage", F.least("ea", "eb").alias("p1"), F.greatest("ea", "eb").alias("p2"), "ea", "esa", "esb").where("esa is not null and esb is not null")
    open_ = g.where("sa is null and a is not null and b is not null").select("seq", "season", "series", "stage", "a", "b", "raw_a", "raw_b", "winner", F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2"))
    j = open_.join(e, ["season", "series", "stage", "p1", "p2"], "left")
    mine = F.when(F.col("ea") == F.col("a"), F.struct(F.col("esa").alias("x"), F.col("esb").alias("y"))).when(F.col("ea").isNotNull(), F.struct(F.col("esb").alias("x"), F.col("esa").alias("y")))
    c = j.groupBy("seq").agg(F.count_distinct(mine).alias("n"), F.min(mine).alias("s"), F.first("winner").alias("winner"), F.first("raw_a").alias("raw_a"), F.first("raw_b").alias("raw_b"))
    slot = F.when(F.col("winner") == F.col("raw_a"), 1).when(F.col("winner") == F.col("raw_b"), 2)
    says = F.when(F.col("s.x") > F.col("s.y"), 1).when(F.col("s.x") < F.col("s.y"), 2)
    out = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(slot != says, "conflict").otherwise("filled")
    return c.select("seq", out.alias("outcome"), F.when(out == "filled", F.col("s.x")).alias("fill_a"), F.when(out == "filled", F.col("s.y")).alias("fill_b"))


CORRECTABLE = ("score1", "score2", "pk1", "pk2", "winner_slot", "notes")


def apply_corrections(g: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections by document and the two printed names, the latest per field, pivoted onto the rows.

    slot is the corrected, else the printed winner's; `fields` names the fields a correction was found for.
    """
    c = corrections.groupBy(F.regexp_replace(F.lower("file"), r"\.pdf$", "").alias("d"), F.col("team1").alias("raw_a"), F.col("team2").alias("raw_b"))
    wide = c.agg(*[F.max_by("value", F.when(F.col("field") == f, F.col("corr_seq"))).alias(f"c_{f}") for f in CORRECTABLE])
    keyed = g.withColumn("d", F.regexp_replace(F.lower("doc"), r"\.pdf$", ""))
    j = keyed.join(wide, ["d", "raw_a", "raw_b"], "left")
    number = lambda f, c: F.coalesce(F.col(f"c_{f}").try_cast("int"), c).alias(c)
    printed = F.when(F.col("winner") == F.col("raw_a"), 1).when(F.col("winner") == F.col("raw_b"), 2)
    slot = F.col("c_winner_slot").try_cast("int")
    fields = F.array_compact(F.array(*[F.when(F.col(f"c_{f}").isNotNull(), F.lit(f)) for f in CORRECTABLE]))
    return j.select(
        "seq", number("score1", "sa"), number("score2", "sb"), number("pk1", "pa"), number("pk2", "pb"), F.when(slot.isin(1, 2), slot).otherwise(printed).alias("slot"),
        F.coalesce("c_notes", "note").alias("note"), (F.size(fields) > 0).alias("corrected"), fields.alias("fields"),
    )


def infer_winner(g: DataFrame) -> DataFrame:
    """The winner's slot: printed, else by score, else by penalties, with its basis."""
    printed = F.when(F.col("winner") == F.col("raw_a"), 1).when(F.col("winner") == F.col("raw_b"), 2)
    scored = F.when(F.col("sa") > F.col("sb"), 1).when(F.col("sa") < F.col("sb"), 2).when(F.col("pa") > F.col("pb"), 1).when(F.col("pa") < F.col("pb"), 2)
    basis = F.when(F.coalesce("note", F.lit("")).contains("目視で訂正") & F.coalesce(printed, scored).isNotNull(), "訂正").when(printed.isNotNull(), F.when(F.col("status").isin(PLAYED[1], PLAYED[2]), "スコア").otherwise("赤線")).when(scored.isNotNull(), "スコア")
    return g.select("seq", F.coalesce(printed, scored).alias("slot"), basis.alias("basis"))


def name_conflicts(g: DataFrame) -> DataFrame:
    """Printed names that were normalised to more than one school."""
    return both_sides(g).where("raw is not null").groupBy("raw").agg(F.count_distinct("me").alias("schools")).where("schools > 1")


def newest_publication(g: DataFrame) -> DataFrame:
    """Per season, series and stage the document with the highest version; equal versions keep the first."""
    v = g.where("doc is not null").withColumn("v", F.coalesce(F.regexp_extract("doc", r"_v(\d+)", 1).try_cast("int"), F.lit(1)))
    return v.groupBy("season", "series", "stage").agg(F.max_by("doc", F.struct("v", -F.col("seq"))).alias("doc"), F.max("v").alias("version"))


def surrogate_ids(g: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing ids never change; new ones follow the maximum in order of first season, then name."""
    seen = both_sides(g).groupBy(F.col("me").alias("name")).agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    j = seen.join(existing, "name", "left")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = global_rank(j.where("id is null"), F.col("first_season"), F.col("name"), name="k").crossJoin(F.broadcast(top))
    old = j.where("id is not null")
    cols = ["name", "first_season", "last_season"]
    return old.select(*cols, "id").unionByName(fresh.select(*cols, (F.col("k") + F.col("top")).alias("id"))).withColumn("school_id", F.format_string("S%04d", "id")).drop("id")


def match_ids(g: DataFrame) -> DataFrame:
    """Competition, sorted sides (∅ and the printed name for blanks) and #n for repeats."""
    side = lambda k, raw: F.coalesce(F.col(k), F.concat(F.lit("∅"), F.coalesce(raw, F.lit(""))))
    x, y = side("a", "raw_a"), side("b", "raw_b")
    base = F.concat_ws("-", F.col("season").cast("string"), "series", "stage", F.least(x, y), F.greatest(x, y))
    j = g.withColumn("base", base)
    n = F.row_number().over(Window.partitionBy("base").orderBy("seq"))
    return j.select("seq", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), n.cast("string"))).alias("match_id"))


def status_codes(g: DataFrame) -> DataFrame:
    """I8: the lossy status code and its inverse through the presence of scores."""
    whole = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    code = F.when(F.col("status").isin(*PLAYED), "済").when(F.col("status") == "不戦勝・棄権", "不戦").when(F.col("status") == "スコア記載なし", "勝者のみ").when(F.col("status") == "勝者不明", "結果不明").otherwise("予定")
    back = F.when(code == "済", F.when(whole, "終了").otherwise("スコア記載なし")).when(code == "不戦", "不戦勝・棄権").when(code == "勝者のみ", "スコア記載なし").when(code == "結果不明", "勝者不明").otherwise("未実施")
    return g.select("seq", code.alias("code"), back.alias("back"))


def check_problems(g: DataFrame, roster: DataFrame) -> DataFrame:
    """Q1-Q5: (check_id, key, problems) of every check that fails; check_report adds Q6 and the messages."""
    side = both_sides(g)
    won = F.when(F.col("winner") == F.col("raw_a"), 1).when(F.col("winner") == F.col("raw_b"), 2)
    by = F.when(F.col("sa") > F.col("sb"), 1).when(F.col("sa") < F.col("sb"), 2).when(F.col("pa") > F.col("pb"), 1).when(F.col("pa") < F.col("pb"), 2)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    q1 = g.groupBy(F.concat_ws("|", s("doc"), s("page"), s("match_no"), s("round"), s("a"), s("b")).alias("key")).agg(F.count("*").alias("problems")).where("problems > 1")
    q2 = side.join(roster.select(F.col("key").alias("me")), "me", "left_anti").groupBy(F.col("me").alias("key")).agg(F.count("*").alias("problems"))
    q3 = g.where(F.col("status").isin(*PLAYED) & ((F.col("sa").isNull() | F.col("sb").isNull()) | (won != by))).select(F.col("seq").cast("string").alias("key"), F.lit(1).cast("bigint").alias("problems"))
    tree = side.where("block is not null").groupBy("season", "series", "stage", "area", "doc", "page", "block").agg(F.count_distinct("me").alias("teams"), F.count_distinct("seq").alias("n"))
    q4 = tree.where("n > teams - 1").select(F.concat_ws("|", *[s(c) for c in ("season", "series", "stage", "area", "doc", "page", "block")]).alias("key"), (F.col("n") - F.col("teams") + 1).alias("problems"))
    q5 = side.groupBy(F.concat_ws("|", *[s(c) for c in ("season", "series", "stage", "area", "page", "round", "me")]).alias("key")).agg(F.count("*").alias("problems")).where("problems > 1")
    parts = [("Q1", q1), ("Q2", q2), ("Q3", q3), ("Q4", q4), ("Q5", q5)]
    out = None
    for name, q in parts:
        row = q.select(F.lit(name).alias("check_id"), "key", F.col("problems").cast("bigint").alias("problems"))
        out = row if out is None else out.unionByName(row)
    return out


MESSAGES = {
    "Q1": "recorded more than once", "Q2": "school not in the roster", "Q3": "played without both scores, or the winner contradicts the score",
    "Q4": "more contests than a bracket of these sides has", "Q5": "side more than once in a round", "Q6": "printed name neither registered nor exempt",
}


def check_report(g: DataFrame, roster: DataFrame) -> DataFrame:
    """Q1-Q6, Q11: (check_id, key, problems, message) of every check that fails.

    Q6: a printed name is registered if it or its normalised name is in the roster; those of more than one school (D8)
    are the known issues and exempt.
    """
    sides = [g.select(F.col(f"raw_{k}").alias("raw"), F.col(k).alias("me")).where(f"raw_{k} is not null") for k in "ab"]
    raw = sides[0].unionByName(sides[1])
    known = roster.select("key").where("key is not null").distinct()
    registered = raw.join(known.withColumnRenamed("key", "me"), "me", "left_semi").select("raw").unionByName(known.select(F.col("key").alias("raw"))).distinct()
    exempt = name_conflicts(g).select("raw")
    q6 = raw.join(registered, "raw", "left_anti").join(exempt, "raw", "left_anti").groupBy(F.col("raw").alias("key")).agg(F.count("*").alias("problems"))
    full = check_problems(g, roster).unionByName(q6.select(F.lit("Q6").alias("check_id"), "key", "problems"))
    text = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return full.withColumn("message", F.format_string("%s: %s (%d)", F.coalesce("key", F.lit("-")), text[F.col("check_id")], "problems"))


def run_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Q10: rows of either run that the other lacks, with multiplicity."""
    return left.exceptAll(right).withColumn("side", F.lit("only left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("only right")))
