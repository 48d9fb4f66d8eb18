"""Queries for deduplication, reconciliation, surrogate keys and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import perspective as P
from ..operators import reconcile as R
from ..session import table
from .ranking import global_rank

G, V = P.GAMES_SQL, P.VIEWS_SQL
PLAYED = "(status in ('終了', 'スコアのみ記載（赤線未反映）', '赤線が両側（スコアで判定）') and sa is not null and sb is not null)"


def _g(spark: SparkSession, d: str) -> DataFrame:
    return P.games(spark, d)


def version_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.version_dedup(_g(spark, d)).where("kept").select("seq")


def version_dedup_dropped(spark: SparkSession, d: str) -> DataFrame:
    return R.version_dedup(_g(spark, d)).where("not kept").select("seq")


def multifeed_merge(spark: SparkSession, d: str) -> DataFrame:
    return R.multiset_merge(R.feeds_of(_g(spark, d))).where("kept").select("feed", "src_seq", "season", "home", "away", "hs", F.col("as_").alias("away_score"))


def multifeed_dropped(spark: SparkSession, d: str) -> DataFrame:
    return R.multiset_merge(R.feeds_of(_g(spark, d))).where("not kept").select("feed", "src_seq")


def feed_union_counts(spark: SparkSession, d: str) -> DataFrame:
    """The union of the feeds by kind."""
    return R.feeds_of(_g(spark, d)).groupBy("feed").agg(F.count("*").alias("n"), F.count("date").alias("dated"))


def bogus_retraction(spark: SparkSession, d: str) -> DataFrame:
    return R.bogus_reads(_g(spark, d)).where("drop_score or drop_winner").select("seq", "drop_score", "drop_winner")


def _external(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "external_results")
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(東京都立|都立|都)", ""), r"(高等学校|高校|高)$", "")
    return e.select(
        F.col("年度").alias("season"), F.col("大会").alias("series"), F.col("段階").alias("stage"), clean("チームA").alias("ea"), clean("チームB").alias("eb"),
        P.number(F.col("得点A")).alias("esa"), P.number(F.col("得点B")).alias("esb"),
    )


def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    return R.fill_missing(_g(spark, d), _external(spark, d))


def fill_counters(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The part that the SQL has: both scores and the note; `corrected` says whether one of these was."""
    c = R.apply_corrections(_g(spark, d), table(spark, d, "corrections"))
    return c.select("seq", "sa", "sb", "note", F.arrays_overlap("fields", F.array(F.lit("score1"), F.lit("score2"), F.lit("notes"))).alias("corrected"))


def corrected_contests(spark: SparkSession, d: str) -> DataFrame:
    """Contests with all six correctable fields applied."""
    return R.apply_corrections(_g(spark, d), table(spark, d, "corrections"))


def infer_winner(spark: SparkSession, d: str) -> DataFrame:
    return R.infer_winner(_g(spark, d))


def name_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return R.name_conflicts(_g(spark, d))


def newest_publication(spark: SparkSession, d: str) -> DataFrame:
    return R.newest_publication(_g(spark, d))


def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Existing ids: the roster, numbered by key."""
    roster = table(spark, d, "school_roster").select("key")
    existing = global_rank(roster.select(F.col("key").alias("name")), F.col("name"), name="id")
    return R.surrogate_ids(_g(spark, d), existing)


def match_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.match_ids(_g(spark, d))


def status_codes(spark: SparkSession, d: str) -> DataFrame:
    return R.status_codes(_g(spark, d))


def check_problems(spark: SparkSession, d: str) -> DataFrame:
    return R.check_problems(_g(spark, d), table(spark, d, "school_roster"))


def check_report(spark: SparkSession, d: str) -> DataFrame:
    """Q1-Q6, Q11: every check that fails with its message."""
    return R.check_report(_g(spark, d), table(spark, d, "school_roster"))


def fk_anti(spark: SparkSession, d: str) -> DataFrame:
    """Q2: documents whose source is not registered, orders without customer, lines without order."""
    t = lambda n: table(spark, d, n)
    a = t("documents").join(t("doc_sources"), "source", "left_anti").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"))
    b = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("orders"), "o_orderkey")
    c = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("lineitem"), "l_orderkey")
    return a.union(b).union(c)


def run_difference(spark: SparkSession, d: str) -> DataFrame:
    """Q10: the table against its deduplicated run."""
    g = _g(spark, d).select("season", "series", "a", "b")
    return R.run_difference(g, R.version_dedup(_g(spark, d)).where("kept").select("season", "series", "a", "b"))


def cross_source_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the external record agrees with the contests, per season."""
    e = _external(spark, d)
    e = e.select("season", "series", "stage", F.least("ea", "eb").alias("p1"), F.greatest("ea", "eb").alias("p2"), F.when(F.col("ea") <= F.col("eb"), F.col("esa")).otherwise(F.col("esb")).alias("x"), F.when(F.col("ea") <= F.col("eb"), F.col("esb")).otherwise(F.col("esa")).alias("y"))
    g = P.played(_g(spark, d)).where("a is not null and b is not null")
    g = g.select("season", "series", "stage", F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2"), F.when(F.col("a") <= F.col("b"), F.col("sa")).otherwise(F.col("sb")).alias("gx"), F.when(F.col("a") <= F.col("b"), F.col("sb")).otherwise(F.col("sa")).alias("gy"))
    j = g.join(e, ["season", "series", "stage", "p1", "p2"])
    return j.groupBy("season").agg(F.count("*").alias("n"), F.count_if((F.col("x") == F.col("gx")) & (F.col("y") == F.col("gy"))).alias("agree"))


def queries() -> dict:
    return {f.__name__: f for f in (
        version_dedup, version_dedup_dropped, multifeed_merge, multifeed_dropped, feed_union_counts, bogus_retraction, fill_missing, fill_counters, apply_corrections, corrected_contests,
        infer_winner, name_conflicts, newest_publication, surrogate_ids, match_ids, status_codes, check_problems, check_report, fk_anti, run_difference, cross_source_agreement,
    )}


_DEDUP = f"""with {G}, k as (select *, row_number() over (partition by season, series, stage, round, least(a, b), greatest(a, b) order by (sa is not null and sb is not null) desc, seq) = 1 kept from games where a is not null and b is not null
 union all select *, true from games where a is null or b is null)"""
_FEEDS = f"""with {G}, feeds as (select 'f' || k feed, seq src_seq, season, case when seq % 3 <> k % 3 then date_text end date, case when k % 2 = 0 then b else a end home, case when k % 2 = 0 then a else b end away,
 case when k % 2 = 0 then sb else sa end hs, case when k % 2 = 0 then sa else sb end away_score from games, (select unnest([0, 1, 2, 3, 4]) k) where {PLAYED} and a <> b and (k = 4 or seq % 7 <= k))"""
_MERGE = f"""{_FEEDS}, x as (select *, case when (home, hs) <= (away, away_score) then home || '#' || hs || '#' || away || '#' || away_score else away || '#' || away_score || '#' || home || '#' || hs end key from feeds),
 p as (select season, key, max(c) allowed from (select season, key, feed, count(*) c from x group by all) group by season, key),
 r as (select *, row_number() over (partition by season, key order by date is null, feed, src_seq) k from x), m as (select r.*, k <= allowed kept from r join p using (season, key))"""
_CLEAN = "regexp_replace(regexp_replace({0}, '^(東京都立|都立|都)', ''), '(高等学校|高校|高)$', '')"
_EXT = f"""ext as (select "年度" season, "大会" series, "段階" stage, {_CLEAN.format('"チームA"')} ea, {_CLEAN.format('"チームB"')} eb, case when regexp_matches("得点A", '^-?[0-9]{{1,9}}$') then cast("得点A" as int) end esa,
 case when regexp_matches("得点B", '^-?[0-9]{{1,9}}$') then cast("得点B" as int) end esb from external_results)"""
_FILL = f"""with {G}, {_EXT}, o as (select *, least(a, b) p1, greatest(a, b) p2 from games where sa is null and a is not null and b is not null),
 c as (select o.seq, any_value(o.winner) winner, any_value(o.raw_a) raw_a, any_value(o.raw_b) raw_b,
 list(distinct case when e.ea = o.a then [esa, esb] else [esb, esa] end) filter (e.ea is not null) l from o left join (select * from ext where esa is not null and esb is not null) e
 on e.season = o.season and e.series = o.series and e.stage = o.stage and least(e.ea, e.eb) = p1 and greatest(e.ea, e.eb) = p2 group by o.seq),
 f as (select seq, case when len(coalesce(l, [])) = 0 then 'missing' when len(l) > 1 then 'ambiguous'
 when (case when winner = raw_a then 1 when winner = raw_b then 2 end) <> (case when l[1][1] > l[1][2] then 1 when l[1][1] < l[1][2] then 2 end) then 'conflict' else 'filled' end outcome, l from c)"""


def oracle_sql() -> dict[str, str]:
    won = "case when winner = raw_a then 1 when winner = raw_b then 2 end"
    by = "case when sa > sb then 1 when sa < sb then 2 when pa > pb then 1 when pa < pb then 2 end"
    s = lambda c: f"coalesce(cast({c} as varchar), '-')"
    cat = lambda *c: "concat_ws('|', " + ", ".join(map(s, c)) + ")"
    code = "case when status in ('終了', 'スコアのみ記載（赤線未反映）', '赤線が両側（スコアで判定）') then '済' when status = '不戦勝・棄権' then '不戦' when status = 'スコア記載なし' then '勝者のみ' when status = '勝者不明' then '結果不明' else '予定' end"
    return {
        "version_dedup": f"{_DEDUP} select seq from k where kept",
        "version_dedup_dropped": f"{_DEDUP} select seq from k where not kept",
        "multifeed_merge": f"{_MERGE} select feed, src_seq, season, home, away, hs, away_score from m where kept",
        "multifeed_dropped": f"{_MERGE} select feed, src_seq from m where not kept",
        "feed_union_counts": f"{_FEEDS} select feed, count(*) n, count(date) dated from feeds group by feed",
        "bogus_retraction": f"""with {G}, d as (select *, {won} slot, sa is not null and sb is not null whole from games where doc is not null),
 n as (select *, case when whole then count(*) over (partition by doc, sa, sb) end np, count(*) filter (whole) over (partition by doc) nw, count(slot) over (partition by doc) nwin,
 min(slot) over (partition by doc) lo, max(slot) over (partition by doc) hi from d), f as (select seq, ((sa is null) <> (sb is null)) or coalesce(np >= 8 and np >= 0.30 * nw, false) drop_score,
 coalesce(slot is not null and lo = hi and nwin >= 6, false) drop_winner from n) select * from f where drop_score or drop_winner""",
        "fill_missing": f"{_FILL} select seq, outcome, case when outcome = 'filled' then l[1][1] end fill_a, case when outcome = 'filled' then l[1][2] end fill_b from f",
        "fill_counters": f"{_FILL} select outcome, count(*) n from f group by outcome",
        "apply_corrections": f"""with {G}, w as (select regexp_replace(lower(file), '\\.pdf$', '') d, team1, team2, arg_max(value, corr_seq) filter (field = 'score1') c1, arg_max(value, corr_seq) filter (field = 'score2') c2,
 arg_max(value, corr_seq) filter (field = 'notes') cn from corrections group by 1, 2, 3)
 select seq, coalesce(try_cast(c1 as int), sa) sa, coalesce(try_cast(c2 as int), sb) sb, coalesce(cn, note) note, coalesce(c1, c2, cn) is not null corrected
 from games left join w on w.d = regexp_replace(lower(doc), '\\.pdf$', '') and team1 = raw_a and team2 = raw_b""",
        "infer_winner": f"""with {G}, w as (select *, {won} p, {by} s from games) select seq, coalesce(p, s) slot, case when contains(coalesce(note, ''), '目視で訂正') and coalesce(p, s) is not null then '訂正'
 when p is not null then case when status in ('スコアのみ記載（赤線未反映）', '赤線が両側（スコアで判定）') then 'スコア' else '赤線' end when s is not null then 'スコア' end basis from w""",
        "name_conflicts": f"with {G}, {V.format('games')} select raw, count(distinct me) schools from views where raw is not null group by raw having count(distinct me) > 1",
        "newest_publication": f"""with {G}, v as (select *, coalesce(try_cast(nullif(regexp_extract(doc, '_v(\\d+)', 1), '') as int), 1) v from games where doc is not null)
 select season, series, stage, doc, v as version from (select *, row_number() over (partition by season, series, stage order by v desc, seq) k from v) where k = 1""",
        "surrogate_ids": f"""with {G}, {V.format('games')}, s as (select me name, min(season) first_season, max(season) last_season from views group by me), e as (select key name, row_number() over (order by key) id from school_roster),
 j as (select s.*, e.id from s left join e using (name)), t as (select coalesce(max(id), 0) top from e)
 select name, first_season, last_season, printf('S%04d', id) school_id from j where id is not null
 union all select name, first_season, last_season, printf('S%04d', row_number() over (order by first_season, name) + (select top from t)) from j where id is null""",
        "match_ids": f"""with {G}, x as (select seq, coalesce(a, '∅' || coalesce(raw_a, '')) x, coalesce(b, '∅' || coalesce(raw_b, '')) y, season, series, stage from games),
 b as (select seq, concat_ws('-', season, series, stage, least(x, y), greatest(x, y)) base from x), n as (select *, row_number() over (partition by base order by seq) n from b)
 select seq, case when n = 1 then base else base || '#' || n end match_id from n""",
        "status_codes": f"""with {G}, c as (select seq, sa is not null and sb is not null whole, {code} code from games) select seq, code, case code when '済' then case when whole then '終了' else 'スコア記載なし' end
 when '不戦' then '不戦勝・棄権' when '勝者のみ' then 'スコア記載なし' when '結果不明' then '勝者不明' else '未実施' end back from c""",
        "check_problems": f"""with {G}, {V.format('games')} select 'Q1' check_id, {cat('doc', 'page', 'match_no', 'round', 'a', 'b')} key, count(*) problems from games group by 2 having count(*) > 1
 union all select 'Q2', me, count(*) from views where me not in (select key from school_roster where key is not null) group by me
 union all select 'Q3', cast(seq as varchar), 1 from games where status in ('終了', 'スコアのみ記載（赤線未反映）', '赤線が両側（スコアで判定）') and (sa is null or sb is null or ({won}) <> ({by}))
 union all select 'Q4', {cat('season', 'series', 'stage', 'area', 'doc', 'page', 'block')}, count(distinct seq) - count(distinct me) + 1 from views where block is not null
 group by season, series, stage, area, doc, page, block having count(distinct seq) > count(distinct me) - 1
 union all select 'Q5', {cat('season', 'series', 'stage', 'area', 'page', 'round', 'me')}, count(*) from views group by 2 having count(*) > 1""",
        "fk_anti": """select 'documents' tab, doc_id id from documents where source is null or source not in (select source from doc_sources)
 union all select 'orders', o_orderkey from orders where o_custkey not in (select c_custkey from customer) union all select 'lineitem', l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders)""",
        "run_difference": f"{_DEDUP} select season, series, a, b, 'only left' side from k where not kept",
        "cross_source_agreement": f"""with {G}, {_EXT}, e as (select season, series, stage, least(ea, eb) p1, greatest(ea, eb) p2, case when ea <= eb then esa else esb end x, case when ea <= eb then esb else esa end y from ext),
 g as (select season, series, stage, least(a, b) p1, greatest(a, b) p2, case when a <= b then sa else sb end gx, case when a <= b then sb else sa end gy from played where a is not null and b is not null)
 select season, count(*) n, count(*) filter (x = gx and y = gy) agree from g join e using (season, series, stage, p1, p2) group by season""",
    }
