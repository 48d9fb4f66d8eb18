"""Queries for the rating fold, its back-test, paths and brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as B
from ..operators import perspective as P
from ..operators import rating as E
from ..session import checkpointed, table

G, V = P.GAMES_SQL, P.VIEWS_SQL
WITH = f"with {G}, {V.format('played')}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.cup_events(P.games(spark, d))


def rating_events(spark: SparkSession, d: str) -> DataFrame:
    """The ordered events."""
    w = Window.partitionBy("season").orderBy("day", "kind", "st", "rr", "seq")
    return _events(spark, d).select("seq", "season", "day", F.row_number().over(w).alias("k"))


def rating_fold(spark: SparkSession, d: str) -> DataFrame:
    f = E.rating_fold(_events(spark, d), [E.Config()])
    pre = [F.round(c).cast("int").alias(f"pre_{c[-1]}") for c in ("ea", "eb")]  # E8
    return f.select("seq", F.round("ea", 4).alias("ea"), F.round("eb", 4).alias("eb"), F.round("p", 6).alias("p"), "na", "nb", *pre)


def rating_final(spark: SparkSession, d: str) -> DataFrame:
    r = E.final_ratings(E.rating_fold(_events(spark, d), [E.Config()]))
    return r.select("team", F.round("rating", 4).alias("rating"), "games")


def rating_history(spark: SparkSession, d: str) -> DataFrame:
    h = E.rating_history(E.rating_fold(_events(spark, d), [E.Config()]))
    return h.select("team", "season", "rating", "delta", "rank")


def sweep_scores(spark: SparkSession, d: str) -> DataFrame:
    """Thirty configurations folded side by side, scored on the last seasons."""
    grid = [(k, carry, n) for k in (32, 40, 56, 72, 88) for carry in (0.75, 0.9, 1.0) for n in (0, 10)]
    configs = [E.Config(config_id=i, k=float(k), carry=carry, provisional=n) for i, (k, carry, n) in enumerate(grid)]
    f = E.rating_fold(_events(spark, d), configs).where("season >= 2022")
    return E.scores(f).select("config_id", "n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "accuracy")])


def best_config(spark: SparkSession, d: str) -> DataFrame:
    """The configuration with the least log loss, ties to the smaller id."""
    return sweep_scores(spark, d).agg(F.min_by("config_id", F.struct("log_loss", "config_id")).alias("config_id"), F.min("log_loss").alias("log_loss"))


def _forecast(spark: SparkSession, d: str) -> DataFrame:
    """Predictions out of season points: p from the difference of the sides' rates, s from the result."""
    v = P.both_sides(P.played(P.games(spark, d))).where("opp is not null")
    rate = v.groupBy("me").agg(F.avg(F.when(F.col("res") == "○", 1.0).when(F.col("res") == "△", 0.5).otherwise(0.0)).alias("r"))
    a = v.where("slot = 'A'").join(rate, "me").join(rate.select(F.col("me").alias("opp"), F.col("r").alias("q")), "opp")
    return a.select(F.lit(0).alias("config_id"), F.round(0.5 + (F.col("r") - F.col("q")) / 2, 4).alias("p"), F.when(F.col("res") == "○", 1.0).when(F.col("res") == "△", 0.5).otherwise(0.0).alias("s"))


def logloss_brier(spark: SparkSession, d: str) -> DataFrame:
    return E.scores(_forecast(spark, d)).select("n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "accuracy")])


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return E.calibration(_forecast(spark, d)).select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


def win_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """N6, N7, N10 on supplier balances as ratings: each supplier against the next of its nation."""
    s = table(spark, d, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = s.select("s_suppkey", F.col("s_acctbal").alias("x"), F.lead("s_acctbal").over(w).alias("y"), F.col("s_suppkey") % 7).where("y is not null").toDF("id", "x", "y", "m")
    return s.select("id", F.round(E.win_prob(F.col("x"), F.col("y")), 6).alias("p"), E.margin_mult(F.col("m")).alias("mult"), P.band(F.col("x"), F.col("y")).alias("band"))


# Paths run between the two sides with the most contests, found by the query itself.
def _ends(spark: SparkSession, d: str) -> tuple[DataFrame, str, str, int]:
    v = P.both_sides(P.played(P.games(spark, d)))
    top = v.groupBy("me").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "me").limit(3).collect()
    season = v.agg(F.max("season")).first()[0]
    return v, top[1].me, top[2].me, season  # the busiest side of all plays everyone: the next two are more telling


def paths_2hop(spark: SparkSession, d: str) -> DataFrame:
    v, x, y, season = _ends(spark, d)
    return B.paths(B.edges(v), x, y, season, 2).select("hops", "m1", "weight", "implied", "path")


def path_summary(spark: SparkSession, d: str) -> DataFrame:
    v, x, y, season = _ends(spark, d)
    p = B.path_summary(B.paths(B.edges(v), x, y, season, 3))
    return p.select(*[c for c in p.columns if c not in ("mean", "total")], F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"))


def path_pick(spark: SparkSession, d: str) -> DataFrame:
    v, x, y, season = _ends(spark, d)
    return B.path_pick(B.paths(B.edges(v), x, y, season, 2)).select("hops", "m1", "weight", "implied", "path")


def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    """Every pair's direct balance, one row per unordered pair."""
    e = B.edges(P.both_sides(P.played(P.games(spark, d)))).where("x < y")
    return e.groupBy("x", "y").agg(F.count("*").alias("n"), F.count_if(F.col("res") == "○").alias("w"), F.count_if(F.col("res") == "●").alias("l"), F.sum("d").alias("d"))


def common_opponents(spark: SparkSession, d: str) -> DataFrame:
    v, x, y, _ = _ends(spark, d)
    return B.common_opponents(v, x, y)


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers by key, with their balances as ratings: every eight are a bracket."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("pos"), F.col("s_name").alias("team"), F.col("s_acctbal").alias("rating"))


def bracket_advance(spark: SparkSession, d: str) -> DataFrame:
    leaves = checkpointed(_leaves(spark, d))
    return B.advance(leaves, 3).select("round", "pos", "team", F.round("p", 6).alias("p"))


def bracket_decided(spark: SparkSession, d: str) -> DataFrame:
    leaves = checkpointed(_leaves(spark, d))
    # the first contest of every pair of neighbours is decided for the upper one
    upper = leaves.where("pos % 2 = 0").select((F.col("pos") + 1).alias("pos"), F.col("team").alias("winner"))
    w = upper.join(leaves.select("pos", F.col("team").alias("loser")), "pos").select("winner", "loser")
    return B.advance(leaves, 3, w).select("round", "pos", "team", F.round("p", 6).alias("p"))


def predicted_winner(spark: SparkSession, d: str) -> DataFrame:
    return B.predicted_winner(_leaves(spark, d), 3)


def round_names(spark: SparkSession, d: str) -> DataFrame:
    return B.round_names(P.games(spark, d))


def first_round_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.first_round_blocks(P.games(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (
        rating_events, rating_fold, rating_final, rating_history, sweep_scores, best_config, logloss_brier, calibration, win_probabilities, paths_2hop, path_summary,
        path_pick, head_to_head, common_opponents, bracket_advance, bracket_decided, predicted_winner, round_names, first_round_blocks,
    )}


_RR = "case round when '3位決定戦' then 90 when '決勝' then 80 when 'ブロック決勝' then 70 when '準決勝' then 60 when '準々決勝' then 50 else coalesce(try_cast(nullif(regexp_extract(round, '^(\\d+)回戦', 1), '') as int), 0) end"
_STAGES = "(values (0, '関東', '', 401), (1, '総体', '支部予選', 425), (2, '総体', '一次', 510), (3, '総体', '二次', 525), (4, '選手権', '一次', 901), (5, '選手権', '二次', 1015), (6, '新人戦', '', 1115)) s(k, series, part, md)"
_EVENTS = f"""ev0 as (select *, try_cast(nullif(regexp_extract(date_text, '^(\\d{{1,2}})/(\\d{{1,2}})', 1), '') as int) mm, try_cast(nullif(regexp_extract(date_text, '^(\\d{{1,2}})/(\\d{{1,2}})', 2), '') as int) dd from games),
 ev1 as (select *, (season + (case when mm < 4 then 1 else 0 end)) * 10000 + mm * 100 + dd own from ev0),
 ev2 as (select *, min(own) over (partition by season, series, stage, area) first from ev1),
 ev3 as (select ev2.*, (select min(k) from {_STAGES} where s.series = ev2.series and contains(ev2.stage, s.part)) st0 from ev2 where seq in (select seq from played) and a is not null and b is not null and a <> b),
 ev as (select seq, season, a, b, sa, sb, coalesce(own, first, season * 10000 + coalesce((select md from {_STAGES} where k = st0), 401)) as "day", coalesce(st0, 99) st, {_RR} rr, pa is not null and pb is not null pk from ev3)"""
# the fold once more: state in maps, one event a step
_FOLD = f"""with recursive {G}, {_EVENTS}, o as (select *, row_number() over (order by "day", st, rr, seq) k from ev),
 f as (select 0::bigint k, map([''], [0.0::double]) elo, map([''], [0]) games, 0::bigint seq, 0 season, '' a, '' b, 0.0::double ea, 0.0::double eb, 0.0::double p, 0 na, 0 nb, 0.0::double post_a, 0.0::double post_b
 union all select k, map_concat(elo, map([a, b], [post_a, post_b])), map_concat(games, map([a, b], [na + 1, nb + 1])), seq, season, a, b, ea, eb, p, na, nb, post_a, post_b from (
 select *, case when nb < 10 and na >= 10 then ea else ea + d end post_a, case when na < 10 and nb >= 10 then eb else eb - d end post_b from (
 select *, 88 * (case when abs(sa - sb) <= 1 then 1 when abs(sa - sb) = 2 then 1.5 else (11 + abs(sa - sb)) / 8.0 end)::double * ((case when pk or sa = sb then 0.5 when sa > sb then 1 else 0 end)::double - p) d from (
 select *, 1 / (1 + pow(10.0::double, (eb - ea) / 400)) p from (
 select o.k, o.seq, o.season, o.a, o.b, o.sa, o.sb, o.pk, f.elo, f.games, coalesce(f.elo[o.a], 1500.0::double) ea, coalesce(f.elo[o.b], 1500.0::double) eb, coalesce(f.games[o.a], 0) na, coalesce(f.games[o.b], 0) nb
 from f join o on o.k = f.k + 1)))))"""
_SIDES = "s as (select a team, season, post_a r, na n from f where k > 0 union all select b, season, post_b, nb from f where k > 0)"
_FORECAST = f"""{WITH}, r as (select me, avg(case res when '○' then 1.0::double when '△' then 0.5::double else 0.0::double end) r from views where opp is not null group by me),
 f as (select round(0.5::double + (x.r - y.r) / 2, 4) p, case res when '○' then 1.0::double when '△' then 0.5::double else 0.0::double end s from views v join r x on x.me = v.me join r y on y.me = v.opp where slot = 'A')"""
_EDGES = f"""{WITH}, e as (select seq, season, me x, opp y, case when pf is not null and pg is not null then 0 else greatest(-5, least(5, gf - ga)) end d, res from views where opp is not null and me <> opp),
 top as (select me, row_number() over (order by count(*) desc, me) k from views group by me), ends as (select (select me from top where k = 2) me, (select me from top where k = 3) opp, (select max(season) from views) s),
 w as (select e.*, pow(0.7::double, greatest(0, s - season)) w from e, ends),
 f as (select y m1, d d1, w w1, seq s1 from w, ends where x = me), l as (select x m2, d d2, w w2, seq s2 from w, ends where y = opp),
 p1 as (select 1 hops, null::varchar m1, null::varchar m2, round(w1, 4) weight, d1 implied, cast(s1 as varchar) path from f, ends where m1 = opp),
 f2 as (select f.* from f, ends where m1 <> opp), l2 as (select l.* from l, ends where m2 <> me),
 p2 as (select 2 hops, m1, null::varchar m2, round(0.5::double * w1 * w2, 4) weight, d1 + d2 implied, s1 || '-' || s2 path from f2 join l2 on m1 = m2),
 mid as (select w.* from w, ends where x <> me and x <> opp and y <> me and y <> opp),
 p3 as (select 3 hops, m1, m2, round(0.25::double * w1 * w * w2, 4) weight, d1 + d + d2 implied, s1 || '-' || seq || '-' || s2 path from f2 join mid on m1 = x join l2 on y = m2)"""


def _advance_sql(decided: bool) -> str:
    prob = "1 / (1 + pow(10.0::double, (b.rating - a.rating) / 400))"
    if decided:
        prob = f"case when a.pos % 2 = 0 and b.pos = a.pos + 1 then 1.0::double when a.pos % 2 = 1 and b.pos = a.pos - 1 then 0.0::double else {prob} end"
    out = "with r0 as (select cast(s_suppkey as int) pos, s_name team, s_acctbal rating, 1.0::double p from supplier)"
    for r in (1, 2, 3):
        out += f""", r{r} as (select a.pos, a.team, a.rating, any_value(a.p) * sum(b.p * {prob}) p from r{r - 1} a join r{r - 1} b on (a.pos >> {r}) = (b.pos >> {r})
 and (a.pos >> {r - 1}) <> (b.pos >> {r - 1}) group by a.pos, a.team, a.rating)"""
    return out + " " + " union all ".join(f"select {r} round, pos, team, round(p, 6) p from r{r}" for r in range(4))


def oracle_sql() -> dict[str, str]:
    scores = """count(*) n, round(avg(-(s * ln(least(1 - 1e-6, greatest(1e-6, p))) + (1 - s) * ln(1 - least(1 - 1e-6, greatest(1e-6, p))))), 6) log_loss, round(avg(pow(p - s, 2)), 6) brier,
 round(avg(case when s <> 0.5 and p <> 0.5 then ((p > 0.5) = (s > 0.5))::int end), 6) accuracy"""
    nodes = " union all ".join(
        f"select {r} round, node, team from (select s_suppkey >> {r} node, s_name team, row_number() over (partition by s_suppkey >> {r} order by s_acctbal desc, s_suppkey) k from supplier) where k = 1"
        for r in (1, 2, 3)
    )
    return {
        "rating_events": f'with {G}, {_EVENTS} select seq, season, "day", row_number() over (partition by season order by "day", st, rr, seq) k from ev',
        "rating_fold": f"{_FOLD} select seq, round(ea, 4) ea, round(eb, 4) eb, round(p, 6) p, na, nb, cast(round(ea) as int) pre_a, cast(round(eb) as int) pre_b from f where k > 0",
        "rating_final": f"{_FOLD}, {_SIDES} select team, round(arg_max(r, n), 4) rating, max(n) + 1 games from s group by team",
        "rating_history": f"""{_FOLD}, {_SIDES}, own as (select team, season, arg_max(r, n) r from s group by team, season), se as (select distinct season from own),
 h as (select t.team, se.season, (select cast(round(r) as int) from own where own.team = t.team and own.season <= se.season order by own.season desc limit 1) rating
 from (select team, min(season) first from own group by team) t join se on se.season >= t.first)
 select h.team, h.season, h.rating, h.rating - b.rating delta, cast(row_number() over (partition by h.season order by h.rating desc, h.team) as int) as rank from h left join h b on b.team = h.team and b.season = h.season - 1""",
        "logloss_brier": f"{_FORECAST} select {scores} from f",
        "calibration": f"""{_FORECAST}, b as (select case when p > 0.5 then 1 - p else p end p, case when p > 0.5 then 1 - s else s end s from f),
 c as (select *, case when p < 0.05 then '0-5' when p < 0.1 then '5-10' when p < 0.2 then '10-20' when p < 0.35 then '20-35' when p < 0.5 then '35-50' end bin from b)
 select bin, count(*) n, round(avg(p), 6) predicted, round(avg(s), 6) observed from c where bin is not null group by bin""",
        "win_probabilities": """with s as (select s_suppkey id, s_acctbal x, lead(s_acctbal) over (partition by s_nationkey order by s_suppkey) y, s_suppkey % 7 m from supplier)
 select id, round(1 / (1 + pow(10.0::double, (y - x) / 400)), 6) p, case when m <= 1 then 1.0 when m = 2 then 1.5 else (11 + m) / 8.0 end::double mult, case when y - x > 50 then '格上' when y - x < -50 then '格下' else '同格' end band
 from s where y is not null""",
        "paths_2hop": f"{_EDGES} select hops, m1, weight, implied, path from (select * from p1 union all select * from p2)",
        "path_summary": f"""{_EDGES} select count(*) n, count(*) filter (hops = 1) direct, count(*) filter (hops = 2) two, count(*) filter (hops = 3) three, count(*) filter (implied > 0) up,
 count(*) filter (implied < 0) down, count(*) filter (implied = 0) even, round(sum(weight * implied) / sum(weight), 6) mean, round(sum(weight), 4) total from (select * from p1 union all select * from p2 union all select * from p3)""",
        "path_pick": f"""{_EDGES}, q as (select *, row_number() over (partition by hops, m1, m2 order by weight desc, abs(implied) desc, path) k from (select * from p1 union all select * from p2))
 select hops, m1, weight, implied, path from q where k = 1 order by round(q.weight, 9) desc, abs(implied) desc, path limit 8""",
        "head_to_head": f"{_EDGES} select x, y, count(*) n, count(*) filter (res = '○') w, count(*) filter (res = '●') l, cast(sum(d) as bigint) d from e where x < y group by x, y",
        "common_opponents": f"""{_EDGES}, s as (select v.me, v.opp, count(*) n, count(*) filter (res = '○') w, arg_max(res, v.season * 1000000000::bigint + seq) last from views v where v.opp is not null group by v.me, v.opp)
 select x.opp, x.n x_n, x.w x_w, x.last x_last, y.n y_n, y.w y_w, y.last y_last from ends join s x on x.me = ends.me join s y on y.me = ends.opp and y.opp = x.opp""",
        "bracket_advance": _advance_sql(False),
        "bracket_decided": _advance_sql(True),
        "predicted_winner": nodes,
        "round_names": f"""with {G}, l as (select seq, block, col, max(col) over (partition by doc, page, block) - col dist from games where doc is not null) select seq, case when block is not null and dist = 0 then 'ブロック決勝'
 when dist = 0 then '決勝' when block is null and dist = 1 then '準決勝' when block is null and dist = 2 then '準々決勝' else col || '回戦' end as name from l""",
        "first_round_blocks": f"""with {G}, s as (select doc, block, seq, 0 k, a t, raw_a raw, winner, raw_a, raw_b from games union all select doc, block, seq, 1, b, raw_b, winner, raw_a, raw_b from games),
 p as (select doc, block, t team, min(seq * 2 + k) first, bool_or(coalesce(winner in (raw_a, raw_b) and winner <> raw, false)) lost from s where doc is not null and block is not null and t is not null group by doc, block, t)
 select doc, block, string_agg(team, '・' order by first) teams, count(*) filter (lost) lost, count(*) n from p group by doc, block""",
    }
