"""Queries over one-sided views: filters, records, standings, windows (SURVEY F, A, W, O, P, U, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import perspective as P
from ..operators import records as R

G, V = P.GAMES_SQL, P.VIEWS_SQL
WITH = f"with {G}, {V.format('played')}"
WITH_ALL = f"with {G}, {V.format('games')}"


def _played_views(spark: SparkSession, d: str) -> DataFrame:
    return P.both_sides(P.played(P.games(spark, d)))


def _all_views(spark: SparkSession, d: str) -> DataFrame:
    return P.both_sides(P.games(spark, d))


def standings(spark: SparkSession, d: str) -> DataFrame:
    return R.standings(_played_views(spark, d), ["season", "series"], ("points", "gd", "gf"))


def standings_alt_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return R.standings(_played_views(spark, d), ["season", "series"], ("points", "gd"))


def team_record(spark: SparkSession, d: str) -> DataFrame:
    return R.team_record(P.games(spark, d))


def summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.summary_rollup(_played_views(spark, d))


def active_sides(spark: SparkSession, d: str) -> DataFrame:
    return _played_views(spark, d).select("season", F.col("me").alias("side")).distinct()


def played_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.played(P.games(spark, d)).select("seq", "sa", "sb")


def one_side_view(spark: SparkSession, d: str) -> DataFrame:
    return P.one_view(_played_views(spark, d)).select("seq", "slot", "me", "opp", "gf", "ga", "res")


def furthest_run(spark: SparkSession, d: str) -> DataFrame:
    return R.furthest_run(_all_views(spark, d))


def season_rank(spark: SparkSession, d: str) -> DataFrame:
    s = R.standings(_played_views(spark, d), ["season"], ("points", "gd", "gf"))
    return s.select("season", "team", "points", "rank")


def rank_delta(spark: SparkSession, d: str) -> DataFrame:
    """Against exactly the season before, not the previous row."""
    s = season_rank(spark, d)
    before = s.select((F.col("season") + 1).alias("season"), "team", F.col("rank").alias("rank_before"), F.col("points").alias("points_before"))
    return s.join(before, ["season", "team"], "left").select("season", "team", "rank", "rank_before", (F.col("points") - F.col("points_before")).alias("delta"))


def latest_per_opponent(spark: SparkSession, d: str) -> DataFrame:
    """The last contest against each opponent; ties go to the later row."""
    v = _played_views(spark, d).where("opp is not null")
    last = v.groupBy("me", "opp").agg(F.max_by(F.struct("seq", "season", "gf", "ga", "res"), F.struct("season", "seq")).alias("x"))
    return last.select("me", "opp", "x.*")


def last_five(spark: SparkSession, d: str) -> DataFrame:
    """The form over the last five contests, oldest first."""
    w = Window.partitionBy("me").orderBy(F.col("season").desc(), F.col("seq").desc())
    v = _played_views(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5")
    return v.groupBy("me").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("k"), "res"))), lambda x: x["res"]), "").alias("form"))


def top_opponents(spark: SparkSession, d: str) -> DataFrame:
    """The 24 most frequent opponents of each side."""
    n = _played_views(spark, d).where("opp is not null").groupBy("me", "opp").agg(F.count("*").alias("n"), F.count_if(F.expr("res = '○'")).alias("w"))
    w = Window.partitionBy("me").orderBy(F.col("n").desc(), "opp")
    return n.withColumn("k", F.row_number().over(w)).where("k <= 24")


def best_worst(spark: SparkSession, d: str) -> DataFrame:
    """The best win and the worst loss by goal difference, then goals, then the earlier row."""
    v = _played_views(spark, d)
    gd = F.col("gf") - F.col("ga")
    best = F.max_by(F.when(gd > 0, F.col("seq")), F.when(gd > 0, F.struct(gd, F.col("gf"), -F.col("seq"))))
    worst = F.min_by(F.when(gd < 0, F.col("seq")), F.when(gd < 0, F.struct(gd, -F.col("ga"), F.col("seq"))))
    return v.groupBy("me").agg(best.alias("best_win"), worst.alias("worst_loss"))


def winning_losing(spark: SparkSession, d: str) -> DataFrame:
    """Opponents met at least three times, with the balance against each."""
    n = _played_views(spark, d).where("opp is not null").groupBy("me", "opp").agg(F.count("*").alias("n"), F.count_if(F.expr("res = '○'")).alias("w"), F.count_if(F.expr("res = '●'")).alias("l"))
    return n.where("n >= 3").withColumn("kind", F.expr("case when w > l then '勝ち越し' when w < l then '負け越し' else '五分' end"))


def first_last_five_years(spark: SparkSession, d: str) -> DataFrame:
    """Win rates of the first and last five recorded seasons, for sides with at least eight."""
    y = _played_views(spark, d).groupBy("me", "season").agg(F.count("*").alias("n"), F.count_if(F.expr("res = '○'")).alias("w"))
    up, down, all_ = Window.partitionBy("me").orderBy("season"), Window.partitionBy("me").orderBy(F.col("season").desc()), Window.partitionBy("me")
    y = y.withColumns({"i": F.row_number().over(up), "j": F.row_number().over(down), "years": F.count("*").over(all_)}).where("years >= 8")
    rate = lambda c: F.try_divide(F.sum(F.when(F.col(c) <= 5, F.col("w"))), F.sum(F.when(F.col(c) <= 5, F.col("n"))))
    return y.groupBy("me").agg(rate("i").alias("first_rate"), rate("j").alias("last_rate"))


def season_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive seasons in which a side took part in a series (gaps and islands)."""
    s = _all_views(spark, d).select("me", "series", "season").distinct()
    w = Window.partitionBy("me", "series").orderBy("season")
    s = s.withColumn("k", F.col("season") - F.row_number().over(w))
    return s.groupBy("me", "series", "k").agg(F.min("season").alias("from_season"), F.max("season").alias("to_season")).drop("k")


def stage_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Contests by area and series, with a column for all other series; areas without any as zero."""
    g = P.games(spark, d).where("area is not null")
    known = ["新人戦", "総体", "選手権", "関東"]
    other = F.count_if(~F.coalesce(F.col("series").isin(known), F.lit(False))).alias("その他")
    return g.groupBy("area").agg(*[F.count_if(F.col("series") == s).alias(s) for s in known], other)


def roster_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Roster entries with their number of contests, zero for those without."""
    n = _all_views(spark, d).groupBy(F.col("me").alias("key")).agg(F.count("*").alias("n"))
    roster = spark.read.parquet(f"{d}/school_roster.parquet").select("key", "area")
    return roster.join(n, "key", "left").select("key", "area", F.coalesce("n", F.lit(0)).alias("n"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.games(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Sides of two series, without those of the third, plus a fixed extra."""
    v = _all_views(spark, d)
    of = lambda s: v.where(F.col("series") == s).select("me")
    extra = spark.createDataFrame([("特別枠",)], "me string")
    return of("総体").union(of("選手権")).subtract(of("関東")).union(extra).distinct()


def membership_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per season how many sides are in one series only, the other only or both."""
    v = _all_views(spark, d)
    f = v.groupBy("season", "me").agg(F.bool_or(F.col("series") == "総体").alias("x"), F.bool_or(F.col("series") == "選手権").alias("y"))
    return f.groupBy("season").agg(F.count_if(F.expr("x and not y")).alias("only_x"), F.count_if(F.expr("y and not x")).alias("only_y"), F.count_if(F.expr("x and y")).alias("both"))


def fiscal_dates(spark: SparkSession, d: str) -> DataFrame:
    return R.fiscal_dates(P.games(spark, d)).select("seq", "season", "date", "season_back")


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last area seen above each row of its document."""
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return P.games(spark, d).where("doc is not null").select("seq", "doc", F.last("area", True).over(w).alias("carried"))


def cup_order(spark: SparkSession, d: str) -> DataFrame:
    """O3: the order of a season's cups: series index, stage tier, then file order."""
    g = P.games(spark, d).select("seq", "season", R.series_index(F.col("series")).alias("si"), R.stage_tier(F.col("stage")).alias("st"))
    w = Window.partitionBy("season").orderBy("si", "st", "seq")
    return g.withColumn("k", F.row_number().over(w))


def upsets(spark: SparkSession, d: str) -> DataFrame:
    """C6 shape on season points: winners ranked below losers, by the gap; top ten of each season."""
    r = season_rank(spark, d).select("season", "team", "rank")
    v = _played_views(spark, d).where("res = '○' and opp is not null")
    j = v.join(r.withColumnsRenamed({"team": "me", "rank": "mine"}), ["season", "me"]).join(r.withColumnsRenamed({"team": "opp", "rank": "theirs"}), ["season", "opp"])
    w = Window.partitionBy("season").orderBy((F.col("mine") - F.col("theirs")).desc(), "seq")
    return j.where("mine > theirs").select("season", "seq", "me", "opp", (F.col("mine") - F.col("theirs")).alias("gap"), F.row_number().over(w).alias("k")).where("k <= 10")


def minmax_composite(spark: SparkSession, d: str) -> DataFrame:
    """Parts scaled to 0..100 within a season, weighted over the parts that are there."""
    s = R.standings(_played_views(spark, d), ["season"], ("points", "gd", "gf"))
    return R.composite(s, "season", {"points": (3.0, True), "gd": (2.0, True), "ga": (1.0, False)}).select("season", "team", F.round("score", 4).alias("score"))


def search_substring(spark: SparkSession, d: str) -> DataFrame:
    """Substring search on three fields."""
    g = P.games(spark, d)
    hit = F.col("a").contains("学園") | F.col("b").contains("学園") | F.col("note").contains("延長")
    return g.where(hit).select("seq")


def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    """K4: one Markdown table per season and series, rows in standing order."""
    s = standings(spark, d)
    line = F.format_string("|%d|%s|%d|%d|", "rank", F.replace("team", F.lit("|"), F.lit("／")), "points", "gd")
    return s.groupBy("season", "series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("md"))


def queries() -> dict:
    return {f.__name__: f for f in (
        standings, standings_alt_tiebreak, team_record, summary_rollup, active_sides, played_filter, one_side_view, furthest_run, season_rank, rank_delta,
        latest_per_opponent, last_five, top_opponents, best_worst, winning_losing, first_last_five_years, season_islands, stage_crosstab, roster_coverage,
        status_counts, set_algebra, membership_counts, fiscal_dates, carry_forward, cup_order, upsets, minmax_composite, search_substring, markdown_table,
    )}


def _standings_sql(keys: str, order: str) -> str:
    return f"""select {keys}, me team, count(*) played, count(*) filter (res = '○') won, count(*) filter (res = '△') drawn, count(*) filter (res = '●') lost,
 cast(sum(gf) as bigint) gf, cast(sum(ga) as bigint) ga, cast(sum(gf) - sum(ga) as bigint) gd, 3 * count(*) filter (res = '○') + count(*) filter (res = '△') points,
 row_number() over (partition by {keys} order by {order}, me) rank from views group by {keys}, me"""


_PTS = "3 * count(*) filter (res = '○') + count(*) filter (res = '△') desc"
_SEASON = _standings_sql("season", f"{_PTS}, sum(gf) - sum(ga) desc, sum(gf) desc")


def oracle_sql() -> dict[str, str]:
    return {
        "standings": f"{WITH} " + _standings_sql("season, series", f"{_PTS}, sum(gf) - sum(ga) desc, sum(gf) desc"),
        "standings_alt_tiebreak": f"{WITH} " + _standings_sql("season, series", f"{_PTS}, sum(gf) - sum(ga) desc"),
        "team_record": f"""{WITH_ALL}, v as (select *, coalesce(winner = raw, false) won, pf is not null or pg is not null pk from views where status <> '未実施'),
 r as (select *, case round when '決勝' then 9 when '準決勝' then 8 when '準々決勝' then 7 when 'ブロック決勝' then 6 else coalesce(try_cast(regexp_extract(round, '^(\\d)回戦$', 1) as int), 0) end rr from v)
 select season, series, stage, area, me, count(*) filter (status <> '不戦勝・棄権') games, count(*) filter (status <> '不戦勝・棄権' and won and not pk) wins,
 count(*) filter (status <> '不戦勝・棄権' and won and pk) pk_wins, count(*) filter (status <> '不戦勝・棄権' and not won and winner is not null and pk) pk_losses,
 count(*) filter (status <> '不戦勝・棄権' and not won and winner is not null and not pk) losses, count(*) filter (status = '不戦勝・棄権' and won) walkovers,
 arg_min(raw, seq) filter (raw is not null) raw, arg_max(round, (rr * 1000000000::bigint + seq)) filter (round is not null) last_round,
 string_agg(coalesce(round, '?') || case when won then '○' else '●' end, ' → ' order by rr, seq) path
 from r group by season, series, stage, area, me""",
        "summary_rollup": f"""{WITH} select me, season, series, count(*) n, count(*) filter (res = '○') w, count(*) filter (res = '△') d, count(*) filter (res = '●') l,
 cast(sum(gf) as bigint) gf, cast(sum(ga) as bigint) ga, count(*) filter (ga = 0) clean, count(*) filter (gf = 0) scoreless, count(*) filter (abs(gf - ga) = 1) one_goal,
 grouping(season, series) level from views group by grouping sets ((me), (me, season), (me, series))""",
        "active_sides": f"{WITH} select distinct season, me side from views",
        "played_filter": f"with {G} select seq, sa, sb from played",
        "one_side_view": f"""{WITH} select seq, slot, me, opp, gf, ga, case when coalesce(winner = raw, false) then case when pf is not null or pg is not null then 'PK勝' else '勝' end
 else case when pf is not null or pg is not null then 'PK負' else '負' end end res from views""",
        "furthest_run": f"""{WITH_ALL}, r as (select *, case when contains(stage, '二次') or stage = '東京都予選' then 2 when contains(stage, '一次') then 1 else 0 end tier,
 case round when '決勝' then 9 when '準決勝' then 8 when '準々決勝' then 7 when 'ブロック決勝' then 6 else coalesce(try_cast(regexp_extract(round, '^(\\d)回戦$', 1) as int), 0) end rr from views)
 select season, series, me, stage, round, seq from (select *, row_number() over (partition by season, series, me order by tier desc, rr desc, seq, slot) k from r) where k = 1""",
        "season_rank": f"{WITH}, s as ({_SEASON}) select season, team, points, rank from s",
        "rank_delta": f"""{WITH}, s as ({_SEASON}) select x.season, x.team, x.rank, y.rank rank_before, x.points - y.points delta
 from s x left join s y on x.team = y.team and x.season = y.season + 1""",
        "latest_per_opponent": f"""{WITH} select me, opp, seq, season, gf, ga, res from (select *, row_number() over (partition by me, opp order by season desc, seq desc) k
 from views where opp is not null) where k = 1""",
        "last_five": f"""{WITH} select me, string_agg(res, '' order by k desc) form from (select me, res, row_number() over (partition by me order by season desc, seq desc) k from views) where k <= 5 group by me""",
        "top_opponents": f"""{WITH} select * from (select me, opp, count(*) n, count(*) filter (res = '○') w, row_number() over (partition by me order by count(*) desc, opp) k
 from views where opp is not null group by me, opp) where k <= 24""",
        "best_worst": f"""{WITH}, b as (select me, seq, row_number() over (partition by me order by gf - ga desc, gf desc, seq) k from views where gf > ga),
 w as (select me, seq, row_number() over (partition by me order by gf - ga, ga desc, seq) k from views where gf < ga)
 select me, b.seq best_win, w.seq worst_loss from (select distinct me from views) left join (select * from b where k = 1) b using (me) left join (select * from w where k = 1) w using (me)""",
        "winning_losing": f"""{WITH} select *, case when w > l then '勝ち越し' when w < l then '負け越し' else '五分' end kind from (select me, opp, count(*) n, count(*) filter (res = '○') w,
 count(*) filter (res = '●') l from views where opp is not null group by me, opp) where n >= 3""",
        "first_last_five_years": f"""{WITH}, y as (select me, season, count(*) n, count(*) filter (res = '○') w from views group by me, season),
 z as (select *, row_number() over (partition by me order by season) i, row_number() over (partition by me order by season desc) j, count(*) over (partition by me) as "years" from y)
 select me, sum(w) filter (i <= 5) / sum(n) filter (i <= 5) first_rate, sum(w) filter (j <= 5) / sum(n) filter (j <= 5) last_rate from z where "years" >= 8 group by me""",
        "season_islands": f"""{WITH_ALL}, s as (select distinct me, series, season from views), t as (select *, season - row_number() over (partition by me, series order by season) k from s)
 select me, series, min(season) from_season, max(season) to_season from t group by me, series, k""",
        "stage_crosstab": f"""with {G} select area, count(*) filter (series = '新人戦') "新人戦", count(*) filter (series = '総体') "総体", count(*) filter (series = '選手権') "選手権", count(*) filter (series is null or series not in ('新人戦', '総体', '選手権', '関東')) "その他",
 count(*) filter (series = '関東') "関東" from games where area is not null group by area""",
        "roster_coverage": f"""{WITH_ALL} select r.key, r.area, coalesce(n, 0) n from school_roster r left join (select me, count(*) n from views group by me) v on v.me = r.key""",
        "status_counts": f"with {G} select status, count(*) n, min(seq) first_seq from games group by status",
        "set_algebra": f"""{WITH_ALL} select me from ((select me from views where series = '総体' union select me from views where series = '選手権')
 except select me from views where series = '関東') union select '特別枠'""",
        "membership_counts": f"""{WITH_ALL}, f as (select season, me, bool_or(series = '総体') x, bool_or(series = '選手権') y from views group by season, me)
 select season, count(*) filter (x and not y) only_x, count(*) filter (y and not x) only_y, count(*) filter (x and y) "both" from f group by season""",
        "fiscal_dates": f"""with {G}, m as (select seq, season, try_cast(regexp_extract(date_text, '^(\\d{{1,2}})/(\\d{{1,2}})', 1) as int) mm, try_cast(regexp_extract(date_text, '^(\\d{{1,2}})/(\\d{{1,2}})', 2) as int) dd
 from games where regexp_matches(date_text, '^\\d{{1,2}}/\\d{{1,2}}')), t as (select seq, season, try_cast(printf('%04d-%02d-%02d', season + (case when mm < 4 then 1 else 0 end), mm, dd) as date) date from m)
 select seq, season, date, cast(year(date) - (case when month(date) < 4 then 1 else 0 end) as int) season_back from t where date is not null""",
        "carry_forward": f"""with {G} select seq, doc, last_value(area ignore nulls) over (partition by doc order by seq rows unbounded preceding) carried from games where doc is not null""",
        "cup_order": f"""with {G}, o as (select seq, season, case series when '総体' then 0 when '選手権' then 1 when '新人戦' then 2 when '関東' then 3 else 9 end si,
 case when contains(stage, '二次') or stage = '東京都予選' then 2 when contains(stage, '一次') then 1 else 0 end st from games) select *, row_number() over (partition by season order by si, st, seq) k from o""",
        "upsets": f"""{WITH}, s as ({_SEASON}), j as (select v.season, v.seq, v.me, v.opp, x.rank - y.rank gap from views v join s x on x.season = v.season and x.team = v.me
 join s y on y.season = v.season and y.team = v.opp where v.res = '○' and x.rank > y.rank)
 select * from (select *, row_number() over (partition by season order by gap desc, seq) k from j) where k <= 10""",
        "minmax_composite": f"""{WITH}, s as ({_SEASON}), n as (select *, min(points) over w p0, max(points) over w p1, min(gd) over w d0, max(gd) over w d1, min(ga) over w a0, max(ga) over w a1 from s window w as (partition by season))
 select season, team, round((3.0::double * (case when p1 = p0 then 50 else 100.0::double * (points - p0) / (p1 - p0) end) + 2.0::double * (case when d1 = d0 then 50 else 100.0::double * (gd - d0) / (d1 - d0) end)
 + 1.0::double * (case when a1 = a0 then 50 else 100.0::double * (a1 - ga) / (a1 - a0) end)) / 6.0::double, 4) score from n""",
        "search_substring": f"with {G} select seq from games where contains(a, '学園') or contains(b, '学園') or contains(note, '延長')",
        "markdown_table": f"""{WITH}, s as ({_standings_sql('season, series', f'{_PTS}, sum(gf) - sum(ga) desc, sum(gf) desc')})
 select season, series, string_agg('|' || rank || '|' || replace(team, '|', '／') || '|' || points || '|' || gd || '|', chr(10) order by rank) md from s group by season, series""",
    }
