"""Queries for the normalised dataset and the remaining records and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import graph as B
from ..operators import perspective as P
from ..operators import records as Rec
from ..session import checkpointed, table
from .q_rating import _advance_sql
from .q_reconcile import PLAYED
from .ranking import global_rank

G, V = P.GAMES_SQL, P.VIEWS_SQL
WITH = f"with {G}, {V.format('played')}"
WITH_ALL = f"with {G}, {V.format('games')}"
# A small merge map with one of each fault.
MERGES = [("甲", "甲"), ("乙", "丙"), ("丙", "丁"), ("戊", "丁"), ("戊", "己")]


def _g(spark: SparkSession, d: str) -> DataFrame:
    return P.games(spark, d)


def competitions(spark: SparkSession, d: str) -> DataFrame:
    return D.competitions(_g(spark, d))


def source_registry(spark: SparkSession, d: str) -> DataFrame:
    """Existing ids: the documents of the first season."""
    g = _g(spark, d)
    old = g.where("doc is not null and season = 2004").select("doc").distinct()
    return D.source_registry(g, global_rank(old, F.col("doc"), name="id"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return D.provenance(_g(spark, d))


def collisions(spark: SparkSession, d: str) -> DataFrame:
    return D.collisions(_g(spark, d))


def collisions_full(spark: SparkSession, d: str) -> DataFrame:
    """Copies that disagree in anything an export compares."""
    return D.collisions_full(_g(spark, d))


def merge_problems(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame(MERGES, "variant string, canonical string")
    return D.merge_problems(m, spark.createDataFrame([("甲",), ("丙",), ("丁",)], "name string"))


def _merges(spark: SparkSession, d: str) -> DataFrame:
    """Spellings with a doubled first character, merged into the single one where that exists."""
    names = P.both_sides(_g(spark, d)).select(F.col("me").alias("name")).distinct()
    m = names.select(F.col("name").alias("variant"), F.regexp_replace("name", r"^(.)\1", "$1").alias("canonical")).where("variant <> canonical")
    return m.join(names.select(F.col("name").alias("canonical")), "canonical").select("variant", "canonical")


def merged_names(spark: SparkSession, d: str) -> DataFrame:
    return D.apply_merges(_g(spark, d), _merges(spark, d)).select("seq", "a", "b")


def school_attributes(spark: SparkSession, d: str) -> DataFrame:
    return D.school_attributes(_g(spark, d), table(spark, d, "school_roster"))


def star_view(spark: SparkSession, d: str) -> DataFrame:
    return D.star_view(_g(spark, d), table(spark, d, "school_roster"), source_registry(spark, d))


def legacy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return D.legacy_round_trip(_g(spark, d))


def meeting_probability(spark: SparkSession, d: str) -> DataFrame:
    leaves = checkpointed(table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("pos"), F.col("s_name").alias("team"), F.col("s_acctbal").alias("rating")))
    return D.meeting_probability(B.advance(leaves, 3), 3).select("round", "x", "y", F.round("p", 6).alias("p"))


def alive(spark: SparkSession, d: str) -> DataFrame:
    return D.alive(_g(spark, d))


def summary_with_unknowns(spark: SparkSession, d: str) -> DataFrame:
    """By score with penalties apart; rows without a readable score are unknown."""
    v = P.both_sides(_g(spark, d))
    pk = F.col("pf").isNotNull() & F.col("pg").isNotNull()
    return v.groupBy("me").agg(
        F.count("*").alias("n"), F.count_if(F.col("res") == "○").alias("w"), F.count_if(F.col("res") == "●").alias("l"), F.count_if((F.col("res") == "△") & pk & (F.col("pf") > F.col("pg"))).alias("pkw"),
        F.count_if((F.col("res") == "△") & pk & (F.col("pf") < F.col("pg"))).alias("pkl"), F.count_if(F.col("res") == "").alias("unknown"),
    )


def cup_and_league(spark: SparkSession, d: str) -> DataFrame:
    """Contests and league rows of a season side by side."""
    v = P.both_sides(P.played(_g(spark, d))).groupBy("season", F.col("me").alias("team")).agg(F.count("*").alias("cup"))
    s = table(spark, d, "prince_kanto1_2026_standings").groupBy(F.col("年度").alias("season"), F.col("チーム").alias("team")).agg(F.sum("試合").alias("league"), F.max("勝点").alias("points"))
    return v.join(s, ["season", "team"], "full")


def season_record(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a season from each side; unplayed and unknown rows stay."""
    v = P.both_sides(_g(spark, d))
    won = F.coalesce(F.col("winner") == F.col("raw"), F.lit(False))
    wo = F.col("status") == P.WALKOVER
    res = F.when(wo & won, "不戦勝").when(wo & F.col("winner").isNotNull(), "不戦敗").when(F.col("res") == "", "結果不明").otherwise(F.col("res"))
    return v.select("seq", "slot", "season", "me", res.alias("result"))


def band_split(spark: SparkSession, d: str) -> DataFrame:
    """Results by the band of the opponent, rated by points per game of the season."""
    v = P.both_sides(P.played(_g(spark, d))).where("opp is not null")
    r = v.groupBy("season", "me").agg((1500 + 100 * F.avg(F.when(F.col("res") == "○", 3.0).when(F.col("res") == "△", 1.0).otherwise(0.0))).alias("r"))
    j = v.join(r, ["season", "me"]).join(r.select("season", F.col("me").alias("opp"), F.col("r").alias("q")), ["season", "opp"])
    return j.groupBy("me", P.band(F.round("r", 6), F.round("q", 6)).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("res") == "○").alias("w"))


def versus(spark: SparkSession, d: str) -> DataFrame:
    """The ordered record of each side against its most frequent opponent."""
    v = P.both_sides(P.played(_g(spark, d))).where("opp is not null")
    top = v.groupBy("me", "opp").agg(F.count("*").alias("n")).groupBy("me").agg(F.max_by("opp", F.struct("n", "opp")).alias("opp"))
    return v.join(top, ["me", "opp"]).groupBy("me", "opp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("season", "seq", "res"))), lambda x: x["res"]), "").alias("record"))


def thin_guard(spark: SparkSession, d: str) -> DataFrame:
    """Contests between sides with at least ten played contests each, walkovers aside."""
    g = P.played(_g(spark, d)).where(F.col("status") != P.WALKOVER)
    n = P.both_sides(g).groupBy("me").agg(F.count("*").alias("n")).where("n >= 10")
    return g.join(n.select(F.col("me").alias("a")), "a", "left_semi").join(n.select(F.col("me").alias("b")), "b", "left_semi").select("seq")


def exempted_problems(spark: SparkSession, d: str) -> DataFrame:
    """problems of the winner check without those of exempted seasons."""
    from ..operators import reconcile as R

    p = R.check_problems(_g(spark, d), table(spark, d, "school_roster")).where("check_id = 'Q3'")
    exempt = _g(spark, d).where("season < 2010").select(F.col("seq").cast("string").alias("key"))
    return p.join(exempt, "key", "left_anti").select("key")


def first_stage_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first stage of each side, season and series by priority, and whether it was exempt from the lowest."""
    v = P.both_sides(_g(spark, d)).withColumn("tier", Rec.stage_tier(F.col("stage")))
    return v.groupBy("me", "season", "series").agg(F.min_by("stage", F.struct("tier", "seq")).alias("first_stage"), (F.min("tier") > 0).alias("exempt"))


def reach_text(spark: SparkSession, d: str) -> DataFrame:
    """The reach of a side by its last contest: champion, runner-up, else round and result."""
    v = P.both_sides(_g(spark, d)).where("round is not null").withColumn("rr", Rec.round_rank(F.col("round")))
    last = v.groupBy("season", "series", "stage", "me").agg(F.max_by(F.struct("round", (F.coalesce(F.col("winner") == F.col("raw"), F.lit(False))).alias("won")), F.struct("rr", "seq")).alias("x"))
    text = F.when((F.col("x.round") == "決勝") & F.col("x.won"), "優勝").when(F.col("x.round") == "決勝", "準優勝").when((F.col("x.round") == "ブロック決勝") & F.col("x.won"), "ブロック優勝").when(F.col("x.won"), F.concat("x.round", F.lit("突破"))).otherwise(F.concat("x.round", F.lit("敗退")))
    return last.select("season", "series", "stage", "me", text.alias("reach"))


def reason_tags(spark: SparkSession, d: str) -> DataFrame:
    """Reasons with evidence for each side and season, joined in a fixed order."""
    t = P.both_sides(P.played(_g(spark, d))).groupBy("season", "me").agg(
        F.count("*").alias("n"), F.count_if(F.col("res") == "○").alias("w"), F.count_if(F.col("ga") == 0).alias("clean"), F.sum("gf").alias("gf"), F.count_if((F.col("gf") - F.col("ga")) >= 3).alias("big")
    )
    tag = lambda cond, *parts: F.when(cond, F.concat(*parts))
    tags = F.array_compact(F.array(
        tag(F.col("w") * 2 >= F.col("n"), F.lit("勝率:"), F.col("w").cast("string"), F.lit("/"), F.col("n").cast("string")), tag(F.col("clean") >= 2, F.lit("無失点:"), F.col("clean").cast("string")),
        tag(F.col("gf") >= 3 * F.col("n"), F.lit("得点:"), F.col("gf").cast("string")), tag(F.col("big") >= 1, F.lit("大勝:"), F.col("big").cast("string")),
    ))
    return t.select("season", "me", F.array_join(tags, "、").alias("reasons"))


def side_class(spark: SparkSession, d: str) -> DataFrame:
    """Club, roster school, seeded (seen in the second stage only) or other."""
    v = P.both_sides(_g(spark, d)).groupBy("me").agg(F.min(Rec.stage_tier(F.col("stage"))).alias("low"))
    roster = table(spark, d, "school_roster").select(F.col("key").alias("me"), F.lit(True).alias("listed"))
    kind = F.when(F.col("me").rlike("(FC|SC|ユース)$"), "club").when(F.col("low") == 2, "seed").when(F.col("listed"), "listed").otherwise("other")
    return v.join(roster, "me", "left").select("me", kind.alias("kind"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of every text, and how often it occurs."""
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy(F.sha2(F.col("text"), 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def half_scores(spark: SparkSession, d: str) -> DataFrame:
    """Q8: the halves of a score against the whole."""
    g = _g(spark, d).where("halves is not null and sa is not null and sb is not null")
    n = lambda k: F.get(F.regexp_extract_all("halves", F.lit(r"(\d+)"), 1), F.lit(k)).try_cast("int")
    return g.select("seq", (n(0) + n(2) == F.col("sa")).alias("a_ok"), (n(1) + n(3) == F.col("sb")).alias("b_ok"))


def json_report(spark: SparkSession, d: str) -> DataFrame:
    """K3: one JSON document per season with its table in order."""
    from ..sources.sinks import json_documents

    t = Rec.standings(P.both_sides(P.played(_g(spark, d))), ["season"], ("points", "gd", "gf"))
    return json_documents(t, "season", {"table": ["team", "points", "gd"]}, ["rank"])


def queries() -> dict:
    return {f.__name__: f for f in (
        competitions, source_registry, provenance, collisions, collisions_full, merge_problems, merged_names, school_attributes, star_view, legacy_round_trip, meeting_probability, alive,
        summary_with_unknowns, cup_and_league, season_record, band_split, versus, thin_guard, exempted_problems, first_stage_seen, reach_text, reason_tags, side_class,
        content_hash, half_scores, json_report,
    )}


_PROV = f"""with {G}, n as (select *, row_number() over w k, first_value(seq) over w survivor, first_value(a) over w fa from games where a is not null and b is not null
 window w as (partition by season, series, stage, round, least(a, b), greatest(a, b) order by coalesce({PLAYED}, false) desc, seq)),
 p as (select seq, survivor, case when k = 1 then '主' else '重複' end as role, k > 1 and fa <> a flipped, sa, sb from n)"""
_SOURCES = """o as (select doc, row_number() over (order by doc) id from (select distinct doc from games where doc is not null and season = 2004)),
 f as (select doc, min(seq) s from games where doc is not null group by doc), j as (select f.*, o.id from f left join o using (doc)),
 src as (select doc, printf('R%04d', id) source_id from j where id is not null union all select doc, printf('R%04d', row_number() over (order by s) + (select coalesce(max(id), 0) from o)) from j where id is null)"""
_TIER = "case when contains(stage, '二次') or stage = '東京都予選' then 2 when contains(stage, '一次') then 1 else 0 end"
_RR = "case round when '決勝' then 9 when '準決勝' then 8 when '準々決勝' then 7 when 'ブロック決勝' then 6 else coalesce(try_cast(regexp_extract(round, '^(\\d)回戦$', 1) as int), 0) end"


def oracle_sql() -> dict[str, str]:
    won = "case when winner = raw_a then 1 when winner = raw_b then 2 end"
    by = "case when sa > sb then 1 when sa < sb then 2 when pa > pb then 1 when pa < pb then 2 end"
    adv = _advance_sql(False).split(" select 0 round")[0]
    meet = " union all ".join(
        f"select {r} round, a.team x, b.team y, round(a.p * b.p, 6) p from r{r - 1} a join r{r - 1} b on (a.pos >> {r}) = (b.pos >> {r}) and (a.pos >> {r - 1}) < (b.pos >> {r - 1})" for r in (1, 2, 3)
    )
    return {
        "competitions": f"with {G} select season, series, stage, count(*) n, count(distinct area) areas, concat_ws('-', season, series, stage) comp_id from games group by season, series, stage",
        "source_registry": f"with {G}, {_SOURCES} select * from src",
        "provenance": f"{_PROV} select seq, survivor, role, flipped from p",
        "collisions": f"""{_PROV}, o as (select survivor, case when flipped then sb else sa end x, case when flipped then sa else sb end y from p)
 select survivor, count(distinct (x, y)) scores, count(*) as "rows" from o where x is not null and y is not null group by survivor having count(distinct (x, y)) > 1""",
        "merge_problems": """with m(variant, canonical) as (values ('甲', '甲'), ('乙', '丙'), ('丙', '丁'), ('戊', '丁'), ('戊', '己')) select 'self' problem, variant key from m where variant = canonical
 union all select 'chain', variant from m where canonical in (select variant from m) and variant <> canonical union all select 'repeated', variant from m group by variant having count(distinct canonical) > 1
 union all select 'unknown', variant from m where canonical not in ('甲', '丙', '丁')""",
        "merged_names": f"""{WITH_ALL}, n as (select distinct me as name from views), m as (select n.name variant, substr(n.name, 2) canonical from n where substr(n.name, 1, 1) = substr(n.name, 2, 1) and substr(n.name, 2) in (select name from n))
 select seq, coalesce(x.canonical, a) a, coalesce(y.canonical, b) b from games left join m x on x.variant = a left join m y on y.variant = b""",
        "school_attributes": f"""{WITH_ALL}, s as (select me as name, min(season) first_season, max(season) last_season from views group by me)
 select coalesce(s.name, r.key) as name, coalesce(r.kind, case when regexp_matches(coalesce(s.name, r.key), '(FC|SC|ユース|クラブ)$') then 'クラブ' end, '不明') kind, city, first_season, last_season from s full join school_roster r on r.key = s.name""",
        "star_view": f"""with {G}, {_SOURCES} select g.seq, g.a, g.b, x.kind kind_a, x.city city_a, y.kind kind_b, y.city city_b, source_id from games g left join school_roster x on x.key = g.a
 left join school_roster y on y.key = g.b left join src on src.doc = g.doc""",
        "legacy_round_trip": f"""with {G}, c as (select *, case when status in ('終了', 'スコアのみ記載（赤線未反映）', '赤線が両側（スコアで判定）') then case when sa is not null and sb is not null then '終了' else 'スコア記載なし' end
 when status in ('不戦勝・棄権', 'スコア記載なし', '勝者不明') then status else '未実施' end status_back from games) select seq, season, series, stage, a, b, sa, sb, status, status_back, status_back = status same from c""",
        "meeting_probability": f"{adv} {meet}",
        "alive": f"""{WITH_ALL} select distinct doc, me from views v where doc is not null and not exists (select 1 from views l where l.doc = v.doc and l.me = v.me and l.winner is not null and l.winner <> l.raw)""",
        "summary_with_unknowns": f"""{WITH_ALL} select me, count(*) n, count(*) filter (res = '○') w, count(*) filter (res = '●') l, count(*) filter (res = '△' and pf > pg) pkw, count(*) filter (res = '△' and pf < pg) pkl,
 count(*) filter (res = '') as "unknown" from views group by me""",
        "cup_and_league": f"""{WITH}, v as (select season, me team, count(*) cup from views group by season, me), s as (select "年度" season, "チーム" team, cast(sum("試合") as bigint) league, max("勝点") points
 from prince_kanto1_2026_standings group by 1, 2) select coalesce(v.season, s.season) season, coalesce(v.team, s.team) team, cup, league, points from v full join s on v.season = s.season and v.team = s.team""",
        "season_record": f"""{WITH_ALL} select seq, slot, season, me, case when status = '不戦勝・棄権' and winner = raw then '不戦勝' when status = '不戦勝・棄権' and winner is not null then '不戦敗' when res = '' then '結果不明' else res end as result from views""",
        "band_split": f"""{WITH}, r as (select season, me, 1500 + 100 * avg(case res when '○' then 3.0::double when '△' then 1.0::double else 0.0::double end) r from views where opp is not null group by season, me),
 j as (select v.me, v.res, round(y.r, 6) - round(x.r, 6) gap from views v join r x on x.season = v.season and x.me = v.me join r y on y.season = v.season and y.me = v.opp)
 select me, case when gap > 50 then '格上' when gap < -50 then '格下' else '同格' end band, count(*) n, count(*) filter (res = '○') w from j group by 1, 2""",
        "versus": f"""{WITH}, c as (select me, opp, row_number() over (partition by me order by count(*) desc, opp desc) k from views where opp is not null group by me, opp)
 select v.me, v.opp, string_agg(v.res, '' order by v.season, v.seq) record from views v join c on c.me = v.me and c.opp = v.opp and k = 1 group by v.me, v.opp""",
        "thin_guard": f"""{WITH}, n as (select me from views where status <> '不戦勝・棄権' group by me having count(*) >= 10) select seq from played where status <> '不戦勝・棄権' and a in (select me from n) and b in (select me from n)""",
        "exempted_problems": f"with {G} select cast(seq as varchar) key from games where season >= 2010 and status in ('終了', 'スコアのみ記載（赤線未反映）', '赤線が両側（スコアで判定）') and (sa is null or sb is null or ({won}) <> ({by}))",
        "first_stage_seen": f"""{WITH_ALL}, t as (select *, {_TIER} tier from views) select me, season, series, arg_min(stage, tier * 1000000000::bigint + seq) first_stage, min(tier) > 0 exempt from t group by me, season, series""",
        "reach_text": f"""{WITH_ALL}, t as (select *, {_RR} rr, coalesce(winner = raw, false) won from views where round is not null),
 l as (select season, series, stage, me, round, won, row_number() over (partition by season, series, stage, me order by rr desc, seq desc) k from t)
 select season, series, stage, me, case when round = '決勝' and won then '優勝' when round = '決勝' then '準優勝' when round = 'ブロック決勝' and won then 'ブロック優勝' when won then round || '突破' else round || '敗退' end reach from l where k = 1""",
        "reason_tags": f"""{WITH}, t as (select season, me, count(*) n, count(*) filter (res = '○') w, count(*) filter (ga = 0) clean, sum(gf) gf, count(*) filter (gf - ga >= 3) big from views group by season, me)
 select season, me, concat_ws('、', case when w * 2 >= n then '勝率:' || w || '/' || n end, case when clean >= 2 then '無失点:' || clean end, case when gf >= 3 * n then '得点:' || gf end, case when big >= 1 then '大勝:' || big end) reasons from t""",
        "side_class": f"""{WITH_ALL}, v as (select me, min({_TIER}) low from views group by me) select me, case when regexp_matches(me, '(FC|SC|ユース)$') then 'club' when low = 2 then 'seed'
 when me in (select key from school_roster) then 'listed' else 'other' end kind from v""",
        "content_hash": "select sha256(text) sha, count(*) n, min(doc_id) first_doc from documents where text is not null group by 1",
        "half_scores": f"""with {G}, h as (select seq, sa, sb, list_transform(regexp_extract_all(halves, '(\\d+)', 1), lambda x: cast(x as int)) h from games where halves is not null and sa is not null and sb is not null)
 select seq, h[1] + h[3] = sa a_ok, h[2] + h[4] = sb b_ok from h""",
        "json_report": f"""{WITH}, s as (select season, me team, 3 * count(*) filter (res = '○') + count(*) filter (res = '△') points, cast(sum(gf) - sum(ga) as bigint) gd, sum(gf) gf from views group by season, me)
 select season, '{{"table":[' || string_agg('{{"team":"' || team || '","points":' || points || ',"gd":' || gd || '}}', ',' order by points desc, gd desc, gf desc, team) || ']}}' doc from s group by season""",
    }
