"""Queries for scalar functions, geometry on events, and text scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import geometry as Geo
from ..operators import perspective as P
from ..session import table

G = P.GAMES_SQL


def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    g = P.games(spark, d).where("raw_b is not null")
    return g.select("seq", N.normalize(F.col("raw_b")).alias("name"))


def squad_split(spark: SparkSession, d: str) -> DataFrame:
    base, squad = N.squad_of(F.col("raw_b"))
    base2, side = N.split_side(F.col("raw_b"))
    return P.games(spark, d).where("raw_b is not null").select("seq", base.alias("base"), squad.alias("squad"), base2.alias("base2"), side.alias("side"))


def split_stage(spark: SparkSession, d: str) -> DataFrame:
    """T7 both ways on a stage text made of season and stage."""
    text = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("第"), (F.col("season") - 1950).cast("string"), F.lit("回 "), F.col("stage"))).otherwise(F.col("stage"))
    g = P.games(spark, d).withColumn("text", text)
    n, rest = N.split_stage(F.col("text"))
    return g.select("seq", n.alias("edition"), rest.alias("rest"), (N.join_stage(n, rest) == F.col("text")).alias("lossless"))


def league_level(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "prince_kanto1_2026_standings")
    """T6: the division stands in the league's name here."""
    division = F.nullif(F.regexp_extract("リーグ", r"(\d部)", 1), F.lit(""))
    return s.select("sid", N.level_of(F.col("リーグ"), division).alias("level"))


def broken_names(spark: SparkSession, d: str) -> DataFrame:
    return P.games(spark, d).where(N.broken(F.col("b"))).select("seq", "b")


def score_texts(spark: SparkSession, d: str) -> DataFrame:
    g = P.games(spark, d).where("sa is not null and sb is not null")
    text = N.score_text(F.col("sa"), F.col("sb"), F.col("pa"), F.col("pb"), F.coalesce(F.col("note").contains("延長"), F.lit(False)))
    a, b = N.parse_score(text)
    return g.select("seq", text.alias("text"), a.alias("x"), b.alias("y"))


def note_parts(spark: SparkSession, d: str) -> DataFrame:
    return P.games(spark, d).where("note is not null").select("seq", N.clean_notes(F.col("note")).alias("note"))


def document_meta(spark: SparkSession, d: str) -> DataFrame:
    g = P.games(spark, d).where("doc is not null").select("doc").distinct()
    return g.select("doc", *[c.alias(k) for k, c in N.document_meta(F.col("doc")).items()], N.source_kind(F.col("doc")).alias("kind"))


def season_of(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(N.season_of(F.col("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


def month_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "external_results").where("`日付` is not null").groupBy(N.month_day(F.col("日付")).alias("md")).agg(F.count("*").alias("n"))


def standings_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Recorded against computed points, games and goal difference."""
    s = table(spark, d, "prince_kanto1_2026_standings")
    p = N.points(F.col("勝"), F.col("分"), F.col("敗"))
    return s.select("sid", (p["points"] == F.col("勝点")).alias("points_ok"), (p["played"] == F.col("試合")).alias("played_ok"), (F.col("得点") - F.col("失点") == F.col("得失点")).alias("gd_ok"))


def best_league_place(spark: SparkSession, d: str) -> DataFrame:
    """One place per team and season, by priority of the league, then rank (null last), then row."""
    from pyspark.sql.window import Window

    s = table(spark, d, "prince_kanto1_2026_standings")
    pri = F.when(F.col("リーグ").contains("プリンス"), 0).when(F.col("リーグ").rlike("^T"), 1).otherwise(2)
    w = Window.partitionBy("チーム", "年度").orderBy("pri", F.coalesce(F.col("順位").try_cast("int"), F.lit(99)), "sid")
    return s.withColumn("pri", pri).withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("チーム").alias("team"), F.col("年度").alias("season"), "sid")


def division_size(spark: SparkSession, d: str) -> DataFrame:
    """Size of each table and each row's position index."""
    from pyspark.sql.window import Window

    s = table(spark, d, "prince_kanto1_2026_standings")
    n = F.count("*").over(Window.partitionBy("年度", "リーグ"))
    return s.select("sid", n.alias("n"), F.round((F.coalesce(F.col("順位").try_cast("int"), F.lit(99)) - 1) / n, 6).alias("place"))


# Geometry: events as tokens: the user is the page, the value the coordinate.
def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("page"), "event_id", F.col("value").alias("pos"), "event_type", "ts")


def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = Geo.gap_clusters(_tokens(spark, d), "page", "pos", "event_id", 5.0)
    return c.groupBy("page", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("pos"), 4).alias("mean"))


def interval_coalesce(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d).select("page", F.col("pos").alias("lo"), (F.col("pos") + 2).alias("hi"))
    c = Geo.interval_coalesce(t, "page", "lo", "hi", 0.5)
    return c.select("page", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


def regular_runs(spark: SparkSession, d: str) -> DataFrame:
    r = Geo.regular_runs(_tokens(spark, d), "page", "pos", "event_id", 0.3, 5.0)
    return r.select("page", "n", F.round("from_pos", 4).alias("from_pos"), F.round("to_pos", 4).alias("to_pos"))


def _kinds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _tokens(spark, d)
    left = t.where("event_type in ('click', 'view')").select("page", F.col("event_id").alias("l_id"), F.col("pos").alias("l_pos"), F.col("ts").alias("l_ts"))
    return left, t.where("event_type not in ('click', 'view')").select("page", F.col("event_id").alias("r_id"), F.col("pos").alias("r_pos"), F.col("ts").alias("r_ts"))


def band_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = _kinds(spark, d)
    return Geo.band_join(left, right, "page", "l_pos", "r_pos", 4.0).select("page", "l_id", "r_id")


def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = _kinds(spark, d)
    return Geo.nearest_join(left, right, "page", "l_id", "l_pos", "r_pos", "r_id", 40.0).select("page", "l_id", "r_id")


def asof_prev(spark: SparkSession, d: str) -> DataFrame:
    left, right = _kinds(spark, d)
    return Geo.asof_join(left, right, "page", "l_ts", "r_ts", "r_id").select("page", "l_id", "r_id")


def asof_next(spark: SparkSession, d: str) -> DataFrame:
    left, right = _kinds(spark, d)
    return Geo.asof_join(left, right, "page", "l_ts", "r_ts", "r_id", forward=True).select("page", "l_id", "r_id")


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    left, right = _kinds(spark, d)
    l = left.select("page", F.col("l_id").alias("id"), F.col("l_pos").alias("lo"), (F.col("l_pos") + 3).alias("hi"))
    r = right.select("page", F.col("r_id").alias("id"), F.col("r_pos").alias("lo"), (F.col("r_pos") + 3).alias("hi"))
    return Geo.interval_overlap(l, r, "page", 10.0).select("page", "l_id", "r_id", F.round("overlap", 4).alias("overlap"))


def depth_element(spark: SparkSession, d: str) -> DataFrame:
    return Geo.depth_element(_tokens(spark, d), "page", "pos").select("page", F.round("depth", 6).alias("depth"))


def anchor_rows(spark: SparkSession, d: str) -> DataFrame:
    return Geo.anchor_rows(_tokens(spark, d), "page", "event_id", "pos", 3.5)


# Text scans over documents.
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links of the documents by host."""
    t = table(spark, d, "documents").where("text is not null")
    links = t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"https?://([A-Za-z0-9.\-]+)"), 1)).alias("host"))
    return links.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def score_mentions(spark: SparkSession, d: str) -> DataFrame:
    """S18: "A 1-2 B" lines of result lists in the documents; a number beyond an int is null. Only a line feed ends a line."""
    t = table(spark, d, "documents").where("text is not null")
    pattern = r"(?md)^(準々決勝|準決勝|決勝|代表決定戦|\d回戦) ([^ \n]+) (\d+)-(\d+) ([^ \n]+)$"
    hit = F.regexp_extract_all("text", F.lit(pattern), 0)
    x = t.select("doc_id", F.posexplode(hit).alias("k", "line"))
    return x.select("doc_id", "k", F.regexp_extract("line", pattern, 1).alias("round"), F.regexp_extract("line", pattern, 3).try_cast("int").alias("sa"), F.regexp_extract("line", pattern, 4).try_cast("int").alias("sb"))


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of pipe tables in the documents, with the header row's columns by position."""
    t = table(spark, d, "documents").where("text is not null")
    x = t.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^\|(\d+\|[^\n]*)\|$"), 1)).alias("k", "line"))
    c = F.split("line", r"\|")
    return x.select("doc_id", "k", F.get(c, F.lit(0)).try_cast("int").alias("rank"), F.get(c, F.lit(1)).alias("team"), F.get(c, F.lit(2)).try_cast("int").alias("points"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """S4 shape: JSON documents to columns."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("props").isNotNull()).alias("with_props"))


def queries() -> dict:
    return {f.__name__: f for f in (
        normalize_name, squad_split, split_stage, league_level, broken_names, score_texts, note_parts, document_meta, season_of, month_day, standings_arithmetic,
        best_league_place, division_size, gap_clusters, interval_coalesce, regular_runs, band_join, nearest_join, asof_prev, asof_next, interval_overlap, depth_element,
        anchor_rows, link_targets, score_mentions, table_rows, event_props,
    )}


_T = "t as (select user_id page, event_id, value pos, ts, event_type from events where value is not null), l as (select page, event_id l_id, pos l_pos, ts l_ts from t where event_type in ('click', 'view')), r as (select page, event_id r_id, pos r_pos, ts r_ts from t where event_type not in ('click', 'view'))"


def _norm(c: str) -> str:
    """T1 step by step; the case of a name that is an owner's prefix alone stays as it is."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)).replace("'", "''")
    x = f"regexp_replace(regexp_replace(translate(trim({c}), '{wide}　', '{narrow} '), '[(（][^()（）]*[)）]', '', 'g'), '\\s', '', 'g')"
    x = f"regexp_replace({x}, '^(?:東京都立|都立|都・|国立|国・|私立|私・|区立)(.)', '\\1')"
    x = f"regexp_replace({x}, '^都([^市・].)', '\\1')"
    x = f"regexp_replace({x}, '(高等学校|高校|高等科)$', '')"
    for _ in range(2):  # RE2 has no look-around: neighbours that touch need a second pass
        x = f"regexp_replace({x}, '([一-龥])ケ([一-龥])', '\\1ヶ\\2', 'g')"
    return f"translate({x}, '國學髙﨑', '国学高崎')"


def oracle_sql() -> dict[str, str]:
    s = "prince_kanto1_2026_standings"
    return {
        # SQL has only the canonical composition; the letters and signs of full width that occur are translated
        "normalize_name": f"""with {G}, n as (select seq, raw_b, {_norm("raw_b")} as name from games where raw_b is not null) select seq, name from n""",
        "squad_split": f"""with {G}, x as (select seq, trim(raw_b) n, regexp_extract(trim(raw_b), '^(.+?)[\\s・]?([A-JＡ-Ｊ])$', 1) b, regexp_extract(trim(raw_b), '^(.+?)[\\s・]?([A-JＡ-Ｊ])$', 2) l,
 regexp_extract(trim(raw_b), '^(..+?)([A-ZＡ-Ｚ])$', 1) b2, regexp_extract(trim(raw_b), '^(..+?)([A-ZＡ-Ｚ])$', 2) l2 from games where raw_b is not null),
 y as (select *, l <> '' and not regexp_matches(n, '(?i)(FC|SC|F\\.C)$') and not regexp_matches(trim(b), '^[\\x00-\\x7F]*$') and not regexp_matches(trim(b), '(?i)(U-?1[5-8]|FC|F\\.C)$') s from x),
 z as (select *, case when l2 <> '' then b2 else n end r from y)
 select seq, case when s then trim(b) else n end base, case when s then translate(l, 'ＡＢＣＤＥＦＧＨＩＪ', 'ABCDEFGHIJ') else 'A' end squad, {_norm("r")} base2,
 translate(l2, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') side from z""",
        "anchor_rows": """with recursive t as (select user_id page, event_id, value pos from events where value is not null),
 r as (select page, min(pos) anchor from t group by page union all select r.page, (select min(pos) from t where t.page = r.page and t.pos - r.anchor > 3.5) from r
 where (select max(pos) from t where t.page = r.page) - r.anchor > 3.5)
 select page, event_id, cast((select count(*) from r where r.page = t.page and r.anchor <= t.pos) as int) as row from t""",
        "split_stage": f"""with {G} select seq, case when seq % 2 = 0 then season - 1950 end edition, stage rest, true lossless from games""",
        "league_level": f"""select sid, case when starts_with("リーグ", 'プリンス') then 'プリンス' when regexp_matches("リーグ", '^T[1-5]$') then "リーグ" when regexp_extract("リーグ", '(\\d部)', 1) in ('1部', '2部', '3部')
 then regexp_extract("リーグ", '(\\d部)', 1) else '地区' end as level from {s}""",
        "broken_names": f"with {G} select seq, b from games where length(translate(b, '0123456789()（）,、。※・', '')) < length(b) or length(b) not between 1 and 12",
        "score_texts": f"""with {G}, x as (select seq, sa || '-' || sb || case when pa is not null and pb is not null then ' (PK ' || pa || '-' || pb || ')' else '' end
 || case when contains(note, '延長') then ' (延長)' else '' end as text, sa, sb from games where sa is not null and sb is not null) select seq, text, sa x, sb y from x""",
        "note_parts": f"""with {G} select seq, nullif(array_to_string(list_filter(string_split(note, '／'), lambda x: not regexp_matches(x, '^(extra:|text:|facing)') and x <> '延長'), '／'), '') note
 from games where note is not null""",
        "document_meta": f"""with {G}, x as (select distinct doc, regexp_replace(doc, '^matome_', '') s from games where doc is not null)
 select doc, case regexp_extract(s, '^([a-z]+)\\d\\d_[a-z]+_\\d+', 1) when 'shin' then '新人戦' when 'sotai' then '総体' when 'sen' then '選手権' when 'kan' then '関東' end doc_series,
 2000 + try_cast(regexp_extract(s, '^[a-z]+(\\d\\d)_[a-z]+_\\d+', 1) as int) doc_season, nullif(regexp_extract(s, '^[a-z]+\\d\\d_([a-z]+)_\\d+', 1), '') doc_stage,
 try_cast(regexp_extract(s, '^[a-z]+\\d\\d_[a-z]+_(\\d+)', 1) as int) doc_number, case when ends_with(lower(doc), '.pdf') then 'pdf' else 'web' end kind from x""",
        "season_of": "select year(o_orderdate) - case when month(o_orderdate) < 4 then 1 else 0 end season, count(*) n from orders group by 1",
        "month_day": """select cast(month(cast("日付" as date)) as varchar) || '/' || day(cast("日付" as date)) md, count(*) n from external_results where "日付" is not null group by 1""",
        "standings_arithmetic": f"""select sid, 3 * "勝" + "分" = "勝点" points_ok, "勝" + "分" + "敗" = "試合" played_ok, "得点" - "失点" = "得失点" gd_ok from {s}""",
        "best_league_place": f"""select team, season, sid from (select "チーム" team, "年度" season, sid, row_number() over (partition by "チーム", "年度" order by case when contains("リーグ", 'プリンス') then 0
 when starts_with("リーグ", 'T') then 1 else 2 end, coalesce(try_cast("順位" as int), 99), sid) k from {s}) where k = 1""",
        "division_size": f"""select sid, n, round((coalesce(try_cast("順位" as int), 99) - 1) / n, 6) place from (select *, count(*) over (partition by "年度", "リーグ") n from {s})""",
        "gap_clusters": f"""with {_T}, g as (select *, case when pos - lag(pos) over w > 5.0 or lag(pos) over w is null then 1 else 0 end f from t window w as (partition by page order by pos, event_id)),
 c as (select *, sum(f) over (partition by page order by pos, event_id rows unbounded preceding) "cluster" from g) select page, "cluster", count(*) n, round(avg(pos), 4) mean from c group by page, "cluster\"""",
        "interval_coalesce": f"""with {_T}, i as (select page, pos lo, pos + 2 hi from t), m as (select *, case when lo > max(hi) over (partition by page order by lo, hi rows between unbounded preceding and 1 preceding) + 0.5
 or row_number() over (partition by page order by lo, hi) = 1 then 1 else 0 end f from i), k as (select *, sum(f) over (partition by page order by lo, hi rows unbounded preceding) k from m)
 select page, round(min(lo), 4) lo, round(max(hi), 4) hi, count(*) n from k group by page, k""",
        "regular_runs": f"""with {_T}, g as (select *, case when pos - lag(pos) over w between 0.3 and 5.0 then 0 else 1 end f from t window w as (partition by page order by pos, event_id)),
 c as (select *, sum(f) over (partition by page order by pos, event_id rows unbounded preceding) k from g) select page, count(*) n, round(min(pos), 4) from_pos, round(max(pos), 4) to_pos from c group by page, k having count(*) >= 3""",
        "band_join": f"with {_T} select page, l_id, r_id from l join r using (page) where abs(l_pos - r_pos) <= 4.0",
        "nearest_join": f"""with {_T}, p as (select page, l_id, r_id, row_number() over (partition by page, l_id order by abs(l_pos - r_pos), r_id) k from l join r using (page) where abs(l_pos - r_pos) <= 40.0)
 select l.page, l.l_id, p.r_id from l left join (select * from p where k = 1) p on p.page = l.page and p.l_id = l.l_id""",
        "asof_prev": f"""with {_T}, p as (select l_id, r_id, row_number() over (partition by l.page, l_id order by r_ts desc, r_id desc) k from l join r on r.page = l.page and r_ts < l_ts)
 select l.page, l.l_id, p.r_id from l left join (select * from p where k = 1) p using (l_id)""",
        "asof_next": f"""with {_T}, p as (select l_id, r_id, row_number() over (partition by l.page, l_id order by r_ts, r_id) k from l join r on r.page = l.page and r_ts > l_ts)
 select l.page, l.l_id, p.r_id from l left join (select * from p where k = 1) p using (l_id)""",
        "interval_overlap": f"""with {_T} select l.page, l_id, r_id, round(least(l_pos + 3, r_pos + 3) - greatest(l_pos, r_pos), 4) overlap from l join r on r.page = l.page
 where least(l_pos + 3, r_pos + 3) - greatest(l_pos, r_pos) > 0""",
        "depth_element": f"with {_T}, a as (select page, list_sort(list(pos)) a from t group by page) select page, round(a[least(len(a) - 1, cast(floor(len(a) * 0.9::double) as int)) + 1], 6) depth from a",
        "link_targets": """with l as (select doc_id, unnest(regexp_extract_all(text, 'https?://([A-Za-z0-9.\\-]+)', 1)) host from documents where text is not null) select host, count(*) n, count(distinct doc_id) docs from l group by host""",
        "score_mentions": """with p as (select doc_id, regexp_extract_all(text, '(?m)^(?:準々決勝|準決勝|決勝|代表決定戦|\\d回戦) (?:[^ \\n]+) (?:\\d+)-(?:\\d+) (?:[^ \\n]+)$') h from documents where text is not null),
 x as (select doc_id, unnest(h) line, generate_subscripts(h, 1) - 1 k from p) select doc_id, cast(k as int) k, regexp_extract(line, '^(\\S+)', 1) round, cast(regexp_extract(line, ' (\\d+)-(\\d+) ', 1) as int) sa,
 cast(regexp_extract(line, ' (\\d+)-(\\d+) ', 2) as int) sb from x""",
        "table_rows": """with p as (select doc_id, regexp_extract_all(text, '(?m)^\\|(\\d+\\|[^\\n]*)\\|$', 1) h from documents where text is not null), x as (select doc_id, unnest(h) line, generate_subscripts(h, 1) - 1 k from p)
 select doc_id, cast(k as int) k, try_cast(split_part(line, '|', 1) as int) rank, split_part(line, '|', 2) team, try_cast(split_part(line, '|', 3) as int) points from x""",
        "event_props": "select event_type, count(*) n, count(props) with_props from events group by event_type",
    }
