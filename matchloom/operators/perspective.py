"""Typed contests, one-sided views of them and the codes read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# Statuses of contests that were played with a readable score.
PLAYED = ("終了", "スコアのみ記載（赤線未反映）", "赤線が両側（スコアで判定）")
WALKOVER = "不戦勝・棄権"
UNPLAYED = "未実施"


def number(col: Column) -> Column:
    """Permissive integer: null unless the text is a plain number."""
    return F.when(col.rlike(r"^-?[0-9]{1,9}$"), col.cast("int"))


def games(spark: SparkSession, folder: str) -> DataFrame:
    """The matches table with short names and typed scores."""
    m = table(spark, folder, "matches")
    c = F.col
    return m.select(
        "seq", c("年度").alias("season"), c("大会").alias("series"), c("段階").alias("stage"), c("地区・支部").alias("area"), c("ブロック").alias("block"),
        c("ページ").alias("page"), c("ラウンド").alias("round"), c("列").alias("col"), c("日付").alias("date_text"), c("試合番号").alias("match_no"),
        c("チームA").alias("raw_a"), c("チームB").alias("raw_b"), c("チームA_正規化").alias("a"), c("チームB_正規化").alias("b"),
        number(c("得点A")).alias("sa"), number(c("得点B")).alias("sb"), number(c("PK_A")).alias("pa"), number(c("PK_B")).alias("pb"),
        c("勝者").alias("winner"), c("状態").alias("status"), c("備考").alias("note"), c("前後半").alias("halves"), c("出典PDF").alias("doc"),
    )


def played(g: DataFrame) -> DataFrame:
    """contests with a readable result."""
    return g.where(F.col("status").isin(*PLAYED) & F.col("sa").isNotNull() & F.col("sb").isNotNull())


def result_code(gf: Column, ga: Column) -> Column:
    """○ won, ● lost, △ drawn, empty when unknown."""
    return F.when(gf > ga, "○").when(gf < ga, "●").when(gf == ga, "△").otherwise("")


def both_sides(g: DataFrame) -> DataFrame:
    """Each contest once from each side (two rows per contest, no join).

    Rows whose own side is null are left out; the opponent may be null.
    """
    keep = ["seq", "season", "series", "stage", "area", "block", "page", "round", "col", "date_text", "match_no", "status", "note", "doc", "winner"]
    a = g.select(*keep, F.lit("A").alias("slot"), *[F.col(x).alias(y) for x, y in (("a", "me"), ("b", "opp"), ("raw_a", "raw"), ("raw_b", "opp_raw"), ("sa", "gf"), ("sb", "ga"), ("pa", "pf"), ("pb", "pg"))])
    b = g.select(*keep, F.lit("B").alias("slot"), *[F.col(x).alias(y) for x, y in (("b", "me"), ("a", "opp"), ("raw_b", "raw"), ("raw_a", "opp_raw"), ("sb", "gf"), ("sa", "ga"), ("pb", "pf"), ("pa", "pg"))])
    return a.unionByName(b).where("me is not null").withColumn("res", result_code(F.col("gf"), F.col("ga")))


def one_view(views: DataFrame) -> DataFrame:
    """Won, PK won, lost, PK lost by the winner's printed name; a draw without a winner comes out as lost."""
    won = F.coalesce(F.col("winner") == F.col("raw"), F.lit(False))
    pk = F.col("pf").isNotNull() | F.col("pg").isNotNull()
    res = F.when(won & pk, "PK勝").when(won, "勝").when(pk, "PK負").otherwise("負")
    return views.withColumn("res", res)


def band(own: Column, other: Column) -> Column:
    """The opponent against oneself: above, below or level; an unrated side counts as 1500."""
    gap = F.coalesce(other, F.lit(1500.0)) - F.coalesce(own, F.lit(1500.0))
    return F.when(gap > 50, "格上").when(gap < -50, "格下").otherwise("同格")


# The same contests for the SQL side.
_NUM = """case when regexp_matches({0}, '^-?[0-9]{{1,9}}$') then cast({0} as int) end"""
GAMES_SQL = f"""games as (select seq, "年度" season, "大会" series, "段階" stage, "地区・支部" area, "ブロック" block, "ページ" page, "ラウンド" round, "列" col,
 "日付" date_text, "試合番号" match_no, "チームA" raw_a, "チームB" raw_b, "チームA_正規化" a, "チームB_正規化" b, {_NUM.format('"得点A"')} sa, {_NUM.format('"得点B"')} sb,
 {_NUM.format('"PK_A"')} pa, {_NUM.format('"PK_B"')} pb, "勝者" winner, "状態" status, "備考" note, "前後半" halves, "出典PDF" doc from matches),
played as (select * from games where status in ('終了', 'スコアのみ記載（赤線未反映）', '赤線が両側（スコアで判定）') and sa is not null and sb is not null)"""
VIEWS_SQL = """views as (select *, case when gf > ga then '○' when gf < ga then '●' when gf = ga then '△' else '' end res from (
 select seq, season, series, stage, area, block, page, round, col, date_text, match_no, status, note, doc, winner, 'A' slot, a me, b opp, raw_a raw, raw_b opp_raw, sa gf, sb ga, pa pf, pb pg from {0}
 union all select seq, season, series, stage, area, block, page, round, col, date_text, match_no, status, note, doc, winner, 'B', b, a, raw_b, raw_a, sb, sa, pb, pa from {0}) where me is not null)"""
