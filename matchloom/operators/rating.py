"""Sequential rating: an ordered stateful fold, its configurations, projections and back-test.

Each event reads and writes two ratings, so the fold is serial within a connected component; everything before and
after it runs in parallel. Events are narrowed to a few columns, sorted by Spark within one partition per configuration (a
sweep folds all of them side by side) and streamed through `mapInArrow` in batches: memory holds one entry per side
and one batch, not the events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import level_of, team_key
from .perspective import PLAYED


@dataclass(frozen=True)
class Config:
    """The adopted configuration by default."""

    config_id: int = 0
    k: float = 88.0
    carry: float = 1.0
    mean: float = 1500.0
    league_weight: float = 0.5
    provisional: int = 10
    reserve_step: float = 100.0  # 0: a reserve starts like anyone else
    tiers: bool = True  # sides first seen in a league start by its tier


def win_prob(ea: Column, eb: Column) -> Column:
    """N6"""
    return 1 / (1 + F.pow(F.lit(10.0), (eb - ea) / 400))


def margin_mult(m: Column) -> Column:
    """N7"""
    return F.when(m <= 1, 1.0).when(m == 2, 1.5).otherwise((11 + m) / 8)


# The order of the stages of a season with the day assumed for each, that of the rounds, and the first
# rating of a league's sides by its tier.
STAGES = [("関東", "", 401), ("総体", "支部予選", 425), ("総体", "一次", 510), ("総体", "二次", 525), ("選手権", "一次", 901), ("選手権", "二次", 1015), ("新人戦", "", 1115)]
ROUNDS = {"3位決定戦": 90, "決勝": 80, "ブロック決勝": 70, "準決勝": 60, "準々決勝": 50}
TIERS = {"プリンス": 300.0, "T1": 200.0, "T2": 150.0, "T3": 100.0, "T4": 50.0, "T5": 0.0, "1部": -50.0, "2部": -100.0, "3部": -150.0, "地区": -100.0}
UNKNOWN_STAGE = (99, 401)


def _stage(pick: int) -> Column:
    out = None
    for k, (series, part, day) in enumerate(STAGES):
        cond = (F.col("series") == series) & F.col("stage").contains(part)
        value = F.lit((k, day)[pick])
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(UNKNOWN_STAGE[pick])


def event_round(col: Column) -> Column:
    """T13 for the events: 3位決定戦 last, then 決勝; the number of a numbered round, else 0."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ROUNDS.items() for x in kv]), col)
    return F.coalesce(named, F.regexp_extract(col, r"^(\d+)回戦", 1).try_cast("int"), F.lit(0))


def cup_events(g: DataFrame) -> DataFrame:
    """Played contests of all contests g, in order of date (own, else the earliest of the stage's contests, played
    or not, else the stage's usual day), stage, round and file order."""
    pattern = r"^(\d{1,2})/(\d{1,2})"
    mm = F.regexp_extract("date_text", pattern, 1).try_cast("int")
    dd = F.regexp_extract("date_text", pattern, 2).try_cast("int")
    own = F.when(F.col("date_text").rlike(pattern), (F.col("season") + F.when(mm < 4, 1).otherwise(0)) * 10000 + mm * 100 + dd)
    e = g.withColumn("own", own)
    e = e.withColumn("first", F.min("own").over(Window.partitionBy("season", "series", "stage", "area")))
    e = e.where(F.col("status").isin(*PLAYED) & F.col("sa").isNotNull() & F.col("sb").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return e.select(
        "seq", "season", "a", "b", "sa", "sb", F.coalesce("own", "first", F.col("season") * 10000 + _stage(1)).alias("day"), F.lit(0).alias("kind"),
        _stage(0).alias("st"), event_round(F.col("round")).alias("rr"), (F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("pk"), F.lit(None).cast("string").alias("level"),
    )


def league_events(feed: DataFrame, schools: DataFrame) -> DataFrame:
    """Dated and played league contests; those of a day come after its cup contests.

    feed: (seq, season, league, division, matchday, date, played, home, home_school, home_squad, away, away_school,
    away_squad, hs, as_); schools: (school), those that occur in cups. Rows without a key on a side, or with one key on both,
    are left out.
    """
    known = schools.select(F.col("school"), F.lit(True).alias("known")).distinct()
    f = feed.where("played and hs is not null and as_ is not null").withColumn("on", F.to_date(F.regexp_extract("date", r"^\d{4}-\d{2}-\d{2}", 0).try_cast("date"))).where("on is not null")
    for side in ("home", "away"):
        f = f.join(known.withColumnsRenamed({"school": f"{side}_school", "known": f"{side}_known"}), f"{side}_school", "left")
    key = lambda s: F.nullif(team_key(F.col(s), F.col(f"{s}_school"), F.col(f"{s}_squad"), F.coalesce(f"{s}_known", F.lit(False))), F.lit(""))
    day = F.year("on") * 10000 + F.month("on") * 100 + F.dayofmonth("on")
    section = F.coalesce(F.regexp_replace(F.col("matchday").cast("string"), r"\D", "").try_cast("int"), F.lit(0))
    e = f.select(
        "seq", "season", key("home").alias("a"), key("away").alias("b"), F.col("hs").alias("sa"), F.col("as_").alias("sb"), day.alias("day"), F.lit(1).alias("kind"), F.lit(0).alias("st"),
        section.alias("rr"), F.lit(False).alias("pk"), level_of(F.col("league"), F.col("division")).alias("level"),
    )
    return e.where("a is not null and b is not null and a <> b")


_OUT = "config_id int, seq bigint, season int, a string, b string, ea double, eb double, p double, s double, na int, nb int, post_a double, post_b double"
_IN = ("config_id", "seq", "season", "a", "b", "sa", "sb", "pk", "kind", "level")
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.float64(), pa.float64()]


class Fold:
    """E4-E9 on plain values; one instance per group."""

    def __init__(self, config: dict):
        self.c, self.elo, self.games, self.season = config, {}, {}, None

    def start(self, side: str, kind: int, level: str | None) -> float:
        """E5: a reserve starts below its school's first side, a side first seen in a league by the tier, else the mean."""
        step = self.c["reserve_step"]
        if step and len(side) > 3 and side.endswith("）") and side[-3] == "（" and "B" <= side[-2] <= "J" and side[:-3] in self.elo:
            return self.elo[side[:-3]] - step * (ord(side[-2]) - ord("A"))
        return self.c["mean"] + (TIERS.get(level, 0.0) if kind and self.c["tiers"] else 0.0)

    def step(self, season: int, a: str, b: str, sa: int, sb: int, pk: bool, kind: int, level: str | None = None) -> tuple:
        c, elo, games = self.c, self.elo, self.games
        if self.season is not None and season != self.season and c["carry"] != 1:
            for t in elo:
                elo[t] = c["mean"] + c["carry"] * (elo[t] - c["mean"])
        self.season = season
        for t in (a, b):
            if t not in elo:
                elo[t], games[t] = self.start(t, kind, level), 0
        ea, eb, na, nb = elo[a], elo[b], games[a], games[b]
        p = 1 / (1 + 10 ** ((eb - ea) / 400))
        s = 0.5 if pk or sa == sb else 1.0 if sa > sb else 0.0
        m = abs(sa - sb)
        mult = 1.0 if m <= 1 else 1.5 if m == 2 else (11 + m) / 8
        delta = c["k"] * (1.0 if kind == 0 else c["league_weight"]) * mult * (s - p)
        n = c["provisional"]
        pa_, pb_ = bool(n) and na < n, bool(n) and nb < n  # provisional sides
        if not (pb_ and not pa_):  # E7: frozen against a provisional opponent, unless provisional itself
            elo[a] = ea + delta
        if not (pa_ and not pb_):
            elo[b] = eb - delta
        games[a], games[b] = na + 1, nb + 1
        return ea, eb, p, s, na, nb, elo[a], elo[b]


def rating_fold(events: DataFrame, configs: list[Config]) -> DataFrame:
    """One row per event and configuration with the ratings before and after it."""
    spark = events.sparkSession
    table = spark.createDataFrame([(c.config_id,) for c in configs], "config_id int")
    by_id = {c.config_id: asdict(c) for c in configs}
    full = events.select("seq", "season", "a", "b", "sa", "sb", "day", "kind", "st", "rr", "pk", "level").crossJoin(F.broadcast(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, current = None, None
        for batch in batches:
            out = []
            for cid, seq, season, a, b, sa, sb, pk, kind, level in zip(*[batch.column(c).to_pylist() for c in _IN], strict=True):
                if cid != current:
                    fold, current = Fold(by_id[cid]), cid
                out.append((cid, seq, season, a, b, *fold.step(season, a, b, sa, sb, pk, kind, level)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    # each configuration in one partition, sorted by Spark (which spills), streamed through in batches
    ordered = full.repartition("config_id").sortWithinPartitions("config_id", "day", "kind", "st", "rr", "seq")
    return ordered.mapInArrow(run, _OUT)


def final_ratings(fold: DataFrame) -> DataFrame:
    """The last rating of every side and its number of games (order: the fold's own, by games played)."""
    side = fold.select("config_id", F.col("a").alias("team"), "season", F.col("post_a").alias("r"), F.col("na").alias("n")).unionByName(
        fold.select("config_id", F.col("b").alias("team"), "season", F.col("post_b").alias("r"), F.col("nb").alias("n"))
    )
    return side.groupBy("config_id", "team").agg(F.max_by("r", "n").alias("rating"), (F.max("n") + 1).alias("games"))


def rating_history(fold: DataFrame, carry: float = 1.0, mean: float = 1500.0) -> DataFrame:
    """The rounded rating of every side seen so far at the end of each season with events, pulled to the mean by
    `carry` for each such season without events of its own; change since the season before, rank within the season."""
    side = fold.select(F.col("a").alias("team"), "season", F.col("post_a").alias("r"), F.col("na").alias("n")).unionByName(
        fold.select(F.col("b").alias("team"), "season", F.col("post_b").alias("r"), F.col("nb").alias("n"))
    )
    own = side.groupBy("team", "season").agg(F.max_by("r", "n").alias("r"))
    # seasons are few: their numbers in order
    seasons = fold.select("season").distinct().withColumn("k", F.row_number().over(Window.orderBy("season")))
    numbered = own.join(F.broadcast(seasons), "season")
    last = F.coalesce(F.lead("k").over(Window.partitionBy("team").orderBy("k")) - 1, F.lit(None).cast("int"))
    spans = numbered.withColumn("until", last).crossJoin(F.broadcast(seasons.agg(F.max("k").alias("end"))))
    h = spans.select("team", F.col("k").alias("k0"), "r", F.explode(F.sequence("k", F.coalesce("until", "end"))).alias("k")).join(F.broadcast(seasons), "k")
    h = h.select("team", "season", F.round(F.lit(mean) + (F.col("r") - mean) * F.pow(F.lit(carry), F.col("k") - F.col("k0"))).cast("int").alias("rating"))
    before = h.select("team", (F.col("season") + 1).alias("season"), F.col("rating").alias("before"))
    w = Window.partitionBy("season").orderBy(F.col("rating").desc(), "team")
    return h.join(before, ["team", "season"], "left").select("team", "season", "rating", (F.col("rating") - F.col("before")).alias("delta"), F.row_number().over(w).alias("rank"))


def scores(preds: DataFrame) -> DataFrame:
    """Log loss, Brier score and accuracy (draws and p = 0.5 count in no accuracy) per configuration."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    decided = (F.col("s") != 0.5) & (F.col("p") != 0.5)
    return preds.groupBy("config_id").agg(
        F.count("*").alias("n"), F.avg(-(F.col("s") * F.log(p) + (1 - F.col("s")) * F.log(1 - p))).alias("log_loss"),
        F.avg(F.pow(F.col("p") - F.col("s"), 2)).alias("brier"), F.avg(F.when(decided, ((F.col("p") > 0.5) == (F.col("s") > 0.5)).cast("double"))).alias("accuracy"),
    )


def calibration(preds: DataFrame) -> DataFrame:
    """Predictions folded to p <= 0.5 in half-open bins; exactly 0.5 falls in none."""
    p = F.when(F.col("p") > 0.5, 1 - F.col("p")).otherwise(F.col("p"))
    s = F.when(F.col("p") > 0.5, 1 - F.col("s")).otherwise(F.col("s"))
    bin_ = F.when(p < 0.05, "0-5").when(p < 0.1, "5-10").when(p < 0.2, "10-20").when(p < 0.35, "20-35").when(p < 0.5, "35-50")
    return preds.select(bin_.alias("bin"), p.alias("p"), s.alias("s")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("s").alias("observed"))
