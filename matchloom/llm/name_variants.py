"""Problem 1: variant spellings of names typed by people.

1. Distinct names with their numbers of records and their spread over areas: one pre-aggregated groupBy.
2. Character n-gram vectors (gapped, order-free, so that swapped and missing characters leave something in common),
   weighted by inverse frequency; a sparse cosine self-join looks at every pair at or above the threshold. The names are cut
   into blocks by hash, and each pair of blocks is multiplied by n-gram postings in one task: what is shuffled are
   vectors, once for each block, never pairs, whose number grows with the square of the names. Related spellings leave the
   task as rows, the others only as counts. There is no top-n cut, which holds the n nearest of each name for any n.
3. Each pair's weight for the linkage is a calibrated function of its cosine, how much smaller the rarer name is, which
   characters are replaced and how often they are elsewhere, the agreement of their areas, and the share of the rarer
   name's records for which another copy of the same contest sheet carries the other name. The function is a logistic
   regression fitted here on weak labels: pairs that share contest sheets against pairs of far areas or that played each
   other. All quantities are shares or relative to the median name, so that the same table counted ten times gives the
   same links. An exact check (`school_names.compare`) then takes out pairs that no single slip explains.
4. Average-linkage clustering in which every record counts: the similarity of two clusters is the mean over all pairs
   of their records. Mutual best pairs of clusters merge in rounds (average linkage is reducible, so merging them at
   once gives the same tree as one at a time) until no pair reaches the threshold. Each round is a few joins over the
   remaining cluster pairs; nothing is collected.

The regression sees at most `SAMPLE` labelled pairs, chosen by hash; every count, rate and weight covers all data.

Results for odd input: null names are left out; names without any n-gram form classes of their own; ties between
merges go to the smaller name; repeated rows only raise a name's weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from ..session import checkpointed, collect_garbage, release
from . import logistic, school_names

COSINE = 0.15  # least cosine of two vectors to be looked at
LINK = 0.35  # least mean similarity of two clusters to merge
BLOCK, LEAST_BLOCKS = 32_768, 6  # most names in a block, and least number of blocks, of the cosine join
CELLS = 2_000_000  # cosines held at once
AREAS = 9  # 第1地区 .. 第9地区
SAMPLE = 40_000  # most labelled pairs that fit one regression
RATE = 0.01  # least share of the rarer name's records with a copy under the other name, for the two to share sheets
TYPICAL = 0.05  # the usual share among spellings of one school


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grams(names: pd.Series) -> pd.Series:
    return names.map(school_names.grams)


def side_rows(matches: DataFrame) -> DataFrame:
    """(seq, name, other, area) for both sides of every row."""
    area = F.regexp_extract("`地区・支部`", r"(\d+)", 1).try_cast("int").alias("area")
    a = matches.select("seq", F.col("チームA_正規化").alias("name"), F.col("チームB_正規化").alias("other"), area)
    b = matches.select("seq", F.col("チームB_正規化").alias("name"), F.col("チームA_正規化").alias("other"), area)
    return a.unionByName(b).where("name is not null")


def names_of(matches: DataFrame) -> DataFrame:
    """(name, n, areas): number of sides and their counts by area."""
    per = [F.count_if(F.col("area") == k).cast("int") for k in range(1, AREAS + 1)]
    return side_rows(matches).groupBy("name").agg(F.count("*").cast("int").alias("n"), F.array(*per).alias("areas"))


def shared_contests(matches: DataFrame) -> DataFrame:
    """(a, b, shared), a < b: how often two rows of one contest sheet differ in this name only.

    Rows of one contest agree in season, series, stage, page, round, column and document, and in area, block and number
    where both have them; a row without a document meets those of any. The other side is the same. All but the name is
    compared by 64-bit hashes. The records are shuffled once, by the key alone: both sides of the join read that shuffle.
    """
    stem = F.regexp_replace(F.regexp_replace("出典PDF", r"\.[A-Za-z]+$", ""), r"^matome_", "")
    stem = F.nullif(F.regexp_extract(stem, r"^([a-z]+\d+_[a-z]+_\d+)", 1), F.lit(""))
    hashed = lambda c, name: F.when(c.isNotNull(), F.xxhash64(c)).alias(name)
    loose = {"試合番号": "no", "ブロック": "block", "地区・支部": "area"}
    key = ["年度", "大会", "段階", "ページ", "ラウンド", "列"]
    absent = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in key])  # a null differs from ''
    sides = []
    for name, other in (("チームA_正規化", "チームB_正規化"), ("チームB_正規化", "チームA_正規化")):
        sides.append(matches.where(F.col(name).isNotNull() & F.col(other).isNotNull()).select(
            F.xxhash64(*key, absent, F.col(other)).alias("k"), hashed(stem, "doc"), *[hashed(F.col(f"`{c}`"), n) for c, n in loose.items()], F.col(name).alias("name")
        ))
    keyed = sides[0].unionByName(sides[1]).repartition("k").distinct()
    agree = " and ".join(f"coalesce(l.{c} = r.{c}, true)" for c in ("doc", *loose.values()))
    pairs = keyed.alias("l").join(keyed.alias("r"), F.expr(f"l.k = r.k and l.name < r.name and {agree}"))
    return pairs.select(F.col("l.name").alias("a"), F.col("r.name").alias("b")).groupBy("a", "b").agg(F.count("*").cast("int").alias("shared"))


def met_pairs(matches: DataFrame) -> DataFrame:
    """(a, b), a < b: names that played each other."""
    a, b = F.col("チームA_正規化"), F.col("チームB_正規化")
    return matches.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _blocks() -> Column:
    """The number of blocks, by the total of names."""
    return F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("total") / BLOCK).cast("int"))


def _block(name: str) -> Column:
    return F.pmod(F.xxhash64(name), _blocks()).cast("int")


def _vectors(names: DataFrame, grams=_grams, keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, *keep, gs, dfs, total, own, i, j): the n-grams of each name with their numbers of names, once for each pair
    of blocks i <= j that its own block is in. Blocks are by hash of the name, of about BLOCK names at most."""
    long = names.select("name", F.explode(grams("name")).alias("g"))
    idf = long.groupBy("g").agg(F.count("*").alias("df"))
    x = long.join(idf, "g").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("g", "df"))).alias("x"))
    total = names.agg(F.count("*").alias("total"))
    full = names.select("name", *keep).join(x, "name", "left").crossJoin(F.broadcast(total)).withColumn("own", _block("name"))
    pairs = F.transform(F.sequence(F.lit(0), _blocks() - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    return full.select("name", *keep, F.col("x.g").alias("gs"), F.col("x.df").alias("dfs"), "total", "own", F.explode(pairs).alias("p")).select("*", "p.i", "p.j").drop("p")


class _Block:
    """The vectors of one block: unit weights by name, and postings by n-gram."""

    def __init__(self, rows: pa.Table, codes: np.ndarray, sizes: np.ndarray, dfs: np.ndarray, grams: int) -> None:
        self.names = rows["name"].to_pylist()
        total = rows["total"][0].as_py() if len(self.names) else 1
        row = np.repeat(np.arange(len(self.names)), sizes)
        w = np.log(1 + total / dfs)
        w = w / np.sqrt(np.bincount(row, w * w, len(self.names)))[row]
        common = dfs > 1  # the others are in no second name
        self.row, self.code, self.w = row[common], codes[common], w[common]
        self.first = np.searchsorted(self.row, np.arange(len(self.names) + 1))
        order = np.argsort(self.code, kind="stable")
        self.row_of, self.w_of = self.row[order], self.w[order]
        self.start = np.searchsorted(self.code[order], np.arange(grams + 1))

    def cosines(self, other: _Block) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, cosines of some rows with all of other)."""
        width = len(other.names)
        lo = 0
        while lo < len(self.names) and width:
            hi = min(len(self.names), lo + max(1, CELLS // width))
            e = slice(self.first[lo], self.first[hi])
            at, n = other.start[self.code[e]], other.start[self.code[e] + 1] - other.start[self.code[e]]
            to = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat((self.row[e] - lo) * width, n) + other.row_of[to]
            yield lo, np.bincount(cell, np.repeat(self.w[e], n) * other.w_of[to], (hi - lo) * width).reshape(hi - lo, width)
            lo = hi


def _two_blocks(rows: pa.Table) -> tuple[_Block, _Block, np.ndarray, np.ndarray]:
    """The blocks of one pair (twice the same where it is one block), and the rows of each in the table."""
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    lists = rows["gs"].combine_chunks()
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(int)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes, dfs = coded.indices.to_numpy(zero_copy_only=False), pc.list_flatten(rows["dfs"].combine_chunks()).to_numpy(zero_copy_only=False)
    own = rows["own"].to_numpy()
    blocks = []
    for k in (i, j):
        here = own == k
        entry = np.repeat(here, sizes)
        blocks.append((_Block(rows.filter(pa.array(here)), codes[entry], sizes[here], dfs[entry], len(coded.dictionary)), np.flatnonzero(here)))
        if i == j:
            return blocks[0][0], blocks[0][0], blocks[0][1], blocks[0][1]
    return blocks[0][0], blocks[1][0], blocks[0][1], blocks[1][1]


def cosine_pairs(names: DataFrame, least: float = COSINE, grams=_grams) -> DataFrame:
    """(a, b, cosine), a < b, of all names whose weighted n-gram vectors reach the cosine."""

    def run(rows: pa.Table) -> pa.Table:
        x, y, _, _ = _two_blocks(rows)
        out = []
        for lo, c in x.cosines(y):
            p, q = np.nonzero(c >= least)
            for a, b, v in zip(p + lo, q, c[p, q], strict=True):
                if x is not y or a < b:
                    out.append((*sorted((x.names[a], y.names[b])), v))
        a, b, v = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "cosine": pa.array(v, pa.float64())})

    return _vectors(names, grams).groupBy("i", "j").applyInArrow(run, "a string, b string, cosine double")


def related_pairs(names: DataFrame, shared: DataFrame, least: float = COSINE) -> DataFrame:
    """(a, b, cosine, shared, bin, pairs), a < b: of the names that reach the cosine or share contests, each pair of related
    spellings, and the others as numbers of pairs by the bin of their areas (a and b are null there).

    Unrelated pairs, whose number grows with the square of the names, are counted where they are found and not written.
    """
    total = names.agg(F.count("*").alias("total"))
    both = shared.crossJoin(F.broadcast(total)).select("a", "b", "shared", F.least(_block("a"), _block("b")).alias("i"), F.greatest(_block("a"), _block("b")).alias("j"))

    def run(rows: pa.Table, sheets: pa.Table) -> pa.Table:
        x, y, of_x, of_y = _two_blocks(rows)
        areas = np.array(rows["areas"].to_pylist(), float).reshape(rows.num_rows, AREAS)
        n = rows["n"].to_numpy()
        keys_x = [school_names.edit_keys(name) for name in x.names]
        keys_y = keys_x if x is y else [school_names.edit_keys(name) for name in y.names]
        at_x, at_y = ({name: k for k, name in enumerate(z.names)} for z in (x, y))
        ranks = np.argsort(np.argsort(np.array(rows["name"].to_pylist(), object)))
        met: dict[int, list[tuple[int, int]]] = {}
        for a, b, s in zip(*(sheets[c].to_pylist() for c in ("a", "b", "shared")), strict=True):
            p, q = (at_x[a], at_y[b]) if a in at_x and b in at_y else (at_x[b], at_y[a])
            met.setdefault(min(p, q) if x is y else p, []).append((max(p, q) if x is y else q, s))
        out, unrelated = [], np.zeros(len(_AREA_BINS) + 2, int)
        for lo, c in x.cosines(y):
            sheet = {(p, q): s for p in range(lo, lo + len(c)) if p in met for q, s in met[p]}
            looked = c >= least
            for p, q in sheet:
                looked[p - lo, q] = True
            p, q = np.nonzero(looked)
            if x is y:
                p, q = p[p + lo < q], q[p + lo < q]
            near = np.zeros(len(p), bool)
            for k, (a, b) in enumerate(zip((p + lo).tolist(), q.tolist(), strict=True)):
                if not keys_x[a].isdisjoint(keys_y[b]) and school_names.compare(x.names[a], y.names[b])[0] is not None:
                    near[k] = True
                    cosine = c[a - lo, b]
                    out.append((*sorted((x.names[a], y.names[b])), cosine if cosine >= least else None, sheet.get((a, b))))
            a, b = of_x[p[~near] + lo], of_y[q[~near]]
            first = ((n[a] > n[b]) | ((n[a] == n[b]) & (ranks[a] > ranks[b])))[:, None]
            agree = area_agreement(np.where(first, areas[a], areas[b]), np.where(first, areas[b], areas[a]))
            unrelated += np.bincount(area_bins(agree), minlength=len(unrelated))
        bins = range(len(unrelated))
        empty = [None] * len(unrelated)
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = {"a": pa.string(), "b": pa.string(), "cosine": pa.float64(), "shared": pa.int32()}
        table = {c: pa.array([*v, *empty], kind) for (c, kind), v in zip(kinds.items(), cols, strict=True)}
        return pa.table(table | {"bin": pa.array([*[None] * len(out), *bins], pa.int32()), "pairs": pa.array([*[1] * len(out), *unrelated.tolist()], pa.int64())})

    return _vectors(names, keep=("n", "areas")).groupBy("i", "j").cogroup(both.groupBy("i", "j")).applyInArrow(run, "a string, b string, cosine double, shared int, bin int, pairs bigint")


def area_agreement(big: np.ndarray, small: np.ndarray) -> np.ndarray:
    """How well the smaller names' records lie where the larger ones' do, by row: 1 when they are spread alike, NaN where
    the areas are unknown."""
    total, own = small.sum(axis=1), (big * big).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((total > 0) & (own > 0), np.minimum(1.0, (small * big).sum(axis=1) * big.sum(axis=1) / (total * own)), np.nan)


def area_bins(agree: np.ndarray) -> np.ndarray:
    """The bin of each agreement, the last one for unknown."""
    return np.where(np.isnan(agree), len(_AREA_BINS) + 1, (agree[:, None] >= np.array(_AREA_BINS)).sum(axis=1))


_IN = ["a", "b", "na", "nb", "areas_a", "areas_b", "cosine", "shared", "met"]
_OUT = "a string, b string, lo int, hi int, kind string, length int, replaced string, cosine double, shared int, met boolean, agree double"


def described_pairs(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, cosine, shared, met) with their sizes, relation and agreement of areas."""
    left = names.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("areas").alias("areas_a"))
    right = names.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("areas").alias("areas_b"))
    full = pairs.join(left, "a").join(right, "b").select(*_IN)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            a, b = (np.array(f[c].tolist(), float).reshape(len(f), AREAS) for c in ("areas_a", "areas_b"))
            first = ((f.na > f.nb) | ((f.na == f.nb) & (f.a > f.b))).to_numpy()[:, None]
            f["agree"] = area_agreement(np.where(first, a, b), np.where(first, b, a))
            f["lo"], f["hi"] = np.minimum(f.na, f.nb), np.maximum(f.na, f.nb)
            rel = [school_names.compare(x, y) for x, y in zip(f.a, f.b, strict=True)]
            f["kind"], f["length"], f["replaced"] = ([r[k] for r in rel] for k in range(3))
            yield f[[c.split()[0] for c in _OUT.split(", ")]]

    return full.mapInPandas(run, _OUT)


# Where the fits start from; with many labelled pairs they count for little.
_SHEET_PRIOR = [1.0, 2.0, -1.0]
_LINK_PRIOR = [2.0, 3.0, 0.0, -0.5, -1.5, 2.0, -3.0, -2.0, -1.0]
_AREA_BINS = [0.1, 0.3, 0.5]
_AREA_PRIOR = ([0.5, 0.5, 1.0, 50.0], [40.0, 2.0, 2.0, 8.0])  # pairs of one school and others, by bin


def _logit(columns: list[Column], weights: np.ndarray) -> Column:
    return sum((c * float(w) for c, w in zip(columns[1:], weights[1:], strict=True)), F.lit(float(weights[0])))


def _fitted(rows: DataFrame, columns: list[Column], label: Column, weight: Column, prior: list[float]) -> np.ndarray:
    """Logistic weights from at most SAMPLE of the rows, by hash."""
    named = [c.cast("double").alias(f"x{k}") for k, c in enumerate(columns)]
    sample = rows.orderBy(F.xxhash64("a", "b")).limit(SAMPLE).select(*named, label.cast("double").alias("y"), weight.cast("double").alias("w")).toPandas()
    x = sample[[f"x{k}" for k in range(len(columns))]].to_numpy(float)
    return logistic.fit(x, sample.y.to_numpy(float), sample.w.to_numpy(float), prior)


def scored_pairs(described: DataFrame, names: DataFrame, unrelated: DataFrame | None = None) -> DataFrame:
    """(a, b, s): the weight of each related pair in the linkage, near the probability that both are one school.

    unrelated: (bin, pairs), numbers of unrelated pairs besides those of described.
    """
    median = names.agg(F.median("n").alias("median"))
    d = described.crossJoin(F.broadcast(median)).withColumns({
        "ratio": F.log(F.col("lo") / F.col("hi")), "size": F.log(F.col("lo") / F.col("median")), "rate": F.coalesce("shared", F.lit(0)) / F.col("lo"),
        "bin": F.when(F.col("agree").isNull() | F.isnan("agree"), len(_AREA_BINS) + 1).otherwise(sum((F.col("agree") >= x).cast("int") for x in _AREA_BINS)),
    })
    top = len(_AREA_BINS)
    sheets, near = F.col("rate") >= RATE, F.col("bin") == top
    d = d.withColumns({"sheets": sheets, "met": F.col("met") & ~sheets})
    related = F.col("kind").isNotNull()
    # how the areas of spellings of one school agree, and those of unrelated names
    sure = related & (F.col("sheets") | (F.col("cosine") >= 0.95))
    seen = {r.bin: (r.own, r.other) for r in d.groupBy("bin").agg(F.count_if(sure).alias("own"), F.count_if(~related).alias("other")).collect()}  # five rows
    if unrelated is not None:
        for r in unrelated.groupBy("bin").agg(F.sum("pairs").alias("pairs")).collect():  # five rows
            own, other = seen.get(r.bin, (0, 0))
            seen[r.bin] = own, other + r.pairs
    own, other = (np.array([_AREA_PRIOR[k][b] + seen.get(b, (0, 0))[k] for b in range(top + 1)]) for k in (0, 1))
    share = float(other[top] / other.sum())  # of unrelated names in one area
    llr = np.log(own / own.sum()) - np.log(other / other.sum())
    area = F.element_at(F.array(*[F.lit(float(x)) for x in [*(llr - llr[top]), -llr[top]]]), F.col("bin") + 1)
    # how likely spellings of one school are to share a sheet, by their sizes
    one = F.lit(1.0)
    sizes = [one, F.col("size"), F.col("ratio")]
    sheet = _fitted(d.where(related & (F.col("cosine") >= 0.8) & near), sizes, F.col("sheets"), one, _SHEET_PRIOR)
    chance = 1 / (1 + F.exp(-_logit(sizes, sheet)))
    r = d.where(related).withColumn("chance", chance)
    # weak labels: shared sheets, weighted up by their chance; far areas or a contest against each other, weighted to the
    # number of unrelated names that one area holds
    yes, no = F.col("sheets") & near, ((F.col("bin") == 0) | F.col("met")) & ~F.col("sheets")
    r = r.withColumns({
        "yes": F.when(yes, 1 / F.greatest("chance", F.lit(0.05))).otherwise(0.0), "no": F.when(no, share / (1 - share)).otherwise(0.0),
    })
    # how often the same two characters are replaced by each other elsewhere, in pairs of one school and of two
    swaps = r.where("replaced is not null").groupBy("replaced").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    r = r.join(swaps, "replaced", "left")
    replaced = F.col("replaced").isNotNull()
    elsewhere = lambda c: F.when(replaced, F.log1p(F.greatest(F.col(f"all_{c}") - F.col(c), F.lit(0.0)))).otherwise(0.0)
    columns = [
        one, F.coalesce("cosine", F.lit(0.0)), F.col("ratio"), F.col("size"), ((F.col("length") <= 2) & (F.coalesce("cosine", F.lit(0.0)) < 0.8)).cast("double"),
        elsewhere("yes"), elsewhere("no"), replaced.cast("double"), (F.col("kind") == "drop").cast("double"),
    ]
    r = checkpointed(r.select("a", "b", "sheets", "met", "rate", "chance", "yes", "no", area.alias("area"), *[c.alias(f"f{k}") for k, c in enumerate(columns)]))
    columns = [F.col(f"f{k}") for k in range(len(columns))]
    link = _fitted(r.where("yes > 0 or no > 0"), columns, F.col("yes") > 0, F.greatest("yes", "no"), _LINK_PRIOR)
    z = _logit(columns, link) + F.col("area") + F.when(F.col("met"), -4.0).otherwise(0.0) + F.when(F.col("sheets"), 0.0).otherwise(F.log(1 - F.col("chance") + 1e-4))
    p = 1 / (1 + F.exp(-z))
    seen_on = F.least(F.lit(0.95), F.greatest(F.lit(0.5), F.col("rate") / TYPICAL))
    return r.select("a", "b", F.when(F.col("sheets"), 1 - (1 - p) * (1 - seen_on)).otherwise(p).alias("s")).where("s >= 0.001")


def average_linkage(weights: DataFrame, pairs: DataFrame, threshold: float = LINK) -> DataFrame:
    """(name, cluster) by record-weighted average linkage over sparse similarities, until no pair reaches the threshold.

    weights: (name, n); pairs: (a, b, s), a < b, absent pairs count as 0. The cluster is named by its member with the
    most records (ties: the smaller name) among those merged last. A round merges all pairs that are each other's best, and with such a pair
    all clusters that are as near to the larger one, to the smaller one and to each other: merging them one by one would
    change none of their means, so that a school in many equal spellings takes one round, not one for each.
    """
    w = weights.select("name", F.col("n").cast("double").alias("n"))
    member = w.select("name", F.col("name").alias("cluster"))
    # both directions, sums of n_a * n_b * s
    edges = (
        pairs.join(w.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(w.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
        .select("a", "b", (F.col("s") * F.col("na") * F.col("nb")).alias("mass"))
    )
    edges = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "mass")))
    sizes = checkpointed(w.select(F.col("name").alias("c"), "n").join(edges.select(F.col("a").alias("c")).distinct(), "c"))
    steps: list[DataFrame] = []

    def followed(member: DataFrame) -> DataFrame:
        """member after the moves of the steps, in their order."""
        for step in steps:
            member = (
                member.join(step.withColumnRenamed("old", "cluster"), "cluster", "left").select("name", F.coalesce("new", "cluster").alias("cluster"))
            )
        return member

    while True:
        # neighbours by mean similarity; ties to the smaller name on both sides
        near = (
            edges.join(sizes.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
            .select("a", "b", "na", "nb", (F.col("mass") / (F.col("na") * F.col("nb"))).alias("mean"))
            .where(F.col("mean") >= threshold)
        )
        key = F.struct(
            F.round("mean", 9).alias("mean"), F.greatest("na", "nb").alias("hi"), F.least("na", "nb").alias("lo"),
            F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"),
        )
        level = F.round("mean", 9)
        best = checkpointed(
            near.groupBy("a").agg(F.max_by(F.struct("b", "na", "nb", level.alias("level")), key).alias("to")).select("a", "to.b", "to.na", "to.nb", "to.level")
        )
        other = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
        mutual = best.join(other, ["a", "b"], "left_semi")
        # the smaller cluster moves into the larger
        moves = mutual.where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))).select(
            F.col("a").alias("old"), F.col("b").alias("new"), F.col("level")
        )
        # others whose best partner is the larger one too, at the same mean
        also = best.join(moves.select(F.col("new").alias("b"), "level", "old"), ["b", "level"]).where("a <> old").select("a", F.col("b").alias("new"), "level", "old")
        step = moves.select("old", "new")
        if not also.isEmpty():
            star = also.select("a", "new", "level", "old").unionByName(moves.select(F.col("old").alias("a"), "new", "level", "old"))
            equal = (
                near.select("a", "b", level.alias("level"))
                .join(star, ["a", "level"])
                .join(star.select(F.col("a").alias("b"), "new"), ["b", "new"])
                .withColumn("b_near", F.max(F.col("a") == F.col("old")).over(Window.partitionBy("new", "b")))
            )
            ties = equal.where("a <> old").groupBy("new", "a").agg(F.max(F.col("b") == F.col("old")).alias("a_near"), F.count_if((F.col("b") != F.col("old")) & F.col("b_near")).alias("ties"))
            whole = ties.where("a_near").withColumn("size", F.count("*").over(Window.partitionBy("new"))).where("ties = size - 1")
            step = step.unionByName(whole.select(F.col("a").alias("old"), "new"))
        step = checkpointed(step)
        if step.isEmpty():
            break
        steps.append(step)
        if len(steps) == 10:  # else the plan grows with the rounds
            member = checkpointed(followed(member))
            steps.clear()
        ren = lambda df, c: df.join(step.select(F.col("old").alias(c), F.col("new").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        old = edges, sizes, best
        edges = checkpointed(ren(ren(edges, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("mass").alias("mass")))
        sizes = checkpointed(ren(sizes, "c").groupBy("c").agg(F.sum("n").alias("n")))
        release(*old)
    return followed(member)


def school_clusters(matches: DataFrame, cosine: float = COSINE, threshold: float = LINK) -> DataFrame:
    """(name, cluster, n, areas): the class of every normalised name of matches."""
    names = checkpointed(names_of(matches))
    # pairs that share contests are looked at whatever their cosine
    found = checkpointed(related_pairs(names, shared_contests(matches), cosine))
    collect_garbage(matches.sparkSession)
    met = met_pairs(matches).withColumn("met", F.lit(True))
    pairs = found.where("a is not null").drop("bin", "pairs").join(met, ["a", "b"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    scored = scored_pairs(checkpointed(described_pairs(names, pairs)), names, found.where("a is null").select("bin", "pairs"))
    return average_linkage(names, scored, threshold).join(names, "name")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different names that stand for one school; name_a < name_b by code points."""
    clusters = checkpointed(school_clusters(spark.read.parquet(f"{folder}/matches.parquet")))
    a = clusters.select("cluster", F.col("name").alias("name_a"))
    b = clusters.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every normalised name with its class and its number of records."""
    return school_clusters(spark.read.parquet(f"{folder}/matches.parquet")).select("name", "cluster", F.col("n").alias("records"))
