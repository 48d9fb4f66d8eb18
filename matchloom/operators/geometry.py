"""One- and two-dimensional clustering, intervals, nearest and band joins.

Band joins never run as a plain theta join: positions are put into cells as wide as the tolerance, one side is copied
into its own and the two neighbouring cells, and the join is an equi-join on (page, cell) with the exact test after it.
A crowded cell is a skewed key that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_clusters(df: DataFrame, page: str, pos: str, tie: str, gap: float) -> DataFrame:
    """Numbers the clusters of positions whose neighbours are at most `gap` apart."""
    w = Window.partitionBy(page).orderBy(pos, tie)
    new = F.coalesce((F.col(pos) - F.lag(pos).over(w)) > gap, F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def interval_coalesce(df: DataFrame, page: str, lo: str, hi: str, tolerance: float) -> DataFrame:
    """Intervals of a page merged when they overlap or lie within the tolerance."""
    w = Window.partitionBy(page).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce(F.col(lo) > before + tolerance, F.lit(True)).cast("int"))
    grouped = marked.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(page, "_k").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n")).drop("_k")


def regular_runs(df: DataFrame, page: str, pos: str, tie: str, lo: float, hi: float, least: int = 3) -> DataFrame:
    """Runs of at least three positions whose gaps lie in [lo, hi]."""
    w = Window.partitionBy(page).orderBy(pos, tie)
    gap = F.col(pos) - F.lag(pos).over(w)
    new = F.coalesce(~((gap >= lo) & (gap <= hi)), F.lit(True)).cast("int")
    runs = df.withColumn("_new", new).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(page, "_k").agg(F.count("*").alias("n"), F.min(pos).alias("from_pos"), F.max(pos).alias("to_pos")).where(F.col("n") >= least).drop("_k")


def _cell(pos: Column, width: float) -> Column:
    return F.floor(pos / width)


def band_join(left: DataFrame, right: DataFrame, page: str, lpos: str, rpos: str, width: float) -> DataFrame:
    """All pairs of one page at most `width` apart, as an equi-join on cells."""
    r = right.withColumn("_cell", F.explode(F.array(*[_cell(F.col(rpos), width) + k for k in (-1, 0, 1)])))
    l = left.withColumn("_cell", _cell(F.col(lpos), width))
    return l.join(r, [page, "_cell"]).where(F.abs(F.col(lpos) - F.col(rpos)) <= width).drop("_cell")


def nearest_join(left: DataFrame, right: DataFrame, page: str, key: str, lpos: str, rpos: str, rkey: str, width: float) -> DataFrame:
    """The nearest partner within the tolerance, ties to the smaller key; rows without one are kept."""
    pairs = band_join(left.select(page, key, lpos), right.select(page, rkey, rpos), page, lpos, rpos, width)
    best = pairs.groupBy(page, key).agg(F.min_by(F.struct(rkey, rpos), F.struct(F.abs(F.col(lpos) - F.col(rpos)), F.col(rkey))).alias("b"))
    return left.join(best, [page, key], "left").select(*[c for c in left.columns], F.col(f"b.{rkey}").alias(rkey))


def asof_join(left: DataFrame, right: DataFrame, key: str, ltime: str, rtime: str, rvalue: str, forward: bool = False) -> DataFrame:
    """The last row of the right side before (or the first after) each left row, in one sorted pass.

    Both sides are interleaved by time and the value is carried along with a window: one shuffle on the key, no join.
    """
    l = left.select(key, F.col(ltime).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[rvalue].dataType).alias("_v"))
    r = right.select(key, F.col(rtime).alias("_t"), F.lit(0 if forward else 2).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.col(rvalue).alias("_v"))
    both = l.unionByName(r)
    if forward:
        w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        carried = F.first("_v", True).over(w)
    else:
        w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carried = F.last("_v", True).over(w)
    return both.withColumn(rvalue, carried).where("_l is not null").select("_l.*", rvalue)


def interval_overlap(left: DataFrame, right: DataFrame, page: str, width: float) -> DataFrame:
    """Pairs of intervals (lo, hi) of a page that overlap, with the length of the overlap.

    Each interval is copied into every cell it touches; a pair is emitted in the first cell both touch, hence once.
    """
    def cells(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))

    l = cells(left.withColumnsRenamed({"lo": "l_lo", "hi": "l_hi", "id": "l_id"}), "l_lo", "l_hi")
    r = cells(right.withColumnsRenamed({"lo": "r_lo", "hi": "r_hi", "id": "r_id"}), "r_lo", "r_hi")
    first = F.greatest(F.floor(F.col("l_lo") / width), F.floor(F.col("r_lo") / width))
    over = F.least("l_hi", "r_hi") - F.greatest("l_lo", "r_lo")
    return l.join(r, [page, "_cell"]).where((F.col("_cell") == first) & (over > 0)).select(page, "l_id", "r_id", over.alias("overlap"))


def depth_element(df: DataFrame, page: str, value: str, share: float = 0.9) -> DataFrame:
    """Element int(n * share) of the sorted values, capped, which is no percentile."""
    a = F.array_sort(F.collect_list(value))
    return df.groupBy(page).agg(a.alias("a")).select(page, F.element_at("a", F.least(F.size("a") - 1, F.floor(F.size("a") * share).cast("int")) + 1).alias("depth"))


def anchor_rows(df: DataFrame, page: str, key: str, pos: str, tolerance: float) -> DataFrame:
    """Rows of cells by an anchor: a row holds what lies within the tolerance of its first cell. A fold per page;
    pages are bounded by what fits on paper."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([pos, key])
        row, anchor, out = 0, None, []
        for v in frame[pos]:
            if anchor is None or v - anchor > tolerance:
                row, anchor = row + 1, v
            out.append(row)
        return pd.DataFrame({page: frame[page], key: frame[key], "row": out})

    types = dict(df.dtypes)
    return df.select(page, key, pos).groupBy(page).applyInPandas(run, f"{page} {types[page]}, {key} {types[key]}, row int")
