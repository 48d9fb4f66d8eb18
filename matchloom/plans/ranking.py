"""A global rank without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds 1..n in the given order: a range sort, ranks within each partition and the offsets of the partitions.

    The order has to be total. The offsets are one row per partition. The sorted rows are written once, so that both
    passes see the same partitions.
    """
    spread = checkpointed(df.sort(*order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        spread.withColumn("_inside", inside).join(F.broadcast(before), "_part")
        .withColumn(name, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_part", "_inside", "_before")
    )
