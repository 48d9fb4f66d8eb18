"""Streaming counterparts: running standings and late-tolerant windows over a stream of contests.

The batch pipeline has no streams; these two show the same aggregates kept up incrementally. State is one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A stream of contest files (parquet) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def running_standings(stream: DataFrame) -> DataFrame:
    """Played, won, drawn, lost, points per season and side; columns season, a, b, sa, sb."""
    sides = stream.select(
        "season", F.explode(F.array(
            F.struct(F.col("a").alias("team"), F.col("sa").alias("gf"), F.col("sb").alias("ga")), F.struct(F.col("b").alias("team"), F.col("sb").alias("gf"), F.col("sa").alias("ga")),
        )).alias("s"),
    ).select("season", "s.*").where("team is not null and gf is not null and ga is not null")
    won, drawn = F.count_if(F.col("gf") > F.col("ga")), F.count_if(F.col("gf") == F.col("ga"))
    return sides.groupBy("season", "team").agg(F.count("*").alias("played"), won.alias("won"), drawn.alias("drawn"), (3 * won + drawn).alias("points"))


def arrivals_by_window(stream: DataFrame, at: str = "at", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window of arrival; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")
