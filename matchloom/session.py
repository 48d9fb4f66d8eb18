"""Session defaults, the shared checkpoint folder and table access."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "matches", "corrections", "prince_kanto1_2026_standings", "external_results", "school_roster", "doc_sources",
)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("matchloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only where none is set (local tests) make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="matchloom-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table written in the shared folder, so that the result survives the loss of executors.

    A written table, unlike DataFrame.checkpoint, also forgets the plan's constraints, which otherwise multiply with
    every round of an iteration, and tells the planner its true size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path  # for release
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames that checkpointed returned and nothing reads any more, as those of an earlier round."""
    for df in frames:
        path = getattr(df, "written_to", None)
        if path is not None:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files stay on the executors' disks until the driver's garbage collector finds that nothing refers to them;
    a small driver can go without one for a whole query, so it is asked for after a stage with large shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (a parquet file or a folder of them)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
