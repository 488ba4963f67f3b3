"""Session settings used by tests, the benchmark and the entry point."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str = "8", app: str = "terraweft", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the plans expect on a cluster as well."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by the session."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not folder and context.master.startswith("local"):
        # a single machine is its own cluster
        folder = f"{tempfile.gettempdir()}/terraweft-checkpoints"
    if not folder:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application that goes when the application ends."""
    run = f"{shared_folder(spark)}/terraweft-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{run}/{uuid.uuid4().hex[:12]}/{name}"


_RUNS: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut_lineage`` for wide or many rows: a Parquet table below the shared folder, read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so lost executors do not repeat the work."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
