"""Helpers shared by the operators: tables in the shared folder, prefix sums without hot windows, blocks of text bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.session import scratch_path

#: Separators of words, as in the contract's word pattern.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage and outlives lost executors.

    Nothing reads the shuffle files of the write once it is done, so they go with it instead of waiting for the driver's garbage collection.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, name: str, extra: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group that come earlier by (bucket, order).

    Only bucket sums meet per group, rows meet per (group, bucket), so a group with most of the rows is no hot task.
    ``extra`` (one row per group) is attached to the bucket sums, not to the rows.
    """
    by_bucket = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(by_bucket), F.lit(0))).drop("_sum")
    if extra is not None:
        sums = sums.join(extra, group)
    rows = df.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, [*group, bucket]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``most`` bytes of text (one row at least): rows, bytes, offsets of the rows. Null is empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(sizes):
        ends = np.cumsum(sizes[first:])
        last = first + max(1, int(np.searchsorted(ends, most, side="right")))
        part = batch.slice(first, last - first)
        data, offsets = flat(part.column(column))
        yield part, data, offsets
        first = last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array as one numpy array, and row offsets into it."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if data is None or not len(raw):
        return np.zeros(0, np.uint8), np.zeros(len(raw) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
