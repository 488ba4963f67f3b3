"""Merging tiles, exporting grids, mapping samples back to a grid, comparing datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mosaic(tiles: DataFrame, order: str = "file_order", keys: Sequence[str] = ("ix", "iy")) -> DataFrame:
    """One value per pixel; where tiles overlap, the later one wins."""
    return tiles.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def to_grid(values: DataFrame, legal: DataFrame, k: int = 1, scale: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Paste one value per sample into a k x k block of a grid ``scale`` times finer; the later sample wins."""
    placed = values.join(legal.select("sample_id", "bi", "bj"), "sample_id")
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    placed = placed.withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps))
    spots = placed.select(
        *keys,
        (F.floor(F.col("bi") * F.lit(float(scale))) + F.col("_di")).cast("int").alias("ix"),
        (F.floor(F.col("bj") * F.lit(float(scale))) + F.col("_dj")).cast("int").alias("iy"),
        "sample_id",
        "value",
    )
    return spots.groupBy(*keys, "ix", "iy").agg(F.max_by("value", "sample_id").alias("value"))


def dataset_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", eps: float = 1e-3) -> DataFrame:
    """Cells that differ by at least ``eps`` or exist on one side only: keys, a, b."""
    left = a.select(*keys, F.col(value).alias("a"), F.lit(True).alias("_ia"))
    right = b.select(*keys, F.col(value).alias("b"), F.lit(True).alias("_ib"))
    both = left.join(right, list(keys), "full_outer")
    equal = F.col("_ia") & F.col("_ib") & (F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) < eps))
    return both.filter(~F.coalesce(equal, F.lit(False))).select(*keys, "a", "b")


def diff_summary(diff: DataFrame, sample: Sequence[str]) -> DataFrame:
    """Number of differing cells and of samples that hold one."""
    per_sample = diff.groupBy(*sample).agg(F.count(F.lit(1)).alias("cells"))
    return per_sample.agg(
        F.coalesce(F.sum("cells"), F.lit(0)).alias("differing_cells"), F.count(F.lit(1)).alias("differing_samples")
    )
