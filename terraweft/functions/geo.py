"""Affine arithmetic on columns. y runs downward: ``cy = ulv - iy * psv``."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Affine(NamedTuple):
    """Upper-left corner and pixel size; the fields are floats or columns."""

    ulh: float | Column
    ulv: float | Column
    psh: float | Column
    psv: float | Column


def geo_to_index(cx: Column, cy: Column, gt: Affine) -> tuple[Column, Column]:
    """Fractional (ix, iy) of a coordinate."""
    return (cx - gt.ulh) / gt.psh, (F.lit(gt.ulv) - cy) / gt.psv


def geo_to_cell(cx: Column, cy: Column, gt: Affine, rounding: str = "floor") -> tuple[Column, Column]:
    """Pixel that contains a coordinate.

    ``floor`` puts coordinates left of or above the origin outside the grid; ``trunc`` pulls them into cell 0.
    """
    fx, fy = geo_to_index(cx, cy, gt)
    if rounding == "trunc":
        return fx.cast("int"), fy.cast("int")
    return F.floor(fx).cast("int"), F.floor(fy).cast("int")


def index_to_geo(ix: Column, iy: Column, gt: Affine, mode: str = "ul") -> tuple[Column, Column]:
    """Coordinate of a pixel index: its upper-left corner (``ul``) or its centre (``ctr``)."""
    half = 0.5 if mode == "ctr" else 0.0
    return F.lit(gt.ulh) + (ix + half) * gt.psh, F.lit(gt.ulv) - (iy + half) * gt.psv


def sqdist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared planar distance, in squared coordinate units."""
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def _covered(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def overlap_fraction(gt1: Affine, idx1: tuple, gt2: Affine, idx2: tuple) -> Column:
    """Share of cell ``idx2`` of grid 2 that cell ``idx1`` of grid 1 covers."""
    x1, y1 = index_to_geo(F.lit(idx1[0]), F.lit(idx1[1]), gt1)
    x2, y2 = index_to_geo(F.lit(idx2[0]), F.lit(idx2[1]), gt2)
    wide = _covered(x1, x1 + gt1.psh, x2, x2 + gt2.psh)
    high = _covered(y1 - gt1.psv, y1, y2 - gt2.psv, y2)
    return wide * high / (F.lit(gt2.psh) * gt2.psv)


def in_bounds(fx: Column, fy: Column, nx: Column | int, ny: Column | int) -> Column:
    """Whether a fractional index lies inside a grid of nx by ny pixels."""
    return (fx >= 0) & (fy >= 0) & (fx < nx) & (fy < ny)


def subpixel_grid(df: DataFrame, n: int, pad: int = 0) -> DataFrame:
    """One row per sub-pixel of every cell, with ``pad`` extra rings around it: adds si, sj, ox, oy."""
    steps = f"explode(sequence({-pad}, {n + pad - 1}))"
    centres = [f"(2 * {s} + 1) / {2.0 * n}D AS {o}" for s, o in (("si", "ox"), ("sj", "oy"))]
    return df.selectExpr("*", f"{steps} AS si").selectExpr("*", f"{steps} AS sj").selectExpr("*", *centres)


def expected_size(base_res: Column | int, res: Column | int) -> Column:
    """Side of the native window that covers one base cell."""
    base, own = (F.lit(base_res) if isinstance(base_res, int) else base_res), F.lit(res) if isinstance(res, int) else res
    return F.when(base == own, F.lit(1)).otherwise(F.floor(base / own).cast("int") + 1)


def window_origin(t: Column, size: Column) -> Column:
    """First index of a window of ``size`` pixels around the fractional index ``t``."""
    half = F.when(size % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return (F.floor(t + half) - F.floor(size / 2)).cast("int")


def equalize_params(layers: DataFrame, native: str = "native", sample: str = "sample") -> DataFrame:
    """Scale the sample sizes of the x layers so that they hold as many values as the native windows."""
    total = layers.filter("role = 'x'").agg(
        F.sqrt(F.sum(F.col(native) * F.col(native)) / F.sum(F.col(sample) * F.col(sample))).alias("_ratio")
    )
    scaled = F.when(F.col("role") == "x", F.floor(F.col(sample) * F.col("_ratio")).cast("int")).otherwise(F.col(sample))
    return layers.withColumn("_ratio", total.scalar()).withColumn("adjusted", scaled).drop("_ratio")


def unravel(flat: Column, ncols: int | Column) -> tuple[Column, Column]:
    """Flat id to (row, column)."""
    return F.floor(flat / ncols).cast("bigint"), (flat % ncols).cast("bigint")


def ravel(row: Column, col: Column, ncols: int | Column) -> Column:
    """(row, column) to flat id."""
    return row * ncols + col


def rescale_affine(gt: Affine, old_res: float | Column, new_res: float | Column) -> Affine:
    """Same corner, pixel size for a new resolution."""
    ratio = F.lit(new_res) / F.lit(old_res)
    return Affine(gt.ulh, gt.ulv, F.lit(gt.psh) * ratio, F.lit(gt.psv) * ratio)


def halo_width(base_res: int, res: int) -> int:
    """Pixels of fill around a layer that is not the base."""
    return base_res // (2 * res) + 1


def native_size(base_res: int, res: int) -> int:
    """Driver-side twin of ``expected_size`` for catalog rows."""
    return 1 if base_res == res else math.floor(base_res / res) + 1
