"""Aggregating a layer onto the cells of another grid: mean, mode, median, area weights, point sampling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.catalog import Layer
from terraweft.operators.footprint import (
    Footprint,
    Span,
    cells_onto_pixels,
    full_grid,
    pixels_onto_cells,
    position,
    sample_footprint,
)

NO_DATA_FOUND = -99999.0


def target_grid(base: Layer, res: int) -> Layer:
    """Grid of another resolution over the extent of the base layer."""
    scale = res / base.res_m
    return replace(
        base,
        res_m=res,
        psh=base.psh * scale,
        psv=base.psv * scale,
        nx=base.nx * base.res_m // res + 1,
        ny=base.ny * base.res_m // res + 1,
    )


def _counts(axis: str, cell: str, pixel: str, m: int, f: int, offsets: str) -> str:
    """SQL of how many of the m sub-samples of a cell fall into a pixel along one axis."""
    x0 = position(axis, cell)
    if offsets == "floor":
        first = f"{f} * ({pixel} - floor({x0}))"
        last = f"{first} + {f - 1}"
    else:
        first = f"ceil({f} * ({pixel} - {x0}) - 0.5D)"
        last = f"ceil({f} * ({pixel} + 1 - {x0}) - 0.5D) - 1"
    return f"greatest(least({last}, {m - 1}) - greatest({first}, 0) + 1, 0)"


def _covered(axis: str, cell: str, pixel: str) -> str:
    """SQL of the length of a pixel, in pixels, that a cell covers along one axis."""
    low, high = position(axis, cell), position(axis, f"{cell} + 1")
    return f"greatest(least({high}, {pixel} + 1D) - greatest({low}, {pixel} + 0D), 0D)"


def subsamples(target: Layer, layer: Layer, step: int) -> tuple[int, int]:
    """(sub-samples per cell side, sub-samples per native pixel side)."""
    return max(target.res_m // step, 1), max(layer.res_m // step, 1)


def _print_for(target: Layer, layer: Layer, m: int, f: int, offsets: str, weighted: bool) -> Footprint:
    if weighted:
        return sample_footprint(target, layer, 0.0, 1.0)
    corner = sample_footprint(target, layer, 0.0, 0.0)

    def widen(span: Span) -> Span:
        if offsets == "floor":
            return replace(span, o1=(m - 1) // f)
        return replace(span, c0=span.delta + span.px / (2 * f), c1=span.delta + span.px * (2 * m - 1) / (2 * f))

    return replace(corner, x=widen(corner.x), y=widen(corner.y))


def align_agg(
    pixels: DataFrame,
    target: Layer,
    layer: Layer,
    fn: str = "mean",
    step: int = 10,
    offsets: str = "spread",
    weighted: bool = False,
) -> DataFrame:
    """Aggregate a layer onto the target grid: bi, bj, value for every cell that meets at least one value.

    Each cell takes m x m sub-samples; a pixel knows by arithmetic how many of them it receives, so pixels are weighted
    and aggregated directly, with neither sub-sample rows nor a join. ``weighted`` uses the covered area instead.
    """
    m, f = subsamples(target, layer, step)
    prints = [_print_for(target, layer, m, f, offsets, weighted)]
    known = pixels.filter(F.col("value").isNotNull())
    if prints[0].coarse:
        rows = cells_onto_pixels(full_grid(pixels.sparkSession, target.nx, target.ny), known, prints)
    else:
        rows = pixels_onto_cells(known, prints).filter((F.col("bi") < target.nx) & (F.col("bj") < target.ny))
    if weighted:
        w = f"{_covered('x', 'bi', 'ix')} * {_covered('y', 'bj', 'iy')}"
    else:
        w = f"{_counts('x', 'bi', 'ix', m, f, offsets)} * {_counts('y', 'bj', 'iy', m, f, offsets)}"
    rows = rows.selectExpr("bi", "bj", "value", f"{w} AS w").where("w > 0")
    if fn == "mean":
        mean = F.sum(F.col("w") * F.col("value")) / F.sum("w")
        return rows.groupBy("bi", "bj").agg(mean.alias("value"))
    if fn == "median":
        return rows.groupBy("bi", "bj").agg(F.percentile("value", 0.5, F.col("w").cast("bigint")).alias("value"))
    if fn == "mode":
        return weighted_mode(rows, ["bi", "bj"], "value", "w")
    raise ValueError(f"unknown aggregate {fn}")


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    tally = rows.groupBy(*keys, value).agg(amount.alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col(value)).alias("_neg")))
    return tally.groupBy(*keys).agg(best.alias("_best")).select(*keys, (-F.col("_best._neg")).alias(value))


def fill_grid(values: DataFrame, target: Layer, empty: float | None = NO_DATA_FOUND) -> DataFrame:
    """One row per cell of the target grid; cells without data get ``empty``."""
    grid = full_grid(values.sparkSession, target.nx, target.ny)
    out = grid.join(values, ["bi", "bj"], "left")
    return out if empty is None else out.fillna({"value": empty})


def align_sample(pixels: DataFrame, target: Layer, layer: Layer, mode: str = "ul") -> DataFrame:
    """The pixel under the upper-left corner or the centre of every target cell: bi, bj, value."""
    at = 0.5 if mode == "ctr" else 0.0
    prints = [sample_footprint(target, layer, at, at)]
    if prints[0].coarse:
        rows = cells_onto_pixels(full_grid(pixels.sparkSession, target.nx, target.ny), pixels, prints)
    else:
        rows = pixels_onto_cells(pixels, prints).filter((F.col("bi") < target.nx) & (F.col("bj") < target.ny))
    return rows.select("bi", "bj", "value")


def align_report(pixels: DataFrame, target: Layer, layer: Layer, step: int = 10) -> DataFrame:
    """Cells of the target grid, cells without data, and sub-samples that fall outside the layer."""
    m, f = subsamples(target, layer, step)
    spark = pixels.sparkSession

    def inside(axis: str, count: int, width: int) -> Column:
        span = getattr(sample_footprint(target, layer, 0.0, 0.0), axis)
        k = F.sequence(F.lit(0), F.lit(m - 1))
        x0 = (F.lit(span.step) * F.col("id") + span.delta) / span.px
        hit = F.filter(k, lambda i: (x0 + (2 * i + 1) / F.lit(2.0 * f) >= 0) & (x0 + (2 * i + 1) / F.lit(2.0 * f) < width))
        return spark.range(count).agg(F.sum(F.size(hit)).alias("n")).scalar()

    total = target.nx * target.ny
    filled = align_agg(pixels, target, layer, "mean", step).agg(F.count(F.lit(1)).alias("n"))
    return filled.select(
        F.lit(total).cast("bigint").alias("cells"),
        (F.lit(total) - F.col("n")).cast("bigint").alias("empty_cells"),
        (F.lit(total * m * m) - inside("x", target.nx, layer.nx) * inside("y", target.ny, layer.ny))
        .cast("bigint")
        .alias("outside_samples"),
    )
