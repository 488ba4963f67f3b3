"""Resampling layers around base cells: sub-grids, native windows, legality, blends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.catalog import Layer
from terraweft.functions.scalars import range_sql
from terraweft.functions.scale import bucket_rank
from terraweft.operators.footprint import (
    Footprint,
    base_cells,
    cells_onto_pixels,
    gather,
    pixels_onto_cells,
    position,
    sample_footprint,
    window_footprint,
)
from terraweft.session import cut_lineage

MASK_BITS = 62


def halo_steps(n: int, pad: int) -> tuple[float, float]:
    """First and last sub-pixel centre of a cell as fractions of the cell."""
    return (1 - 2 * pad) / (2 * n), (2 * (n + pad) - 1) / (2 * n)


def _owned_steps(axis: str, cell: str, pixel: str, n: int, pad: int) -> str:
    """One row per sub-pixel of a cell that may have its centre in a pixel; the caller tests it exactly."""

    def step_at(index: str) -> str:
        return f"ceil({n} * ((({index}) * px_{axis} - delta_{axis}) / step_{axis} - {cell}) - 0.5D)"

    low, high = f"{step_at(pixel)} - 1", step_at(f"{pixel} + 1")
    return range_sql(f"greatest({low}, {-pad})", f"least({high}, {n + pad - 1})")


def resample_nearest(
    cells: DataFrame, pixels: DataFrame, base: Layer, layers: Sequence[Layer], n: int, pad: int = 0
) -> DataFrame:
    """Every sub-pixel centre of a cell takes the pixel that contains it.

    Columns: those of ``cells`` plus si, sj, channel, value. A sub-pixel outside a layer has no row; nodata is NULL.
    Each pixel emits the sub-pixels it owns, so only pixels are shuffled, never sub-pixels.
    """
    first, last = halo_steps(n, pad)
    rows = gather(cells, pixels, [sample_footprint(base, layer, first, last) for layer in layers])
    for axis, cell, pixel, step in (("x", "bi", "ix", "si"), ("y", "bj", "iy", "sj")):
        rows = rows.selectExpr("*", f"{_owned_steps(axis, cell, pixel, n, pad)} AS {step}")
        rows = rows.where(f"floor({position(axis, f'{cell} + (2 * {step} + 1) / {2.0 * n}D')}) = {pixel}")
    return rows.selectExpr(*cells.columns, "si", "sj", "layer_id AS channel", "value")


def legal_cells(pixels: DataFrame, base: Layer, layers: Sequence[Layer]) -> DataFrame:
    """Base cells whose window holds no nodata and at least one pixel in every layer.

    One aggregation decides all layers: a bit per layer that contributed a pixel, and whether any pixel was bad.
    """
    others = [layer for layer in layers if layer.layer_id != base.layer_id]
    prints = [window_footprint(base, layer) for layer in others]
    cells = base_cells(pixels, base)
    fine = [fp for fp in prints if not fp.coarse]
    coarse = [fp for fp in prints if fp.coarse]
    cols = ["bi", "bj", "layer_id", "value"]
    rows = cells.select("bi", "bj", F.lit(base.layer_id).alias("layer_id"), F.col("y").alias("value"))
    if fine:
        rows = rows.unionByName(pixels_onto_cells(pixels, fine).select(*cols))
    if coarse:
        rows = rows.unionByName(cells_onto_pixels(cells.drop("y"), pixels, coarse).select(*cols))
    checks = [F.expr("max(value IS NULL) AS bad"), F.expr(f"max(layer_id = {base.layer_id}) AS is_cell")]
    legal = "NOT bad AND is_cell"
    for group in range(0, len(others), MASK_BITS):
        ids = [layer.layer_id for layer in others[group : group + MASK_BITS]]
        bits = " ".join(f"WHEN layer_id = {layer_id} THEN {1 << slot}L" for slot, layer_id in enumerate(ids))
        checks.append(F.expr(f"bit_or(CASE WHEN value IS NULL THEN 0L {bits} ELSE 0L END) AS mask_{group}"))
        legal += f" AND mask_{group} = {(1 << len(ids)) - 1}L"
    return rows.groupBy("bi", "bj").agg(*checks).where(legal).select("bi", "bj")


def number_samples(cells: DataFrame, block: int = 65_536) -> DataFrame:
    """Add sample_id, the 0-based rank in (bi, bj) order, without sorting everything in one task."""
    rows, strip = F.floor(F.col("bj") / block), F.floor(F.col("bi") / 4096)
    ranked = bucket_rank(cells, F.struct("bi", rows.alias("block")), [F.col("bi"), F.col("bj")], "sample_id", coarser=strip)
    return ranked.withColumn("sample_id", (F.col("sample_id") - 1).cast("bigint"))


def legal_samples(pixels: DataFrame, base: Layer, layers: Sequence[Layer]) -> DataFrame:
    """Legal cells with their sample ids: sample_id, bi, bj."""
    # numbering reads the cells twice, deciding them is the expensive part
    return number_samples(cut_lineage(legal_cells(pixels, base, layers))).select("sample_id", "bi", "bj")


def gather_windows(cells: DataFrame, pixels: DataFrame, base: Layer, layers: Sequence[Layer]) -> DataFrame:
    """Native windows around the given cells in long form: cell columns, layer_id, wi, wj, value.

    Pixels outside a layer have no row.
    """
    rows = gather(cells, pixels, [window_footprint(base, layer) for layer in layers])
    return rows.select(
        *cells.columns,
        "layer_id",
        (F.col("ix") - F.col("x0")).alias("wi"),
        (F.col("iy") - F.col("y0")).alias("wj"),
        "value",
    )


def _spread(base: Layer, layer: Layer, points: int) -> Footprint:
    """Footprint of the pixels that ``points`` positions spread over the native window can touch."""
    size = layer.size_for(base)
    if size == 1 or points == 1:
        return window_footprint(base, layer, 1)
    half = 0.5 if size % 2 == 0 else 0.0
    spans = []
    for span in (window_footprint(base, layer).x, window_footprint(base, layer).y):
        c = span.step * 0.5 + span.delta + (half - 0.5) * span.px
        spans.append(replace(span, c0=c, c1=c, o1=size - size // 2))
    return Footprint(layer, *spans, wstep=(2 * (size // 2 - half) + 1) / (points - 1), wlast=points - 1)


def resample_windows(
    cells: DataFrame, pixels: DataFrame, base: Layer, layers: Sequence[Layer], points: int | None = None
) -> DataFrame:
    """Windows of n x n values spread over the native window; one-pixel layers keep their pixel.

    n is the sample size of the layer, or ``points`` for layers without one.
    """
    sizes = [layer.sample_size or points for layer in layers]
    if None in sizes:
        raise ValueError("a layer without a sample size needs points")
    rows = gather(cells, pixels, [_spread(base, layer, size) for layer, size in zip(layers, sizes, strict=True)])
    for at, pixel, origin in (("wi", "ix", "x0"), ("wj", "iy", "y0")):
        low = f"if(wstep = 0, 0, greatest(floor(({pixel} - {origin}) / nullif(wstep, 0)) - 1, 0))"
        high = f"if(wstep = 0, 0, least(ceil(({pixel} - {origin} + 1) / nullif(wstep, 0)) + 1, wlast))"
        rows = rows.selectExpr("*", f"{range_sql(low, high)} AS {at}")
        rows = rows.where(f"floor({origin} + {at} * wstep) = {pixel}")
    return rows.select(*cells.columns, "layer_id", "wi", "wj", "value")


def resample_blend(
    cells: DataFrame,
    pixels: DataFrame,
    base: Layer,
    layers: Sequence[Layer],
    n: int,
    res: int,
    weights: str = "bilinear",
) -> DataFrame:
    """Blend of the four nearest pixels, and the containing pixel, at an n x n grid of ``res`` metres in each cell.

    Columns: cell columns, layer_id, gi, gj, blend, nearest. Weights are renormalised over the pixels that hold a value.
    """

    def at(k):
        return (base.res_m / 2 + (k + 0.5 - n / 2) * res) / base.res_m

    rows = gather(cells, pixels, [sample_footprint(base, layer, at(0), at(n - 1), reach=1) for layer in layers])
    # pixels are dealt to their cells before they are multiplied; the aggregation below keeps that partitioning
    rows = rows.filter(F.col("value").isNotNull()).repartition("bi", "bj")
    for axis, cell, pixel, g, d in (("x", "bi", "ix", "gi", "dx"), ("y", "bj", "iy", "gj", "dy")):
        offset = f"({base.res_m / 2}D + ({g} + 0.5D - {n / 2}D) * {res}) / {base.res_m}"
        rows = rows.selectExpr("*", f"{range_sql('0', str(n - 1))} AS {g}")
        rows = rows.selectExpr("*", f"{position(axis, f'{cell} + {offset}')} - {pixel} - 0.5D AS {d}")
        rows = rows.where(f"{d} > -1 AND {d} <= 1")
    wx, wy = 1 - F.abs("dx"), 1 - F.abs("dy")
    rows = rows.withColumn("w", wx * wy if weights == "bilinear" else wx * wx + wy * wy)
    own = (F.floor(F.col("dx") + 0.5) == 0) & (F.floor(F.col("dy") + 0.5) == 0)
    return (
        rows.groupBy(*cells.columns, "layer_id", "gi", "gj")
        .agg(
            F.sum(F.col("w") * F.col("value")).alias("_wv"),
            F.sum("w").alias("_w"),
            F.max(F.when(own, F.col("value"))).alias("nearest"),
        )
        .select(
            *cells.columns,
            "layer_id",
            "gi",
            "gj",
            F.when(F.col("_w") > 0, F.col("_wv") / F.col("_w")).alias("blend"),
            "nearest",
        )
    )
