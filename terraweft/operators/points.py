"""Raster values and neighbourhoods at points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.catalog import Layer, literal_array
from terraweft.functions.geo import Affine, geo_to_cell
from terraweft.functions.scale import lookup, salted_join

# The four 3 x 3 direction kernels, indexed [x offset + 1][y offset + 1].
KERNELS = (
    ((1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (-1.0, -1.0, -1.0)),
    ((0.0, 1.0, 1.4), (-1.0, 0.0, 1.0), (-1.4, -1.0, 0.0)),
    ((-1.0, 0.0, 1.0), (-1.0, 0.0, 1.0), (-1.0, 0.0, 1.0)),
    ((-1.4, -1.0, 0.0), (-1.0, 0.0, 1.0), (0.0, 1.0, 1.4)),
)


def point_cells(points: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """Pixel of every point in every layer: point_id, layer_id, ix, iy."""
    rows = [{k: getattr(layer, k) for k in ("layer_id", "ulh", "ulv", "psh", "psv")} for layer in layers]
    each = points.select("point_id", "lon", "lat", F.inline(literal_array(rows)))
    gt = Affine(*[F.col(c) for c in ("ulh", "ulv", "psh", "psv")])
    ix, iy = geo_to_cell(F.col("lon"), F.col("lat"), gt)
    return each.select("point_id", "layer_id", ix.alias("ix"), iy.alias("iy"))


def sample_at_points(points: DataFrame, pixels: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """Value of the containing pixel per point and layer: point_id, layer_id, value (NULL outside)."""
    found = lookup(point_cells(points, layers), pixels, ["layer_id", "ix", "iy"], "left")
    return found.select("point_id", "layer_id", "value")


def paired_at_points(points: DataFrame, pixels: DataFrame, a: Layer, b: Layer) -> DataFrame:
    """Values of two layers side by side at every point."""
    both = sample_at_points(points, pixels, [a, b])
    return both.groupBy("point_id").agg(
        F.max(F.when(F.col("layer_id") == a.layer_id, F.col("value"))).alias("a"),
        F.max(F.when(F.col("layer_id") == b.layer_id, F.col("value"))).alias("b"),
    )


def _around(cells: DataFrame, pixels: DataFrame, layer: Layer, r: int) -> DataFrame:
    """Pixels within r of distinct cells: ix, iy (the cell), dx, dy, value."""
    steps = F.sequence(F.lit(-r), F.lit(r))
    near = cells.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    keyed = near.select("ix", "iy", "dx", "dy", (F.col("ix") + F.col("dx")).alias("nx"), (F.col("iy") + F.col("dy")).alias("ny"))
    own = pixels.filter((F.col("layer_id") == layer.layer_id) & F.col("value").isNotNull())
    return keyed.join(own.select(F.col("ix").alias("nx"), F.col("iy").alias("ny"), "value"), ["nx", "ny"])


def neighborhood(points: DataFrame, pixels: DataFrame, layer: Layer, r: int = 1) -> DataFrame:
    """Values of the pixels within r of each point's pixel: point_id, dx, dy, value; missing pixels are skipped.

    Neighbourhoods are built once per distinct pixel and then handed to its points.
    """
    cells = point_cells(points, [layer]).select("point_id", "ix", "iy")
    blocks = _around(cells.select("ix", "iy").distinct(), pixels, layer, r)
    return salted_join(cells, blocks, ["ix", "iy"]).select("point_id", "dx", "dy", "value")


def _per_pixel(points: DataFrame, pixels: DataFrame, layer: Layer, aggs: Sequence[Column]) -> DataFrame:
    """Aggregate the 3 x 3 neighbourhood of every distinct pixel and hand the result to its points."""
    cells = point_cells(points, [layer]).select("point_id", "ix", "iy")
    blocks = _around(cells.select("ix", "iy").distinct(), pixels, layer, 1)
    return salted_join(cells, blocks.groupBy("ix", "iy").agg(*aggs), ["ix", "iy"])


def dominant_direction(points: DataFrame, pixels: DataFrame, layer: Layer, wrap: bool = False) -> DataFrame:
    """Kernel with the strongest absolute response at each point, signed by the response (0 if none).

    ``wrap`` indexes the kernels with the raw offsets, so that -1 means the last row or column.
    """

    def weight(kernel) -> Column:
        pick = F.lit(0.0)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                w = kernel[dx][dy] if wrap else kernel[dx + 1][dy + 1]
                pick = F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.lit(w)).otherwise(pick)
        return pick

    sums = [F.sum(weight(k) * F.col("value")).alias(f"r{i}") for i, k in enumerate(KERNELS, 1)]
    rows = _per_pixel(points, pixels, layer, sums)
    best = F.greatest(*[F.abs(f"r{i}") for i in range(1, 5)])
    pick = F.lit(0)
    for i in range(4, 0, -1):
        pick = F.when(F.abs(f"r{i}") == best, (F.signum(f"r{i}") * i).cast("int")).otherwise(pick)
    return rows.select("point_id", pick.alias("direction"))


def flatness(points: DataFrame, pixels: DataFrame, layer: Layer) -> DataFrame:
    """Sum of absolute differences between a point's pixel and its neighbours; NULL if its own pixel is unknown."""
    centre = F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("value"))).alias("centre")
    rows = _per_pixel(points, pixels, layer, [centre, F.collect_list("value").alias("near")])
    total = F.aggregate("near", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("centre")))
    return rows.select("point_id", total.alias("flatness"))
