"""Which pixels belong to which base cell, decided by arithmetic instead of a range join.

Along one axis a cell ``b`` owns the pixels ``floor((step*b + c0)/px) + o0 ... floor((step*b + c1)/px) + o1`` of a layer, with
everything but the offsets in coordinate units. Each pixel is exploded to the cells it belongs to: a few cells for layers
finer than the base, the cells it spans for coarser ones. Only layers whose pixels span very many cells are looked up
from the cell side instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.catalog import Layer, literal_array, literal_rows
from terraweft.functions.scalars import range_sql
from terraweft.functions.scale import lookup


MAX_FAN_OUT = 65_536


@dataclass(frozen=True)
class Span:
    """Pixel range of a cell along one axis."""

    step: float
    px: float
    delta: float
    c0: float
    c1: float
    o0: int = 0
    o1: int = 0


@dataclass(frozen=True)
class Footprint:
    """Pixel rectangle of a cell in one layer; ``wstep`` is the pixel step of resampled windows, ``wlast`` their last index."""

    layer: Layer
    x: Span
    y: Span
    wstep: float = 0.0
    wlast: int = 0

    @property
    def coarse(self) -> bool:
        """Whether one pixel spans too many cells to be exploded by one task."""
        return self.x.px * self.y.px > MAX_FAN_OUT * self.x.step * self.y.step

    def row(self) -> dict:
        row = {"layer_id": self.layer.layer_id, "wstep": self.wstep, "wlast": self.wlast}
        for axis, span in (("x", self.x), ("y", self.y)):
            row |= {f"{k}_{axis}": v for k, v in vars(span).items()}
        return row


def _axes(base: Layer, layer: Layer) -> list[tuple[float, float, float]]:
    """(step, px, delta) per axis: base position ``u`` has the layer index ``(step*u + delta)/px``."""
    return [(base.psh, layer.psh, base.ulh - layer.ulh), (base.psv, layer.psv, layer.ulv - base.ulv)]


def window_footprint(base: Layer, layer: Layer, size: int | None = None) -> Footprint:
    """Native window of ``size`` pixels around the centre of a cell."""
    size = size or layer.size_for(base)
    half = 0.5 if size % 2 == 0 else 0.0
    spans = []
    for step, px, delta in _axes(base, layer):
        c = step * 0.5 + delta + half * px
        spans.append(Span(step, px, delta, c, c, -(size // 2), size - 1 - size // 2))
    return Footprint(layer, *spans)


def sample_footprint(base: Layer, layer: Layer, first: float, last: float, reach: int = 0) -> Footprint:
    """Pixels between two positions given as fractions of the cell, widened by ``reach`` pixels."""
    spans = [
        Span(step, px, delta, step * first + delta, step * last + delta, -reach, reach)
        for step, px, delta in _axes(base, layer)
    ]
    return Footprint(layer, *spans)


def position(axis: str, cell: str) -> str:
    """SQL of the fractional layer index of a base position along one axis."""
    return f"((step_{axis} * ({cell}) + delta_{axis}) / px_{axis})"


def _edge(axis: str, cell: str, side: int) -> str:
    return f"(floor((step_{axis} * {cell} + c{side}_{axis}) / px_{axis}) + o{side}_{axis})"


def _cells_of(axis: str, pixel: str) -> str:
    """One row per cell whose range can hold a pixel, one cell wider than the algebra to absorb rounding."""
    low = f"greatest(ceil((({pixel} - o1_{axis}) * px_{axis} - c1_{axis}) / step_{axis}) - 1, 0)"
    high = f"ceil((({pixel} - o0_{axis} + 1) * px_{axis} - c0_{axis}) / step_{axis})"
    return range_sql(low, high)


def _layers_of(prints: Sequence[Footprint]) -> Column:
    return F.col("layer_id").isin([fp.layer.layer_id for fp in prints])


AXES = (("x", "bi", "ix"), ("y", "bj", "iy"))
ORIGINS = [f"int({_edge('x', 'bi', 0)}) AS x0", f"int({_edge('y', 'bj', 0)}) AS y0"]


def pixels_onto_cells(pixels: DataFrame, prints: Sequence[Footprint]) -> DataFrame:
    """One row per (cell, pixel of its footprint), found from the pixel side without a join on cells.

    Adds bi, bj, the first pixel x0, y0 of the footprint and its parameters.
    """
    params = F.broadcast(literal_rows(pixels.sparkSession, [fp.row() for fp in prints]))
    df = pixels.filter(_layers_of(prints)).join(params, "layer_id")
    for axis, cell, pixel in AXES:
        df = df.selectExpr("*", f"{_cells_of(axis, pixel)} AS {cell}")
        df = df.where(f"{_edge(axis, cell, 0)} <= {pixel} AND {pixel} <= {_edge(axis, cell, 1)}")
    return df.selectExpr("*", *ORIGINS)


def cells_onto_pixels(cells: DataFrame, pixels: DataFrame, prints: Sequence[Footprint]) -> DataFrame:
    """The same rows found from the cell side; for layers whose pixels span very many cells."""
    df = cells.select("*", F.inline(literal_array([fp.row() for fp in prints])))
    for axis, cell, pixel in AXES:
        df = df.selectExpr("*", f"{range_sql(_edge(axis, cell, 0), _edge(axis, cell, 1))} AS {pixel}")
    return lookup(df, pixels.filter(_layers_of(prints)), ["layer_id", "ix", "iy"]).selectExpr("*", *ORIGINS)


def gather(cells: DataFrame, pixels: DataFrame, prints: Sequence[Footprint]) -> DataFrame:
    """Pixels of the footprints of the given cells, which are unique on (bi, bj).

    Columns: those of ``cells``, layer_id, ix, iy, value, x0, y0 and the footprint parameters.
    """
    fine = [fp for fp in prints if not fp.coarse]
    coarse = [fp for fp in prints if fp.coarse]
    parts = []
    if fine:
        parts.append(pixels_onto_cells(pixels, fine).join(cells, ["bi", "bj"]))
    if coarse:
        parts.append(cells_onto_pixels(cells, pixels, coarse))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def base_cells(pixels: DataFrame, base: Layer, valid_only: bool = True) -> DataFrame:
    """Cells of the base grid with their target value; only cells that hold a value by default."""
    cells = pixels.filter(F.col("layer_id") == base.layer_id)
    if valid_only:
        cells = cells.filter(F.col("value").isNotNull())
    return cells.select(F.col("ix").alias("bi"), F.col("iy").alias("bj"), F.col("value").alias("y"))


def full_grid(spark, nx: int, ny: int) -> DataFrame:
    """Every cell of a grid, generated in parallel."""
    cell = F.col("id")
    return spark.range(nx * ny).select(F.floor(cell / ny).cast("int").alias("bi"), (cell % ny).cast("int").alias("bj"))
