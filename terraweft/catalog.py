"""Layer catalog: a short table of affine georeferences, kept on the driver as plain rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.functions.geo import Affine, native_size

MAX_LAYERS = 5_000


@dataclass(frozen=True)
class Layer:
    """One row of the catalog."""

    layer_id: int
    name: str
    role: str
    res_m: int
    ulh: float
    ulv: float
    psh: float
    psv: float
    nodata: float | None
    nx: int | None = None
    ny: int | None = None
    #: side of the resampled window, for layers that have a size of their own
    sample_size: int | None = None

    @property
    def affine(self) -> Affine:
        return Affine(self.ulh, self.ulv, self.psh, self.psv)

    def size_for(self, base: Layer) -> int:
        """Side of the native window of this layer around one cell of ``base``."""
        return native_size(base.res_m, self.res_m)

    def ratio(self, base: Layer) -> tuple[float, float]:
        """Pixels of this layer per cell of ``base``, on both axes."""
        return base.psh / self.psh, base.psv / self.psv

    def is_coarse(self, base: Layer) -> bool:
        """Whether one pixel of this layer spans more than one cell of ``base``."""
        rx, ry = self.ratio(base)
        return rx * ry < 1.0


class Catalog(list[Layer]):
    """The layers of one dataset in layer_id order."""

    @classmethod
    def of(cls, layers: DataFrame) -> Catalog:
        """Read a catalog table; a table that is not metadata-sized is refused."""
        rows = layers.limit(MAX_LAYERS + 1).collect()
        if len(rows) > MAX_LAYERS:
            raise ValueError(f"a catalog holds at most {MAX_LAYERS} layers")
        fields = Layer.__dataclass_fields__
        known = [Layer(**{k: v for k, v in row.asDict().items() if k in fields}) for row in rows]
        return cls(sorted(known, key=lambda layer: layer.layer_id))

    def by_name(self, name: str) -> Layer:
        return next(layer for layer in self if layer.name == name)

    def only(self, ids: Iterable[int]) -> Catalog:
        wanted = set(ids)
        return Catalog(layer for layer in self if layer.layer_id in wanted)

    def without(self, ids: Iterable[int]) -> Catalog:
        """Exclude layers."""
        dropped = set(ids)
        return Catalog(layer for layer in self if layer.layer_id not in dropped)

    def ids(self) -> list[int]:
        return [layer.layer_id for layer in self]

    def table(self, spark: SparkSession) -> DataFrame:
        """The catalog as a DataFrame; sample sizes are a column when any layer has one."""
        sized = any(layer.sample_size is not None for layer in self)
        return literal_rows(spark, [{k: v for k, v in vars(layer).items() if sized or k != "sample_size"} for layer in self])

    def with_sample_sizes(self, sizes: dict[int, int]) -> Catalog:
        """The same layers with their own window sizes, by layer_id."""
        return Catalog(replace(layer, sample_size=sizes.get(layer.layer_id, layer.sample_size)) for layer in self)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_array(rows: Sequence[dict]) -> Column:
    """Rows known to the driver as one array-of-structs literal."""
    structs = (", ".join(f"{_literal(v)} AS {k}" for k, v in row.items()) for row in rows)
    return F.expr("array(" + ", ".join(f"struct({s})" for s in structs) + ")")


def literal_rows(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Rows known to the driver as a DataFrame."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row.values()) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(rows[0])})")


def nodata_table(layers: DataFrame) -> DataFrame:
    """layer_id and nodata of a catalog table of any length."""
    return layers.select("layer_id", "nodata")


def grid_extent(pixels: DataFrame) -> DataFrame:
    """Width and height of every layer, from its pixels."""
    return pixels.groupBy("layer_id").agg((F.max("ix") + 1).alias("nx"), (F.max("iy") + 1).alias("ny"))


def with_extent(layers: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add nx and ny to a catalog table that lacks them."""
    return layers.join(grid_extent(pixels), "layer_id", "left")


def channel_names(layers: Sequence[Layer], fields: Sequence[str], spark: SparkSession) -> DataFrame:
    """Channel order of a cube: the layers, then the point fields, the nearest point and its distance."""
    names = [layer.name for layer in layers] + list(fields) + ["nearest_id", "nearest_d2"]
    return literal_rows(spark, [{"channel": i, "name": name} for i, name in enumerate(names)])
