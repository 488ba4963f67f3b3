"""Parquet datasets: layers, cubes, pyramids, splits, statistics, metrics, manifests and resumable stages."""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.catalog import Layer, literal_array, nodata_table
from terraweft.functions.scalars import null_nodata, range_sql
from terraweft.session import cut_lineage
from terraweft.sources.text import write_cube_text

NO_FOLD = -1
#: Side of a block of pixels, in pixels; and of a tile of cells that blocks are looked up for, in cells.
BLOCK, TILE = 1024, 64
#: Blocks that a read names one by one.
MOST_BLOCKS = 20_000


def clean_pixels(pixels: DataFrame, layers: DataFrame) -> DataFrame:
    """Pixel table with nodata and NaN as NULL."""
    joined = pixels.join(nodata_table(layers), "layer_id")
    return joined.select("layer_id", "ix", "iy", null_nodata(F.col("value"), F.col("nodata")).alias("value"))


def read_layers(
    spark: SparkSession,
    path: str,
    only: Sequence[int] | None = None,
    exclude: Sequence[int] | None = None,
    cells: DataFrame | None = None,
    base: Layer | None = None,
    halo: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(catalog, pixels) of a raster dataset; unwanted layers are pruned by partition.

    With ``cells`` (bi, bj of ``base``) only the blocks are read that windows around these cells, ``halo`` cells wide on each side, can touch.
    """
    layers = spark.read.parquet(f"{path}/layers")
    pixels = spark.read.parquet(f"{path}/pixels")
    if only is not None:
        layers, pixels = (t.filter(F.col("layer_id").isin(list(only))) for t in (layers, pixels))
    if exclude is not None:
        layers, pixels = (t.filter(~F.col("layer_id").isin(list(exclude))) for t in (layers, pixels))
    if cells is not None:
        pixels = pixels.filter(_touched(cells, base, layers, halo))
    layers = layers.drop("block")
    return layers, clean_pixels(pixels, layers)


def needed_blocks(cells: DataFrame, base: Layer, layers: DataFrame, halo: int = 1) -> DataFrame:
    """Blocks of every layer (with its ``block`` side) that windows around the cells can touch: layer_id, bx, by.

    Cells are gathered in tiles first; a tile stands for its box, so a few blocks too many may be named, never one too few.
    """
    tiles = cells.groupBy(F.floor(F.col("bi") / TILE).alias("_ti"), F.floor(F.col("bj") / TILE).alias("_tj")).agg(
        F.min("bi").alias("x0"), F.max("bi").alias("x1"), F.min("bj").alias("y0"), F.max("bj").alias("y1")
    )
    table = layers.select("layer_id", "res_m", "ulh", "ulv", "psh", "psv", "block").collect()  # a row per layer
    # side of a native window, in pixels
    side = f"(if(res_m = {base.res_m}, 1, {base.res_m} div res_m + 1) + 1)"

    def span(axis: str, origin: str, size: float, px: str) -> str:
        low = f"floor(({origin} + ({axis}0 - {halo}) * {size!r}D) / {px}) - {side}"
        high = f"floor(({origin} + ({axis}1 + 1 + {halo}) * {size!r}D) / {px}) + {side}"
        return range_sql(f"floor(({low}) / block)", f"floor(({high}) / block)")

    met = tiles.withColumn("_l", F.explode(literal_array([row.asDict() for row in table]))).select("x0", "x1", "y0", "y1", "_l.*")
    met = met.selectExpr("*", f"{span('x', f'({base.ulh!r}D - ulh)', base.psh, 'psh')} AS bx")
    met = met.selectExpr("*", f"{span('y', f'(ulv - {base.ulv!r}D)', base.psv, 'psv')} AS `by`")
    return met.select("layer_id", "bx", "by").distinct()


def _touched(cells: DataFrame, base: Layer, layers: DataFrame, halo: int) -> Column:
    """Condition on the partition columns: the blocks by name, or a box per layer where there are too many to name."""
    needed = cut_lineage(needed_blocks(cells, base, layers, halo))
    rows = needed.limit(MOST_BLOCKS + 1).collect()
    if len(rows) <= MOST_BLOCKS:
        return F.concat_ws("_", "layer_id", "bx", "by").isin([f"{r['layer_id']}_{r['bx']}_{r['by']}" for r in rows])
    boxes = needed.groupBy("layer_id").agg(F.min("bx").alias("a"), F.max("bx").alias("b"), F.min("by").alias("c"), F.max("by").alias("d")).collect()
    inside = [(F.col("layer_id") == r["layer_id"]) & F.col("bx").between(r["a"], r["b"]) & F.col("by").between(r["c"], r["d"]) for r in boxes]
    return functools.reduce(operator.or_, inside)


def write_layers(layers: DataFrame, pixels: DataFrame, path: str, block: int = BLOCK, mode: str = "errorifexists") -> None:
    """Raster dataset: a catalog and a pixel table partitioned by layer and by blocks of ``block`` x ``block`` pixels."""
    layers.withColumn("block", F.lit(block)).coalesce(1).write.mode(mode).parquet(f"{path}/layers")
    _blocked(pixels, block).write.mode(mode).partitionBy("layer_id", "bx", "by").parquet(f"{path}/pixels")


def _blocked(pixels: DataFrame, block: int) -> DataFrame:
    spots = {"bx": F.floor(F.col("ix") / block).cast("int"), "by": F.floor(F.col("iy") / block).cast("int")}
    blocked = pixels.withColumns(spots)
    return blocked.repartitionByRange("layer_id", "bx", "by").sortWithinPartitions("layer_id", "bx", "by", "ix", "iy")


def write_layer(values: DataFrame, row: DataFrame, path: str) -> None:
    """Add one grid (ix, iy, value; NULL becomes the nodata value) and its catalog row to a raster dataset.

    Writing a layer again replaces its pixels, so a retried job leaves one copy; a layer id with another catalog row is refused.
    """
    spark, meta = row.sparkSession, row.first()
    stored = values.select(F.lit(meta["layer_id"]).alias("layer_id"), "ix", "iy", F.coalesce("value", F.lit(meta["nodata"])).alias("value"))
    known = _catalog_rows(row, f"{path}/layers", meta["layer_id"])
    if any(k != meta for k in known):
        raise ValueError(f"layer {meta['layer_id']} is already in {path} with another catalog row")
    try:
        found = spark.read.parquet(f"{path}/layers").select("block").first()
    except AnalysisException:
        found = None
    block = found["block"] if found else BLOCK
    # blocks that the layer had before and has no more go with the folder
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pixels/layer_id={meta['layer_id']}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _blocked(stored, block).write.mode("append").partitionBy("layer_id", "bx", "by").parquet(f"{path}/pixels")
    if not known:
        row.withColumn("block", F.lit(block)).coalesce(1).write.mode("append").parquet(f"{path}/layers")


def _catalog_rows(row: DataFrame, path: str, layer_id: int) -> list:
    """Catalog rows of a layer that a dataset holds already."""
    try:
        layers = row.sparkSession.read.schema(row.schema).parquet(path)
    except AnalysisException:
        return []
    return layers.filter(F.col("layer_id") == layer_id).limit(2).collect()


def write_cubes(
    df: DataFrame,
    index: DataFrame,
    path: str,
    rows_per_file: int = 1_000_000,
    mode: str = "errorifexists",
    also_text: str | None = None,
) -> None:
    """Cube rows, spread by sample in files of bounded size, and the sample index, which is always written.

    ``also_text`` names a layout ("hwc" or "chw") in which the cubes (si, sj, channel, value) are written as text beside them.
    """
    spread = df.repartition("sample_id").sortWithinPartitions("sample_id")
    spread.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/cube")
    index.write.mode(mode).parquet(f"{path}/index")
    if also_text:
        write_cube_text(df.select("sample_id", "si", "sj", "channel", "value"), f"{path}/text", also_text)


def read_cubes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cube, index) of a cube dataset."""
    return spark.read.parquet(f"{path}/cube"), spark.read.parquet(f"{path}/index")


def write_pyramid(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Pyramid rows (sample_id, layer_id, vals), one folder per layer, clustered by sample."""
    keys = ["layer_id", F.col("sample_id")]
    spread = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    spread.sortWithinPartitions("layer_id", "sample_id").write.mode(mode).partitionBy("layer_id").parquet(path)


def read_pyramid(spark: SparkSession, path: str, layers: Sequence[int] | None = None) -> DataFrame:
    """Pyramid rows, of the given layers only."""
    df = spark.read.parquet(path)
    return df if layers is None else df.filter(F.col("layer_id").isin(list(layers)))


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Split table partitioned by fold and role; rows without fold go to their own partition."""
    stored = df.select("sample_id", F.coalesce("fold", F.lit(NO_FOLD)).alias("fold"), "role")
    stored.write.mode(mode).partitionBy("fold", "role").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Split table: sample_id, fold, role."""
    df = spark.read.parquet(path)
    fold = F.when(F.col("fold") != NO_FOLD, F.col("fold").cast("int"))
    return df.select("sample_id", fold.alias("fold"), "role")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Statistics, legal ids or metrics as one Parquet table."""
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)



def write_manifest(spark: SparkSession, path: str, mode: str = "errorifexists", **params) -> None:
    """All parameters of a run as one JSON row."""
    row = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in params.items()}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in sorted(row.items())]).coalesce(1).write.mode(mode).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


class Stage:
    """One resumable step of a build whose output is a table.

    Every build goes to a folder of its own below ``path``; the marker beside it names the folder that is complete and is written last.
    A build that fails, also under ``override``, leaves the marker and the output it names as they were.
    """

    def __init__(self, spark: SparkSession, path: str, override: bool = False):
        self.spark = spark
        self.path = path
        self.override = override

    @property
    def marker(self) -> str:
        return f"{self.path}.complete"

    def version(self) -> str | None:
        """Folder of the complete output, if there is one."""
        try:
            row = self.spark.read.schema("version STRING").parquet(self.marker).first()
        except AnalysisException:
            return None
        return row["version"] if row else None

    def done(self) -> bool:
        return self.version() is not None

    def run_or_load(self, build: Callable[[], DataFrame]) -> DataFrame:
        """Load the output if it is complete, else build and write it. ``override`` always rebuilds."""
        version = None if self.override else self.version()
        if version is None:
            version = f"build-{uuid.uuid4().hex[:12]}"
            build().write.parquet(f"{self.path}/{version}")
            self.spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(self.marker)
        return self.spark.read.parquet(f"{self.path}/{version}")
