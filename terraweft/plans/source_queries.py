"""Text inputs, manifests and resumable stages, on files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweft.operators.footprint import base_cells
from terraweft.plans.raster_queries import legal_of
from terraweft.plans.registry import query
from terraweft.session import scratch_path
from terraweft.sources import datasets, text

FIELDS = ["lon", "lat", "cover_z_0"]


def _point_file(fx) -> str:
    path = scratch_path(fx.spark, "points")
    broken = F.when(F.col("point_id") % 101 == 3, F.lit("n/a")).otherwise(F.col("cover_z_0").cast("string"))
    text.write_points(fx.points.withColumn("cover_z_0", broken), path, FIELDS)
    return path


@query("s2_read_points", "SELECT lon, lat, cover_z_0 FROM fx_points WHERE point_id % 101 <> 3")
def _(fx):
    return text.read_points(fx.spark, _point_file(fx), FIELDS)


@query("s2_bad_rows", "SELECT count(*) AS dropped FROM fx_points WHERE point_id % 101 = 3")
def _(fx):
    return text.read_points(fx.spark, _point_file(fx), FIELDS, bad_rows=True).agg(F.count(F.lit(1)).alias("dropped"))


@query(
    "s3_read_field_map",
    """SELECT CAST(p_partkey AS INT) AS key, 0 AS file, p_size AS keyword, CAST(p_partkey % 7 AS INT) AS field, CAST(p_partkey % 3 AS INT)
       AS position FROM part""",
)
def _(fx):
    path = scratch_path(fx.spark, "field_map")
    line = F.expr("concat(p_partkey, ':0,', p_size, ',', p_partkey % 7, ',', p_partkey % 3)")
    fx.table("part").select(line.alias("value")).write.text(path)
    return text.read_field_map(fx.spark, path)


@query("s4_read_names", "SELECT p_name AS name FROM part")
def _(fx):
    path = scratch_path(fx.spark, "names")
    fx.table("part").select(F.concat("p_name", F.lit(",")).alias("value")).write.text(path)
    return text.read_names(fx.spark, path)


@query("s6_index_text", "SELECT o_orderkey AS sample_id, o_custkey AS other_id FROM orders")
def _(fx):
    path = scratch_path(fx.spark, "index")
    ids = fx.table("orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("other_id"))
    text.write_index_text(ids, path, ["sample_id", "other_id"])
    return text.read_index_text(fx.spark, path, ["sample_id", "other_id"])


# each tile is a cube of 8 x 8 pixels with two channels: the value and its double
CUBE = """SELECT tile_id, r AS si, c AS sj, CAST(k AS INT) AS channel, value * (k + 1) AS value FROM fx_tiles, (VALUES (0),(1)) AS v(k)"""


def _text_cube(fx, layout: str):
    path = scratch_path(fx.spark, f"cube_{layout}")
    both = F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("value")), F.struct(F.lit(1).alias("channel"), (F.col("value") * 2).alias("value"))))
    cube = fx.tiles.select("tile_id", F.col("r").alias("si"), F.col("c").alias("sj"), both.alias("_e"))
    cube = cube.select("tile_id", "si", "sj", "_e.channel", "_e.value")
    text.write_cube_text(cube, path, layout, key="tile_id")
    return text.read_cube_text(fx.spark, path, layout, key="tile_id").drop("file")


@query("s5_read_cube_text_hwc", CUBE)
def _(fx):
    return _text_cube(fx, "hwc")


@query("s5_read_cube_text_chw", CUBE)
def _(fx):
    return _text_cube(fx, "chw")


@query(
    "p25_parse_info",
    """SELECT CAST(nx AS INT) AS size, role, layer_id AS idx, name, 5 AS folds, -999 AS buffer_fill, 'EPSG4326' AS crs, CAST(NULL AS BIGINT)
       AS seed FROM fx_layers JOIN (SELECT layer_id, max(ix) + 1 AS nx FROM fx_pixels GROUP BY layer_id) d USING (layer_id)""",
)
def _(fx):
    path = scratch_path(fx.spark, "info")
    sized = fx.sized_catalog.table(fx.spark).select(F.col("nx").alias("size"), "role", F.col("layer_id").alias("idx"), "name")
    text.write_info(sized, path, 5, -999, "EPSG4326")
    return text.parse_info(fx.spark, path)


@query("s10_manifest", "SELECT '[0, 1, 2, 3, 4]' AS layers, CAST(count(*) AS VARCHAR) AS samples, 'legal' AS stage FROM v_legal")
def _(fx):
    path = scratch_path(fx.spark, "manifest")
    datasets.write_manifest(fx.spark, path, layers=fx.catalog.ids(), samples=legal_of(fx).count(), stage="legal")
    return datasets.read_manifest(fx.spark, path)


@query("s11_stage_resume", "SELECT sample_id, bi, bj FROM v_legal")
def _(fx):
    path = scratch_path(fx.spark, "stage_legal")
    datasets.Stage(fx.spark, path).run_or_load(lambda: legal_of(fx))

    def never():
        raise AssertionError("a finished stage is loaded, not rebuilt")

    return datasets.Stage(fx.spark, path).run_or_load(never)


@query(
    "s13_reuse_or_override",
    """SELECT 'reused' AS mode, count(*) AS cells FROM v_base UNION ALL
       SELECT 'overridden', count(*) FROM v_base WHERE y > 250000""",
)
def _(fx):
    path = scratch_path(fx.spark, "cells")
    cells = base_cells(fx.pixels, fx.base)
    large = cells.filter("y > 250000")
    datasets.write_table(cells, f"{path}/a")
    datasets.write_table(large, f"{path}/a", mode="ignore")
    datasets.write_table(cells, f"{path}/b")
    datasets.write_table(large, f"{path}/b", mode="overwrite")
    counts = [
        datasets.read_table(fx.spark, f"{path}/{sub}").agg(F.count(F.lit(1)).alias("cells")).select(F.lit(mode).alias("mode"), "cells")
        for mode, sub in (("reused", "a"), ("overridden", "b"))
    ]
    return counts[0].unionByName(counts[1])
