"""Datasets, pruning, stages and plan shape."""

from __future__ import annotations

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from terraweft.operators import resample, stats
from terraweft.operators.footprint import base_cells
from terraweft.session import scratch_path
from terraweft.sources import datasets, text


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_layer_choice_prunes_partitions(spark, fx):
    path = scratch_path(spark, "raster")
    datasets.write_layers(fx.layers, fx.raw_pixels, path)
    _, pixels = datasets.read_layers(spark, path, only=[1])
    shown = plan(pixels.select("value"))
    assert "PartitionFilters" in shown and "ReadSchema: struct<value:double>" in shown
    assert pixels.select("layer_id").distinct().collect()[0][0] == 1


@pytest.mark.parametrize("named", [True, False])
def test_only_blocks_that_cells_need_are_read(spark, fx, monkeypatch, named):
    if not named:
        monkeypatch.setattr(datasets, "MOST_BLOCKS", 3)
    path = scratch_path(spark, "raster")
    datasets.write_layers(fx.layers, fx.raw_pixels, path, block=8)
    all_cells = base_cells(fx.pixels, fx.base)
    cells = all_cells.where("bi BETWEEN 10 AND 12 AND bj BETWEEN 3 AND 5").select("bi", "bj").cache()
    _, pixels = datasets.read_layers(spark, path, cells=cells, base=fx.base)
    assert "PartitionFilters" in plan(pixels.select("value"))
    every = len(datasets.read_layers(spark, path)[1].inputFiles())
    scan = spark.read.parquet(f"{path}/pixels").where(datasets._touched(cells, fx.base, spark.read.parquet(f"{path}/layers"), 1))
    files = {r[0] for r in scan.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files) < every / 4
    for build in (
        lambda px: resample.resample_nearest(cells, px, fx.base, fx.x_layers, 2, pad=1),
        lambda px: resample.gather_windows(cells.selectExpr("*", "bi * 1000L + bj AS sample_id"), px, fx.base, fx.x_layers),
    ):
        assert sorted(map(tuple, build(pixels).collect())) == sorted(map(tuple, build(fx.pixels).collect()))


def test_stage_resumes_and_recovers(spark):
    path = scratch_path(spark, "stage")
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    stage = datasets.Stage(spark, path)
    assert not stage.done()
    assert stage.run_or_load(build).count() == 5 and stage.done()
    assert datasets.Stage(spark, path).run_or_load(build).count() == 5 and len(built) == 1
    datasets.Stage(spark, path, override=True).run_or_load(build)
    assert len(built) == 2
    # output without marker: the write was interrupted
    broken = scratch_path(spark, "stage")
    spark.range(3).write.parquet(broken)
    assert datasets.Stage(spark, broken).run_or_load(build).count() == 5 and len(built) == 3


def test_failed_override_keeps_the_old_output(spark):
    path = scratch_path(spark, "stage")
    datasets.Stage(spark, path).run_or_load(lambda: spark.range(5))

    def fails():
        return spark.range(3).select(F.raise_error(F.lit("broken build")))

    with pytest.raises(Exception, match="broken build"):
        datasets.Stage(spark, path, override=True).run_or_load(fails)
    assert datasets.Stage(spark, path).run_or_load(fails).count() == 5


def test_layer_written_twice_is_there_once(spark, fx):
    path = scratch_path(spark, "raster")
    datasets.write_layers(fx.layers, fx.raw_pixels, path)
    row = fx.layers.where("layer_id = 1").selectExpr("77 AS layer_id", "'new' AS name", "role", "res_m", "ulh", "ulv", "psh", "psv", "nodata")
    values = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "ix int, iy int, value double")
    for _ in range(2):
        datasets.write_layer(values, row, path)
    layers, pixels = datasets.read_layers(spark, path, only=[77])
    assert layers.count() == 1 and pixels.count() == 2
    assert datasets.read_layers(spark, path)[1].count() == fx.raw_pixels.count() + 2
    with pytest.raises(ValueError, match="another catalog row"):
        datasets.write_layer(values, row.withColumn("nodata", F.lit(0.5)), path)


def test_cubes_with_text_twin(spark, fx):
    px = fx.tiles.where("tile_id < 2").selectExpr("tile_id AS sample_id", "r AS si", "c AS sj", "0 AS channel", "value")
    path = scratch_path(spark, "cubes")
    datasets.write_cubes(px, px.select("sample_id").distinct(), path, also_text="hwc")
    back = text.read_cube_text(spark, f"{path}/text", "hwc").drop("file")
    assert back.exceptAll(px).isEmpty() and back.count() == px.count() == datasets.read_cubes(spark, path)[0].count()


def test_info_with_and_without_seed(spark, fx):
    layers = fx.layers.selectExpr("3 AS size", "role", "layer_id AS idx", "name")
    for seed in (None, 100807):
        path = scratch_path(spark, "info")
        text.write_info(layers, path, 10, -999, "EPSG4326", seed)
        got = text.parse_info(spark, path)
        assert got.count() == 5 and got.select("seed").distinct().first()[0] == seed


def test_override_modes(spark):
    path = scratch_path(spark, "t")
    datasets.write_table(spark.range(2), path)
    with pytest.raises(Exception, match="already exists"):
        datasets.write_table(spark.range(2), path)
    datasets.write_table(spark.range(9), path, mode="ignore")
    assert datasets.read_table(spark, path).count() == 2


def test_plans_have_no_cartesian_product(fx):
    legal = resample.legal_cells(fx.pixels, fx.base, fx.catalog)
    cells = base_cells(fx.pixels, fx.base).select("bi", "bj")
    px = resample.resample_nearest(cells, fx.pixels, fx.base, fx.x_layers, 4)
    for df in (legal, px, stats.channel_stats(px)):
        shown = plan(df)
        assert "CartesianProduct" not in shown and "Python" not in shown


def test_one_shuffle_decides_legality(fx):
    shown = plan(resample.legal_cells(fx.pixels.where(F.col("layer_id") != 2), fx.base, fx.catalog.without([2])))
    assert shown.count("hashpartitioning(bi") == 1


def test_twin_text_cubes(spark, fx):
    px = fx.tiles.where("tile_id < 3").selectExpr("tile_id AS sample_id", "r AS si", "c AS sj", "0 AS channel", "value")
    for layout in ("hwc", "chw"):
        path = scratch_path(spark, "cube")
        text.write_cube_text(px, path, layout)
        back = text.read_cube_text(spark, path, layout).drop("file")
        assert back.exceptAll(px).isEmpty() and back.count() == px.count()


def test_many_text_cubes_in_one_folder(spark):
    px = spark.range(6000).selectExpr("id - 5 AS sample_id", "explode(sequence(0, 3)) AS p").selectExpr("sample_id", "int(p div 2) AS si", "p % 2 AS sj", "0 AS channel", "sample_id / 7 + p AS value")
    path = scratch_path(spark, "cube")
    text.write_cube_text(px, path)
    names = [f for f in os.listdir(path.removeprefix("file:")) if not f.startswith((".", "_"))]
    assert len(names) == 6000 and "-5.csv" in names
    back = text.read_cube_text(spark, path)
    assert back.rdd.getNumPartitions() == 6
    assert back.drop("file").exceptAll(px).isEmpty() and back.count() == 24000
    with pytest.raises(FileExistsError):
        text.write_cube_text(px, path)
    text.write_cube_text(px.where("sample_id < 0"), path, mode="overwrite")
    assert text.read_cube_text(spark, path).select("sample_id").distinct().count() == 5


def test_text_cubes_named_by_others(spark, tmp_path):
    (tmp_path / "x_12.csv").write_text("1,2\n3,4\n5,6\n7,8\n")
    (tmp_path / "plain.txt").write_text("9\n")
    got = text.read_cube_text(spark, str(tmp_path)).orderBy("file", "si", "sj", "channel").collect()
    assert [tuple(r) for r in got[:2]] == [(None, "plain.txt", 0, 0, 0, 9.0), (12, "x_12.csv", 0, 0, 0, 1.0)] and len(got) == 9
    (tmp_path / "empty").mkdir()
    assert text.read_cube_text(spark, str(tmp_path / "empty")).count() == 0
