"""Layers, legality, windows, resampling and alignment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from terraweft.catalog import Catalog
from terraweft.functions import geo
from terraweft.operators import align, cube, mosaic, resample, screen, stats
from terraweft.operators.footprint import base_cells
from terraweft.operators.splits import random_split
from terraweft.plans.registry import near, query
from terraweft.session import cut_lineage, scratch_path, stored
from terraweft.sources import datasets


def legal_of(fx):
    return resample.legal_samples(fx.pixels, fx.base, fx.catalog)


def pyramid_of(fx):
    """Legal samples and their windows in the x layers."""
    legal = cut_lineage(legal_of(fx))
    px = resample.gather_windows(legal, fx.pixels, fx.base, fx.x_layers)
    return legal, px.select("sample_id", "layer_id", "wi", "wj", "value")


def splits_of(legal):
    return random_split(legal, folds=3, test_frac=0.3, val_frac=0.2, seed=7)


@query("s1_read_region", "SELECT bi, bj, si, sj, channel, value FROM v_cube WHERE bi BETWEEN 20 AND 29 AND bj BETWEEN 4 AND 9")
def _(fx):
    """The sub-grid of the cells of a region, from the blocks that they need."""
    path = scratch_path(fx.spark, "raster")
    datasets.write_layers(fx.layers, fx.raw_pixels, path, block=64)
    cells = base_cells(fx.pixels, fx.base).filter("bi BETWEEN 20 AND 29 AND bj BETWEEN 4 AND 9").select("bi", "bj")
    _, pixels = datasets.read_layers(fx.spark, path, cells=cells, base=fx.base)
    return resample.resample_nearest(cells, pixels, fx.base, fx.x_layers, 2)


@query("s1_read_layers", "SELECT layer_id, ix, iy, value FROM v_px")
def _(fx):
    path = scratch_path(fx.spark, "raster")
    datasets.write_layers(fx.layers, fx.raw_pixels, path)
    return datasets.read_layers(fx.spark, path)[1]


@query("f9_exclude_layers", "SELECT layer_id, count(*) AS pixels FROM v_px WHERE layer_id NOT IN (2, 4) GROUP BY layer_id")
def _(fx):
    path = scratch_path(fx.spark, "raster")
    datasets.write_layers(fx.layers, fx.raw_pixels, path)
    pixels = datasets.read_layers(fx.spark, path, exclude=[2, 4])[1]
    return pixels.groupBy("layer_id").agg(F.count(F.lit(1)).alias("pixels"))


@query("f1_valid_base", "SELECT bi, bj, y FROM v_base")
def _(fx):
    return base_cells(fx.pixels, fx.base)


@query("f2_legal_samples", "SELECT sample_id, bi, bj FROM v_legal")
def _(fx):
    return legal_of(fx)


@query("w3_sample_id", "SELECT row_number() OVER (ORDER BY bi, bj) - 1 AS sample_id, bi, bj FROM v_base")
def _(fx):
    return resample.number_samples(base_cells(fx.pixels, fx.base).select("bi", "bj")).select("sample_id", "bi", "bj")


@query(
    "u4_layer_intersection",
    """SELECT bi, bj FROM (SELECT w.bi, w.bj, layer_id, count(p.ix) AS n, count(p.ix) - count(p.value) AS bad
       FROM v_win w LEFT JOIN v_px p USING (layer_id, ix, iy) GROUP BY ALL) c
       GROUP BY bi, bj HAVING bool_and(n > 0 AND bad = 0)""",
)
def _(fx):
    return resample.legal_cells(fx.pixels, fx.base, fx.x_layers)


@query("j1_resample_nearest", "SELECT bi, bj, si, sj, channel, value FROM v_cube")
def _(fx):
    cells = base_cells(fx.pixels, fx.base).select("bi", "bj")
    return resample.resample_nearest(cells, fx.pixels, fx.base, fx.x_layers, 2)


@query(
    "c9_halo",
    """SELECT bi, bj, CAST(si AS INT) AS si, CAST(sj AS INT) AS sj, layer_id AS channel, value FROM (
       SELECT bi, bj, si, sj, l.layer_id, CAST(floor((bi + (2 * si + 1) / 4.0E0) / l.psh) AS INT) AS ix,
         CAST(floor((bj + (2 * sj + 1) / 4.0E0) / l.psv) AS INT) AS iy
       FROM v_base CROSS JOIN fx_layers l, range(-1, 3) AS a(si), range(-1, 3) AS b(sj)
       WHERE l.layer_id IN (1, 4)) q JOIN v_px USING (layer_id, ix, iy)""",
)
def _(fx):
    cells = base_cells(fx.pixels, fx.base).select("bi", "bj")
    return resample.resample_nearest(cells, fx.pixels, fx.base, fx.catalog.only([1, 4]), 2, pad=1)


@query("j2_gather_windows", "SELECT sample_id, layer_id, wi, wj, value FROM v_pyr")
def _(fx):
    return pyramid_of(fx)[1]


def resampled(sizes: str) -> str:
    """Resampled windows (sample_id, layer_id, wi, wj, value) of the x layers under a table of sizes (layer_id, n)."""
    return f"""SELECT sample_id, layer_id, CAST(wi AS INT) AS wi, CAST(wj AS INT) AS wj, value FROM (
       SELECT sample_id, l.layer_id, a.i AS wi, b.j AS wj,
         CAST(CASE WHEN res_m = 30 AND n > 1 THEN floor(floor((bi + 0.5E0) / psh - 0.5E0) - 1 + a.i * (3.0E0 / (n - 1)))
              ELSE floor((bi + 0.5E0) / psh) END AS INT) AS ix,
         CAST(CASE WHEN res_m = 30 AND n > 1 THEN floor(floor((bj + 0.5E0) / psv - 0.5E0) - 1 + b.j * (3.0E0 / (n - 1)))
              ELSE floor((bj + 0.5E0) / psv) END AS INT) AS iy
       FROM v_legal CROSS JOIN (SELECT * FROM fx_layers JOIN ({sizes}) z USING (layer_id) WHERE layer_id > 0) l, range(0, 16) AS a(i), range(0, 16) AS b(j)
       WHERE a.i < n AND b.j < n AND (res_m = 30 OR (a.i = 0 AND b.j = 0))) q JOIN v_px USING (layer_id, ix, iy)"""


@query("j3_resample_windows", resampled("SELECT layer_id, CASE WHEN layer_id = 2 THEN 3 ELSE 5 END AS n FROM fx_layers"))
def _(fx):
    layers = Catalog(fx.x_layers).with_sample_sizes({2: 3})
    rows = resample.resample_windows(legal_of(fx), fx.pixels, fx.base, layers, 5)
    return rows.select("sample_id", "layer_id", "wi", "wj", "value")


EQUALIZED = """SELECT layer_id, native, 16 AS sample, CAST(floor(16 * sqrt((SELECT sum(native * native) FROM w) / (SELECT sum(256) FROM w))) AS INT) AS n FROM w"""
NATIVE = "w AS (SELECT layer_id, CASE WHEN res_m = 70 THEN 1 ELSE CAST(floor(70.0E0 / res_m) AS INT) + 1 END AS native FROM fx_layers WHERE role = 'x')"


@query(
    "p7_equalize_params",
    f"""WITH {NATIVE}, z AS ({EQUALIZED}), r AS ({resampled("SELECT layer_id, n FROM z")})
        SELECT z.layer_id, z.native, z.sample, z.n AS adjusted, count(*) AS pixels, count(value) AS vals FROM z JOIN r USING (layer_id) GROUP BY ALL""",
)
def _(fx):
    """Sample sizes that hold as many values as the native windows, and the windows built with them."""
    sized = fx.layers.select("layer_id", "role", geo.expected_size(70, F.col("res_m")).alias("native"), F.lit(16).alias("sample"))
    sizes = geo.equalize_params(sized).filter("role = 'x'").drop("role")
    chosen = {r["layer_id"]: r["adjusted"] for r in sizes.collect()}  # one row per layer
    rows = resample.resample_windows(legal_of(fx), fx.pixels, fx.base, Catalog(fx.x_layers).with_sample_sizes(chosen))
    built = rows.groupBy("layer_id").agg(F.count(F.lit(1)).alias("pixels"), F.count("value").alias("vals"))
    return sizes.join(built, "layer_id").select("layer_id", "native", "sample", "adjusted", "pixels", "vals")


@query(
    "p5_expected_size",
    """SELECT layer_id, CASE WHEN res_m = 70 THEN 1 ELSE CAST(floor(70.0E0 / res_m) AS INT) + 1 END AS size, count(*) AS pixels,
       count(DISTINCT sample_id) AS windows FROM fx_layers JOIN v_pyr USING (layer_id) GROUP BY layer_id, res_m""",
)
def _(fx):
    """Native window sizes, and the windows of the pyramid that they give."""
    sized = fx.layers.select("layer_id", geo.expected_size(70, F.col("res_m")).alias("size"))
    built = pyramid_of(fx)[1].groupBy("layer_id", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    built = built.groupBy("layer_id").agg(F.sum("n").alias("pixels"), F.count(F.lit(1)).alias("windows"))
    return sized.join(built, "layer_id")


@query(
    "a3_layer_minmax",
    """SELECT s.fold, layer_id, min(value) AS vmin, max(value) AS vmax FROM v_pyr JOIN v_splits s USING (sample_id)
       WHERE role IN ('remaining', 'train') GROUP BY s.fold, layer_id""",
)
def _(fx):
    legal, px = pyramid_of(fx)
    return stats.layer_minmax(px, splits_of(legal))


@query(
    "a3_combined_minmax",
    "SELECT layer_id, min(value) AS vmin, max(value) AS vmax, count(value) AS pixels FROM v_pyr GROUP BY layer_id",
)
def flagship(fx):
    return stats.combined_minmax(pyramid_of(fx)[1])


@query(
    "p14_minmax_norm",
    """SELECT sample_id, layer_id, wi, wj, round(CASE WHEN vmax <> vmin THEN (value - vmin) / (vmax - vmin) END, 9) AS value
       FROM v_pyr JOIN (SELECT layer_id, min(value) AS vmin, max(value) AS vmax FROM v_pyr JOIN v_splits USING (sample_id)
         WHERE role = 'train' AND fold = 1 GROUP BY layer_id) m USING (layer_id)""",
)
def _(fx):
    legal, px = pyramid_of(fx)
    px = stored(px, "windows")  # read twice: for the ranges and to be scaled
    normed = stats.minmax_norm(px, stats.layer_minmax(px, splits_of(legal)), 1)
    return normed.withColumn("value", F.round("value", 9))


@query(
    "c10_buffer_pixels",
    """SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, CASE WHEN i >= 0 AND j >= 0 AND i < nx AND j < ny THEN p.value
         ELSE -999.0E0 END AS value
       FROM (SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny FROM fx_pixels WHERE layer_id = 1) d
       JOIN range(-2, 100000) AS a(i) ON i < nx + 2 JOIN range(-2, 100000) AS b(j) ON j < ny + 2
       LEFT JOIN (SELECT * FROM v_px WHERE layer_id = 1) p ON p.ix = i AND p.iy = j""",
)
def _(fx):
    layers = fx.sized_catalog
    return cube.buffer_pixels(fx.pixels, layers.by_name("fine"), layers[0])


# one row per sub-sample of a 140 m cell: 14 x 14, three per side of a 30 m pixel
SUBS = """SELECT bi, bj, p.value FROM (
  SELECT bi, bj, CAST(floor(bi * 2 / {psh} + (2 * a.k + 1) / (2.0E0 * {f})) AS INT) AS ix,
         CAST(floor(bj * 2 / {psh} + (2 * b.k + 1) / (2.0E0 * {f})) AS INT) AS iy
  FROM v_grid, range(0, 14) AS a(k), range(0, 14) AS b(k)) q
  JOIN (SELECT * FROM v_px WHERE layer_id = {layer} AND value IS NOT NULL) p USING (ix, iy)"""
SUBS_FINE = SUBS.format(psh="0.4375E0", f=3, layer=1)
SUBS_SPARSE = SUBS.format(psh="0.5E0", f=3, layer=2)
SUBS_CLASS = SUBS.format(psh="1.0E0", f=7, layer=3)


def _target(fx):
    return align.target_grid(fx.sized_catalog[0], 140)


@query("a4_align_mean", f"SELECT bi, bj, near(avg(value)) AS value FROM ({SUBS_FINE}) s GROUP BY bi, bj")
def _(fx):
    out = align.align_agg(fx.pixels, _target(fx), fx.catalog.by_name("fine"), "mean")
    return out.withColumn("value", near("value"))


@query(
    "a4_align_filled",
    f"""SELECT bi, bj, coalesce(value, -99999.0E0) AS value FROM (SELECT bi, bj FROM v_grid) g LEFT JOIN
        (SELECT bi, bj, near(avg(value)) AS value FROM ({SUBS_FINE}) s GROUP BY bi, bj) v USING (bi, bj)""",
)
def _(fx):
    out = align.align_agg(fx.pixels, _target(fx), fx.catalog.by_name("fine"), "mean")
    return align.fill_grid(out.withColumn("value", near("value")), _target(fx))


@query(
    "a5_align_mode",
    f"""SELECT bi, bj, value FROM (SELECT bi, bj, value, row_number() OVER (PARTITION BY bi, bj ORDER BY count(*) DESC,
        value) AS r FROM ({SUBS_CLASS}) s GROUP BY bi, bj, value) q WHERE r = 1""",
)
def _(fx):
    return align.align_agg(fx.pixels, _target(fx), fx.catalog.by_name("class"), "mode")


@query("a6_align_median", f"SELECT bi, bj, near(median(value)) AS value FROM ({SUBS_SPARSE}) s GROUP BY bi, bj")
def _(fx):
    out = align.align_agg(fx.pixels, _target(fx), fx.catalog.by_name("sparse"), "median")
    return out.withColumn("value", near("value"))


@query(
    "a7_align_weighted_mean",
    """SELECT bi, bj, near(sum(w * value) / sum(w)) AS value FROM (
       SELECT bi, bj, value, greatest(least((bi + 1) * 2, (ix + 1) * 0.4375E0) - greatest(bi * 2, ix * 0.4375E0), 0)
         * greatest(least((bj + 1) * 2, (iy + 1) * 0.4375E0) - greatest(bj * 2, iy * 0.4375E0), 0) AS w
       FROM (SELECT ix, iy, value, CAST(floor(ix * 0.4375E0 / 2) AS INT) + a.d AS bi, CAST(floor(iy * 0.4375E0 / 2) AS INT) + b.d
               AS bj FROM v_px, (VALUES (0),(1)) AS a(d), (VALUES (0),(1)) AS b(d) WHERE layer_id = 1 AND value IS NOT NULL) p
       JOIN v_grid USING (bi, bj)) q WHERE w > 0 GROUP BY bi, bj""",
)
def _(fx):
    out = align.align_agg(fx.pixels, _target(fx), fx.catalog.by_name("fine"), "mean", weighted=True)
    return out.withColumn("value", near("value"))


@query(
    "a7_align_weighted_mode",
    """SELECT bi, bj, value FROM (SELECT bi, bj, value, row_number() OVER (PARTITION BY bi, bj ORDER BY count(*) DESC,
       value) AS r FROM v_grid JOIN (SELECT *, ix // 2 AS b0, iy // 2 AS b1 FROM v_px WHERE layer_id = 3) p
       ON bi = b0 AND bj = b1 GROUP BY bi, bj, value) q WHERE r = 1""",
)
def _(fx):
    return align.align_agg(fx.pixels, _target(fx), fx.catalog.by_name("class"), "mode", weighted=True)


@query(
    "a8_align_floor_offsets",
    """SELECT bi, bj, near(avg(value)) AS value FROM (
       SELECT bi, bj, CAST(floor(bi * 2 / 0.4375E0) + a.k // 3 AS INT) AS ix, CAST(floor(bj * 2 / 0.4375E0) + b.k // 3 AS INT) AS iy
       FROM v_grid, range(0, 14) AS a(k), range(0, 14) AS b(k)) q
       JOIN (SELECT * FROM v_px WHERE layer_id = 1 AND value IS NOT NULL) p USING (ix, iy) GROUP BY bi, bj""",
)
def _(fx):
    out = align.align_agg(fx.pixels, _target(fx), fx.catalog.by_name("fine"), "mean", offsets="floor")
    return out.withColumn("value", near("value"))


@query(
    "a33_align_report",
    f"""SELECT (SELECT count(*) FROM v_grid) AS cells,
        (SELECT count(*) FROM v_grid) - (SELECT count(*) FROM (SELECT DISTINCT bi, bj FROM ({SUBS_FINE}) s) d) AS empty_cells,
        (SELECT count(*) FROM (SELECT bi * 2 / 0.4375E0 + (2 * a.k + 1) / 6.0E0 AS x, bj * 2 / 0.4375E0 + (2 * b.k + 1) / 6.0E0 AS y
           FROM v_grid, range(0, 14) AS a(k), range(0, 14) AS b(k)) p,
           (SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny FROM fx_pixels WHERE layer_id = 1) d
         WHERE x >= nx OR y >= ny) AS outside_samples""",
)
def _(fx):
    return align.align_report(fx.pixels, _target(fx), fx.sized_catalog.by_name("fine"))


@query(
    "j16_align_sample",
    """SELECT bi, bj, value FROM v_grid LEFT JOIN (SELECT * FROM v_px WHERE layer_id = 1) p
       ON p.ix = CAST(floor((bi * 2 + 1) / 0.4375E0) AS INT) AND p.iy = CAST(floor((bj * 2 + 1) / 0.4375E0) AS INT)""",
)
def _(fx):
    target = _target(fx)
    return align.fill_grid(align.align_sample(fx.pixels, target, fx.catalog.by_name("fine"), "ctr"), target, None)


@query(
    "s12_export_grid",
    f"""SELECT layer_id, ix, iy, value FROM v_px WHERE layer_id = 1 UNION ALL
        SELECT 9, bi, bj, value FROM (SELECT bi, bj FROM v_grid) g LEFT JOIN
        (SELECT bi, bj, near(avg(value)) AS value FROM ({SUBS_FINE}) s GROUP BY bi, bj) v USING (bi, bj)""",
)
def _(fx):
    path = scratch_path(fx.spark, "raster")
    target = _target(fx)
    fine = fx.layers.filter("layer_id = 1")
    datasets.write_layers(fine, fx.raw_pixels.filter("layer_id = 1"), path)
    aligned = align.align_agg(fx.pixels, target, fx.catalog.by_name("fine"), "mean").withColumn("value", near("value"))
    grid = align.fill_grid(aligned, target, None).select(F.col("bi").alias("ix"), F.col("bj").alias("iy"), "value")
    row = replace(target, layer_id=9, name="aligned", nodata=align.NO_DATA_FOUND)
    as_row = type(fx.catalog)([row]).table(fx.spark).select(fine.columns)
    datasets.write_layer(grid, as_row, path)
    return datasets.read_layers(fx.spark, path)[1].select("layer_id", "ix", "iy", "value")


BLEND = """
SELECT bi, bj, layer_id, CAST(gi AS INT) AS gi, CAST(gj AS INT) AS gj,
       near(CASE WHEN sum({w}) FILTER (WHERE value IS NOT NULL) > 0 THEN sum(({w}) * value)
         / sum({w}) FILTER (WHERE value IS NOT NULL) END) AS blend,
       max(value) FILTER (WHERE ox = 0 AND oy = 0) AS nearest
FROM (SELECT bi, bj, layer_id, gi, gj, ox, oy, CASE WHEN ox = 0 THEN 1 - abs(dx) ELSE abs(dx) END AS wx,
        CASE WHEN oy = 0 THEN 1 - abs(dy) ELSE abs(dy) END AS wy,
        CAST(ix + ox * CASE WHEN dx <= 0 THEN -1 ELSE 1 END AS INT) AS ix,
        CAST(iy + oy * CASE WHEN dy <= 0 THEN -1 ELSE 1 END AS INT) AS iy
      FROM (SELECT *, floor(tx) AS ix, floor(ty) AS iy, tx - floor(tx) - 0.5E0 AS dx, ty - floor(ty) - 0.5E0 AS dy
            FROM (SELECT bi, bj, layer_id, gi, gj, (bi + (30 * gi - 10) / 70.0E0) / psh AS tx,
                    (bj + (30 * gj - 10) / 70.0E0) / psv AS ty
                  FROM v_base CROSS JOIN (SELECT * FROM fx_layers WHERE layer_id IN (1, 3)) l,
                    range(0, 4) AS a(gi), range(0, 4) AS b(gj)) t) p,
      (VALUES (0),(1)) AS c(ox), (VALUES (0),(1)) AS d(oy)) n
JOIN v_px USING (layer_id, ix, iy) GROUP BY bi, bj, layer_id, gi, gj
HAVING count(value) > 0"""


def _blend(fx, weights):
    cells = base_cells(fx.pixels, fx.base).select("bi", "bj")
    out = resample.resample_blend(cells, fx.pixels, fx.base, fx.catalog.only([1, 3]), 4, 30, weights)
    return out.withColumn("blend", near("blend"))


@query("c5_blend_bilinear", BLEND.format(w="wx * wy"))
def _(fx):
    return _blend(fx, "bilinear")


@query("c5_blend_sqdist", BLEND.format(w="wx * wx + wy * wy"))
def _(fx):
    return _blend(fx, "sqdist")


@query("u1_mosaic", "SELECT ix, iy, arg_max(value, file_order) AS value FROM fx_tile_parts GROUP BY ix, iy")
def _(fx):
    return mosaic.mosaic(fx.tile_parts)


@query(
    "f6_clip",
    """SELECT p.layer_id, p.ix, p.iy, CASE WHEN n % 2 = 1 THEN value END AS value FROM (SELECT * FROM v_px WHERE layer_id = 1) p
       JOIN (SELECT ix, iy, count(e.x) AS n FROM (SELECT ix, iy, (ix + 0.5E0) * 0.4375E0 AS cx, -(iy + 0.5E0) * 0.4375E0 AS cy
         FROM fx_pixels WHERE layer_id = 1) c LEFT JOIN (SELECT x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_aoi
         WINDOW w AS (PARTITION BY poly_id ORDER BY seq)) e
         ON (e.y > cy) <> (e.y2 > cy) AND cx < e.x + (cy - e.y) * (e.x2 - e.x) / (e.y2 - e.y) GROUP BY ix, iy) i USING (ix, iy)""",
)
def _(fx):
    layer = fx.sized_catalog.by_name("fine")
    return screen.clip(fx.pixels, layer, fx.aoi, layer.ny)
