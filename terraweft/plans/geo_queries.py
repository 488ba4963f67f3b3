"""Affine arithmetic and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweft.catalog import channel_names, literal_array
from terraweft.functions import geo, scalars
from terraweft.functions.geo import Affine
from terraweft.operators import screen, tables
from terraweft.operators.footprint import base_cells
from terraweft.plans.registry import query

FINE = Affine(0.0, 0.0, 0.4375, 0.4375)
BASE = Affine(0.0, 0.0, 1.0, 1.0)
COARSE = Affine(0.0, 0.0, 10.0, 1.0)


@query(
    "p1_geo_to_index",
    "SELECT point_id, (lon - 0.0E0) / 0.4375E0 AS fx, (0.0E0 - lat) / 0.4375E0 AS fy FROM fx_points",
)
def _(fx):
    at = geo.geo_to_index(F.col("lon"), F.col("lat"), FINE)
    return fx.points.select("point_id", at[0].alias("fx"), at[1].alias("fy"))


@query(
    "p2_geo_to_cell",
    """SELECT point_id, CAST(floor((lon - 50) / 0.4375E0) AS INT) AS ix, CAST(floor(-lat / 0.4375E0) AS INT) AS iy,
       CAST(trunc((lon - 50) / 0.4375E0) AS INT) AS ix_trunc, CAST(trunc(-lat / 0.4375E0) AS INT) AS iy_trunc
       FROM fx_points""",
)
def _(fx):
    shifted = Affine(50.0, 0.0, 0.4375, 0.4375)
    a = geo.geo_to_cell(F.col("lon"), F.col("lat"), shifted)
    b = geo.geo_to_cell(F.col("lon"), F.col("lat"), shifted, "trunc")
    return fx.points.select(
        "point_id", a[0].alias("ix"), a[1].alias("iy"), b[0].alias("ix_trunc"), b[1].alias("iy_trunc")
    )


@query(
    "p3_index_to_geo",
    """SELECT layer_id, ix, iy, ulh + ix * psh AS ul_x, ulv - iy * psv AS ul_y,
       ulh + (ix + 0.5E0) * psh AS ctr_x, ulv - (iy + 0.5E0) * psv AS ctr_y
       FROM fx_pixels JOIN fx_layers USING (layer_id)""",
)
def _(fx):
    gt = Affine(*[F.col(c) for c in ("ulh", "ulv", "psh", "psv")])
    ul = geo.index_to_geo(F.col("ix"), F.col("iy"), gt)
    ctr = geo.index_to_geo(F.col("ix"), F.col("iy"), gt, "ctr")
    joined = fx.raw_pixels.join(F.broadcast(fx.catalog.table(fx.spark)), "layer_id")
    return joined.select(
        "layer_id", "ix", "iy", ul[0].alias("ul_x"), ul[1].alias("ul_y"), ctr[0].alias("ctr_x"), ctr[1].alias("ctr_y")
    )


@query(
    "p4_subpixel_grid",
    """SELECT bi, bj, CAST(si AS INT) AS si, CAST(sj AS INT) AS sj, (2 * si + 1) / 4.0E0 AS ox, (2 * sj + 1) / 4.0E0 AS oy
       FROM v_base, range(-1, 3) AS a(si), range(-1, 3) AS b(sj)""",
)
def _(fx):
    return geo.subpixel_grid(base_cells(fx.pixels, fx.base).drop("y"), 2, 1)


@query(
    "p6_window_origin",
    """SELECT bi, bj, layer_id, CAST(floor((bi + 0.5E0) / psh + CASE WHEN size % 2 = 0 THEN 0.5E0 ELSE 0.0E0 END)
         - size // 2 AS INT) AS x0
       FROM v_base CROSS JOIN (SELECT *, CASE WHEN res_m = 70 THEN 1 ELSE CAST(floor(70.0E0 / res_m) AS INT) + 1 END AS size
         FROM fx_layers UNION ALL SELECT layer_id + 10, name, role, res_m, ulh, ulv, psh, psv, nodata, 4
         FROM fx_layers) AS l""",
)
def _(fx):
    sizes = [(layer.layer_id, layer.psh, layer.size_for(fx.base)) for layer in fx.catalog]
    sizes += [(layer.layer_id + 10, layer.psh, 4) for layer in fx.catalog]
    layers = literal_array([{"layer_id": i, "psh": psh, "size": size} for i, psh, size in sizes])
    cells = base_cells(fx.pixels, fx.base).select("bi", "bj", F.inline(layers))
    t = (F.col("bi") + 0.5) / F.col("psh")
    return cells.select("bi", "bj", "layer_id", geo.window_origin(t, F.col("size")).alias("x0"))


@query(
    "p9_select_fields",
    "SELECT point_id, fhd_0 AS fhd_0, cover_z_0 AS cover_0, cover_z_1 AS cover_1 FROM fx_points",
)
def _(fx):
    return tables.select_fields(fx.points, ["fhd", "cover"], keep=["point_id"])


# what each channel of a cube can draw on: known pixels of a layer, points that have a field, all points for the nearest one
@query(
    "p10_channel_names",
    """SELECT CAST(row_number() OVER (ORDER BY o, k) - 1 AS INT) AS channel, name, n FROM (
         SELECT 0 AS o, l.layer_id AS k, l.name, count(p.value) AS n FROM fx_layers l JOIN v_px p USING (layer_id) WHERE l.layer_id > 0 GROUP BY ALL
         UNION ALL SELECT 1, 0, 'cover_0', count(cover_z_0) FROM fx_points UNION ALL SELECT 1, 1, 'cover_1', count(cover_z_1) FROM fx_points
         UNION ALL SELECT 2, 0, 'nearest_id', count(*) FROM fx_points UNION ALL SELECT 2, 1, 'nearest_d2', count(*) FROM fx_points) c""",
)
def _(fx):
    chosen = tables.select_fields(fx.points, ["cover"])
    names = channel_names(fx.x_layers, chosen.columns, fx.spark)
    known = fx.pixels.groupBy("layer_id").agg(F.count("value").alias("n")).join(fx.layers.select("layer_id", "name"), "layer_id").select("name", "n")
    held = [*chosen.columns, "nearest_id", "nearest_d2"]
    totals = chosen.agg(*[F.count(c).alias(c) for c in chosen.columns], *[F.count(F.lit(1)).alias(c) for c in held[-2:]])
    points = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in held])))
    return names.join(known.unionByName(points), "name", "left").select("channel", "name", "n")


@query(
    "p11_reset_nodata",
    "SELECT layer_id, ix, iy, CASE WHEN isnan(value) OR value = -9999 THEN -1.0E0 ELSE value END AS value FROM fx_pixels",
)
def _(fx):
    return fx.raw_pixels.withColumn("value", scalars.reset_nodata(F.col("value"), -9999.0, -1.0))


@query(
    "p12_sqdist",
    "SELECT point_id, (lon - 50) * (lon - 50) + (lat + 7) * (lat + 7) AS d2 FROM fx_points",
)
def _(fx):
    d2 = geo.sqdist(F.col("lon"), F.col("lat"), F.lit(50.0), F.lit(-7.0))
    return fx.points.select("point_id", d2.alias("d2"))


@query(
    "p13_overlap_fraction",
    """SELECT bi, bj, ix, iy,
       greatest(least(bi + 1, (ix + 1) * 0.4375E0) - greatest(bi, ix * 0.4375E0), 0) *
       greatest(least(bj + 1, (iy + 1) * 0.4375E0) - greatest(bj, iy * 0.4375E0), 0) / (0.4375E0 * 0.4375E0) AS share
       FROM (SELECT bi, bj, CAST(floor(bi / 0.4375E0) AS INT) AS ix, CAST(floor((bj + 1) / 0.4375E0) AS INT) AS iy
             FROM v_base) AS q""",
)
def _(fx):
    cells = base_cells(fx.pixels, fx.base).select(
        "bi",
        "bj",
        F.floor(F.col("bi") / 0.4375).cast("int").alias("ix"),
        F.floor((F.col("bj") + 1) / 0.4375).cast("int").alias("iy"),
    )
    share = geo.overlap_fraction(BASE, (F.col("bi"), F.col("bj")), FINE, (F.col("ix"), F.col("iy")))
    return cells.withColumn("share", share)


@query(
    "p17_null_outside",
    "SELECT layer_id, ix, iy, CASE WHEN value BETWEEN -1e5 AND 1e5 THEN value END AS value FROM fx_pixels",
)
def _(fx):
    return fx.raw_pixels.withColumn("value", scalars.null_outside(F.col("value"), -1e5, 1e5))


@query(
    "p18_class_from_name",
    """SELECT file_id, array_to_string(list_slice(string_split(fname, ' '), 1, len(string_split(fname, ' ')) - 1), ' ')
       AS class FROM fx_files""",
)
def _(fx):
    return fx.files.select("file_id", scalars.class_from_name(F.col("fname")).alias("class"))


@query(
    "p19_log_counts",
    """SELECT bin, n, CASE WHEN n > 0 THEN round(ln(n), 9) ELSE 0 END AS log_n FROM (SELECT b AS bin, count(layer_id) AS n
       FROM (SELECT unnest(range(0, CAST(max(value) AS BIGINT) + 1)) AS b FROM fx_pixels WHERE layer_id = 3) AS r
       LEFT JOIN (SELECT layer_id, CAST(value AS BIGINT) AS v FROM fx_pixels WHERE layer_id = 3) AS p ON v = b GROUP BY b) AS c""",
)
def _(fx):
    classes = fx.raw_pixels.filter("layer_id = 3").groupBy(F.col("value").cast("bigint").alias("bin")).count()
    codes = classes.agg(F.max("bin").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("bin"))
    every = codes.join(classes, "bin", "left")
    n = F.coalesce(F.col("count"), F.lit(0))
    return every.select("bin", n.alias("n"), F.round(scalars.log_counts(n), 9).alias("log_n"))


@query(
    "p20_unravel",
    """SELECT o_orderkey AS id, CAST(floor(o_orderkey / 100.0E0) AS BIGINT) AS r, o_orderkey % 100 AS c,
       o_orderkey AS back FROM orders""",
)
def _(fx):
    r, c = geo.unravel(F.col("o_orderkey"), 100)
    cells = fx.table("orders").select(F.col("o_orderkey").alias("id"), r.alias("r"), c.alias("c"))
    return cells.withColumn("back", geo.ravel(F.col("r"), F.col("c"), 100))


@query(
    "p23_rescale_affine",
    """SELECT layer_id, psh * (140.0E0 / res_m) AS psh, psv * (140.0E0 / res_m) AS psv, count(*) AS pixels,
       count(DISTINCT struct_pack(x := floor(((ix + 0.5E0) * psh) / (psh * (140.0E0 / res_m))), y := floor(((iy + 0.5E0) * psv) / (psv * (140.0E0 / res_m))))) AS cells
       FROM fx_layers JOIN fx_pixels USING (layer_id) GROUP BY ALL""",
)
def _(fx):
    """Every pixel in the cell of a 140 m grid with the corner of its layer."""
    old = Affine(*[F.col(c) for c in ("ulh", "ulv", "psh", "psv")])
    new = geo.rescale_affine(old, F.col("res_m"), 140.0)
    centre = geo.index_to_geo(F.col("ix"), F.col("iy"), old, "ctr")
    cx, cy = geo.geo_to_cell(*centre, new)
    placed = fx.raw_pixels.join(fx.layers, "layer_id").select("layer_id", new.psh.alias("psh"), new.psv.alias("psv"), cx.alias("cx"), cy.alias("cy"))
    per_cell = placed.groupBy("layer_id", "psh", "psv", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    return per_cell.groupBy("layer_id", "psh", "psv").agg(F.sum("n").alias("pixels"), F.count(F.lit(1)).alias("cells"))


@query(
    "f8_in_bounds",
    """SELECT layer_id, count(*) FILTER (WHERE NOT ok) AS outside, count(*) FILTER (WHERE ok) AS inside FROM (
       SELECT d.layer_id, lon / psh >= 0 AND -lat / psv >= 0 AND lon / psh < nx AND -lat / psv < ny AS ok
       FROM fx_points CROSS JOIN (SELECT layer_id, psh, psv, max(ix) + 1 AS nx, max(iy) + 1 AS ny
         FROM fx_layers JOIN fx_pixels USING (layer_id) GROUP BY ALL) AS d) AS q GROUP BY layer_id""",
)
def _(fx):
    return screen.bounds_report(fx.points, fx.sized_catalog)
