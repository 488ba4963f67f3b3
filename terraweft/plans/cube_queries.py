"""Cubes, layouts, tiles, normalisation and screens."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.operators import cube, resample, screen, stats, tables, tiles
from terraweft.plans.point_queries import cells_of
from terraweft.plans.registry import near, query
from terraweft.session import cut_lineage, scratch_path
from terraweft.sources import datasets

KEYS = ["bi", "bj"]


def cube_of(fx):
    """2 x 2 sub-pixels of every base cell in the x layers, long form."""
    return resample.resample_nearest(cells_of(fx), fx.pixels, fx.base, fx.x_layers, 2)


@query(
    "j13_stack_cube",
    """SELECT s.bi, s.bj, s.si, s.sj, max(value) FILTER (WHERE channel = 1) AS fine, max(value) FILTER (WHERE channel = 2) AS sparse,
       max(value) FILTER (WHERE channel = 3) AS class, max(value) FILTER (WHERE channel = 4) AS coarse,
       any_value(p.cover_z_0) AS cover_z_0, any_value(s.point_id) AS nearest_id, any_value(s.d2) AS nearest_d2
       FROM v_near s JOIN fx_points p USING (point_id) LEFT JOIN v_cube c USING (bi, bj, si, sj) GROUP BY s.bi, s.bj, s.si, s.sj""",
)
def _(fx):
    wide, index = cube.build_cube(
        fx.pixels, fx.points, fx.base, fx.x_layers, ["cover_z_0"], 2, screen=False
    )
    return wide.join(index.select("sample_id", "bi", "bj"), "sample_id").drop("sample_id")


@query(
    "j13_sample_index",
    """SELECT row_number() OVER (ORDER BY bi, bj) - 1 AS sample_id, bi, bj, y, round(avg_mid_dist, 9) AS avg_mid_dist FROM (
       SELECT bi, bj, y, avg(d2) AS avg_mid_dist FROM v_base JOIN v_near USING (bi, bj) GROUP BY ALL) q
       WHERE (bi, bj) NOT IN (SELECT (bi, bj) FROM v_cube WHERE abs(value) > 1e5)""",
)
def _(fx):
    index = cube.build_cube(fx.pixels, fx.points, fx.base, fx.x_layers, ["cover_z_0"], 2)[1]
    return index.withColumn("avg_mid_dist", F.round("avg_mid_dist", 9))


@query("s8_write_cubes", "SELECT channel, count(*) AS pixels, count(value) AS known FROM v_cube GROUP BY channel")
def _(fx):
    path = scratch_path(fx.spark, "cubes")
    samples = resample.number_samples(cells_of(fx))
    px = resample.resample_nearest(samples, fx.pixels, fx.base, fx.x_layers, 2)
    datasets.write_cubes(px, samples, path, rows_per_file=50_000)
    stored = datasets.read_cubes(fx.spark, path)[0]
    return stored.groupBy("channel").agg(F.count(F.lit(1)).alias("pixels"), F.count("value").alias("known"))


@query("p8_select_channels", "SELECT bi, bj, si, sj, channel, value FROM v_cube WHERE channel IN (1, 4)")
def _(fx):
    return tables.select_channels(cube_of(fx), keep=[1, 2, 4], drop=[2])


@query(
    "p21_return_format",
    f"""SELECT bi, bj, {", ".join(f"round(avg(value) FILTER (WHERE channel = {c}), 6) AS mean_{c}" for c in range(1, 5))}, y
       FROM v_base JOIN v_cube USING (bi, bj) GROUP BY bi, bj, y""",
)
def _(fx):
    names = [f"mean_{c}" for c in fx.x_layers.ids()]
    means = stats.channel_means(cube_of(fx), KEYS, fx.x_layers.ids())
    joined = means.join(_targets(fx), KEYS)
    rounded = [F.round(c, 6).alias(c) for c in names]
    return tables.as_xy(joined, names, "y", keys=KEYS).select(*KEYS, *rounded, "y")


def _targets(fx):
    from terraweft.operators.footprint import base_cells

    return base_cells(fx.pixels, fx.base)


@query(
    "p22_to_layout",
    """SELECT bi, bj, CAST(row_number() OVER (PARTITION BY bi, bj ORDER BY si, sj, channel) - 1 AS INT) AS hwc,
       CAST(row_number() OVER (PARTITION BY bi, bj ORDER BY channel, si, sj) - 1 AS INT) AS chw, value
       FROM v_cube""",
)
def _(fx):
    px = cube_of(fx)
    # cells on the edge of a layer hold fewer values, so positions are taken from the arrays themselves
    tagged = px.withColumn("value", F.struct("value", "si", "sj", "channel"))
    hwc = tables.to_layout(tagged, "hwc", KEYS).select(*KEYS, F.posexplode("cube").alias("hwc", "v"))
    chw = tables.to_layout(tagged, "chw", KEYS).select(*KEYS, F.posexplode("cube").alias("chw", "v"))
    spot = [*KEYS, "v.si", "v.sj", "v.channel"]
    both = hwc.select(*spot, "hwc", "v.value").join(
        chw.select(*spot, "chw"), [*KEYS, "si", "sj", "channel"]
    )
    return both.select(*KEYS, "hwc", "chw", "value")


@query("c12_arrays_round_trip", "SELECT sample_id, layer_id, wi, wj, value FROM v_pyr")
def _(fx):
    legal = cut_lineage(resample.legal_samples(fx.pixels, fx.base, fx.catalog))
    px = resample.gather_windows(legal, fx.pixels, fx.base, fx.x_layers)
    packed = tables.to_arrays(px.withColumn("value", F.struct("wi", "wj", "value")), ["sample_id", "layer_id"], ["wi", "wj"])
    long = tables.to_long(packed, 3)
    return long.select("sample_id", "layer_id", "value.wi", "value.wj", "value.value")


@query(
    "s9_write_pyramid",
    """SELECT layer_id, count(*) AS samples, near(sum(total)) AS total FROM (SELECT layer_id, sample_id, sum(value) AS total
       FROM v_pyr GROUP BY ALL) q GROUP BY layer_id""",
)
def _(fx):
    path = scratch_path(fx.spark, "pyramid")
    _, px = cube.pyramid(fx.pixels, fx.base, fx.x_layers)
    datasets.write_pyramid(tables.to_arrays(px, ["sample_id", "layer_id"], ["wi", "wj"]), path)
    stored = datasets.read_pyramid(fx.spark, path)
    total = F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)
    return stored.groupBy("layer_id").agg(F.count(F.lit(1)).alias("samples"), near(F.sum(total)).alias("total"))


PER = "SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM v_cube GROUP BY channel"


@query("a1_channel_stats", f"SELECT channel, near(mean) AS mean, near(std) AS std FROM ({PER}) q")
def _(fx):
    return stats.channel_stats(cube_of(fx)).select("channel", near("mean").alias("mean"), near("std").alias("std"))


@query(
    "a2_global_stats",
    """SELECT channel, near(mean) AS mean, near(std) AS std FROM (SELECT DISTINCT channel FROM v_cube) c,
       (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM v_cube) s""",
)
def _(fx):
    out = stats.channel_stats(cube_of(fx), "global")
    return out.select("channel", near("mean").alias("mean"), near("std").alias("std"))


@query(
    "p15_zscore",
    f"""SELECT bi, bj, si, sj, channel, round(CASE WHEN std <> 0 THEN (value - mean) / std ELSE value END, 6) AS value
        FROM v_cube JOIN ({PER}) s USING (channel)""",
)
def _(fx):
    px = cube_of(fx)
    return stats.zscore(px, stats.channel_stats(px)).withColumn("value", F.round("value", 6))


@query("p15_unzscore", "SELECT bi, bj, si, sj, channel, near(value) AS value FROM v_cube")
def _(fx):
    px = cube_of(fx)
    per = cut_lineage(stats.channel_stats(px))
    return stats.unzscore(stats.zscore(px, per), per).withColumn("value", near("value"))


# two 52-bit numbers of the digest of a row's keys and the seed
PARTS = ", ".join(f"(CAST(concat('0x', substr(d, {at}, 13)) AS BIGINT) + 0.5E0) / 4503599627370496.0E0 AS u{k}" for k, at in enumerate((1, 14)))


@query(
    "p16_add_noise",
    f"""SELECT channel, bi, count(value) AS pixels, near(sum(0.5E0 * sqrt(-2 * ln(u0)) * cos(2 * pi() * u1))) AS noise, near(sum(-2 * ln(u0) * cos(2 * pi() * u1) * cos(2 * pi() * u1))) AS squares
        FROM (SELECT *, {PARTS} FROM (SELECT *, md5(concat(bi, ':', bj, ':', si, ':', sj, ':', channel, ':11')) AS d FROM v_cube WHERE value IS NOT NULL) a) b GROUP BY channel, bi""",
)
def _(fx):
    """Noise and its square, added up over each column of cells; the table is dealt anew before it gets its noise."""
    px = cube_of(fx).select("bi", "bj", "si", "sj", "channel", "value").filter("value IS NOT NULL").withColumn("clean", F.col("value"))
    noisy = stats.add_noise(px.repartition(7), 0.5, 11, ["bi", "bj", "si", "sj", "channel"])
    noise = F.col("value") - F.col("clean")
    sums = noisy.groupBy("channel", "bi").agg(F.count("value").alias("pixels"), F.sum(noise).alias("noise"), F.sum(noise * noise * 4).alias("squares"))
    return sums.select("channel", "bi", "pixels", near("noise").alias("noise"), near("squares").alias("squares"))


@query(
    "a9_channel_means",
    """SELECT bi, bj, near(avg(value) FILTER (WHERE channel = 1)) AS mean_1, near(avg(value) FILTER (WHERE channel = 2)) AS mean_2,
       near(avg(value) FILTER (WHERE channel = 3)) AS mean_3, near(avg(value) FILTER (WHERE channel = 4)) AS mean_4
       FROM v_cube GROUP BY bi, bj""",
)
def _(fx):
    out = stats.channel_means(cube_of(fx), KEYS, [1, 2, 3, 4])
    return out.select(*KEYS, *[near(f"mean_{c}").alias(f"mean_{c}") for c in (1, 2, 3, 4)])


@query(
    "a10_channel_mode",
    """SELECT bi, bj, value FROM (SELECT bi, bj, value, row_number() OVER (PARTITION BY bi, bj ORDER BY count(*) DESC, value) AS r
       FROM v_cube WHERE channel = 2 AND value IS NOT NULL GROUP BY bi, bj, value) q WHERE r = 1""",
)
def _(fx):
    return stats.channel_mode(cube_of(fx), KEYS, 2)


@query(
    "a12_extreme_report",
    """SELECT channel, count(*) FILTER (WHERE abs(value) > CASE WHEN channel = 4 THEN 1e4 ELSE 1e5 END) AS extremes, count(*) AS pixels
       FROM v_cube GROUP BY channel""",
)
def _(fx):
    return screen.extreme_report(cube_of(fx), point_channels=[4])


@query(
    "a14_channel_hist",
    """SELECT channel, CAST(CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 100) ELSE 0 END AS INT) AS bin, count(*) AS n
       FROM v_cube JOIN (SELECT channel, min(value) AS lo, max(value) AS hi FROM v_cube GROUP BY channel) r USING (channel)
       WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def _(fx):
    return stats.channel_hist(cube_of(fx))


@query(
    "a35_channel_target",
    """SELECT channel, count(*) AS samples, round(corr(m, y), 6) AS r FROM (SELECT bi, bj, channel, avg(value) AS m FROM v_cube
       GROUP BY ALL HAVING avg(value) IS NOT NULL) c JOIN v_base USING (bi, bj) GROUP BY channel""",
)
def _(fx):
    return stats.channel_target(cube_of(fx), _targets(fx), KEYS).withColumn("r", F.round("r", 6))


@query(
    "a35_channel_target_pairs",
    """SELECT CAST(channel AS INT) AS channel, bi, bj, near(avg(value)) AS x, y FROM v_cube JOIN v_base USING (bi, bj) GROUP BY channel, bi, bj, y""",
)
def _(fx):
    px, targets = cut_lineage(cube_of(fx)), cut_lineage(_targets(fx))
    pairs = [stats.channel_target_pairs(px, targets, KEYS, c).withColumns({"channel": F.lit(c), "x": near("x")}) for c in fx.x_layers.ids()]
    return functools.reduce(DataFrame.unionByName, pairs)


@query(
    "f3_prescreen",
    "SELECT bi, bj FROM v_cube GROUP BY bi, bj HAVING count(*) FILTER (WHERE abs(value) > 1e5) = 0",
)
def _(fx):
    return screen.prescreen(cube_of(fx), KEYS)


@query(
    "f4_within_distance",
    "SELECT bi, bj, avg(d2) AS avg_mid_dist FROM v_near GROUP BY bi, bj HAVING avg(d2) <= 0.25",
)
def _(fx):
    from terraweft.operators.nearest import mid_distance, nearest_point

    return screen.within_distance(mid_distance(nearest_point(cells_of(fx), fx.points, fx.base, 2), 2), 0.25)


@query(
    "f5_class_fraction",
    """SELECT bi, bj, round(avg(CASE WHEN value BETWEEN 40 AND 45 THEN 1.0E0 ELSE 0.0E0 END), 6) AS fraction FROM v_cube
       WHERE channel = 3 GROUP BY bi, bj HAVING avg(CASE WHEN value BETWEEN 40 AND 45 THEN 1.0E0 ELSE 0.0E0 END) >= 0.95""",
)
def _(fx):
    return screen.class_fraction_at_least(cube_of(fx), KEYS, 3).withColumn("fraction", F.round("fraction", 6))


# class share over 3 x 3 windows of the class layer, one cell of halo around the 1 x 1 cell
@query(
    "a16_class_percent_hist",
    """SELECT CAST(round(f * 100) AS INT) AS percent, count(*) AS n FROM (
       SELECT bi, bj, avg(CASE WHEN value BETWEEN 40 AND 45 THEN 1.0E0 ELSE 0.0E0 END) AS f FROM (
         SELECT bi, bj, bi + a.d AS ix, bj + b.d AS iy FROM v_base, (VALUES (-1),(0),(1)) AS a(d), (VALUES (-1),(0),(1)) AS b(d)) q
       JOIN (SELECT * FROM v_px WHERE layer_id = 3) p USING (ix, iy) GROUP BY bi, bj) s GROUP BY 1""",
)
def _(fx):
    px = resample.resample_nearest(cells_of(fx), fx.pixels, fx.base, fx.catalog.only([3]), 1, pad=1)
    return screen.class_percent_hist(px, KEYS, 3)


@query(
    "a32_audit",
    """SELECT 'lon' AS column, count(*) AS rows, count(*) FILTER (WHERE lon IS NULL OR isnan(lon)) AS bad, count(DISTINCT lon) AS
       distinct_values FROM fx_points UNION ALL
       SELECT 'lat', count(*), count(*) FILTER (WHERE lat IS NULL OR isnan(lat)), count(DISTINCT lat) FROM fx_points UNION ALL
       SELECT 'cover_z_0', count(*), count(*) FILTER (WHERE cover_z_0 IS NULL OR isnan(cover_z_0)), count(DISTINCT cover_z_0) FROM fx_points""",
)
def _(fx):
    return screen.audit(fx.points, ["lon", "lat", "cover_z_0"])


TILE_SIDES = "(SELECT layer_id, ix, iy, value, CASE WHEN layer_id = 0 THEN 9 ELSE 21 END AS side FROM v_px WHERE layer_id < 2)"

# beyond any raster here, so every pixel is in a tile
TILES_ALONG = 1_000_000


@query(
    "c1_cut_tiles",
    f"""SELECT CAST((ix // side) * {TILES_ALONG} + iy // side AS BIGINT) AS tile_id, layer_id, ix % side AS r, iy % side AS c, value FROM {TILE_SIDES} t""",
)
def _(fx):
    return tiles.cut_tiles(fx.pixels, fx.catalog.only([0, 1]), 630, 0, TILES_ALONG)


@query("c2_stride", "SELECT tile_id, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, value, label FROM fx_tiles WHERE r % 2 = 0 AND c % 2 = 0")
def _(fx):
    return tiles.stride(fx.tiles, 2)


@query(
    "c3_upsample_nearest",
    "SELECT tile_id, CAST(r * 3 + a.i AS INT) AS r, CAST(c * 3 + b.i AS INT) AS c, value, label FROM fx_tiles, range(0, 3) AS a(i), range(0, 3) AS b(i)",
)
def _(fx):
    return tiles.upsample_nearest(fx.tiles, 3)


@query(
    "c4_upsample_weighted",
    """SELECT tile_id, CAST(br * 3 + j AS INT) AS r, CAST(bc * 3 + k AS INT) AS c, label, round(CASE WHEN j = 0 AND k = 0 THEN v00 ELSE
         (v00 * ((3 - j) * (3 - j) + (3 - k) * (3 - k)) + v10 * (j * j + (3 - k) * (3 - k)) + v01 * ((3 - j) * (3 - j) + k * k)
          + v11 * (j * j + k * k)) / ((3 - j) * (3 - j) + (3 - k) * (3 - k) + j * j + (3 - k) * (3 - k) + (3 - j) * (3 - j) + k * k
          + j * j + k * k) END, 7) AS value
       FROM (SELECT t.tile_id, t.label, t.r AS br, t.c AS bc, t.value AS v00, x.value AS v10, y.value AS v01, z.value AS v11
         FROM fx_tiles t JOIN fx_tiles x ON x.tile_id = t.tile_id AND x.r = least(t.r + 1, 7) AND x.c = t.c
         JOIN fx_tiles y ON y.tile_id = t.tile_id AND y.r = t.r AND y.c = least(t.c + 1, 7)
         JOIN fx_tiles z ON z.tile_id = t.tile_id AND z.r = least(t.r + 1, 7) AND z.c = least(t.c + 1, 7)) q,
       range(0, 3) AS a(j), range(0, 3) AS b(k)""",
)
def _(fx):
    return tiles.upsample_weighted(fx.tiles, 3, 8, 8).withColumn("value", F.round("value", 7))


@query(
    "c6_sub_blocks",
    """SELECT tile_id, CAST(r // 4 AS INT) AS br, CAST(c // 4 AS INT) AS bc, CAST((r % 4) * 4 + c % 4 AS INT) AS pos, value,
       round(avg(value) OVER (PARTITION BY tile_id, r // 4, c // 4), 7) AS label FROM fx_tiles""",
)
def _(fx):
    blocks = tiles.sub_blocks(fx.tiles, 4).join(tiles.block_means(fx.tiles, 4), ["tile_id", "br", "bc"])
    flat = blocks.select("tile_id", "br", "bc", F.round("label", 7).alias("label"), F.posexplode("features").alias("pos", "value"))
    return flat


@query(
    "c7_patchify",
    """SELECT tile_id, CAST(p AS INT) AS patch_size, CAST((r // p) * (8 // p) + c // p AS INT) AS patch, CAST((r % p) * p + c % p AS INT) AS pos, value
       FROM fx_tiles, (VALUES (2),(3),(5)) AS s(p) WHERE r // p < 8 // p AND c // p < 8 // p""",
)
def _(fx):
    packed = tiles.patchify(fx.tiles, [2, 3, 5], 8, ["tile_id"])
    return packed.select("tile_id", "patch_size", "patch", F.posexplode("vals").alias("pos", "value"))


@query(
    "c8_fit_tile",
    """SELECT g.tile_id, CAST(g.r AS INT) AS r, CAST(g.c AS INT) AS c, coalesce(x.value, 0) AS value FROM (SELECT tile_id, a.i AS r, b.i AS c FROM
         (SELECT DISTINCT tile_id FROM fx_tiles) t, range(0, 10) AS a(i), range(0, 6) AS b(i)) g
       LEFT JOIN fx_tiles x ON x.tile_id = g.tile_id AND x.r = g.r AND x.c = g.c""",
)
def _(fx):
    return tiles.fit_tile(fx.tiles, 10, 6)


CROP = "CAST(CAST(concat('0x', substr(md5(concat(tile_id, ':3:{a}')), 1, 7)) AS BIGINT) % 3 AS INT)"


@query(
    "l5_random_crop",
    f"""SELECT tile_id, r, c, value, label FROM (SELECT tile_id, r - {CROP.format(a="r")} AS r, c - {CROP.format(a="c")} AS c, value, label
        FROM fx_tiles) q WHERE r BETWEEN 0 AND 4 AND c BETWEEN 0 AND 4""",
)
def _(fx):
    return tiles.random_crop(fx.tiles, 5, 5, 8, 8, 3)


@query(
    "a31_psnr",
    """SELECT label, round(sqrt(m), 9) AS rmse, round(10 * log10(1 / m), 6) AS psnr FROM (SELECT t.label, avg((s.value - t.value)
       * (s.value - t.value)) AS m FROM fx_tiles t JOIN fx_tiles s ON s.tile_id = t.tile_id AND s.r = t.r // 2 * 2 AND s.c = t.c // 2 * 2
       GROUP BY t.label) q""",
)
def _(fx):
    from terraweft.operators.evaluate import rmse_psnr

    truth = fx.tiles.withColumnRenamed("value", "truth")
    recon = tiles.upsample_nearest(tiles.stride(fx.tiles, 2), 2).select("tile_id", "r", "c", F.col("value").alias("recon"))
    out = rmse_psnr(truth.join(recon, ["tile_id", "r", "c"]), ["label"])
    return out.select("label", F.round("rmse", 9).alias("rmse"), F.round("psnr", 6).alias("psnr"))
