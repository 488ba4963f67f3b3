"""Points on rasters and nearest points."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweft.operators import cube, nearest, points, stats
from terraweft.operators.footprint import base_cells
from terraweft.plans.registry import near, query


def cells_of(fx):
    return base_cells(fx.pixels, fx.base).select("bi", "bj")


AT_POINTS = """
SELECT point_id, l.layer_id, p.value FROM (SELECT point_id, lon, lat, layer_id,
    CAST(floor((lon - ulh) / psh) AS INT) AS ix, CAST(floor((ulv - lat) / psv) AS INT) AS iy
  FROM fx_points CROSS JOIN fx_layers WHERE layer_id IN ({layers})) l LEFT JOIN v_px p USING (layer_id, ix, iy)"""


@query("j4_sample_at_points", AT_POINTS.format(layers="0, 1, 2, 3, 4"))
def _(fx):
    return points.sample_at_points(fx.points, fx.pixels, fx.catalog)


@query(
    "a36_paired_at_points",
    f"""SELECT point_id, max(value) FILTER (WHERE layer_id = 3) AS a, max(value) FILTER (WHERE layer_id = 1) AS b
        FROM ({AT_POINTS.format(layers="1, 3")}) q GROUP BY point_id""",
)
def _(fx):
    return points.paired_at_points(fx.points, fx.pixels, fx.catalog.by_name("class"), fx.catalog.by_name("fine"))


@query(
    "a15_hist_at_points",
    f"""SELECT CAST(least(floor((value - lo) * 10 / (hi - lo)), 9) AS INT) AS bin, count(*) AS n FROM ({AT_POINTS.format(layers="1")}) q,
        (SELECT min(value) AS lo, max(value) AS hi FROM ({AT_POINTS.format(layers="1")}) r) m WHERE value IS NOT NULL GROUP BY 1""",
)
def _(fx):
    at = points.sample_at_points(fx.points, fx.pixels, fx.catalog.only([1]))
    return stats.hist(at, "value", 10)


NEIGHBOURS = """
SELECT point_id, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, p.value FROM (
  SELECT point_id, dx, dy, CAST(floor(lon / 0.4375E0) AS INT) + dx AS ix, CAST(floor(-lat / 0.4375E0) AS INT) + dy AS iy
  FROM fx_points, (VALUES (-1),(0),(1)) AS a(dx), (VALUES (-1),(0),(1)) AS b(dy)) q
JOIN (SELECT * FROM v_px WHERE layer_id = 1 AND value IS NOT NULL) p USING (ix, iy)"""


@query("j5_neighborhood", NEIGHBOURS)
def _(fx):
    return points.neighborhood(fx.points, fx.pixels, fx.catalog.by_name("fine"))


def _direction_sql(wrap: bool) -> str:
    def weight(k):
        cases = " ".join(
            f"WHEN dx = {dx} AND dy = {dy} THEN {points.KERNELS[k][dx if wrap else dx + 1][dy if wrap else dy + 1]}E0"
            for dx in (-1, 0, 1)
            for dy in (-1, 0, 1)
        )
        return f"sum(CASE {cases} END * value) AS r{k + 1}"

    picks = " ".join(f"WHEN abs(r{i}) = best THEN CAST(sign(r{i}) * {i} AS INT)" for i in range(1, 5))
    return f"""SELECT point_id, CASE {picks} END AS direction FROM (SELECT *, greatest(abs(r1), abs(r2), abs(r3), abs(r4)) AS best
        FROM (SELECT point_id, {", ".join(weight(k) for k in range(4))} FROM ({NEIGHBOURS}) n GROUP BY point_id) s) t"""


@query("a29_dominant_direction", _direction_sql(False))
def _(fx):
    return points.dominant_direction(fx.points, fx.pixels, fx.catalog.by_name("fine"))


@query("a29_dominant_direction_wrap", _direction_sql(True))
def _(fx):
    return points.dominant_direction(fx.points, fx.pixels, fx.catalog.by_name("fine"), wrap=True)


@query(
    "a30_flatness",
    f"""SELECT point_id, near(sum(abs(value - centre))) AS flatness FROM (SELECT *, max(value) FILTER (WHERE dx = 0 AND dy = 0)
        OVER (PARTITION BY point_id) AS centre FROM ({NEIGHBOURS}) n) q GROUP BY point_id""",
)
def _(fx):
    out = points.flatness(fx.points, fx.pixels, fx.catalog.by_name("fine"))
    return out.withColumn("flatness", near("flatness"))


@query("j6_nearest_point", "SELECT bi, bj, si, sj, point_id, d2 FROM v_near")
def _(fx):
    return nearest.nearest_point(cells_of(fx), fx.points, fx.base, 2)


@query(
    "j7_k_nearest",
    """SELECT bi, bj, CAST(r AS INT) AS rank, best[r] % 16777216 AS point_id, (best[r] // 16777216) / 4096.0E0 AS d2 FROM (
       SELECT bi, bj, min(CAST(((lon - bi - 0.5E0) * (lon - bi - 0.5E0) + (lat + bj + 0.5E0) * (lat + bj + 0.5E0)) * 4096
         AS BIGINT) * 16777216 + point_id, 3) AS best FROM v_base CROSS JOIN fx_points GROUP BY ALL) q, (VALUES (1),(2),(3)) AS k(r)""",
)
def _(fx):
    return nearest.k_nearest(cells_of(fx), fx.points, fx.base, 3)


@query(
    "j8_ring_candidates",
    """SELECT bi, bj, ring0, rings, pi, pj, points FROM v_rings JOIN v_occ
       ON pi BETWEEN bi - rings + 1 AND bi + rings - 1 AND pj BETWEEN bj - rings + 1 AND bj + rings - 1""",
)
def _(fx):
    return nearest.ring_candidates(cells_of(fx), fx.points, fx.base)


@query(
    "a13_ring_stats",
    "SELECT max(rings) AS max_rings, CAST(floor(avg(rings)) AS BIGINT) AS mean_rings FROM v_rings",
)
def _(fx):
    return nearest.ring_stats(nearest.ring_counts(cells_of(fx), fx.points, fx.base))


@query(
    "j9_points_in_box",
    """SELECT bi, bj, count(*) AS points, near(sum(cover_z_0)) AS total, min(point_id) AS first_id, max(point_id) AS last_id
       FROM (SELECT point_id, cover_z_0, CAST(floor(lon) - dx AS INT) AS bi, CAST(floor(-lat) - dy AS INT) AS bj
             FROM fx_points, range(-4, 5) AS a(dx), range(-4, 5) AS b(dy)) q JOIN v_base USING (bi, bj) GROUP BY bi, bj""",
)
def _(fx):
    out = nearest.box_summary(cells_of(fx), fx.points, fx.base, "cover_z_0")
    return out.withColumn("total", near("total"))


@query(
    "j9_points_in_box_list",
    """SELECT bi, bj, point_id FROM (SELECT point_id, CAST(floor(lon) - dx AS INT) AS bi, CAST(floor(-lat) - dy AS INT) AS bj
       FROM fx_points, range(-1, 2) AS a(dx), range(-1, 2) AS b(dy)) q JOIN v_base USING (bi, bj)""",
)
def _(fx):
    return nearest.points_in_box(cells_of(fx), fx.points, fx.base, -1, 2)


@query("j10_site_partition", "SELECT point_id, count(*) AS cells FROM v_near GROUP BY point_id")
def _(fx):
    return nearest.site_partition(nearest.nearest_point(cells_of(fx), fx.points, fx.base, 2))


@query("a11_mid_distance", "SELECT bi, bj, round(avg(d2), 9) AS avg_mid_dist FROM v_near GROUP BY bi, bj")
def _(fx):
    out = nearest.mid_distance(nearest.nearest_point(cells_of(fx), fx.points, fx.base, 2), 2)
    return out.withColumn("avg_mid_dist", F.round("avg_mid_dist", 9))


MINI = """
WITH sub AS (SELECT bi, bj, CAST(a.s AS INT) AS si, CAST(b.s AS INT) AS sj, bi + (2 * a.s + 1) / 8.0E0 AS ux, bj + (2 * b.s + 1) / 8.0E0 AS uy
  FROM v_base, range(0, 4) AS a(s), range(0, 4) AS b(s)),
pix AS (SELECT s.*, layer_id, psh, psv, CAST(floor(ux / psh) AS INT) AS ix, CAST(floor(uy / psv) AS INT) AS iy
  FROM sub s CROSS JOIN fx_layers WHERE layer_id IN (1, 4)),
hit AS (SELECT pix.*, p.value, CASE WHEN layer_id = 1 THEN 0 ELSE 1 END AS k FROM pix JOIN v_px p USING (layer_id, ix, iy))
SELECT bi, bj, si, sj, 2 * k AS channel, value FROM hit
UNION ALL
SELECT bi, bj, si, sj, 2 * k + 1,
  greatest(least(bi + (si + 1) / 4.0E0, (ix + 1) * psh) - greatest(bi + si / 4.0E0, ix * psh), 0)
  * greatest(least(bj + (sj + 1) / 4.0E0, (iy + 1) * psv) - greatest(bj + sj / 4.0E0, iy * psv), 0) / (psh * psv) FROM hit
UNION ALL
SELECT bi, bj, CAST(0 AS INT), CAST(p AS INT), 4, CASE p WHEN 0 THEN cover_z_0 WHEN 1 THEN fhd_0 WHEN 2 THEN point_id ELSE d2 END
FROM v_near_ctr JOIN fx_points USING (point_id), range(0, 4) AS r(p)"""


@query("c11_mini_cube", MINI)
def _(fx):
    return cube.mini_cube(fx.pixels, fx.points, fx.base, fx.catalog.only([1, 4]), ["cover_z_0", "fhd_0"])
