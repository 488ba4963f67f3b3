"""Fixture views: rasters, points, predictions and tiles derived from the driver's tables.

One text per view serves Spark and the SQL twin; names in braces are tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from terraweft.catalog import Catalog, Layer, with_extent
from terraweft.sources.datasets import clean_pixels

VIEWS = {
    "fx_layers": """
SELECT * FROM (VALUES
 (0,'base','y',70, 0.0E0,0.0E0, 1.0E0,1.0E0, -9999.0E0),
 (1,'fine','x',30, 0.0E0,0.0E0, 0.4375E0,0.4375E0, -9999.0E0),
 (2,'sparse','x',30, 0.0E0,0.0E0, 0.5E0,0.5E0, -9999.0E0),
 (3,'class','x',70, 0.0E0,0.0E0, 1.0E0,1.0E0, -9999.0E0),
 (4,'coarse','x',700, 0.0E0,0.0E0, 10.0E0,1.0E0, -9999.0E0)
) AS t(layer_id, name, role, res_m, ulh, ulv, psh, psv, nodata)""",
    "fx_pixels": """
SELECT 0 AS layer_id, CAST(o_orderkey % 100 AS INT) AS ix, CAST(floor(o_orderkey / 100.0E0) AS INT) AS iy,
       CASE WHEN o_orderkey % 29 = 7 THEN -9999.0E0 ELSE o_totalprice END AS value FROM {orders}
UNION ALL
SELECT 1, CAST((o_orderkey % 100) * 2 + dx AS INT), CAST(floor(o_orderkey / 100.0E0) * 2 + dy AS INT),
       CASE WHEN o_orderkey % 37 = 5 AND dx = 1 THEN -9999.0E0 ELSE o_totalprice / 2 + 1000 * dx + 100 * dy END
FROM {orders} CROSS JOIN (SELECT * FROM (VALUES (0,0),(0,1),(1,0),(1,1)) AS d(dx, dy)) AS dd
UNION ALL
SELECT 2, CAST((l_orderkey % 100) * 2 + l_linenumber % 2 AS INT),
       CAST(floor(l_orderkey / 100.0E0) * 2 + floor(l_linenumber / 2.0E0) % 2 AS INT), max(l_extendedprice)
FROM {lineitem} GROUP BY 2, 3
UNION ALL
SELECT 3, CAST(o_orderkey % 100 AS INT), CAST(floor(o_orderkey / 100.0E0) AS INT),
       CASE o_custkey % 8 WHEN 0 THEN 11.0E0 WHEN 1 THEN 21.0E0 WHEN 2 THEN 41.0E0 WHEN 3 THEN 42.0E0
            WHEN 4 THEN 43.0E0 WHEN 5 THEN 52.0E0 WHEN 6 THEN 71.0E0 ELSE 90.0E0 END FROM {orders}
UNION ALL
SELECT 4, CAST(c_custkey % 10 AS INT), CAST(floor(c_custkey / 10.0E0) AS INT), c_acctbal FROM {customer}""",
    "fx_points": """
SELECT event_id AS point_id, ((event_id * 7919) % 6400) / 64.0E0 AS lon,
       -(((event_id * 104729) % (64 * h.nrow)) / 64.0E0) AS lat,
       value AS cover_z_0, value * 2 AS cover_z_1, CAST(user_id AS DOUBLE) AS fhd_0, event_type AS kind
FROM {events} CROSS JOIN (SELECT CAST(floor(count(*) / 100.0E0) AS BIGINT) AS nrow FROM {orders}) AS h""",
    "fx_aoi": """
SELECT * FROM (VALUES (0,0,10.25E0,-1.25E0),(0,1,60.25E0,-0.25E0),(0,2,90.25E0,-6.25E0),(0,3,70.25E0,-13.25E0),
 (0,4,20.25E0,-14.25E0),(0,5,5.25E0,-7.25E0),(0,6,10.25E0,-1.25E0)) AS t(poly_id, seq, x, y)""",
    "fx_preds": """
SELECT CAST(l_linenumber % 3 AS INT) AS fold, l_orderkey AS sample_id,
       CASE l_returnflag WHEN 'A' THEN 'wue' WHEN 'N' THEN 'esi' ELSE 'agb' END AS target,
       max(l_extendedprice) / 100000.0E0 AS y, max(l_quantity * 1000.0E0) / 100000.0E0 + max(l_discount) AS yhat
FROM {lineitem} GROUP BY 1, 2, 3""",
    "fx_epoch_log": """
SELECT event_type AS model, CAST(user_id % 3 AS INT) AS fold, CAST(day(ts) AS INT) AS epoch,
       avg(value) AS val_loss, min(ts) AS ts
FROM {events} GROUP BY 1, 2, 3""",
    "fx_tile_parts": """
SELECT 0 AS file_order, ix, iy, value FROM (SELECT CAST(o_orderkey % 100 AS INT) AS ix,
  CAST(floor(o_orderkey / 100.0E0) AS INT) AS iy, o_totalprice AS value FROM {orders}) AS a WHERE ix < 60
UNION ALL
SELECT 1, ix, iy, value + 1 FROM (SELECT CAST(o_orderkey % 100 AS INT) AS ix,
  CAST(floor(o_orderkey / 100.0E0) AS INT) AS iy, o_totalprice AS value FROM {orders}) AS b WHERE ix >= 40""",
    "fx_files": """
SELECT p_partkey AS file_id, concat(p_name, ' ', lpad(CAST(p_partkey AS VARCHAR(12)), 6, '0'), '.png') AS fname
FROM {part}""",
    "fx_tiles": """
SELECT vec_id AS tile_id, CAST(floor(i / 8) AS INT) AS r, CAST(i % 8 AS INT) AS c, CAST(v AS DOUBLE) AS value, label
FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS i, v""",
}

# views that exist only on the SQL side: another spelling, or inputs shared by several twins
SQL_VIEWS = {
    "fx_tiles": """
SELECT vec_id AS tile_id, CAST(floor(i / 8) AS INT) AS r, CAST(i % 8 AS INT) AS c, CAST(v AS DOUBLE) AS value, label
FROM (SELECT vec_id AS tile_id, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i, label
      FROM embeddings) AS t""",
    # pixels with nodata as NULL
    "v_px": """
SELECT p.layer_id, ix, iy, CASE WHEN isnan(value) OR value = nodata THEN NULL ELSE value END AS value
FROM fx_pixels p JOIN fx_layers USING (layer_id)""",
    "v_base": "SELECT ix AS bi, iy AS bj, value AS y FROM v_px WHERE layer_id = 0 AND value IS NOT NULL",
    "v_dims": "SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny FROM fx_pixels WHERE layer_id = 0",
    # 2 x 2 sub-pixels of every base cell
    "v_sub2": """
SELECT bi, bj, y, si, sj, bi + (2 * si + 1) / 4.0E0 AS ux, bj + (2 * sj + 1) / 4.0E0 AS uy
FROM v_base, (VALUES (0),(1)) AS a(si), (VALUES (0),(1)) AS b(sj)""",
    "v_cube": """
SELECT bi, bj, si, sj, layer_id AS channel, value FROM (
  SELECT bi, bj, si, sj, l.layer_id, CAST(floor((ux - l.ulh) / l.psh) AS INT) AS ix,
         CAST(floor((l.ulv + uy) / l.psv) AS INT) AS iy
  FROM v_sub2 CROSS JOIN fx_layers l WHERE l.layer_id > 0) q JOIN v_px USING (layer_id, ix, iy)""",
    # native windows around each base cell: 3 x 3 pixels in the 30 m layers, one pixel in the others
    "v_win": """
SELECT bi, bj, l.layer_id, a.w AS wi, b.w AS wj,
       CAST(floor((bi + 0.5E0 - l.ulh) / l.psh) - o + a.w AS INT) AS ix,
       CAST(floor((l.ulv + bj + 0.5E0) / l.psv) - o + b.w AS INT) AS iy
FROM v_base CROSS JOIN (SELECT *, CASE WHEN res_m = 30 THEN 1 ELSE 0 END AS o FROM fx_layers WHERE layer_id > 0) l
CROSS JOIN (VALUES (0),(1),(2)) AS a(w) CROSS JOIN (VALUES (0),(1),(2)) AS b(w)
WHERE res_m = 30 OR (a.w = 0 AND b.w = 0)""",
    "v_legal": """
SELECT row_number() OVER (ORDER BY bi, bj) - 1 AS sample_id, bi, bj FROM (
  SELECT bi, bj FROM (
    SELECT w.bi, w.bj, layer_id, count(p.ix) AS n, count(p.ix) - count(p.value) AS bad
    FROM v_win w LEFT JOIN v_px p USING (layer_id, ix, iy) GROUP BY ALL) c
  GROUP BY bi, bj HAVING bool_and(n > 0 AND bad = 0)) g""",
    # long form of the windows of the legal samples
    "v_pyr": """
SELECT sample_id, layer_id, wi, wj, value
FROM v_legal JOIN v_win USING (bi, bj) JOIN v_px USING (layer_id, ix, iy)""",
    # random split of the legal samples: 30 % test, then 3 folds of 20 % of the rest, seed 7
    "v_ranked": """
SELECT sample_id, row_number() OVER (ORDER BY md5(concat(sample_id, ':7')), sample_id) AS r, count(*) OVER () AS n
FROM v_legal""",
    "v_folded": """
SELECT sample_id, fold, row_number() OVER (PARTITION BY fold ORDER BY md5(concat(sample_id, ':7:', fold)), sample_id) AS r,
       n - CAST(ceil(round(n * 0.3E0, 9)) AS BIGINT) AS n
FROM v_ranked CROSS JOIN (VALUES (0),(1),(2)) AS f(fold) WHERE r > ceil(round(n * 0.3E0, 9))""",
    "v_splits": """
SELECT sample_id, CAST(NULL AS INT) AS fold, CASE WHEN r <= ceil(round(n * 0.3E0, 9)) THEN 'test' ELSE 'remaining' END AS role
FROM v_ranked
UNION ALL
SELECT sample_id, fold, CASE WHEN r <= ceil(round(n * 0.2E0, 9)) THEN 'val' ELSE 'train' END FROM v_folded""",
    # cells of a 140 m grid over the base layer
    "v_grid": """
SELECT CAST(a.i AS INT) AS bi, CAST(b.j AS INT) AS bj, nx * 70 // 140 + 1 AS gx, ny * 70 // 140 + 1 AS gy
FROM v_dims, range(0, 1000000) AS a(i), range(0, 1000000) AS b(j)
WHERE a.i < nx * 70 // 140 + 1 AND b.j < ny * 70 // 140 + 1""",
    # nearest points among the candidates of the ring search; distances are multiples of 1/4096, so one integer orders
    # (distance, id)
    "v_near": """
SELECT bi, bj, si, sj, best % 16777216 AS point_id, (best // 16777216) / 4096.0E0 AS d2 FROM (
  SELECT bi, bj, si, sj, min(CAST(((lon - ux) * (lon - ux) + (lat + uy) * (lat + uy)) * 4096 AS BIGINT) * 16777216
    + point_id) AS best
  FROM (SELECT bi, bj, pi, pj FROM v_rings JOIN v_occ
        ON pi BETWEEN bi - rings + 1 AND bi + rings - 1 AND pj BETWEEN bj - rings + 1 AND bj + rings - 1) c
  JOIN (SELECT point_id, lon, lat, CAST(floor(lon) AS INT) AS pi, CAST(floor(-lat) AS INT) AS pj FROM fx_points) p USING (pi, pj)
  JOIN v_sub2 USING (bi, bj) GROUP BY ALL) q""",
    # the same for cell centres by brute force over all points
    "v_near_ctr": """
SELECT bi, bj, best % 16777216 AS point_id, (best // 16777216) / 4096.0E0 AS d2 FROM (
  SELECT bi, bj, min(CAST(((lon - bi - 0.5E0) * (lon - bi - 0.5E0) + (lat + bj + 0.5E0) * (lat + bj + 0.5E0)) * 4096
    AS BIGINT) * 16777216 + point_id) AS best FROM v_base CROSS JOIN fx_points GROUP BY ALL) q""",
    # cells that hold points, and the first occupied ring around every base cell
    "v_occ": """
SELECT CAST(floor(lon) AS INT) AS pi, CAST(floor(-lat) AS INT) AS pj, count(*) AS points FROM fx_points GROUP BY ALL""",
    "v_rings": """
SELECT bi, bj, ring0, CAST(floor(sqrt(2) * (ring0 + 1) + 1) AS INT) + 1 AS rings FROM (
  SELECT bi, bj, min(greatest(abs(bi - pi), abs(bj - pj))) AS ring0 FROM v_base CROSS JOIN v_occ GROUP BY bi, bj) q""",
}

ORDERED = {**VIEWS, **SQL_VIEWS}
#: Views that twins compute once, so that a join on computed cells is not folded into the rest of a query.
ONCE = ("v_px", "v_cube", "v_win")


def _needs(text: str) -> list[str]:
    found = []
    for name in ORDERED:
        if re.search(rf"\b{name}\b", text):
            found.append(name)
    return found


def twin(sql: str) -> str:
    """Prefix a query with the fixture views it uses, as common table expressions."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...] = ()) -> None:
        for name in _needs(text):
            if name in seen or name in order:
                continue
            visit(ORDERED[name], (*seen, name))
            order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    views = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({re.sub(r'[{}]', '', ORDERED[n]).strip()})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


class Fixtures:
    """The fixture views of one scale-factor directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        tables = {t: self.table(t) for t in set(re.findall(r"{(\w+)}", text))}
        return self.spark.sql(text, **tables)

    @cached_property
    def layers(self) -> DataFrame:
        return self.view("fx_layers")

    @cached_property
    def raw_pixels(self) -> DataFrame:
        return self.view("fx_pixels")

    @cached_property
    def pixels(self) -> DataFrame:
        return clean_pixels(self.raw_pixels, self.layers)

    @cached_property
    def points(self) -> DataFrame:
        return self.view("fx_points")

    @cached_property
    def aoi(self) -> DataFrame:
        return self.view("fx_aoi")

    @cached_property
    def preds(self) -> DataFrame:
        return self.view("fx_preds")

    @cached_property
    def epoch_log(self) -> DataFrame:
        return self.view("fx_epoch_log")

    @cached_property
    def tile_parts(self) -> DataFrame:
        return self.view("fx_tile_parts")

    @cached_property
    def files(self) -> DataFrame:
        return self.view("fx_files")

    @cached_property
    def tiles(self) -> DataFrame:
        return self.view("fx_tiles")

    @cached_property
    def catalog(self) -> Catalog:
        return Catalog.of(self.layers)

    @cached_property
    def sized_catalog(self) -> Catalog:
        return Catalog.of(with_extent(self.layers, self.raw_pixels))

    @property
    def base(self) -> Layer:
        return self.catalog[0]

    @property
    def x_layers(self) -> Catalog:
        return self.catalog.without([0])
