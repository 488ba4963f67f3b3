"""Orders, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweft.functions.geo import unravel
from terraweft.operators import resample, splits, stats
from terraweft.operators.footprint import base_cells
from terraweft.plans.raster_queries import legal_of, pyramid_of, splits_of
from terraweft.plans.registry import query
from terraweft.session import cut_lineage, scratch_path
from terraweft.sources import datasets


def ids_of(fx):
    return fx.table("orders").select(F.col("o_orderkey").alias("sample_id"))


POSITIONS = "SELECT o_orderkey AS sample_id, row_number() OVER (ORDER BY md5(concat(o_orderkey, ':5')), o_orderkey) - 1 AS position FROM orders"


@query("l1_shuffle", POSITIONS)
def _(fx):
    return splits.shuffle(ids_of(fx), "sample_id", 5)


@query(
    "l1_shuffle_cells",
    """SELECT bi, bj, pos_i, pos_j FROM v_base JOIN
       (SELECT bi, row_number() OVER (ORDER BY md5(concat(bi, ':5:i')), bi) - 1 AS pos_i FROM (SELECT DISTINCT bi FROM v_base) a) i USING (bi)
       JOIN (SELECT bj, row_number() OVER (ORDER BY md5(concat(bj, ':5:j')), bj) - 1 AS pos_j FROM (SELECT DISTINCT bj FROM v_base) b) j
       USING (bj)""",
)
def _(fx):
    return splits.shuffle_cells(base_cells(fx.pixels, fx.base).select("bi", "bj"), 5)


@query("l2_take_first", "SELECT bi, bj, y FROM v_base ORDER BY bi, bj LIMIT 500")
def _(fx):
    return splits.take_first(base_cells(fx.pixels, fx.base), ["bi", "bj"], 500)


@query("l3_subsample", f"SELECT sample_id FROM ({POSITIONS}) p WHERE position < 1000")
def _(fx):
    return splits.subsample(ids_of(fx), "sample_id", 1000, 5)


BATCHES = f"SELECT sample_id, position // 128 AS batch FROM ({POSITIONS}) p"


@query("w2_batch_ids", BATCHES)
def _(fx):
    return splits.batch_ids(ids_of(fx), "sample_id", 128, 5)


@query("l4_batches_in_order", BATCHES)
def _(fx):
    return splits.batches_in_order(splits.batch_ids(ids_of(fx), "sample_id", 128, 5))


@query("r1_random_split", "SELECT sample_id, fold, role FROM v_splits")
def _(fx):
    return splits_of(legal_of(fx))


FLOOR_SPLIT = """
WITH ids AS (SELECT o_orderkey AS sample_id FROM orders),
ranked AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat(sample_id, ':9')), sample_id) AS r, count(*) OVER () AS n FROM ids),
folded AS (SELECT sample_id, fold, row_number() OVER (PARTITION BY fold ORDER BY md5(concat(sample_id, ':9:', fold)), sample_id) AS r,
  n - floor(round(n * 0.25E0, 9)) AS n FROM ranked CROSS JOIN (VALUES (0),(1)) AS f(fold) WHERE r > floor(round(n * 0.25E0, 9)))
SELECT sample_id, CAST(NULL AS INT) AS fold, CASE WHEN r <= floor(round(n * 0.25E0, 9)) THEN 'test' ELSE 'remaining' END AS role FROM ranked
UNION ALL
SELECT sample_id, fold, CASE WHEN r <= floor(round(n * 0.15E0, 9)) THEN 'val' ELSE 'train' END FROM folded"""


def _floor_split(fx):
    return splits.random_split(ids_of(fx), folds=2, test_frac=0.25, val_frac=0.15, seed=9, rounding="floor")


@query("r2_full_random_split", FLOOR_SPLIT)
def _(fx):
    return _floor_split(fx)


@query("r6_cell_split", f"SELECT fold, role, sample_id // 100 AS r, sample_id % 100 AS c FROM ({FLOOR_SPLIT}) s")
def _(fx):
    r, c = unravel(F.col("sample_id"), 100)
    return _floor_split(fx).select("fold", "role", r.alias("r"), c.alias("c"))


@query(
    "r5_dilate",
    """SELECT bi, bj FROM v_base b WHERE NOT EXISTS (SELECT 1 FROM v_base t WHERE t.y > 490000
       AND abs(t.bi - b.bi) <= 2 AND abs(t.bj - b.bj) <= 2)""",
)
def _(fx):
    cells = base_cells(fx.pixels, fx.base)
    return splits.free_cells(cells.select("bi", "bj"), cells.filter("y > 490000"), 2)


REGIONS, TEST, VAL, BUFFER, FOLDS, SEED = 16, 0.2, 0.1, 2, 2, 3


def _blocks(fx, method="tiles"):
    legal = cut_lineage(legal_of(fx))
    out, marks = splits.block_split_with_seeds(legal, REGIONS, (TEST, VAL), buffer=BUFFER, folds=FOLDS, seed=SEED, method=method)
    return cut_lineage(out), marks, legal


def _contract(out, legal):
    """Sizes per set and region, with how many of the ids are different, legal, and in the sets they must be in."""
    out = out.withColumn("in_rest", F.col("role") != "test")
    rest = out.filter("role = 'remaining'").select("sample_id", F.lit(1).alias("r"))
    known = out.join(legal.select("sample_id", F.lit(1).alias("l")), "sample_id", "left").join(rest, "sample_id", "left")
    sized = known.groupBy("role", "fold", "region").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("different"), F.count("l").alias("legal"), F.count("r").alias("in_rest")
    )
    # ids of a fold that are in both of its sets
    both = out.filter("fold IS NOT NULL").groupBy("fold", "sample_id").count().filter("count > 1")
    twice = both.groupBy("fold").agg(F.count(F.lit(1)).alias("twice"))
    return sized.join(twice, "fold", "left").withColumn("twice", F.coalesce("twice", F.lit(0)))


CONTRACT = f"""
WITH n AS (SELECT count(*) AS n, CAST(floor(count(*) * {TEST}E0) AS BIGINT) AS t, CAST(floor(count(*) * {VAL}E0) AS BIGINT) AS v FROM v_legal),
regions AS (SELECT unnest(range({REGIONS})) AS region),
folds AS (SELECT unnest(range({FOLDS})) AS fold),
sets AS (
  SELECT 'test' AS role, CAST(NULL AS INT) AS fold, CAST(region AS INT) AS region, (region + 1) * t // {REGIONS} - region * t // {REGIONS} AS n FROM regions, n
  UNION ALL SELECT 'val', CAST(fold AS INT), CAST(region AS INT), (region + 1) * v // {REGIONS} - region * v // {REGIONS} FROM regions, folds, n
  UNION ALL SELECT 'remaining', NULL, NULL, n - t FROM n
  UNION ALL SELECT 'train', CAST(fold AS INT), NULL, n - t - v FROM folds, n)
SELECT role, fold, region, n, n AS different, n AS legal, CASE WHEN role = 'test' THEN 0 ELSE n END AS in_rest, 0 AS twice FROM sets WHERE n > 0"""


@query("r3_spatial_block_split", CONTRACT)
def _(fx):
    out, _, legal = _blocks(fx)
    return _contract(out, legal)


@query(
    "r3_block_sizes",
    f"""SELECT role, fold, CAST(floor(n * share) AS BIGINT) AS wanted, CAST(floor(n * share) AS BIGINT) AS reached FROM (SELECT count(*) AS n FROM v_legal) l,
        (SELECT 'test' AS role, CAST(NULL AS INT) AS fold, {TEST}E0 AS share UNION ALL
         SELECT 'val', CAST(fold AS INT), {VAL}E0 FROM (SELECT unnest(range({FOLDS})) AS fold) f) s""",
)
def _(fx):
    out, _, legal = _blocks(fx)
    sizes = splits.split_shortfall(out, legal, (TEST, VAL))
    return sizes.withColumn("wanted", F.col("wanted").cast("bigint"))


# seeds of each set: all placed, none within the buffer of a block placed before it
SEEDS = f"""SELECT role, fold, count(*) AS regions, CAST(sum(n) AS BIGINT) AS wanted, {BUFFER} AS least_apart, 0 AS nearer, TRUE AS apart
    FROM ({CONTRACT}) c WHERE role IN ('test', 'val') GROUP BY role, fold"""


def _seed_facts(fx, method):
    """The report of the seeds; ``apart`` measures the distances anew, between seeds and the cells that the split gave to regions before theirs."""
    out, marks, legal = _blocks(fx, method)
    marks = cut_lineage(marks)
    key = ["role", "fold", "region"]
    known = marks.fillna(-1, ["fold"])
    cells = out.filter("region IS NOT NULL").fillna(-1, ["fold"]).join(legal.select("sample_id", "bi", "bj"), "sample_id")
    cells = cells.join(known.select(*key, F.col("turn").alias("before")), key).select("role", "fold", "bi", "bj", "before")
    step = F.explode(F.sequence(F.lit(-BUFFER), F.lit(BUFFER)))
    spots = known.select("role", "fold", "si", "sj", "turn").withColumn("di", step).withColumn("dj", step)
    spots = spots.select("role", "fold", "turn", (F.col("si") + F.col("di")).alias("bi"), (F.col("sj") + F.col("dj")).alias("bj"))
    met = spots.join(cells, ["role", "fold", "bi", "bj"]).filter("before < turn").groupBy("role", "fold").agg(F.count(F.lit(1)).alias("met"))
    report = splits.seed_report(known).drop("least_clear").join(met, ["role", "fold"], "left")
    return report.withColumn("apart", F.col("met").isNull()).drop("met").withColumn("fold", F.when(F.col("fold") >= 0, F.col("fold")))


@query("r3_seed_report", SEEDS)
def _(fx):
    return _seed_facts(fx, "tiles")


@query("r4_seed_report", SEEDS)
def _(fx):
    return _seed_facts(fx, "reject")


@query("r4_rejection_block_split", CONTRACT)
def _(fx):
    out, _, legal = _blocks(fx, "reject")
    return _contract(out, legal)


@query(
    "w6_grow_block",
    """WITH seeds AS (SELECT * FROM (VALUES (0, 20, 40, 60), (1, 60, 8, 45)) AS s(region, si, sj, quota)),
       near AS (SELECT sample_id, region, quota, greatest(abs(bi - si), abs(bj - sj)) AS ring FROM v_legal CROSS JOIN seeds),
       owned AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ring, region) AS o FROM near),
       inner_cells AS (SELECT region, count(*) AS n FROM owned WHERE o = 1 AND ring <= 3 GROUP BY region)
       SELECT region, least(quota, l.n) AS n, least(quota, l.n) AS different, least(quota, coalesce(i.n, 0)) AS within_three
       FROM seeds LEFT JOIN inner_cells i USING (region), (SELECT count(*) AS n FROM v_legal) l""",
)
def _(fx):
    legal = cut_lineage(legal_of(fx))
    seeds = fx.spark.createDataFrame([(0, 20, 40, 60, 1, -1), (1, 60, 8, 45, 1, -1)], "region int, si int, sj int, quota long, oi int, oj int")
    grown = splits.grow_blocks(legal, seeds, 12)
    centre = F.when(F.col("region") == 0, F.greatest(F.abs(F.col("bi") - 20), F.abs(F.col("bj") - 40))).otherwise(
        F.greatest(F.abs(F.col("bi") - 60), F.abs(F.col("bj") - 8))
    )
    return grown.withColumn("ring", centre).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("different"), F.count(F.when(F.col("ring") <= 3, 1)).alias("within_three")
    )


def _legal_splits(fx):
    legal = cut_lineage(legal_of(fx))
    return legal, cut_lineage(splits_of(legal))


@query(
    "j11_fold_view",
    """SELECT sample_id, y, layer_id, wi, wj, value FROM v_splits JOIN v_legal USING (sample_id) JOIN v_base USING (bi, bj)
       JOIN v_pyr USING (sample_id) WHERE role = 'val' AND fold = 1""",
)
def _(fx):
    legal, px = pyramid_of(fx)
    samples = legal.join(base_cells(fx.pixels, fx.base), ["bi", "bj"]).select("sample_id", "y")
    return splits.fold_view(samples, splits_of(legal), px, 1, "val")


@query(
    "j11_test_view",
    """SELECT sample_id, y, count(value) AS pixels FROM v_splits JOIN v_legal USING (sample_id) JOIN v_base USING (bi, bj)
       JOIN v_pyr USING (sample_id) WHERE role = 'test' GROUP BY ALL""",
)
def _(fx):
    legal, px = pyramid_of(fx)
    samples = legal.join(base_cells(fx.pixels, fx.base), ["bi", "bj"]).select("sample_id", "y")
    per = px.groupBy("sample_id").agg(F.count("value").alias("pixels"))
    return splits.fold_view(samples, splits_of(legal), per, 0, "test")


@query("j12_train_ids", "SELECT sample_id, fold FROM v_splits WHERE role = 'train'")
def _(fx):
    return splits.train_ids(_legal_splits(fx)[1])


@query("u5_remaining", "SELECT sample_id FROM v_splits WHERE role = 'remaining'")
def _(fx):
    legal, table = _legal_splits(fx)
    return splits.remaining_ids(legal, table.filter("role = 'test'"))


@query("u2_combine_roles", "SELECT DISTINCT sample_id FROM v_splits WHERE role IN ('train', 'val') AND fold = 1")
def _(fx):
    return splits.combine_roles(_legal_splits(fx)[1], ["train", "val"], 1)


@query("u2_all_roles", "SELECT DISTINCT sample_id FROM v_splits WHERE role = 'test' OR fold = 1")
def _(fx):
    return splits.combine_roles(_legal_splits(fx)[1], ["train", "val", "test"], 1)


@query(
    "a27_split_counts",
    """SELECT role, CAST(NULL AS INT) AS fold, count(*) AS n FROM v_splits GROUP BY role
       UNION ALL SELECT role, fold, count(*) FROM v_splits WHERE fold IS NOT NULL GROUP BY role, fold""",
)
def _(fx):
    return splits.split_counts(_legal_splits(fx)[1])


@query("s6_split_files", "SELECT sample_id, fold, role FROM v_splits")
def _(fx):
    path = scratch_path(fx.spark, "splits")
    datasets.write_splits(splits_of(legal_of(fx)), path)
    return datasets.read_splits(fx.spark, path)


@query("s7_stats_files", "SELECT layer_id, min(value) AS vmin, max(value) AS vmax, count(value) AS pixels FROM v_pyr GROUP BY layer_id")
def _(fx):
    path = scratch_path(fx.spark, "stats")
    datasets.write_table(stats.combined_minmax(pyramid_of(fx)[1]), path)
    return datasets.read_table(fx.spark, path)


@query("s7_legal_files", "SELECT sample_id, bi, bj FROM v_legal")
def _(fx):
    path = scratch_path(fx.spark, "legal")
    datasets.write_table(resample.legal_samples(fx.pixels, fx.base, fx.catalog), path)
    return datasets.read_table(fx.spark, path)


CLASSES = "SELECT file_id, array_to_string(list_slice(string_split(fname, ' '), 1, len(string_split(fname, ' ')) - 1), ' ') AS class FROM fx_files"


def classes_of(fx):
    from terraweft.functions.scalars import class_from_name

    return fx.files.select("file_id", class_from_name(F.col("fname")).alias("class"))


@query(
    "w1_index_by_first_seen",
    f"""SELECT class, first_seen, CAST(dense_rank() OVER (ORDER BY first_seen) - 1 AS INT) AS class_index FROM (SELECT class, min(file_id)
        AS first_seen FROM ({CLASSES}) c GROUP BY class) q""",
)
def _(fx):
    return splits.index_by_first_seen(classes_of(fx), "class", "file_id")


@query(
    "f7_first_k_classes",
    f"""SELECT file_id, class FROM ({CLASSES}) a WHERE class IN (SELECT class FROM ({CLASSES}) c GROUP BY class ORDER BY min(file_id) LIMIT 3)""",
)
def _(fx):
    return splits.first_k_classes(classes_of(fx), "class", "file_id", 3).select("file_id", "class")


@query("a28_class_counts", f"SELECT class, count(*) AS n FROM ({CLASSES}) c GROUP BY class")
def _(fx):
    return stats.class_counts(classes_of(fx), "class")
