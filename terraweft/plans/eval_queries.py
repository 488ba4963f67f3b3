"""Errors, distributions and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweft.operators import evaluate, ml, mosaic, stats
from terraweft.operators.footprint import base_cells
from terraweft.operators.splits import index_by_first_seen
from terraweft.plans.cube_queries import cube_of
from terraweft.plans.registry import query
from terraweft.session import scratch_path
from terraweft.sources import datasets

SE = "(yhat - y) * (yhat - y)"


def r9(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("p24_errors", f"SELECT fold, sample_id, target, y, yhat, round(abs(yhat - y), 9) AS ae, round({SE}, 9) AS se FROM fx_preds")
def _(fx):
    return r9(evaluate.errors(fx.preds), "ae", "se")


OVERALL = f"SELECT fold, target, avg({SE}) AS mse, avg(abs(yhat - y)) AS mae FROM fx_preds GROUP BY fold, target"
SINGLE = f"SELECT fold, target, sample_id, avg({SE}) AS mse, avg(abs(yhat - y)) AS mae FROM fx_preds GROUP BY ALL"


@query(
    "a20_regression_error",
    f"""SELECT fold, target, sample_id, round(mse, 9) AS mse, round(mae, 9) AS mae FROM ({SINGLE}) s
        UNION ALL SELECT fold, target, NULL, round(mse, 9), round(mae, 9) FROM ({OVERALL}) o""",
)
def _(fx):
    return r9(evaluate.regression_error(fx.preds), "mse", "mae")


@query(
    "a21_pearson",
    "SELECT fold, target, round(r, 9) AS r, round(r * r, 9) AS r2 FROM (SELECT fold, target, corr(y, yhat) AS r FROM fx_preds GROUP BY ALL) q",
)
def _(fx):
    return r9(evaluate.pearson(fx.preds), "r", "r2")


@query(
    "a22_fold_summary",
    f"""SELECT target, round(avg(mse), 9) AS mean, round(min(mse), 9) AS min, round(max(mse), 9) AS max, arg_min(fold, mse) AS min_fold,
        arg_max(fold, mse) AS max_fold FROM ({OVERALL}) o GROUP BY target""",
)
def _(fx):
    overall = evaluate.regression_error(fx.preds).filter("sample_id IS NULL")
    return r9(evaluate.fold_summary(overall, "mse"), "mean", "min", "max")


# every epoch-log model gets the predictions of the samples it is numbered for
MODELS = "SELECT model, dense_rank() OVER (ORDER BY model) - 1 AS k FROM (SELECT DISTINCT model FROM fx_epoch_log) m"
TIMES = "SELECT model, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, round(min(val_loss), 9) AS best FROM fx_epoch_log GROUP BY model"


@query(
    "a23_compare_models",
    f"""SELECT model, round(avg({SE}) FILTER (WHERE target = 'wue'), 9) AS mse_wue, round(avg({SE}) FILTER (WHERE target = 'esi'), 9) AS mse_esi,
        round(avg({SE}) FILTER (WHERE target = 'agb'), 9) AS mse_agb, round(avg(abs(yhat - y)) FILTER (WHERE target = 'wue'), 9) AS mae_wue,
        round(avg(abs(yhat - y)) FILTER (WHERE target = 'esi'), 9) AS mae_esi, round(avg(abs(yhat - y)) FILTER (WHERE target = 'agb'), 9) AS mae_agb,
        any_value(seconds) AS seconds FROM fx_preds JOIN ({MODELS}) m ON sample_id % 5 = k JOIN ({TIMES}) t USING (model) GROUP BY model""",
)
def _(fx):
    names = fx.epoch_log.select("model").distinct()
    numbered = index_by_first_seen(names.withColumn("o", F.rank().over(_by_name())), "model", "o", "k").select("model", "k")
    scored = evaluate.errors(fx.preds).withColumn("k", (F.col("sample_id") % 5).cast("int")).join(numbered, "k")
    metrics = scored.select("model", "target", F.col("se").alias("mse"), F.col("ae").alias("mae"))
    out = evaluate.compare_models(metrics, fx.epoch_log, ["wue", "esi", "agb"])
    cols = [c for c in out.columns if c not in ("model", "seconds")]
    return r9(out, *cols).withColumn("seconds", F.round("seconds", 6))


def _by_name():
    from pyspark.sql import Window

    # one row per model
    return Window.orderBy("model")


@query("a24_best_over_training", TIMES)
def _(fx):
    out = evaluate.best_over_training(fx.epoch_log)
    return out.select("model", F.round("seconds", 6).alias("seconds"), F.round("best", 9).alias("best"))


@query("a25_training_curve", "SELECT model, epoch, round(avg(val_loss), 9) AS value FROM fx_epoch_log GROUP BY model, epoch")
def _(fx):
    return r9(evaluate.training_curve(fx.epoch_log), "value")


@query(
    "a26_error_distribution",
    f"""SELECT target, count(*) AS samples, round(avg(e), 9) AS mean, round(quantile_cont(e, 0.25), 9) AS q1, round(quantile_cont(e, 0.5), 9)
        AS median, round(quantile_cont(e, 0.75), 9) AS q3 FROM (SELECT target, sample_id, avg(mse) AS e FROM ({SINGLE}) s GROUP BY ALL) q
        GROUP BY target""",
)
def _(fx):
    single = evaluate.regression_error(fx.preds).filter("sample_id IS NOT NULL")
    return r9(evaluate.error_distribution(single, "target"), "mean", "q1", "median", "q3")


def _bin(v, lo, hi, n):
    return f"CAST(least(floor(({v} - {lo}) * {n} / ({hi} - {lo})), {n - 1}) AS INT)"


@query(
    "a17_hist2d",
    f"""SELECT target, {_bin("y", "ly", "hy", 200)} AS xb, {_bin("yhat", "lh", "hh", 200)} AS yb, count(*) AS n FROM fx_preds JOIN
        (SELECT target, min(y) AS ly, max(y) AS hy, min(yhat) AS lh, max(yhat) AS hh FROM fx_preds GROUP BY target) r USING (target) GROUP BY 1, 2, 3""",
)
def _(fx):
    return evaluate.hist2d(fx.preds, "y", "yhat", 200, keys=["target"])


@query(
    "a17_hist2d_fixed",
    f"""SELECT {_bin("y", "0E0", "2E0", 1000)} AS xb, {_bin("yhat", "0E0", "2E0", 1000)} AS yb, count(*) AS n FROM fx_preds
        WHERE y BETWEEN 0 AND 2 AND yhat BETWEEN 0 AND 2 GROUP BY 1, 2""",
)
def _(fx):
    return evaluate.hist2d(fx.preds, "y", "yhat", 1000, (0.0, 2.0))


@query(
    "a18_error_by_value",
    f"""SELECT target, CAST(b AS INT) AS bin, count(se) AS n, round(coalesce(avg(se), 0), 9) AS mse FROM (SELECT DISTINCT target FROM fx_preds) t
        CROSS JOIN range(0, 200) AS r(b) LEFT JOIN (SELECT target, {_bin("y", "ly", "hy", 200)} AS b, {SE} AS se FROM fx_preds JOIN
        (SELECT target, min(y) AS ly, max(y) AS hy FROM fx_preds GROUP BY target) g USING (target)) e USING (target, b) GROUP BY target, b""",
)
def _(fx):
    return r9(evaluate.error_by_value(fx.preds, 200), "mse")


@query(
    "a19_fraction_under",
    f"""SELECT target, CAST(s AS INT) AS step, round(s / 999.0E0, 9) AS threshold, round(count(*) FILTER (WHERE e < s / 999.0E0)
        / count(*), 9) AS share FROM (SELECT target, abs(yhat - y) AS e FROM fx_preds) q, range(0, 1000) AS r(s) GROUP BY target, s""",
)
def _(fx):
    return r9(evaluate.fraction_under(evaluate.errors(fx.preds), "ae", 1000, ["target"]), "threshold", "share")


@query(
    "w5_running_share",
    f"""SELECT target, CAST(s AS INT) AS step, round(s / 99.0E0, 9) AS threshold, round(count(*) FILTER (WHERE e < s / 99.0E0)
        / count(*), 9) AS share FROM (SELECT target, mse AS e FROM ({SINGLE}) z) q, range(0, 100) AS r(s) GROUP BY target, s""",
)
def _(fx):
    single = evaluate.regression_error(fx.preds).filter("sample_id IS NOT NULL")
    return r9(evaluate.fraction_under(single, "mse", 100, ["target"]), "threshold", "share")


@query("a15_hist_y", f"""SELECT {_bin("y", "ly", "hy", 10)} AS bin, count(*) AS n FROM fx_preds, (SELECT min(y) AS ly, max(y) AS hy FROM fx_preds) r GROUP BY 1""")
def _(fx):
    return stats.hist(fx.preds, "y", 10)


@query(
    "w4_epoch_times",
    """SELECT model, fold, epoch, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY model, fold ORDER BY epoch))) / 1e6, 0), 6)
       AS seconds FROM fx_epoch_log""",
)
def _(fx):
    return evaluate.epoch_times(fx.epoch_log).withColumn("seconds", F.round("seconds", 6))


@query("w4_elapsed", "SELECT model, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM fx_epoch_log GROUP BY model")
def _(fx):
    return evaluate.elapsed(fx.epoch_log).withColumn("seconds", F.round("seconds", 6))


@query(
    "a34_error_by_covariate",
    f"""SELECT fold, sample_id, target, CASE WHEN round(m, 4) BETWEEN -1e4 AND 1e4 THEN round(m, 4) END AS covariate, round({SE}, 9) AS se,
        round(abs(yhat - y), 9) AS ae FROM fx_preds JOIN (SELECT bj * 100 + bi AS sample_id, avg(value) AS m FROM v_cube WHERE channel = 4
        GROUP BY bi, bj) c USING (sample_id)""",
)
def _(fx):
    means = stats.channel_means(cube_of(fx), ["bi", "bj"], [4])
    flat = means.select((F.col("bj") * 100 + F.col("bi")).cast("bigint").alias("sample_id"), F.round("mean_4", 4).alias("m"))
    return r9(evaluate.error_by_covariate(fx.preds, flat, "m"), "se", "ae")


@query(
    "j14_to_grid",
    """SELECT target, CAST(bi + a.d AS INT) AS ix, CAST(bj + b.d AS INT) AS iy, arg_max(value, sample_id) AS value FROM (SELECT target, sample_id,
       max(y) AS value FROM fx_preds GROUP BY ALL) p JOIN (SELECT bj * 100 + bi AS sample_id, bi, bj FROM v_base) l USING (sample_id),
       (VALUES (0),(1)) AS a(d), (VALUES (0),(1)) AS b(d) GROUP BY 1, 2, 3""",
)
def _(fx):
    values = fx.preds.groupBy("target", "sample_id").agg(F.max("y").alias("value"))
    cells = base_cells(fx.pixels, fx.base)
    legal = cells.select((F.col("bj") * 100 + F.col("bi")).cast("bigint").alias("sample_id"), "bi", "bj")
    return mosaic.to_grid(values, legal, 2, keys=["target"])


def _parts(fx):
    a = fx.tile_parts.filter("file_order = 0")
    # shift some pixels of the second part back, so that equal, different and one-sided cells all occur
    b = fx.tile_parts.filter("file_order = 1").withColumn("value", F.col("value") - F.when(F.col("iy") % 2 == 0, 1.0).otherwise(0.5))
    return a, b


DIFF = """SELECT ix, iy, a.value AS a, b.value AS b FROM (SELECT * FROM fx_tile_parts WHERE file_order = 0) a
  FULL JOIN (SELECT ix, iy, value - CASE WHEN iy % 2 = 0 THEN 1 ELSE 0.5E0 END AS value FROM fx_tile_parts WHERE file_order = 1) b USING (ix, iy)
  WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) >= 0.001"""


@query("j15_dataset_diff", DIFF)
def _(fx):
    return mosaic.dataset_diff(*_parts(fx), ["ix", "iy"])


@query("j15_diff_summary", f"SELECT count(*) AS differing_cells, count(DISTINCT ix) AS differing_samples FROM ({DIFF}) d")
def _(fx):
    return mosaic.diff_summary(mosaic.dataset_diff(*_parts(fx), ["ix", "iy"]), ["ix"])


@query("u3_merge_runs", "SELECT target, fold, count(*) AS n, round(avg(y), 9) AS mean FROM fx_preds GROUP BY ALL")
def _(fx):
    runs = [fx.preds.filter("fold = 0"), fx.preds.filter("fold > 0").select("target", "fold", "sample_id", "yhat", "y")]
    merged = evaluate.merge_runs(runs)
    return merged.groupBy("target", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 9).alias("mean"))


@query("s14_metric_tables", f"SELECT fold, target, round(mse, 9) AS mse, round(mae, 9) AS mae FROM ({OVERALL}) o")
def _(fx):
    path = scratch_path(fx.spark, "metrics")
    overall = evaluate.regression_error(fx.preds).filter("sample_id IS NULL").drop("sample_id")
    datasets.write_table(r9(overall, "mse", "mae"), path)
    return datasets.read_table(fx.spark, path)


@query("m11_select_targets", "SELECT fold, sample_id, target, y, yhat FROM fx_preds WHERE target IN ('wue', 'agb')")
def _(fx):
    return ml.select_targets(fx.preds, ["wue", "agb"])
