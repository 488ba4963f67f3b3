"""Regression baselines on channel means."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweft.functions.scalars import pearson_r
from terraweft.operators import evaluate, ml, resample, splits, stats, training
from terraweft.operators.footprint import base_cells
from terraweft.operators.tiles import block_means
from terraweft.plans.registry import near, query
from terraweft.session import cut_lineage, scratch_path

SCALES = {"mean_1": 1e5, "mean_2": 1e5, "mean_3": 100.0, "mean_4": 1e4}
FEATURES = list(SCALES)
FOLDS = (0, 1, 2)


def features_of(fx):
    """Scaled channel means of every base cell as features, the scaled base value as target."""
    samples = resample.number_samples(base_cells(fx.pixels, fx.base))
    px = resample.resample_nearest(samples.select("sample_id", "bi", "bj"), fx.pixels, fx.base, fx.x_layers, 2)
    means = stats.channel_means(px, ["sample_id"], [1, 2, 3, 4])
    scaled = means.select("sample_id", *[(F.col(c) / s).alias(c) for c, s in SCALES.items()])
    target = samples.select("sample_id", (F.col("y") / 1e5).alias("y"))
    return cut_lineage(target.join(scaled, "sample_id").dropna())


def folds_of(data):
    return splits.random_split(data, folds=3, test_frac=0.2, val_frac=0.25, seed=4)


def scores(fx, name, folds=FOLDS, features=FEATURES, **params):
    data = features_of(fx)
    preds, _ = ml.cross_validate(data, folds_of(data), name, features, folds, **params)
    return _score(preds)


def beats_mean(fx, name, **params):
    """For models without a closed form, per fold and role: rows scored, the error of the training mean, and whether the model's is smaller
    on the rows it learned from, and within twice of it on the others (the features tell little about the target)."""
    data = features_of(fx)
    table = cut_lineage(folds_of(data))
    preds = None
    for fold in FOLDS:
        own = data.join(table.filter(F.col("fold") == fold).select("sample_id", "fold", "role"), "sample_id")
        train = own.filter("role = 'train'")
        mean = train.agg(F.avg("y")).scalar()
        out = ml.predict(ml.fit(name, train.drop("fold", "role"), FEATURES, **params), own, ("fold", "role")).withColumn("m", mean)
        preds = out if preds is None else preds.unionByName(out)
    base, error = (F.col("y") - F.col("m")) * (F.col("y") - F.col("m")), (F.col("yhat") - F.col("y")) * (F.col("yhat") - F.col("y"))
    scored = preds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("samples"), F.avg(base).alias("base"), F.avg(error).alias("mse"))
    limit = F.when(F.col("role") == "train", F.col("base")).otherwise(2 * F.col("base"))
    return scored.select(F.lit(name).alias("model"), "fold", "role", "samples", near("base").alias("base_mse"), (F.col("mse") < limit).alias("better"))


def _score(preds):
    scored = evaluate.errors(preds)
    return scored.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg("se"), 4).alias("mse"),
        F.round(F.avg("ae"), 4).alias("mae"),
        F.round(pearson_r("y", "yhat"), 4).alias("r"),
    )


# the same samples, features and folds in SQL; z1 to z4 are the features
Z = [f"z{k}" for k in range(1, 5)]
SETUP = f"""
WITH feat AS (SELECT * FROM (SELECT sample_id, y / 1e5 AS y, {", ".join(f"avg(value) FILTER (WHERE channel = {k}) / {scale!r} AS z{k}" for k, scale in enumerate(SCALES.values(), 1))}
  FROM (SELECT row_number() OVER (ORDER BY bi, bj) - 1 AS sample_id, * FROM v_base) s JOIN v_cube USING (bi, bj) GROUP BY ALL) q
  WHERE {" AND ".join(f"{z} IS NOT NULL" for z in Z)}),
ranked AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat(sample_id, ':4')), sample_id) AS r, count(*) OVER () AS n FROM feat),
folded AS (SELECT sample_id, fold, row_number() OVER (PARTITION BY fold ORDER BY md5(concat(sample_id, ':4:', fold)), sample_id) AS r,
  n - ceil(round(n * 0.2E0, 9)) AS n FROM ranked CROSS JOIN (VALUES (0),(1),(2)) AS f(fold) WHERE r > ceil(round(n * 0.2E0, 9))),
used AS (SELECT fold, r <= ceil(round(n * 0.25E0, 9)) AS val, feat.* FROM folded JOIN feat USING (sample_id))"""
SCORED = """SELECT '{model}' AS model, CAST(fold AS INT) AS fold, count(*) AS samples, round(avg((yhat - y) * (yhat - y)), 4) AS mse,
  round(avg(abs(yhat - y)), 4) AS mae, round(corr(y, yhat), 4) AS r FROM ({preds}) p WHERE fold IN ({folds}) GROUP BY fold"""


def _moments(rows: str, diagonal: str = "0", centred: bool = True) -> str:
    """Products of every feature (i) with every feature and the target (j = 5), averaged over the centred columns or summed as they are."""
    of = "covar_pop({}, {})" if centred else "sum({} * {})"
    pairs = [f"SELECT fold, {i} AS i, {j} AS j, {of.format(a, b)}{f' + {diagonal}' if i == j else ''} AS v FROM {rows} GROUP BY fold" for i, a in enumerate(Z, 1) for j, b in enumerate([*Z, "y"], 1)]
    return " UNION ALL ".join(pairs)


def _solved(moments: str) -> str:
    """Coefficients (fold, z1 ... z4 as w1 ... w4): elimination of one row of the normal equations after the other."""
    step = """SELECT r.fold, r.i, r.j, CASE WHEN r.i = {k} THEN r.v / p.v ELSE r.v - a.v * q.v / p.v END AS v FROM e{before} r JOIN e{before} p ON p.fold = r.fold AND p.i = {k} AND p.j = {k}
      JOIN e{before} q ON q.fold = r.fold AND q.i = {k} AND q.j = r.j JOIN e{before} a ON a.fold = r.fold AND a.i = r.i AND a.j = {k}"""
    parts = [f"e0 AS MATERIALIZED ({moments})", *[f"e{k} AS MATERIALIZED ({step.format(k=k, before=k - 1)})" for k in range(1, 5)]]
    return f"WITH {', '.join(parts)} SELECT fold, {', '.join(f'max(v) FILTER (WHERE i = {k} AND j = 5) AS w{k}' for k in range(1, 5))} FROM e4 GROUP BY fold"


TRAIN = "(SELECT * FROM used WHERE NOT val)"
CENTRES = f"SELECT fold, avg(y) AS my, {', '.join(f'avg({z}) AS m{k}' for k, z in enumerate(Z, 1))} FROM {{rows}} GROUP BY fold"


def _least_squares(penalty: str = "0", weights: str | None = None) -> str:
    """Predictions of least squares with intercept on all features, with an L2 penalty on the coefficients."""
    weights = weights or _solved(_moments(TRAIN, penalty))
    return f"""SELECT u.fold, sample_id, u.y, my + {' + '.join(f'w{k} * ({z} - m{k})' for k, z in enumerate(Z, 1))} AS yhat
      FROM used u JOIN ({CENTRES.format(rows=TRAIN)}) m USING (fold) JOIN ({weights}) w USING (fold) WHERE val"""


def _lasso(alpha: float, sweeps: int = 400) -> str:
    """Coefficients by coordinate descent on the moments, one sweep over the features per step."""
    def moment(i: int, j: int) -> str:
        return f"max(v) FILTER (WHERE i = {i} AND j = {j}) AS v{i}{j}"

    table = f"SELECT fold, {', '.join(moment(i, j) for i in range(1, 5) for j in range(1, 6))} FROM ({_moments(TRAIN)}) m GROUP BY fold"
    state = "SELECT * FROM lasso"
    for k in range(1, 5):
        others = " - ".join([f"v{k}5", *[f"v{k}{j} * w{j}" for j in range(1, 5) if j != k]])
        keep = ", ".join(f"w{j}" for j in range(1, 5) if j != k)
        moments = ", ".join(f"v{i}{j}" for i in range(1, 5) for j in range(1, 6))
        state = f"SELECT fold, n, {moments}, {keep}, sign({others}) * greatest(abs({others}) - {alpha!r}, 0) / v{k}{k} AS w{k} FROM ({state}) s{k}"
    columns = ", ".join([f"v{i}{j}" for i in range(1, 5) for j in range(1, 6)] + [f"w{k}" for k in range(1, 5)])
    first = f"SELECT fold, 0 AS n, *  EXCLUDE (fold), {', '.join(f'0E0 AS w{k}' for k in range(1, 5))} FROM ({table}) t"
    return f"""WITH RECURSIVE lasso AS (SELECT fold, n, {columns} FROM ({first}) f UNION ALL SELECT fold, n + 1, {columns} FROM ({state}) s WHERE n < {sweeps})
      SELECT fold, w1, w2, w3, w4 FROM lasso WHERE n = {sweeps}"""


def _twin(model: str, preds: str, folds: str = "0, 1, 2") -> str:
    return SETUP + SCORED.format(model=model, preds=preds, folds=folds)


def _beats(model: str) -> str:
    return f"""{SETUP} SELECT '{model}' AS model, CAST(u.fold AS INT) AS fold, CASE WHEN val THEN 'val' ELSE 'train' END AS role, count(*) AS samples,
      near(avg((y - m) * (y - m))) AS base_mse, TRUE AS better
      FROM used u JOIN (SELECT fold, avg(y) AS m FROM used WHERE NOT val GROUP BY fold) k USING (fold) GROUP BY u.fold, val"""


KERNEL = f"""SELECT u.fold, sample_id, u.y, {' + '.join(f'w{k} * {z}' for k, z in enumerate(Z, 1))} AS yhat FROM used u
  JOIN ({_solved(_moments(TRAIN, "0.2", centred=False))}) w USING (fold) WHERE val"""
COMPONENT = """SELECT fold, sample_id, y, my + slope * (t - mt) AS yhat FROM (SELECT u.*, u.z1 * va + u.z2 * vb AS t, my, ma * va + mb * vb AS mt,
  (cya * va + cyb * vb) / (saa * va * va + 2 * sab * va * vb + sbb * vb * vb) AS slope FROM used u JOIN (SELECT *, sab AS va,
    (saa + sbb) / 2 + sqrt((saa - sbb) * (saa - sbb) / 4 + sab * sab) - saa AS vb FROM (SELECT fold, avg(y) AS my, avg(z1) AS ma, avg(z2) AS mb, var_pop(z1) AS saa,
      var_pop(z2) AS sbb, covar_pop(z1, z2) AS sab, covar_pop(y, z1) AS cya, covar_pop(y, z2) AS cyb FROM used WHERE NOT val GROUP BY fold) m) k USING (fold) WHERE val) q"""
# ridge on 1, sqrt(2) b, b^2, the terms of (b b' + 1)^2, solved by Cramer's rule
POLYNOMIAL = """SELECT fold, sample_id, y, ((g0 * (m11 * m22 - m12 * m12) - m01 * (g1 * m22 - g2 * m12) + m02 * (g1 * m12 - g2 * m11))
    + p * (m00 * (g1 * m22 - g2 * m12) - g0 * (m01 * m22 - m02 * m12) + m02 * (m01 * g2 - m02 * g1))
    + b * b * (m00 * (m11 * g2 - m12 * g1) - m01 * (m01 * g2 - m02 * g1) + g0 * (m01 * m12 - m02 * m11)))
    / (m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02)) AS yhat
  FROM (SELECT *, z2 AS b, sqrt(2) * z2 AS p FROM used) u JOIN (SELECT fold, count(*) + 0.2 AS m00, sum(p) AS m01, sum(b * b) AS m02, sum(p * p) + 0.2 AS m11, sum(p * b * b) AS m12,
    sum(b * b * b * b) + 0.2 AS m22, sum(y) AS g0, sum(y * p) AS g1, sum(y * b * b) AS g2 FROM (SELECT *, z2 AS b, sqrt(2) * z2 AS p FROM used) z WHERE NOT val GROUP BY fold) k
  USING (fold) WHERE val"""
ALL_ROWS = "(SELECT 0 AS fold, * FROM feat)"
FULL_FIT = f"""{SETUP} SELECT sample_id, y, round(my + {' + '.join(f'w{k} * ({z} - m{k})' for k, z in enumerate(Z, 1))}, 6) AS yhat
  FROM feat, ({CENTRES.format(rows=ALL_ROWS)}) m, ({_solved(_moments(ALL_ROWS))}) w"""


@query("m1_linear", _twin("linear", _least_squares()))
def _(fx):
    return scores(fx, "linear")


@query("m2_ridge", _twin("ridge", _least_squares("0.05")))
def _(fx):
    return scores(fx, "ridge", alpha=0.05)


@query("m2_ridge_by_descent", f"SELECT model, fold, samples, round(mse, 2) AS mse, round(mae, 2) AS mae, TRUE AS close FROM ({_twin('sgd', _least_squares('0.05'))}) t")
def _(fx):
    """Mini-batch descent against the closed form: scores, and whether every prediction is within a hundredth of it."""
    data = features_of(fx)
    folds = cut_lineage(folds_of(data))
    descent, _ = ml.cross_validate(data, folds, "sgd", FEATURES, FOLDS, alpha=0.05, epochs=200, together=50, seed=3)
    closed, _ = ml.cross_validate(data, folds, "ridge", FEATURES, FOLDS, alpha=0.05)
    descent = cut_lineage(descent)
    both = descent.join(closed.select("fold", "sample_id", F.col("yhat").alias("closed")), ["fold", "sample_id"])
    close = both.groupBy("fold").agg((F.max(F.abs(F.col("yhat") - F.col("closed"))) < 0.01).alias("close"))
    found = _score(descent).join(close, "fold")
    return found.select("model", "fold", "samples", F.round("mse", 2).alias("mse"), F.round("mae", 2).alias("mae"), "close")


@query("m3_lasso", _twin("lasso", _least_squares(weights=_lasso(0.002))))
def _(fx):
    return scores(fx, "lasso", alpha=0.002)


# regression on the first principal component of two features, and on all components of all features
@query("m4_pca_lr", _twin("pca_lr", COMPONENT))
def _(fx):
    return scores(fx, "pca_lr", features=FEATURES[:2], k=1)


@query("m4_pca_lr_all_components", _twin("pca_lr", _least_squares()))
def _(fx):
    return scores(fx, "pca_lr", k=4)


@query("m5_random_forest", _beats("rf"))
def _(fx):
    return beats_mean(fx, "rf", trees=20, depth=8)


@query("m6_gradient_boosting", _beats("gbt"))
def _(fx):
    return beats_mean(fx, "gbt", rounds=10, depth=3)


@query("m7_kernel_ridge_linear", _twin("kernel_ridge", KERNEL))
def _(fx):
    return scores(fx, "kernel_ridge", kernel="linear", alpha=0.2)


@query("m7_kernel_ridge_polynomial", _twin("kernel_ridge", POLYNOMIAL))
def _(fx):
    return scores(fx, "kernel_ridge", features=["mean_2"], kernel="polynomial", alpha=0.2, degree=2)


@query("m7_kernel_ridge_rbf", _beats("kernel_ridge"))
def _(fx):
    return beats_mean(fx, "kernel_ridge", kernel="rbf", alpha=0.2, landmarks=512)


@query("m8_cross_validate", "SELECT *, TRUE AS timed FROM (" + _twin("linear", _least_squares()) + ") t")
def _(fx):
    data = features_of(fx)
    preds, times = ml.cross_validate(data, folds_of(data), "linear", FEATURES, FOLDS)
    timed = times.select("model", "fold", (F.col("train_seconds") > 0).alias("timed"))
    return _score(preds).join(timed, ["model", "fold"])


@query("m9_predict", FULL_FIT)
def _(fx):
    data = features_of(fx)
    return ml.predict(ml.fit("linear", data, FEATURES), data).withColumn("yhat", F.round("yhat", 6))


@query("m10_save_load", FULL_FIT)
def _(fx):
    data = features_of(fx)
    path = scratch_path(fx.spark, "model")
    ml.save_model(ml.fit("linear", data, FEATURES), path)
    return ml.predict(ml.load_model(path), data).withColumn("yhat", F.round("yhat", 6))


RESUMED = f"SELECT *, CASE WHEN fold = 0 THEN 'loaded' ELSE 'fitted' END AS origin, TRUE AS logged FROM ({_twin('linear', _least_squares())}) t"


class Stopped(RuntimeError):
    """A run that is stopped from outside."""


@query("m10_resume", RESUMED)
def _(fx):
    """A run over three folds that is stopped after the first and started again: what was loaded, what fitted, and the scores."""
    data = features_of(fx)
    table, path = cut_lineage(folds_of(data)), scratch_path(fx.spark, "run")

    def stop(fold):
        raise Stopped(fold)

    try:
        training.train_folds(data, table, "linear", FEATURES, FOLDS, path, after=stop)
    except Stopped:
        pass
    preds, ledger = training.train_folds(data, table, "linear", FEATURES, FOLDS, path)
    return _score(preds).join(ledger.select("model", "fold", "origin", (F.col("train_seconds") > 0).alias("logged")), ["model", "fold"])


@query(
    "m12_reconstruction_study",
    """SELECT method, count(DISTINCT tile_id) * 4 AS samples, TRUE AS better, TRUE AS consistent FROM fx_tiles, (VALUES ('nearest'), ('weighted')) AS m(method)
       WHERE tile_id % 2 = 1 GROUP BY method""",
)
def _(fx):
    """Blocks held out, whether the error is below the spread of the block means, and whether psnr follows from rmse."""
    out = ml.reconstruction_study(fx.tiles, 2, 4, 8)
    truth = block_means(fx.tiles.filter("tile_id % 2 = 1").select("tile_id", "r", "c", "value"), 4)
    spread = truth.agg(F.stddev_pop("label").alias("spread"), (F.max("label")).alias("top"))
    joined = out.crossJoin(F.broadcast(spread))  # one row
    return joined.select("method", "samples", (F.col("rmse") < F.col("spread")).alias("better"), (F.col("psnr").isNotNull() & (F.col("rmse") > 0)).alias("consistent"))
