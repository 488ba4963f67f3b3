"""Regression baselines by name, k-fold driver, predictions and reconstruction study on Spark ML."""

from __future__ import annotations

import functools
import itertools
import math
import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from terraweft.catalog import literal_rows
from terraweft.operators.descent import descend, linear_stage
from terraweft.operators.evaluate import rmse_psnr
from terraweft.operators.kernel import RbfModel, fit_rbf
from terraweft.operators.tiles import block_means, stride, sub_blocks, upsample_nearest, upsample_weighted
from terraweft.session import cut_lineage

FEATURES = "features"
COLS = {"labelCol": "y", "featuresCol": FEATURES, "predictionCol": "yhat"}


def _assemble(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES)


def linear(cols: Sequence[str]) -> list:
    return [_assemble(cols), LinearRegression(regParam=0.0, **COLS)]


def ridge(cols: Sequence[str], alpha: float = 1e-4, spread: float = 1.0) -> list:
    """Minimises 1/(2n) |y - Xw - b|^2 + alpha/2 |w|^2. ``spread`` is the standard deviation of the target, by which the
    solver divides its L2 penalty (but not the L1 penalty)."""
    return [_assemble(cols), LinearRegression(regParam=alpha * spread, elasticNetParam=0.0, standardization=False, **COLS)]


def lasso(cols: Sequence[str], alpha: float = 0.2) -> list:
    return [_assemble(cols), LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, **COLS)]


def pca_lr(cols: Sequence[str], k: int = 2) -> list:
    reduce = PCA(k=k, inputCol="raw_features", outputCol=FEATURES)
    return [VectorAssembler(inputCols=list(cols), outputCol="raw_features"), reduce, LinearRegression(**COLS)]


def forest(cols: Sequence[str], trees: int = 1000, depth: int = 30, seed: int = 0) -> list:
    return [_assemble(cols), RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **COLS)]


def boosting(cols: Sequence[str], rounds: int = 1000, depth: int = 3, rate: float = 0.1, seed: int = 0) -> list:
    return [_assemble(cols), GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **COLS)]


def _mapped(expressions: Sequence[str]) -> SQLTransformer:
    named = ", ".join(f"{e} AS _k{i}" for i, e in enumerate(expressions))
    return SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__")


def polynomial_terms(cols: Sequence[str], degree: int, gamma: float, coef0: float) -> list[str]:
    """Feature map of the kernel (gamma x.z + coef0)^degree as SQL expressions."""
    scaled = [f"({math.sqrt(gamma)!r}D * `{c}`)" for c in cols] + [f"{math.sqrt(coef0)!r}D"]
    terms = []
    for pick in itertools.combinations_with_replacement(range(len(scaled)), degree):
        ways = math.factorial(degree)
        for i in set(pick):
            ways //= math.factorial(pick.count(i))
        terms.append(" * ".join([f"{math.sqrt(ways)!r}D", *[scaled[i] for i in pick]]))
    return terms


def kernel_ridge(
    cols: Sequence[str],
    kernel: str = "linear",
    alpha: float = 1.0,
    rows: int = 1,
    spread: float = 1.0,
    degree: int = 3,
    gamma: float | None = None,
    coef0: float = 1.0,
) -> list:
    """Kernel ridge as ridge on explicit features: |y - Xw|^2 + alpha |w|^2 without intercept. The rbf kernel has none; see ``kernel.fit_rbf``.

    ``rows`` and ``spread`` are the number of training rows and the standard deviation of their target.
    """
    gamma = gamma or 1.0 / len(cols)
    if kernel == "linear":
        terms = [f"`{c}`" for c in cols]
    elif kernel == "polynomial":
        terms = polynomial_terms(cols, degree, gamma, coef0)
    else:
        raise ValueError(f"unknown kernel {kernel}")
    solver = LinearRegression(
        regParam=alpha / rows * spread, elasticNetParam=0.0, standardization=False, fitIntercept=False, **COLS
    )
    return [_mapped([f"_sign * {t}" for t in terms]), _assemble([f"_k{i}" for i in range(len(terms))]), solver]


def fit_descent(df: DataFrame, features: Sequence[str], label: str = "y", **params) -> tuple[PipelineModel, list[float]]:
    """Ridge by mini-batch descent (see ``descent.descend``): the model and its loss per epoch."""
    weights, losses = descend(df, features, label, **params)
    return PipelineModel([linear_stage(features, weights)]), losses


MODELS: dict[str, Callable[..., list]] = {
    "linear": linear,
    "ridge": ridge,
    "lasso": lasso,
    "pca_lr": pca_lr,
    "rf": forest,
    "gbt": boosting,
    "kernel_ridge": kernel_ridge,
}


def fit(name: str, df: DataFrame, features: Sequence[str], label: str = "y", **params) -> PipelineModel | RbfModel:
    """Fit a model by name on the feature columns. ``kernel_ridge`` has the rbf kernel unless another is named."""
    if name == "kernel_ridge" and params.get("kernel", "rbf") == "rbf":
        return fit_rbf(df, features, label, **{k: v for k, v in params.items() if k != "kernel"})
    if name == "sgd":
        return fit_descent(df, features, label, **params)[0]
    data = df.withColumnRenamed(label, "y") if label != "y" else df
    if name == "kernel_ridge":
        # turning the sign of a row and its target leaves the loss as it is, but lets the solver see the constant
        # feature, which it would otherwise drop for want of variance
        sign = F.when(F.pmod(F.xxhash64("y", *features), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        data = data.withColumn("_sign", sign).withColumn("y", F.col("y") * F.col("_sign"))
    if name in ("ridge", "kernel_ridge"):
        size = data.agg(F.count(F.lit(1)).alias("rows"), F.stddev_pop("y").alias("spread")).first()
        params["spread"] = size["spread"] or 1.0
        if name == "kernel_ridge":
            params["rows"] = size["rows"]
    return Pipeline(stages=MODELS[name](features, **params)).fit(data)


def predict(model: PipelineModel | RbfModel, df: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Predictions as a table: keys, y, yhat."""
    return model.transform(df.withColumn("_sign", F.lit(1.0))).select(*keys, "y", "yhat")


def save_model(model: PipelineModel | RbfModel, path: str, override: bool = False) -> None:
    if isinstance(model, RbfModel):
        model.save(SparkSession.active(), path, override)
        return
    writer = model.write().overwrite() if override else model.write()
    writer.save(path)


def load_model(path: str) -> PipelineModel | RbfModel:
    """A saved model; a pipeline has a folder of metadata, a kernel model is a table."""
    spark = SparkSession.active()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    return RbfModel.load(spark, path)


def select_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows of the chosen targets of a multi-target table."""
    return df.filter(F.col("target").isin(list(targets)))


def cross_validate(
    df: DataFrame, splits: DataFrame, name: str, features: Sequence[str], folds: Sequence[int], parallelism: int = 4, **params
) -> tuple[DataFrame, DataFrame]:
    """Fit on train and predict on val for every fold: (predictions, fit times).

    Predictions: model, fold, sample_id, y, yhat. Times: model, fold, train_seconds (wall clock). Up to ``parallelism`` folds are fitted at once.
    """
    spark = df.sparkSession
    data = cut_lineage(df.select("sample_id", "y", *features).dropna())
    used = cut_lineage(splits.filter("role IN ('train', 'val')").select("sample_id", "fold", "role"))

    def one(fold: int) -> tuple[DataFrame, dict]:
        own = used.filter(F.col("fold") == fold)
        train = data.join(own.filter("role = 'train'"), "sample_id", "left_semi")
        val = data.join(own.filter("role = 'val'"), "sample_id", "left_semi")
        begin = time.perf_counter()
        model = fit(name, train, features, **params)
        seconds = time.perf_counter() - begin
        out = predict(model, val).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "sample_id", "y", "yhat")
        return out, {"model": name, "fold": fold, "train_seconds": seconds}

    tasks = [inheritable_thread_target(spark)(functools.partial(one, fold)) for fold in folds]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        done = pool.map(lambda task: task(), tasks)
    return functools.reduce(DataFrame.unionByName, [out for out, _ in done]), literal_rows(spark, [times for _, times in done])


def reconstruction_study(tiles: DataFrame, k: int, m: int, side: int, trees: int = 20, depth: int = 8, seed: int = 0) -> DataFrame:
    """How well blocks of reconstructed tiles predict the mean of the true block: method, samples, rmse, psnr.

    Tiles are thinned by k and rebuilt by repetition and by weighted blending; a forest learns on half of the tiles.
    """
    truth = tiles.select("tile_id", "r", "c", "value")
    small = stride(truth, k)
    labels = cut_lineage(block_means(truth, m))
    recon = {"nearest": upsample_nearest(small, k), "weighted": upsample_weighted(small, k, side // k, side // k)}
    out = None
    for method, rebuilt in recon.items():
        blocks = sub_blocks(rebuilt, m).join(labels, ["tile_id", "br", "bc"])
        data = cut_lineage(
            blocks.select("tile_id", "br", "bc", F.col("label").alias("y"), array_to_vector("features").alias(FEATURES))
        )
        model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **COLS).fit(data.filter("tile_id % 2 = 0"))
        held = model.transform(data.filter("tile_id % 2 = 1")).select(F.col("y").alias("truth"), F.col("yhat").alias("recon"))
        n = held.agg(F.count(F.lit(1))).scalar()
        scored = rmse_psnr(held.withColumn("method", F.lit(method)), ["method"]).withColumn("samples", n)
        out = scored if out is None else out.unionByName(scored)
    return out
