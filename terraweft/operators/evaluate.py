"""Error measures, distributions and comparisons of predictions and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweft.functions.scalars import equal_width_bin, pearson_r
from terraweft.functions.scale import bounded, exact_quantiles
from terraweft.session import cut_lineage


def _error() -> Column:
    return F.col("yhat") - F.col("y")


def errors(preds: DataFrame) -> DataFrame:
    """Add the absolute (ae) and squared (se) error of every prediction."""
    return preds.withColumns({"ae": F.abs(_error()), "se": _error() * _error()})


def regression_error(preds: DataFrame, keys: Sequence[str] = ("fold", "target")) -> DataFrame:
    """MSE and MAE per sample and overall in one pass: keys, sample_id (NULL = overall), mse, mae."""
    sets = errors(preds).groupingSets([[*keys, "sample_id"], list(keys)], *keys, "sample_id")
    return sets.agg(F.avg("se").alias("mse"), F.avg("ae").alias("mae"))


def pearson(preds: DataFrame, keys: Sequence[str] = ("fold", "target")) -> DataFrame:
    """Pearson r and r squared of target and prediction."""
    return preds.groupBy(*keys).agg(pearson_r("y", "yhat").alias("r")).withColumn("r2", F.col("r") * F.col("r"))


def fold_summary(metrics: DataFrame, value: str, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Mean, minimum, maximum over folds and the folds that reach them (lowest fold on ties)."""
    lowest = F.min(F.struct(F.col(value), F.col("fold")))
    highest = F.max(F.struct(F.col(value), (-F.col("fold")).alias("neg")))
    out = metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), lowest.alias("_l"), highest.alias("_h"))
    return out.select(
        *keys,
        "mean",
        F.col(f"_l.{value}").alias("min"),
        F.col(f"_h.{value}").alias("max"),
        F.col("_l.fold").alias("min_fold"),
        (-F.col("_h.neg")).cast("int").alias("max_fold"),
    )


def _seconds(span: str) -> str:
    """SQL of the length of a day-time interval in seconds."""
    return (
        f"(extract(DAY FROM {span}) * 86400 + extract(HOUR FROM {span}) * 3600 "
        f"+ extract(MINUTE FROM {span}) * 60 + double(extract(SECOND FROM {span})))"
    )


LASTED = _seconds("(max(ts) - min(ts))")


def elapsed(epoch_log: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Seconds between the first and the last record."""
    return epoch_log.groupBy(*keys).agg(F.expr(f"{LASTED} AS seconds"))


def epoch_times(epoch_log: DataFrame, keys: Sequence[str] = ("model", "fold")) -> DataFrame:
    """Seconds since the previous epoch; 0 for the first."""
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("epoch"))
    steps = epoch_log.select(*keys, "epoch", (F.col("ts") - before).alias("_d"))
    return steps.selectExpr(*keys, "epoch", f"coalesce({_seconds('_d')}, 0D) AS seconds")


def compare_models(
    metrics: DataFrame, epoch_log: DataFrame, targets: Sequence[str], values: Sequence[str] = ("mse", "mae")
) -> DataFrame:
    """One row per model: the mean of every metric per target, and the elapsed time."""
    means = [
        F.avg(F.when(F.col("target") == t, F.col(v))).alias(f"{v}_{t}") for v in values for t in targets
    ]
    return metrics.groupBy("model").agg(*means).join(elapsed(epoch_log), "model", "left")


def best_over_training(epoch_log: DataFrame, value: str = "val_loss") -> DataFrame:
    """Best value over all epochs per model, with the elapsed time."""
    return epoch_log.groupBy("model").agg(F.min(value).alias("best"), F.expr(f"{LASTED} AS seconds"))


def training_curve(epoch_log: DataFrame, value: str = "val_loss") -> DataFrame:
    """Training curve averaged over folds."""
    return epoch_log.groupBy("model", "epoch").agg(F.avg(value).alias("value"))


def error_distribution(metrics: DataFrame, key: str, value: str = "mse") -> DataFrame:
    """Per model: number of samples, mean and quartiles of the per-sample error averaged over folds."""
    per_sample = cut_lineage(metrics.groupBy(key, "sample_id").agg(F.avg(value).alias("e")))
    base = per_sample.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.avg("e").alias("mean"))
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    cuts = exact_quantiles(per_sample, [key], "e", list(names))
    wide = cuts.groupBy(key).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()])
    return base.join(wide, key)


def hist2d(
    df: DataFrame, x: str, y: str, bins: int, limits: tuple[float, float] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Two-dimensional histogram over the observed ranges or fixed limits: keys, xb, yb, n; outside values are dropped."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if limits is not None:
        lo, hi = (F.lit(float(v)) for v in limits)
        known = known.filter(F.col(x).between(lo, hi) & F.col(y).between(lo, hi))
        xb, yb = (equal_width_bin(F.col(c), lo, hi, bins) for c in (x, y))
        return known.groupBy(*keys, xb.alias("xb"), yb.alias("yb")).agg(F.count(F.lit(1)).alias("n"))
    ends = [f(c).alias(f"_{side}{axis}") for side, f in (("lo", F.min), ("hi", F.max)) for axis, c in (("x", x), ("y", y))]
    known = _with_ranges(known, ends, keys)
    xb, yb = (equal_width_bin(F.col(c), F.col(f"_lo{a}"), F.col(f"_hi{a}"), bins) for a, c in (("x", x), ("y", y)))
    return known.groupBy(*keys, xb.alias("xb"), yb.alias("yb")).agg(F.count(F.lit(1)).alias("n"))


def _with_ranges(df: DataFrame, ends: list[Column], keys: Sequence[str]) -> DataFrame:
    if keys:
        return df.join(bounded(df.groupBy(*keys).agg(*ends)), list(keys))
    return df.withColumn("_r", df.agg(F.struct(*ends)).scalar()).select("*", "_r.*").drop("_r")


def error_by_value(preds: DataFrame, bins: int, key: str = "target") -> DataFrame:
    """Mean squared error per equal-width bin of the true value; empty bins have error 0: key, bin, n, mse."""
    ends = [F.min("y").alias("_lo"), F.max("y").alias("_hi")]
    spot = equal_width_bin(F.col("y"), F.col("_lo"), F.col("_hi"), bins)
    binned = _with_ranges(errors(preds), ends, [key]).groupBy(key, spot.alias("bin"))
    filled = binned.agg(F.count(F.lit(1)).alias("n"), F.avg("se").alias("mse"))
    every = preds.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(filled, [key, "bin"], "left")
    return out.select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mse", F.lit(0.0)).alias("mse"))


def fraction_under(df: DataFrame, col: str, steps: int, keys: Sequence[str]) -> DataFrame:
    """Share of rows below each of ``steps`` thresholds evenly spaced over [0, 1]: keys, step, threshold, share.

    One histogram over the thresholds and a running sum replace a scan per threshold.
    """
    last = steps - 1
    # first threshold that is greater than the value; values of 1 and more are below none
    first = F.floor(F.col(col) * last) + 1
    first = F.when(F.col(col) < (first - 1) / last, first - 1).when(F.col(col) >= first / last, first + 1).otherwise(first)
    spot = F.greatest(F.least(first, F.lit(steps)), F.lit(0)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, spot.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    grid = totals.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(last))))
    run = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(counts, [*keys, "step"], "left").withColumn("_c", F.sum(F.coalesce("n", F.lit(0))).over(run))
    return filled.select(
        *keys, "step", (F.col("step") / last).alias("threshold"), (F.col("_c") / F.col("total")).alias("share")
    )


def rmse_psnr(df: DataFrame, keys: Sequence[str], max_val: float = 1.0) -> DataFrame:
    """RMSE and peak signal-to-noise ratio of reconstructed tiles (columns truth and recon)."""
    mse = F.avg((F.col("recon") - F.col("truth")) * (F.col("recon") - F.col("truth")))
    out = df.groupBy(*keys).agg(mse.alias("_m"))
    ratio = F.when(F.col("_m") > 0, 10 * F.log10(F.lit(max_val * max_val) / F.col("_m")))
    return out.select(*keys, F.sqrt("_m").alias("rmse"), ratio.alias("psnr"))


def error_by_covariate(preds: DataFrame, covariates: DataFrame, col: str, lo: float = -1e4, hi: float = 1e4) -> DataFrame:
    """Squared and absolute error of every sample beside a covariate; values outside [lo, hi] become NULL."""
    value = F.when(F.col(col).between(lo, hi), F.col(col)).alias("covariate")
    return errors(preds).join(covariates.select("sample_id", col), "sample_id").select(
        *[c for c in preds.columns if c not in ("y", "yhat")], value, "se", "ae"
    )


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Fold results of separate runs as one table."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out
