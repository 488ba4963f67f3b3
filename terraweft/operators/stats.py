"""Statistics and normalisation of cubes and pyramids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweft.functions.scalars import equal_width_bin, order_hash, pearson_r
from terraweft.functions.scale import bounded
from terraweft.operators.align import weighted_mode


def channel_stats(cube_px: DataFrame, mode: str = "per", channel: str = "channel") -> DataFrame:
    """Mean and population standard deviation per channel, or of all channels together given to each (``global``)."""
    stats = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    if mode == "per":
        return cube_px.groupBy(channel).agg(*stats)
    # one pass: the channels' counts, means and spreads combine to those of all values
    per = cube_px.groupBy(channel).agg(F.count("value").alias("_n"), *stats)
    everything = Window.partitionBy()  # one row per channel
    n = F.sum("_n").over(everything)
    per = per.withColumn("_m", F.sum(F.col("_n") * F.col("mean")).over(everything) / n)
    spread = F.sum(F.col("_n") * (F.col("std") * F.col("std") + (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m")))).over(everything)
    return per.select(channel, F.col("_m").alias("mean"), F.sqrt(spread / n).alias("std"))


def layer_minmax(pyramid_px: DataFrame, splits: DataFrame, layer: str = "layer_id") -> DataFrame:
    """Layer minimum and maximum without test leakage: fold, layer, vmin, vmax.

    Values are reduced per (sample, layer) first, so the splits meet one row per window instead of its pixels. The
    combined row (fold NULL) covers everything but the test set, a fold row only its training samples.
    """
    per_window = pyramid_px.groupBy("sample_id", layer).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    used = splits.filter("role IN ('remaining', 'train')").select("sample_id", "fold")
    joined = per_window.join(used, "sample_id")
    return joined.groupBy("fold", layer).agg(F.min("_lo").alias("vmin"), F.max("_hi").alias("vmax"))


def combined_minmax(pyramid_px: DataFrame, layer: str = "layer_id") -> DataFrame:
    """Minimum and maximum per layer over all samples given."""
    return pyramid_px.groupBy(layer).agg(
        F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.count("value").alias("pixels")
    )


def minmax_norm(df: DataFrame, stats: DataFrame, fold: int | None, layer: str = "layer_id") -> DataFrame:
    """Scale values with the statistics of a fold, or with the combined ones (``fold=None``)."""
    own = stats.filter(F.col("fold").isNull() if fold is None else F.col("fold") == fold)
    joined = df.join(bounded(own.select(layer, "vmin", "vmax")), layer)
    width = F.col("vmax") - F.col("vmin")
    scaled = F.when(width != 0, (F.col("value") - F.col("vmin")) / width)
    return joined.withColumn("value", scaled).select(*df.columns)


def _with_stats(df: DataFrame, stats: DataFrame, channel: str, formula: Column) -> DataFrame:
    joined = df.join(bounded(stats.select(channel, "mean", "std")), channel)
    return joined.withColumn("value", formula).select(*df.columns)


def zscore(df: DataFrame, stats: DataFrame, channel: str = "channel") -> DataFrame:
    """Standardise values; channels without spread stay as they are."""
    v, m, s = F.col("value"), F.col("mean"), F.col("std")
    return _with_stats(df, stats, channel, F.when(s != 0, (v - m) / s).otherwise(v))


def unzscore(df: DataFrame, stats: DataFrame, channel: str = "channel") -> DataFrame:
    """Inverse of ``zscore``."""
    v, m, s = F.col("value"), F.col("mean"), F.col("std")
    return _with_stats(df, stats, channel, F.when(s != 0, v * s + m).otherwise(v))


def gaussian(keys: Sequence[str], seed: int) -> Column:
    """Standard normal number of a row, by its keys and the seed alone: Box-Muller on two 52-bit numbers of an md5 digest."""
    digest = order_hash(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), seed)
    part = lambda at: (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    return F.sqrt(-2.0 * F.log(part(1))) * F.cos(2.0 * math.pi * part(14))


def add_noise(df: DataFrame, level: float, seed: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Add Gaussian noise N(0, level) to every value.

    The noise of a row follows from its ``keys`` (all columns but value, unless given), so retries, other partitionings and
    other clusters give the same; rows with equal keys have equal noise.
    """
    keys = [c for c in df.columns if c != "value"] if keys is None else keys
    return df.withColumn("value", F.col("value") + gaussian(keys, seed) * level)


def channel_means(cube_px: DataFrame, keys: Sequence[str], channels: Sequence[int], prefix: str = "mean") -> DataFrame:
    """Feature vector of a sample: one mean per channel."""
    cols = [F.avg(F.when(F.col("channel") == c, F.col("value"))).alias(f"{prefix}_{c}") for c in channels]
    return cube_px.groupBy(*keys).agg(*cols)


def channel_mode(cube_px: DataFrame, keys: Sequence[str], channel: int) -> DataFrame:
    """Most frequent value of a channel per sample; ties go to the smallest value."""
    own = cube_px.filter((F.col("channel") == channel) & F.col("value").isNotNull())
    return weighted_mode(own.select(*keys, "value"), list(keys), "value")


def channel_hist(cube_px: DataFrame, bins: int = 101, channel: str = "channel") -> DataFrame:
    """Histogram per channel over its own range: value v falls in bin floor(100 * share of the range) for 101 bins."""
    known = cube_px.filter(F.col("value").isNotNull())
    ranges = known.groupBy(channel).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    joined = known.join(bounded(ranges), channel)
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    spot = F.when(F.col("hi") > F.col("lo"), F.floor(share * (bins - 1))).otherwise(0).cast("int")
    return joined.groupBy(channel, spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hist(df: DataFrame, col: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over the observed range, last bin closed: keys, bin, n."""
    known = df.filter(F.col(col).isNotNull())
    if keys:
        ranges = known.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        known = known.join(bounded(ranges), list(keys))
    else:
        known = known.withColumn("_r", known.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar())
        known = known.withColumns({"_lo": F.col("_r.lo"), "_hi": F.col("_r.hi")})
    spot = equal_width_bin(F.col(col), F.col("_lo"), F.col("_hi"), bins)
    return known.groupBy(*keys, spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def channel_target(cube_px: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of every channel's sample mean with the target: channel, samples, r."""
    means = cube_px.groupBy(*keys, "channel").agg(F.avg("value").alias("m")).filter("m IS NOT NULL")
    joined = means.join(samples.select(*keys, "y"), list(keys))
    return joined.groupBy("channel").agg(F.count(F.lit(1)).alias("samples"), pearson_r("m", "y").alias("r"))


def channel_target_pairs(cube_px: DataFrame, samples: DataFrame, keys: Sequence[str], channel: int) -> DataFrame:
    """Sample mean of a channel beside the target."""
    means = cube_px.filter(F.col("channel") == channel).groupBy(*keys).agg(F.avg("value").alias("x"))
    return means.join(samples.select(*keys, "y"), list(keys))
