"""Column selection, layouts and array assembly for sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_fields(df: DataFrame, keywords: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains a keyword, by keyword then position, renamed ``keyword_n``."""
    picked = []
    for word in keywords:
        matches = [c for c in df.columns if word in c]
        picked += [F.col(c).alias(f"{word}_{i}") for i, c in enumerate(matches)]
    return df.select(*keep, *picked)


def select_channels(
    df: DataFrame,
    keep: Sequence | None = None,
    drop: Sequence | None = None,
    channel: str = "channel",
) -> DataFrame:
    """Keep or drop channels, given by id or by name, of a long table."""
    if keep is not None:
        df = df.filter(F.col(channel).isin(list(keep)))
    if drop is not None:
        df = df.filter(~F.col(channel).isin(list(drop)))
    return df


def as_xy(df: DataFrame, x: Sequence[str], y: str, fmt: str = "both", keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Return format of a sample table: ``x``, ``y``, ``both`` or ``xx`` (features as their own target)."""
    if fmt == "x":
        return df.select(*keys, *x)
    if fmt == "y":
        return df.select(*keys, y)
    if fmt == "xx":
        return df.select(*keys, *x, *[F.col(c).alias(f"{c}_target") for c in x])
    return df.select(*keys, *x, y)


def to_arrays(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", name: str = "vals"
) -> DataFrame:
    """Long to array form: one row per key, values in the given order. Groups are the pixels of one window."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda e: e["_v"]).alias(name))


def to_long(df: DataFrame, side: int, name: str = "vals", value: str = "value") -> DataFrame:
    """Array to long form: adds si, sj, value for a row-major square array."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.posexplode(name).alias("_p", value)).select(
        *rest, F.floor(F.col("_p") / side).cast("int").alias("si"), (F.col("_p") % side).cast("int").alias("sj"), value
    )


def to_layout(df: DataFrame, layout: str, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Flat cube array per sample in ``hwc`` or ``chw`` order from long rows (si, sj, channel, value)."""
    order = {"hwc": ["si", "sj", "channel"], "chw": ["channel", "si", "sj"]}[layout]
    return to_arrays(df, keys, order, name="cube")


def flat_index(layout: str, side: int, channels: int) -> Column:
    """Position of (si, sj, channel) in the flat array of a layout; channel numbers start at 0."""
    si, sj, c = F.col("si"), F.col("sj"), F.col("channel")
    if layout == "hwc":
        return (si * side + sj) * channels + c
    return (c * side + si) * side + sj


def stack_cube(
    cube_px: DataFrame,
    channels: Sequence[int],
    names: Sequence[str],
    keys: Sequence[str] = ("bi", "bj", "si", "sj"),
    nearest: DataFrame | None = None,
    flag: Column | None = None,
) -> DataFrame:
    """One row per sub-pixel with a column per channel, and the nearest point with its fields if given.

    ``flag`` is a condition on the rows of ``cube_px``; a column of its name tells whether any channel of the sub-pixel meets it.
    """
    cols = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(n) for c, n in zip(channels, names, strict=True)]
    if flag is not None:
        cols.append(F.max(F.coalesce(flag, F.lit(False))).alias("flag"))
    wide = cube_px.groupBy(*keys).agg(*cols)
    return wide if nearest is None else nearest.join(wide, list(keys), "left")
