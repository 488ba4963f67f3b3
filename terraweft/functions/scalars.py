"""Scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_outside(col: Column, lo: float, hi: float) -> Column:
    """NULL for values outside [lo, hi]."""
    return F.when(col.between(lo, hi), col)


def null_nodata(value: Column, nodata: Column | float | None) -> Column:
    """NULL where a pixel is NaN or equals the nodata value of its layer."""
    known = ~F.isnan(value)
    if nodata is not None:
        known = known & ~value.eqNullSafe(nodata)
    return F.when(known, value)


def reset_nodata(value: Column, old: float | None, new: float) -> Column:
    """Replace NaN and the old nodata value by a new nodata value."""
    hit = F.isnan(value) if old is None else F.isnan(value) | (value == F.lit(old))
    return F.when(hit, F.lit(new)).otherwise(value)


def log_counts(count: Column) -> Column:
    """Natural log of a count; 0 stays 0."""
    return F.when(count != 0, F.log(count)).otherwise(F.lit(0.0))


def class_from_name(name: Column) -> Column:
    """Class of a file: every word of its base name but the last."""
    base = F.element_at(F.split(name, "/"), -1)
    words = F.split(base, " ")
    return F.array_join(F.slice(words, 1, F.size(words) - 1), " ")


def order_hash(ident: Column, seed: int | str) -> Column:
    """Repeatable random order of ids: md5 of ``id:seed``, equal in any engine."""
    return F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}")).cast("binary"))


def hash_int(digest: Column, digits: int = 4) -> Column:
    """Leading hex digits of a digest as an integer."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of an equal-width histogram whose last bin is closed; everything is bin 0 when lo = hi."""
    raw = F.floor((value - lo) * bins / (hi - lo))
    return F.when(hi > lo, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def range_sql(low: str, high: str) -> str:
    """SQL generator of one row per integer from low to high; none if low > high."""
    return f"explode(CASE WHEN int({low}) <= int({high}) THEN sequence(int({low}), int({high})) END)"


def pearson_r(x: str, y: str) -> Column:
    """Aggregate Pearson correlation over pairs without NULL; NULL where a side does not vary."""
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return F.expr(f"covar_pop({x}, {y}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0D)")
