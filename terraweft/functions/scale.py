"""Building blocks that keep plans safe at scale: checked broadcasts, salted joins, ranks without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweft.functions.scalars import hash_int, order_hash
from terraweft.session import cut_lineage

BROADCAST_ROWS = 200_000
#: Left rows of a key beyond which a join spreads it over tasks.
HOT_ROWS = 1_000_000
SPLITS = 8
#: Distinct values of a quantile's bracket that one task sorts.
SORTED_ROWS = 65_536
#: Bins of a round that narrows such brackets.
BINS = 1024


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if it is shown to have at most ``rows`` rows; else leave it to a shuffle.

    A side that qualifies is computed once, for the check and for the join.
    """
    head = cut_lineage(df.limit(rows + 1))
    return F.broadcast(head) if head.count() <= rows else df


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    splits: int | None = None,
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join whose left side may hold one key in most of its rows; the right side must be short per key.

    Keys with more than ``hot_rows`` left rows are spread over as many tasks as they fill, and only their right rows are repeated. The keys are
    counted (``counts`` has them as ``_n`` if the caller knows them). ``splits`` instead spreads every key over that many tasks without a
    count, for sides that are joined many times. Valid for inner, left, left_semi and left_anti joins.
    """
    digest = F.xxhash64(*left.columns)
    if splits is not None:
        spread = left.withColumn("_salt", F.pmod(digest, F.lit(splits)).cast("int"))
        copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        return spread.join(copies, [*on, "_salt"], how).drop("_salt")
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_parts")
    hot = cut_lineage(counts.filter(F.col("_n") > hot_rows).select(*on, parts))
    if hot.isEmpty():
        return left.join(right, list(on), how)
    hot = bounded(hot)
    own = F.coalesce(F.col("_parts"), F.lit(1))
    spread = left.join(hot, list(on), "left").withColumn("_salt", F.pmod(digest, own).cast("int")).drop("_parts")
    copies = right.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1))).drop("_parts")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows to a table that is unique on ``on`` and possibly much larger.

    The distinct keys are counted and matched first, so the table is shuffled once and never repeated; only what matches hot keys is
    repeated for the salted join back.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hits = table.join(counts.select(*on), list(on), "left_semi")
    return salted_join(rows, hits, on, how, counts=counts)


def _running_total(counts: DataFrame, group: Sequence[str], coarse: str) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def bucket_rank(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column],
    name: str = "rank",
    group: Sequence[str] = (),
    coarser: Column | None = None,
) -> DataFrame:
    """1-based rank in (bucket, order) order without sorting everything in one task.

    ``bucket`` must be a coarse form of the order. Only the bucket counts, a short table, see a global window. Where the buckets grow with
    the data, ``coarser``, a coarse form of the bucket, gathers them: then only its counts see a global window.
    """
    keyed = df.withColumn("_b", bucket)
    if coarser is None:
        counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
        starts = _running_total(counts, group, "_b").drop("_n")
    else:
        counts = keyed.groupBy(*group, coarser.alias("_s"), "_b").agg(F.count(F.lit(1)).alias("_n"))
        tops = _running_total(counts.groupBy(*group, "_s").agg(F.sum("_n").alias("_n")), group, "_s")
        tops = tops.select(*group, "_s", F.col("_before").alias("_top"))
        inner = _running_total(counts, [*group, "_s"], "_b").join(tops, [*group, "_s"])
        starts = inner.select(*group, "_b", (F.col("_before") + F.col("_top")).alias("_before"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = keyed.withColumn("_in", F.row_number().over(inside)).join(starts, [*group, "_b"])
    return ranked.withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def hash_rank(df: DataFrame, ident: str, seed: int | str, name: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """1-based rank of unique ids in their repeatable random order."""
    keyed = df.withColumn("_h", order_hash(F.col(ident), seed))
    return bucket_rank(keyed, hash_int(F.col("_h")), [F.col("_h"), F.col(ident)], name, group).drop("_h")


def take_quota(
    df: DataFrame, coarse: Column, order: Sequence[Column], quota: Column | int, flag: str, group: Sequence[str] = ()
) -> DataFrame:
    """Flag the first ``quota`` rows of each group in (coarse, order) order.

    Rows in coarse steps that fit entirely are taken without a sort; only the one step that the quota cuts is ranked.
    """
    keyed = df.withColumns({"_c": coarse, "_q": F.lit(quota) if isinstance(quota, int) else quota})
    counts = keyed.groupBy(*group, "_c").agg(F.count(F.lit(1)).alias("_n"))
    steps = _running_total(counts, group, "_c")
    keyed = keyed.join(steps, [*group, "_c"])
    left = F.col("_q") - F.col("_before")
    cut = (left > 0) & (left < F.col("_n"))
    helpers = ["_c", "_q", "_n", "_before"]
    whole = keyed.filter(~cut).withColumn(flag, left >= F.col("_n")).drop(*helpers)
    inside = Window.partitionBy(*group, "_c").orderBy(*order)
    part = keyed.filter(cut).withColumn(flag, F.row_number().over(inside) <= left).drop(*helpers)
    return whole.unionByName(part)


def take_random(df: DataFrame, ident: str, quota: Column | int, seed: int | str, flag: str) -> DataFrame:
    """Flag the first ``quota`` rows in the repeatable random order of ``ident``."""
    keyed = df.withColumn("_h", order_hash(F.col(ident), seed))
    order = [F.col("_h"), F.col(ident)]
    return take_quota(keyed, hash_int(F.col("_h")), order, quota, flag).drop("_h")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 100_000, sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """Exact linear-interpolated quantiles per (non-empty) group: columns group..., prob, quantile.

    A sketch brackets every quantile and counting places the bracket. Rounds of histograms narrow the brackets of all groups at once, until
    none has more than ``sorted_rows`` distinct values; only these are sorted.
    """
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.col(value).alias("_v"))
    # the margin around a quantile covers the error of the sketch and, in small groups, a few ranks
    margins = [m for m in (1e-5, 1e-4, 1e-3, 1e-2, 1e-1) if m >= 10.0 / accuracy] + [1.0]
    asked = sorted({min(max(p + s * m, 0.0), 1.0) for p in probs for m in margins for s in (-1, 1)})
    at = {q: i for i, q in enumerate(asked)}
    sketch = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", asked, accuracy).alias("_s"),
    )

    def edge(p: float, sign: int, end: str) -> str:
        picks = ""
        for m in margins:
            q = min(max(p + sign * m, 0.0), 1.0)
            value = end if q in (0.0, 1.0) else f"_s[{at[q]}]"
            picks += f" WHEN _n * {m!r}D >= 3 THEN {value}"
        return f"CASE{picks} ELSE {end} END"

    structs = ", ".join(
        f"struct({float(p)!r}D AS prob, {edge(p, -1, '_min')} AS _lo, {edge(p, 1, '_max')} AS _hi)" for p in probs
    )
    brackets = sketch.selectExpr(*group, "_n", f"inline(array({structs}))")
    spot = brackets.withColumn("_pos", F.col("prob") * (F.col("_n") - 1))
    # every value meets the few brackets of its group; values above a bracket drop out, those below are only counted
    met = df.join(bounded(spot), list(group))
    cols = [*group, "prob", "_pos"]
    slim = met.filter("_v <= _hi").withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
    counts = cut_lineage(slim.groupBy(*cols, "_v").agg(F.count(F.lit(1)).alias("_c")))
    below = counts.groupBy(*cols).agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"))
    # the two values around a position, as ranks inside the bracket
    ends = below.selectExpr(*cols, "_below", "inline(array(struct(false AS _up, floor(_pos) AS _rank), struct(true AS _up, ceil(_pos) AS _rank)))")
    ends = bounded(ends.select(*cols, "_up", (F.col("_rank") - F.col("_below")).alias("_rank")))
    keys = [*cols, "_up"]
    found = _at_ranks(counts.filter("_v IS NOT NULL").join(ends, cols), keys, sorted_rows)
    out = found.groupBy(*cols).agg(F.min(F.when(~F.col("_up"), F.col("_v"))).alias("_lo"), F.min(F.when(F.col("_up"), F.col("_v"))).alias("_hi"))
    step = F.col("_pos") - F.floor("_pos")
    return out.select(*group, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * step).alias("quantile"))


def _at_ranks(rows: DataFrame, keys: Sequence[str], sorted_rows: int) -> DataFrame:
    """The value at the 0-based ``_rank`` of each key, among distinct values ``_v`` that occur ``_c`` times: keys, _v.

    A round counts values in equal bins between the least and the greatest and keeps the bin that the rank falls in.
    """
    while True:
        sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        if sizes.filter(F.col("_n") > sorted_rows).isEmpty():
            break
        # halves keep the width of the bracket finite
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        whole = (F.col("_n") <= sorted_rows) | (F.col("_hi") / 2 == F.col("_lo") / 2)
        binned = rows.join(bounded(sizes), list(keys)).withColumn("_bin", F.when(whole, 0).otherwise(F.floor(share * (BINS - 1))).cast("int"))
        per_bin = binned.groupBy(*keys, "_rank", "_bin").agg(F.sum("_c").alias("_n"))
        ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        chosen = per_bin.withColumn("_ahead", ahead).filter((F.col("_ahead") <= F.col("_rank")) & (F.col("_rank") < F.col("_ahead") + F.col("_n")))
        kept = binned.join(bounded(chosen.select(*keys, "_bin", "_ahead")), [*keys, "_bin"])
        rows = cut_lineage(kept.select(*keys, "_v", "_c", (F.col("_rank") - F.col("_ahead")).alias("_rank")))
    end = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_end", end).filter(F.col("_end") > F.col("_rank")).groupBy(*keys).agg(F.min("_v").alias("_v"))
