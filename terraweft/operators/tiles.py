"""Cutting, striding, upsampling and padding of tiles held as (tile_id, r, c, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.catalog import Layer
from terraweft.functions.scalars import hash_int, order_hash
from terraweft.operators.tables import to_arrays


def cut_tiles(pixels: DataFrame, layers: Sequence[Layer], extent_m: int, start: int, count: int) -> DataFrame:
    """Paired tiles: ``count`` x ``count`` blocks of ``extent_m`` metres, the same ground in every layer.

    Columns: tile_id, layer_id, r, c, value. A pixel finds its tile by division; nothing is joined.
    """
    parts = []
    for layer in layers:
        side = extent_m // layer.res_m
        own = pixels.filter(F.col("layer_id") == layer.layer_id)
        # tiles start on multiples of the extent, rounded down to whole pixels
        for axis, at in (("ix", "r"), ("iy", "c")):
            k = F.floor((F.col(axis) + 1) * layer.res_m / extent_m)
            k = F.when(F.floor(k * extent_m / layer.res_m) > F.col(axis), k - 1).otherwise(k)
            own = own.withColumn(f"_t{at}", k)
            own = own.withColumn(at, (F.col(axis) - F.floor(k * extent_m / layer.res_m)).cast("int"))
        inside = (F.col("r") < side) & (F.col("c") < side)
        for at in ("r", "c"):
            inside = inside & F.col(f"_t{at}").between(start, start + count - 1)
        tile = ((F.col("_tr") - start) * count + F.col("_tc") - start).cast("bigint").alias("tile_id")
        parts.append(own.filter(inside).select(tile, "layer_id", "r", "c", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stride(tiles: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column."""
    kept = tiles.filter((F.col("r") % k == 0) & (F.col("c") % k == 0))
    return kept.withColumns({"r": F.floor(F.col("r") / k).cast("int"), "c": F.floor(F.col("c") / k).cast("int")})


def _spread(tiles: DataFrame, k: int) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    return tiles.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))


def upsample_nearest(tiles: DataFrame, k: int) -> DataFrame:
    """Repeat every pixel k x k times."""
    big = {"r": F.col("r") * k + F.col("_dr"), "c": F.col("c") * k + F.col("_dc")}
    return _spread(tiles, k).withColumns(big).drop("_dr", "_dc")


def upsample_weighted(tiles: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """Blend of the four corner pixels; a corner weighs the squared distance to the opposite corner, edges are clamped.

    Each pixel sends itself to the blocks where it is a corner, so one aggregation replaces four joins. Tiles are dealt out whole first, so
    what is shuffled are the pixels, not their copies.
    """
    half = F.sequence(F.lit(0), F.lit(1))
    names = [c for c in tiles.columns if c not in ("r", "c", "value")]
    sent = (tiles.repartition(*names) if names else tiles).withColumn("_cr", F.explode(half)).withColumn("_cc", F.explode(half))
    for at, corner, size in (("r", "_cr", rows), ("c", "_cc", cols)):
        # corner 1 of block b is pixel b + 1, or the last pixel again at the edge
        own = F.col(at) - F.col(corner)
        edge = (F.col(at) == size - 1) & (F.col(corner) == 1)
        block = F.when(edge, F.array(own, F.col(at))).otherwise(F.array(own))
        sent = sent.withColumn(f"_b{at}", F.explode(block)).filter(F.col(f"_b{at}") >= 0)
    sent = _spread(sent, k)
    # distance to the opposite corner along one axis
    dr = F.when(F.col("_cr") == 0, k - F.col("_dr")).otherwise(F.col("_dr"))
    dc = F.when(F.col("_cc") == 0, k - F.col("_dc")).otherwise(F.col("_dc"))
    at_corner = (F.col("_dr") == 0) & (F.col("_dc") == 0)
    own = (F.col("_cr") == 0) & (F.col("_cc") == 0)
    weight = F.when(at_corner, F.when(own, 1).otherwise(0)).otherwise(dr * dr + dc * dc)
    keys = [c for c in tiles.columns if c not in ("r", "c", "value")]
    big = sent.select(
        *keys,
        (F.col("_br") * k + F.col("_dr")).cast("int").alias("r"),
        (F.col("_bc") * k + F.col("_dc")).cast("int").alias("c"),
        "value",
        weight.alias("_w"),
    )
    blend = F.sum(F.col("_w") * F.col("value")) / F.sum("_w")
    return big.groupBy(*keys, "r", "c").agg(blend.alias("value"))


def sub_blocks(tiles: DataFrame, m: int, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """m x m blocks of every tile as feature rows: keys, br, bc, features (row-major)."""
    cut = tiles.withColumns({"br": F.floor(F.col("r") / m).cast("int"), "bc": F.floor(F.col("c") / m).cast("int")})
    return to_arrays(cut, [*keys, "br", "bc"], ["r", "c"], name="features")


def block_means(tiles: DataFrame, m: int, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Mean of every m x m block: keys, br, bc, label."""
    cut = tiles.withColumns({"br": F.floor(F.col("r") / m).cast("int"), "bc": F.floor(F.col("c") / m).cast("int")})
    return cut.groupBy(*keys, "br", "bc").agg(F.avg("value").alias("label"))


def patch_rows(df: DataFrame, sizes: Sequence[int], side: int, row: str = "r", col: str = "c") -> DataFrame:
    """Patch of every pixel for several patch sizes at once; the remainder at the edge is dropped.

    Adds patch_size, patch (row-major number) and pos (position inside the patch).
    """
    each = df.withColumn("patch_size", F.explode(F.array(*[F.lit(p) for p in sizes])))
    p, whole = F.col("patch_size"), F.floor(F.lit(side) / F.col("patch_size"))
    pr, pc = F.floor(F.col(row) / p), F.floor(F.col(col) / p)
    inside = each.filter((pr < whole) & (pc < whole))
    return inside.withColumns(
        {
            "patch": (pr * whole + pc).cast("int"),
            "pos": ((F.col(row) % p) * p + F.col(col) % p).cast("int"),
        }
    )


def patchify(df: DataFrame, sizes: Sequence[int], side: int, keys: Sequence[str], row: str = "r", col: str = "c") -> DataFrame:
    """Patches as arrays: keys, patch_size, patch, vals."""
    return to_arrays(patch_rows(df, sizes, side, row, col), [*keys, "patch_size", "patch"], ["pos"])


def fit_tile(tiles: DataFrame, h: int, w: int) -> DataFrame:
    """Crop or zero-pad every tile to h x w."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(h - 1)))
    cols = F.explode(F.sequence(F.lit(0), F.lit(w - 1)))
    blank = tiles.select("tile_id").distinct().withColumn("r", rows).withColumn("c", cols)
    kept = tiles.filter((F.col("r") < h) & (F.col("c") < w)).select("tile_id", "r", "c", "value")
    both = kept.unionByName(blank.withColumn("value", F.lit(None).cast("double")))
    return both.groupBy("tile_id", "r", "c").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


def crop_offset(ident: Column, seed: int | str, slack: int) -> Column:
    """Repeatable random offset in [0, slack)."""
    return F.pmod(hash_int(order_hash(ident, seed), 7), F.lit(slack)).cast("int")


def random_crop(tiles: DataFrame, h: int, w: int, rows: int, cols: int, seed: int) -> DataFrame:
    """Crop of h x w at a random offset per tile."""
    r0 = crop_offset(F.col("tile_id"), f"{seed}:r", max(rows - h, 1))
    c0 = crop_offset(F.col("tile_id"), f"{seed}:c", max(cols - w, 1))
    moved = tiles.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})
    return moved.filter(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))
