"""Orders, subsamples and train/val/test splits. Every random choice follows the md5 order of ids under a seed."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweft.functions.scalars import hash_int
from terraweft.functions.scale import bucket_rank, hash_rank, take_quota, take_random
from terraweft.session import cut_lineage


def shuffle(df: DataFrame, ident: str, seed: int, name: str = "position") -> DataFrame:
    """Repeatable random order as a 0-based position."""
    return hash_rank(df, ident, seed, name).withColumn(name, F.col(name) - 1)


def shuffle_cells(cells: DataFrame, seed: int) -> DataFrame:
    """Row and column order shuffled independently: bi, bj and the position of each in its own shuffled order."""
    rows = shuffle(cells.select("bi").distinct(), "bi", f"{seed}:i", "pos_i")
    cols = shuffle(cells.select("bj").distinct(), "bj", f"{seed}:j", "pos_j")
    return cells.join(rows, "bi").join(cols, "bj").select("bi", "bj", "pos_i", "pos_j")


def take_first(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Exactly the first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def subsample(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """min(n, total) rows without replacement."""
    return take_random(df, ident, n, seed, "_keep").filter("_keep").drop("_keep")


def batch_ids(df: DataFrame, ident: str, size: int, seed: int) -> DataFrame:
    """Batch number of every id in shuffled order; the last batch may be short."""
    return shuffle(df, ident, seed, "_pos").withColumn("batch", F.floor(F.col("_pos") / size).cast("bigint")).drop("_pos")


def batches_in_order(df: DataFrame, ident: str = "sample_id") -> DataFrame:
    """Rows grouped by batch, ids ascending inside each batch."""
    return df.repartition("batch").sortWithinPartitions("batch", ident)


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _share(total: Column, fraction: float, rounding: str) -> Column:
    step = F.ceil if rounding == "ceil" else F.floor
    # rounding first keeps 0.3 * 10 at 3
    return step(F.round(total * F.lit(fraction), 9)).cast("bigint")


def random_split(
    df: DataFrame,
    ident: str = "sample_id",
    folds: int = 5,
    test_frac: float = 0.3,
    val_frac: float = 0.2,
    seed: int = 0,
    rounding: str = "ceil",
) -> DataFrame:
    """Test set, then ``folds`` independent validation sets over the rest: id, fold, role.

    test and remaining rows have no fold; validation folds may overlap.
    """
    ids = cut_lineage(df.select(ident))
    marked = cut_lineage(take_random(ids, ident, _share(_count(ids), test_frac, rounding), seed, "_test"))
    rest = marked.filter(~F.col("_test")).select(ident)
    fixed = marked.select(
        ident, F.lit(None).cast("int").alias("fold"), F.when(F.col("_test"), "test").otherwise("remaining").alias("role")
    )
    quota = _share(_count(rest), val_frac, rounding)
    each = rest.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    digest = F.md5(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}:"), F.col("fold").cast("string")).cast("binary"))
    each = each.withColumn("_h", digest)
    order = [F.col("_h"), F.col(ident)]
    picked = take_quota(each, hash_int(F.col("_h")), order, quota, "_val", ["fold"])
    folded = picked.select(ident, "fold", F.when(F.col("_val"), "val").otherwise("train").alias("role"))
    return fixed.unionByName(folded)


def dilate(cells: DataFrame, b: int, keys: Sequence[str] = ()) -> DataFrame:
    """Cells within ``b`` (square distance) of the given cells, one axis at a time, for every value of the keys."""
    steps = F.explode(F.sequence(F.lit(-b), F.lit(b)))
    wide = cells.withColumn("_d", steps).select(*keys, (F.col("bi") + F.col("_d")).alias("bi"), "bj").distinct()
    tall = wide.withColumn("_d", steps)
    return tall.select(*keys, "bi", (F.col("bj") + F.col("_d")).alias("bj")).distinct()


def free_cells(legal: DataFrame, taken: DataFrame, b: int) -> DataFrame:
    """Legal cells that are not within ``b`` of a taken cell."""
    return legal.join(dilate(taken.select("bi", "bj"), b), ["bi", "bj"], "left_anti")


def quotas(total: int, regions: int) -> list[int]:
    """Whole cells per region that add up to the total."""
    return [(i + 1) * total // regions - i * total // regions for i in range(regions)]


def _key_of_lot(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), F.col("lot") + 1)


def _digest(text: Column, names: Sequence[str]) -> Column:
    return F.md5(F.concat(text, F.lit(":"), _key_of_lot(names)).cast("binary"))


def _tiled(width: int, x: str = "bi", y: str = "bj") -> dict[str, Column]:
    return {"tx": F.floor(F.col(x) / width), "ty": F.floor(F.col(y) / width)}


def _around(df: DataFrame) -> DataFrame:
    """Each row in its own tile and the eight beside it."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    wide = df.withColumn("_d", step).withColumn("tx", F.col("tx") + F.col("_d"))
    return wide.withColumn("_d", step).withColumn("ty", F.col("ty") + F.col("_d")).drop("_d")


def _tile_seeds(cells: DataFrame, side: int, buffer: int, names: Sequence[str]) -> DataFrame:
    """One seed in the central square of each tile, so seeds are half a block and ``buffer`` apart: lot, si, sj, h."""
    width, inner_side = side + buffer, max(side // 2, 1)
    low = (width - inner_side) // 2
    inner = cells.withColumns(_tiled(width)).withColumns(
        {"_x": F.col("bi") - F.col("tx") * width - low, "_y": F.col("bj") - F.col("ty") * width - low}
    )
    inner = inner.filter(F.col("_x").between(0, inner_side - 1) & F.col("_y").between(0, inner_side - 1))
    mid = (inner_side - 1) / 2
    off = F.greatest(F.abs(F.col("_x") - mid), F.abs(F.col("_y") - mid))
    best = inner.groupBy("lot", "tx", "ty").agg(F.min(F.struct(off.alias("off"), "bi", "bj")).alias("s"))
    return best.select("lot", F.col("s.bi").alias("si"), F.col("s.bj").alias("sj"), _digest(F.concat_ws("_", "tx", "ty"), names).alias("h"))


def _distant_seeds(cells: DataFrame, apart: int, names: Sequence[str]) -> DataFrame:
    """Cells that no better-ranked cell is within ``apart`` of: lot, si, sj, h.

    The best-ranked cell of a lot always stands, so a round gives a seed to every lot that has a cell left.
    """
    keyed = cells.withColumns(_tiled(apart + 1)).withColumn("h", _digest(F.concat_ws("_", "bi", "bj"), names))
    # only the best cell of a tile can stand; others lose to it
    best = keyed.groupBy("lot", "tx", "ty").agg(F.min(F.struct("h", "bi", "bj")).alias("s"))
    best = cut_lineage(best.select("lot", "tx", "ty", "s.h", "s.bi", "s.bj"))
    others = _around(best.withColumnsRenamed({"h": "h2", "bi": "bi2", "bj": "bj2"}))
    close = (F.abs(F.col("bi") - F.col("bi2")) <= apart) & (F.abs(F.col("bj") - F.col("bj2")) <= apart)
    beaten = best.join(others, ["lot", "tx", "ty"]).filter(close & (F.col("h2") < F.col("h"))).select("lot", "h").distinct()
    stand = best.join(beaten, ["lot", "h"], "left_anti")
    return stand.select("lot", F.col("bi").alias("si"), F.col("bj").alias("sj"), "h")


def clearance(cells: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """Distance of every seed to the nearest cell of the blocks placed before it, as far as ``reach``: lot, region, clear (NULL beyond).

    ``cells`` (lot, bi, bj) and ``seeds`` (lot, region, si, sj) both have the turn of their block.
    """
    spots = _around(seeds.select("lot", "region", "si", "sj", F.col("turn").alias("own")).withColumns(_tiled(reach + 1, "si", "sj")))
    met = cells.select("lot", "bi", "bj", "turn").withColumns(_tiled(reach + 1)).join(spots, ["lot", "tx", "ty"]).filter("turn < own")
    away = F.greatest(F.abs(F.col("bi") - F.col("si")), F.abs(F.col("bj") - F.col("sj")))
    nearest = met.groupBy("lot", "region").agg(F.min(F.when(away <= reach, away)).alias("clear"))
    return seeds.select("lot", "region").join(nearest, ["lot", "region"], "left")


def _claim(cells: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """Give every cell within ``reach`` to its nearest seed and let each seed take its quota, ring by ring."""
    table = _around(seeds.select("lot", "region", "si", "sj", "quota", "oi", "oj").withColumns(_tiled(reach + 1, "si", "sj")))
    di, dj = F.col("bi") - F.col("si"), F.col("bj") - F.col("sj")
    ring = F.greatest(F.abs(di), F.abs(dj))
    near = cells.withColumns(_tiled(reach + 1)).join(table, ["lot", "tx", "ty"]).withColumn("ring", ring).filter(F.col("ring") <= reach)
    first = F.min(F.struct("ring", "region", "quota", (di * F.col("oi")).alias("di"), (dj * F.col("oj")).alias("dj")))
    owned = cut_lineage(near.groupBy(*cells.columns).agg(first.alias("s")).select(*cells.columns, "s.*"))  # read three times
    order = [F.col("di"), F.col("dj")]
    taken = take_quota(owned, F.col("ring"), order, F.col("quota"), "_take", ["lot", "region"])
    return taken.filter("_take").select(*cells.columns, "region")


def grow_lots(cells: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """Blocks of all lots at once: the cells that the seeds take, with their region. ``cells`` has lot, bi, bj and any other columns.

    Every round the free cells go to the nearest region that is still short; then the short regions look twice as far. It ends when
    all quotas are met or a lot has no free cell.
    """
    free, parts, extent, short = cells, [], None, seeds
    while True:
        taken = cut_lineage(_claim(free, short, reach))
        parts.append(taken)
        got = taken.groupBy("lot", "region").agg(F.count(F.lit(1)).alias("_got"))
        short = short.join(got, ["lot", "region"], "left").withColumn("quota", F.col("quota") - F.coalesce("_got", F.lit(0))).drop("_got").filter("quota > 0")
        if short.isEmpty():
            break
        short = cut_lineage(short)
        if taken.isEmpty():
            if extent is None:
                ends = cells.agg(F.min("bi"), F.max("bi"), F.min("bj"), F.max("bj")).first()
                extent = max(ends[1] - ends[0], ends[3] - ends[2]) if ends[0] is not None else 0
            if reach > extent:
                break
        free = cut_lineage(free.join(taken.select("lot", "bi", "bj"), ["lot", "bi", "bj"], "left_anti"))
        reach *= 2
    return functools.reduce(DataFrame.unionByName, parts)


def grow_blocks(cells: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """Blocks around given seeds: the columns of ``cells`` plus region.

    ``seeds`` rows hold region, si, sj, quota and the orientation oi, oj of the row-major order inside a ring; ``reach`` is where the
    search starts, it widens until the quotas are met.
    """
    lots = cells.withColumn("lot", F.lit(0))
    return grow_lots(lots, seeds.withColumn("lot", F.lit(0)), reach).select(*cells.columns, "region")


def _blocks(cells: DataFrame, total: int, regions: int, buffer: int, names: Sequence[str], method: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of one lot per name over the same cells, and their seeds: lot, region, si, sj, quota, apart, turn, clear.

    A round places seeds for the regions that lack one, on cells more than ``buffer`` away from all blocks that stand, and grows their blocks. A
    block whose seed came within ``buffer`` of a block that precedes it in the round is given up, and its region goes to the next round.
    Where a lot has no such cell left, the distance is halved (``apart`` has the one that a seed was placed with).
    """
    side = max(math.ceil(math.sqrt(total / regions)), 1)
    spark, last = cells.sparkSession, len(names) - 1
    lots = cells.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(last))))
    # whole cells per region that add up to the total; a region without cells is not placed
    share = F.expr(f"(id + 1) * {total}L div {regions}L - id * {total}L div {regions}L")
    wanted = spark.range(regions).select(F.col("id").cast("int").alias("region"), share.alias("quota")).filter("quota > 0")
    wanted = wanted.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(last))))
    open_regions = wanted.count()
    first = Window.partitionBy("lot").orderBy("region")
    apart, turn, tiles = buffer, 0, method == "tiles"
    taken = placed = None
    free = lots
    while open_regions:
        waits = wanted.withColumn("rank", F.row_number().over(first))
        most = waits.groupBy("lot").agg(F.max("rank").alias("most"))
        places = free if taken is None else free.join(dilate(taken.select("lot", "bi", "bj"), apart, ["lot"]), ["lot", "bi", "bj"], "left_anti")
        places = places.join(F.broadcast(most.select("lot")), "lot", "left_semi")  # a row per lot
        seeds = _tile_seeds(places, side, apart, names) if tiles else _distant_seeds(places, side // 2 + apart, names)
        seeds = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("lot").orderBy("h"))).join(F.broadcast(most), "lot").filter("rank <= most")
        turned = lambda at: F.when(F.expr(f"conv(substring(h, {at}, 1), 16, 10) % 2 = 1"), 1).otherwise(-1)
        seeds = seeds.join(waits, ["lot", "rank"]).select(
            "lot", "region", "si", "sj", "quota", turned(32).alias("oi"), turned(31).alias("oj"), F.lit(apart).alias("apart"), (F.lit(turn).cast("long") + F.col("rank")).alias("turn")
        )
        seeds = cut_lineage(seeds)
        found = seeds.count()
        if not found:
            if not tiles:
                if apart == 0:
                    break  # no free cell left
                apart //= 2
            tiles = False
            continue
        tiles, turn = False, turn + regions
        grown = grow_lots(free, seeds, 2 * side).join(seeds.select("lot", "region", "turn"), ["lot", "region"])
        grown = grown.select(*lots.columns, "region", "turn")
        close = cut_lineage(clearance(grown, seeds, apart).filter("clear IS NOT NULL").select("lot", "region"))
        given_up = close.count()
        if given_up:
            seeds = seeds.join(close, ["lot", "region"], "left_anti")
            grown = grown.join(close, ["lot", "region"], "left_anti")
        taken = grown if taken is None else taken.unionByName(grown)
        placed = seeds if placed is None else placed.unionByName(seeds)
        open_regions -= found - given_up
        if open_regions:
            taken, placed = cut_lineage(taken), cut_lineage(placed)
            wanted = cut_lineage(wanted.join(placed.select("lot", "region"), ["lot", "region"], "left_anti"))
            free = lots.join(taken.select("lot", "bi", "bj"), ["lot", "bi", "bj"], "left_anti")
    if placed is None:
        empty = lots.limit(0).withColumns({"region": F.lit(0), "turn": F.lit(0).cast("long")})
        return empty.drop("turn"), spark.createDataFrame([], "lot int, region int, si int, sj int, quota long, apart int, turn long, clear int")
    marks = placed.drop("oi", "oj").join(clearance(taken, placed, buffer + side), ["lot", "region"])
    return taken.drop("turn"), marks


def spatial_block_split(
    legal: DataFrame,
    regions: int,
    partition: tuple[float, float] = (0.3, 0.2),
    buffer: int = 2,
    folds: int = 5,
    seed: int = 0,
    method: str = "tiles",
    exclude_margin: int = 0,
) -> DataFrame:
    """Split legal samples in spatial blocks: sample_id, fold, role, region. See ``block_split_with_seeds``."""
    return block_split_with_seeds(legal, regions, partition, buffer, folds, seed, method, exclude_margin)[0]


def block_split_with_seeds(
    legal: DataFrame,
    regions: int,
    partition: tuple[float, float] = (0.3, 0.2),
    buffer: int = 2,
    folds: int = 5,
    seed: int = 0,
    method: str = "tiles",
    exclude_margin: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Spatial block split and the seeds of its blocks: role, fold, region, si, sj, quota, apart, turn, clear.

    ``regions`` blocks grow from seeds to the test share; the rest is split again per fold for validation. The sets have exactly their
    share of the cells. A seed lies more than ``buffer`` away from the cells of the blocks placed before it, where there is room; ``apart`` is
    the distance asked of it, ``clear`` its distance to those cells (NULL where they are far). ``exclude_margin`` keeps training cells that far
    away from test cells. ``method`` draws seeds from "tiles" first, or all by "reject", from the cells that remain.
    """
    cells = cut_lineage(legal.select("sample_id", "bi", "bj"))
    n = cells.count()
    none = F.lit(None).cast("int")
    tested, seeds = _blocks(cells, int(n * partition[0]), regions, buffer, [f"{seed}:test"], method)
    marks = seeds.withColumns({"role": F.lit("test"), "fold": none}).drop("lot")
    test = tested.drop("lot")
    rest = cut_lineage(cells.join(test.select("sample_id"), "sample_id", "left_anti"))
    out = test.select("sample_id", none.alias("fold"), F.lit("test").alias("role"), "region")
    out = out.unionByName(rest.select("sample_id", none.alias("fold"), F.lit("remaining").alias("role"), none.alias("region")))
    if not folds:
        return out, marks
    val, seeds = _blocks(rest, int(n * partition[1]), regions, buffer, [f"{seed}:{fold}" for fold in range(folds)], method)
    marks = marks.unionByName(seeds.withColumns({"role": F.lit("val"), "fold": F.col("lot")}).drop("lot"))
    usable = free_cells(rest, test, exclude_margin) if exclude_margin else rest
    each = usable.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    train = each.join(val.select("sample_id", F.col("lot").alias("fold")), ["sample_id", "fold"], "left_anti")
    out = out.unionByName(val.select("sample_id", F.col("lot").alias("fold"), F.lit("val").alias("role"), "region"))
    return out.unionByName(train.select("sample_id", "fold", F.lit("train").alias("role"), none.alias("region"))), marks


def seed_report(marks: DataFrame) -> DataFrame:
    """Per block set: blocks, cells wanted, least distance asked of a seed, least distance found to blocks before it, and seeds nearer than asked."""
    nearer = F.count(F.when(F.col("clear") <= F.col("apart"), 1)).alias("nearer")
    return marks.groupBy("role", "fold").agg(F.count(F.lit(1)).alias("regions"), F.sum("quota").alias("wanted"), F.min("apart").alias("least_apart"), F.min("clear").alias("least_clear"), nearer)


def split_shortfall(splits: DataFrame, legal: DataFrame, partition: tuple[float, float]) -> DataFrame:
    """Wanted and reached size of every block set: role, fold, wanted, reached. They differ only where legal cells run out."""
    n = legal.count()
    wanted = F.when(F.col("role") == "test", int(n * partition[0])).otherwise(int(n * partition[1]))
    sizes = splits.filter("role IN ('test', 'val')").groupBy("role", "fold").agg(F.count(F.lit(1)).alias("reached"))
    return sizes.select("role", "fold", wanted.alias("wanted"), "reached")


def fold_view(samples: DataFrame, splits: DataFrame, data: DataFrame, fold: int, role: str) -> DataFrame:
    """Samples of one role of one fold with their target and their data rows; ``test`` means the test set."""
    chosen = splits.filter(F.col("role") == role)
    if role in ("train", "val"):
        chosen = chosen.filter(F.col("fold") == fold)
    return chosen.select("sample_id").join(samples, "sample_id").join(data, "sample_id")


def train_ids(splits: DataFrame, ident: str = "sample_id", folds: int | None = None) -> DataFrame:
    """Training rows derived as remaining minus validation, per fold.

    ``folds`` names the number of folds; without it the folds are those that any row names, so only a fold that no row names is missed.
    A table without folds is one fold without validation.
    """
    val = splits.filter("role = 'val'").select(ident, "fold")
    last = F.coalesce(splits.agg(F.max("fold").alias("m")).scalar(), F.lit(0)) if folds is None else F.lit(folds - 1)
    rest = splits.filter("role = 'remaining'").select(ident)
    each = rest.withColumn("fold", F.explode(F.sequence(F.lit(0), last)))
    return each.join(val, [ident, "fold"], "left_anti")


def remaining_ids(samples: DataFrame, test: DataFrame, ident: str = "sample_id") -> DataFrame:
    """Samples that are not in the test set."""
    return samples.select(ident).join(test.select(ident), ident, "left_anti")


def combine_roles(splits: DataFrame, roles: Sequence[str], fold: int | None = None, ident: str = "sample_id") -> DataFrame:
    """Distinct ids of several roles, for example train and val for a final fit."""
    rows = splits.filter(F.col("role").isin(list(roles)))
    if fold is not None:
        rows = rows.filter(F.col("fold").isNull() | (F.col("fold") == fold))
    return rows.select(ident).distinct()


def split_counts(splits: DataFrame) -> DataFrame:
    """Rows per role and per (role, fold) in one pass."""
    sets = splits.groupingSets([["role"], ["role", "fold"]], "role", "fold")
    sized = sets.agg(F.grouping("fold").alias("_all"), F.count(F.lit(1)).alias("n"))
    per_fold = (F.col("_all") == 0) & F.col("fold").isNotNull()
    return sized.filter((F.col("_all") == 1) | per_fold).select("role", "fold", "n")


def index_by_first_seen(df: DataFrame, col: str, order: str, name: str = "class_index") -> DataFrame:
    """Classes numbered from 0 by first appearance: class, first, index."""
    first = df.groupBy(col).agg(F.min(order).alias("first_seen"))
    ranked = bucket_rank(first, F.floor(F.col("first_seen") / 65_536), [F.col("first_seen")], name)
    return ranked.withColumn(name, (F.col(name) - 1).cast("int"))


def first_k_classes(df: DataFrame, col: str, order: str, k: int) -> DataFrame:
    """Rows of the first k classes by first appearance."""
    first = df.groupBy(col).agg(F.min(order).alias("_f")).orderBy("_f").limit(k).select(col)
    return df.join(F.broadcast(first), col, "left_semi") if k <= 10_000 else df.join(first, col, "left_semi")

