"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.llm.frames import WORD, fresh, running_before, written

#: Parts of the golden ratio's fraction for the low 20 bits of a slot number and for the rest.
STEP, STEP_HIGH = 0.6180339887498949, (0.6180339887498949 * (1 << 20)) % 1.0
SLOTS, LARGEST_BLOCK, CELLS, CHUNK = 1 << 20, 1 << 16, 4096, 4096
#: A source whose size or target holds fewer of the table's blocks than this has smaller blocks of its own.
FEWEST_BLOCKS = 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int) -> DataFrame:
    """Per source: sid, source_size, target, and its part [low, high) of the words to mix. One row per source.

    Weights are 1, 2, 3, repeating, by code point of the source, null last. A target stops at ``repeats`` times the size of its
    source; the rest goes to the others by weight. Sources that stop are a prefix by size per weight, so no iteration is needed.
    """
    alone = Window.orderBy(F.col("source").isNull(), "source")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.select("source", "source_size", F.row_number().over(alone).alias("sid")).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    sources = sources.withColumn("cap", F.col("source_size") * repeats)
    everything = Window.partitionBy()
    tightest = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "sid")
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"),
    )
    level = (F.col("total") - F.col("caps_before")).cast("double") / (F.col("weights") - F.col("weights_before"))
    sources = sources.withColumn("stops", F.col("cap").cast("double") / F.col("weight") <= level)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(left.cast("double") * F.col("weight") / open_weight)
    sources = sources.withColumn("target", target)
    high = F.sum(F.round("target").cast("long")).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    sources = sources.withColumn("high", high).withColumn("low", F.col("high") - F.round("target").cast("long"))
    return sources.select("source", "sid", "source_size", "target", "low", "high")


def grained(sources: DataFrame, block: int) -> DataFrame:
    """Add the words in a block of each source, its number of blocks, and whether the source is fine: its blocks are smaller than ``block``.

    A fine source has about ``FEWEST_BLOCKS`` blocks in its size or target, whichever is less. Its part [low, high) counts slots
    on a line of fine sources only: one for each block of a whole pass over the source, whatever the last block holds, and the rest by words.
    """
    aim = F.round("target").cast("long")
    held = F.least(F.col("source_size"), aim)
    own = F.greatest(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.floor(held / F.lit(float(FEWEST_BLOCKS)))))
    sources = sources.withColumn("own", own).withColumn("fine", F.col("own") < block)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("own").cast("double")))
    passes = F.floor(aim / F.greatest("source_size", F.lit(1)))
    rest = F.round((aim - passes * F.col("source_size")) / F.col("own").cast("double")).cast("long")
    slots = F.when(F.col("fine"), passes * F.col("n_blocks") + F.least("n_blocks", rest)).otherwise(0)
    sources = sources.withColumn("slots", slots)
    high = F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    sources = sources.withColumn("fine_high", high)
    part = {"low": F.when(F.col("fine"), F.col("fine_high") - F.col("slots")).otherwise(F.col("low")), "high": F.when(F.col("fine"), F.col("fine_high")).otherwise(F.col("high"))}
    return sources.withColumns(part).drop("slots", "fine_high")


def schedule(sources: DataFrame, words: int, block: int, repeats: int) -> DataFrame:
    """The mix of sources on one line of ``words``, as slots of ``block``: slot, sid, block, epoch.

    Golden-ratio points go through the cumulative targets; the rank of a slot within its source names the block. A source gives
    each of its blocks at most ``repeats`` times, whatever the points say.
    """
    spark = sources.sparkSession
    slot = F.col("slot")
    turn = F.shiftright(slot, 20) * F.lit(STEP_HIGH) + F.pmod(slot, F.lit(1 << 20)) * F.lit(STEP)
    at = F.floor((turn - F.floor(turn)) * F.lit(float(words)))
    slots = spark.range(-(-words // block)).select(F.col("id").alias("slot")).withColumn("at", at)
    cell = lambda c: F.least(F.floor(c * F.lit(float(CELLS)) / F.lit(float(max(words, 1)))), F.lit(CELLS - 1))
    parts = sources.where("high > low").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    dealt = slots.withColumn("cell", cell(F.col("at"))).join(parts, "cell").where("at >= low AND at < high")
    dealt = dealt.select("slot", "sid", F.expr(f"slot div {CHUNK}").alias("chunk"), F.lit(1).alias("one"), "n_blocks")
    ranked = running_before(dealt, ["sid"], "chunk", [F.col("slot")], "one", "rank")
    used = ranked.where(F.col("rank") < F.col("n_blocks") * repeats)
    return used.select("slot", "sid", (F.col("rank") % F.col("n_blocks")).alias("block"), F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", repeats: int = 3) -> DataFrame:
    """What a mix of as many words as the table has takes from each document: doc_id, size, source_size, target, taken, source.

    The documents of a source are shuffled by a digest of their id and cut into blocks of equally many words; the last block of a
    source may be shorter. Blocks have a millionth of the words, one at least and 65,536 at most; a source with less than 1,024 of them
    in its size or target has smaller ones and a schedule of its own kind, see ``grained``. A document without words has
    size and taken 0; a null source is a source; repeated rows are documents of their own; an empty table gives no rows. Only the
    three named columns are read, whatever else the table holds.
    """
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), digest.alias("digest"))
    sizes = written(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = written(targets(sizes, repeats), "sources")
    words = sources.agg(F.max("high")).first()[0] or 0
    block = max(1, min(LARGEST_BLOCK, words // SLOTS))
    if block > 1:
        sources = written(grained(sources, block), "grained")
        fine = sources.where("fine").agg(F.max("high")).first()[0] or 0
        dealt = schedule(sources.where("NOT fine"), words, block, repeats).unionByName(schedule(sources.where("fine"), fine, 1, repeats))
    else:
        sources = sources.withColumns({"own": F.lit(1).cast("long"), "n_blocks": F.col("source_size")})
        dealt = schedule(sources, words, block, repeats)
    uses = written(dealt.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses")), "uses")
    # blocks are given in order, so none after the last one given counts
    sources = sources.join(uses.groupBy("sid").agg((F.max("block") + 1).alias("given_blocks")), "sid", "left")
    keyed = sizes.withColumn("part", F.substring("digest", 1, 3))
    # the few columns of a source are attached to bucket sums, so a large source is no hot join key
    order = [F.col("digest"), F.col("doc_id"), F.col("size"), F.col("row")]
    extra = sources.select(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("group"), "sid", "source_size", "target", "own", (F.coalesce("given_blocks", F.lit(0)) * F.col("own")).alias("given_end"))
    keyed = keyed.withColumn("group", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    placed = running_before(keyed, ["group"], "part", order, "size", "begin", extra)
    placed = placed.withColumn("end", F.col("begin") + F.col("size"))
    comes = (F.col("size") > 0) & (F.col("begin") < F.col("given_end"))
    cut = placed.where(comes).withColumn("block", F.explode(F.expr("sequence(begin div own, (least(end, given_end) - 1) div own)")))
    overlap = F.least("end", (F.col("block") + 1) * F.col("own")) - F.greatest("begin", F.col("block") * F.col("own"))
    whole = ["row", "doc_id", "source", "size", "source_size", "target"]
    given = cut.join(uses, ["sid", "block"], "left").groupBy(*whole).agg(F.sum(overlap * F.coalesce("uses", F.lit(0))).alias("taken"))
    nothing = placed.where(~comes).select(*whole, F.lit(0).cast("long").alias("taken"))
    return given.unionByName(nothing).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "source")


def repeat_to_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", repeats: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they were: words taken over words, rounded.

    A document that the mix takes less than half of does not come; one without words neither. Rows that share id, source and number of words
    come equally often.
    """
    names = [fresh(docs, n) for n in ("_id", "_source", "_size", "_copies")]
    mixed = mix(docs, doc_id, text, source, repeats).where("size > 0")
    copies = mixed.withColumn("copies", F.expr("(2 * taken + size) div (2 * size)")).where("copies > 0")
    copies = copies.groupBy("doc_id", "source", "size").agg(F.max("copies")).toDF(*names)
    same = F.col(doc_id).eqNullSafe(F.col(names[0])) & F.col(source).eqNullSafe(F.col(names[1])) & (word_count(text) == F.col(names[2]))
    found = docs.join(copies, same)
    return found.withColumn(names[3], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*docs.columns)
