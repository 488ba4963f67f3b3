"""Exact deduplication through an extendible-hash index kept as files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.functions.scale import HOT_ROWS, salted_join
from terraweft.llm.frames import SPACE, fresh, written

#: Keys of a bucket, beyond which it splits; bits of the largest directory.
CAPACITY, DEPTH = 4_000, 16
#: Entries that a text brings to its owner at most.
SALTS = 4


def normalised(text: str = "text") -> Column:
    """The text without spaces, tabs and line breaks; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def directory(chains: DataFrame, capacity: int, depth: int) -> DataFrame:
    """Bucket of every key prefix of ``depth`` bits: (prefix, bucket, local_depth).

    The directory doubles from one bucket on: a bucket with more than ``capacity`` chains splits by its next bit, and stops at
    ``depth`` bits, beyond which it only grows. A bucket is the first prefix of its key range, so buckets are ordered by range.
    At most 2^depth rows.
    """
    filled = chains.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    levels = filled.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("bucket", F.expr(f"shiftleft(shiftright(prefix, {depth} - local_depth), {depth} - local_depth)"))
    totals = F.broadcast(levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("total")))  # below 2^(depth + 1) rows
    fits = (F.col("total") <= capacity) | (F.col("local_depth") == depth)
    least = levels.join(totals, ["local_depth", "bucket"]).where(fits)
    return least.groupBy("prefix").agg(F.min_by("bucket", "local_depth").alias("bucket"), F.min("local_depth").alias("local_depth"))


def chained(entries: Column) -> Column:
    """The chain of a key: entries of equal bytes become one, with the better keeper and both counts; others follow each other."""

    def add(chain: Column, entry: Column) -> Column:
        same = lambda held: held["body"] == entry["body"]
        joined = lambda held: F.struct(held["body"].alias("body"), F.least(held["best"], entry["best"]).alias("best"), (held["n"] + entry["n"]).alias("n"))
        merged = F.transform(chain, lambda held: F.when(same(held), joined(held)).otherwise(held))
        return F.when(F.exists(chain, same), merged).otherwise(F.concat(chain, F.array(entry)))

    return F.aggregate(F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0))), F.slice(entries, 1, 1), add)


def prefix_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def hash_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, depth: int = DEPTH, key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """The index of a table, (directory, chains): bucket of every prefix, and (bucket, key, chain of text_sha256, keep_id, group_size).

    Copies are added up before they travel, per salt of their id, so a text with many copies reaches its owner as SALTS entries at most. The
    directory doubles until no bucket is overfull. A bucket is a range of keys with one owner task, which links the entries of each key in a
    chain, comparing bytes, and writes the chains to the shared folder. The directory has at most 2^depth rows.
    """
    id_ = F.col(doc_id)
    rows = docs.select(id_.alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"), normalised(text).alias("body"))
    salt = F.pmod(F.xxhash64("id", "points"), F.lit(SALTS))
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("id")))
    added = rows.withColumns({"key": key(F.col("body")), "salt": salt}).groupBy("salt", "key", "body").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    added = written(added.select(prefix_of(F.col("key"), depth).alias("prefix"), "key", "body", "best", "n"), "added")
    buckets = written(directory(added.select("prefix", "key").distinct(), capacity, depth), "directory")
    owned = added.join(F.broadcast(buckets.select("prefix", "bucket")), "prefix").repartition("bucket").sortWithinPartitions("bucket", "key")
    entries = owned.groupBy("bucket", "key").agg(F.collect_list(F.struct("body", "best", "n")).alias("entries"))
    told = F.transform(chained(F.col("entries")), lambda e: F.struct(F.sha2(e["body"], 256).alias("text_sha256"), e["best"]["id"].alias("keep_id"), e["n"].alias("group_size")))
    return buckets, written(entries.select("bucket", "key", told.alias("chain")), "index")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, depth: int = DEPTH, key: Callable[[Column], Column] = F.xxhash64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Look every row up in the index of its own table: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical without spaces, tabs and line breaks; null counts as empty, and all empty texts are one group. The row
    with the most code points stays, then the smallest id; null ids lose against any other. Repeated rows count each; rows that
    share the id that stays are all kept. An empty table gives no rows. Other columns of ``docs`` are not read.

    A row goes from the prefix of its key to the bucket, there to the chain of its key, and takes the entry with its own digest. Chains that more
    than ``hot_rows`` rows ask for are repeated, and their rows spread.
    """
    buckets, index = hash_index(docs, doc_id, text, capacity, depth, key)
    body = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("body"))
    members = body.select("doc_id", key(F.col("body")).alias("key"), F.sha2("body", 256).alias("text_sha256"))
    members = members.withColumn("prefix", prefix_of(F.col("key"), depth)).join(F.broadcast(buckets.select("prefix", "bucket")), "prefix").drop("prefix")
    asked = index.select("bucket", "key", F.aggregate("chain", F.lit(0).cast("long"), lambda total, e: total + e["group_size"]).alias("_n"))
    found = salted_join(members, index, ["bucket", "key"], counts=asked, hot_rows=hot_rows)
    found = found.withColumn("entry", F.filter("chain", lambda e: e["text_sha256"] == F.col("text_sha256"))[0])
    return found.select("doc_id", "entry.keep_id", "entry.group_size", F.col("doc_id").eqNullSafe(F.col("entry.keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, one per different text, all columns as they were.

    Rows are looked up by text and id together, so a text with many copies is no hot key. Of repeated rows any one stays.
    """
    digest, name = fresh(docs, "_digest"), fresh(docs, "_name")
    stay = hash_index(docs, doc_id, text, capacity, depth)[1].select(F.inline("chain"))
    stay = stay.select(F.col("text_sha256").alias(digest), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias(name))
    keyed = docs.withColumn(digest, F.sha2(normalised(text), 256)).withColumn(name, F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return keyed.join(stay, [digest, name], "left_semi").dropDuplicates([digest, name]).select(*docs.columns)
