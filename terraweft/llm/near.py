"""Near-duplicate documents: circulant MinHash proposes, exact Jaccard on full shingle sets decides."""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.llm.frames import blocks, fresh, written
from terraweft.llm.words import Spans, chained, first_seen, keyed, scramble, word_spans

#: Chance that all bands miss a pair at the threshold.
MISS = 1e-9
#: Shingles that one task compares at once.
CELL = 1 << 21


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def shingle_sets(data: np.ndarray, offsets: np.ndarray, spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row after row, and their number per row. A row of fewer words is one shingle."""
    rows = len(offsets) - 1
    data = lower_table()[data]
    starts, ends, row = word_spans(data, offsets)
    hashes = spans.hashes(spans.prefix(data), starts, ends)
    values = chained(hashes, width)
    whole = row[: len(values)] == row[len(hashes) - len(values) :]
    values, owner = values[whole], row[: len(whole)][whole]
    n_words = np.bincount(row, minlength=rows)
    first = np.cumsum(n_words) - n_words
    for short in range(1, width):
        own = np.flatnonzero(n_words == short)
        if len(own):
            values = np.concatenate([values, scramble(chained(hashes, short)[first[own]] ^ np.uint64(short))])
            owner = np.concatenate([owner, own])
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    keys = keyed(values, owner)
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(twice):
        again = np.flatnonzero(np.isin(keys, twice))
        stay = np.ones(len(values), bool)
        stay[again[~first_seen(keys[again])]] = False
        values, owner = values[stay], owner[stay]
    return values, np.bincount(owner, minlength=rows)


def circulant(values: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures of sets that begin at ``starts``: one permutation deals the shingles over a circle of 2^32 places, a second
    one, shifted by one place per coordinate, ranks them."""
    place = (scramble(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        x = place + np.uint32(k)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x21F0AAAD)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xD35A2D97)
        x ^= x >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def set_marks(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits per set that do not depend on its order."""
    return np.stack([np.add.reduceat(scramble(values ^ np.uint64(salt)), starts) for salt in (0x243F6A8885A308D3, 0x5851F42D4C957F2D)], axis=1)


def bands_for(percent: int, rows: int) -> int:
    """Bands that a pair at the threshold misses with a chance below MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def _signatures(width: int, rows: int, bands: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(key)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                values, counts = shingle_sets(data, offsets, spans, width)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                keys = np.zeros((len(some), bands), np.uint64)
                marks = np.zeros((len(some), 2), np.uint64)
                if len(some):
                    marks = set_marks(values, starts)
                    signature = circulant(values, starts, rows * bands).reshape(len(some), bands, rows)
                    keys += np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        keys = scramble(keys * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, :, k])
                place = np.full(len(counts), -1)
                place[some] = np.arange(len(some))
                flat = pa.array(keys.astype(np.int64).ravel())
                held = (counts > 0).astype(np.int32)
                offsets32 = np.concatenate([[0], np.cumsum(held * bands)]).astype(np.int32)
                marked = [marks[p].tobytes() if p >= 0 else None for p in place.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), pa.array(marked, pa.binary()), pa.ListArray.from_arrays(offsets32, flat)],
                    names=["doc_id", "n_shingles", "set_id", "keys"],
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, label), the label being the least node; nodes without links are absent.

    Large-star and small-star steps, each an aggregation and a join; every round is written to the shared folder. The hubs of a large star are
    written before they are joined: a join of two plain exchanges is one whose hot keys Spark splits over tasks.
    """
    state = None
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    while True:
        links = written(links, "links")
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = mark
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub")), "hubs")
        large = written(both.join(hubs, "a").where("b > a").select(F.col("b").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("hub"))
        small = large.join(least, "a").where("b <> hub").select(F.col("b").alias("a"), F.col("hub").alias("b"))
        links = small.unionByName(least.select("a", F.col("hub").alias("b"))).where("a <> b").distinct()


def cells(members: DataFrame, buckets: DataFrame, coarse: DataFrame, limit: int) -> DataFrame:
    """Where sets are compared: (set_id, cell). Every pair that shares a bucket meets in a cell.

    A set goes once to the cell of its coarse component when that holds at most ``limit`` shingles. Larger components are compared
    bucket by bucket, and buckets beyond the limit in blocks of half of it, every two blocks in a cell.
    """
    placed = members.join(coarse, members.set_id == coarse.node).select("set_id", "label", "n_shingles")
    # totals are written before they are joined, so that a large component is no hot key
    weights = written(placed.groupBy("label").agg((F.sum("n_shingles") <= limit).alias("fits")), "weights")
    placed = written(placed.join(weights, "label"), "placed")
    fitting = placed.where("fits").select("set_id", F.col("label").alias("cell"))
    crowded = buckets.join(placed.where("NOT fits").select("set_id", "n_shingles"), "set_id")
    parts = crowded.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") * 2 / F.lit(limit))).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    # blocks hold half a cell at most, so a bucket that fits is one block
    crowded = crowded.join(parts.where("n > 1").withColumn("parts", F.expr("if(parts <= 2, 1, parts)")), "key")
    crowded = crowded.withColumn("own", F.pmod(F.xxhash64("set_id"), "parts")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    name = F.md5(F.concat_ws(":", "key", F.least("own", "other"), F.greatest("own", "other")).cast("binary"))
    return fitting.unionByName(crowded.select("set_id", F.unhex(name).alias("cell")))


def _compare(width: int, percent: int, key: int):
    """Rows sorted by cell to links (a, b) that span the components inside each cell.

    A row whose text has another set than its name says (ids may repeat), or a set that is there already, is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, cell, names, sets, known = Spans(key), None, [], [], set()

        def links() -> pa.RecordBatch:
            label = linked(sets, percent)
            pairs = [(names[i], names[k]) for i, k in enumerate(label) if i != k]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                values, counts = shingle_sets(data, offsets, spans, width)
                ends = np.cumsum(counts)
                some = np.flatnonzero(counts)
                marks = dict(zip(some.tolist(), map(bytes, set_marks(values, (ends - counts)[some])), strict=True)) if len(some) else {}
                for k, (here, name) in enumerate(zip(part.column("cell").to_pylist(), part.column("set_id").to_pylist(), strict=True)):
                    if here != cell:
                        if len(names) > 1:
                            yield links()
                        cell, names, sets, known = here, [], [], set()
                    if marks.get(k) != name or name in known:
                        continue
                    known.add(name)
                    names.append(name)
                    sets.append(values[ends[k] - counts[k] : ends[k]].copy())
        if len(names) > 1:
            yield links()

    return run


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component under 100 * intersection >= percent * union. All pairs are decided exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    live = np.ones(n, bool)
    while True:
        # a set must share enough of its own shingles with anyone at all
        df = np.bincount(tokens[live[owner]], minlength=tokens.max(initial=0) + 1)
        usable = (df[tokens] > 1) & live[owner]
        enough = live & (100 * np.bincount(owner[usable], minlength=n) >= percent * sizes)
        if (enough == live).all():
            break
        live = enough
    tokens, owner = tokens[usable], owner[usable]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    label, free, left = np.arange(n), live.copy(), int(live.sum())
    posted, held = _postings(tokens, owner, len(df)), left
    # from each set that has no component yet, on to all that links reach; sets that have one need not be found again
    for seed in np.flatnonzero(live).tolist():
        if not free[seed]:
            continue
        free[seed], left, reached = False, left - 1, [seed]
        while reached and left:
            if 2 * left < held:
                open_ = free[owner]
                posted, held = _postings(tokens[open_], owner[open_], len(df)), left
            i = reached.pop()
            own = tokens[bounds[i] : bounds[i + 1]]
            begin, lengths = posted[1][own], posted[2][own]
            at = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            met = posted[0][at]
            others, shared = np.unique(met[free[met]], return_counts=True)
            new = others[100 * shared >= percent * (sizes[i] + sizes[others] - shared)]
            free[new], label[new], left = False, seed, left - len(new)
            reached += new.tolist()
    return label.tolist()


def _postings(tokens: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners by token, and the first and the number of each token's owners."""
    lengths = np.bincount(tokens, minlength=size)
    return owner[np.argsort(tokens, kind="stable")], np.cumsum(lengths) - lengths, lengths


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5, rows: int = 5, cell: int = CELL) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id (smallest id that links reach), kept (doc_id = component_id).

    Two documents are linked when 100 * intersection >= percent * union of their sets of ``width``-word shingles, A-Z in lower case.
    A document of fewer words is one shingle; one without words (null, empty) has no shingle, links with nothing and is kept. Equal sets
    are one node; bands of circulant MinHash propose which nodes to compare, exact sets decide. Ties cannot arise; repeated rows and rows
    that share an id count as documents with that id, and null ids lose against others (a group of nulls has a null id and is kept). An empty table
    gives no rows. Texts are read whole; other columns are not read.
    """
    bands, key = bands_for(percent, rows), secrets.randbits(64)
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(read.mapInArrow(_signatures(width, rows, bands, key), f"doc_id {kind}, n_shingles long, set_id binary, keys array<long>"), "signatures")
    nodes = signed.where("set_id IS NOT NULL").groupBy("set_id")
    nodes = written(nodes.agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "nodes")
    spread = nodes.select("set_id", F.explode("keys").alias("key"))
    hubs = spread.groupBy("key").agg(F.min("set_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = written(spread.join(written(hubs, "bucket_hubs"), "key"), "buckets")
    coarse = components(buckets.select(F.col("set_id").alias("a"), F.col("hub").alias("b")))
    # a node without a link of its own is the label of others
    coarse = written(coarse.unionByName(coarse.select(F.col("label").alias("node"), "label").distinct()), "coarse")
    members = nodes.select("set_id", "least", "n_shingles")
    meet = written(cells(members, buckets.select("set_id", "key"), coarse, cell), "cells")
    # one document brings the text of its set
    bearers = members.select("set_id", "least").join(meet, "set_id")
    texts = read.join(bearers, read.doc_id.eqNullSafe(bearers.least)).select("cell", "set_id", "text")
    compared = texts.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(width, percent, key), "a binary, b binary")
    groups = components(compared)
    labels = members.join(groups, members.set_id == groups.node, "left").select("set_id", "least", F.coalesce("label", "set_id").alias("label"))
    labels = written(labels, "labels")
    smallest = written(labels.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    named = labels.join(smallest, "label").select("set_id", "component_id")
    found = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, one document per group, all columns as they were."""
    name = fresh(docs, "_kept_id")
    stay = near_duplicates(docs, doc_id, text, percent).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(stay, F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
