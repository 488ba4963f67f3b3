"""Repeated passages: every byte under a long string that also starts earlier is removed, found by refining buckets of q-grams.

Positions are sampled by content: of the q-grams in a window of the string's length the one with the least hash is the window's anchor, so
equal windows have equal anchors at equal offsets. Runs of windows with one anchor are the suffixes that fall into its q-gram bucket. A
bucket with one run is finished. Otherwise runs with equal context are split from the others, and what differs is refined by sorting on the
bucket numbers of later offsets, doubling the compared length with the numbers of the round before, until it spans the string.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.llm.frames import blocks, flat, written
from terraweft.llm.words import Rolling, Spans, first_seen, per_row, scramble

LENGTH, QGRAM = 100, 24
#: Bytes searched at once, longer texts in overlapping parts; and the bits that hold a position within them.
PART, PLACE_BITS = 2 << 20, 24
#: Bytes of contexts that a task refines at once; buckets are not divided.
BYTES_AT_ONCE = 1 << 20
#: Runs of one bucket beyond which its windows are dealt out by their content instead.
HOT_BUCKET = 20_000
FULL, EDGE = 0, 1
#: Choose anchors and name buckets; what shares a bucket by chance is told apart in it.
ANCHORS = Rolling(QGRAM, 5)


def runs_of(data: np.ndarray, offsets: np.ndarray, spans: Spans, length: int) -> dict[str, np.ndarray]:
    """Runs of windows with a common anchor: row, start within the row, windows, hash of the anchor (h), hash of the whole context (c)."""
    found = []
    for first in range(0, len(offsets) - 1):
        begin, end = int(offsets[first]), int(offsets[first + 1])
        if end - begin > PART:
            for at in range(begin, end - length + 1, PART - length + 1):
                to = min(end, at + PART)
                got = _runs(data[at:to], np.array([0, to - at]), spans, length)
                got["row"] += first
                got["start"] += at - begin
                found.append(got)
    small = np.flatnonzero(np.diff(offsets) <= PART)
    if len(small) == len(offsets) - 1:
        return _runs(data, offsets, spans, length)
    for k in small.tolist():
        got = _runs(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), spans, length)
        got["row"] += k
        found.append(got)
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _runs(data: np.ndarray, offsets: np.ndarray, spans: Spans, length: int) -> dict[str, np.ndarray]:
    n, grams = len(data), length - QGRAM + 1
    none = {"row": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "h": np.zeros(0, np.uint64), "c": np.zeros(0, np.uint64)}
    if n < length:
        return none
    hashes = ANCHORS.hashes(data)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    # windows that lie within one row
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    if not len(row):
        return none
    at = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    anchor = (least[at] & place).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    n_windows = np.diff(np.append(heads, len(row)))
    begin = at[heads]
    return {
        "row": row[heads],
        "start": begin - offsets[row[heads]],
        "n": n_windows,
        "h": hashes[anchor[heads]],
        "c": spans.hashes(spans.prefix(data), begin, begin + n_windows + length - 1),
    }


def _find(length: int, key: int):
    """Documents to runs. A run that an equal one precedes in the same text is known to be removed; such neighbours are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(key)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                got = runs_of(data, offsets, spans, length)
                again = ~first_seen(scramble(got["c"] ^ scramble(got["h"] + got["row"].astype(np.uint64))))
                joined = np.zeros(len(again), bool)
                joined[1:] = again[1:] & again[:-1] & (got["row"][1:] == got["row"][:-1]) & (got["start"][1:] == got["start"][:-1] + got["n"][:-1])
                heads = np.flatnonzero(~joined)
                n = np.add.reduceat(got["n"], heads) if len(heads) else got["n"]
                got = {k: v[heads] for k, v in got.items()} | {"n": n}
                known = again[heads]
                # known runs need no bucket and are dealt anywhere
                h = np.where(known, scramble(got["c"] + got["start"].astype(np.uint64)), got["h"])
                row = pa.array(got["row"])
                columns = [h.view(np.int64), got["c"].view(np.int64), got["start"], got["n"].astype(np.int32), np.where(known, FULL, EDGE).astype(np.int8)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("twin").take(row), *map(pa.array, columns)], names=["doc_id", "twin", "h", "c", "start", "n", "kind"])

    return run


def classified(runs: DataFrame) -> DataFrame:
    """What the buckets tell of runs: a run after an equal one is removed whole; the first run of each context in a bucket with several
    contexts is an edge to refine; a context alone in its bucket is finished and left out."""
    order = [F.col("c"), F.col("doc_id").asc_nulls_last(), F.col("twin"), F.col("start")]
    bucket = Window.partitionBy("h").orderBy(*order)
    ends = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = runs.select("*", F.coalesce(F.lag("c").over(bucket) == F.col("c"), F.lit(False)).alias("same"), (F.first("c").over(ends) != F.last("c").over(ends)).alias("several"))
    removed = (F.col("kind") == FULL) | F.col("same")
    return told.select("doc_id", "twin", "h", "start", "n", removed.alias("removed"), "several").where("removed OR several").drop("several")


def _contexts(length: int):
    """Documents with their edge runs to one row per edge, with the bytes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                edges = part.column("edges")
                items = edges.flatten()
                row = np.repeat(np.arange(len(edges)), pc.list_value_length(edges).to_numpy())
                start, n = items.field("start").to_numpy(), items.field("n").to_numpy()
                begin = offsets[:-1][row] + start
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True)]
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(own), part.column("twin").take(own), items.field("h"), items.field("start"), items.field("n"), pa.array(texts, pa.binary())],
                    names=["doc_id", "twin", "h", "start", "n", "context"],
                )

    return run


def numbered(keys: np.ndarray) -> np.ndarray:
    """Bucket numbers of equal keys, -1 for keys that occur once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    numbers = np.cumsum(new) - 1
    numbers[new & np.append(new[1:], True)] = -1
    out = np.empty(len(keys), np.int64)
    out[order] = numbers
    return out


def refine(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of the strings of ``length`` bytes at ``starts``, -1 for those that occur once among all positions.

    The first buckets are the 8-grams. Each round sorts the positions of open buckets on their number and the number at the compared length
    further on, so the numbers of one round are the keys of the next. A position alone in its bucket is finished, and so is any that reads it.
    """
    size = len(data) - 7
    grams = np.zeros(size, np.uint64)
    for k in range(8):
        grams |= data[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    number, done = numbered(grams), 8
    while done < length:
        step = min(done, length - done)
        far = number[step:]
        near = number[: len(far)]
        spots = np.flatnonzero((near >= 0) & (far >= 0))
        number = np.full(len(far), -1, np.int64)
        number[spots] = numbered((near[spots].astype(np.uint64) << np.uint64(32)) | far[spots].astype(np.uint64))
        done += step
    return number[starts]


def repeated_windows(contexts: pa.Array, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in order of position to runs of windows that occur in an earlier one: context, first window, windows."""
    data, offsets = flat(contexts)
    row = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    number = refine(data, offsets[:-1][row] + window, length)
    open_ = np.flatnonzero(number >= 0)
    gone = np.zeros(len(row), bool)
    gone[open_] = ~first_seen(number[open_])
    spots = np.flatnonzero(gone)
    heads = np.ones(len(spots), bool)
    heads[1:] = (np.diff(spots) > 1) | (row[spots[1:]] != row[spots[:-1]])
    begin = np.flatnonzero(heads)
    return row[spots[begin]], window[spots[begin]], np.diff(np.append(begin, len(spots)))


def _refined(length: int):
    """Rows sorted by bucket and position to the removed windows of edges. Whole buckets are refined together, many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            which, first, n = repeated_windows(rows.column("context").combine_chunks(), rows.column("n").to_numpy().astype(np.int64), length)
            own = rows.select(["doc_id", "twin", "start"]).take(pa.array(which))
            start = pa.array(own.column("start").to_numpy() + first)
            for batch in own.drop_columns(["start"]).append_column("start", start).append_column("n", pa.array(n.astype(np.int32))).combine_chunks().to_batches():
                yield batch

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("context"))).as_py() or 0
                if size > BYTES_AT_ONCE:
                    rows = pa.Table.from_batches(held)
                    h = rows.column("h").to_numpy()
                    cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
                    if cut:
                        yield from told(rows.slice(0, cut))
                        held = rows.slice(cut).combine_chunks().to_batches()
                        size = sum(pc.sum(pc.binary_length(x.column("context"))).as_py() for x in held)
        if held:
            yield from told(pa.Table.from_batches(held))

    return run


def _cut_out(length: int):
    """Documents with their removed windows to counts and the digest of what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                spans = part.column("spans")
                items = spans.flatten()
                row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
                begin = offsets[:-1][row] + items.field("start").to_numpy()
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + items.field("n").to_numpy() + length - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                heads = gone.copy()
                heads[1:] &= ~gone[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                heads[edges] = gone[edges]
                n_removed = per_row(gone, offsets)
                raw, digests = data.tobytes(), []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    left = data[a:b][~gone[a:b]].tobytes() if n_removed[k] else raw[a:b]
                    digests.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(per_row(heads, offsets)), pa.array(digests)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


def told_apart(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, twin, text: twin is 0 when ids are unique and none is null; otherwise the rows are stored and numbered."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    twins = read.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if twins.isEmpty():
        return read.select("doc_id", F.lit(0).cast("long").alias("twin"), "text")
    return written(read.select("doc_id", F.monotonically_increasing_id().alias("twin"), "text"), "numbered")


def removed_windows(docs: DataFrame, kind: str, length: int, hot: int) -> DataFrame:
    """Runs of windows that also start earlier: doc_id, twin, start, n. ``docs`` comes from told_apart."""
    position = f"doc_id {kind}, twin long"
    runs = docs.mapInArrow(_find(length, secrets.randbits(64)), f"{position}, h long, c long, start long, n int, kind byte")
    told = written(classified(runs), "told")
    edges = told.where("NOT removed").drop("removed")
    crowds = edges.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("hot"))
    per_doc = edges.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("h", "start", "n")).alias("edges"))
    brought = docs.join(per_doc.withColumnsRenamed({"doc_id": "d", "twin": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t"))).select("doc_id", "twin", "text", "edges")
    contexts = brought.mapInArrow(_contexts(length), f"{position}, h long, start long, n int, context binary")
    crowds = written(crowds, "crowds")
    order = ["h", F.col("doc_id").asc_nulls_last(), "twin", "start"]
    removed = told.where("removed").select("doc_id", "twin", "start", "n")
    if crowds.isEmpty():
        refined = contexts.repartition("h").sortWithinPartitions(*order).mapInArrow(_refined(length), f"{position}, start long, n int")
        return removed.unionByName(refined)
    # windows of crowded buckets meet by content, pre-aggregated, whatever the size of the bucket
    contexts = written(contexts.join(crowds, "h", "left"), "contexts")
    calm = contexts.where("hot IS NULL").repartition("h").sortWithinPartitions(*order).mapInArrow(_refined(length), f"{position}, start long, n int")
    windows = contexts.where("hot").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    windows = windows.select("doc_id", "twin", (F.col("start") + F.col("k")).alias("start"), F.substring("context", F.col("k") + 1, F.lit(length)).alias("content"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "twin", "start")
    firsts = windows.groupBy("content").agg(F.min(place).alias("first"))
    later = windows.join(firsts, "content").where(place != F.col("first")).select("doc_id", "twin", "start", F.lit(1).alias("n"))
    return removed.unionByName(calm).unionByName(later)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT_BUCKET) -> DataFrame:
    """Remove every byte under a ``length``-byte string that also starts earlier: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Earlier is a smaller id, or the same document and an earlier byte; null ids come last, and rows that share an id come in the order of
    their storage. Matches never cross documents; overlaps count; strings are judged on the input. Null and empty texts have no bytes, and
    the digest of nothing. Texts are read whole, each row gives one row, other columns are not read; an empty table gives no rows.
    ``length`` is 32 at least.
    """
    if length < QGRAM + 8:
        raise ValueError(f"length must be at least {QGRAM + 8}")
    kind = docs.schema[doc_id].dataType.simpleString()
    apart = told_apart(docs, doc_id, text)
    windows = written(removed_windows(apart, kind, length, hot), "windows")
    spans = windows.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "n")).alias("spans")).withColumnsRenamed({"doc_id": "d", "twin": "t"})
    joined = apart.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_out(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
