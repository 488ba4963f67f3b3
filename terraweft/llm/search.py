"""Exact nearest vectors by inner product: local score lists, a safe cutoff, sufficient entries, exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraweft.llm.frames import written

#: Vectors of one task; of queries, as many come along as PANEL.
BLOCK = 1 << 18
PANEL = 1 << 16
#: Least vectors that are worth a task.
SMALL = 4096
#: Scores that a task holds at once.
SCORES = 1 << 22
SEGMENTS = 2
#: The score below which there is none; a cutoff there leaves nothing out.
LOWEST = -(1 << 63)


def exact_kind(*largest: int) -> type:
    """The number type in which sums of products up to this size are exact."""
    size = int(np.prod([int(x) for x in largest], dtype=object))
    return np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else object


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


class Tile:
    """Vectors of one block in segments of their components; every segment is a node that scores queries on its own."""

    def __init__(self, vectors: list[pa.ListArray], segments: int):
        self.width = max((int(np.diff(v.offsets.to_numpy()).max(initial=0)) for v in vectors), default=0)
        self.vectors = np.concatenate([matrix(v, self.width) for v in vectors])
        self.cuts = np.linspace(0, self.width, segments + 1).astype(int)
        self.largest = int(max(-int(self.vectors.min(initial=0)), int(self.vectors.max(initial=0))))

    def scores(self, queries: np.ndarray) -> list[np.ndarray]:
        """Exact scores of the segments, (queries, vectors) each; queries are cut to the components that vectors have."""
        kind = exact_kind(max(-int(queries.min(initial=0)), int(queries.max(initial=0))) + 1, self.largest + 1, self.width + 1)
        return [queries[:, a:z].astype(kind) @ self.vectors[:, a:z].astype(kind).T for a, z in zip(self.cuts[:-1], self.cuts[1:], strict=True)]


def highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, in any order."""
    n = scores.shape[1]
    if k >= n:
        return np.tile(np.arange(n), (len(scores), 1))
    if scores.dtype == object:
        return np.array([sorted(range(n), key=row.__getitem__)[-k:] for row in scores])
    return np.argpartition(scores, n - k, axis=1)[:, n - k :]


def _phase(k: int, segments: int, lists: bool):
    """Rows sorted by (block, panel, asks): vectors, then queries. Gives entries (query, name, ids, first, score).

    ``lists``: the vectors on the local lists of any segment, the k highest scores there. Else those with a score in any segment that reaches its
    share of the query's cutoff, since a sum that reaches the cutoff has such a part; their scores are completed over all segments, and the k
    best of them that reach the cutoff remain, by score and first id.
    """

    def entries(tile: Tile, own: pa.RecordBatch, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        width = int(np.diff(rows.column("vector").offsets.to_numpy()).max(initial=0))
        queries = matrix(rows.column("vector"), max(width, tile.width))[:, : tile.width]
        first = own.column("first").to_numpy()
        cutoffs = rows.column("cutoff").fill_null(LOWEST).to_numpy()
        unbound = cutoffs == LOWEST
        step = max(1, SCORES // len(own))
        for at in range(0, len(queries), step):
            parts = tile.scores(queries[at : at + step])
            if lists:
                chosen = np.sort(np.concatenate([highest(p, k) for p in parts], axis=1), axis=1)
                once = np.ones(chosen.shape, bool)
                once[:, 1:] = chosen[:, 1:] != chosen[:, :-1]
                i, j = np.nonzero(once)[0], chosen[once]
            else:
                share = cutoffs[at : at + step, None]
                share = share // segments + (share % segments > 0)
                reached = np.repeat(unbound[at : at + step, None], len(own), axis=1)
                for p in parts:
                    reached |= np.asarray(p >= share, bool)
                i, j = np.nonzero(reached)
            total = np.zeros(len(i), object if parts[0].dtype == object else np.int64)
            for p in parts:
                total += p[i, j].astype(total.dtype)
            if total.dtype == object:
                total = np.array([min(max(t, LOWEST), (1 << 63) - 1) for t in total.tolist()], np.int64)
            if not lists:
                stay = unbound[at + i] | (total >= cutoffs[at + i])
                i, j, total = i[stay], j[stay], total[stay]
                order = np.lexsort((first[j], ~total, i))
                i, j, total = i[order], j[order], total[order]
                stay = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j, total = i[stay], j[stay], total[stay]
            found = own.take(pa.array(j))
            asks = rows.column("name").take(pa.array(at + i))
            yield pa.RecordBatch.from_arrays([asks, *(found.column(c) for c in ("name", "ids", "first")), pa.array(total, pa.int64())], names=["query", "name", "ids", "first", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tile, held = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "panel", "asks")), strict=True))
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                block, panel, asks = keys[lo]
                part = batch.slice(lo, hi - lo)
                if (block, panel) != cell:
                    cell, tile, held = (block, panel), None, []
                if not asks:
                    held.append(part)
                elif held:
                    if tile is None:
                        tile = Tile([h.column("vector") for h in held], segments)
                        held = [pa.Table.from_batches(held).select(["name", "ids", "first"]).combine_chunks().to_batches()[0]]
                    yield from entries(tile, held[0], part)

    return run


def top_k(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: int = 256, segments: int = SEGMENTS, block: int = BLOCK, panel: int = PANEL
) -> DataFrame:
    """The k vectors with the highest scores for every query: query_id, rank, vec_id, score.

    Queries are the rows whose integer id ``every`` divides; candidates are all rows but the query's own. A component x counts as floor(scale * x),
    the score is the integer inner product; ties go to the smaller id, null ids last. Shorter vectors end in zeros. Vectors that are null or hold a
    null, NaN or infinite component take no part; rows that repeat an id, a vector or both are rows of their own, as queries and as candidates.
    Fewer candidates give fewer rows, an empty table none. Components beyond 2^63 / scale and scores beyond a long count as the nearest long. Other
    columns are not read.

    Equal vectors are one entry with its k + 1 smallest ids. Blocks of vectors are scored by segments of the components. First every segment gives its
    k + 1 highest entries; their exact scores give each query a cutoff that k + 1 rows reach. Then every segment gives the entries that reach its
    share of the cutoff, so none that reaches the cutoff is missing. Last their scores are completed and the k + 1 best rows, less the query's own,
    remain.
    """
    spark = rows.sparkSession
    plain = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    read = rows.where(F.col(vector).isNotNull() & plain).select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("vector"))
    read = written(read.withColumn("name", F.unhex(F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256))), "vectors")
    few = Window.partitionBy("name").orderBy(F.col("vec_id").asc_nulls_last())
    least = read.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda x: x["vec_id"])
    last = F.lit((1 << 63) - 1)
    entries = least.groupBy("name").agg(F.first("vector").alias("vector"), ids.alias("ids"), F.coalesce(F.min("vec_id"), last).alias("first"))
    entries = written(entries, "entries")
    asking = written(read.where(F.col("vec_id") % every == 0).groupBy("name", "vec_id").agg(F.count(F.lit(1)).cast("int").alias("times")), "asking")
    questions = written(entries.join(asking.select("name").distinct(), "name", "left_semi").select("name", "vector"), "questions")
    n, asked = entries.count(), questions.count()
    slots = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // SMALL)))
    panels = max(1, -(-asked // panel))
    place = lambda count: F.pmod(F.xxhash64("name"), F.lit(count)).cast("int")
    every_one = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    sides = entries.withColumns({"block": place(slots), "panel": every_one(panels), "asks": F.lit(False), "cutoff": F.lit(None).cast("long")})

    def entries_of(queries: DataFrame, lists: bool) -> DataFrame:
        spread = queries.withColumns({"block": every_one(slots), "panel": place(panels), "asks": F.lit(True), "ids": F.lit(None).cast("array<long>"), "first": last})
        both = sides.unionByName(spread.select(*sides.columns))
        dealt = both.repartition("block", "panel").sortWithinPartitions("block", "panel", "asks")
        return dealt.mapInArrow(_phase(k + 1, segments, lists), "query binary, name binary, ids array<long>, first long, score long")

    lists = entries_of(questions.withColumn("cutoff", F.lit(None).cast("long")), True).select("query", "name", F.size("ids").alias("copies"), "score")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "name")
    lists = lists.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = lists.withColumn("reach", F.sum("copies").over(best.rowsBetween(Window.unboundedPreceding, 0)))
    cutoffs = lists.where(F.col("reach") >= k + 1).groupBy("query").agg(F.max("score").alias("cutoff"))
    cutoffs = written(questions.join(cutoffs, questions.name == cutoffs["query"], "left").select("name", "vector", "cutoff"), "cutoffs")
    found = entries_of(cutoffs, False).select("query", "score", (F.col("name") == F.col("query")).alias("own"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    hits = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score", "own"))).alias("hits"))
    # a query's own row is one of its vector's, by id; where it is among the hits, it goes
    each = asking.withColumnRenamed("vec_id", "query_id").join(hits, asking.name == hits["query"]).withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
    itself = F.expr("coalesce(array_min(transform(filter(hits, h -> h.own AND h.vec_id = query_id), h -> h.nth)), 0)")
    each = each.withColumn("itself", itself).selectExpr("query_id", f"posexplode(slice(filter(hits, h -> h.nth <> itself), 1, {k})) AS (at, hit)")
    return each.selectExpr("query_id", "CAST(at + 1 AS int) AS rank", "hit.vec_id", "hit.score")
