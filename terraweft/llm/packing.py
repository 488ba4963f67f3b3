"""Best-fit packing of documents into bins, where no bin holds a source or a duplicate cluster twice."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.llm.exact import normalised
from terraweft.llm.frames import written
from terraweft.llm.mixing import word_count

CAPACITY, SHARD_ROWS = 2048, 4096


class Bins:
    """Open bins in the order of their residual, each with a bitmap of its sources and one of its duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.sources, self.clusters = capacity, [], [], []
        self.residuals: list[int] = []  # ascending, those that any bin has
        self.holding: dict[int, list[int]] = {}  # bins by residual, ascending

    def open(self) -> int:
        self.free.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.free) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and position of a piece: the tightest compatible bin, the earliest among equals, or a new one."""
        at = bisect_left(self.residuals, size)
        while at < len(self.residuals):
            residual = self.residuals[at]
            own = self.holding[residual]
            for k, number in enumerate(own):
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    del own[k]
                    if not own:
                        del self.holding[residual]
                        del self.residuals[at]
                    return self._fill(number, size, source, cluster)
            at += 1
        return self._fill(self.open(), size, source, cluster)

    def _fill(self, number: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        begin = self.capacity - self.free[number]
        self.free[number] -= size
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if left := self.free[number]:
            if left not in self.holding:
                self.holding[left] = []
                insort(self.residuals, left)
            insort(self.holding[left], number)
        return number, begin


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack the pieces of one shard: whole bins of long documents first, then the rests, largest first."""
    rows = rows.sort_values(["row"], kind="stable")
    rows = rows.sort_values(["doc_id"], kind="stable", na_position="last").reset_index(drop=True)
    bits = {}
    shared = rows.cluster.duplicated(keep=False)
    sources = [1 << bits.setdefault(s, len(bits)) for s in rows.source.where(rows.source.notna(), None)]
    marks: dict = {}
    clusters = [1 << marks.setdefault(c, len(marks)) if twice else 0 for c, twice in zip(rows.cluster, shared, strict=True)]
    bins, out = Bins(capacity), []
    for k, size in enumerate(rows["size"].tolist()):
        for piece in range(size // capacity):
            out.append((k, piece, capacity, *bins.place(capacity, sources[k], clusters[k])))
    rest = (rows["size"] % capacity).sort_values(ascending=False, kind="stable")
    for k, size in rest[rest > 0].items():
        out.append((k, int(rows["size"][k]) // capacity, size, *bins.place(size, sources[k], clusters[k])))
    placed = pd.DataFrame(out, columns=["k", "piece", "n_tokens", "number", "bin_offset"]).astype("int64")
    shard = int(rows["shard"].iloc[0])
    found = rows.loc[placed.k, ["doc_id", "source", "cluster"]].reset_index(drop=True)
    return found.assign(piece=placed.piece, n_tokens=placed.n_tokens, bin_id=placed.number + (shard << 32), bin_offset=placed.bin_offset)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack documents by their words: doc_id, source, cluster, piece, n_tokens, bin_id, bin_offset.

    A document longer than a bin is cut into pieces of ``capacity`` words, the last one shorter. No bin holds two pieces of one source or of
    one duplicate cluster (``cluster`` names a column; without it, equal texts up to spaces are a cluster). A null source is a source. Rows are
    dealt by a hash of the id (of id and place, where ids repeat) into shards of about ``shard_rows``, packed on their own: best fit, largest
    first, then by id; ties go to the bin opened first. Shards of a few thousand rows fill bins within a hundredth of one packing of all rows. A document without words (null, empty) has no piece and no row. Repeated rows are packed each, in different bins.
    An empty table gives no rows; other columns are not read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    key = F.col(cluster).cast("string") if cluster else F.sha2(normalised(text), 256)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(key).alias("cluster"))
    sized = written(sized.where("size > 0").withColumn("row", F.monotonically_increasing_id()), "sizes")
    shards = max(1, -(-sized.count() // shard_rows))
    # rows that share an id, or have none, are dealt by their place in storage as well, so that no id fills a shard
    twins = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id") if twins.isEmpty() else F.xxhash64("doc_id", "row"), F.lit(shards)))
    schema = f"doc_id {kinds[doc_id]}, source string, cluster long, piece long, n_tokens long, bin_id long, bin_offset long"
    return dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), schema)
