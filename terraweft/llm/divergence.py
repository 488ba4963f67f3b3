"""Audit of sources against each other and against their language: exact divergences, and the terms that stand out, by dominance skybands."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraweft.functions.scale import bounded
from terraweft.llm.frames import written

#: Letters in UTF-8: A-Z, a-z and everything beyond ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PIECE = 1 << 20
#: Counted terms that a task holds before it passes them on.
HELD = 200_000
#: Sources of a block; a task holds sums for the pairs of two blocks.
BLOCK = 256
#: Pairs of one step of the pair sums.
STEP = 1 << 20
SALTS = 16


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms of one text, piece by piece; a piece ends where a term ends."""
    text, found, at = text.translate(LOWER), Counter(), 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        cut = TERM.match(text, end)
        end = cut.end() if cut else end
        found.update(TERM.findall(text, at, end))
        at = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs), added up over many documents; the empty term stands for the group itself."""
    n, docs, size = {}, {}, 0

    def rows() -> pa.RecordBatch:
        found = [(*group, term, c, docs[group][term]) for group, counts in n.items() for term, c in counts.items()]
        columns = [pa.array(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([*columns[:2], columns[2].cast(pa.string()), *columns[3:]], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            group = (lang.as_py(), source.as_py())
            if group not in n:
                n[group], docs[group] = Counter({b"": 0}), Counter({b"": 0})
            own, before = term_counts(text.as_buffer().to_pybytes()), len(n[group])
            n[group].update(own)
            docs[group].update(own.keys())
            size += len(n[group]) - before
            if size > HELD:
                yield rows()
                n, docs, size = {}, {}, 0
    if n:
        yield rows()


def share(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 * (count + 1) / total) for count < total, by long division to base 1000: exact below 9 * 10^15 occurrences."""
    first = f"({count} + 1) * 1000"
    second = f"({first} % {total}) * 1000"
    return f"1 + ({first}) div {total} * 1000000 + ({second}) div {total} * 1000 + (({second}) % {total} * 1000) div {total}"


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _skyband(k: int):
    """Of rows sorted by (lang, source, n descending, total, term), those that fewer than k others of their group dominate.

    A dominating row has as many occurrences in the group or more, as many in the lang or fewer, and an earlier term. All that dominate
    a row come before it, and k of them are in the skyband if k are anywhere, so only the skyband is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = run_of = None
        terms, totals, room = [], np.empty(0, np.int64), 0
        for batch in batches:
            stay = []
            columns = [batch.column(c).to_pylist() for c in ("lang", "source", "n", "total")]
            names = batch.column("term").cast(pa.binary()).to_pylist()
            for row, (lang, source, n, total, term) in enumerate(zip(*columns, names, strict=True)):
                if (lang, source) != group:
                    group, terms, totals, room, run_of = (lang, source), [], np.empty(1024, np.int64), 1024, None
                if (n, total) == run_of:
                    continue  # an earlier term with these counts is dominated by k others already
                at, size = bisect_left(terms, term), len(terms)
                if at >= k and np.count_nonzero(totals[:at] <= total) >= k:
                    run_of = (n, total)
                    continue
                if size == room:
                    totals, room = np.concatenate([totals, np.empty(room, np.int64)]), 2 * room
                totals[at + 1 : size + 1] = totals[at:size]
                totals[at] = total
                terms.insert(at, term)
                stay.append(row)
            yield batch.take(pa.array(stay, pa.int64()))

    return run


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """The rows of each group that fewer than k others dominate: skybands of partitions, merged over salts, then per group."""
    order = ["lang", "source", F.col("n").desc(), "total", "term"]
    for dealt in (None, ["lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS))], ["lang", "source"]):
        rows = rows if dealt is None else rows.repartition(*dealt)
        rows = rows.sortWithinPartitions(*order).mapInArrow(_skyband(k), rows.schema)
    return rows


def changes(column: pa.ChunkedArray) -> np.ndarray:
    """Flags of rows that differ from the row before, the first row included."""
    column = column.combine_chunks()
    return np.concatenate([[True], np.asarray(pc.not_equal(column[1:], column[:-1]))]) if len(column) else np.zeros(0, bool)


def whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows again, none of the tables ending inside a term (which has at most a row per source of two blocks)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if len(table):
            last = int(np.flatnonzero(changes(table["term"]) | changes(table["lang"]) | changes(table["a"]) | changes(table["b"]))[-1])
            yield table.slice(0, last)
            held = table.slice(last)
    if held is not None:
        yield held


class PairSums:
    """Sums over the terms that two sources share, for the pairs of sources of one block, or of one block with another."""

    def __init__(self, lang: str, a: int, b: int):
        self.lang, self.a, self.b = lang, a, b
        width = BLOCK if a == b else 2 * BLOCK
        self.value, self.shared = np.zeros((width, width), np.int64), np.zeros((width, width), np.int64)

    def add(self, sid: np.ndarray, p: np.ndarray, z: np.ndarray, starts: np.ndarray) -> None:
        """Rows of whole terms that begin at ``starts``: numbers of sources, shares of the term, shares of an absent term."""
        local = sid % BLOCK + np.where(sid // BLOCK == self.a, 0, BLOCK)
        size = np.diff(np.append(starts, len(sid)))
        first, size = np.repeat(starts, size), np.repeat(size, size)
        cost, at = np.cumsum(size), 0
        while at < len(local):
            to = max(at + 1, int(np.searchsorted(cost, cost[at] + STEP, side="right")))
            m = size[at:to]
            i = np.repeat(np.arange(at, to), m)
            k = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[at:to], m)
            meet = local[i] != local[k] if self.a == self.b else (local[i] < BLOCK) != (local[k] < BLOCK)
            i, k = i[meet], k[meet]
            # what one of the two gives where the other lacks the term is in the histograms already
            both = (p[i] - p[k]) ** 2 // p[k] - (p[i] - z[k]) ** 2 // z[k] - (z[i] - p[k]) ** 2 // p[k]
            np.add.at(self.value, (local[i], local[k]), both)
            np.add.at(self.shared, (local[i], local[k]), 1)
            at = to

    def rows(self) -> pa.RecordBatch:
        s, t = np.nonzero(self.shared)
        number = lambda i: np.where(i < BLOCK, self.a * BLOCK + i, self.b * BLOCK + i - BLOCK)
        columns = [pa.array([self.lang] * len(s), pa.string()), *map(pa.array, (number(s), number(t), self.value[s, t], self.shared[s, t]))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "s", "t", "value", "shared"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, a, b, term, sid, p, z) sorted by (lang, a, b, term) to (lang, s, t, value, shared)."""
    sums = None
    for table in whole_terms(batches):
        new = changes(table["lang"]) | changes(table["a"]) | changes(table["b"])
        starts = np.flatnonzero(new | changes(table["term"]))
        a, b, sid, p, z = (table[c].to_numpy() for c in ("a", "b", "sid", "p", "z"))
        edges = [*np.flatnonzero(new).tolist(), len(table)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            lang = table["lang"][lo].as_py()
            if sums is None or (sums.lang, sums.a, sums.b) != (lang, a[lo], b[lo]):
                if sums is not None:
                    yield sums.rows()
                sums = PairSums(lang, int(a[lo]), int(b[lo]))
            sums.add(sid[lo:hi], p[lo:hi], z[lo:hi], starts[(starts >= lo) & (starts < hi)] - lo)
    if sums is not None:
        yield sums.rows()


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms, for every two sources of a lang.

    A term that neither source has counts once, by number; a term that one has comes from the histogram of its shares; only terms that both have
    are met pair by pair, inside tasks that hold one sum per pair of two blocks of sources.
    """
    known = bounded(groups.select("lang", "source", "sid", "z", "size"))
    rows = kept.join(known, ["lang", "source"]).withColumn("p", F.expr(share("n", "size")))
    rows = rows.select("lang", "term", "sid", "p", "z")
    blocks = groups.groupBy("lang").agg(F.floor(F.max("sid") / BLOCK).cast("int").alias("last"))
    dealt = rows.join(bounded(blocks), "lang").withColumn("own", F.floor(F.col("sid") / BLOCK).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    dealt = dealt.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "term", "sid", "p", "z")
    dealt = dealt.repartition("lang", "a", "b", "term").sortWithinPartitions("lang", "a", "b", "term")
    met = dealt.mapInArrow(_pair_sums, "lang string, s long, t long, value long, shared long")
    # the histogram of a source against every other source of its lang
    shares = written(rows.groupBy("lang", "sid", "p", "z").agg(F.count(F.lit(1)).alias("h")), "shares")
    others = bounded(groups.select("lang", F.col("sid").alias("other"), F.col("z").alias("zo")))
    against = shares.join(others, "lang").where("sid <> other")
    alone = against.groupBy("lang", "sid", "other").agg(F.expr(f"sum(h * ({gap('p', 'zo')}))").alias("ahead"), F.expr(f"sum(h * ({gap('zo', 'p')}))").alias("behind"))
    alone = alone.selectExpr("lang", "inline(array(struct(sid AS s, other AS t, ahead AS value), struct(other AS s, sid AS t, behind AS value)))").withColumn("shared", F.lit(0))
    sums = met.unionByName(alone.withColumn("shared", F.col("shared").cast("long"))).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("shared").alias("shared"))
    left = groups.selectExpr("lang", "source", "sid AS s", "z AS zs", "terms AS ns", "v")
    right = groups.selectExpr("lang", "source AS item", "sid AS t", "z AS zt", "terms AS nt")
    pairs = left.join(right, "lang").where("s <> t").join(sums, ["lang", "s", "t"], "left")
    absent = f"(v - ns - nt + coalesce(shared, 0)) * ({gap('zs', 'zt')})"
    return pairs.select("lang", "source", "item", F.expr(f"if(v = 0, 0L, coalesce(value, 0L) + {absent})").alias("value"))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """How sources differ: lang, source, part, item, value, rank.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; a lang keeps the terms of at least ``least_docs`` of its documents. A
    (lang, source) group or a lang has the share p = 1 + floor(10^9 (count + 1) / (N + V)) of a kept term. With f = floor((p - q)^2 / q):
    part ``pair`` gives, for every two sources of a lang, f of p against q of the other source summed over all kept terms; part ``term`` the terms
    whose share in the group is above that in the lang, the first ``top`` by f. Ranks run per group and part by falling value, then by UTF-8 of
    the item. Null text, lang and source count as empty. Groups without terms take part; where a lang keeps none, pairs have 0. Every row
    is a document, also where ids repeat. An empty table gives no rows; other columns are not read. Exact below 9 * 10^15 occurrences.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    found = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    some = counts.where("term <> ''")
    totals = some.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(some.drop("docs").join(totals, ["lang", "term"]), "kept")
    # one row per group and lang
    vocabulary = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("terms"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0)
    groups = groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = groups.withColumns({"size": F.col("own_n") + F.col("v"), "lang_size": F.col("all_n") + F.col("v")})
    # where no term is kept there is no share; sizes of 1 keep the arithmetic defined
    groups = groups.withColumns({c: F.greatest(c, F.lit(1)) for c in ("size", "lang_size")})
    groups = written(groups.withColumn("z", F.expr(share("0", "size"))), "groups")
    rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(kept, groups).withColumn("rank", F.row_number().over(rank))
    # the terms ahead of their lang: whatever dominates one of them is ahead as well
    ahead = kept.join(bounded(groups.select("lang", "source", "size", "lang_size")), ["lang", "source"])
    ahead = ahead.withColumns({"p": F.expr(share("n", "size")), "q": F.expr(share("total", "lang_size"))}).where("p > q")
    band = skyband(ahead.select("lang", "source", "term", "n", "total", "p", "q"), top)
    terms = band.select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    parts = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, part in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])
