"""Groups of spelling variants: words one edit apart, found by search schemes on FM-indexes read in both directions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.functions.scale import bounded
from terraweft.llm.frames import written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Counted words that a task holds before it passes them on.
HELD = 200_000
#: Words of one index. Words that share a half are dealt to one index, or to several where they are more.
INDEXED = 50_000
#: Words that are searched at once.
ASKED = 4096


def _counted(least: int, every: int):
    """Rows (doc_id, text) to (word, n), added up over many documents. Of a run whose crc32 ``every`` divides, one code point goes."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes().translate(LOWER).decode()
                seed = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(map(re.Match.group, runs.finditer(raw))).items():
                    mark = zlib.crc32(word.encode(), seed)
                    if mark % every == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    return run


class FmIndex:
    """FM-index over words of Latin-1 bytes without zeros, each followed by a delimiter, that reads words from their first byte on.

    The rows are the suffixes of the words read backwards, so the backward search goes forwards through a word; ranks of a byte are positions in one
    sorted array. Suffixes that are equal up to their delimiter keep the order of their words, hence the delimiters in the transform number the words.
    """

    def __init__(self, words: list[bytes]):
        self.words = sorted(w[::-1] for w in words)
        text = np.frombuffer(b"\0".join(self.words) + b"\0", np.uint8)
        self.n, self.size = len(text), len(self.words)
        ends = np.flatnonzero(text == 0)
        left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(self.n)
        order = self.sorted_suffixes(text, left)
        before = text[order - 1]
        self.symbols = np.unique(before).astype(np.int64)
        places = np.argsort(before, kind="stable")
        self.keys = before[places].astype(np.int64) * self.n + places
        self.before = before
        self.words = [w[::-1] for w in self.words]

    @staticmethod
    def sorted_suffixes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Starts of the suffixes in order, by prefix doubling from 7 bytes on; ``left`` has the bytes up to the own delimiter."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        rank = np.zeros(n, np.int64)
        for k in range(7):
            rank = rank << 8 | np.where(left > k, padded[k : n + k], 0)
        width, longest = 7, int(left.max(initial=0))
        while True:
            order = np.argsort(rank, kind="stable")
            ranked = rank[order]
            if width > longest:
                return order
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            follow = np.zeros(n, np.int64)
            on = np.flatnonzero(left > width)
            follow[on] = number[on + width] + 1
            rank, width = number * (n + 2) + follow, 2 * width

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-rank intervals after one more byte; a delimiter leads to numbers of words."""
        at = symbol.astype(np.int64) * self.n
        return np.searchsorted(self.keys, at + low), np.searchsorted(self.keys, at + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All bytes that go on from each interval: number of the interval, byte, interval after it. Equal intervals are looked at once."""
        pairs, which = np.unique(low * (self.n + 1) + high, return_inverse=True)
        low, high = pairs // (self.n + 1), pairs % (self.n + 1)
        narrow = np.flatnonzero(high - low <= len(self.symbols))
        wide = np.flatnonzero(high - low > len(self.symbols))
        m = (high - low)[narrow]
        at = np.repeat(low[narrow], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        found = np.unique(np.repeat(narrow, m) << 8 | self.before[at])
        own = np.concatenate([found >> 8, np.repeat(wide, len(self.symbols))])
        symbol = np.concatenate([found & 255, np.tile(self.symbols, len(wide))])
        lo, hi = self.step(symbol, low[own], high[own])
        some = hi > lo
        own, symbol, lo, hi = own[some], symbol[some], lo[some], hi[some]
        order = np.argsort(own, kind="stable")
        own, symbol, lo, hi = own[order], symbol[order], lo[order], hi[order]
        first, count = np.searchsorted(own, np.arange(len(pairs))), np.bincount(own, minlength=len(pairs))
        m = count[which]
        at = np.repeat(first[which], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        return np.repeat(np.arange(len(which)), m), symbol[at], lo[at], hi[at]

    def search(self, asked: list[bytes], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of asked word, number of indexed word): equal in the first ``half`` bytes, one edit apart after them.

        The error comes where the indexed word takes a byte that the asked word does not have there, so every pair has one place for it: a byte put
        in beside equal ones goes after them, and of equal bytes the last one is left out.
        """
        data = np.frombuffer(b"\0".join(asked) + b"\0\0\0", np.uint8)
        length = np.array([len(w) for w in asked], np.int64)
        start = np.cumsum(length + 1) - length - 1
        word = np.arange(len(asked))
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), self.size)
        for k in range(int(half.max(initial=0))):
            on = np.flatnonzero(half[word] > k)
            low[on], high[on] = self.step(data[start[word[on]] + k], low[on], high[on])
            stay = high > low
            word, low, high = word[stay], low[stay], high[stay]
        place, pairs = half[word].copy(), []
        while len(word):
            own, symbol, lo, hi = self.branches(low, high)
            asks, at = word[own], place[own]
            due = data[start[asks] + at]
            other = symbol != due
            asks, at, due, symbol, lo, hi = (x[other] for x in (asks, at, due, symbol, lo, hi))
            inside, goes_on = at < length[asks], symbol != 0
            pairs.append((asks[~goes_on & (at == length[asks] - 1)], lo[~goes_on & (at == length[asks] - 1)]))
            put, swap = goes_on, goes_on & inside
            # after the last byte comes the delimiter, and data goes on beyond it
            drop = goes_on & (at + 1 < length[asks]) & (symbol == data[start[asks] + at + 1])
            tail = [np.concatenate([x[put], x[swap], x[drop]]) for x in (asks, lo, hi)]
            pairs += self.rest(data, start, length, *tail, np.concatenate([at[put], at[swap] + 1, at[drop] + 2]))
            on = place < length[word]
            word, place, low, high = word[on], place[on], low[on], high[on]
            low, high = self.step(data[start[word] + place], low, high)
            stay = high > low
            word, place, low, high = word[stay], place[stay] + 1, low[stay], high[stay]
        return tuple(np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))

    def rest(self, data, start, length, word, low, high, place) -> list[tuple[np.ndarray, np.ndarray]]:
        """Goes on without an error to the delimiter."""
        pairs = []
        while len(word):
            low, high = self.step(data[start[word] + place], low, high)
            stay = high > low
            word, low, high, place = word[stay], low[stay], high[stay], place[stay]
            done = place == length[word]
            pairs.append((word[done], low[done]))
            word, low, high, place = word[~done], low[~done], high[~done], place[~done] + 1
        return pairs


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (side, bucket, own, part, asks, text): words of an index, then words to ask it. Gives (word, n_near, best)."""
    cell, index = None, None
    counts: dict[bytes, int] = {}
    asked: list[tuple[str, bytes]] = []

    def answer() -> pa.RecordBatch:
        nonlocal index, asked
        found: dict[str, list] = {}
        if counts:
            index = index or FmIndex(list(counts))
            backwards = cell[0] == 1
            # words are read backwards on the second side; the half that must be equal is the rest of the first side's half
            half = np.array([(len(raw) + 1) // 2 if backwards else len(raw) // 2 for _, raw in asked], np.int64)
            for i, k in zip(*(x.tolist() for x in index.search([raw for _, raw in asked], half)), strict=True):
                raw, other = asked[i][1], index.words[k]
                if backwards and other.endswith(raw[half[i] :]):
                    continue  # the first half is equal as well: found on the first side
                name = (other[::-1] if backwards else other).decode("latin-1")
                found.setdefault(asked[i][0], []).append((-counts[other], name))
        asked = []
        best = [min(f) for f in found.values()]
        columns = ((list(found), pa.string()), ([len(f) for f in found.values()], pa.int64()), ([b[0] for b in best], pa.int64()), ([b[1] for b in best], pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["word", "n_near", "minus", "near"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("side", "bucket", "own", "part", "asks", "text", "n"))
        for side, bucket, own, part, asks, text, n in zip(*columns, strict=True):
            if (side, bucket, own, part) != cell:
                if asked:
                    yield answer()
                cell, index, counts = (side, bucket, own, part), None, {}
            raw = text.encode("latin-1")
            if asks:
                asked.append((text[::-1] if side else text, raw))
                if len(asked) == ASKED:
                    yield answer()
            else:
                counts[raw] = n
    if asked:
        yield answer()


def near_words(words: DataFrame, indexed: int = INDEXED) -> DataFrame:
    """Of words (word, n), those with near words: word, n_near, minus and near, the largest count (negative) and its first word.

    Two words one edit apart share one half of the asked word, its first or its last, so every word is dealt by the halves that words of its length
    and of lengths next to it can ask for, forwards and backwards. A half with more than ``indexed`` words fills several indexes, and what asks for
    it asks each of them.
    """
    length = "length(word)"
    halves = f"""array(
      struct(0 AS side, word AS text, {length} div 2 AS own, {length} div 2 + if({length} % 2 = 1, 1, -1) AS next),
      struct(1 AS side, reverse(word) AS text, ({length} + 1) div 2 AS own, ({length} + 1) div 2 + if({length} % 2 = 1, -1, 1) AS next))"""
    dealt = words.selectExpr("n", f"inline({halves})")
    dealt = dealt.selectExpr("n", "side", "text", "inline(array(struct(false AS asks, own AS size), struct(false AS asks, next AS size), struct(true AS asks, own AS size)))")
    dealt = written(dealt.selectExpr("side", "left(text, CAST(size AS int)) AS half", "asks", "text", "n"), "halves")
    loads = dealt.where("NOT asks").groupBy("side", "half").agg(F.ceil(F.count(F.lit(1)) / indexed).cast("int").alias("parts"))
    hot = bounded(written(loads.where("parts > 1"), "hot_halves"))
    buckets = max(1, -(-dealt.count() // indexed))
    rows = dealt.join(hot, ["side", "half"], "left").withColumn("bucket", F.pmod(F.xxhash64("side", "half"), F.lit(buckets)).cast("int"))
    # part 0 has the halves that fit one index; a larger half has parts of its own, where no other half brings its words again
    rows = rows.withColumn("own", F.when(F.col("parts").isNotNull(), F.col("half")).otherwise(F.lit("")))
    rows = rows.withColumn("part", F.explode(F.expr("CASE WHEN parts IS NULL THEN array(0) WHEN asks THEN sequence(1, parts) ELSE array(CAST(pmod(xxhash64(text), parts) AS int) + 1) END")))
    order = ["side", "bucket", "own", "part", "asks", "text"]
    rows = rows.select(*order, "n").repartition("side", "bucket", "own", "part").sortWithinPartitions(*order)
    found = rows.mapInArrow(_near, "word string, n_near long, minus long, near string")
    best = F.min(F.struct("minus", "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), by pointer jumping; counts grow tenfold along a chain, so few rounds do."""
    state = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = state.select(F.col("word").alias("via"), F.col("root").alias("further"))
        state = written(state.join(on, state.root == on.via, "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, factor: int = 10, every: int = 31, indexed: int = INDEXED
) -> DataFrame:
    """Spelling variants: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Where ``every`` divides the crc32 h of ``<doc_id>:<run>`` the run loses its
    code point h % length. What then has ``least_length`` code points or more and ``least_count`` occurrences (n) is a word. Words are near if
    one inserted, deleted or replaced code point makes one the other; n_near counts near words. The form of a word is its near word of
    largest n (ties: first in code-point order) if that n is ``factor`` times its own or more, else null; root is the last word that forms lead
    to, the word itself without a form. Null text has no words; a null id is written as nothing before the colon; rows that share an id count each.
    An empty table gives no rows; other columns are not read.
    """
    read = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = read.mapInArrow(_counted(least_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(counted.where(F.col("n") >= least_count), "words")
    found = words.join(near_words(words, indexed), "word", "left")
    has_form = F.col("minus") <= -factor * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("near")).alias("form"), F.when(has_form, -F.col("minus")).alias("form_n"))
    found = written(found, "found")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
