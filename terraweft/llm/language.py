"""Language identification with a small byte convolutional network, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.llm.frames import blocks
from terraweft.llm.words import per_row

WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 12, 8
UNKNOWN = "und"
#: The training sample: so many documents per language at most, with so many windows each.
PER_LANGUAGE, WINDOWS = 500, 4
#: Labels that are learned, the most frequent ones; and documents of the whole sample.
MOST_LANGUAGES, MOST_DOCUMENTS = 1000, 50_000
CHUNK = 128  # windows convolved at once


def remainder(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


class Network:
    """Byte embedding, filters of several widths, the maximum of each over a window, and a softmax over the languages.

    A filter is a sum of one table look-up per byte it spans: table[k][byte] = embedding[byte] . filter[k].
    """

    def __init__(self, labels: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.weights = {"embedding": rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, (w * DEPTH) ** -0.5, (w, DEPTH, FILTERS)).astype(np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.weights["bias"] = np.zeros(len(labels), np.float32)
        self.weights["shift"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)

    def tables(self, width: int) -> list[np.ndarray]:
        return [self.weights["embedding"] @ k for k in self.weights[f"filter{width}"]]

    def fit(self, windows: np.ndarray, targets: np.ndarray, epochs: int = 8, steps: int = 1000, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the cross-entropy; only the window that wins a maximum gets a gradient.

        Runs ``epochs`` times over the sample, more often where that makes fewer than ``steps`` steps; the rate falls to a sixtieth.
        """
        rng = np.random.default_rng(2)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        per_epoch = -(-len(windows) // batch)
        total = per_epoch * max(epochs, -(-steps // per_epoch))
        for step in range(1, total + 1):
            if (step - 1) % per_epoch == 0:
                order = rng.permutation(len(windows))
            at = (step - 1) % per_epoch * batch
            own = order[at : at + batch]
            for k, g in self._gradients(windows[own], targets[own]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
                self.weights[k] -= (rate * 60 ** (-step / total)) * move

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        best, where = [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            raw = sum(t[x[:, k : k + span]] for k, t in enumerate(self.tables(w)))
            where.append(raw.argmax(axis=1))
            best.append(np.take_along_axis(raw, where[-1][:, None, :], axis=1)[:, 0])
        hidden = np.concatenate(best, axis=1) + self.weights["shift"]
        active = np.maximum(hidden, 0)
        grad = softmax(active @ self.weights["out"] + self.weights["bias"])
        grad[np.arange(len(y)), y] -= 1
        grad /= len(y)
        out = {"out": active.T @ grad, "bias": grad.sum(axis=0), "embedding": np.zeros_like(self.weights["embedding"])}
        back = (grad @ self.weights["out"].T) * (hidden > 0)
        out["shift"] = back.sum(axis=0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            kernel = self.weights[f"filter{w}"]
            change = np.zeros_like(kernel)
            for j in range(w):
                spelled = x[rows, where[k] + j]  # byte under tap j of the winning place, (batch, filters)
                change[j] = np.einsum("bf,bfd->df", own, self.weights["embedding"][spelled])
                np.add.at(out["embedding"], spelled, own[:, :, None] * kernel[j].T[None])
            out[f"filter{w}"] = change
        return out

    def compiled(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The network for many windows: look-ups of byte pairs instead of bytes."""

    def __init__(self, net: Network):
        self.net, self.plan = net, []
        for w in WIDTHS:
            single = net.tables(w)
            steps = []
            for k in range(0, w - 1, 2):
                steps.append((k, True, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, FILTERS)))
            if w % 2:
                steps.append((w - 1, False, single[w - 1]))
            self.plan.append((w, steps))

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities per window."""
        out = np.empty((len(windows), len(self.net.labels)), np.float32)
        for at in range(0, len(windows), CHUNK):
            x = windows[at : at + CHUNK].astype(np.int32)
            pair = x[:, :-1] * 256 + x[:, 1:]
            best = []
            for w, steps in self.plan:
                span = x.shape[1] - w + 1
                raw = None
                for k, double, table in steps:
                    part = table.take((pair if double else x)[:, k : k + span], axis=0)
                    raw = part if raw is None else np.add(raw, part, out=raw)
                best.append(raw.max(axis=1))
            hidden = np.maximum(np.concatenate(best, axis=1) + self.net.weights["shift"], 0)
            out[at : at + CHUNK] = softmax(hidden @ self.net.weights["out"] + self.net.weights["bias"])
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, zero-filled at the end: the windows, their row, their bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][row] + number * WINDOW
    held = np.minimum(WINDOW, offsets[1:][row] - begin)
    padded = np.concatenate([lower_table()[data], np.zeros(WINDOW, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin] if len(row) else np.zeros((0, WINDOW), np.uint8)
    short = np.flatnonzero(held < WINDOW)
    windows[short] *= np.arange(WINDOW)[None, :] < held[short, None]
    return windows, row, held


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS windows of each sampled document, evenly spaced over all of its text. Copies that a task has seen give nothing."""
    seen = set()
    for batch in batches:
        fresh = []
        for key in zip(batch.column("lang").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            fresh.append(key not in seen)
            seen.add(key)
        for part, data, offsets in blocks(batch.filter(pa.array(fresh, pa.bool_())), "text"):
            windows, row, _ = cut(data, offsets)
            n = np.bincount(row, minlength=len(offsets) - 1)
            first = np.cumsum(n) - n
            picks = [(first[k] + i * n[k] // min(WINDOWS, n[k]), i) for k in range(len(n)) for i in range(min(WINDOWS, n[k]))]
            own = row[[p for p, _ in picks]] if picks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(own)), part.column("digest").take(pa.array(own)), pa.array([i for _, i in picks], pa.int32()), pa.array([windows[p].tobytes() for p, _ in picks], pa.binary())],
                names=["lang", "digest", "number", "window"],
            )


def sample(labelled: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """Windows of at most ``per_language`` documents of each language: lang, digest, number, window; one row per window.

    ``counts`` are numbers of digests. The lowest digests are taken, each once however many rows have it.
    """
    # about 1.2 times the sample by hash, then cut to the bound
    scale = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(1.2 * scale * per_language / n) + 1))]), F.col("lang"))
    order = F.pmod("digest", F.lit(scale))
    chosen = labelled.where(order < share).select("text", "lang", "digest")
    windows = chosen.mapInArrow(_samples, "lang string, digest long, number int, window binary")
    # the same window from many tasks is one row; texts that share a digest by chance do not add rows
    windows = windows.groupBy("lang", "digest", "number").agg(F.min("window").alias("window"))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy(order, "digest"))
    return windows.withColumn("place", place).where(F.col("place") <= per_language)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """Fit on at most ``per_language`` labelled documents of each language, four windows each; None without labelled text.

    Of more than MOST_LANGUAGES labels the most frequent are learned (ties: first by name); the sample holds MOST_DOCUMENTS documents at most, so
    beyond a hundred labels each has a smaller share of it.
    Documents whose crc32 of the id leaves 1 modulo 3 are never read. The choice goes by a hash of id and text, so it repeats, and rows that
    share an id, or have none, are documents of their own; rows that share both count once.
    """
    rows = docs.select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("digest"), remainder(doc_id).alias("fold")
    )
    labelled = rows.where("lang IS NOT NULL AND text IS NOT NULL AND text <> '' AND fold <> 1")
    found = labelled.select("lang", "digest").distinct().groupBy("lang").count().orderBy(F.col("count").desc(), "lang")
    counts = {r[0]: r[1] for r in found.limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    per_language = max(1, min(per_language, MOST_DOCUMENTS // len(counts)))
    taken = sample(labelled, counts, per_language).toPandas().sort_values(["lang", "place", "number"])
    labels = sorted(counts)
    windows = np.frombuffer(b"".join(taken.window), np.uint8).reshape(-1, WINDOW)
    net = Network(labels)
    if len(labels) > 1:
        net.fit(windows, taken.lang.map({k: i for i, k in enumerate(labels)}).to_numpy())
    return net


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.compiled() if net else None
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                names, scores = predict(part.column("text"), data, offsets, score)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, score: Scorer | None) -> tuple[list[str], list[float]]:
    """Language and probability of each text: the mean over all of its windows, weighted by their bytes."""
    rows = len(offsets) - 1
    letters = per_row(((data | 0x20) >= ord("a")) & ((data | 0x20) <= ord("z")), offsets) > 0
    for k in np.flatnonzero(~letters & (per_row(data >= 0x80, offsets) > 0)).tolist():
        letters[k] = any(c.isalpha() for c in texts[k].as_py())
    if score is None:
        return [UNKNOWN] * rows, [0.0] * rows
    windows, row, held = cut(data, offsets)
    mean = np.zeros((rows, len(score.net.labels)))
    np.add.at(mean, row, score(windows) * held[:, None])
    mean /= np.maximum(np.diff(offsets), 1)[:, None]
    best = mean.argmax(axis=1)
    names = [score.net.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    scores = [min(1.0, float(mean[k, b])) if ok else 0.0 for k, (b, ok) in enumerate(zip(best.tolist(), letters.tolist(), strict=True))]
    return names, scores


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score (0 to 1).

    The network learns from text and label of the documents that are not held out and predicts from text alone, all windows of all texts.
    A text that is null, empty or without a letter is ``und`` with score 0, and so is every text when there is no label to learn from. Among
    equal probabilities the first label by name wins. Each row gives one row, a null id is held out by the digest of an empty id; other
    columns are not read.
    """
    net = train(docs, doc_id, text, lang, per_language)
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (remainder(doc_id) == 1).alias("held_out"))
    return read.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_score: float = 0.4, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least_score`` at least, all columns as they were.

    Null, empty and letterless texts go. Without a label to learn from, no text is identified and no row stays.
    """
    net = train(docs, doc_id, text, lang, per_language)
    return docs.mapInArrow(_keep(net, text, least_score), docs.schema)


def _keep(net: Network | None, text: str, least_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.compiled() if net else None
        for batch in batches:
            for part, data, offsets in blocks(batch, text):
                names, scores = predict(part.column(text), data, offsets, score)
                yield part.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return run
