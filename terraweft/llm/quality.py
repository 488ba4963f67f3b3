"""Line-first cleaning: rules per line, then a verdict on what is left of the document."""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.llm.frames import blocks
from terraweft.llm.words import Spans, chained, first_seen, keyed, per_row, repeated, rows_of, word_spans

#: The contract's symbols, window and base limits.
SYMBOLS, WINDOW, FEWEST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30
#: Phrases of boilerplate lines, in either case.
BOILERPLATE = (
    "cookie policy|uses? cookies|accept (all )?cookies|privacy policy|terms of (use|service)|all rights reserved|enable javascript"
    "|javascript (is|must be) (disabled|enabled)|lorem ipsum|click here|read more|sign up|log in|subscribe to|follow us on|share (this|on)"
    "|skip to (main )?content|back to top|powered by|add to cart|leave a (comment|reply)"
)
#: A line with phrases fails when it has at most so many words, or when the phrases make up at least one word in so many.
SHORT_LINE, PHRASE_SHARE = 12, 5
#: A line fails with more than one such mark in ten characters, three separators in at least a sixth of its words, or two of three words ending in "!!".
MARKS, SEPARATORS, SHOUT = b"#*$%&<>{}~^=_\\", b"|", b"!!"

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"


def clean_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """Measures, verdict and cleaned text of every document.

    Lines that fail a punctuation, navigation or boilerplate rule are removed; a phrase in a longer line of prose is none. A document is rejected when its base measures fail
    or when the removed lines hold more than ``most_lost`` of the characters in words. Null and empty texts have no words and
    are rejected; a text is read whole whatever its length; every row gives one row, repeated ones too. Other columns are not
    read. ``clean`` holds the lines that stay (of rejected documents too).
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(_cleaner(most_lost, with_text, secrets.randbits(64)), f"doc_id {kind}, {COLUMNS}" + ", clean string" * with_text)


def _cleaner(most_lost: float, with_text: bool, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, phrases = Spans(key), re.compile(rb"(?<![\w\x80-\xff])(?:" + BOILERPLATE.encode() + rb")(?![\w\x80-\xff])", re.IGNORECASE)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                found = measure(data, offsets, spans, phrases, most_lost, with_text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    return run


def measure(data: np.ndarray, offsets: np.ndarray, spans: Spans, phrases: re.Pattern, most_lost: float, with_text: bool) -> dict:
    """All columns of a block of texts."""
    rows = len(offsets) - 1
    prefix = spans.prefix(data)
    starts, ends, row = word_spans(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    word_points = points[ends] - points[starts]

    # lines: every row has one more than it has line breaks
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a break at the end of a row opens a last, empty line, which sorts beside the next row's first
    line_rows = np.sort(np.concatenate([np.arange(rows), rows_of(breaks, offsets)]), kind="stable")
    line_ends = np.empty_like(line_starts)
    line_ends[:-1] = np.where(line_rows[1:] == line_rows[:-1], line_starts[1:] - 1, offsets[1:][line_rows[:-1]])
    if len(line_ends):
        line_ends[-1] = len(data)
    holds = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    line_words = holds[1] - holds[0]
    filled = line_words > 0
    same = first_seen(keyed(spans.hashes(prefix, line_starts[filled], line_ends[filled]), line_rows[filled]))
    n_dup_lines = np.bincount(line_rows[filled][~same], minlength=rows)

    windows = chained(spans.hashes(prefix, starts, ends), WINDOW)
    whole = row[: len(windows)] == row[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    at = at[repeated(keyed(windows[at], row[at]))]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    n_repeat_words = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=rows)
    base_failed = (n_words < FEWEST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)

    held = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(word_points, out=held[1:])
    line_chars = held[holds[1]] - held[holds[0]]
    fails = _failing(data, line_starts, line_ends, line_words, line_chars, starts, ends)
    fails |= _phrase_lines(data, offsets, line_starts, line_words, starts, phrases)
    lost = np.bincount(line_rows, weights=line_chars * fails, minlength=rows).astype(np.int64)
    word_chars = np.bincount(row, weights=word_points, minlength=rows).astype(np.int64)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_row(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": base_failed,
        "kept": ~base_failed & (lost <= most_lost * word_chars),
        "lost_chars": lost,
    }
    if with_text:
        raw, stay = data.tobytes(), [[] for _ in range(rows)]
        for k in np.flatnonzero(~fails):
            stay[line_rows[k]].append(raw[line_starts[k] : line_ends[k]])
        out["clean"] = [b"\n".join(lines).decode() for lines in stay]
    return out


def _failing(data, line_starts, line_ends, line_words, line_chars, starts, ends) -> np.ndarray:
    """Lines that fail the punctuation or navigation rule; lines without words pass."""

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[line_ends] - total[line_starts]

    marks = count(np.isin(data, np.frombuffer(MARKS, np.uint8)))
    separators = count(np.isin(data, np.frombuffer(SEPARATORS, np.uint8)))
    loud = np.zeros(len(data), bool)
    long = ends - starts >= 2
    loud[starts[long]] = (data[ends[long] - 1] == SHOUT[0]) & (data[ends[long] - 2] == SHOUT[0])
    shouts = count(loud)
    some = line_words > 0
    return some & ((10 * marks > line_chars) | ((separators >= 3) & (6 * separators >= line_words)) | (3 * shouts >= 2 * line_words))


def _phrase_lines(data, offsets, line_starts, line_words, starts, phrases) -> np.ndarray:
    """Lines that phrases of the boilerplate list make up, or short lines with one; phrases are whole words and never cross lines or rows."""
    raw, hits = data.tobytes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        # a row on its own: bytes of the rows beside it are no context
        hits += [(a + m.start(), a + m.end()) for m in phrases.finditer(raw[a:b])]
    begins, ends = np.array(hits, np.int64).reshape(-1, 2).T
    line = np.searchsorted(line_starts, begins, side="right") - 1
    words = np.searchsorted(starts, ends) - np.searchsorted(starts, begins, side="right") + 1
    told = np.bincount(line, weights=words, minlength=len(line_starts))
    return (told > 0) & ((line_words <= SHORT_LINE) | (PHRASE_SHARE * told >= line_words))
