"""License scan: passages whose normalised words match a license template by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.llm.frames import blocks
from terraweft.llm.words import Spans, chained, per_row, word_spans

#: Notices by which texts name their license, as published with the licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _plain_bytes() -> np.ndarray:
    """Lower-case ASCII letters, digits and all non-ASCII bytes stay; every other byte becomes a space."""
    table = np.full(256, 0x20, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for low in range(ord("a"), ord("z") + 1):
        table[low] = table[low - 0x20] = low
    for digit in range(ord("0"), ord("9") + 1):
        table[digit] = digit
    return table


class Templates:
    """Bigram counts of the templates, by hash."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.plain, self.spans, self.threshold = _plain_bytes(), Spans(3), threshold
        self.names, self.counts = list(texts), []
        for text in texts.values():
            raw = np.frombuffer(text.encode(), np.uint8)
            pairs, _ = self.pairs(raw, np.array([0, len(raw)]))
            self.counts.append(Counter(pairs.tolist()))
        self.sizes = [sum(c.values()) for c in self.counts]
        self.known = np.unique(np.array([h for c in self.counts for h in c], np.uint64))

    def pairs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word bigrams of each row, and the number of the first word within its row's block; pairs across rows are 0."""
        plain = self.plain[data]
        starts, ends, row = word_spans(plain, offsets)
        pairs = chained(self.spans.hashes(self.spans.prefix(plain), starts, ends), 2)
        if len(pairs):
            pairs[row[1:] != row[:-1]] = 0
        return pairs, np.searchsorted(row, np.arange(len(offsets)))

    def best(self, pairs: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(dice, template, first word, words) of the best passage for each template that reaches the threshold.

        A best passage starts and ends with a bigram of the template, and its size is within the bounds that the threshold leaves, so
        only runs between such bigrams are compared.
        """
        out, t = [], self.threshold
        hits = np.flatnonzero(np.isin(pairs, self.known))
        seen = pairs[hits].tolist()
        for number, (counts, size) in enumerate(zip(self.counts, self.sizes, strict=True)):
            own = [(int(p), h) for p, h in zip(hits, seen, strict=True) if h in counts]
            least, most = t * size / (2 - t), size * (2 - t) / t
            if len(own) < least:
                continue
            top = None
            for i, (begin, _) in enumerate(own):
                left, shared = dict(counts), 0
                for at, h in own[i:]:
                    n = at - begin + 1
                    if n > most:
                        break
                    if left[h]:
                        left[h] -= 1
                        shared += 1
                        if n >= least:
                            dice = 2 * shared / (n + size)
                            if dice >= t and (top is None or dice > top[0]):
                                top = (dice, number, begin, n + 1)
            if top:
                out.append(top)
        return out


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """The license named in every document: doc_id, n_words, license, dice, first_word, license_words, matches.

    Words are runs of letters and digits, in lower case. The passage with the highest Dice coefficient wins, among equals the template that
    stands first, then the earliest and shortest passage; ``matches`` lists all templates that reach the threshold, best first. Texts are read
    whole and passages may start and end anywhere. A null or empty text, or one without a match, gives a row without a license. Each row gives
    one row, other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    columns = "n_words long, license string, dice double, first_word long, license_words long, matches string"
    return read.mapInArrow(_matcher(templates or TEMPLATES, threshold), f"doc_id {kind}, {columns}")


def _matcher(templates: dict[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                yield match(part, data, offsets, known)

    return run


def match(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, known: Templates) -> pa.RecordBatch:
    pairs, first = known.pairs(data, offsets)
    total = np.diff(first)
    hit = np.isin(pairs, known.known)
    lows = np.minimum(first[:-1], len(pairs))
    highs = np.minimum(first[1:], len(pairs))
    hits = per_row(hit, np.append(lows, highs[-1:]))
    fewest = min((threshold_hits(s, known.threshold) for s in known.sizes), default=1)
    rows: list[tuple] = []
    for k in range(len(total)):
        found = known.best(pairs[lows[k] : highs[k]]) if hits[k] >= fewest else []
        found.sort(key=lambda x: (-x[0], x[1]))
        if found:
            dice, number, begin, words = found[0]
            rows.append((known.names[number], dice, begin, words, ",".join(f"{known.names[x[1]]}:{x[0]:.3f}" for x in found)))
        else:
            rows.append((None, None, None, None, ""))
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total), *cols], names=["doc_id", "n_words", "license", "dice", "first_word", "license_words", "matches"])


def threshold_hits(size: int, threshold: float) -> float:
    """The least number of shared bigrams with which a passage can reach the threshold."""
    return threshold * size / (2 - threshold)
