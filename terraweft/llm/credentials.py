"""Secret scan: token patterns, and values in credential contexts judged by the guesses that a password cracker would need."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract's base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # shorter runs fail anyway, and a run is taken whole
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: Credential contexts of the guess-cost rule: a name, then ':', '=', '=>' or 'is', then a value without spaces. A name is a run of
#: identifier characters with a credential word anywhere in it; ordinary words (secretary, tokenizer, passage, compass) are none.
NAME_WORD = re.compile(
    r"""pass(?:word|wd|phrase|code)|(?<!com)(?<!by)(?<!tres)(?<!sur)(?<!over)(?<!under)pass(?:(?![a-z])|(?-i:(?<=s)(?=[A-Z])))"""
    r"""|pwd|secret(?!ar[iy]|ive|ion|ly\b|e[sd]?\b|ing\b)|credential|token(?!i[sz](?:e|a|ing))"""
    r"""|(?:api|access|private|auth)[_\x20.-]?key(?!board|note|hole|pad|ring|word|stone|stroke)""",
    re.IGNORECASE | re.ASCII,
)
#: What is left of a name; "access key" with a space is one name.
NAME_REST = re.compile(r"[A-Za-z0-9_.-]*+(?:(?:(?<=api)|(?<=access)|(?<=private)|(?<=auth))\x20key[A-Za-z0-9_.-]*+)?+", re.IGNORECASE | re.ASCII)
NAME_CHARS = frozenset(string.ascii_letters + string.digits + "_.-")
VALUE = re.compile(r"""["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is:?\x20+)["']?([^\s"'<>,;]{8,})""", re.IGNORECASE | re.ASCII)
#: One of these is in every text that ASSIGN or a credential context can match, once lower-cased.
HINTS = ("pass", "pwd", "secret", "credential", "token", "key")

#: Common parts of passwords, most common first; the rank is the cost.
WORDS = (
    "password pass love admin welcome login monkey dragon master hello sunshine princess shadow football baseball secret summer winter "
    "spring autumn letmein test user root guest qwerty abc iloveyou trust star super angel batman superman flower cheese computer internet "
    "service server default change changeme example sample demo temp public private token access key system manager office company "
    "market green blue red black white orange yellow purple silver gold tiger lion horse eagle bear wolf happy lucky money power "
    "the and you for this that with from your name house world time life girl boy baby king queen jack john mike alex anna maria "
    "michael daniel thomas robert george charlie jordan hunter ranger soccer hockey correct battery staple monday friday january june july"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
SWAPS = str.maketrans("013457$@", "oieastsa")
DIRECTIONS = (1, -1, 2, -2)
SEPARATORS = "-./_"
SEPARATED = re.compile(rf"([0-9]{{2}}|[0-9]{{4}})([{SEPARATORS}])([0-9]{{2}})\2([0-9]{{2}}|[0-9]{{4}})")
DATE_LENGTHS = (4, 6, 8, 10)
#: Vocabulary of the public tokenizers that ranks further words.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LONGEST = 24  # of a dictionary word, date or walk; longer spans are chains of these
CLASSES = ((10, str.isdigit), (26, str.islower), (26, str.isupper))
PER_SPAN = math.log10(2)


class Covered:
    """Tells whether a span overlaps any of the given ones, in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(itertools.accumulate((b for _, b in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def guess_cost(value: str, enough: float = math.inf, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest way to cut the value into words, dates, repeats, walks and brute-force characters.

    A value whose every way costs ``enough`` or more already before its end is not read further; the result is then ``enough`` or more.
    """
    n, ranks = len(value), RANKS if ranks is None else ranks
    low = value.lower()
    plain = low.translate(SWAPS)
    cost = [0.0] + [math.inf] * n
    run = 0  # characters equal to the current one, up to it
    walk = 0  # steps along a keyboard row or the alphabet, up to the current character
    turn = 0
    for i in range(n):
        char = value[i]
        size = next((s for s, test in CLASSES if test(char)), 33)
        best = cost[i] + math.log10(size)
        run = run + 1 if i and char == value[i - 1] else 1
        if run >= 3:
            best = min(best, min(cost[i + 1 - k] + math.log10(size * k) for k in {3, run} if k <= run) + PER_SPAN)
        step = STEPS.get((low[i - 1], low[i]), 0) if i else 0
        walk, turn = (walk + 1, turn) if step and step == turn else (1 if step else 0, step)
        if walk >= 2:
            best = min(best, min(cost[i - k] + math.log10(47 * len(DIRECTIONS) * (k + 1)) for k in {2, walk}) + PER_SPAN)
        for k in range(3, min(LONGEST, i + 1) + 1):
            j = i + 1 - k
            rank = ranks.get(low[j : i + 1])
            swapped = rank is None
            if swapped:
                rank = ranks.get(plain[j : i + 1])
            if rank is not None:
                case = 0 if value[j : i + 1] == low[j : i + 1] else 1 if value[j].isupper() and value[j + 1 : i + 1] == low[j + 1 : i + 1] else 2
                best = min(best, cost[j] + math.log10(rank) + PER_SPAN * (1 + case + 2 * swapped))
            if k in DATE_LENGTHS and (dates := _dates(value[j : i + 1])):
                best = min(best, cost[j] + math.log10(dates) + PER_SPAN)
        cost[i + 1] = best
        # every way on has a cut among the last positions, unless a run or a walk spans them all
        if i >= LONGEST and best >= enough and max(run, walk) < LONGEST and (least := min(cost[i + 2 - LONGEST : i + 2])) >= enough:
            return least
    return cost[n]


def _dates(span: str) -> int:
    """Number of dates written like this one, 0 if it is none. Separated dates cost the choice of the separator as well."""
    if m := SEPARATED.fullmatch(span):
        a, b, c = m[1], m[3], m[4]
        if len(a) == 4 == len(c):
            return 0
        forms, long, separators = ((a, b, c),) if len(a) == 4 else ((c, a, b), (c, b, a)) if len(c) == 4 else ((None, a, b), (None, b, a), (None, b, c)), len(span) == 10, len(SEPARATORS)
    elif len(span) > 8 or not (span.isascii() and span.isdigit()):
        return 0
    elif len(span) == 4:
        return 150 if "1900" <= span < "2050" else 0
    else:
        forms = ((span[:4], span[4:6], span[6:]), (span[4:], span[:2], span[2:4]), (span[4:], span[2:4], span[:2])) if len(span) == 8 else ((None, span[:2], span[2:4]), (None, span[2:4], span[:2]), (None, span[2:4], span[4:]))
        long, separators = len(span) == 8, 1
    fits = any((y is None or "1900" <= y < "2050") and "01" <= m <= "12" and "01" <= d <= "31" for y, m, d in forms)
    return (150 if long else 100) * 365 * separators if fits else 0


def _steps() -> dict[tuple[str, str], int]:
    """Direction of each step between neighbours: along a row or the alphabet, and down or up a slanted column of the keyboard."""
    out = {}
    for lines, (ahead, back) in ((ROWS, DIRECTIONS[:2]), (zip(*ROWS[:4], strict=False), DIRECTIONS[2:])):
        for line in lines:
            for a, b in zip(line, line[1:], strict=False):
                out[a, b], out[b, a] = ahead, back
    return out


def word_ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Ranks of common words: the list above, then the whole words of a tokenizer's vocabulary, whose numbers follow from how common they are.

    ``vocabulary`` is the path of a JSON file with lower-case word ends ("</w>"); without one, or where it is missing, the list is all there is.
    """
    words = list(WORDS)
    if vocabulary and os.path.exists(vocabulary):
        with open(vocabulary, encoding="utf-8") as file:
            numbers = json.load(file)["model"]["vocab"]
        whole = sorted((number, token[:-4]) for token, number in numbers.items() if token.endswith("</w>"))
        words += [word for _, word in whole if len(word) >= 3 and word.isascii() and word.isalpha()]
    return {word: rank for rank, word in enumerate(dict.fromkeys(words), 1)}


RANKS = word_ranks()
STEPS = _steps()


def context_values(text: str, counts: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Spans of the values in credential contexts that count. The last name in a value that does not may open a context itself.

    No part of the text is read more than a few times, so long runs of names take linear time.
    """
    at = 0
    while word := NAME_WORD.search(text, at):
        at = NAME_REST.match(text, word.end()).end()
        if value := VALUE.match(text, at):
            first, at = value.span(1)
            if counts(first, at):
                yield first, at
                continue
            while at > first and text[at - 1] in ":=":
                at -= 1
            while at > first and text[at - 1] in NAME_CHARS:
                at -= 1


def secret_spans(text: str, least_guesses: float = 10.0, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, kinds numbered as in KINDS, by start, then kind. Guess spans never overlap base spans."""
    low = text.lower()
    found = []
    named = any(h in low for h in HINTS)
    if named:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if named:
        base = Covered((a, b) for a, _, b in found)
        counts = lambda a, b: not base.meets(a, b) and guess_cost(text[a:b], least_guesses, ranks) >= least_guesses
        found += [(a, 3, b) for a, b in context_values(text, counts)]
    return sorted(found)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_guesses: float = 10.0, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans (kind:start:end in code points).

    A value in a credential context counts when the cheapest segmentation costs 10^least_guesses guesses or more; words are ranked by ``word_ranks``
    of the vocabulary file, which the driver reads (some 25,000 words). Null is empty; an
    empty text has no spans and the digest of nothing. Texts are read whole, each row gives one row, other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranks = word_ranks(vocabulary)
    columns = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return read.mapInArrow(_scanner(lambda t: secret_spans(t, least_guesses, ranks), KINDS, 3), f"doc_id {kind}, {columns}")


def _scanner(find, kinds: tuple[str, ...], base: int):
    """Arrow batches of documents to counts per kind, digest of the first ``base`` kinds, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(kinds) + 2)]
            for value in batch.column("text"):
                found = find(value.as_py() or "")
                for k in range(len(kinds)):
                    out[k].append(sum(x[1] == k for x in found))
                own = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found if k < base)
                out[-2].append(hashlib.sha256(own.encode()).hexdigest())
                out[-1].append(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found))
            names = [f"n_{k}" for k in kinds] + ["base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:-2]), *(pa.array(x, pa.string()) for x in out[-2:])], names=["doc_id", *names])

    return run
