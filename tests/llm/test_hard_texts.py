"""Texts made to break shortcuts: strings with equal polynomial hashes, and runs that make careless searches quadratic."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import brute
import numpy as np
import pytest

from terraweft.llm import credentials, near, personal, quality, repeats
from terraweft.llm.words import Spans


def thue_morse(n: int) -> tuple[str, str]:
    """A string of 2^n letters and its complement; polynomials modulo 2^64 cannot tell them apart from 2^10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 11, 13])
def test_thue_morse_strings_are_different(spark, n):
    a, b = thue_morse(n)
    data = np.frombuffer((a + b).encode(), np.uint8)
    spans = Spans(3)
    h = spans.hashes(spans.prefix(data), np.array([0, 1 << n]), np.array([1 << n, 2 << n]))
    assert h[0] != h[1]
    filler = " ".join(f"w{k}" for k in range(30))
    rows = [(1, a), (2, b), (3, f"{a}\n{b}\n{filler}"), (4, f"{a}\n{a}\n{filler}"), (5, " ".join([a, b] * 9)), (6, filler + " " + a), (7, filler + " " + b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(docs, percent=95)
    assert Counter(tuple(r)[:3] for r in got.collect()) == Counter(brute.near_components(rows, 95))
    lines = {r.doc_id: r.n_dup_lines for r in quality.clean_lines(docs, with_text=False).collect()}
    assert (lines[3], lines[4]) == (0, 1)
    removed = [tuple(r) for r in repeats.remove_repeats(docs).collect()]
    assert Counter(removed) == Counter(brute.without_repeats(rows))


def test_spans_are_equal_only_for_equal_bytes():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    spans = Spans(rng.getrandbits(64))
    h = spans.hashes(spans.prefix(data), starts, ends).tolist()
    assert len(set(h)) == len(set(texts)) == len(set(zip(h, texts, strict=True)))


def test_large_groups_are_linked_in_linear_time():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = []
    for _ in range(10_000):
        own = base.copy()
        own[rng.integers(0, 100, 4)] = rng.integers(0, 1 << 62, 4)
        sets.append(np.unique(own))
    begin = time.perf_counter()
    assert set(near.linked(sets, 80)) == {0}
    assert time.perf_counter() - begin < 15


LONG = 1_000_000
RUNS = {
    "spaces": "a" + " " * LONG + "b (at) c" + " " * 1000 + "[dot] de",
    "brackets": "[" * LONG + "at]" + "( at" * 1000,
    "dots": "1." * (LONG // 2) + "a@" + "b." * (LONG // 2),
    "digits": "+1" + "4111 1111 " * (LONG // 10) + "7" * LONG,
    "spelled": "one two three " * (LONG // 14),
    "at signs": "a@" * (LONG // 2) + "at dot " * 1000,
    "spoken": "me at home dot com " * (LONG // 19),
    "credentials": "password=abcdefghijkl1! " * (LONG // 24),
    "names": "password_token_" * (LONG // 15) + "=" + "xY7#" * (LONG // 4),
    "no value": "password" + " " * LONG + "token" + "=" * LONG,
    "identifiers": "mail a (at) b (dot) com, " * (LONG // 25) + "a.b@c.de " * (LONG // 9),
}


@pytest.mark.parametrize("kind", sorted(RUNS))
def test_scans_take_linear_time(kind):
    """A megabyte or two in seconds: twice the text takes about twice the time."""
    text, begin = RUNS[kind], time.perf_counter()
    personal.personal_spans(text)
    credentials.secret_spans(text)
    assert time.perf_counter() - begin < 40


def test_spaces_around_brackets_go_with_them():
    text = "me    ( at )   home   [dot]  org"
    spans = personal.personal_spans(text)
    assert spans == [(0, 4, len(text))]


def test_covered_spans():
    rng = random.Random(9)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        covered = credentials.Covered(spans)
        for a in range(0, 60, 3):
            for b in range(a + 1, a + 12, 4):
                assert covered.meets(a, b) == any(x < b and a < y for x, y in spans)


def segment_costs(value: str) -> dict[tuple[int, int], float]:
    """Cost of every single segment, from the rules themselves."""
    low, out = value.lower(), {}
    plain = low.translate(credentials.SWAPS)
    size = lambda c: 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33
    for i in range(len(value)):
        for j in range(i + 1, len(value) + 1):
            span, options = value[i:j], []
            if j - i == 1:
                options.append(math.log10(size(span)))
            if j - i >= 3 and len(set(span)) == 1 and (j - i == 3 or i == 0 or value[i - 1] != span[0]):
                options.append(math.log10(size(span[0]) * (j - i)) + credentials.PER_SPAN)
            out[i, j] = min(options, default=math.inf)
            for text, swapped in ((low[i:j], False), (plain[i:j], True)):
                if 3 <= j - i <= credentials.LONGEST and text in credentials.RANKS and not (swapped and low[i:j] in credentials.RANKS):
                    case = 0 if span == low[i:j] else 1 if span[0].isupper() and span[1:] == low[i + 1 : j] else 2
                    out[i, j] = min(out[i, j], math.log10(credentials.RANKS[text]) + credentials.PER_SPAN * (1 + case + 2 * swapped))
            if j - i in credentials.DATE_LENGTHS and credentials._dates(span):
                out[i, j] = min(out[i, j], math.log10(credentials._dates(span)) + credentials.PER_SPAN)
    return out


def test_guess_cost_is_the_cheapest_of_all_segmentations():
    """Against an enumeration of all cuts, for values without keyboard walks."""
    rng = random.Random(12)
    pieces = ["love", "Pass", "p4ss", "aaa", "7777", "1999", "x", "#", "Q", "0412", "19991231", "24.12.99", "2024-01-15"]
    for _ in range(300):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))[:11]
        if any((a, b) in credentials.STEPS for a, b in zip(value.lower(), value.lower()[1:], strict=False)):
            continue
        costs = segment_costs(value)
        best = [0.0] + [math.inf] * len(value)
        for cuts in range(1 << (len(value) - 1)):
            ends = [k for k in range(1, len(value)) if cuts >> (k - 1) & 1] + [len(value)]
            total = sum(costs[a, b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
            best[-1] = min(best[-1], total)
        assert credentials.guess_cost(value) == pytest.approx(best[-1]), value


def test_long_values_are_costly_before_their_end():
    rng = random.Random(3)
    value = "".join(rng.choice("abQZ19#$kv") for _ in range(500))
    assert credentials.guess_cost(value, 10.0) >= 10.0 and credentials.guess_cost(value) >= credentials.guess_cost(value, 10.0)
    assert credentials.guess_cost("a" * 5000, 10.0) == credentials.guess_cost("a" * 5000) < 10


def test_common_passwords_are_cheap():
    """Words of a real vocabulary, columns of the keyboard and separated dates."""
    ranks = credentials.word_ranks(credentials.VOCABULARY)
    if len(ranks) < 1000:
        pytest.skip("no vocabulary file")
    for value in ("butterfly-elephant", "1qaz2wsx3edc", "zaq12wsx", "2024-01-15", "15.01.2024", "Butterfly2024", "abcdefghijkl", "welcome-back"):
        assert credentials.guess_cost(value, ranks=ranks) < 10, value
    for value in ("xK9$vQ!27#mZ", "8f!Qz@71LmWp", "pX8!zz@Lq2#Vt9"):
        assert credentials.guess_cost(value, ranks=ranks) > 10, value
    assert credentials.word_ranks("/nowhere") == credentials.RANKS and credentials.RANKS["password"] == ranks["password"] == 1
    assert credentials._dates("2024-01.15") == credentials._dates("2024-13-15") == credentials._dates("20-24-0115") == 0
