"""Divergence audit, exact search and spelling groups: the methods on their own, and small tables against brute force."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from awkward import duck_over, messy, store  # noqa: F401
from conftest import same_rows

from terraweft.llm import divergence, search, spelling
from terraweft.llm.queries import QUERIES, TWINS


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def counted(tmp_path_factory, spark):
    """Many sources that share terms unevenly, a lang without terms, a group without text."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        source = f"s{min(rng.randrange(12), rng.randrange(12)):02}"
        words = ["".join(rng.choice("abç") for _ in range(rng.randint(1, 4))).title() for _ in range(rng.randint(0, 40))]
        rows.append((k, rng.choice([" ", ", ", "7"]).join(words), rng.choice(["en", "de"]), source, 0))
    rows += [(500, "alone", "xx", "a", 0), (501, None, "xx", "b", 0), (502, None, None, None, 0), (503, "", "en", "empty", 0)]
    return store(spark, rows, tmp_path_factory.mktemp("counted"))


@pytest.mark.parametrize("block", [256, 3])
def test_divergences_match_sql(spark, counted, block, monkeypatch):
    """Also with sources dealt to several blocks, and pair sums in small steps."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    if block < 256:
        monkeypatch.setattr(divergence, "STEP", 7)
    got = QUERIES["op11_source_divergence"](spark, counted).toPandas()
    same_rows(got, duck_over(counted).execute(TWINS["op11_source_divergence"]).df())


def test_skyband_keeps_what_few_dominate():
    rng = random.Random(2)
    for k in (1, 3, 20):
        rows = [(g, "s", f"t{i:03}", rng.randint(1, 9), rng.randint(9, 15)) for g in "ab" for i in range(300)]
        rows.sort(key=lambda r: (r[0], r[1], -r[3], r[4], r[2]))
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "source", "term", "n", "total"])
        parts = [batch.slice(0, 250), batch.slice(250)]
        got = {tuple(r.values()) for out in divergence._skyband(k)(iter(parts)) for r in out.to_pylist()}
        beats = lambda a, b: a[0] == b[0] and a[3] >= b[3] and a[4] <= b[4] and a[2] < b[2]
        assert got == {r for r in rows if sum(beats(o, r) for o in rows) < k}


def test_shares_are_exact_beyond_longs(spark):
    cases = [(0, 1), (7, 9), (10**12, 10**12 + 5), (8 * 10**15, 9 * 10**15), (123456789012345, 987654321098765)]
    frame = spark.createDataFrame(cases, "c long, d long").selectExpr("c", "d", f"{divergence.share('c', 'd')} AS p")
    assert {(r.c, r.d): r.p for r in frame.collect()} == {(c, d): 1 + 10**9 * (c + 1) // d for c, d in cases}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("Ärger über Foo1bar " * 50 + "x" * 300).encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "PIECE", 11)
    assert divergence.term_counts(text) == whole
    assert whole["x".encode() * 300] == 1 and whole["ärger".encode()] == 0 and whole["Ärger".encode()] == 50


def brute_top(rows, k, every):
    plain = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, own) in enumerate(plain):
        if q is not None and q % every == 0:
            scores = [(-sum(x * y for x, y in zip(own, v, strict=False)), i is None, i) for b, (i, v) in enumerate(plain) if a != b]
            out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("segments,block,panel", [(1, 1 << 18, 1 << 16), (3, 40, 5), (8, 1 << 18, 1 << 16)])
def test_search_matches_brute_force(spark, segments, block, panel):
    rng = random.Random(segments)
    rows = [(rng.randrange(400) if rng.random() < 0.97 else None, [round(rng.uniform(-0.05, 0.05), 3) for _ in range(rng.choice([3, 4, 4]))]) for _ in range(250)]
    rows += [(k, [0.01, 0.02, 0.01, 0.0]) for k in range(0, 200, 2)] + [(1000, [0.0] * 4), (1001, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.top_k(frame, every=10, segments=segments, block=block, panel=panel)
    assert Counter(map(tuple, got.collect())) == brute_top(rows, 5, 10)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, -1.0]), (2, [-3e6, 5.0]), (3, [2e6, 7.0]), (50, [1e30, 1.0]), (51, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in search.top_k(frame, every=50).collect()}
    assert got[0, 2] == (1, 768000000**2 - 256 * 256) and got[0, 1] == (50, (1 << 63) - 1)
    assert got[0, 4] == (51, 256 * 256) and got[50, 5][0] == 2


def test_index_finds_all_words_one_edit_away():
    rng = random.Random(1)
    for trial in range(60):
        letters = [b"a", b"ab", b"ab\xe9"][trial % 3]
        word = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        words = list({word() for _ in range(rng.randint(1, 200))})
        asked = words + [word() for _ in range(30)]
        index = spelling.FmIndex(words)
        found = index.search(asked, np.array([len(w) // 2 for w in asked]))
        got = Counter((i, index.words[k]) for i, k in zip(*(x.tolist() for x in found), strict=True))
        assert got == Counter((i, b) for i, a in enumerate(asked) for b in words if a != b and b.startswith(a[: len(a) // 2]) and brute.one_edit(a.decode("latin-1"), b.decode("latin-1")))


@pytest.mark.parametrize("indexed", [spelling.INDEXED, 5])
def test_spelling_groups_match_brute_force(spark, indexed):
    """Also where halves have more words than an index takes."""
    rng = random.Random(3)
    stems = ["international", "straße", "gardening", "überlegung", "wonderful", "÷×ÿþðïî", "aaaaaaaaaa"]
    rows = []
    for k in range(300):
        words = []
        for _ in range(40):
            word = list(rng.choice(stems))
            while rng.random() < 0.25:
                at = rng.randrange(len(word))
                word[at : at + rng.randrange(2)] = rng.choice(["", "x", "É", "a", "B"])
            words.append("".join(word))
        rows.append((k % 290 or None, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "7 " * 9), (4, "b" * 3000), (5, "b" * 3000 + " " + "b" * 2999), (6, "b" * 2999)]
    got = spelling.spelling_groups(documents(spark, rows), indexed=indexed)
    expected = brute.spelling_groups(rows)
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    assert any(r[1] and r[2] != r[1] for r in expected) or any(r[1] for r in expected)


def test_messy_words_match_brute_force(spark, messy):
    folder, rows = messy
    got = QUERIES["op13_spelling_variants"](spark, folder)
    assert Counter(map(tuple, got.collect())) == Counter(brute.spelling_groups([r[:2] for r in rows]))
