"""Every operator over the awkward table, against SQL or brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from awkward import duck_over, messy, nothing, unique  # noqa: F401
from conftest import SF_DIR, same_rows
from pyspark.sql import functions as F

from terraweft.llm import credentials, exact, language, licenses, mixing, near, packing, personal, quality, repeats
from terraweft.llm.queries import QUERIES, TWINS
from terraweft.llm.words import Spans


def rows_of(frame, *columns) -> Counter:
    return Counter(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table_gives_no_rows(name, spark, nothing):
    assert QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op10_best_fit_packing", "op11_source_divergence", "op12_exact_top_k", "op13_spelling_variants"}))
def test_one_row_per_document(name, spark, messy):
    folder, rows = messy
    assert Counter(r.doc_id for r in QUERIES[name](spark, folder).collect()) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_messy_table_matches_twin(name, spark, unique):
    folder, _ = unique
    same_rows(QUERIES[name](spark, folder).toPandas(), duck_over(folder).execute(TWINS[name]).df())


def test_near_duplicates_match_brute_force(spark, messy):
    folder, rows = messy
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for percent, cell in ((85, near.CELL), (60, 200)):  # the small limit compares bucket by bucket, in blocks
        got = near.near_duplicates(docs, percent=percent, cell=cell)
        expected = brute.near_components([r[:2] for r in rows], percent)
        assert rows_of(got, "doc_id", "n_shingles", "component_id") == Counter(expected)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_repeated_ids_are_documents_of_their_own(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other words"), (2, text + " end"), (3, "other words")], "doc_id long, text string")
    assert rows_of(near.near_duplicates(docs, percent=80), "doc_id", "component_id") == Counter({(1, 1): 3, (2, 1): 1, (3, 1): 1})
    kept = exact.drop_copies(docs)
    assert rows_of(kept, "doc_id", "text") == Counter({(1, text): 1, (1, "other words"): 1, (2, text + " end"): 1})


def test_linked_sets_match_all_pairs():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        for _ in range(6):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 1 << 62)
            sets.append(np.unique(own))
    label = near.linked(sets, 80)
    link = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    group = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for k, b in enumerate(sets[:i]):
                if group[i] != group[k] and link(a.tolist(), b.tolist()):
                    group = [min(group[i], group[k]) if g in (group[i], group[k]) else g for g in group]
    assert label == group


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    assert near.bands_for(85, 5) == 36
    found = []
    for _ in range(200):
        shared, own = rng.integers(0, 1 << 62, 85), rng.integers(0, 1 << 62, (2, 8))
        values = np.concatenate([shared, own[0], shared, own[1]]).astype(np.uint64)
        signature = near.circulant(values, np.array([0, 93]), 180)
        found.append((signature[0] == signature[1]).mean())
    assert abs(np.mean(found) - 85 / 101) < 0.01


def test_mix_keeps_its_promises(spark, messy):
    folder, rows = messy
    got = QUERIES["op2_mix_sources"](spark, folder).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(brute.WORD.findall(text or ""))
    assert all(r.taken <= 3 * r.size for r in got)
    again = QUERIES["op2_mix_sources"](spark, folder)
    assert rows_of(again, "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in got)
    total = sum(sizes.values())
    assert abs(sum(r.taken for r in got) - total) < 0.02 * total
    full = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"))
    for r in full.groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect():
        assert r["max(source_size)"] == sizes[r.source]
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * total / len(sizes) + 3


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes, 3).collect()}
    assert got["a"] == 30 and got["c"] == 3
    assert got["b"] + got[None] == pytest.approx(1511 - 33)
    assert got["b"] == pytest.approx(2 * got[None])


@pytest.mark.parametrize("capacity,key", [(20_000, None), (1, None), (1, lambda body: F.lit(0).cast("long")), (3, lambda body: F.shiftleft(F.length(body).cast("long"), 50))])
def test_index_gives_the_groups_whatever_the_keys(spark, messy, capacity, key):
    """Also where every bucket is overfull, and where all texts share one key or a few, so that chains and bytes decide."""
    folder, rows = messy
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = exact.exact_dedup(docs, capacity=capacity, depth=6, hot_rows=2, **({"key": key} if key else {}))
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    keep = {b: min((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]) for r, own in zip(rows, bodies, strict=True) if own == b)[3] for b in set(bodies)}
    sizes = Counter(bodies)
    want = Counter((r[0], keep[b], sizes[b], hashlib.sha256(b.encode()).hexdigest()) for r, b in zip(rows, bodies, strict=True))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_chains_hold_the_texts_that_share_a_key(spark):
    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(40)], "doc_id long, text string")
    buckets, index = exact.hash_index(docs, key=lambda body: F.lit(7).cast("long"))
    chains = index.collect()
    assert len(chains) == 1 and sorted((e.keep_id, e.group_size) for e in chains[0].chain) == [(k, 8) for k in range(5)]
    assert buckets.count() == 1


def test_directory_splits_overfull_buckets(spark):
    chains = spark.range(1000).selectExpr("CAST(CASE WHEN id < 900 THEN 5 ELSE id % 16 END AS int) AS prefix")
    got = {r.prefix: (r.bucket, r.local_depth) for r in exact.directory(chains, 50, 4).collect()}
    assert got[5] == (5, 4)  # cannot be split further
    assert all(b >> (4 - d) << (4 - d) == b and p >> (4 - d) == b >> (4 - d) for p, (b, d) in got.items())
    assert {b for p, (b, d) in got.items() if p >= 8} == {8} or all(d >= 1 for _, d in got.values())


def test_quality_returns_the_lines_that_stay(spark, messy):
    folder, rows = messy
    got = {r.doc_id: r for r in quality.clean_lines(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    text = rows[21][1].split("\n")
    assert got[21].clean == "\n".join([text[1], text[4]]) and got[21].kept
    assert got[22].lost_chars == got[22].word_chars and not got[22].kept
    assert got[9].clean == rows[9][1] and got[0].clean == ""


def test_secrets_match_brute_force(spark, messy):
    folder, rows = messy
    got = rows_of(QUERIES["op6_secret_scan"](spark, folder), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == Counter((r[0], *brute.secret(r[1])) for r in rows)


def test_guess_cost_orders_passwords():
    cheap = ["password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "19840312", "letmein2020", "P@ssw0rd", "monkeymonkey"]
    dear = ["x7Qp!vR2mZ", "kd93-fjw0-2lqp", "tZ8#qLw0vB"]
    assert max(map(credentials.guess_cost, cheap)) < 10 < min(map(credentials.guess_cost, dear))
    text = "his passphrase is x7Qp!vR2mZ but pwd=password and token: plain words"
    spans = [text[a:b] for a, k, b in credentials.secret_spans(text) if k == 3]
    assert spans == ["x7Qp!vR2mZ"]


def test_licenses_match_brute_force(spark, messy):
    folder, rows = messy
    short = {k: licenses.TEMPLATES[k] for k in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "CC-BY-4.0")}
    extra = [(100, "Licensed under CC BY-NC 4.0"), (101, "this work is licensed under the gnu general public license version 3 and more"), (102, "released under mit license " * 3)]
    few = [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 400] + extra
    docs = spark.createDataFrame(few, "doc_id long, text string")
    got = Counter((r.doc_id, r.license and (r.license, round(r.dice, 9), r.first_word, r.license_words)) for r in licenses.scan_licenses(docs, templates=short).collect())
    expected = [(i, brute.best_dice(t, short, 0.8)) for i, t in few]
    assert got == Counter((i, b and (b[0], round(b[1], 9), b[2], b[3])) for i, b in expected)
    found = {r.doc_id: r.license for r in QUERIES["op7_license_scan"](spark, folder).collect()}
    assert found[24] == "MIT" and found[3] is None


def test_personal_data_matches_brute_force(spark, messy):
    folder, rows = messy
    got = rows_of(QUERIES["op8_personal_data"](spark, folder), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == Counter((r[0], *brute.personal(r[1])) for r in rows)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to john.doe [at] example [dot] org today", "hidden_email", "john.doe [at] example [dot] org"),
        ("write to jane at example dot com today", "hidden_email", "jane at example dot com"),
        ("mail jоhn@exаmple.com now", "hidden_email", "jоhn@exаmple.com"),
        ("host 192[.]168[.]0[.]1 is down", "hidden_ip", "192[.]168[.]0[.]1"),
        ("call plus one five five five one two three four five six seven now", "hidden_phone", "plus one five five five one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one end", "hidden_card", "four one one one one one one one one one one one one one one one"),
        ("card ４１１１ １１１１ １１１１ １１１１ end", "hidden_card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    spans = [(personal.KINDS[k], text[a:b]) for a, k, b in personal.personal_spans(text)]
    assert (kind, source) in spans


@pytest.mark.parametrize("text", ["look at example.com for more", "one two three four", "the dot at the end", "été à la maison", "at 5 dot com", "Привет, мир"])
def test_clean_prose_has_no_personal_data(text):
    assert personal.personal_spans(text) == []


def test_repeats_match_brute_force(spark, messy, unique):
    for folder, rows in (unique, messy):
        named = sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0])
        rows = named + [r[:2] for r in rows if r[0] is None]
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for hot in (repeats.HOT_BUCKET, 1):  # the small limit deals windows out by content
            got = repeats.remove_repeats(docs, hot=hot)
            assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.without_repeats(rows))


def test_long_texts_are_searched_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 9000).astype(np.uint8)
    monkeypatch.setattr(repeats, "PART", 1000)
    got = repeats.runs_of(data, np.array([0, 9000]), Spans(5), 100)
    windows = sorted(w for s, n in zip(got["start"], got["n"], strict=True) for w in range(s, s + n))
    assert windows == list(range(8901))


def test_refine_numbers_equal_strings():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    data[1000:1300] = data[200:500]
    starts = np.arange(len(data) - 100)
    number = repeats.refine(data, starts, 100)
    strings = [data[s : s + 100].tobytes() for s in starts]
    count = Counter(strings)
    names = {}
    for s, k in zip(strings, number.tolist(), strict=True):
        assert (k >= 0) == (count[s] > 1)
        if k >= 0:
            assert names.setdefault(k, s) == s


def test_packing_keeps_words_and_conflicts(spark, messy):
    folder, rows = messy
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for shard_rows in (4096, 5):
        got = packing.pack(docs, capacity=256, shard_rows=shard_rows).toPandas()
        words = Counter()
        for i, text, *_ in rows:
            words[i] += len(brute.WORD.findall(text or ""))
        total = got.assign(doc_id=got.doc_id.fillna(-1)).groupby("doc_id").n_tokens.sum()
        assert total.to_dict() == {-1 if k is None else k: v for k, v in words.items() if v}
        assert not got.duplicated(["bin_id", "source"]).any()
        assert not got.duplicated(["bin_id", "cluster"]).any()
        got = got.sort_values(["bin_id", "bin_offset"])
        bins = got.groupby("bin_id")
        assert (bins.n_tokens.sum() <= 256).all()
        assert (got.bin_offset == bins.n_tokens.cumsum() - got.n_tokens).all()


def test_shards_need_hardly_more_bins_than_one_packing():
    """Bins of shards against one global packing of all rows, over the 10,000 documents of the largest test table."""
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "source", "text"]).to_pandas()
    sizes = table.text.fillna("").str.count(brute.WORD.pattern)
    rows = table.assign(size=sizes, cluster=table.text.map(hash), row=range(len(table)))[sizes > 0]
    whole = packing.pack_shard(rows.assign(shard=0), packing.CAPACITY).bin_id.nunique()
    parts = rows.assign(shard=np.random.default_rng(1).integers(0, 3, len(rows)))
    dealt = sum(packing.pack_shard(part, packing.CAPACITY).bin_id.nunique() for _, part in parts.groupby("shard"))
    assert whole <= dealt <= 1.01 * whole


def test_an_id_with_most_rows_fills_no_shard(spark):
    docs = spark.createDataFrame([(7 if k % 3 else k, f"w{k} " * 5, f"s{k % 40}") for k in range(600)], "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=64, shard_rows=50)
    shards = got.selectExpr("bin_id >> 32 AS shard", "doc_id").groupBy("shard").count().collect()
    assert len(shards) == 12 and max(r["count"] for r in shards) < 120
    assert got.count() == 600


def test_bins_choose_the_tightest_compatible():
    rng = np.random.default_rng(7)
    bins, plain = packing.Bins(100), []
    for _ in range(400):
        size, source, cluster = int(rng.integers(1, 60)), 1 << int(rng.integers(0, 6)), int(rng.integers(0, 3)) and 1 << int(rng.integers(0, 9))
        fits = [(free, k) for k, (free, s, c) in enumerate(plain) if free >= size and not (s & source or c & cluster)]
        at = min(fits)[1] if fits else len(plain)
        if not fits:
            plain.append((100, 0, 0))
        free, s, c = plain[at]
        plain[at] = (free - size, s | source, c | cluster)
        assert bins.place(size, source, cluster) == (at, 100 - free)


def test_language_is_learned_from_labelled_text_only(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    # labels and sources of held-out rows, and all sources, may say anything
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    again = language.identify(other).toPandas()
    assert dict(zip(again.doc_id, again.lang_pred, strict=True)) == dict(zip(got.doc_id, got.lang_pred, strict=True))


def test_language_of_texts_without_letters_is_unknown(spark, messy):
    folder, _ = messy
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, folder).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 28))
    assert got[27].lang_pred in ("de", "en") and got[3].lang_pred in ("de", "en")
    unlabelled = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_scorer_equals_the_plain_network():
    net = language.Network(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, language.WINDOW)).astype(np.uint8)
    hidden = []
    for w in language.WIDTHS:
        spelled = np.stack([net.weights["embedding"][x[:, k : k + language.WINDOW - w + 1]] for k in range(w)], axis=2)
        hidden.append(np.einsum("btkd,kdf->btf", spelled, net.weights[f"filter{w}"]).max(axis=1))
    plain = language.softmax(np.maximum(np.concatenate(hidden, axis=1), 0) @ net.weights["out"])
    assert np.allclose(net.compiled()(x), plain, atol=1e-5)


def test_tiny_sources_reach_their_targets_beside_a_huge_one(spark, monkeypatch):
    # fewer slots give the small table the coarse blocks of a large one
    monkeypatch.setattr(mixing, "SLOTS", 1 << 13)
    sizes = [("huge", 500, 2000), ("few", 10, 20), ("some", 20, 50), ("rare", 100, 60), (None, 3, 1)]
    docs = spark.createDataFrame([(f"{s}{k}", "w " * n, s) for s, m, n in sizes for k in range(m)], "doc_id string, text string, source string")
    full = mixing.mix(docs)
    assert full.count() == docs.count()
    got = {r.source: (r.size, r.target, r.taken) for r in full.groupBy("source").agg(F.sum("size").alias("size"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    for source, documents, words in sizes:
        size, target, taken = got[source]
        assert size == documents * words and taken <= 3 * size
        assert abs(taken - target) <= 0.01 * target + 3
    kept = {r.source for r in mixing.repeat_to_mix(docs).select("source").distinct().collect()}
    assert kept >= {"huge", "few", "some", "rare"}


def test_a_huge_source_with_a_small_target_reaches_it(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 1 << 8)
    sizes = [("a", 200, 100), *((f"b{k:03}", 5, 20) for k in range(400))]
    docs = spark.createDataFrame([(f"{s}{k}", "w " * n, s) for s, m, n in sizes for k in range(m)], "doc_id string, text string, source string")
    for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target + 3


CLEAN = "the old catalog in 1998 was a dialog in French, they spread more seeds, share onions and design up to three maps while rivers run under the stone bridge "


@pytest.mark.parametrize("text", [CLEAN.strip(), CLEAN * 5, (CLEAN * 3).strip() + " so click here to see it, he said", "Ein Dialog in Wien über Kataloglog into und señalog in zwei Teilen bleibt heute noch lange ohne jede Antwort und ohne Ende"])
def test_prose_with_words_like_boilerplate_loses_nothing(spark, text):
    distinct = " ".join(f"{w}{k}" if k > 40 else w for k, w in enumerate(text.split()))
    got = quality.clean_lines(spark.createDataFrame([(1, distinct)], "doc_id long, text string")).first()
    assert got.lost_chars == 0 and got.clean == distinct and got.kept


@pytest.mark.parametrize("line", ["Log in", "Subscribe to our newsletter", "All Rights Reserved.", "we use cookies, accept all cookies, see our privacy policy and terms of use, log in or sign up"])
def test_boilerplate_lines_fail(spark, line):
    docs = spark.createDataFrame([(1, f"é\n{line}\nlog"), (2, "in the plain text")], "doc_id long, text string").coalesce(1)
    assert [r.clean for r in quality.clean_lines(docs).orderBy("doc_id").collect()] == ["é\nlog", "in the plain text"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("export DB_PASSWORD=xK9$vQ!27#mZ", "xK9$vQ!27#mZ"),
        ("client_secret: 8f!Qz@71LmWp", "8f!Qz@71LmWp"),
        ("secret_key = 'pX8!zz@Lq2#Vt9'", "pX8!zz@Lq2#Vt9"),
        ("aws_secret_access_key=abcdEFGH1234ijklMNOP5678", "abcdEFGH1234ijklMNOP5678"),
        ('{"clientSecret": "8f!Qz@71LmWp"}', "8f!Qz@71LmWp"),
        ("spring.datasource.password.prod=xK9$vQ!27#mZ", "xK9$vQ!27#mZ"),
        ("MYSQL_PWD=xK9$vQ!27#mZ", "xK9$vQ!27#mZ"),
        ("secret-access key: xK9$vQ!27#mZ", "xK9$vQ!27#mZ"),
        ("secret_note is password: xK9$vQ!27#mZ", "xK9$vQ!27#mZ"),
    ],
)
def test_compound_names_are_credential_contexts(text, value):
    assert [text[a:b] for a, k, b in credentials.secret_spans(text) if k == 3] == [value]


def test_ordinary_words_are_no_credential_names():
    text = "Secretary: Constantinople tokenizer = Constantinople passage: Constantinople compass is Constantinople db_password=password"
    assert credentials.secret_spans(text) == []
    assert credentials.secret_spans("token" * 200_000) == []


def test_repeated_and_missing_ids_do_not_grow_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language.Network, "fit", lambda net, windows, targets: seen.append((len(windows), np.bincount(targets).tolist())))
    words = "river stone cloud garden winter table lamp window bridge forest".split()
    ids = [None] * 300 + ["0"] * 300 + [f"d{k}" for k in range(300)] + ["copy"] * 300
    rows = [(i, "same text here" if i == "copy" else f"{words[k % 10]} {k} " * 30, "en" if k % 2 else "de") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(6)
    language.train(docs, per_language=20)
    (windows, per_label), = seen
    assert windows == sum(per_label) and all(20 <= n <= 20 * language.WINDOWS for n in per_label)


def test_more_labels_than_are_learned(spark, monkeypatch):
    """A dirty label column: the most frequent labels are learned, within the bound of the sample."""
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(language, "MOST_DOCUMENTS", 30)
    rows = [(k, f"the house {k} and the garden" if k % 2 else f"das haus {k} und der garten", ("en" if k % 2 else "de") if k % 5 else f"junk{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(docs)
    assert len(net.labels) == 3 and {"de", "en"} < set(net.labels)
    got = language.identify(docs).collect()
    assert len(got) == 300 and {r.lang_pred for r in got} <= set(net.labels)
