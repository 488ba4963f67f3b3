"""Stages of the pipeline, each on what the one before kept."""

from __future__ import annotations

import re
from collections import Counter

import brute
import corpus_pipeline
import pytest
from awkward import messy, nothing  # noqa: F401
from conftest import SF_DIR

from terraweft.llm import mixing, near
from terraweft.llm.frames import written


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF_DIR), name))
    return out


def test_stages_keep_the_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_language_stage_keeps_clean_documents(tables):
    assert tables[1].count() >= 0.98 * tables[0].count()


def test_one_document_of_each_text_stays(tables):
    body = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text)
    before, after = tables[1].collect(), tables[2].collect()
    assert Counter(map(body, after)) == Counter(set(map(body, before)))
    for r in after:
        assert (-len(r.text), r.doc_id) == min((-len(x.text), x.doc_id) for x in before if body(x) == body(r))


def test_one_document_of_each_group_stays(tables):
    before = [(r.doc_id, r.text) for r in tables[2].collect()]
    stay = {c for _, _, c in brute.near_components(before, 80)}
    assert {r.doc_id for r in tables[3].collect()} == stay


def test_mix_repeats_documents_towards_the_targets(tables):
    aims = {r.source: (r.target, r.largest) for r in mixing.mix(tables[3]).groupBy("source").agg({"target": "max", "size": "max"}).toDF("source", "target", "largest").collect()}
    words, copies = Counter(), Counter()
    for r in tables[4].collect():
        words[r.source] += len(brute.WORD.findall(r.text))
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    for source, (target, largest) in aims.items():
        assert abs(words[source] - target) <= largest + 10


def test_packing_places_every_word_once(tables):
    words = Counter()
    for r in tables[4].collect():
        words[r.doc_id] += len(brute.WORD.findall(r.text))
    packed = tables[5].toPandas()
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == dict(words)
    assert not packed.duplicated(["bin_id", "cluster"]).any()
    assert packed.groupby("bin_id").n_tokens.sum().max() <= 2048


def test_pipeline_runs_over_awkward_and_empty_tables(spark, messy, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []
    packed = corpus_pipeline.run(spark, messy[0]).collect()
    assert packed and near.CELL
