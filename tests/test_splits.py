"""Splits are disjoint, complete and of the promised size."""

from __future__ import annotations

import numpy as np
import pytest

from terraweft.operators import splits
from terraweft.operators.footprint import full_grid
from terraweft.operators.resample import number_samples


@pytest.fixture(scope="module")
def legal(spark):
    cells = full_grid(spark, 60, 50).where("(bi * 31 + bj * 17) % 11 <> 0")
    return number_samples(cells).cache()


def parts(df):
    pdf = df.toPandas()
    return {key: set(g["sample_id"]) for key, g in pdf.assign(fold=pdf["fold"].fillna(-1)).groupby(["role", "fold"])}


@pytest.mark.parametrize("rounding,up", [("ceil", np.ceil), ("floor", np.floor)])
def test_random_split(legal, rounding, up):
    n = legal.count()
    got = parts(splits.random_split(legal, folds=3, test_frac=0.3, val_frac=0.2, seed=1, rounding=rounding))
    test, rest = got[("test", -1)], got[("remaining", -1)]
    assert len(test) == up(n * 0.3) and not test & rest and len(test | rest) == n
    for fold in range(3):
        train, val = got[("train", fold)], got[("val", fold)]
        assert len(val) == up(len(rest) * 0.2) and not train & val and train | val == rest
    assert got[("val", 0)] != got[("val", 1)]


def masked(spark, kind):
    grid = full_grid(spark, 60, 50)
    masks = {
        "full": "true",
        "holes": "(bi * 31 + bj * 17) % 11 <> 0",
        "thin": "(bi * 7919 + bj * 104729) % 25 = 0",
        "ragged": "bj < 4 + bi % 7 OR (bi > 50 AND bj > 40)",
    }
    return number_samples(grid.where(masks[kind]))


@pytest.mark.parametrize("kind", ["full", "holes", "thin", "ragged"])
@pytest.mark.parametrize(("method", "buffer"), [("tiles", 2), ("reject", 2), ("reject", 10)])
def test_block_split(spark, kind, method, buffer):
    legal = masked(spark, kind).cache()
    n = legal.count()
    out, marks = splits.block_split_with_seeds(legal, 10, (0.2, 0.1), buffer=buffer, folds=2, seed=5, method=method)
    out = out.cache()
    got = parts(out)
    test, rest = got[("test", -1)], got[("remaining", -1)]
    assert not test & rest and len(test | rest) == n and len(test) == int(n * 0.2)
    for fold in range(2):
        train, val = got[("train", fold)], got[("val", fold)]
        assert not train & val and train | val == rest and len(val) == int(n * 0.1)
    report = splits.split_shortfall(out, legal, (0.2, 0.1)).toPandas()
    assert (report["reached"] == report["wanted"]).all() and len(report) == 3
    sizes = out.where("role = 'test'").groupBy("region").count().toPandas()
    assert sorted(sizes["count"]) == sorted(q for q in splits.quotas(int(n * 0.2), 10) if q)
    report = splits.seed_report(marks).toPandas()
    assert (report["regions"] == 10).all() and (report["nearer"] == 0).all()
    # every seed is as far from the cells of the blocks before it as was asked of it
    seeds, blocks = marks.toPandas().fillna({"fold": -1}), out.join(legal, "sample_id").where("region IS NOT NULL").toPandas().fillna({"fold": -1})
    blocks = blocks.merge(seeds[["role", "fold", "region", "turn"]], on=["role", "fold", "region"])
    for s in seeds.itertuples():
        before = blocks[(blocks.role == s.role) & (blocks.fold == s.fold) & (blocks.turn < s.turn)]
        away = np.maximum(abs(before.bi - s.si), abs(before.bj - s.sj))
        assert not len(away) or away.min() > s.apart
        assert np.isnan(s.clear) or s.clear == away.min()
    if kind == "full" and buffer == 2:
        assert (seeds["apart"] == 2).all()


def test_regions_without_cells_are_not_placed(spark):
    legal = number_samples(full_grid(spark, 2, 3))
    out, marks = splits.block_split_with_seeds(legal, 20, (0.5, 0.34), folds=1, seed=1)
    got = parts(out)
    assert len(got[("test", -1)]) == 3 and len(got[("val", 0)]) == 2
    assert {r.role: r.regions for r in splits.seed_report(marks).collect()} == {"test": 3, "val": 2}


def test_no_cells_give_no_blocks(spark):
    legal = number_samples(full_grid(spark, 2, 3)).where("false")
    out, marks = splits.block_split_with_seeds(legal, 4, (0.5, 0.3), folds=2, seed=1)
    assert out.count() == 0 and marks.count() == 0


def test_training_rows_of_folds_without_validation(spark):
    rows = [(1, None, "remaining"), (2, None, "remaining"), (1, 0, "val")]
    table = spark.createDataFrame(rows, "sample_id long, fold int, role string")
    got = {tuple(r) for r in splits.train_ids(table, folds=2).collect()}
    assert got == {(2, 0), (1, 1), (2, 1)}
    assert {tuple(r) for r in splits.train_ids(table.where("role <> 'val'")).collect()} == {(1, 0), (2, 0)}


def test_margin_keeps_training_away(legal):
    out = splits.spatial_block_split(legal, 6, (0.1, 0.1), folds=1, seed=2, exclude_margin=2)
    placed = out.join(legal.select("sample_id", "bi", "bj"), "sample_id").toPandas()
    test, train = placed[placed.role == "test"], placed[placed.role == "train"]
    for r in train.itertuples():
        assert (np.maximum(abs(test.bi - r.bi), abs(test.bj - r.bj)) > 2).all()


def test_quotas_add_up():
    assert splits.quotas(10, 4) == [2, 3, 2, 3]
    assert all(sum(splits.quotas(n, k)) == n for n in range(200) for k in (1, 7, 10, 30, 100))


def test_dilate(spark):
    got = splits.dilate(spark.createDataFrame([(5, 5), (6, 5)], "bi int, bj int"), 1).toPandas()
    assert {(r.bi, r.bj) for r in got.itertuples()} == {(i, j) for i in range(4, 8) for j in range(4, 7)}


def test_roles(legal):
    table = splits.random_split(legal, folds=2, seed=3).cache()
    got = parts(table)
    train = splits.train_ids(table).toPandas()
    for fold in range(2):
        assert set(train[train.fold == fold].sample_id) == got[("train", fold)]
    everything = splits.combine_roles(table, ["train", "val", "test"], 0)
    assert everything.count() == legal.count()
    rest = splits.remaining_ids(legal, table.where("role = 'test'")).toPandas()
    assert set(rest.sample_id) == got[("remaining", -1)]


def test_batches(legal):
    got = splits.batch_ids(legal, "sample_id", 100, 1).groupBy("batch").count().toPandas().sort_values("batch")
    assert (got["count"].iloc[:-1] == 100).all() and 0 < got["count"].iloc[-1] <= 100
    assert splits.subsample(legal, "sample_id", 10**6, 1).count() == legal.count()
