"""Ranks, quotas, joins and quantiles that avoid one-task work."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraweft.functions import scale
from terraweft.functions.scalars import order_hash


@pytest.fixture(scope="module")
def rows(spark):
    # one key holds a third of the rows
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17).cast("int")
    return spark.range(3000).withColumn("k", key).withColumn("v", (F.col("id") * 7919 % 1009).cast("double"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, rows, how):
    right = spark.range(0, 12).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    b = rows.join(right, "k", how).toPandas()
    # no hot key, one hot key, every key spread
    for options in ({}, {"hot_rows": 20}, {"splits": 3}):
        a = scale.salted_join(rows, right, ["k"], how, **options).toPandas()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        pd.testing.assert_frame_equal(
            a[cols].sort_values("id").reset_index(drop=True), b[cols].sort_values("id").reset_index(drop=True)
        )


def test_only_hot_keys_are_repeated(spark):
    left = spark.range(100).selectExpr("id", "CASE WHEN id < 90 THEN 1 ELSE id END AS k")
    right = spark.range(100).selectExpr("id AS k", "id * 2 AS w")
    joined = scale.salted_join(left, right, ["k"], hot_rows=30)
    assert joined.count() == 100
    hot = left.groupBy("k").count().where("count > 30").collect()
    assert [tuple(r) for r in hot] == [(1, 90)]


def test_lookup_equals_join(spark, rows):
    table = spark.range(0, 100).select(F.col("id").cast("int").alias("k"), (F.col("id") + 5).alias("w"))
    got = scale.lookup(rows, table, ["k"]).select("id", "w").orderBy("id").toPandas()
    want = rows.join(table, "k").select("id", "w").orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, want)


def test_bucket_rank_is_global_rank(rows):
    got = scale.bucket_rank(rows, F.floor(F.col("id") / 100), [F.col("id")]).toPandas()
    assert (got["rank"] == got["id"] + 1).all()


def test_hash_rank_is_a_repeatable_permutation(rows):
    a = scale.hash_rank(rows, "id", 1).orderBy("rank").toPandas()
    b = scale.hash_rank(rows.repartition(5), "id", 1).orderBy("rank").toPandas()
    assert a["rank"].tolist() == list(range(1, 3001))
    assert a["id"].tolist() == b["id"].tolist()
    assert a["id"].tolist() != scale.hash_rank(rows, "id", 2).orderBy("rank").toPandas()["id"].tolist()


@pytest.mark.parametrize("quota", [0, 1, 777, 3000, 5000])
def test_take_random_takes_the_first_of_the_order(rows, quota):
    got = scale.take_random(rows, "id", quota, 9, "keep").toPandas()
    assert len(got) == 3000
    order = rows.withColumn("h", order_hash(F.col("id"), 9)).orderBy("h").limit(quota).toPandas()["id"]
    assert set(got[got["keep"]]["id"]) == set(order)


def test_take_quota_per_group(rows):
    got = scale.take_quota(rows, F.floor(F.col("v") / 50), [F.col("v"), F.col("id")], 20, "keep", ["k"]).toPandas()
    for _, part in got.groupby("k"):
        want = part.sort_values(["v", "id"]).head(20)["id"]
        assert set(part[part["keep"]]["id"]) == set(want)


@pytest.mark.parametrize("accuracy", [1000, 100_000])
def test_exact_quantiles_with_repeated_values(spark, accuracy):
    rng = np.random.default_rng(3)
    values = rng.permutation(np.concatenate([rng.normal(size=2001), np.full(1500, 0.25)]))
    pdf = pd.DataFrame({"g": ["a"] * 2501 + ["b"] * 900 + ["c"] * 97 + ["d"] * 3, "v": values})
    probs = [0.0, 0.25, 0.5, 0.733, 1.0]
    got = scale.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs, accuracy=accuracy).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got["g"] == g].sort_values("prob")["quantile"].to_numpy()
        np.testing.assert_allclose(mine, np.quantile(part["v"], probs), rtol=0, atol=1e-12)


def test_bounded_refuses_large_sides(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(scale.bounded(spark.range(10), 10))
    assert not hinted(scale.bounded(spark.range(11), 10))


@pytest.mark.parametrize("accuracy,sorted_rows", [(20, 50), (20, 65_536)])
def test_quantiles_by_rounds_of_histograms(spark, monkeypatch, accuracy, sorted_rows):
    """Coarse sketches leave wide brackets, which rounds narrow: also of clusters far apart, of extreme and of repeated values."""
    monkeypatch.setattr(scale, "BINS", 64)
    rng = np.random.default_rng(11)
    values = {
        "normal": rng.normal(size=3000),
        "clusters": np.concatenate([rng.normal(size=1000) * 1e-9, 1e9 + rng.normal(size=1001)]),
        "powers": 2.0 ** rng.integers(-30, 30, 800),
        "ends": np.concatenate([rng.normal(size=500), [-1.7e308, 1.7e308, 0.0, -0.0]]),
        "same": np.full(900, 3.5),
        "few": rng.integers(0, 5, 2000).astype(float),
    }
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in values.items()])
    probs = [0.0, 0.1, 0.25, 0.5, 0.5005, 0.99, 1.0]
    got = scale.exact_quantiles(spark.createDataFrame(pdf).repartition(6), ["g"], "v", probs, accuracy, sorted_rows).toPandas()
    for g, v in values.items():
        mine = got[got["g"] == g].sort_values("prob")["quantile"].to_numpy()
        low, high = (np.quantile(v, probs, method=m) for m in ("lower", "higher"))
        at = np.array(probs) * (len(v) - 1)
        np.testing.assert_allclose(mine, low + (high - low) * (at - np.floor(at)), rtol=1e-9)
