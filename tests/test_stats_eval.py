"""Normalisation, histograms and error curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraweft.operators import evaluate, mosaic, stats, tables


@pytest.fixture(scope="module")
def px(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"sample_id": np.repeat(np.arange(50), 8), "channel": np.tile([0, 1], 200), "value": rng.normal(size=400)})
    pdf.loc[pdf.channel == 1, "value"] = 4.0
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("mode", ["per", "global"])
def test_zscore_round_trip(px, mode):
    st = stats.channel_stats(px, mode)
    back = stats.unzscore(stats.zscore(px, st), st)
    diff = back.agg(F.abs(F.sum("value") - px.agg(F.sum("value")).scalar())).first()[0]
    assert diff < 1e-9


def test_minmax_without_spread_is_null(px, spark):
    st = px.groupBy(F.col("channel").alias("layer_id")).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    st = st.withColumn("fold", F.lit(None).cast("int"))
    out = stats.minmax_norm(px.withColumnRenamed("channel", "layer_id"), st, None).toPandas()
    assert out[out.layer_id == 1]["value"].isna().all()
    flat = out[out.layer_id == 0]["value"]
    assert flat.min() == 0.0 and flat.max() == 1.0


def test_test_samples_do_not_leak(spark):
    px = spark.createDataFrame([(0, 1, 5.0), (1, 1, 9.0), (2, 1, 1.0)], "sample_id bigint, layer_id int, value double")
    sp = spark.createDataFrame(
        [(0, None, "remaining"), (1, None, "test"), (2, None, "remaining"), (0, 0, "train"), (2, 0, "val")],
        "sample_id bigint, fold int, role string",
    )
    got = {r.fold: (r.vmin, r.vmax) for r in stats.layer_minmax(px, sp).collect()}
    assert got == {None: (1.0, 5.0), 0: (5.0, 5.0)}


@pytest.mark.parametrize("steps", [2, 11, 1000])
def test_fraction_under(spark, steps):
    rng = np.random.default_rng(1)
    grid = np.linspace(0, 1, steps)
    values = np.concatenate([rng.uniform(-0.2, 1.5, 500), grid[:: max(steps // 20, 1)]])
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "e": values}))
    got = evaluate.fraction_under(df, "e", steps, ["g"]).toPandas().sort_values("step")
    want = [(values < t).mean() for t in got["threshold"]]
    np.testing.assert_allclose(got["share"], want, atol=1e-12)


def test_constant_prediction_has_no_correlation(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 2.0), (0, "a", 3.0, 2.0)], "fold int, target string, y double, yhat double")
    assert evaluate.pearson(df).first()["r"] is None


def test_diff_counts_one_sided_cells(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, value double")
    b = spark.createDataFrame([(1, 1.0005), (2, 2.5), (4, 1.0), (3, None)], "k int, value double")
    got = mosaic.dataset_diff(a, b, ["k"]).toPandas()
    assert sorted(got["k"]) == [2, 4]
    assert mosaic.dataset_diff(a, a, ["k"]).isEmpty()


def test_mosaic_is_idempotent(spark):
    t = spark.createDataFrame([(0, 1, 1, 5.0), (1, 1, 1, 6.0), (0, 2, 1, 7.0)], "file_order int, ix int, iy int, value double")
    once = mosaic.mosaic(t)
    twice = mosaic.mosaic(once.withColumn("file_order", F.lit(0)))
    assert once.exceptAll(twice).isEmpty() and once.count() == 2


def test_layouts(spark):
    rows = [(0, i, j, c, float(c * 100 + i * 10 + j)) for i in range(2) for j in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, "sample_id int, si int, sj int, channel int, value double")
    arr = np.array([[[c * 100 + i * 10 + j for c in range(3)] for j in range(2)] for i in range(2)], dtype=float)
    assert tables.to_layout(df, "hwc").first()["cube"] == arr.reshape(-1).tolist()
    assert tables.to_layout(df, "chw").first()["cube"] == arr.transpose(2, 0, 1).reshape(-1).tolist()
    flat = df.withColumn("p", tables.flat_index("chw", 2, 3)).orderBy("p").toPandas()["value"]
    assert flat.tolist() == arr.transpose(2, 0, 1).reshape(-1).tolist()


def test_noise_is_repeatable(px):
    numbered = px.withColumn("row", F.monotonically_increasing_id()).cache()
    a = stats.add_noise(numbered, 0.1, 3, ["row"]).toPandas().sort_values("row")
    b = stats.add_noise(numbered.repartition(7).sortWithinPartitions("value"), 0.1, 3, ["row"]).toPandas().sort_values("row")
    assert (a.value.to_numpy() == b.value.to_numpy()).all()
    other = stats.add_noise(numbered, 0.1, 4, ["row"]).toPandas().sort_values("row")
    assert (other.value.to_numpy() != a.value.to_numpy()).all()


def test_noise_is_gaussian(spark):
    clean = spark.range(20_000).select("id", F.lit(0.0).alias("value"))
    noise = np.sort(stats.add_noise(clean, 2.0, 5).toPandas().value.to_numpy()) / 2
    assert abs(noise.mean()) < 0.03 and abs(noise.std() - 1) < 0.03
    # share of values below some quantiles of the normal distribution
    for at, share in ((-1.959964, 0.025), (-0.674490, 0.25), (0.0, 0.5), (1.281552, 0.9), (2.575829, 0.995)):
        assert abs(np.searchsorted(noise, at) / len(noise) - share) < 5 * (share * (1 - share) / len(noise)) ** 0.5
