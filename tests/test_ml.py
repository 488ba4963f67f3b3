"""Baselines on data with known coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terraweft.operators import descent, kernel, ml, splits, training
from terraweft.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["sample_id"] = np.arange(300)
    pdf["y"] = 3 * pdf.a - 2 * pdf.b + 1
    return spark.createDataFrame(pdf).cache()


def test_linear_recovers_coefficients(data):
    last = ml.fit("linear", data, ["a", "b"]).stages[-1]
    np.testing.assert_allclose([*last.coefficients, last.intercept], [3, -2, 1], atol=1e-6)


def test_pca_of_all_components_is_linear(data):
    out = ml.predict(ml.fit("pca_lr", data, ["a", "b"], k=2), data).toPandas()
    np.testing.assert_allclose(out["yhat"], out["y"], atol=1e-6)


def test_lasso_shrinks_by_its_objective(data):
    # coordinate descent on 1/(2n) |y - Xw - b|^2 + alpha |w|_1
    pdf = data.toPandas()
    x, y, alpha = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(), 0.2
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(2)
    for _ in range(200):
        for j in range(2):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (xc[:, j] @ xc[:, j] / len(y))
    last = ml.fit("lasso", data, ["a", "b"], alpha=alpha).stages[-1]
    np.testing.assert_allclose(last.coefficients.toArray(), w, atol=1e-3)


def test_ridge_equals_the_closed_form(data):
    pdf = data.toPandas()
    x, y, alpha = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(), 0.3
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc / len(y) + alpha * np.eye(2), xc.T @ yc / len(y))
    last = ml.fit("ridge", data, ["a", "b"], alpha=alpha).stages[-1]
    np.testing.assert_allclose(last.coefficients.toArray(), want, atol=1e-6)


@pytest.mark.parametrize("kernel", ["linear", "polynomial"])
def test_kernel_ridge_equals_the_dual_form(data, kernel):
    pdf = data.toPandas()
    x, y, alpha = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(), 0.7
    k = x @ x.T if kernel == "linear" else (0.5 * x @ x.T + 1) ** 3
    want = k @ np.linalg.solve(k + alpha * np.eye(len(y)), y)
    model = ml.fit("kernel_ridge", data, ["a", "b"], kernel=kernel, alpha=alpha)
    got = ml.predict(model, data).toPandas().sort_values("sample_id")["yhat"]
    np.testing.assert_allclose(got, want, atol=1e-5)


def test_trees_learn_and_models_survive_storage(spark, data):
    for name, params in (("rf", {"trees": 10, "depth": 8}), ("gbt", {"rounds": 10})):
        model = ml.fit(name, data, ["a", "b"], **params)
        out = ml.predict(model, data).toPandas()
        assert np.corrcoef(out.y, out.yhat)[0, 1] > 0.9
    path = scratch_path(spark, "model")
    ml.save_model(model, path)
    again = ml.predict(ml.load_model(path), data).toPandas()
    np.testing.assert_allclose(out.sort_values("sample_id").yhat, again.sort_values("sample_id").yhat)


def test_cross_validate_predicts_only_val(data):
    table = splits.random_split(data, folds=2, seed=1)
    preds, times = ml.cross_validate(data, table, "ridge", ["a", "b"], [0, 1], alpha=1e-6)
    want = table.where("role = 'val'").select("sample_id", "fold")
    assert preds.select("sample_id", "fold").exceptAll(want).isEmpty() and preds.count() == want.count()
    assert times.count() == 2


def test_descent_reaches_the_closed_form(data):
    noisy = data.selectExpr("sample_id", "a * 5 + 100 AS a", "b", "y + 0.3 * sin(sample_id) AS y").cache()
    pdf = noisy.toPandas()
    x, y, alpha = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(), 0.01
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc / len(y) + alpha * np.eye(2), xc.T @ yc / len(y))
    weights, losses = descent.descend(noisy, ["a", "b"], alpha=alpha, epochs=100, batches=8, seed=1)
    np.testing.assert_allclose(weights[1:], want, atol=1e-3)
    np.testing.assert_allclose(weights[0], y.mean() - want @ x.mean(0), atol=0.1)
    assert len(losses) == 100 and losses[-1] < losses[0]
    again, _ = descent.descend(noisy.repartition(5), ["a", "b"], alpha=alpha, epochs=100, batches=8, seed=1)
    np.testing.assert_allclose(weights, again, rtol=1e-9)


class Stop(RuntimeError):
    pass


def folds(data):
    return splits.random_split(data, folds=3, seed=2)


@pytest.mark.parametrize("name,params", [("linear", {}), ("gbt", {"rounds": 3}), ("sgd", {"epochs": 20, "batches": 4})])
def test_stopped_training_goes_on(data, spark, name, params):
    table, path = folds(data).cache(), scratch_path(spark, "run")

    def stop(fold):
        if fold == 1:
            raise Stop

    with pytest.raises(Stop):
        training.train_folds(data, table, name, ["a", "b"], [0, 1, 2], path, after=stop, **params)
    preds, ledger = training.train_folds(data, table, name, ["a", "b"], [0, 1, 2], path, **params)
    whole, _ = training.train_folds(data, table, name, ["a", "b"], [0, 1, 2], scratch_path(spark, "run"), **params)
    rows = {r.fold: r for r in ledger.collect()}
    assert [rows[k].origin for k in range(3)] == ["loaded", "loaded", "fitted"]
    assert all(len(rows[k].log) > 0 and rows[k].samples > 0 for k in range(3))
    a, b = (p.toPandas().sort_values(["fold", "sample_id"]) for p in (preds, whole))
    np.testing.assert_allclose(a.yhat, b.yhat, rtol=1e-9)
    with pytest.raises(ValueError, match="another setup"):
        training.train_folds(data, table, name, ["a"], [0], path, **params)
    _, anew = training.train_folds(data, table, name, ["a"], [0], path, override=True, **params)
    assert anew.first()["origin"] == "fitted"


def test_stopped_descent_goes_on_inside_a_fold(data, spark, monkeypatch):
    table, path, kept = folds(data).cache(), scratch_path(spark, "run"), training.Ledger.save_round

    def stop(self, fold, state):
        kept(self, fold, state)
        if state.epoch == 20:
            raise Stop

    monkeypatch.setattr(training.Ledger, "save_round", stop)
    with pytest.raises(Stop):
        training.train_folds(data, table, "sgd", ["a", "b"], [0], path, epochs=40)
    asked, moments = [], descent.batch_moments
    monkeypatch.setattr(training.Ledger, "save_round", kept)
    monkeypatch.setattr(descent, "batch_moments", lambda d, c, epochs, *rest: asked.extend(epochs) or moments(d, c, epochs, *rest))
    preds, ledger = training.train_folds(data, table, "sgd", ["a", "b"], [0], path, epochs=40)
    assert asked == list(range(20, 40)) and len(ledger.first()["log"]) == 40
    whole, _ = training.train_folds(data, table, "sgd", ["a", "b"], [0], scratch_path(spark, "run"), epochs=40)
    a, b = (p.toPandas().sort_values("sample_id") for p in (preds, whole))
    np.testing.assert_allclose(a.yhat, b.yhat, rtol=1e-9)


def dense(x, y, z, alpha, gamma):
    """Kernel ridge by a solve over all rows."""
    return kernel.rbf(z, x, gamma) @ np.linalg.solve(kernel.rbf(x, x, gamma) + alpha * np.eye(len(x)), y)


@pytest.fixture(scope="module")
def wavy(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(2000, 3)), columns=["a", "b", "c"])
    pdf["sample_id"] = np.arange(2000)
    pdf["y"] = np.sin(pdf.a) + pdf.b * pdf.c + 0.1 * rng.normal(size=2000)
    return spark.createDataFrame(pdf).repartition(5).cache()


def test_rbf_on_all_rows_is_the_dense_solve(wavy, spark):
    pdf = wavy.toPandas().sort_values("sample_id")
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    model = ml.fit("kernel_ridge", wavy, ["a", "b", "c"], alpha=0.5, landmarks=2048)
    got = ml.predict(model, wavy).toPandas().sort_values("sample_id")
    np.testing.assert_allclose(got.yhat, dense(x, y, x, 0.5, 1 / 3), atol=1e-6)
    assert model.rows == 2000 and model.residual_max < 1e-7
    path = scratch_path(spark, "rbf")
    ml.save_model(model, path)
    again = ml.predict(ml.load_model(path), wavy).toPandas().sort_values("sample_id")
    np.testing.assert_allclose(again.yhat, got.yhat, rtol=1e-12)


def test_rbf_on_landmarks_tells_its_distance(wavy):
    pdf = wavy.toPandas().sort_values("sample_id")
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    model = ml.fit("kernel_ridge", wavy, ["a", "b", "c"], alpha=0.5, landmarks=300)
    got = ml.predict(model, wavy).toPandas().sort_values("sample_id").yhat.to_numpy()
    z = model.landmarks
    k = kernel.rbf(x, z, 1 / 3)
    own = k @ np.linalg.pinv(kernel.rbf(z, z, 1 / 3), rcond=kernel.SMALLEST) @ k.T
    assert model.residual_mean == pytest.approx(1 - np.diag(own).mean(), abs=1e-5) and 0 < model.residual_mean < 0.1
    want = own @ np.linalg.solve(own + 0.5 * np.eye(len(x)), y)
    np.testing.assert_allclose(got, want, atol=1e-4)
    assert np.mean((got - dense(x, y, x, 0.5, 1 / 3)) ** 2) < 0.02 * y.var()


def test_rbf_without_rows(wavy):
    model = ml.fit("kernel_ridge", wavy.where("a IS NULL"), ["a", "b", "c"])
    assert model.rows == 0 and ml.predict(model, wavy).agg({"yhat": "max"}).first()[0] == 0.0
