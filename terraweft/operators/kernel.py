"""Kernel ridge with the rbf kernel on landmarks: one pass of small matrix products, a known distance from the full kernel."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Python workers get the functions themselves, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows whose kernel values a task holds at once.
ROWS = 2048
#: Share of the largest eigenvalue of the landmarks' kernel below which a direction is noise.
SMALLEST = 1e-10


def rbf(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - z|^2) for every row of x and of z."""
    squares = (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2.0 * x @ z.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1) if len(batch) else np.zeros((0, len(names)))


@dataclass
class RbfModel:
    """Predictions k(x, landmarks) @ weights. ``residual_mean`` and ``residual_max`` tell how much of the kernel of a training row with itself,
    which is 1, the landmarks leave out: the kernel that was used differs from the full one by rows x residual_mean at most (trace)."""

    features: list[str]
    gamma: float
    landmarks: np.ndarray
    weights: np.ndarray
    rows: int
    residual_mean: float
    residual_max: float

    def transform(self, df: DataFrame) -> DataFrame:
        names, gamma, landmarks, weights = self.features, self.gamma, self.landmarks, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.slice(at, ROWS)
                    yhat = rbf(_columns(part, names), landmarks, gamma) @ weights
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(yhat)], names=[*part.schema.names, "yhat"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{fields}, yhat double")

    def save(self, spark: SparkSession, path: str, override: bool = False) -> None:
        head = json.dumps({"features": self.features, "gamma": self.gamma, "rows": self.rows, "residual_mean": self.residual_mean, "residual_max": self.residual_max})
        rows = [(i, head, z.tolist(), float(w)) for i, (z, w) in enumerate(zip(self.landmarks, self.weights, strict=True))]
        table = spark.createDataFrame(rows, "landmark int, head string, position array<double>, weight double")
        table.coalesce(1).write.mode("overwrite" if override else "errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RbfModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["landmark"])  # a row per landmark
        positions, weights = np.array([r["position"] for r in rows]), np.array([r["weight"] for r in rows])
        return cls(**json.loads(rows[0]["head"]), landmarks=positions, weights=weights)


def _products(features: list[str], gamma: float, landmarks: np.ndarray, mapping: np.ndarray):
    """Rows to the sums of a task: row i of phi' phi with phi' y behind it; row -1 has rows, residual and largest residual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = mapping.shape[1]
        gram, n, left, most = np.zeros((size, size + 1)), 0, 0.0, 0.0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                phi = rbf(_columns(part, features), landmarks, gamma) @ mapping
                y = part.column("y").to_numpy(zero_copy_only=False).astype(float)
                gram += phi.T @ np.concatenate([phi, y[:, None]], axis=1)
                residual = np.maximum(1.0 - (phi * phi).sum(1), 0.0)
                n, left, most = n + len(part), left + residual.sum(), max(most, residual.max(initial=0.0))
        if n:
            values = [*gram.tolist(), [float(n), float(left), float(most)]]
            yield pa.RecordBatch.from_arrays([pa.array([*range(size), -1], pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the same row of all tasks; of the largest residuals the largest."""
    values, i = np.stack(rows["v"].to_list()), int(rows["i"].iloc[0])
    total = values.sum(axis=0)
    if i < 0:
        total[2] = values[:, 2].max()
    return pd.DataFrame({"i": [i], "v": [total]})


def fit_rbf(df: DataFrame, features: Sequence[str], label: str = "y", alpha: float = 1.0, gamma: float | None = None, landmarks: int = 1024, seed: int = 0) -> RbfModel:
    """Minimises |y - f|^2 + alpha |f|^2 over functions on the landmarks: different rows, the first ``landmarks`` in the order of a hash.

    With no more different rows than landmarks this is kernel ridge itself. Otherwise the model tells how far its kernel is from the full one.
    Tasks add up matrices of landmarks x landmarks; these are all that travels, and all that the driver solves.
    """
    features, gamma = list(features), gamma or 1.0 / len(features)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("y")).dropna()
    order = F.xxhash64(*features, F.lit(seed))
    chosen = data.select(*features).distinct().orderBy(order, *features).limit(landmarks).collect()
    z = np.array([[r[c] for c in features] for r in chosen]).reshape(-1, len(features))
    if not len(z):
        return RbfModel(features, gamma, z, np.zeros(0), 0, 0.0, 0.0)
    values, vectors = np.linalg.eigh(rbf(z, z, gamma))
    stays = values > values[-1] * SMALLEST
    mapping = vectors[:, stays] / np.sqrt(values[stays])
    sums = data.mapInArrow(_products(features, gamma, z, mapping), "i int, v array<double>")
    found = {r["i"]: np.array(r["v"]) for r in sums.groupBy("i").applyInPandas(_added, "i int, v array<double>").collect()}
    system = np.stack([found[i] for i in range(mapping.shape[1])])
    w = np.linalg.solve(system[:, :-1] + alpha * np.eye(len(system)), system[:, -1])
    rows, left, most = found[-1]
    return RbfModel(features, gamma, z, mapping @ w, int(rows), float(left / rows), float(most))
