"""Linear regression by mini-batch descent: one aggregation brings the moments of many batches, the steps follow on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class State:
    """Where a descent stands after some epochs: weights of the scaled columns (intercept first), their running mean, the losses so far."""

    epoch: int
    weights: list[float]
    mean: list[float]
    losses: list[float] = field(default_factory=list)


def batch_moments(data: DataFrame, columns: Sequence[str], epochs: Sequence[int], batches: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums of products of the columns for every batch of every epoch. Each epoch deals the rows anew, by their ``_h``."""
    dealt = data.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in epochs])))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("_h", "epoch", F.lit(seed)), F.lit(batches)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs]
    out = {}
    for row in dealt.groupBy("epoch", "batch").agg(*sums).collect():  # epochs x batches rows
        m = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"s{i}_{j}"]
        out[row["epoch"], row["batch"]] = m
    return out


def descend(
    df: DataFrame,
    features: Sequence[str],
    label: str = "y",
    alpha: float = 1e-4,
    epochs: int = 60,
    batches: int = 16,
    seed: int = 0,
    together: int = 10,
    resume: State | None = None,
    save: Callable[[State], None] | None = None,
) -> tuple[list[float], list[float]]:
    """Minimises 1/(2n) |y - Xw - b|^2 + alpha/2 |w|^2 by steps over shuffled batches: ([b, w...], loss per epoch).

    Columns are centred and scaled first; step sizes fall with the number of steps, and the result is the mean of the weights over the later half
    of the epochs. The gradient of a batch needs only its moments, so ``together`` epochs cost one pass. ``save`` gets the state after
    each pass, and a descent that is given one goes on from there, to the same result.
    """
    names = list(features)
    # rows are dealt by the values they come with, which no order of sums can change
    used = df.select(*names, F.col(label).alias("_y")).dropna().withColumn("_h", F.xxhash64(*names, "_y"))
    aggregates = [f(c).alias(f"{k}{i}") for i, c in enumerate([*names, "_y"]) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    scale = used.agg(*aggregates).first()
    centre = np.array([scale[f"m{i}"] or 0.0 for i in range(len(names) + 1)])
    spread = np.array([scale[f"s{i}"] or 1.0 for i in range(len(names) + 1)])
    columns = ["_one", *[f"_z{i}" for i in range(len(names) + 1)]]
    scaled = used.select("_h", F.lit(1.0).alias("_one"), *[((F.col(c) - F.lit(float(centre[i]))) / F.lit(float(spread[i]))).alias(f"_z{i}") for i, c in enumerate([*names, "_y"])])
    k = len(names) + 1
    # the penalty is on the weights of the columns as given
    penalty = np.concatenate([[0.0], alpha / spread[:-1] ** 2])
    state = resume or State(0, [0.0] * k, [0.0] * k)
    w, mean = np.array(state.weights), np.array(state.mean)
    losses, half = list(state.losses), epochs // 2
    largest = 1.0 / (k + penalty.max())
    for start in range(state.epoch, epochs, together):
        chunk = list(range(start, min(start + together, epochs)))
        moments = batch_moments(scaled, columns, chunk, batches, seed)
        for epoch in chunk:
            total, rows = 0.0, 0.0
            for batch in range(batches):
                m = moments.get((epoch, batch))
                if m is None:
                    continue
                n = m[0, 0]
                gram, cross = m[:k, :k], m[:k, k]
                total += (w @ gram @ w - 2 * cross @ w + m[k, k]) / 2
                rows += n
                step = largest / (1 + (epoch * batches + batch) / (8 * batches))
                w = w - step * ((gram @ w - cross) / n + penalty * w)
            losses.append(float(total / rows) * float(spread[-1]) ** 2 if rows else 0.0)
            if epoch >= half:
                mean += (w - mean) / (epoch - half + 1)
        if save is not None:
            save(State(chunk[-1] + 1, w.tolist(), mean.tolist(), losses))
    slope = mean[1:] * spread[-1] / spread[:-1]
    intercept = centre[-1] + mean[0] * spread[-1] - float(slope @ centre[:-1])
    return [intercept, *slope.tolist()], losses


def linear_stage(features: Sequence[str], weights: Sequence[float], name: str = "yhat") -> SQLTransformer:
    """A saveable stage that predicts with the given weights, intercept first."""
    terms = [f"{float(weights[0])!r}D", *[f"{float(w)!r}D * `{c}`" for w, c in zip(weights[1:], features, strict=True)]]
    return SQLTransformer(statement=f"SELECT *, {' + '.join(terms)} AS {name} FROM __THIS__")
