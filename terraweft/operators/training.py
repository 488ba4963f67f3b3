"""Training runs over folds that go on where they stopped: models, scores and logs in a ledger, round by round."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terraweft.functions.scalars import pearson_r
from terraweft.operators import ml
from terraweft.operators.descent import State
from terraweft.operators.evaluate import errors
from terraweft.operators.kernel import RbfModel
from terraweft.session import cut_lineage

FOLD = "model string, fold int, setup string, version string, samples bigint, mse double, mae double, r double, train_seconds double, log array<double>"
ROUND = "setup string, epoch int, weights array<double>, mean array<double>, losses array<double>"


class Ledger:
    """What a run has finished, below one folder: an entry and a model per fold, and the state of the fold under way.

    An entry is a table of one row in a folder of its own, and counts once it is whole. A model is saved under a name that no other has, before
    the entry that names it. So a run that is stopped anywhere, also while it replaces an earlier one, finds only what is complete.
    Entries of another setup (model, features, parameters, data) are refused.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, setup: dict, override: bool = False):
        self.spark, self.model = spark, model
        self.path = f"{path.rstrip('/')}/{model}"
        self.setup = json.dumps(setup, sort_keys=True, default=str)
        self.override = override

    def _rows(self, path: str, schema: str) -> list[Row]:
        try:
            rows = self.spark.read.schema(schema).parquet(path).collect()  # a row per entry
        except AnalysisException:
            return []
        if any(row["setup"] != self.setup for row in rows):
            raise ValueError(f"{path} was trained with another setup; train elsewhere or override it")
        return rows

    def _put(self, path: str, schema: str, row: Row | tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    def fold(self, fold: int) -> Row | None:
        """The entry of a finished fold."""
        rows = [] if self.override else self._rows(f"{self.path}/fold-{fold}/entry", FOLD)
        return rows[0] if rows else None

    def finish(self, fold: int, model: PipelineModel | RbfModel, scores: Row, seconds: float, log: Sequence[float]) -> Row:
        version = f"{self.path}/fold-{fold}/model-{uuid.uuid4().hex[:12]}"
        ml.save_model(model, version)
        row = (self.model, fold, self.setup, version, scores["samples"], scores["mse"], scores["mae"], scores["r"], seconds, [float(x) for x in log])
        self._put(f"{self.path}/fold-{fold}/entry", FOLD, row)
        return Row(*[c.split(" ")[0] for c in FOLD.split(", ")])(*row)

    def rounds(self, fold: int) -> State | None:
        """The last state of a fold that was stopped between rounds. An attempt that overrides another leaves the other's rounds aside."""
        rows = [] if self.override else self._rows(f"{self.path}/fold-{fold}/rounds/*", ROUND)
        last = max(rows, key=lambda row: row["epoch"], default=None)
        return State(last["epoch"], last["weights"], last["mean"], last["losses"]) if last else None

    def save_round(self, fold: int, state: State) -> None:
        row = (self.setup, state.epoch, state.weights, state.mean, state.losses)
        self._put(f"{self.path}/fold-{fold}/rounds/after-{state.epoch}", ROUND, row)


def fit_log(model: PipelineModel | RbfModel, train: DataFrame) -> list[float]:
    """Loss by iteration, of models that learn in iterations."""
    if not isinstance(model, PipelineModel):
        return []
    last = model.stages[-1]
    if isinstance(last, GBTRegressionModel):
        for stage in model.stages[:-1]:
            train = stage.transform(train)
        return list(last.evaluateEachIteration(train, "squared"))
    if isinstance(last, LinearRegressionModel) and last.hasSummary:
        return list(last.summary.objectiveHistory)
    return []


def scores(preds: DataFrame) -> Row:
    return errors(preds).agg(F.count(F.lit(1)).alias("samples"), F.avg("se").alias("mse"), F.avg("ae").alias("mae"), pearson_r("y", "yhat").alias("r")).first()


def train_folds(
    df: DataFrame,
    splits: DataFrame,
    name: str,
    features: Sequence[str],
    folds: Sequence[int],
    path: str,
    override: bool = False,
    after: Callable[[int], None] | None = None,
    **params,
) -> tuple[DataFrame, DataFrame]:
    """``ml.cross_validate`` with a ledger below ``path``: (predictions, ledger).

    Folds that the ledger has are loaded, the others fitted, scored on their val rows, saved and entered one by one; mini-batch descents also
    go on inside a fold. Predictions: model, fold, sample_id, y, yhat. Ledger: model, fold, origin (loaded or fitted), version, samples,
    mse, mae, r, train_seconds, log (loss by iteration). ``after`` is called when a fold is entered. ``override`` trains all folds anew.
    """
    spark = df.sparkSession
    data = cut_lineage(df.select("sample_id", "y", *features).dropna())
    used = cut_lineage(splits.filter("role IN ('train', 'val')").select("sample_id", "fold", "role"))
    mark = lambda rows: str(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())
    setup = {"model": name, "features": list(features), "params": params, "data": mark(data), "splits": mark(used)}
    ledger = Ledger(spark, path, name, setup, override)
    preds, entries = None, []
    for fold in folds:
        own = used.filter(F.col("fold") == fold)
        val = data.join(own.filter("role = 'val'"), "sample_id", "left_semi")
        entry = ledger.fold(fold)
        model = ml.load_model(entry["version"]) if entry else None
        origin = "loaded" if entry else "fitted"
        if model is None:
            train = data.join(own.filter("role = 'train'"), "sample_id", "left_semi")
            begin, log = time.perf_counter(), None
            if name == "sgd":
                model, log = ml.fit_descent(train, features, resume=ledger.rounds(fold), save=lambda state, f=fold: ledger.save_round(f, state), **params)
            else:
                model = ml.fit(name, train, features, **params)
            seconds = time.perf_counter() - begin
            entry = ledger.finish(fold, model, scores(ml.predict(model, val)), seconds, fit_log(model, train) if log is None else log)
            if after is not None:
                after(fold)
        entries.append((origin, *entry))
        out = ml.predict(model, val).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "sample_id", "y", "yhat")
        preds = out if preds is None else preds.unionByName(out)
    table = spark.createDataFrame(entries, f"origin string, {FOLD}").drop("setup")
    return preds, table.select("model", "fold", "origin", "version", "samples", "mse", "mae", "r", "train_seconds", "log")
