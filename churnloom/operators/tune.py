"""Search of settings over folds, the report of all classifiers, and the choice between them."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.operators import metrics
from churnloom.operators.models import FitCache, ModelSpec
from churnloom.schema import ID_COLUMN
from churnloom.sources.storage import path_exists, write_text

FOLD_COLUMN = "fold"
# Fixed value: folds of the search.
SEARCH_FOLDS = 3
# Fits of a search between two writes of its log.
SEARCH_BATCH = 48


@dataclass(frozen=True)
class Candidate:
    """One setting of one classifier and its mean F1 over the folds, if searched."""

    model: str
    position: int
    settings: dict
    cv_f1: float | None


def _settings_key(settings: dict) -> str:
    return json.dumps(settings, sort_keys=True)


class ScoreLog:
    """Scores of a search, kept in the shared folder as they are found.

    A search that finds its log goes on where the last one ended, so a lost driver loses
    the fits of one batch. One small file for each batch; rows that were written twice are
    equal, as fits are seeded.
    """

    _SCHEMA = "model string, settings string, fold int, f1 double"

    def __init__(self, spark: SparkSession, uri: str | None):
        self.spark, self.uri = spark, uri
        self._found: dict[tuple[str, str, int], float] = {}
        if uri and path_exists(spark, uri):
            for row in spark.read.schema(self._SCHEMA).json(uri).collect():  # a row for each fit
                self._found[(row["model"], row["settings"], row["fold"])] = row["f1"]

    def get(self, model: str, settings: dict, fold: int) -> float | None:
        return self._found.get((model, _settings_key(settings), fold))

    def add(self, scores: list[tuple[str, dict, int, float]]) -> None:
        rows = [(m, _settings_key(s), fold, f1) for m, s, fold, f1 in scores]
        self._found |= {row[:3]: row[3] for row in rows}
        if self.uri and rows:
            lines = "".join(json.dumps(dict(zip(("model", "settings", "fold", "f1"), r))) + "\n" for r in rows)
            write_text(self.spark, f"{self.uri}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", lines)


def _held_out_f1(rows: DataFrame, model: Model, fold: int) -> float:
    """F1 of class 1 on the rows of one fold."""
    scored = model.transform(rows.where(F.col(FOLD_COLUMN) == fold))
    return metrics.threshold_metrics(scored).first()["f1_score"]


def search(
    cache: FitCache,
    spec: ModelSpec,
    folds: int = SEARCH_FOLDS,
    parallelism: int = 2,
    score_single: bool = False,
    log: ScoreLog | None = None,
    batch: int = SEARCH_BATCH,
) -> list[Candidate]:
    """Every setting of ``spec`` with its mean F1 of class 1 over the folds.

    ``cache.rows`` has a ``fold`` column. ``batch`` fits are made and scored before their scores
    are logged; boosters of a batch grow together. A grid of one setting needs no search,
    unless its score is asked for.
    """
    found = [Candidate(spec.name, i, s, None) for i, s in enumerate(spec.grid)]
    if len(found) == 1 and not score_single:
        return found
    rows, log = cache.rows, log or ScoreLog(cache.rows.sparkSession, None)
    tasks = [(c, fold) for c in found for fold in range(folds) if log.get(c.model, c.settings, fold) is None]
    score = inheritable_thread_target(rows.sparkSession)(lambda task: _held_out_f1(rows, *task))
    for at in range(0, len(tasks), batch):
        part = tasks[at : at + batch]
        fitted = cache.fits([(spec.build(**c.settings), (FOLD_COLUMN, fold)) for c, fold in part], parallelism)
        with ThreadPool(parallelism) as pool:
            scores = pool.map(score, [(m, fold) for m, (_, fold) in zip(fitted, part)], chunksize=1)
        log.add([(c.model, c.settings, fold, f1) for (c, fold), f1 in zip(part, scores)])
        cache.forget(fitted)
    return [
        replace(c, cv_f1=sum(log.get(c.model, c.settings, f) for f in range(folds)) / folds) for c in found
    ]


def grid_search(
    train: DataFrame | FitCache,
    spec: ModelSpec,
    folds: int = SEARCH_FOLDS,
    parallelism: int = 2,
    score_single: bool = False,
    log: ScoreLog | None = None,
) -> tuple[Model, list[Candidate]]:
    """The best setting by mean F1 of class 1, fitted on all rows, and every candidate.

    ``train`` has a ``fold`` column, which a plain filter reads; Spark's own validator
    would check it with a Python function on every row. ``parallelism`` fits run at a
    time. The first setting wins a tie.
    """
    cache = train if isinstance(train, FitCache) else FitCache(train)
    found = search(cache, spec, folds, parallelism, score_single, log)
    best = best_candidate(found)
    (fitted,) = cache.fits([(spec.build(**best.settings), None)], parallelism)
    return fitted, found


def best_candidate(candidates: list[Candidate]) -> Candidate:
    """Highest mean F1; the first in grid order wins a tie."""
    return max(
        candidates, key=lambda c: (-1.0 if c.cv_f1 is None else c.cv_f1, -c.position)
    )


def candidate_table(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    rows = [
        (c.model, c.position, json.dumps(c.settings, sort_keys=True), c.cv_f1) for c in candidates
    ]
    return spark.createDataFrame(rows, "model string, position int, settings string, cv_f1 double")


def predictions(model: Model, df: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """(key, label, prediction, score) of a fitted classifier."""
    return model.transform(df).select(
        key,
        F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def model_metrics(fitted: dict[str, Model], test: DataFrame) -> DataFrame:
    """Metrics of every model on the same rows, AUC on the hard labels; one row per model."""
    scored = None
    for position, (name, model) in enumerate(fitted.items()):
        rows = predictions(model, test).select(
            F.lit(position).alias("position"), F.lit(name).alias("model"), "label", "prediction"
        )
        scored = rows if scored is None else scored.unionByName(rows)
    return metrics.binary_metrics(scored, ["position", "model"], score="prediction")
