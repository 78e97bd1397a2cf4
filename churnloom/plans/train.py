"""Transform, train, publish, and the gated run over all steps."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.operators import clean, drift, metrics, split, weights
from churnloom.operators.features import (
    SELECTOR_DEPTH,
    SELECTOR_TREES,
    preprocessing,
)
from churnloom.operators.models import (
    BALANCED,
    POSITIVE_WEIGHT,
    FitCache,
    ModelSpec,
    StackingClassifier,
    full_specs,
    with_stack_folds,
)
from churnloom.operators.score import InputContract
from churnloom.operators.tune import (
    FOLD_COLUMN,
    SEARCH_FOLDS,
    ScoreLog,
    best_candidate,
    candidate_table,
    model_metrics,
    predictions,
    search,
)
from churnloom.plans.ingest import Validation, ingest, parts, validate
from churnloom.schema import ID_COLUMN, TARGET
from churnloom.sources.storage import list_names, materialize, write_text
from churnloom.sources.writers import route_by_validity, write_feature_store, write_report

_LOG = logging.getLogger(__name__)

# The score a model should reach, and the gaps that would mean a misfit.
# They are reported with a run; nothing is refused because of them.
EXPECTED_SCORE = 0.7
FIT_GAP = 0.05


@dataclass(frozen=True)
class Prepared:
    """Feature tables of both parts, and the fitted preprocessing."""

    train: DataFrame
    test: DataFrame
    preprocessor: PipelineModel
    inputs: list[str]


def transform(
    train: DataFrame,
    test: DataFrame,
    target: str = TARGET,
    key: str = ID_COLUMN,
    selector_trees: int = SELECTOR_TREES,
    selector_depth: int = SELECTOR_DEPTH,
    id_columns: Sequence[str] = (),
) -> Prepared:
    """Fit the preprocessing on train and write both parts as (key, label, weights, features).

    The key and other id columns are never encoded: one slot per customer would only
    memorise the table.
    """
    for part in (train, test):
        clean.split_target(part, target)
    numeric, categorical = clean.columns_by_type(
        clean.coerce_numeric(train), target, [key, *id_columns]
    )
    inputs = [c for c in train.columns if c != target]

    def labeled(part: DataFrame) -> DataFrame:
        code = clean.encode_target(part, target, "label")
        return code.withColumn("label", F.col("label").cast("double")).drop(target)

    fitted = preprocessing(
        numeric, categorical, selector_trees=selector_trees, selector_depth=selector_depth
    ).fit(labeled(train))
    # Both parts go through together: one neighbour search, one written table.
    both = labeled(train.withColumn("split", F.lit("train"))).unionByName(
        labeled(test.withColumn("split", F.lit("test")))
    )
    # Each row's fold is written with it, so a fit on some folds opens only their folders.
    rows = fitted.transform(both).select(key, "split", "label", "features")
    folded = split.hash_folds(rows, SEARCH_FOLDS, key, output=FOLD_COLUMN)
    done = materialize(folded, "features", ["split", FOLD_COLUMN])
    train_done, test_done = parts(done)
    test_done = test_done.drop(FOLD_COLUMN)
    train_done = weights.with_balanced_weights(train_done, "label", BALANCED)
    train_done = weights.with_positive_weight(train_done, "label", POSITIVE_WEIGHT)
    return Prepared(train_done, test_done, fitted, inputs)


@dataclass(frozen=True)
class Trained:
    """All fitted classifiers, their report, and the chosen one."""

    report: DataFrame
    candidates: DataFrame
    models: dict[str, Model]
    best_name: str
    best_settings: dict

    @property
    def best(self) -> Model:
        return self.models[self.best_name]


def train(
    prepared: Prepared,
    specs: Sequence[ModelSpec] | None = None,
    select_on: str = "test",
    parallelism: int = 6,
    search_uri: str | None = None,
) -> Trained:
    """Search, fit and compare the classifiers; the first highest F1 wins.

    ``specs`` defaults to the whole search. ``select_on`` is ``test`` (F1 on the test part, which is
    then an optimistic estimate) or ``cv`` (mean F1 over the folds). Scores of the search are logged
    below ``search_uri``; another call on the same data goes on from there.
    """
    specs = list(full_specs() if specs is None else specs)
    cache = FitCache(with_stack_folds(prepared.train))
    log = ScoreLog(cache.rows.sparkSession, search_uri)
    tried = {s.name: search(cache, s, parallelism=parallelism, score_single=select_on == "cv", log=log) for s in specs}
    chosen = [best_candidate(tried[s.name]) for s in specs]
    # All that is still to fit, with the parts of a stack, goes through the cache at once.
    best_of = {s.name: s.build(**c.settings) for s, c in zip(specs, chosen)}
    wanted = [(e, None) for e in best_of.values() if not isinstance(e, StackingClassifier)]
    for stack in best_of.values():
        if isinstance(stack, StackingClassifier):
            wanted += [w for w in stack.wanted() if not w[1] or w[1][0] in cache.rows.columns]
    cache.fits(wanted, parallelism)
    models = dict(zip(best_of, cache.fits([(e, None) for e in best_of.values()], parallelism)))
    spark = prepared.train.sparkSession
    settings = candidate_table(spark, chosen).select("model", F.col("settings").alias("best_params"), "cv_f1")
    # One row per classifier on both sides.
    report = materialize(
        model_metrics(models, prepared.test).join(settings, "model"), "model-report"
    )
    by = "cv_f1" if select_on == "cv" else "f1_score"
    best_name = metrics.pick_best(report, by).first()["model"]
    best = next(c for c in chosen if c.model == best_name)
    every = [c for found in tried.values() for c in found]
    return Trained(report, candidate_table(spark, every), models, best_name, best.settings)


def metrics_of_best(trained: Trained, prepared: Prepared) -> DataFrame:
    """Train and test metrics of the chosen classifier, AUC on probabilities."""
    scored = None
    for name, part in (("train", prepared.train), ("test", prepared.test)):
        rows = predictions(trained.best, part).withColumn("split", F.lit(name))
        scored = rows if scored is None else scored.unionByName(rows)
    return metrics.binary_metrics(scored, ["split"])


def run_metrics(run_id: str, measured: DataFrame, trained: Trained) -> DataFrame:
    """Metrics and settings of a run as rows: run_id, model, split, metric, value and text.

    A setting that is no number, such as an impurity or the settings of a stack's parts, has its
    JSON in ``text``.
    """
    names = [c for c in measured.columns if c != "split"]
    values = measured.select(
        "split", *(F.col(c).cast("double").alias(c) for c in names)
    ).unpivot(["split"], names, "metric", "value")
    fixed = {"expected_score": EXPECTED_SCORE, "fit_gap": FIT_GAP, **trained.best_settings}
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    text = lambda v: None if isinstance(v, (int, float)) else json.dumps(v, sort_keys=True)
    settings = measured.sparkSession.createDataFrame(
        [("setting", k, number(v), text(v)) for k, v in fixed.items()],
        "split string, metric string, value double, text string",
    )
    return values.withColumn("text", F.lit(None).cast("string")).unionByName(settings).select(
        F.lit(run_id).alias("run_id"),
        F.lit(trained.best_name).alias("model"),
        "split",
        "metric",
        "value",
        "text",
    )


def assemble_model(prepared: Prepared, classifier: Model) -> PipelineModel:
    """Input contract, preprocessing and classifier as one model for raw records."""
    return PipelineModel(
        [InputContract(expected=prepared.inputs), *prepared.preprocessor.stages, classifier]
    )


def publish(model: PipelineModel, uri: str) -> str:
    """Write a model below ``uri`` as a new version, then make it the current one.

    The version in use is never touched: a model that was loaded from here, and reads its
    tables from there, can be published to the same place, and a publish that fails half-way
    leaves the former model in force. The pointer is a small file of its own for each version;
    the last one that is complete counts.
    """
    root = uri.rstrip("/")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    model.write().save(f"{root}/versions/{version}")
    write_text(SparkSession.active(), f"{root}/current/{version}", version)
    return uri


def current_version(spark: SparkSession, uri: str) -> str | None:
    """Folder of the model in force at ``uri``; a version without pointer does not count."""
    root = uri.rstrip("/")
    names = list_names(spark, f"{root}/current")
    return f"{root}/versions/{max(names)}" if names else None


def load_model(uri: str) -> PipelineModel:
    found = current_version(SparkSession.active(), uri)
    if found is None:
        raise ValueError(f"no model is published at {uri}")
    return PipelineModel.load(found)


def find_model(spark: SparkSession, uris: Sequence[str]) -> str | None:
    """The first location that holds a model; one that cannot be reached is logged and passed over."""
    for uri in uris:
        try:
            if current_version(spark, uri):
                return uri
        except Exception as error:  # noqa: BLE001 - any storage failure means: look in the next place
            _LOG.warning("%s cannot be reached: %s", uri, error)
    return None


@dataclass(frozen=True)
class Run:
    """What a run did; model parts are None when it trained nothing."""

    decision: DataFrame
    validation: Validation
    paths: dict[str, str]
    trained: Trained | None = None
    metrics: DataFrame | None = None
    model_uri: str | None = None


def run(
    raw: DataFrame,
    model_uris: Sequence[str],
    run_uri: str,
    specs: Sequence[ModelSpec] | None = None,
    force: bool = False,
    selector_trees: int = SELECTOR_TREES,
    selector_depth: int = SELECTOR_DEPTH,
    run_id: str | None = None,
    id_columns: Sequence[str] = (),
) -> Run:
    """Ingest, validate, decide, transform, train and publish.

    Trains if no model is published, if the data drifted, or if forced. Drift alone
    does not stop training, since drift is the reason to train; a failed schema does.
    What the run finds is kept below ``run_uri``.
    """
    spark = raw.sparkSession
    run_id = run_id or run_uri.rstrip("/").rsplit("/", 1)[-1]
    paths = write_feature_store(ingest(clean.require_rows(raw)), run_uri)
    store = spark.read.parquet(paths["feature_store"])
    train_part, test_part = (clean.coerce_numeric(p) for p in parts(store))
    checked = validate(train_part, test_part)
    paths |= route_by_validity(train_part, test_part, checked.passed, run_uri)
    known = find_model(spark, model_uris) is not None
    decision = drift.retrain_decision(drift.drift_overall(checked.drift), known, force)
    write_report(checked.schema, f"{run_uri}/schema_report")
    write_report(checked.drift, f"{run_uri}/drift_report")
    if not checked.schema_ok:
        raise ValueError(f"the data breaks its schema; see {paths}")
    if decision.first()["decision"] == "skip":
        return Run(decision, checked, paths)
    prepared = transform(
        spark.read.parquet(paths["train"]),
        spark.read.parquet(paths["test"]),
        selector_trees=selector_trees,
        selector_depth=selector_depth,
        id_columns=id_columns,
    )
    trained = train(prepared, specs, search_uri=f"{run_uri}/search")
    measured = run_metrics(run_id, metrics_of_best(trained, prepared), trained)
    measured.write.mode("append").parquet(f"{run_uri}/metrics")
    write_report(trained.report, f"{run_uri}/model_report")
    write_report(
        prepared.train.select(vector_to_array("features").alias("features")).limit(5),
        f"{run_uri}/input_example",
    )
    uri = publish(assemble_model(prepared, trained.best), model_uris[0])
    return Run(
        decision, checked, paths, trained, spark.read.parquet(f"{run_uri}/metrics"), uri
    )
