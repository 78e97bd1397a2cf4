"""Named queries that fit or use models. Importing the module registers them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.catalog import tables
from churnloom.catalog.oracle import NUMERIC, ONE_HOT_COLUMNS
from churnloom.catalog.queries import query, rounded
from churnloom.operators import clean, features, models, score, tune
from churnloom.operators.impute import KNNImputer, ModeImputer, Standardizer
from churnloom.operators.metrics import binary_metrics
from churnloom.plans import eda
from churnloom.plans import train as jobs
from churnloom.schema import FEATURES
from churnloom.sources import writers
from churnloom.sources.derived import raw_customers
from churnloom.sources.readers import json_records, scan_csv
from churnloom.sources.storage import generation, materialize, scratch_path
from churnloom.streaming.scoring import score_stream as start_score_stream

TEXT = list(ONE_HOT_COLUMNS)
_RATES = ("accuracy", "precision", "recall", "f1_score", "roc_auc")

# Feature tables and fitted classifiers by application, folder and kind: the queries below
# share them as a model run shares its written tables.
_SHARED: dict[tuple, object] = {}


def _shared(spark: SparkSession, sf_dir: str, kind: str, build):
    now = (spark.sparkContext.applicationId, generation())
    for key in [k for k in _SHARED if k[:2] != now]:
        del _SHARED[key]  # what refers to dropped scratch is void
    key = (*now, sf_dir, kind)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _shared(spark, sf_dir, "parts", lambda: tables.separable_parts(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str) -> jobs.Prepared:
    return _shared(
        spark, sf_dir, "prepared", lambda: jobs.transform(*_parts(spark, sf_dir))
    )


def _model(spark: SparkSession, sf_dir: str):
    """A whole model with a boosted classifier."""

    def build():
        prepared = _prepared(spark, sf_dir)
        settings = models.BASE_SETTINGS["gradient_boosting"]
        fitted = models.gradient_boosting(**settings).fit(prepared.train)
        return jobs.assemble_model(prepared, fitted)

    return _shared(spark, sf_dir, "model", build)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as scoring input."""
    train, test = _parts(spark, sf_dir)
    return train.unionByName(test).select(*FEATURES)


# --- preprocessing -------------------------------------------------------------------


def _fit_part(spark, sf_dir):
    table = tables.patchy(spark, sf_dir)
    return table.where("split = 'train'"), table


@query
def knn_impute(spark, sf_dir):
    train, table = _fit_part(spark, sf_dir)
    filled = KNNImputer(inputCols=NUMERIC).fit(train).transform(table)
    return rounded(filled.select("customerID", *NUMERIC), "MonthlyCharges", "TotalCharges")


@query
def mode_impute(spark, sf_dir):
    train, table = _fit_part(spark, sf_dir)
    return ModeImputer(inputCols=TEXT).fit(train).transform(table).select("customerID", *TEXT)


@query
def standardize(spark, sf_dir):
    train, table = _fit_part(spark, sf_dir)
    scaled = Standardizer(inputCols=NUMERIC).fit(train).transform(table)
    return rounded(scaled.select("customerID", *NUMERIC), *NUMERIC)


@query
def one_hot(spark, sf_dir):
    train, table = _fit_part(spark, sf_dir)
    names = list(ONE_HOT_COLUMNS)
    stages = [
        features.CategoryIndexer(inputCols=names, outputCols=[f"{c}_index" for c in names]),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in names], outputCols=[f"{c}_onehot" for c in names]
        ),
    ]
    encoded = Pipeline(stages=stages).fit(train).transform(table)
    return encoded.select(
        "customerID",
        *(
            vector_to_array(f"{c}_onehot")[i].alias(f"{c}_{i}")
            for c, values in ONE_HOT_COLUMNS.items()
            for i in range(len(values))
        ),
    )


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        train, _ = _parts(spark, sf_dir)
        labeled = clean.encode_target(train).withColumn("label", F.col("label").cast("double"))
        numeric, categorical = clean.columns_by_type(train, id_columns=["customerID"])
        stages = Pipeline(stages=features.encoding_stages(numeric, categorical))
        encoded = stages.fit(labeled).transform(labeled)
        return materialize(encoded.select("customerID", "label", features.ALL_FEATURES), "encoded")

    return _shared(spark, sf_dir, "encoded", build)


def _vector_rows(df: DataFrame, column: str) -> DataFrame:
    return df.select(
        "customerID", "label", F.transform(vector_to_array(column), lambda v: F.round(v, 6)).alias(column)
    )


@query
def assemble_features(spark, sf_dir):
    """Every slot of every training row's vector, by slot number."""
    slots = F.posexplode(vector_to_array(features.ALL_FEATURES)).alias("position", "value")
    return rounded(_encoded(spark, sf_dir).select("customerID", slots), "value")


@query
def feature_names(spark, sf_dir):
    """Slot names in order, and how many training rows fill each slot."""
    encoded = _encoded(spark, sf_dir)
    names = features.feature_names(encoded, features.ALL_FEATURES)
    slots = F.posexplode(vector_to_array(features.ALL_FEATURES)).alias("position", "value")
    return (
        encoded.select(slots)
        .groupBy("position")
        .agg(F.count_if(F.abs("value") > 1e-9).alias("n_filled"))
        .withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("position") + 1))
    )


@query
def select_features(spark, sf_dir):
    encoded = _encoded(spark, sf_dir)
    return _vector_rows(features.ForestSelector().fit(encoded).transform(encoded), "features")


@query
def features_table(spark, sf_dir):
    """Written and read back feature vectors with their labels."""
    prepared = _prepared(spark, sf_dir)
    path = scratch_path(spark, "features")
    both = prepared.train.select("customerID", "label", "features").unionByName(
        prepared.test.select("customerID", "label", "features")
    )
    writers.write_table(both, path)
    return _vector_rows(spark.read.parquet(path), "features")


@query
def transform(spark, sf_dir):
    prepared = jobs.transform(*_parts(spark, sf_dir))
    both = prepared.train.select("customerID", "label", "features", F.lit("train").alias("split"))
    other = prepared.test.select("customerID", "label", "features", F.lit("test").alias("split"))
    rows = both.unionByName(other)
    return rows.withColumn("features", vector_to_array("features"))


# --- classifiers ---------------------------------------------------------------------


def _classifier(name: str, build, settings: dict):
    """Predictions for the test part by a classifier at its base settings."""

    def run(spark, sf_dir):
        prepared = _prepared(spark, sf_dir)
        fitted = build(**settings).fit(prepared.train)
        return tune.predictions(fitted, prepared.test).drop("score").withColumn("model", F.lit(name))

    run.__name__ = f"model_{name}"
    return query(run)


_classifier("random_forest", models.random_forest, models.BASE_SETTINGS["random_forest"])
_classifier("gbt", models.gradient_boosting, models.BASE_SETTINGS["gradient_boosting"])
_classifier("adaboost", models.ada_boost, models.BASE_SETTINGS["ada_boost"])
_classifier("decision_tree", models.decision_tree, models.BASE_SETTINGS["decision_tree"])
_classifier("weighted_gbt", models.weighted_boosting, models.BASE_SETTINGS["weighted_boosting"])
_classifier("stacking", models.stacking, {"settings": models.BASE_SETTINGS, "folds": 5})


@query
def grid_search(spark, sf_dir):
    """Every setting of the single tree by mean F1 over three folds."""
    spec = next(s for s in models.full_specs() if s.name == "decision_tree")
    _, found = tune.grid_search(_prepared(spark, sf_dir).train, spec, parallelism=4)
    return rounded(tune.candidate_table(spark, found), "cv_f1")


def _trained(spark, sf_dir) -> jobs.Trained:
    """All classifiers at the best settings of the whole search."""
    return _shared(
        spark,
        sf_dir,
        "trained",
        lambda: jobs.train(_prepared(spark, sf_dir), models.full_specs()),
    )


@query
def model_report(spark, sf_dir):
    return rounded(_trained(spark, sf_dir).report, *_RATES)


@query
def refit_best(spark, sf_dir):
    """Test predictions of the chosen classifier, fitted on all training rows."""
    trained = _trained(spark, sf_dir)
    return tune.predictions(trained.best, _prepared(spark, sf_dir).test).drop("score")


@query
def train(spark, sf_dir):
    """Train and test metrics of the chosen classifier."""
    trained = _trained(spark, sf_dir)
    return rounded(jobs.metrics_of_best(trained, _prepared(spark, sf_dir)), *_RATES)


@query
def run_metrics(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    measured = jobs.metrics_of_best(trained, _prepared(spark, sf_dir))
    return rounded(jobs.run_metrics("run-1", measured, trained), "value").where(
        "split <> 'setting'"
    ).drop("model", "text")


@query
def top_features(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    forest = models.random_forest(**models.BASE_SETTINGS["random_forest"]).fit(prepared.train)
    importance = features.importance_table(
        spark, features.feature_names(prepared.train), forest.featureImportances.toArray()
    )
    return rounded(features.top_features(importance), "importance")


# --- scoring -------------------------------------------------------------------------


@query
def check_features(spark, sf_dir):
    """The input contract on a table that lacks one column and has two others."""
    return score.column_status(tables.patchy(spark, sf_dir).drop("tenure"), FEATURES)


@query
def expected_features(spark, sf_dir):
    """The features that the fitted model asks for, and how many customers have each."""
    records = _records(spark, sf_dir)
    filled = records.agg(*(F.count(c).alias(c) for c in FEATURES))
    counts = filled.unpivot([], FEATURES, "feature", "n_filled")
    return score.expected_feature_table(spark, _model(spark, sf_dir)).join(counts, "feature")


@query
def score_records(spark, sf_dir):
    return score.score(_model(spark, sf_dir), _records(spark, sf_dir)).drop("probability")


@query
def score_request_records(spark, sf_dir):
    """All customers as JSON request records, turned into a table again and scored."""
    lines = writers.to_json_records(_records(spark, sf_dir))
    return score.score(_model(spark, sf_dir), json_records(lines)).drop("probability")


@query
def prediction_preview(spark, sf_dir):
    scored = score.score(_model(spark, sf_dir), _records(spark, sf_dir))
    return score.preview(scored).drop("probability")


@query
def score_csv(spark, sf_dir):
    """Customers written as CSV, read back and scored into a table."""
    path = scratch_path(spark, "scoring-csv")
    writers.write_table(
        _records(spark, sf_dir).withColumn("TotalCharges", F.col("TotalCharges").cast("string")),
        path,
        "csv",
    )
    scored = score.score(_model(spark, sf_dir), scan_csv(spark, path))
    return writers.write_table(scored, scratch_path(spark, "scored")).drop("probability")


@query
def score_stream(spark, sf_dir):
    """Customers arriving as JSON files, scored by a stream until none is left."""
    source, sink = scratch_path(spark, "arrivals"), scratch_path(spark, "scored-stream")
    records = _records(spark, sf_dir)
    records.withColumn("TotalCharges", F.col("TotalCharges").cast("string")).write.json(source)
    stream = start_score_stream(
        spark,
        _model(spark, sf_dir),
        source,
        sink,
        scratch_path(spark, "stream-checkpoint"),
    )
    stream.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id", "probability")


@query
def model_roundtrip(spark, sf_dir):
    """Scores of a model that was saved and loaded."""
    uri = jobs.publish(_model(spark, sf_dir), scratch_path(spark, "model"))
    return score.score(jobs.load_model(uri), _records(spark, sf_dir)).drop("probability")


@query
def publish_model(spark, sf_dir):
    """Publishing twice to one place: the second model replaces the first and scores."""
    uri = scratch_path(spark, "final-model")
    prepared = _prepared(spark, sf_dir)
    tree = models.decision_tree(**models.BASE_SETTINGS["decision_tree"]).fit(prepared.train)
    jobs.publish(_model(spark, sf_dir), uri)
    jobs.publish(jobs.assemble_model(prepared, tree), uri)
    found = jobs.find_model(spark, [scratch_path(spark, "nothing"), uri])
    scored = score.score(jobs.load_model(found), _records(spark, sf_dir))
    return scored.groupBy("prediction").agg(F.count("*").alias("n"))


# --- whole jobs ----------------------------------------------------------------------

@query
def gated_run(spark, sf_dir):
    """Two runs on the same data: the first has no model and trains, the second meets its model."""
    uri = scratch_path(spark, "published")
    turns = None
    for turn in (1, 2):
        done = jobs.run(
            raw_customers(spark, sf_dir), [uri], scratch_path(spark, "run"), models.base_specs()
        )
        row = done.decision.select(
            F.lit(turn).alias("turn"),
            "decision",
            "reason",
            F.lit(done.validation.schema_ok).alias("schema_ok"),
            F.lit(done.validation.drift_found).alias("drift_found"),
            F.lit(done.model_uri is not None).alias("published"),
        )
        turns = row if turns is None else turns.unionByName(row)
    return turns


@query
def forced_run(spark, sf_dir):
    """Metrics of a run that trains whatever the gate says."""
    done = jobs.run(
        raw_customers(spark, sf_dir),
        [scratch_path(spark, "published")],
        scratch_path(spark, "run"),
        models.base_specs(),
        force=True,
        run_id="forced",
    )
    # The counts of both parts: rows and positives are the data's, whatever the fit.
    counts = done.metrics.where("metric in ('tn', 'fp', 'fn', 'tp')")
    return counts.groupBy("run_id", "split").agg(
        F.sum("value").alias("n_rows"),
        F.sum(F.when(F.col("metric").isin("fn", "tp"), F.col("value"))).alias("n_positive"),
    )


@query
def eda_report(spark, sf_dir):
    return rounded(eda.eda_report(raw_customers(spark, sf_dir)), "value")
