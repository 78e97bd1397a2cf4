"""Named queries: one per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.catalog import tables
from churnloom.catalog.oracle import NUMERIC, ONE_HOT_COLUMNS
from churnloom.operators import clean, drift, metrics, ordered, profile, rules, split, weights
from churnloom.plans.ingest import clean_customers, ingest, schema_reports, validation_summary
from churnloom.schema import COLUMNS, CUSTOMER_RULES, NUMERIC_KINDS
from churnloom.sources import writers
from churnloom.sources.derived import raw_customers
from churnloom.sources.readers import invalid_cells, scan_csv, scan_table
from churnloom.sources.storage import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUMERIC_RULES = tuple(r for r in CUSTOMER_RULES if r.kind in NUMERIC_KINDS)
TEXT_RULES = tuple(r for r in CUSTOMER_RULES if r.kind not in NUMERIC_KINDS)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources and sinks ---------------------------------------------------------------


@query
def scan_customers(spark, sf_dir):
    return raw_customers(spark, sf_dir)


@query
def drop_system_columns(spark, sf_dir):
    documents = raw_customers(spark, sf_dir).withColumn("_id", F.md5("customerID"))
    return clean.drop_system_columns(documents)


@query
def scan_csv_(spark, sf_dir):
    path = scratch_path(spark, "customers-csv")
    writers.write_table(raw_customers(spark, sf_dir), path, "csv")
    return scan_csv(spark, path)


@query
def csv_invalid_cells(spark, sf_dir):
    """Cells of a CSV that are not of their declared type: every even tenure is written as a word."""
    path = scratch_path(spark, "bad-csv")
    word = F.when(F.col("tenure") % 2 == 0, F.lit("many")).otherwise(F.col("tenure").cast("string"))
    writers.write_table(raw_customers(spark, sf_dir).withColumn("tenure", word), path, "csv")
    return invalid_cells(spark, path)


@query
def to_json_records(spark, sf_dir):
    records = writers.to_json_records(raw_customers(spark, sf_dir))
    return records.select(
        *(F.get_json_object("record", f"$.{name}").alias(name) for name in COLUMNS)
    ).withColumns(
        {
            "SeniorCitizen": F.col("SeniorCitizen").cast("int"),
            "tenure": F.col("tenure").cast("int"),
            "MonthlyCharges": F.col("MonthlyCharges").cast("double"),
        }
    )


@query
def append_records(spark, sf_dir):
    """Two appends of the same rows, as a loader that is run twice."""
    path = scratch_path(spark, "collection")
    raw = raw_customers(spark, sf_dir)
    writers.append_records(raw, path)
    writers.append_records(raw, path)
    return scan_table(spark, path)


@query
def write_feature_store(spark, sf_dir):
    paths = writers.write_feature_store(
        ingest(raw_customers(spark, sf_dir)), scratch_path(spark, "run")
    )
    return scan_table(spark, paths["feature_store"])


@query
def route_by_validity(spark, sf_dir):
    train, test = tables.ingested_parts(spark, sf_dir)
    status = rules.combined_status(schema_reports(train, test))
    passed = rules.report_passed(status)
    paths = writers.route_by_validity(train, test, passed, scratch_path(spark, "run"))
    routed = [
        scan_table(spark, path).select(
            F.lit(name).alias("split"),
            F.lit("valid" if passed else "invalid").alias("routed_to"),
            "customerID",
        )
        for name, path in paths.items()
    ]
    return routed[0].unionByName(routed[1])


# --- cleaning ------------------------------------------------------------------------


@query
def replace_na_token(spark, sf_dir):
    return clean.replace_missing_token(raw_customers(spark, sf_dir))


@query
def dropna_any(spark, sf_dir):
    return clean.drop_incomplete_rows(
        clean.replace_missing_token(raw_customers(spark, sf_dir))
    )


@query
def dropna_subset(spark, sf_dir):
    return tables.explored(spark, sf_dir)


@query
def coerce_numeric(spark, sf_dir):
    return clean.coerce_numeric(raw_customers(spark, sf_dir))


@query
def split_target(spark, sf_dir):
    cleaned = materialize(clean_customers(raw_customers(spark, sf_dir)), "cleaned")
    features, target = clean.split_target(cleaned, key="customerID")
    return features.join(target.withColumnRenamed("Churn", "target"), "customerID")


@query
def columns_by_type(spark, sf_dir):
    table = tables.patchy(spark, sf_dir).drop("split")
    numeric, categorical = clean.columns_by_type(table, id_columns=["customerID"])
    return (
        clean.null_counts(table.select(*numeric, *categorical))
        .withColumn(
            "kind", F.when(F.col("column").isin(numeric), "numeric").otherwise("categorical")
        )
    )


@query
def binary_encode(spark, sf_dir):
    return clean.encode_flags(tables.explored(spark, sf_dir)).select(
        "customerID", "gender", "Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn"
    )


@query
def encode_target(spark, sf_dir):
    return clean.encode_target(raw_customers(spark, sf_dir)).select("customerID", "Churn", "label")


@query
def fill_median(spark, sf_dir):
    return clean.fill_median(tables.patchy(spark, sf_dir), NUMERIC).select("customerID", *NUMERIC)


@query
def fill_mode(spark, sf_dir):
    names = list(ONE_HOT_COLUMNS)
    return clean.fill_mode(tables.patchy(spark, sf_dir), names).select("customerID", *names)


@query
def null_counts(spark, sf_dir):
    return clean.null_counts(
        clean.coerce_numeric(clean.replace_missing_token(raw_customers(spark, sf_dir)))
    )


# --- aggregations --------------------------------------------------------------------


@query
def drop_duplicates(spark, sf_dir):
    return tables.distinct_customers(spark, sf_dir)


@query
def duplicate_count(spark, sf_dir):
    return clean.duplicate_count(raw_customers(spark, sf_dir))


@query
def table_profile(spark, sf_dir):
    return profile.table_profile(raw_customers(spark, sf_dir))


@query
def churn_counts(spark, sf_dir):
    return profile.group_counts(tables.explored(spark, sf_dir), "Churn")


@query
def contract_by_churn(spark, sf_dir):
    return profile.group_counts(tables.explored(spark, sf_dir), "Contract", "Churn")


_BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query
def box_monthly_by_churn(spark, sf_dir):
    return rounded(profile.box_summary(tables.explored(spark, sf_dir), "MonthlyCharges"), *_BOX)


@query
def box_total_by_churn(spark, sf_dir):
    return rounded(profile.box_summary(tables.explored(spark, sf_dir), "TotalCharges"), *_BOX)


@query
def tenure_histogram(spark, sf_dir):
    return rounded(profile.histogram(tables.explored(spark, sf_dir)), "bin_start", "bin_end")


@query
def tenure_density(spark, sf_dir):
    return rounded(profile.density(tables.explored(spark, sf_dir)), "x", "density", "height")


@query
def scale_pos_weight(spark, sf_dir):
    return rounded(
        weights.scale_pos_weight(clean.encode_target(tables.distinct_customers(spark, sf_dir))),
        "scale_pos_weight",
    )


@query
def balanced_weights(spark, sf_dir):
    return rounded(
        weights.with_balanced_weights(
            clean.encode_target(tables.distinct_customers(spark, sf_dir))
        ).select("customerID", "label", "weight"),
        "weight",
    )


@query
def prefix_sum(spark, sf_dir):
    """Running number of orders by price within each priority, over all orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return ordered.prefix_sum(orders, "o_totalprice", ["o_orderpriority"])


@query
def grouped_quantiles(spark, sf_dir):
    """Exact quartiles of the line price per return flag, over all line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(
        ordered.grouped_quantiles(
            items, "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["l_returnflag"]
        ),
        "q1",
        "median",
        "q3",
    )


# --- splits --------------------------------------------------------------------------


@query
def holdout_split(spark, sf_dir):
    return split.holdout_split(tables.distinct_customers(spark, sf_dir)).select(
        "customerID", "split"
    )


@query
def holdout_split_exact(spark, sf_dir):
    return split.holdout_split_exact(
        tables.distinct_customers(spark, sf_dir).select("customerID")
    )


@query
def hash_folds(spark, sf_dir):
    return split.hash_folds(tables.distinct_customers(spark, sf_dir)).select("customerID", "fold")


@query
def stratified_folds(spark, sf_dir):
    return split.stratified_folds(
        tables.distinct_customers(spark, sf_dir).select("customerID", "Churn")
    )


# --- validation ----------------------------------------------------------------------


@query
def validate_schema(spark, sf_dir):
    return rules.schema_report(raw_customers(spark, sf_dir), check_ranges=False)


@query
def validate_ranges(spark, sf_dir):
    report = rules.schema_report(clean.coerce_numeric(raw_customers(spark, sf_dir)), NUMERIC_RULES)
    return report.where(F.col("rule").isin("min", "max")).select(
        "column",
        "rule",
        F.col("expected").cast("double").alias("expected"),
        F.col("observed").cast("double").alias("observed"),
        "passed",
    )


@query
def validate_domains(spark, sf_dir):
    report = rules.schema_report(
        raw_customers(spark, sf_dir), TEXT_RULES, check_ranges=False, check_allowed=True
    )
    return report.where("rule = 'allowed'")


@query
def validation_status(spark, sf_dir):
    train, test = tables.ingested_parts(spark, sf_dir)
    return rules.combined_status(schema_reports(train, test))


# --- drift ---------------------------------------------------------------------------


def _patchy_parts(spark, sf_dir):
    table = tables.patchy(spark, sf_dir)
    return table.where("split = 'train'"), table.where("split = 'test'")


@query
def drift_fill(spark, sf_dir):
    return rounded(drift.drift_fill(*_patchy_parts(spark, sf_dir)), "fill_number")


@query
def ks_numeric(spark, sf_dir):
    return rounded(
        drift.ks_statistics(*_patchy_parts(spark, sf_dir), NUMERIC_RULES), "ks_statistic"
    )


@query
def ks_categorical(spark, sf_dir):
    return rounded(drift.ks_statistics(*_patchy_parts(spark, sf_dir), TEXT_RULES), "ks_statistic")


@query
def drift_report(spark, sf_dir):
    return rounded(
        drift.drift_report(*tables.ingested_parts(spark, sf_dir)), "ks_statistic", "p_value"
    )


@query
def drift_report_shifted(spark, sf_dir):
    """The whole table against itself with dearer months and one contract kind."""
    table = tables.patchy(spark, sf_dir)
    shifted = table.withColumns(
        {"MonthlyCharges": F.col("MonthlyCharges") + 50, "Contract": F.lit("Two year")}
    )
    return rounded(drift.drift_report(table, shifted), "ks_statistic", "p_value")


@query
def drift_overall(spark, sf_dir):
    return drift.drift_overall(drift.drift_report(*tables.ingested_parts(spark, sf_dir)))


@query
def retrain_decision(spark, sf_dir):
    """The decision with a published model, after the drift check."""
    overall = drift.drift_overall(drift.drift_report(*tables.ingested_parts(spark, sf_dir)))
    return drift.retrain_decision(overall, model_exists=True)


# --- metrics -------------------------------------------------------------------------

_RATES = ("accuracy", "precision", "recall", "f1_score")


@query
def binary_metrics(spark, sf_dir):
    return rounded(
        metrics.binary_metrics(tables.scored(spark, sf_dir), ["model"]), *_RATES, "roc_auc"
    )


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(tables.tenure_scored(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(tables.scored(spark, sf_dir), ["model"]), "roc_auc")


@query
def roc_auc_hard(spark, sf_dir):
    return rounded(
        metrics.roc_auc(tables.scored(spark, sf_dir), ["model"], score="prediction"), "roc_auc"
    )


@query
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(tables.scored(spark, sf_dir), ["model"]), "fpr", "tpr")


@query
def roc_area(spark, sf_dir):
    return rounded(metrics.roc_area(tables.scored(spark, sf_dir), ["model"]), "area")


@query
def pr_curve(spark, sf_dir):
    return rounded(
        metrics.pr_curve(tables.scored(spark, sf_dir), ["model"]), "precision", "recall"
    )


@query
def metrics_by_split(spark, sf_dir):
    return rounded(
        metrics.binary_metrics(tables.tenure_scored(spark, sf_dir), ["split"]), *_RATES, "roc_auc"
    )


@query
def best_model(spark, sf_dir):
    """The best of the column scorers by F1 on the test part."""
    test = tables.scored(spark, sf_dir).where("split = 'test'")
    report = metrics.threshold_metrics(test, ["position", "model"])
    return rounded(metrics.pick_best(report), *_RATES)


# --- jobs ----------------------------------------------------------------------------


@query
def ingest_(spark, sf_dir):
    return ingest(raw_customers(spark, sf_dir))


@query
def validate_(spark, sf_dir):
    return validation_summary(*tables.ingested_parts(spark, sf_dir))
