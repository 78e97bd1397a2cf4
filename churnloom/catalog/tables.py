"""Tables the named queries share, all derived from the given ``customer`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.functions.expressions import to_number
from churnloom.operators import clean, split
from churnloom.plans.ingest import ingest, parts
from churnloom.sources.derived import raw_customers, separable_target
from churnloom.sources.storage import materialize


def distinct_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_duplicate_rows(raw_customers(spark, sf_dir))


def patchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers with every kind of missing cell as null, and their split.

    Its readers scan it more than once, so it is written first.
    """
    table = clean.replace_missing_token(distinct_customers(spark, sf_dir))
    return materialize(split.holdout_split(clean.coerce_numeric(table)), "patchy", "split")


def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exploration's table: totals coerced, rows without a total dropped."""
    table = clean.coerce_numeric(raw_customers(spark, sf_dir))
    return clean.drop_incomplete_rows(table, ["TotalCharges"])


def ingested_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test as validation sees them, from the written store."""
    store = materialize(ingest(raw_customers(spark, sf_dir)), "store", "split")
    train, test = parts(store)
    return clean.coerce_numeric(train), clean.coerce_numeric(test)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with three scores computed from the columns, one row per customer and scorer."""
    table = split.holdout_split(clean.encode_target(distinct_customers(spark, sf_dir)))
    total = F.coalesce(to_number("TotalCharges"), F.lit(0.0))
    scorers = {
        "tenure": F.round(1 - F.col("tenure").cast("double") / 100, 2),
        "contract": F.when(F.col("Contract") == "Month-to-month", F.lit(0.75))
        .when(F.col("Contract") == "One year", F.lit(0.5))
        .otherwise(F.lit(0.25)),
        "total": 1 - F.least(total, F.lit(10000.0)) / 10000,
    }
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("model"), expr.alias("score")
            )
            for i, (name, expr) in enumerate(scorers.items())
        )
    )
    return table.select("customerID", "split", "label", F.inline(entries)).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int")
    )


def tenure_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("model = 'tenure'").drop("model", "position")


def separable_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test with a target that the features decide; missing numbers are kept.

    Both are read from one written table, so the customers are put together once.
    """
    table = clean.replace_missing_token(distinct_customers(spark, sf_dir))
    table = clean.coerce_numeric(table).withColumn("Churn", separable_target())
    return parts(materialize(split.holdout_split(table), "parts", "split"))
