"""Ingest and validate jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.operators import clean, drift, rules, split
from churnloom.schema import CUSTOMER_RULES, ID_COLUMN, ColumnRule
from churnloom.sources.storage import materialize


def clean_customers(raw: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Raw customer rows to complete, distinct rows.

    Duplicates go first, then missing tokens become null and rows with a missing
    cell go. A blank total is text and stays until it is coerced.
    """
    table = clean.drop_system_columns(raw)
    table = clean.drop_duplicate_rows(table)
    table = clean.replace_missing_token(table)
    return clean.drop_incomplete_rows(table)


def ingest(raw: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Cleaned rows with their ``split``."""
    return split.holdout_split(clean_customers(raw, key), key)


def parts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a table with a ``split`` column."""
    return tuple(
        table.where(F.col("split") == name).drop("split") for name in ("train", "test")
    )


@dataclass(frozen=True)
class Validation:
    """What validation found."""

    schema: DataFrame
    drift: DataFrame
    schema_ok: bool
    drift_found: bool

    @property
    def passed(self) -> bool:
        return self.schema_ok and not self.drift_found


def schema_reports(
    train: DataFrame, test: DataFrame, column_rules: tuple[ColumnRule, ...] = CUSTOMER_RULES
) -> dict[str, DataFrame]:
    return {
        "train": rules.schema_report(train, column_rules),
        "test": rules.schema_report(test, column_rules),
    }


def validate(
    train: DataFrame, test: DataFrame, column_rules: tuple[ColumnRule, ...] = CUSTOMER_RULES
) -> Validation:
    """Schema rules on both parts, and drift between them; totals are coerced first."""
    train, test = clean.coerce_numeric(train), clean.coerce_numeric(test)
    # Reports have one row per rule or column; written once, they are read many times.
    status = materialize(
        rules.combined_status(schema_reports(train, test, column_rules)), "schema-report"
    )
    report = materialize(drift.drift_report(train, test, column_rules), "drift-report")
    return Validation(
        schema=status,
        drift=report,
        schema_ok=rules.report_passed(status),
        drift_found=drift.drift_overall(report).first()["overall_drift_found"],
    )


def validation_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: schema status, drift status, and both together."""
    train, test = clean.coerce_numeric(train), clean.coerce_numeric(test)
    status = rules.combined_status(schema_reports(train, test)).agg(
        F.bool_and("passed").alias("schema_ok")
    )
    overall = drift.drift_overall(drift.drift_report(train, test)).select("overall_drift_found")
    # Both sides are one-row totals.
    both = status.unionByName(overall, allowMissingColumns=True)
    return both.agg(
        F.bool_and("schema_ok").alias("schema_ok"),
        F.bool_or("overall_drift_found").alias("drift_found"),
    ).withColumn("passed", F.col("schema_ok") & ~F.col("drift_found"))
