"""The exploration report as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.operators import clean, profile
from churnloom.schema import TARGET
from churnloom.sources.storage import materialize


def _long(
    df: DataFrame, section: str, item: Column | str, value: Column, group: Column | None = None
) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        (F.lit(item) if isinstance(item, str) else item).alias("item"),
        (F.lit(None) if group is None else group).cast("string").alias("churn"),
        value.cast("double").alias("value"),
    )


def _wide(df: DataFrame, section: str, group: str) -> DataFrame:
    """Every column but the group as an item."""
    names = [c for c in df.columns if c != group]
    stacked = df.select(group, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(
        [group], names, "item", "value"
    )
    return _long(stacked, section, F.col("item"), F.col("value"), F.col(group))


def eda_report(raw: DataFrame, target: str = TARGET) -> DataFrame:
    """(section, item, churn, value): shape, types, missing cells, duplicates, counts, boxes,
    histogram and density.

    Rows, duplicates and missing cells come from one pass over the raw table, collapsed to
    distinct rows; the cleaned, coded table is written once, since the other sections read it.
    """
    coerced = clean.coerce_numeric(raw)
    # A distinct raw row has one coerced form, so its copies count for all sections.
    copies = clean.coerce_numeric(raw.groupBy(*raw.columns).agg(F.count("*").alias("_n")))
    n = F.col("_n")
    totals = materialize(
        copies.agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("_rows"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("_duplicates"),
            *(F.sum(F.when(F.col(c).isNull(), n).otherwise(0)).alias(c) for c in raw.columns),
        ),
        "totals",
    )
    missing = totals.unpivot(["_rows"], list(raw.columns), "column", "n_missing")
    kinds = dict(coerced.dtypes)
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("column")]
    point = F.concat(F.lit("point "), F.lpad(F.col("point").cast("string"), 3, "0"))
    coded = clean.encode_flags(clean.drop_incomplete_rows(coerced, ["TotalCharges"]))
    table = materialize(coded, "explored")
    bin_name = F.concat(F.lit("bin "), F.lpad(F.col("bin").cast("string"), 2, "0"))
    sections = [
        _long(totals, "shape", "rows", F.col("_rows")),
        _long(totals, "shape", "columns", F.lit(len(raw.columns))),
        _long(table.agg(F.count("*").alias("n")), "shape", "clean_rows", F.col("n")),
        _long(totals, "duplicates", "rows", F.col("_duplicates")),
        _long(missing, "missing", F.col("column"), F.col("n_missing")),
        _long(missing, "types", F.concat_ws(" ", "column", kind), F.col("_rows") - F.col("n_missing")),
        _long(profile.group_counts(table, target), "churn", "rows", F.col("n"), F.col(target)),
        _long(
            profile.group_counts(table, "Contract", target),
            "contract",
            F.col("Contract"),
            F.col("n"),
            F.col(target),
        ),
        _wide(profile.box_summary(table, "MonthlyCharges", target), "monthly", target),
        _wide(profile.box_summary(table, "TotalCharges", target), "total", target),
        _long(profile.histogram(table, "tenure", target), "tenure", bin_name, F.col("n"), F.col(target)),
        _long(profile.density(table, "tenure", target), "density", point, F.col("density"), F.col(target)),
    ]
    return reduce(DataFrame.unionByName, sections)
