"""Projections, filters and fills that clean the customer table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom.functions.expressions import nan_to_null, to_number
from churnloom.operators.ordered import quantile_at, running_totals
from churnloom.schema import MISSING_TOKEN, NEGATIVE, POSITIVE, TARGET

# The flags the exploration turns into 0/1, and their codes.
FLAG_COLUMNS = ("Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn")
FLAG_CODES = {"Yes": 1, "No": 0}
GENDER_CODES = {"Male": 1, "Female": 0}
ALL_MISSING_FILL = "Unknown"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def drop_system_columns(df: DataFrame, names: Iterable[str] = ("_id",)) -> DataFrame:
    return df.drop(*names)


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself; an error if it has no row."""
    if df.isEmpty():
        raise ValueError("the customer table is empty")
    return df


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; missing equals missing."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return (
        df.groupBy(*df.columns)
        .agg((F.count("*") - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))
    )


def replace_missing_token(df: DataFrame, token: str = MISSING_TOKEN) -> DataFrame:
    """Text cells equal to the token become null; longer cells holding it stay."""
    return df.replace(token, None, subset=string_columns(df))


def drop_incomplete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def coerce_numeric(df: DataFrame, columns: Iterable[str] = ("TotalCharges",)) -> DataFrame:
    """Text columns to double; blanks and other non-numbers become null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(c) for c in present})


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN to null in floating columns."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating}) if floating else df


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column, from one aggregation."""
    counted = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counted.unpivot([], df.columns, "column", "n_missing")


def split_target(
    df: DataFrame, target: str = TARGET, key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(features, target); the target must be there and hold no missing value."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    if not df.where(F.col(target).isNull()).isEmpty():
        raise ValueError(f"target column {target!r} holds missing values")
    keys = [key] if key else []
    return df.drop(target), df.select(*keys, target)


def columns_by_type(
    df: DataFrame, target: str = TARGET, id_columns: Iterable[str] = ()
) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by physical type."""
    skip = {target, *id_columns}
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    categorical = [c for c in string_columns(df) if c not in skip]
    if not numeric and not categorical:
        raise ValueError("no numeric or categorical feature column")
    return numeric, categorical


def _coded(column: str, codes: dict[str, int]):
    chain = F
    for text, code in codes.items():
        chain = chain.when(F.col(column) == text, F.lit(code))
    return chain


def encode_flags(df: DataFrame) -> DataFrame:
    """Yes/No flags and gender as 1/0; any other value becomes null."""
    codes = {c: _coded(c, FLAG_CODES) for c in FLAG_COLUMNS if c in df.columns}
    if "gender" in df.columns:
        codes["gender"] = _coded("gender", GENDER_CODES)
    return df.withColumns(codes)


def encode_target(df: DataFrame, target: str = TARGET, output: str = "label") -> DataFrame:
    """No/Yes as 0/1 bytes; any other value fails the query."""
    value = F.col(target)
    code = (
        F.when(value == NEGATIVE, F.lit(0))
        .when(value == POSITIVE, F.lit(1))
        .otherwise(
            F.raise_error(
                F.concat(F.lit("target value not in the code list: "), F.coalesce(value, F.lit("null")))
            ).cast("int")
        )
    )
    return df.withColumn(output, code.cast("tinyint"))


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact interpolated medians; one row per column comes to the driver."""
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)
    )
    counts = (
        df.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    rows = (
        running_totals(counts, ["column"], ["value"], ["n"])
        .groupBy("column")
        .agg(quantile_at("value", 0.5, F.col("n_cum"), F.col("n_total")).alias("median"))
        .collect()
    )
    found = {row["column"]: row["median"] for row in rows}
    return {c: found.get(c) for c in columns}


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent text per column, the smallest on a tie; one row per column collected."""
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)
    )
    rows = (
        df.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best"))
        .collect()
    )
    found = {row["column"]: row["best"]["value"] for row in rows}
    return {c: found.get(c) for c in columns}


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls to the column's median, as double; a column without values stays null."""
    medians = column_medians(df, columns)
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double")) for c in columns}
    )


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls to the column's most frequent text, or to a fixed word if it has none."""
    modes = column_modes(df, columns)
    return df.fillna({c: modes[c] if modes[c] is not None else ALL_MISSING_FILL for c in columns})
