"""Class weights against imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _class_totals(df: DataFrame, label: str) -> DataFrame:
    value = F.col(label).cast("int")
    return df.agg(
        F.count_if(value == 0).alias("n_negative"), F.count_if(value == 1).alias("n_positive")
    )


def scale_pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive; 1 when either class is absent. One row."""
    both = (F.col("n_negative") > 0) & (F.col("n_positive") > 0)
    return _class_totals(df, label).withColumn(
        "scale_pos_weight",
        F.when(both, F.col("n_negative") / F.col("n_positive")).otherwise(F.lit(1.0)),
    )


def class_weight_values(df: DataFrame, label: str = "label") -> dict[int, float]:
    """Weight per class present: rows / (classes present * rows of the class)."""
    row = _class_totals(df, label).first()
    sizes = {0: row["n_negative"], 1: row["n_positive"]}
    present = {c: n for c, n in sizes.items() if n > 0}
    total = sum(present.values())
    return {c: total / (len(present) * n) for c, n in present.items()}


def with_balanced_weights(df: DataFrame, label: str = "label", output: str = "weight") -> DataFrame:
    """Add the balanced class weight; the two weights travel as literals, not as a join."""
    weights = class_weight_values(df, label)
    value = F.col(label).cast("int")
    return df.withColumn(
        output,
        F.when(value == 1, F.lit(weights.get(1, 1.0))).otherwise(F.lit(weights.get(0, 1.0))),
    )


def with_positive_weight(df: DataFrame, label: str = "label", output: str = "weight") -> DataFrame:
    """Weight 1 for negatives and negatives-per-positive for positives."""
    factor = scale_pos_weight(df, label).first()["scale_pos_weight"]
    return df.withColumn(
        output, F.when(F.col(label).cast("int") == 1, F.lit(factor)).otherwise(F.lit(1.0))
    )
