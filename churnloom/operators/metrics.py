"""Metrics of a binary classifier from (label, prediction, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.functions.expressions import ratio
from churnloom.operators.ordered import running_totals

_CELLS = ("tn", "fp", "fn", "tp")


def _cell_conditions(label: str, prediction: str) -> dict[str, Column]:
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return {
        "tn": (y == 0) & (p == 0),
        "fp": (y == 0) & (p == 1),
        "fn": (y == 1) & (p == 0),
        "tp": (y == 1) & (p == 1),
    }


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in _CELLS)
    return {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    }


def threshold_metrics(
    df: DataFrame, by: list[str] | None = None, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy, precision, recall, F1 and the four counts; one aggregation."""
    by = by or []
    cells = df.groupBy(*by).agg(
        *(F.count_if(c).alias(name) for name, c in _cell_conditions(label, prediction).items())
    )
    return cells.select(*by, *(c.alias(name) for name, c in _rates().items()), *_CELLS)


def _score_counts(df: DataFrame, by: list[str], label: str, score: str, extra=None) -> DataFrame:
    """Rows per (group, score). Rows without a score have a row too, with no ``pos`` or ``neg``."""
    y, scored = F.col(label).cast("int"), F.col(score).isNotNull()
    sums = {"pos": (y == 1) & scored, "neg": (y == 0) & scored, **(extra or {})}
    return df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        *(F.count_if(c).alias(name) for name, c in sums.items())
    )


def _curve_totals(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Running counts by falling score, for the rows that have one."""
    counts = _score_counts(df, by, label, score).where("threshold is not null")
    return running_totals(counts, by, ["threshold"], ["pos", "neg"], descending=True)


def _auc(pos: str = "pos", neg: str = "neg") -> Column:
    """Aggregate over rows by ascending score: share of (positive, negative) pairs in order.

    A tie counts half. The products are summed as doubles, since a count of pairs
    overflows a long on large tables.
    """
    below = (F.col(f"{neg}_cum") - F.col(neg)).cast("double")
    pairs = F.sum(F.col(pos) * (below + F.col(neg) / 2.0))
    return F.try_divide(
        pairs, F.max(F.col(f"{pos}_total")).cast("double") * F.max(F.col(f"{neg}_total"))
    )


def binary_metrics(
    df: DataFrame,
    by: list[str] | None = None,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "score",
) -> DataFrame:
    """Threshold metrics plus ROC AUC per group, from one pass over the rows.

    All rows count for the threshold metrics; the AUC is that of the rows with a score.
    """
    by = by or []
    counts = _score_counts(df, by, label, score, _cell_conditions(label, prediction))
    running = running_totals(counts, by, ["threshold"], ["pos", "neg"])
    cells = running.groupBy(*by).agg(
        _auc().alias("roc_auc"), *(F.sum(c).alias(c) for c in _CELLS)
    )
    return cells.select(*by, *(c.alias(name) for name, c in _rates().items()), "roc_auc", *_CELLS)


def confusion_matrix(
    df: DataFrame, by: list[str] | None = None, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Four rows per group: actual, predicted, n; empty cells are 0."""
    by = by or []
    cells = threshold_metrics(df, by, label, prediction)
    grid = F.array(
        *(
            F.struct(F.lit(y).alias("actual"), F.lit(p).alias("predicted"), F.col(name).alias("n"))
            for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        )
    )
    return cells.select(*by, F.inline(grid))


def roc_auc(
    df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score"
) -> DataFrame:
    """Area under the ROC curve by rank sum; null when a class is absent."""
    by = by or []
    running = running_totals(
        _score_counts(df, by, label, score), by, ["threshold"], ["pos", "neg"]
    )
    return running.groupBy(*by).agg(_auc().alias("roc_auc"))


def roc_curve(
    df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score"
) -> DataFrame:
    """(threshold, fpr, tpr) at every score, and the origin with a null threshold."""
    by = by or []
    running = _curve_totals(df, by, label, score)
    points = running.select(
        *by,
        "threshold",
        F.try_divide(F.col("neg_cum"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_cum"), F.col("pos_total")).alias("tpr"),
    )
    origin = df.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def roc_area(
    df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score"
) -> DataFrame:
    """Trapezoid area under :func:`roc_curve`."""
    by = by or []
    running = _curve_totals(df, by, label, score)
    width = F.try_divide(F.col("neg"), F.col("neg_total"))
    height = F.try_divide(2 * F.col("pos_cum") - F.col("pos"), 2 * F.col("pos_total"))
    return running.groupBy(*by).agg(F.sum(width * height).alias("area"))


def pr_curve(
    df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score"
) -> DataFrame:
    """(threshold, precision, recall) at every score, closed by precision 1, recall 0."""
    by = by or []
    running = _curve_totals(df, by, label, score)
    points = running.select(
        *by,
        "threshold",
        (F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("precision"),
        F.coalesce(F.try_divide(F.col("pos_cum"), F.col("pos_total")), F.lit(1.0)).alias("recall"),
    )
    closing = df.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(closing)


def pick_best(report: DataFrame, metric: str = "f1_score", order: str = "position") -> DataFrame:
    """The row with the highest metric; the first in ``order`` wins a tie."""
    return report.orderBy(F.col(metric).desc(), F.col(order).asc()).limit(1)
