"""Running totals over a sorted table without putting it on one task.

A window without partition keys, or with a hot key, sorts everything in a single
task. Here the rows are range-partitioned on (key, order), each slice gets a local
window, and the small table of slice totals supplies what came before the slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnloom.sources.storage import materialize

_SLICE = "_slice"


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows per (group, value) without null values; combined map-side before the shuffle.

    A null in ``by`` is a group of its own.
    """
    known = df.select(*by, value).where(F.col(value).isNotNull())
    return known.groupBy(*by, value).agg(F.count("*").alias("n"))


def running_totals(
    counts: DataFrame, by: list[str], order: list[str], sums: list[str], descending: bool = False
) -> DataFrame:
    """Add ``<c>_cum`` (this row included) and ``<c>_total`` (whole group) for each c in sums.

    ``counts`` must hold one row per (by, order); a null in ``by`` is a group. A group may
    span any number of slices, so a hot group costs no more than any other.
    """
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    # The slice number is stored with the rows: a later stage that recomputes the
    # range bounds would otherwise see other slices.
    ranged = materialize(
        counts.repartitionByRange(*(F.col(c) for c in by), *sort).withColumn(
            _SLICE, F.spark_partition_id()
        ),
        "ranged",
    )
    slices = ranged.groupBy(*by, _SLICE).agg(*(F.sum(c).alias(c) for c in sums))
    # One row per slice and group; with no group that is one row per slice.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *by,
        _SLICE,
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before") for c in sums),
        *(F.sum(c).over(whole).alias(f"{c}_total") for c in sums),
    )
    inside = (
        Window.partitionBy(*by, _SLICE)
        .orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select("*", *(F.sum(c).over(inside).alias(f"_{c}_local") for c in sums))
    # No hint: the join runs on the window's own partitioning, and adaptive
    # execution broadcasts the offsets when their measured size allows it.
    same = reduce(
        lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, _SLICE])
    )
    return (
        local.alias("l")
        .join(offsets.alias("o"), same)
        .select(
            *(F.col(f"l.{c}") for c in counts.columns),
            *((F.col(f"_{c}_local") + F.col(f"_{c}_before")).alias(f"{c}_cum") for c in sums),
            *(F.col(f"{c}_total") for c in sums),
        )
    )


def prefix_sum(
    df: DataFrame, value: str, by: list[str] | None = None, descending: bool = False
) -> DataFrame:
    """Running count of rows per distinct value: (by, value, n, n_cum, n_total)."""
    by = by or []
    return running_totals(value_counts(df, by, value), by, [value], ["n"], descending)


def quantile_at(value: str, prob: float, cum: Column, total: Column) -> Column:
    """Aggregate: interpolated quantile of a group from its running counts."""
    position = (total - 1) * F.lit(float(prob))
    low = F.min(F.when(cum > F.floor(position), F.col(value)))
    high = F.min(F.when(cum > F.ceil(position), F.col(value)))
    fraction = F.max(position - F.floor(position))
    return low + (high - low) * fraction


def grouped_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per name in ``probs``."""
    by = by or []
    running = prefix_sum(df, value, by)
    return running.groupBy(*by).agg(
        *(
            quantile_at(value, prob, F.col("n_cum"), F.col("n_total")).alias(name)
            for name, prob in probs.items()
        )
    )
