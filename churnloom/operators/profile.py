"""Profiles of a table: shape, counts per class, box summaries, histogram, density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnloom.operators.ordered import quantile_at, running_totals, value_counts
from churnloom.schema import TARGET
from churnloom.sources.storage import materialize

# Fixed values of the exploration plots.
HISTOGRAM_BINS = 30
DENSITY_POINTS = 200
WHISKER_REACH = 1.5


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows and missing cells."""
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.lit(dtype).alias("dtype"),
            F.col("_rows").alias("n_rows"),
            F.col(f"_missing_{i}").alias("n_missing"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    counted = df.agg(
        F.count("*").alias("_rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"_missing_{i}") for i, c in enumerate(df.columns)),
    )
    return counted.select(F.inline(F.array(*entries)))


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def box_summary(df: DataFrame, value: str, by: str = TARGET) -> DataFrame:
    """Quartiles, whiskers and outlier count of a numeric column per group.

    A whisker ends at the last value within 1.5 interquartile ranges of the box.
    """
    counts = materialize(value_counts(df, [by], value), "counts")
    cum, total = F.col("n_cum"), F.col("n_total")
    # Written, so that the join below is planned with the real size: a broadcast for a
    # few groups, a shuffle for very many.
    boxes = materialize(
        running_totals(counts, [by], [value], ["n"])
        .groupBy(by)
        .agg(
            F.max(total).alias("n_rows"),
            quantile_at(value, 0.25, cum, total).alias("q1"),
            quantile_at(value, 0.5, cum, total).alias("median"),
            quantile_at(value, 0.75, cum, total).alias("q3"),
        ),
        "boxes",
    )
    reach = WHISKER_REACH * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counts.join(boxes, by)
        .groupBy(by, "n_rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
        )
    )


def value_range(df: DataFrame, value: str) -> tuple[float, float] | None:
    """(min, max) on the driver, or None without values."""
    row = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    return None if row["low"] is None else (float(row["low"]), float(row["high"]))


def _bin_edges(low: float, high: float) -> tuple[float, float]:
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def histogram(
    df: DataFrame, value: str = "tenure", by: str = TARGET, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal bins over the common range, counts per group, and stacked heights.

    Bins are closed on the left, the last one on both sides; empty bins are kept.
    """
    clean = df.select(by, value).na.drop("any")
    limits = value_range(clean, value)
    if limits is None:
        raise ValueError(f"no value in {value!r}")
    low, high = _bin_edges(*limits)
    index = F.least(
        F.floor((F.col(value) - low) * float(bins) / (high - low)).cast("int"), F.lit(bins - 1)
    )
    counted = clean.groupBy(by, index.alias("bin")).agg(F.count("*").alias("n"))
    # At most `bins` entries per group, so the map stays small.
    per_group = counted.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_filled")
    )
    width = (high - low) / bins
    stacked = Window.partitionBy("bin").orderBy(by)
    return (
        per_group.select(by, "_filled", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select(
            by,
            "bin",
            (F.lit(low) + F.col("bin") * width).alias("bin_start"),
            (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce(F.try_element_at("_filled", F.col("bin")), F.lit(0)).alias("n"),
        )
        .withColumn("stacked_n", F.sum("n").over(stacked))
    )


def density(
    df: DataFrame,
    value: str = "tenure",
    by: str = TARGET,
    points: int = DENSITY_POINTS,
    bins: int = HISTOGRAM_BINS,
) -> DataFrame:
    """Gaussian kernel density per group on a common grid, and its height on the histogram.

    The bandwidth is Scott's: n^(-1/5) times the sample standard deviation. Rows are
    collapsed to distinct values first, then one aggregation sums all grid points.
    """
    clean = df.select(by, F.col(value).cast("double").alias("x")).na.drop("any")
    limits = value_range(clean, "x")
    if limits is None:
        raise ValueError(f"no value in {value!r}")
    low, high = limits
    step = (high - low) / (points - 1)
    bin_low, bin_high = _bin_edges(low, high)
    bin_width = (bin_high - bin_low) / bins
    # Written, so that the join is planned with the real size.
    spread = materialize(
        clean.groupBy(by)
        .agg(
            F.count("*").alias("n_rows"),
            (F.pow(F.count("*"), F.lit(-0.2)) * F.stddev_samp("x")).alias("bandwidth"),
        )
        .where("bandwidth > 0"),
        "spread",
    )
    weights = clean.groupBy(by, "x").agg(F.count("*").alias("n"))
    grid = [low + i * step for i in range(points)]

    def mass(at: float) -> Column:
        distance = (F.lit(at) - F.col("x")) / F.col("bandwidth")
        return F.sum(F.col("n") * F.exp(-0.5 * distance * distance))

    # One row of sums for each group; no distinct value becomes a row for each grid point.
    sums = (
        weights.join(spread, by)
        .groupBy(by, "n_rows", "bandwidth")
        .agg(*(mass(x).alias(f"_{i}") for i, x in enumerate(grid)))
    )
    masses = F.array(*(F.col(f"_{i}") for i in range(points)))
    root = math.sqrt(2 * math.pi)
    return sums.select(by, "n_rows", "bandwidth", F.posexplode(masses).alias("point", "mass")).select(
        by,
        "point",
        (F.lit(low) + F.col("point") * step).alias("x"),
        (F.col("mass") / (F.col("n_rows") * F.col("bandwidth") * root)).alias("density"),
        (F.col("mass") * bin_width / (F.col("bandwidth") * root)).alias("height"),
    )
