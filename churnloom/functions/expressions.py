"""Column expressions used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKETS = 10000


def to_number(column: str) -> Column:
    """Text to double; what is not a number becomes null, NaN included."""
    number = F.col(column).try_cast("double")
    return F.when(~F.isnan(number), number)


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def key_hash(key: str, seed: int) -> Column:
    """32-bit number from the key and a seed; depends on nothing else."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: str, seed: int, buckets: int = HASH_BUCKETS) -> Column:
    return key_hash(key, seed) % buckets


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def ks_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    """Two-sided large-sample p-value of the two-sample KS statistic.

    Kolmogorov's series 2 * sum((-1)^(j-1) exp(-2 j^2 x^2)); below x = 0.2 it is
    1 to more digits than a double holds, and the series converges too slowly.
    """
    n, m = n.cast("double"), m.cast("double")
    x = statistic * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, j: total
        + F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    )
