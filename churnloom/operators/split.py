"""Hold-out splits and folds from a hash of the key.

The hash depends on the key alone, so a row stays in its part when the table is
repartitioned, appended to or read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.functions.expressions import HASH_BUCKETS, hash_bucket, key_hash
from churnloom.operators.ordered import running_totals
from churnloom.schema import ID_COLUMN, TARGET

# Fixed values of the default split.
TEST_SHARE = 0.2
SEED = 42


def holdout_split(
    df: DataFrame, key: str = ID_COLUMN, test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``split`` = train or test; a projection, no shuffle."""
    limit = round(test_share * HASH_BUCKETS)
    return df.withColumn(
        "split", F.when(hash_bucket(key, seed) < limit, F.lit("test")).otherwise(F.lit("train"))
    )


def holdout_split_exact(
    df: DataFrame, key: str = ID_COLUMN, test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """As :func:`holdout_split`, with exactly ceil(share * rows) test rows; needs a unique key."""
    ranked = running_totals(
        df.withColumns({"_hash": key_hash(key, seed), "_one": F.lit(1)}),
        [],
        ["_hash", key],
        ["_one"],
    )
    test = F.col("_one_cum") <= F.ceil(F.col("_one_total") * F.lit(test_share))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).select(
        *df.columns, "split"
    )


def hash_folds(
    df: DataFrame, k: int = 3, key: str = ID_COLUMN, seed: int = SEED, output: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1; class shares are equal only on average; no shuffle."""
    return df.withColumn(output, hash_bucket(key, seed, k).cast("int"))


def stratified_folds(
    df: DataFrame,
    k: int = 3,
    label: str = TARGET,
    key: str = ID_COLUMN,
    seed: int = SEED,
    output: str = "fold",
) -> DataFrame:
    """Add a fold number; within each class the fold sizes differ by at most one.

    Rows are ranked inside their class by (hash, key). A class may hold most of
    the table, so the rank comes from the sliced running total.
    """
    # Rows without a label form a class of their own.
    group = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    ranked = running_totals(
        df.withColumns({"_class": group, "_hash": key_hash(key, seed), "_one": F.lit(1)}),
        ["_class"],
        ["_hash", key],
        ["_one"],
    )
    return ranked.withColumn(output, ((F.col("_one_cum") - 1) % k).cast("int")).select(
        *df.columns, output
    )
