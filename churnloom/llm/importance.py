"""Quality selection by importance resampling over hashed n-grams.

Words and word pairs are hashed into a fixed number of buckets. Bucket counts over all texts
give the raw model, those over the target texts the target model; a text's log importance
weight is the sum of its n-grams' log ratios. Adding Gumbel noise to the weights and taking
the ``k`` largest draws ``k`` texts without replacement in proportion to the weights.

The cut for the ``k`` largest is found by counting 16 bits of the sort key at a time, so
nothing is sorted and no more than 65,536 counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.llm.tables import materialize, text_or_empty

BUCKETS = 1 << 16
#: Target texts that the target model is fitted on, about; more are sampled by their id.
MAX_TARGET = 40_000
_SEED = 7
_CACHE = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Buckets:
    """Hash buckets of the words and word pairs of a text; remembers the words it has hashed."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, words = self.known, (text or "").lower().split()
        if len(known) > _CACHE:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, _SEED)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * _MULTIPLIER) ^ h[1:]
        return (np.concatenate([h, pairs]) * _MULTIPLIER >> np.uint64(48)).astype(np.int64)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """``bucket``, ``raw``, ``target``: n-grams over all rows of ``text``, and where ``target``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target, buckets = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), Buckets()
        for batch in batches:
            for text, is_target in zip(batch.text, batch.target):
                if not text:
                    continue
                n = np.bincount(buckets(text), minlength=BUCKETS)
                raw += n
                if is_target:
                    target += n
        held = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": held, "raw": raw[held], "target": target[held]})

    parts = rows.select("text", "target").mapInPandas(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """Log of target over raw probability for each bucket; zeros without target n-grams."""
    table = counts.toPandas()  # one row for each bucket at most
    raw, target = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    raw[table.bucket] += table.raw
    target[table.bucket] += table.target
    if not table.target.sum():
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weight(text: Column, ratios: np.ndarray) -> Column:
    """Sum of the n-grams' log ratios over the whole text; 0 for null and empty texts."""

    @F.pandas_udf("double")
    def weights(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts in batches:
            yield pd.Series([float(ratios[buckets(x)].sum()) if x else 0.0 for x in texts], dtype="float64")

    return weights(text)


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise that depends on the columns' values alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def _ordered(key: str) -> Column:
    """A long that sorts as the double does."""

    @F.pandas_udf("long")
    def ordered(keys: pd.Series) -> pd.Series:
        bits = (keys.to_numpy(np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))

    return ordered(F.col(key))


def top_k_cut(keys: DataFrame, k: int, column: str = "sort_key") -> int | None:
    """The ``k``-th largest long of a column, by counts of its digits; null if there are fewer."""
    digits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(digits, shift).bitwiseAND(F.lit(0xFFFF))
        rows = keys if prefix is None else keys.where(F.shiftrightunsigned(digits, shift + 16) == prefix)
        counts = rows.groupBy(digit.alias("digit")).count().collect()  # 65,536 rows at most
        for digit_value, n in sorted(((r.digit, r["count"]) for r in counts), reverse=True):
            if left <= n:
                prefix = ((prefix or 0) << 16) | digit_value
                break
            left -= n
        else:
            return None
    return prefix - (1 << 63)


def resample(
    docs: DataFrame,
    target_ids: DataFrame,
    share: float,
    seed: int = 42,
    smoothing: float = 1.0,
    max_target: int = MAX_TARGET,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The ``share`` of ``docs`` (rounded up) with the largest perturbed importance weights.

    ``target_ids`` holds the ids of the target texts in ``id_column``. The target model is fitted
    on about ``max_target`` of them, by a hash of the id, so they are a small table at any size
    and no text is shuffled to meet its label; the raw model counts all texts. Returns id,
    ``log_weight`` and ``perturbed`` (weight plus noise) of the drawn rows. Null and empty texts
    weigh 0 in the logarithm, as a text that is as likely under both models. Rows that tie at
    the cut, such as repeated rows, are all drawn. Null ids are no target. An empty table gives an
    empty sample.
    """
    wanted = target_ids.select(F.col(id_column)).where(F.col(id_column).isNotNull()).distinct()
    part = int(min(1.0, max_target / max(1, wanted.count())) * (1 << 20))
    chosen = wanted.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < part)
    marked = docs.select(F.col(id_column), text_or_empty(text).alias("text")).join(
        F.broadcast(chosen.withColumn("is_target", F.lit(True))), id_column, "left"
    )
    ratios = log_ratios(
        bucket_counts(marked.select("text", F.coalesce("is_target", F.lit(False)).alias("target"))),
        smoothing,
    )
    scored = docs.select(F.col(id_column), text_or_empty(text).alias("text")).select(
        F.col(id_column),
        log_weight(F.col("text"), ratios).alias("log_weight"),
        gumbel(seed, id_column, "text").alias("noise"),
    )
    scored = scored.withColumn("perturbed", F.col("log_weight") + F.col("noise")).drop("noise")
    keys = materialize(scored.withColumn("sort_key", _ordered("perturbed")), "scored")
    rows = keys.count()
    cut = top_k_cut(keys, int(np.ceil(share * rows))) if rows and share > 0 else None
    if cut is None:
        return keys.drop("sort_key").where(F.lit(False) if share <= 0 else F.lit(True))
    return keys.where(F.col("sort_key") >= cut).drop("sort_key")


def labelled_share(labels: DataFrame, column: str = "quality") -> float:
    """Share of label 1 among the rows that have a label; 1 if no row has one."""
    share = labels.agg(F.avg(F.col(column).cast("double"))).first()[0]
    return 1.0 if share is None else share
