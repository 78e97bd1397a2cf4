"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Every text becomes the set of its character n-grams (3 to 5 code points of the lower-cased
text, hashed). Counting how many labelled texts of each class hold an n-gram gives the naive
Bayes log-count ratio that scales the feature; a logistic regression is then trained on the
scaled features, and the product of ratio and coefficient is one weight for each n-gram.

Training uses a sample of labelled rows whose size is a documented parameter, and the n-grams
that tell the classes apart best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.llm.tables import fresh, materialize

SIZES = (3, 4, 5)
BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ codes[i : n + i]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def grams(text: str | None, chosen: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, of those marked in ``chosen`` if it is given."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = []
    for begin in range(0, max(1, len(codes)), _PIECE):
        piece = codes[begin : begin + _PIECE + max(SIZES) - 1]
        for size in SIZES:
            h = _hashes(piece, size)
            found.append(np.unique(h if chosen is None else h[chosen[h]]))
    return np.unique(np.concatenate(found))


@dataclass
class Toxicity:
    """A fitted model: one weight for each chosen n-gram, and the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: Column) -> Column:
        """Probability of label 1; null and empty texts have that of the intercept."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.grams] = self.weights
        intercept = self.intercept

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            chosen = table != 0
            for texts in batches:
                sums = np.array([float(table[grams(x, chosen)].sum(dtype=np.float64)) for x in texts])
                yield pd.Series(1 / (1 + np.exp(-np.clip(sums + intercept, -500, 500))))

        return scores(text)


def _class_counts(rows: DataFrame) -> DataFrame:
    """``gram``, ``n0``, ``n1``: labelled texts of each class that hold the n-gram."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for label, text in zip(batch.label, batch.text):
                totals[int(label), grams(text)] += 1
        held = np.flatnonzero(totals.any(axis=0))
        yield pd.DataFrame({"gram": held, "n0": totals[0, held], "n1": totals[1, held]})

    parts = rows.select("label", "text").mapInPandas(count, "gram long, n0 long, n1 long")
    return parts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "label",
    features: int = 4096,
    min_texts: int = 5,
    penalty: float = 1e-3,
    smoothing: float = 1.0,
) -> Toxicity:
    """Train on rows of a text and a 0/1 label; rows with another label are left out.

    ``features`` bounds the n-grams in the model. Without rows of both classes the score is the
    share of label 1, and 0 without any row.
    """
    rows = materialize(
        labelled.where(F.col(label).isin(0, 1)).select(
            F.col(label).cast("int").alias("label"), F.col(text).cast("string").alias("text")
        ),
        "labelled",
    )
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = np.zeros(0, np.int64)
    if not ones or ones == n:
        share = ones / n if n else 0.0
        return Toxicity(none, none.astype(float), 500.0 if share else -500.0)
    base = ones / n
    held = F.col("n0") + F.col("n1")
    apart = F.abs(F.col("n1") - held * base) / F.sqrt(held * base * (1 - base))
    chosen = (
        _class_counts(rows).where(held >= min_texts)
        .orderBy(apart.desc(), "gram").limit(features).toPandas().sort_values("gram")
    )
    if not len(chosen):
        return Toxicity(none, none.astype(float), float(np.log(base / (1 - base))))
    ids = chosen.gram.to_numpy()
    yes = (chosen.n1.to_numpy() + smoothing) / (ones + 2 * smoothing)
    no = (chosen.n0.to_numpy() + smoothing) / (n - ones + 2 * smoothing)
    ratio = np.log(yes / no)

    mark = np.zeros(1 << BITS, bool)
    mark[ids] = True

    def scaled(value):
        at = np.searchsorted(ids, grams(value, mark))
        return Vectors.sparse(len(ids), at.tolist(), ratio[at].tolist())

    vectors = F.udf(scaled, VectorUDT())
    train = materialize(
        rows.select(F.col("label").cast("double").alias("label"), vectors("text").alias("features")),
        "scaled",
    )
    model = LogisticRegression(regParam=penalty, standardization=False, maxIter=60).fit(train)
    weights = model.coefficients.toArray() * ratio
    return Toxicity(ids, weights, float(model.intercept))


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no model may learn labels from: a quarter, by the id. Null ids are held out."""
    code = F.crc32(F.col(id_column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(code, F.lit(4)) == 2, F.lit(True))


#: Labelled documents that a model is trained on, about; more are sampled by their id.
MAX_ROWS = 40_000


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **settings) -> Toxicity:
    """Model from the labelled documents that are not held out.

    About ``max_rows`` of them are taken, by a hash of the id, so their ids and labels are a
    small table at any size and the texts are not shuffled to meet them. A document with several
    labels counts as toxic if one of them says so; null labels and documents without a label are
    no training rows.
    """
    one = (
        labels.where(F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("label"))
    )
    n = one.count()
    share = int(min(1.0, max_rows / max(1, n)) * (1 << 20))
    chosen = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit(rows, **settings)


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``; one row each."""
    model = fit_toxicity(docs, labels, **settings)
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or more; all columns as they are."""
    model = fit_toxicity(docs, labels, **settings)
    score = fresh(docs, "toxicity")
    return docs.withColumn(score, model.score(F.col("text"))).where(F.col(score) < threshold).drop(score)
