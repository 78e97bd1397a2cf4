"""Approximate nearest neighbours by inner product, with an inverted multi-index.

The two halves of the vectors are quantised by k-means of their own; a pair of centroids, one
for each half, is a cell of the index. For a query both halves score all centroids, and the
pairs are taken off a heap in order of their summed score, each pair once, until the cells hold a
``share`` of all vectors. Entries of these cells are then scored with the original vectors in
double precision.

Cells with the same first centroid are one block; a block with many entries is split by a hash,
so that a task holds about ``BLOCK_ROWS`` entries and as many queries however the vectors are
distributed. A query goes to a block once, with the set of second centroids to look at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnloom.llm.tables import materialize

CENTROIDS = 64  # a set of second centroids is the bits of a long
BLOCK_ROWS = 4096
SAMPLE_ROWS = 20_000
#: Scores this close to the last one kept are scored again exactly before the cut.
_NEAR = 1e-9
FOUND = "query_id long, vec_id long, score double"


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part, repeated rows once.

    Null ids, null vectors, vectors of zeros, and vectors that hold a null or a number that is
    not finite take no part, nor do vectors of another length than most.
    """
    whole = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = whole.where(F.exists("vector", lambda x: x != 0.0)).distinct()
    kept = materialize(whole, "vectors")
    lengths = kept.groupBy(F.size("vector").alias("length")).count()
    usual = lengths.orderBy(F.col("count").desc(), "length").first()
    return kept.where(F.size("vector") == (usual.length if usual else 0))


def codebooks(vectors: DataFrame, rows: int, k: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> list[np.ndarray]:
    """Centroids of each half, from about ``sample_rows`` vectors taken by a hash."""
    share = min(1.0, sample_rows / max(1, rows))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = materialize(sample, "sample")
    if not sample.limit(1).count():
        sample = vectors
    half = F.floor(F.size("vector") / 2).cast("int")
    parts = (F.slice("vector", 1, F.greatest(half, F.lit(1))), F.slice("vector", half + 1, F.size("vector")))
    books = []
    for part in parts:
        data = materialize(sample.select(array_to_vector(part).alias("features")), "half")
        centers = KMeans(k=k, seed=7, maxIter=12, initMode="random").fit(data).clusterCenters()
        books.append(np.array(centers))
    return books


def _halves(matrix: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves; of vectors of one number both are that number."""
    half = matrix.shape[1] // 2
    return matrix[:, : max(1, half)], matrix[:, half:]


def assign(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``id``, ``vector``, and the nearest centroid of each half, ``first`` and ``second``."""

    @F.pandas_udf("first int, second int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix, out = np.vstack(batch.to_list()) if len(batch) else np.zeros((0, 2)), []
            for part, book in zip(_halves(matrix, books), books):
                out.append(((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1))
            yield pd.DataFrame({"first": out[0], "second": out[1]})

    return vectors.withColumn("cell", nearest("vector")).select("id", "vector", "cell.first", "cell.second")


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> dict[int, int]:
    """Cells in order of summed score until they hold ``wanted`` entries: bits of ``second`` by ``first``.

    ``first`` and ``second`` are a query's scores of the centroids. The heap starts at the best
    pair; a pair is followed by the next one of either half once its neighbours were taken.
    """
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap, seen, sets, held = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}, {}, 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            sets[a[i]] = sets.get(a[i], 0) | 1 << b[j]
            held += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                if (p == 0 or (p - 1, q) in seen) and (q == 0 or (p, q - 1) in seen):
                    seen.add((p, q))
                    heapq.heappush(heap, (-(x[p] + y[q]), p, q))
    return sets


def _traversal(queries: DataFrame, books: list[np.ndarray], counts: np.ndarray, wanted: int) -> DataFrame:
    @F.pandas_udf("array<struct<first:int,seconds:long>>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = np.vstack(batch.to_list()) if len(batch) else np.zeros((0, 2))
            one, two = (part @ book.T for part, book in zip(_halves(matrix, books), books))
            found = [visited(one[i], two[i], counts, wanted) for i in range(len(matrix))]
            yield pd.Series(
                [[(f, int(np.uint64(bits).astype(np.int64))) for f, bits in x.items()] for x in found]
            )

    return queries.select("id", "vector", F.explode(cells("vector")).alias("c")).select(
        "id", "vector", "c.first", "c.seconds"
    )


def _rerank(k: int):
    def rerank(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(entries) or not len(queries):
            return empty
        entries = entries.sort_values("id", kind="stable")
        ids, matrix = entries.id.to_numpy(), np.vstack(entries.vector.to_list())
        bit = np.uint64(1) << entries.second.to_numpy().astype(np.uint64)
        own, asked = queries.id.to_numpy(), np.vstack(queries.vector.to_list())
        scores = asked @ matrix.T
        out = []
        for i, mask in enumerate(queries.seconds.to_numpy().astype(np.int64).view(np.uint64)):
            here = np.flatnonzero((bit & mask != 0) & (ids != own[i]))
            if len(here) > k:
                row = scores[i, here]
                here = here[row >= np.partition(row, len(row) - k)[len(row) - k] - _NEAR]
            exact = (matrix[here] * asked[i]).sum(axis=1)
            best = np.lexsort((ids[here], -exact))[:k]
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[here][best], "score": exact[best]}))
        return pd.concat(out) if out else empty

    return rerank


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    share: float = 0.5,
    centroids: int = CENTROIDS,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query.

    ``queries`` are rows like ``rows``. Candidates are all rows with another id, those of the
    cells visited until they hold ``share`` of all vectors (and ``k`` of them at least); 1 is an
    exact search. Ties go to the smaller id. Queries that take no part have no result. What takes
    part is said at ``valid_vectors``.
    """
    if not 1 <= centroids <= 64:
        raise ValueError("centroids must be from 1 to 64")
    vectors = valid_vectors(rows, id_column, vector)
    n = vectors.count()
    asked = valid_vectors(queries, id_column, vector)
    if not n:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"),
                            F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    books = codebooks(vectors, n, centroids)
    entries = materialize(assign(vectors, books), "entries")
    cells = entries.groupBy("first", "second").count().collect()  # a row for each pair at most
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for cell in cells:
        counts[cell.first, cell.second] = cell["count"]
    wanted = max(int(np.ceil(share * n)), min(k + 1, n))

    blocks = [(i, int(c)) for i, c in enumerate(-(-counts.sum(axis=1) // BLOCK_ROWS)) if c]
    splits = F.create_map(*[F.lit(x) for pair in blocks for x in pair])
    parts = -(-asked.count() // BLOCK_ROWS) or 1
    every_part = F.sequence(F.lit(0), F.lit(parts - 1))
    entry_rows = entries.select(
        "first", "second", "id", "vector",
        F.pmod(F.xxhash64("id", "vector"), splits[F.col("first")]).cast("int").alias("split"),
        F.explode(every_part).alias("part"),
    )
    query_rows = _traversal(asked, books, counts, wanted).select(
        "first", "seconds", "id", "vector",
        F.explode(F.sequence(F.lit(0), splits[F.col("first")] - 1)).alias("split"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
    )
    group = ("first", "split", "part")
    found = (
        entry_rows.groupBy(*group)
        .cogroup(query_rows.groupBy(*group))
        .applyInPandas(_rerank(k), FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
