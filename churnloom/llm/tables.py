"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.sources.storage import materialize

__all__ = ["fresh", "keyed", "materialize", "read", "short_batches", "text_or_empty"]

#: Rows and bytes that a task hands to Python at a time.
_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_2``, ``name_3`` ... that no column has."""
    taken = {column.lower() for column in df.columns}
    tried, n = name, 1
    while tried.lower() in taken:
        n += 1
        tried = f"{name}_{n}"
    return tried


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Rows with a key column made of the id and two hashes of the text; and its name.

    Equal rows share a key, null ids and null texts have one too, and a third of all rows
    with one id still spread over as many keys as they have texts.
    """
    name = fresh(docs, "row_key")
    key = F.concat_ws(
        ":",
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")),
        F.hex(F.xxhash64(text_or_empty(text))),
        F.hex(F.crc32(text_or_empty(text).cast("binary"))),
        F.col(text).isNull().cast("string"),
    )
    return docs.withColumn(name, key), name


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside hand whole texts to Python in batches of bounded size.

    A batch of 10,000 texts, the default, is held several times over: as Arrow columns and as a message
    outside of the JVM's heap, and as a message and as objects in Python. The session's own bounds
    come back when the block ends.
    """
    before = {key: spark.conf.get(key, None) for key in _BATCH}
    try:
        for key, value in _BATCH.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
