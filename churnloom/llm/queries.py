"""One query for each operator of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.llm import (
    contamination,
    conversations,
    importance,
    minmax,
    mixing,
    multiindex,
    periods,
    pii,
    simhash,
    suffix,
    templates,
    toxicity,
    warc,
)
from churnloom.llm.oracle import MIXING_SQL
from churnloom.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op1_mixing": MIXING_SQL}


def _query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that token shares meet tempered source, language and topic targets."""
    drawn, names = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    whole = ("source", "lang", "topic", "tokens")
    return drawn.select(
        "doc_id",
        *[F.col(names[n]).alias(f"mix_{n}") for n in whole],
        *[F.round(names[n], 6).alias(n) for n in ("weight", "probability")],
    )


@_query
def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards those labelled as good; as many as the labels hold good ones."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return importance.resample(
        docs, labels.where("quality = 1"), importance.labelled_share(labels)
    )


@_query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@_query
def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped for a recurring template, and what stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned, count = templates.drop_recurring_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id",
        F.col(count).alias("n_dropped"),
        F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


@_query
def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeated(read(spark, sf_dir, "documents"), length=200))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op7_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each row whose id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    return multiindex.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), k=20)


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_query
def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


@_query
def op11_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


@_query
def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, after the contract has planted some."""
    docs = read(spark, sf_dir, "documents")
    return periods.digest(periods.periodic_runs(docs, text=periods.planted()))


@_query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of the conversations, after the contract has damaged some of their rows."""
    return conversations.repair_damaged(read(spark, sf_dir, "conversations"))
