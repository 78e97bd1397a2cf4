"""SimHash fingerprints linked by ball hashing that meets in the middle.

Two fingerprints at 3 or fewer differing bits meet on one shared variant when one of them
flips at most one bit and the other at most two. Every distinct fingerprint emits its
variants, the variants are the shuffle key, and a variant's owners become a star:

* *hub* variants flip 0 or 1 bit, so two owners of a hub variant differ in 2 bits at most;
* *arm* variants flip 2 bits. At distance 3 the two fingerprints have different bit
  parity, and two of the three bits lie in the same half of the word. So only
  fingerprints of even parity emit arms, and only pairs of bits inside one half.

An arm is linked only to a hub of the same variant, never to another arm (those may be 4
bits apart). Links go to the smallest hub, so a variant with ``n`` owners gives ``n - 1``
links and a group of copies never becomes all of its pairs; a variant has at most 2,081
owners. Equal fingerprints are one node.

Emitting the full ball for every fingerprint would shuffle about a thousand rows for each.
Two fingerprints within 3 bits also have a half of 32 bits within 1 bit, so a first, narrow
round of the same scheme on halves (64 variants) finds the fingerprints that can have a
partner at all; only those emit the full ball. Nothing is lost by this.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.llm.components import component_labels
from churnloom.llm.tables import fresh, materialize

HASH_SEED = 42
MAX_RADIUS = 3
_CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text, as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    total = len(words) - size + 1
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in spans), np.uint64, total
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, total, _CHUNK):
        octets = hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | Column, shingle: int = 3) -> Column:
    """Fingerprint of a text column as a signed long; null counts as empty."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        values = np.fromiter((simhash(x, shingle) for x in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return prints(F.col(text) if isinstance(text, str) else text)


def _flip(value: Column, *bits: Column) -> Column:
    for bit in bits:
        value = value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return value


def _range(first: int, last: int) -> Column:
    return F.sequence(F.lit(first), F.lit(last))


def _may_have_partner(nodes: DataFrame) -> DataFrame:
    """Fingerprints of which a half is within one bit of another fingerprint's half."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = nodes.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("half"), low.alias("value")),
                F.struct(F.lit(1).alias("half"), high.alias("value")),
            )
        ).alias("h"),
    ).select("fp", "h.half", "h.value")
    known = materialize(halves.groupBy("half", "value").agg(F.count("*").alias("n")), "halves")
    flipped = halves.select(
        "fp",
        "half",
        F.explode(
            F.transform(_range(0, 31), lambda bit: _flip(F.col("value"), bit))
        ).alias("value"),
    )
    # The rows made by explode are many more than Spark expects of the small table below them.
    near = flipped.join(known.select("half", "value").hint("merge"), ["half", "value"], "left_semi")
    same = halves.join(known.where("n > 1").select("half", "value"), ["half", "value"], "left_semi")
    return near.select("fp").unionByName(same.select("fp")).distinct()


def _hubs(nodes: DataFrame, flips: int) -> DataFrame:
    fp = F.col("fp")
    variants = F.array(fp)
    if flips:
        variants = F.concat(variants, F.transform(_range(0, 63), lambda bit: _flip(fp, bit)))
    return nodes.select("fp", F.explode(variants).alias("variant"))


def _arms(nodes: DataFrame, flips: int) -> DataFrame:
    fp = F.col("fp")
    even = nodes.where((F.bit_count(fp) % 2) == 0)
    if flips == 1:
        variants = F.transform(_range(0, 63), lambda bit: _flip(fp, bit))
    else:
        variants = F.flatten(
            F.transform(
                F.filter(_range(0, 62), lambda a: a != 31),
                lambda a: F.transform(
                    F.sequence(a + 1, F.when(a < 32, 31).otherwise(63)),
                    lambda b: _flip(fp, a, b),
                ),
            )
        )
    return even.select("fp", F.explode(variants).alias("variant"))


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (``a`` < ``b``) that join exactly the fingerprints within ``radius`` bits.

    ``nodes`` holds distinct fingerprints in ``fp``. The links are a subset of all near
    pairs with the same connected components.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"radius must be from 0 to {MAX_RADIUS}")
    live = materialize(_may_have_partner(nodes), "live")
    hubs = _hubs(live, radius // 2)
    owners = hubs if radius % 2 == 0 else hubs.unionByName(_arms(live, (radius + 1) // 2))
    star = hubs.groupBy("variant").agg(F.min("fp").alias("hub"))
    return (
        owners.hint("merge").join(star, "variant")
        .where((F.col("fp") != F.col("hub")))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius)
        .select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    radius: int = 3,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``id_column``, ``fp``, ``component_id`` and ``cluster``: one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of ``radius`` bits, the row's
    own included; ``cluster`` is the smallest fingerprint of the component. Null and empty
    texts, and texts of white space, have the fingerprint zero and are linked like any
    other. Repeated rows give repeated result rows. Null ids are never a component's
    smallest id while it has another; a component of null ids has a null one. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = materialize(
        docs.select(F.col(id_column).alias("id"), fingerprint(text, shingle).alias("fp")),
        "fingerprints",
    )
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    labels = component_labels(links(nodes.select("fp"), radius))
    members = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("cluster")
    )
    members = materialize(members, "members")
    smallest = members.groupBy("cluster").agg(F.min("first_id").alias("component_id"))
    known = materialize(members.join(smallest, "cluster").drop("first_id"), "clusters")
    return rows.join(known, "fp").select(
        F.col("id").alias(id_column), "fp", "component_id", "cluster"
    )


def keep_one(
    docs: DataFrame,
    shingle: int = 3,
    radius: int = 3,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that with the smallest id.

    All columns stay as they are. Of repeated rows with that id the one with the smallest
    text hash stays; of a component of null ids, one row.
    """
    print_, cluster, rank = (fresh(docs, x) for x in ("print_of_row", "cluster_of_row", "rank"))
    found = near_duplicates(docs, shingle, radius, id_column, text)
    kept = materialize(
        found.where(F.col(id_column).eqNullSafe(F.col("component_id")))
        .groupBy("cluster")
        .agg(F.min("fp").alias("fp"), F.min("component_id").alias("id")),
        "kept",
    )
    key = fresh(docs, "id_key")
    as_key = lambda column: F.coalesce(column.cast("string"), F.lit("null"))
    named = docs.withColumn(key, as_key(F.col(id_column)))
    with_id = named.join(
        kept.where("id is not null").select(as_key(F.col("id")).alias(key)), key, "left_semi"
    )
    window = _first_by(key, text, rank)
    chosen = window(with_id)
    lost = kept.where("id is null").select(F.col("fp").alias(print_))
    nameless = (
        docs.where(F.col(id_column).isNull())
        .withColumn(print_, fingerprint(text, shingle))
        .join(lost, print_, "left_semi")
    )
    nameless = _first_by(print_, text, rank)(nameless)
    return chosen.select(*docs.columns).unionByName(nameless.select(*docs.columns))


def _first_by(key: str, text: str, rank: str):
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.xxhash64(text), F.length(text))
    return lambda df: df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
