"""Near-duplicates by min-max hashing of word shingles.

Every permutation of the shingle hashes is evaluated once and gives two signature values, the
minimum and the maximum, so a signature needs half the evaluations of plain MinHash. Each value
matches between two sets with their Jaccard similarity J; the two of one permutation match
together with (I / U) * ((I - 1) / (U - 1)), a little below J^2, and so the estimate has a lower
variance than that of as many separate permutations.

A band is ``permutations`` permutations, both ends of each. At J = 0.8 the 28 bands of 2 miss a
pair with a probability of 4e-7 (4e-6 for sets of 5 shingles, the smallest with partners that
differ), and more similar pairs far less. Every candidate is confirmed on the full sets of
64-bit shingle hashes.

Texts with equal sets are one node, however many they are. Members of a bucket are not paired with
each other: at first every node is held against the smallest one that it shares a bucket with,
which makes one component of most groups. From then on only buckets that several components share
go on, and only pairs of different components are looked at. Shingles that no other of these
documents has cannot be shared, so those with too many of their own, such as documents around a
long passage that many share, go first. In a bucket of a few members all pairs that are left are
compared. In a crowded one all are held against the smallest, the hub. Two members that both are
similar to it are in its component; if one is not, it must share some of its differences from the
hub with the other, and these, mostly rare, bring the pairs together. So no link between components
is lost, and a group of copies never becomes all of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnloom.llm.components import component_labels
from churnloom.llm.tables import materialize, short_batches, text_or_empty

BANDS = 28
PERMUTATIONS = 2
SEED = 11
#: Members that are held against one hub in one task.
SHARD = 512
#: Members of a bucket of which all pairs of different components are looked at.
SMALL = 24
#: Rounds of leaving out nodes that can have no partner; they save work and change no result.
PEELS = 3
#: Characters of text whose words are held as Python objects at a time.
_TEXTS = 1 << 20
_CHUNK = 1 << 15
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
SIGNED = "n long, set_key binary, bands array<long>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in portions of bounded length; a longer text is one of its own."""
    portion, held = [], 0
    for text in texts:
        if portion and held + len(text) > _TEXTS:
            yield portion
            portion, held = [], 0
        portion.append(text)
        held += len(text)
    if portion:
        yield portion


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; an empty array without words."""
    words = [text.encode().lower().split() for text in texts]  # bytes: ASCII only
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = [word for found in words for word in found]
    code, kinds = pd.factorize(flat)
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in kinds), np.uint64, len(kinds))
    hashes, out, at = known[code], [], 0
    for found in words:
        own = hashes[at : at + len(found)]
        at += len(found)
        size = min(shingle, len(own))
        if not size:
            out.append(own)
            continue
        # The number of words goes in, so that a short text equals no shingle of a longer one.
        joined = np.full(len(own) - size + 1, size, np.uint64)
        for i in range(size):
            joined = _mixed(joined * _FIRST + own[i : i + len(joined)] * _SECOND)
        out.append(np.unique(joined))
    return out


class MinMax:
    """Minimum and maximum of each set under random permutations, banded."""

    def __init__(self, bands: int, permutations: int) -> None:
        rng = np.random.default_rng(SEED)
        total = bands * permutations
        self.bands, self.permutations = bands, permutations
        self.factor = rng.integers(1, 1 << 63, total, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, total, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Minima and maxima, a row for each of the sets, none of which is empty."""
        sizes = np.array([len(s) for s in sets], np.int64)
        low = np.full((len(sets), len(self.factor)), np.uint64(0xFFFFFFFFFFFFFFFF))
        high = np.zeros_like(low)
        flat = np.concatenate(sets)
        ends = np.cumsum(sizes)
        for at in range(0, len(flat), _CHUNK):
            part = flat[at : at + _CHUNK]
            first = int(np.searchsorted(ends, at, "right"))
            last = int(np.searchsorted(ends, at + len(part), "left"))
            begins = np.maximum(ends[first : last + 1] - sizes[first : last + 1] - at, 0)
            for p, (factor, shift) in enumerate(zip(self.factor, self.shift)):
                moved = part * factor + shift
                own = slice(first, last + 1)
                low[own, p] = np.minimum(low[own, p], np.minimum.reduceat(moved, begins))
                high[own, p] = np.maximum(high[own, p], np.maximum.reduceat(moved, begins))
        return low, high

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """One 64-bit key for each set and band."""
        low, high = self.signatures(sets)
        band = np.arange(1, self.bands + 1, dtype=np.uint64)
        key = np.broadcast_to(band, (len(sets), self.bands))
        for p in range(self.permutations):
            for ends in (low, high):
                key = _mixed(key * _FIRST + ends[:, p :: self.permutations])
        return key


def _signed(text: str, shingle: int, bands: int, permutations: int) -> Column:
    hashing = MinMax(bands, permutations)

    @F.pandas_udf(SIGNED)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sizes, digests, keys = [], [], []
            for portion in _portions(list(texts)):
                sets = shingle_sets(portion, shingle)
                found = iter(hashing.keys(filled) if (filled := [s for s in sets if len(s)]) else ())
                sizes += map(len, sets)
                digests += [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                keys += [next(found).view(np.int64) if len(s) else None for s in sets]
            yield pd.DataFrame({"n": sizes, "set_key": digests, "bands": keys})

    return sign(text)


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``node``, ``n`` and the sorted shingle hashes of each text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = iter(batch.node)
            for portion in _portions(list(batch.text)):
                found = shingle_sets(portion, shingle)
                hashes = [s.view(np.int64) for s in found]
                yield pd.DataFrame({"node": [next(nodes) for _ in found], "n": list(map(len, found)), "hashes": hashes})

    return rows.mapInPandas(find, "node long, n long, hashes array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Both sets of the written, distinct pairs (``hub``, ``node``).

    A hub with many members is held against them in several tasks.
    """
    shards = F.ceil(F.count("*") / SHARD).cast("int")
    hubs = materialize(pairs.groupBy("hub").agg(shards.alias("shards")), "hubs")
    hub_sets = sets.join(hubs.hint("merge"), sets.node == hubs.hub).select(
        "hub",
        F.col("n").alias("hub_n"),
        F.col("hashes").alias("hub_hashes"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
    )
    dealt = pairs.join(hubs.hint("merge"), "hub").select(
        "hub", "node", F.pmod(F.xxhash64("node"), "shards").cast("int").alias("shard")
    )
    return dealt.join(sets.hint("merge"), "node").join(hub_sets.hint("merge"), ["hub", "shard"])


def _similar(shared: Column, percent: int) -> Column:
    return shared * 100 >= percent * (F.col("n") + F.col("hub_n") - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) of the pairs that are similar enough."""
    shared = F.size(F.array_intersect("hashes", "hub_hashes"))
    return (
        _compared(pairs, sets)
        .where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
        .where(_similar(shared, percent))
        .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    )


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    shared = shared.where("hub < last").select("bucket", "hub")
    return materialize(exploded.join(shared.hint("merge"), "bucket"), "members")


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels with the ``found`` links added."""
    if labels is not None:
        known = labels.where("linked <> label").select(F.col("linked").alias("a"), F.col("label").alias("b"))
        found = known.unionByName(found)
    return component_labels(found).withColumnRenamed("node", "linked")


def _mixed_only(named: DataFrame) -> DataFrame:
    """Members of the buckets that several components share, with members, smallest node and size."""
    mixed = (
        named.groupBy("bucket")
        .agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.count("*").alias("members"),
            F.min("size").alias("least"),
            F.min(F.struct("node", "label", "size", "common")).alias("hub"),
        )
        .where(F.col("low") < F.col("high"))
    )
    kept = ["bucket", "members", "least", "hub"]
    return materialize(
        named.select("bucket", "node", "label", "size", "common").join(mixed.select(*kept).hint("merge"), "bucket"),
        "mixed",
    )


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Mixed buckets of the members by the labels so far."""
    named = members.join(labels.hint("merge"), members.node == labels.linked, "left").select(
        "bucket", "node", "size", "common", F.coalesce("label", "node").alias("label")
    )
    return _mixed_only(materialize(named, "named"))


def _sized(members: DataFrame, sets: DataFrame) -> DataFrame:
    sizes = sets.select("node", F.col("n").alias("size"))
    return members.select("bucket", "node").join(sizes.hint("merge"), "node").withColumn("common", F.col("size"))


def _fits(size, common, other_size, other_common, percent: int) -> Column:
    """Whether two sets can be similar: they share what both have in common with others at most."""
    shared = F.least(common, other_common)
    return shared * 100 >= percent * (size + other_size - shared)


def _peeled(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Mixed buckets without the nodes that can be similar to no other in them.

    A shingle that only one of the nodes has is shared with none. So a node whose edits, or whose
    own text around a shared passage, leave too few others for the smallest set of its bucket goes
    before any pair is looked at. What goes may leave others without a partner, hence the rounds.
    """
    for _ in range(PEELS):
        nodes = mixed.select("node").distinct()
        chosen = sets.join(nodes.hint("merge"), "node", "left_semi")
        alone = (
            chosen.select("node", F.explode("hashes").alias("hash"))
            .groupBy("hash").agg(F.count("*").alias("nodes"), F.min("node").alias("node"))
            .where("nodes = 1").groupBy("node").agg(F.count("*").alias("alone"))
        )
        known = mixed.drop("common").join(materialize(alone, "alone").hint("merge"), "node", "left")
        known = known.withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0)))
        fits = F.col("common") * 100 >= percent * (F.col("size") + F.col("least") - F.col("common"))
        kept = _mixed_only(materialize(known.where(fits), "peeled"))
        before, after = mixed.count(), kept.count()
        mixed = kept
        if after > 0.9 * before:
            break
    return mixed


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    pairs = pairs.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
    return materialize(pairs.distinct(), "pairs")


def _small_pairs(small: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components, in buckets of bounded size, that can be similar."""
    names = ("node", "label", "size", "common")
    other = small.select("bucket", *(F.col(c).alias(f"hub_{c}") for c in names))
    fits = _fits(*(F.col(c) for c in ("size", "common", "hub_size", "hub_common")), percent)
    joined = small.join(other.hint("merge"), "bucket").where(F.col("node") > F.col("hub_node"))
    return joined.where((F.col("label") != F.col("hub_label")) & fits).select(F.col("hub_node").alias("hub"), "node")


def _differences(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each hub and member: whether they are similar, and the hashes that only one has; written.

    The ``delta`` has what the member adds first, which is rarer than what it lacks.
    """
    pairs = crowded.select(F.col("hub.node").alias("hub"), "node").where("hub <> node").distinct()
    both = _compared(materialize(pairs, "pairs"), sets)
    added, lost = F.array_except("hashes", "hub_hashes"), F.array_except("hub_hashes", "hashes")
    return materialize(
        both.select("hub", "node", "n", "hub_n", added.alias("added"), lost.alias("lost")).select(
            "hub", "node", "n", "hub_n",
            _similar(F.col("n") - F.size("added"), percent).alias("similar"),
            F.concat("added", "lost").alias("delta"),
        ),
        "differences",
    )


def _across(differences: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links of members of one hub that are in different components.

    Sets x and y are similar if x and y differ in at most r (|x| + |y|) hashes, with r =
    (100 - percent) / (100 + percent). What they differ in is what their differences from the hub
    do not share. If x is not similar to the hub, they must share more than z = (|delta y| +
    r (|hub| - |y|)) / 2 hashes of these. So one of them is among any |delta y| - floor(z) of y's:
    x looks for all of its own among the rarest ones, by the members of the hub that differ in them.
    The first hash that both have, in that order, leaves them at most as many more as the shorter
    rest after it; with too few the pair goes. The others are settled by the differences alone,
    which tell in how many hashes the full sets differ.
    """
    named = differences.join(labels.hint("merge"), differences.node == labels.linked, "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    m, apart, whole = F.size("delta"), 100 - percent, 100 + percent
    needed = F.greatest(F.lit(0), m * whole + (F.col("hub_n") - F.col("n")) * apart)
    every = named.select(
        "hub", "node", "n", "similar", "label", m.alias("m"),
        (m - F.floor(needed / F.lit(2 * whole))).cast("int").alias("first"),
        F.explode("delta").alias("hash"),
    )
    # What only members of one component differ in is shared by no pair that is looked for, however many
    # they are; it comes first in every order. Counted beside the rows, in one shuffle.
    alike = Window.partitionBy("hub", "hash")
    mine = Window.partitionBy("hub", "node")
    met = materialize(
        every.withColumn("holders", F.count("*").over(alike))
        .withColumn("low", F.min("label").over(alike))
        .withColumn("high", F.max("label").over(alike))
        .where("low < high")
        .drop("low", "high")
        .withColumn("met", F.count("*").over(mine))
        .withColumn("place", F.row_number().over(mine.orderBy("holders", "hash")))
        .withColumn("rest", F.col("met") - F.col("place") + 1),
        "met",
    )
    index = met.where(F.col("place") + F.col("m") - F.col("met") <= F.col("first")).select(
        "hub", "hash", *(F.col(c).alias(f"other_{c}") for c in ("node", "label", "n", "m", "rest"))
    )
    probe = met.where("not similar").select("hub", "hash", "node", "label", "n", "m", "rest")
    least = (F.col("m") + F.col("other_m")) * whole - (F.col("n") + F.col("other_n")) * apart
    pairs = (
        probe.join(index.hint("merge"), ["hub", "hash"])
        .where((F.col("node") != F.col("other_node")) & (F.col("label") != F.col("other_label")))
        .where(F.least("rest", "other_rest") * (2 * whole) >= least)
        .select("hub", F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))
    )
    # Members of several hubs are settled at one of them.
    pairs = materialize(pairs.groupBy("a", "b").agg(F.min("hub").alias("hub")), "pairs")
    shared = materialize(
        met.groupBy("hub", "node", "n", "m").agg(F.array_sort(F.collect_list("hash")).alias("met")), "shared"
    )
    one = shared.select("hub", F.col("node").alias("a"), "n", "m", "met")
    other = shared.select("hub", F.col("node").alias("b"), *(F.col(c).alias(f"other_{c}") for c in ("n", "m", "met")))
    return (
        pairs.join(one.hint("merge"), ["hub", "a"])
        .join(other.hint("merge"), ["hub", "b"])
        .where(F.size(F.array_intersect("met", "other_met")) * (2 * whole) >= least)
        .select("a", "b")
    )


def _labels(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``linked`` and ``label`` of the nodes with links, of all similar pairs within buckets.

    ``members`` has ``bucket``, ``node`` and the bucket's smallest node, ``hub``.
    """
    nearest = members.groupBy("node").agg(F.min("hub").alias("hub")).where("hub < node")
    labels = _merged(None, _confirmed(_ordered_pairs(nearest), sets, percent))
    mixed = _peeled(_named(_sized(members, sets), labels), sets, percent)
    crowded = F.col("members") > SMALL
    pairs = _small_pairs(mixed.where(~crowded), percent)
    differences = _differences(mixed.where(crowded), sets, percent)
    stars = differences.where("similar").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    found = _confirmed(_ordered_pairs(pairs), sets, percent).unionByName(stars)
    labels = _merged(labels, materialize(found, "links"))
    return _merged(labels, materialize(_across(differences, labels, percent), "links"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    permutations: int = PERMUTATIONS,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``id_column``, ``n_shingles``, ``component_id`` and ``kept``: one row for each row of ``docs``.

    Two texts are linked if their shingle sets have a Jaccard similarity of ``percent`` / 100 or
    more; ``component_id`` is the smallest id reachable over links, the row's own included, and
    ``kept`` tells whether that is the row's own. A text of fewer words than a shingle has its
    whole sequence as one; null texts, empty ones and those of white space have no shingle and are
    linked with nothing. Texts are taken whole, however long. Repeated rows give repeated result
    rows, all of them kept if one is; a null id is smallest only where no other is in its
    component. Other columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    value = text_or_empty(text)
    source = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(value).alias("a"),
        F.crc32(value.cast("binary")).alias("b"),
        value.alias("text"),
    )
    signed = _signed("text", shingle, bands, permutations)
    with short_batches(docs.sparkSession):
        rows = materialize(source.select("id", "a", "b", signed.alias("s")).select("id", "a", "b", "s.*"), "signed")
    nodes = materialize(
        rows.where("n > 0")
        .groupBy("set_key")
        .agg(
            F.min("id").alias("first_id"),
            F.min(F.struct("a", "b")).alias("one"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    members = _shared_buckets(nodes.select("node", "bands"))
    wanted = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select(
        "node", "one.*"
    )
    texts = source.select("a", "b", "text").join(wanted.hint("merge"), ["a", "b"])
    with short_batches(docs.sparkSession):
        sets = materialize(_sets(texts.dropDuplicates(["a", "b"]).select("node", "text"), shingle), "sets")
    labels = _labels(members, sets, percent)
    classes = materialize(
        nodes.join(labels.hint("merge"), nodes.node == labels.linked, "left").select(
            "set_key", "first_id", F.coalesce("label", "node").alias("class")
        ),
        "classes",
    )
    smallest = classes.groupBy("class").agg(F.min("first_id").alias("component_id"))
    known = materialize(classes.join(smallest.hint("merge"), "class").select("set_key", "component_id"), "known")
    found = rows.select("id", "n", "set_key").join(known.hint("merge"), "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
