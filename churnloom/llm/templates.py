"""Line deduplication with a log-template tree.

A line's way through the tree is fixed: its token count, then its leading tokens, where tokens
with a digit are one variable token. A leaf holds the templates of its lines. A line joins the
template with which it agrees at most positions if they are a share ``similar`` of all, and
positions where they differ become variable; otherwise it starts a template. Lines whose
template occurs in ``min_docs`` different documents are dropped, whatever their share of a document.

Spark counts and hashes all lines; only distinct lines of leaves with two or more different
lines are parsed, a leaf in one task. A line that occurs in a third of all documents is one row
there. Beyond ``SHARD`` templates a leaf looks its candidates up by pieces of the line: the
positions are dealt to one piece more than two similar lines may differ in, so these share one.

Documents that hold the same templates in the same places, from first line to last, are copies
and count as one, so copies alone make no line recur. A document that has a copy and of which all
lines recur is left whole, for the stages that handle copies; any other one loses all these lines.

A line of ``long_tokens`` tokens or more that fewer documents share, but at least two, stays in one
of them and is dropped in the others: always the one with the smallest layout, so that documents
that share most of their lines do not lose them all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.tables import fresh, keyed, materialize, text_or_empty

VARIABLE = "<*>"
SHARD = 256
_SEED = 42
_DIGIT = re.compile("[0-9]")
LINES = "doc string, whole long, pos int, line_id long, leaf long, n_tokens int"


def masked(line: str) -> list[str]:
    """Tokens of a line, those with a digit as ``<*>``."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _hash(text: str) -> int:
    """The signed XXH64 that Spark's ``xxhash64`` gives a text."""
    h = xxhash.xxh64_intdigest(text.encode(), _SEED)
    return h - (1 << 64) if h >> 63 else h


def lines(docs: DataFrame, key: str, text: str, depth: int, with_line: bool = False) -> DataFrame:
    """A row for each line with a token: document key, hash of its text, position, hash, leaf, tokens; or leaf, hash, masked line."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs_, wholes, places, ids, leaves, counts, texts = [], [], [], [], [], [], []
            for doc, value in zip(batch.doc, batch.text):
                of_text = _hash(value or "")
                for pos, line in enumerate((value or "").split("\n")):
                    if tokens := masked(line):
                        whole = " ".join(tokens)
                        leaves.append(_hash(f"{len(tokens)} {' '.join(tokens[:depth])}"))
                        ids.append(_hash(whole))
                        if with_line:
                            texts.append(whole)
                        else:
                            docs_.append(doc)
                            wholes.append(of_text)
                            places.append(pos)
                            counts.append(len(tokens))
            ids, leaves = np.array(ids, np.int64), np.array(leaves, np.int64)
            if with_line:
                yield pd.DataFrame({"leaf": leaves, "line_id": ids, "line": pd.Series(texts, dtype=object)})
            else:
                yield pd.DataFrame({
                    "doc": pd.Series(docs_, dtype=object), "whole": np.array(wholes, np.int64),
                    "pos": np.array(places, np.int32), "line_id": ids, "leaf": leaves,
                    "n_tokens": np.array(counts, np.int32),
                })

    schema = "leaf long, line_id long, line string" if with_line else LINES
    return docs.select(F.col(key).alias("doc"), text_or_empty(text).alias("text")).mapInPandas(split, schema)


class Leaf:
    """Templates of one leaf, as rows of token numbers; 0 is a variable position."""

    def __init__(self, similar: float, shard: int = SHARD) -> None:
        self.similar, self.shard, self.words = similar, shard, {VARIABLE: 0}
        self.rows = np.zeros((0, 0), np.int64)
        self.names = [VARIABLE]
        self.count = 0
        self.by_piece: dict[tuple[int, bytes], list[int]] = {}

    def add(self, line: str) -> int:
        """Number of the template that the line joins or starts."""
        ids = []
        for word in line.split(" "):
            if word not in self.words:
                self.words[word] = len(self.names)
                self.names.append(word)
            ids.append(self.words[word])
        row = np.array(ids, np.int64)
        near = self._candidates(row)
        if len(near):
            agree = (self.rows[near] == row).sum(axis=1)
            first = int(agree.argmax())
            if agree[first] >= self.similar * len(row):
                best = int(near[first])
                if agree[first] < len(row):
                    self.rows[best, self.rows[best] != row] = 0
                    self._index(best)
                return best
        if self.count == len(self.rows):
            grown = np.zeros((max(4, 2 * self.count), len(row)), np.int64)
            if self.count:
                grown[: self.count] = self.rows
            self.rows = grown
        self.rows[self.count] = row
        self.count += 1
        if self.count == self.shard + 1:
            for n in range(self.count):
                self._index(n)
        else:
            self._index(self.count - 1)
        return self.count - 1

    def _pieces(self, row: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Parts of a row, of which two rows that are similar have at least one in common."""
        n = len(row) - math.ceil(self.similar * len(row)) + 1
        return ((i, row[i::n].tobytes()) for i in range(n))

    def _index(self, n: int) -> None:
        """Lists template ``n`` by its pieces; those that it had before only add candidates."""
        if self.count > self.shard:
            for piece in self._pieces(self.rows[n]):
                held = self.by_piece.setdefault(piece, [])
                if not held or held[-1] != n:
                    held.append(n)

    def _candidates(self, row: np.ndarray) -> np.ndarray:
        """Numbers of the templates that may be similar to the row, in order."""
        if self.count <= self.shard:
            return np.arange(self.count)
        found = set().union(*(self.by_piece.get(piece, ()) for piece in self._pieces(row)))
        return np.array(sorted(found), np.int64)

    def template(self, n: int) -> str:
        return " ".join(self.names[i] for i in self.rows[n])


def parse_templates(found: DataFrame, similar: float = 0.8, shard: int = SHARD) -> DataFrame:
    """``line_id`` and ``template_id`` of distinct lines (``leaf``, ``line_id``, ``line``).

    Lines that are alone in their leaf need not be in it: they are their own template. Each leaf is
    parsed whole and in the order of its lines, so the result does not depend on ``shard``, the
    number of templates from which on they are looked up by pieces.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaf, members = None, Leaf(similar, shard), []

        def done() -> pd.DataFrame:
            ids = [_hash(leaf.template(n)) for n in range(leaf.count)]
            return pd.DataFrame({
                "line_id": np.array([line_id for line_id, _ in members], np.int64),
                "template_id": np.array([ids[n] for _, n in members], np.int64),
            })

        for batch in batches:
            for of_leaf, line_id, line in zip(batch.leaf, batch.line_id, batch.line):
                if of_leaf != at:
                    if members:
                        yield done()
                    at, leaf, members = of_leaf, Leaf(similar, shard), []
                members.append((line_id, leaf.add(line)))
        if members:
            yield done()

    dealt = found.repartition("leaf").sortWithinPartitions("leaf", "line")
    parsed = dealt.select("leaf", "line_id", "line").mapInPandas(parse, "line_id long, template_id long")
    return materialize(parsed, "templates")


def recurring_lines(
    docs: DataFrame,
    key: str,
    text: str = "text",
    min_docs: int = 5,
    depth: int = 3,
    similar: float = 0.8,
    long_tokens: int = 20,
) -> DataFrame:
    """``doc`` (the key) and ``drop``: positions of the lines to drop, for documents that lose any."""
    table = materialize(lines(docs, key, text, depth), "lines")
    mixed = materialize(
        table.groupBy("leaf")
        .agg(F.min("line_id").alias("a"), F.max("line_id").alias("b"))
        .where("a <> b")
        .select("leaf"),
        "leaves",
    )
    # Always by shuffle: how many leaves are mixed follows the number of lines.
    texts = lines(docs, key, text, depth, with_line=True).join(mixed.hint("merge"), "leaf", "left_semi")
    distinct = materialize(texts.distinct(), "distinct")
    parsed = parse_templates(distinct, similar)
    placed = table.join(parsed, "line_id", "left").select(
        "doc", "whole", "pos", F.coalesce("template_id", "line_id").alias("template_id"),
        (F.col("n_tokens") >= long_tokens).alias("long"),
    )
    placed = materialize(placed, "placed")
    texts = materialize(placed.select("whole", "pos", "template_id", "long").distinct(), "texts")
    # Copies have one layout: a hash of all places and their templates.
    layouts = materialize(
        texts.groupBy("whole").agg(
            F.bit_xor(F.xxhash64("pos", "template_id")).alias("layout"), F.count("*").alias("lines")
        ),
        "layouts",
    )
    held = texts.join(layouts, "whole").select("template_id", "long", "layout").distinct()
    shared = materialize(
        held.groupBy("template_id", "long").agg(F.count("*").alias("n"), F.min("layout").alias("first"))
        .where((F.col("n") >= min_docs) | F.col("long") & (F.col("n") > 1)),
        "shared",
    )
    recurring = shared.where(F.col("n") >= min_docs).select("template_id")
    passages = shared.where(F.col("n") < min_docs).select("template_id", "first")
    copied = (
        placed.groupBy("whole").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
        .join(layouts, "whole").groupBy("layout").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .where("a <> b").select("layout")
    )
    lost = texts.join(recurring, "template_id", "left_semi").groupBy("whole").agg(F.count("*").alias("lost"))
    all_lost = lost.join(layouts, "whole").where("lost = lines")
    kept = materialize(all_lost.join(copied, "layout", "left_semi").select("whole"), "kept")
    everywhere = placed.join(recurring, "template_id", "left_semi").join(kept, "whole", "left_anti")
    elsewhere = placed.join(passages, "template_id").join(layouts, "whole").where("layout <> first")
    dropped = everywhere.select("doc", "pos").union(elsewhere.select("doc", "pos"))
    return materialize(dropped.groupBy("doc").agg(F.collect_set("pos").alias("drop")), "dropped")


def drop_recurring_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", **settings
) -> tuple[DataFrame, str]:
    """``docs`` with the lines of recurring templates taken out of ``text``; and a column's name.

    The named column holds the number of dropped lines. Lines end at line feeds; the lines left
    are joined by them again. Lines without a token are never dropped. Null texts stay null, empty
    texts empty. Rows that are equal in id and text count as one document and lose the same lines.
    All other columns stay as they are; an empty table gives an empty result.
    """
    named, key = keyed(docs, id_column, text)
    gone = recurring_lines(named, key, text, **settings).withColumnRenamed("doc", key)
    drop, count = fresh(named, "dropped_positions"), fresh(docs, "n_dropped")
    joined = named.join(gone.withColumnRenamed("drop", drop), key, "left")
    parts = F.filter(
        F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(F.col(drop), i)
    )
    kept = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(parts, "\n"))
    n = F.coalesce(F.size(F.array_distinct(drop)), F.lit(0)).cast("long")
    n = F.when(F.col(drop).isNull(), F.lit(0).cast("long")).otherwise(n)
    columns = [kept.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, n.alias(count)), count


def without_recurring_lines(docs: DataFrame, **settings) -> DataFrame:
    """As ``drop_recurring_lines``, with the columns of ``docs`` alone."""
    cleaned, count = drop_recurring_lines(docs, **settings)
    return cleaned.drop(count)
