"""Benchmark decontamination over sharded suffix arrays of the training words.

Each batch of documents is a shard. The shard's word sequence becomes an array of suffixes,
sorted by their first ``window`` words; every suffix of every benchmark item is searched in
it by bisection, which gives all places where the window occurs, and windows that follow each
other on both sides are joined to the longest verbatim match. Words are numbers of the
benchmark's vocabulary. A training suffix that starts with a word pair of no test suffix can
never match one, so it is left out before the sort; nothing else is.

Equal windows are searched once, so a place is found at most once for each size of a window, and
an item that repeats a window costs no more than one that has it once: a match goes on in its
item for as long as the item goes on with the same words, and else begins anew at the window's
first place there.

The benchmark is sent to the executors in blocks of a checked size. One block is one projection
without any shuffle. With more of them the driver holds one at a time, each has its own pass,
and what a pass finds is written and joined by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.llm.tables import fresh, materialize

#: Bytes of item text that one block sends to the executors.
BLOCK_BYTES = 32 << 20
#: Characters of text (one whole text at least) that make a shard.
SHARD_CHARS = 4 << 20

MATCHES = "array<struct<item:string,start:int,item_start:int,length:int>>"
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_KEEP).split()


class TestSuffixes:
    """Every different window of the items, as rows of word numbers in sorted order."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        rows, self.names, item = [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not ids:
                continue
            size = min(window, len(ids))
            begins = range(len(ids) - size + 1)
            rows += [ids[i : i + size] + [0] * (window - size) for i in begins]
            item += [len(self.names)] * len(begins)
            self.names.append(name)
        every = np.array(rows, ">u4").reshape(len(rows), window)
        _, first, kind = np.unique(_key(every), return_index=True, return_inverse=True)
        self.ids = every[first]
        self.size = (self.ids != 0).sum(axis=1)
        # All windows of all items in order: their item, and which different window they are.
        self.item, self.kind = np.array([*item, -1], np.int64), np.append(kind.reshape(-1), -1)
        self.begin = np.searchsorted(self.item[:-1], np.arange(len(self.names)))
        # The items that have a window, and its first place in each.
        pair, place = np.unique(self.kind[:-1] * max(1, len(self.names)) + self.item[:-1], return_index=True)
        owner = pair // max(1, len(self.names))
        self.first = place[np.lexsort((place, owner))]
        self.low = np.searchsorted(owner, np.arange(len(self.ids)), "left")
        self.high = np.searchsorted(owner, np.arange(len(self.ids)), "right")
        self.single = np.unique(self.ids[self.size == 1, 0]).astype(np.int64)
        paired = self.ids[self.size > 1].astype(np.int64)
        second = paired[:, 1] if window > 1 else paired[:, 0] * 0
        self.pairs = np.unique((paired[:, 0] << 32) | second)
        self.other = len(self.vocabulary) + 1


def _key(ids: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(ids).view(f"S{4 * ids.shape[1]}").ravel()


def _shard_matches(texts: list, tests: TestSuffixes) -> tuple[np.ndarray, list]:
    """Words of each text, and (text, word, window) of each place where a test window occurs."""
    get, other = tests.vocabulary.get, tests.other
    parts, counts = [], np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        ids = np.array([get(w, other) for w in words(text)], np.int64)
        counts[n] = len(ids)
        parts += [ids, np.zeros(tests.window, np.int64)]
    if not len(tests.ids) or not counts.any():
        return counts, []
    flat = np.concatenate(parts)
    begins = np.concatenate(([0], np.cumsum(counts + tests.window)[:-1]))
    pair = (flat[:-1] << 32) | flat[1:]
    may = _in_sorted(tests.pairs, pair)
    if len(tests.single):
        may |= _in_sorted(tests.single, flat[:-1])
    places = np.flatnonzero(may)
    if not len(places):
        return counts, []
    suffixes = flat[places[:, None] + np.arange(tests.window)].astype(">u4")
    keys = _key(suffixes)
    order = np.argsort(keys, kind="stable")
    array, places = keys[order], places[order]
    low = np.searchsorted(array, _key(tests.ids), "left")
    # A short item is a prefix: its upper end is the first suffix past every continuation.
    top = tests.ids.copy()
    top[np.arange(tests.window) >= tests.size[:, None]] = 0xFFFFFFFF
    high = np.searchsorted(array, _key(top), "right")
    found = np.flatnonzero(high > low)
    if not len(found):
        return counts, []
    reps = (high - low)[found]
    kind = np.repeat(found, reps)
    offset = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    place = places[np.repeat(low[found], reps) + offset]
    text = np.searchsorted(begins, place, "right") - 1
    return counts, [text, place - begins[text], kind]


def _in_sorted(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return values[at] == wanted


def _longest(counts: np.ndarray, found: list, tests: TestSuffixes) -> list[list[tuple]]:
    """Per text: (item, start, item_start, length), of windows that follow each other on both sides."""
    out: list[list[tuple]] = [[] for _ in counts]
    if not found:
        return out
    order = np.lexsort((found[1], found[0]))
    # By item: the open match (text, start, first and last window of the item, last place).
    open_: dict[int, list[int]] = {}

    def close(item: int) -> None:
        text, start, first, last, at = open_.pop(item)
        size = int(tests.size[tests.kind[last]])
        out[text].append((tests.names[item], start, first - int(tests.begin[item]), at + size - start))

    for text, at, kind in zip(*(x[order].tolist() for x in found)):
        for window in tests.first[tests.low[kind] : tests.high[kind]].tolist():
            item = int(tests.item[window])
            known = open_.get(item)
            if known and known[0] == text and known[4] == at - 1 and tests.item[known[3] + 1] == item:
                if tests.kind[known[3] + 1] == kind:
                    known[3], known[4] = known[3] + 1, at
                    continue
            if known:
                close(item)
            open_[item] = [text, at, window, window, at]
    for item in list(open_):
        close(item)
    for rows in out:
        rows.sort()
    return out


def _shards(texts: list) -> Iterator[list]:
    begin = chars = 0
    for n, text in enumerate(texts):
        chars += len(text or "")
        if chars >= SHARD_CHARS:
            yield texts[begin : n + 1]
            begin, chars = n + 1, 0
    yield texts[begin:]


def _search(tests: TestSuffixes, text: Column) -> Column:
    @F.pandas_udf(f"n_words long, matches {MATCHES}")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, found = [], []
            for shard in _shards(list(batch)):
                counts, places = _shard_matches(shard, tests)
                n_words += counts.tolist()
                found += _longest(counts, places, tests)
            yield pd.DataFrame({"n_words": n_words, "matches": found})

    return search(text)


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """The items in lists of at most ``block_bytes`` of text, one list on the driver at a time."""
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    count = int(size // block_bytes) + 1
    for n in range(count):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == n) if count > 1 else items
        rows = block.distinct().collect()
        yield sorted(((r.id, r.text) for r in rows if r.id is not None), key=str)


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of ``n_words`` and ``matches``.

    A match is a run of words that a document shares with an item, of ``window`` words at
    least, or a whole item of fewer words, followed for as long as both go on alike: item id,
    first word in the document, first word in the item, words. Null and empty texts have no words and no match; items
    without words or without an id match nothing; repeated rows are searched each. Texts are
    taken whole, however long or repetitive; an empty table has no rows. Columns that clash with
    the new one give it a number.
    """
    column = fresh(docs, "contamination")
    blocks = _blocks(items, item_id, item_text, block_bytes)
    first = TestSuffixes(next(blocks), window)
    second = next(blocks, None)
    if second is None:
        return docs.withColumn(column, _search(first, F.col(text))), column
    row, block_column = fresh(docs, "row"), fresh(docs, "block_matches")
    table = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    parts = []
    for block in chain([None, second], blocks):
        tests = first if block is None else TestSuffixes(block, window)
        part = table.select(row, _search(tests, F.col(text)).alias(block_column)).select(row, f"{block_column}.*")
        part = part if block is None else part.where(F.size("matches") > 0)
        parts.append(materialize(part, "matches"))
    counted = parts[0].select(row, "n_words")
    every = reduce(DataFrame.unionByName, [p.select(row, F.explode("matches").alias("match")) for p in parts])
    found = every.groupBy(row).agg(F.sort_array(F.collect_list("match")).alias("matches"))
    known = counted.join(found, row, "left").select(
        row, F.struct("n_words", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches")).alias(column)
    )
    return table.join(known, row).drop(row), column


def hit_words(found: Column) -> Column:
    """Words inside any match; overlaps count once."""
    spans = F.array_sort(
        F.transform(found, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b")))
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["b"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``item_ids``, ``contaminated``.

    Odd rows and tables give what :func:`matches` says of them; other columns are ignored.
    """
    found, column = matches(docs.select(id_column, text), items, window, text)
    hits = F.col(column)["matches"]
    names = F.array_sort(F.array_distinct(F.transform(hits, lambda m: m["item"])))
    return found.select(
        id_column,
        F.col(column)["n_words"].alias("n_words"),
        hit_words(hits).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        names.alias("item_ids"),
        (F.size(hits) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    found, column = matches(docs, items, window, text)
    return found.where(F.size(F.col(column)["matches"]) == 0).drop(column)
