"""Boosted trees grown from histograms, many fits in the same passes over one binned table.

The features are cut into bins once and written, with only the entries that do not lie in the bin
of zero, so a one-hot slot costs nothing where it is not set. A level of a tree is one
aggregation of the written rows to sums for each (fit, node, slot, bin); the bin of zero gets what
the others leave of its node. Rows are written in blocks, whose entries are ordered by slot and bin, so
a task meets arrays only and no single row. All fits that are wanted, say every fold of two boosters and the
boosted stumps, take part in the same aggregation, so a hundred rounds cost as many jobs as for one
of them. What reaches the driver is bounded by fits, nodes and bins, not by rows.

Several fits of a table of few rows (one task would read it all) are not worth a job for each level: its blocks
are handed to the executors once, and each fit grows there as a whole, in a task of its own, by the same steps.

Each row keeps one number for each fit: the margin of the trees so far, or the logarithm of its
weight. It is written with the rows every few rounds, and the trees since then are evaluated in
the pass, so a lost executor repeats a few trees only.

Three kinds of fits:

* ``gradient``: first order. Trees on the residuals of the logistic loss, split by the difference of
  their means; a leaf is the residuals' sum over that of p(1 - p).
* ``second_order``: splits by gradient and hessian sums with an L2 penalty and a least hessian in
  each child; a leaf is -G / (H + l2); margins begin at 0.
* ``stumps``: one split a round by Gini impurity of the weights, which grow on the rows it gets wrong.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnloom.sources.storage import materialize

# The passes travel to the executors with the job, which need no installed copy of them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cut points that a tree looks at in one slot, plus 1.
MAX_BINS = 256
_WRITE_EVERY = 10
# Most bytes of blocks that are handed to every executor.
WHOLE_BYTES = 1 << 26
# Rows that make a task worth its start, and most of a task; most bytes of the tasks' sums that the driver
# adds up by itself.
ROWS_A_TASK, MOST_ROWS, FEW_BYTES = 20_000, 1_000_000, 1 << 25
# Most rows and entries of a written block, rows that are cut at a time, bins of slots that are kept.
BLOCK_ROWS, BLOCK_ENTRIES, SLICE_ROWS, KNOWN_SLOTS = 1 << 13, 1 << 21, 1 << 11, 256
_DENSE_CELLS = 1 << 22
_BLOCK = "n int, rid long, rows binary, cells binary, y binary, kept binary"
_BLOCK_SCHEMA = pa.schema(
    [("n", pa.int32()), ("rid", pa.int64()), *((c, pa.binary()) for c in ("rows", "cells", "y", "kept"))]
)


@dataclass(frozen=True)
class Fit:
    """One booster to fit: which rows it sees and how its trees grow."""

    kind: str
    rounds: int
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    min_child: float = 1.0
    subsample: float = 1.0
    columns: float = 1.0
    seed: int = 42
    weight: str | None = None
    #: Fold column and the fold whose rows are not seen.
    leave_out: tuple[str, int] | None = None


@dataclass
class Tree:
    """Nodes in heap order: slot (-1: leaf), the last bin on the left, cut point, value."""

    slot: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))


@dataclass
class Grown:
    """Trees of a fit in order, its first margin, and for stumps the vote of each."""

    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0
    votes: list[float] = field(default_factory=list)
    #: What the logarithm of every weight loses after a stump, so that weights stay near 1.
    shifts: list[float] = field(default_factory=list)
    stopped: bool = False


@dataclass(frozen=True)
class Bins:
    """Cut points of each slot; bins of all slots in one row of cells."""

    cuts: list[np.ndarray]
    first: np.ndarray  # cell of a slot's first bin
    zero: np.ndarray  # bin of the value 0

    @classmethod
    def of(cls, cuts: Sequence[Sequence[float]]) -> Bins:
        arrays = [np.asarray(c, float) for c in cuts]
        sizes = np.array([len(c) + 1 for c in arrays], np.int64)
        zero = np.array([np.searchsorted(c, 0.0, "left") for c in arrays], np.int64)
        return cls(arrays, np.cumsum(sizes) - sizes, zero)

    @property
    def cells(self) -> int:
        return int(self.first[-1] + len(self.cuts[-1]) + 1) if self.cuts else 0


# --- binning -------------------------------------------------------------------------


def _entries(features: str):
    """Indices and values of a vector column; all slots of a dense one."""
    vector = F.unwrap_udt(features)
    dense = F.when(
        F.size(vector["values"]) > 0, F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.when(vector["type"] == 0, vector["indices"]).otherwise(dense), vector["values"]


def slot_cuts(rows: DataFrame, features: str, bins: int = MAX_BINS) -> list[list[float]]:
    """Cut points of each slot: between its values if they are few, else quantiles."""
    size = F.coalesce(F.unwrap_udt(features)["size"], F.size(F.unwrap_udt(features)["values"]))
    total = rows.agg(F.count("*").alias("n"), F.max(size).alias("slots")).first()
    index, value = _entries(features)
    filled = (
        rows.select(F.explode(F.arrays_zip(index.alias("slot"), value.alias("value"))).alias("e"))
        .select("e.slot", "e.value")
        .where("value <> 0")
    )
    counted = filled.groupBy("slot", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("slot").orderBy("value")
    few = (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= bins + 1)
        .groupBy("slot")
        .agg(F.collect_list("value").alias("values"), F.sum("n").alias("n"))
    )
    cuts: list[list[float]] = [[] for _ in range(total["slots"] or 0)]
    wide = []
    for row in few.collect():  # at most bins + 1 values for each slot
        values = sorted({*row["values"], *([0.0] if row["n"] < total["n"] else [])})
        if len(row["values"]) > bins or len(values) > bins:
            wide.append(row["slot"])
        else:
            cuts[row["slot"]] = [(p + q) / 2 for p, q in zip(values, values[1:])]
    if wide:
        probs = F.array(*(F.lit(i / bins) for i in range(1, bins)))
        array = vector_to_array(features)
        chosen = F.array(*(F.struct(F.lit(s).alias("slot"), array[s].alias("value")) for s in wide))
        found = (
            rows.select(F.inline(chosen)).groupBy("slot")
            .agg(F.percentile_approx("value", probs, 100 * bins).alias("cuts")).collect()
        )
        for row in found:
            cuts[row["slot"]] = sorted(set(row["cuts"]))
    return cuts


def _bin_rows(rows: DataFrame, bins: Bins, features: str, kept: list[str], parts: int) -> DataFrame:
    """Blocks of rows: ``y`` and the ``kept`` columns as bytes, and the entries outside the bin of zero.

    An entry is its row's place in the block and its cell; those of a block are ordered by cell.
    """
    index, value = _entries(features)

    def block(arrays: list[tuple[np.ndarray, ...]], rid: int) -> pa.RecordBatch:
        at, found, lengths, numbers = (np.concatenate(x, axis=-1) for x in zip(*arrays))
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(at, kind="stable")
        at, found, row = at[order], found[order], row[order]
        place = np.zeros(len(at), np.int64)
        slots, begins = np.unique(at, return_index=True)
        for slot, begin, end in zip(slots, begins, np.append(begins[1:], len(at))):
            cuts, own = bins.cuts[slot], found[begin:end]
            if len(cuts) > 1:
                place[begin:end] = np.searchsorted(cuts, own, "left")
            elif len(cuts):
                place[begin:end] = own > cuts[0]
        kept_ = place != bins.zero[at]
        cell, row = (bins.first[at] + place)[kept_], row[kept_]
        order = np.argsort(cell, kind="stable")
        values = {
            "n": len(lengths),
            "rid": rid,
            "rows": row[order].astype("<u2").tobytes(),
            "cells": cell[order].astype("<i4").tobytes(),
            "y": numbers[0].astype("<f8").tobytes(),
            "kept": numbers[1:].astype("<f8").tobytes(),
        }
        return pa.RecordBatch.from_pydict({c: [v] for c, v in values.items()}, schema=_BLOCK_SCHEMA)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        held, n, entries, done = [], 0, 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                at, found = part.column("index"), part.column("value")
                lengths = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                if held and (n + len(lengths) > BLOCK_ROWS or entries + lengths.sum() > BLOCK_ENTRIES):
                    yield block(held, first + done)
                    held, n, entries, done = [], 0, 0, done + n
                numbers = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ["y", *kept]])
                flat = (x.flatten().to_numpy(zero_copy_only=False) for x in (at, found))
                held.append((next(flat).astype(np.int64), next(flat).astype(float), lengths, numbers))
                n, entries = n + len(lengths), entries + int(lengths.sum())
        if held:
            yield block(held, first + done)

    chosen = rows.select(index.alias("index"), value.alias("value"), "y", *kept).coalesce(parts)
    return chosen.mapInArrow(cut, _BLOCK)


# --- a pass over the rows ------------------------------------------------------------


class _Rows:
    """A block of binned rows, of numbers and bytes by column; bins of single slots on demand."""

    def __init__(self, block: dict, bins: Bins, kept: Sequence[str]) -> None:
        self.n, self.bins = block["n"], bins
        read = lambda c, kind: np.frombuffer(block[c] or b"", kind)
        self.row = read("rows", "<u2").astype(np.intp)
        self.cell = read("cells", "<i4").astype(np.int64)
        self.y = read("y", "<f8")
        self.kept = dict(zip(kept, read("kept", "<f8").reshape(len(kept), self.n)))
        self.rid = block["rid"] + np.arange(self.n)
        self.saved = read("state", "<f8").reshape(-1, self.n) if "state" in block else None
        self.known: dict[int, np.ndarray] = {}

    def place(self, slot: int) -> np.ndarray:
        """The bin of each row in a slot."""
        if slot not in self.known:
            first = self.bins.first[slot]
            begin, end = np.searchsorted(self.cell, [first, first + len(self.bins.cuts[slot]) + 1])
            found = np.full(self.n, self.bins.zero[slot], np.int16)
            found[self.row[begin:end]] = self.cell[begin:end] - first
            if len(self.known) >= KNOWN_SLOTS:
                self.known.clear()
            self.known[slot] = found
        return self.known[slot]

    def leaf(self, tree: Tree) -> np.ndarray:
        """Node that each row comes to."""
        node = np.zeros(self.n, np.int32)
        # A node's children come after it, so one round in heap order takes each row to its leaf.
        for i in np.flatnonzero(tree.slot >= 0):
            here = node == i
            right = self.place(int(tree.slot[i])) > tree.bin[i]
            node += here * (right + np.int32(i + 1))
        return node


def _uniform(rid: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number from 0 to 1 for each row, by hashing."""
    x = rid.astype(np.uint64) + np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _advance(fit: Fit, grown: Grown, rows: _Rows, state: np.ndarray, begin: int) -> np.ndarray:
    """The state after the trees from number ``begin`` on."""
    for i in range(begin, len(grown.trees)):
        said = grown.trees[i].value[rows.leaf(grown.trees[i])]
        if fit.kind == "stumps":
            state = state + np.where(said != rows.y, grown.votes[i], 0.0) - grown.shifts[i]
        else:
            state = state + said
    return state


def _sums(fit: Fit, y: np.ndarray, weight: np.ndarray, state: np.ndarray):
    """The two sums that a fit's splits are made of, row by row."""
    if fit.kind == "stumps":
        w = weight * np.exp(state)
        return w * y, w
    p = _sigmoid(state)
    return weight * (y - p), weight * p * (1 - p)


@dataclass(frozen=True)
class _Pass:
    """What the tasks need: the fits, their trees since the last write, and the open trees."""

    fits: list[Fit]
    grown: list[Grown]
    bins: Bins
    kept: list[str]
    written: list[int]
    open: dict[int, Tree] = field(default_factory=dict)
    level: int = 0
    round: int = 0

    def state(self, rows: _Rows, f: int) -> np.ndarray:
        state = np.full(rows.n, self.grown[f].start) if rows.saved is None else rows.saved[f]
        return _advance(self.fits[f], self.grown[f], rows, state, self.written[f])

    def weights(self, rows: _Rows, f: int) -> np.ndarray:
        fit = self.fits[f]
        weight = rows.kept[fit.weight].copy() if fit.weight else np.ones(rows.n)
        if fit.leave_out:
            weight[rows.kept[fit.leave_out[0]] == fit.leave_out[1]] = 0.0
        if fit.subsample < 1.0:
            weight[_uniform(rows.rid, fit.seed, self.round) >= fit.subsample] = 0.0
        return weight

    def rows(self, blocks: Iterator[dict]) -> Iterator[_Rows]:
        return (_Rows(block, self.bins, self.kept) for block in blocks)

    def sums(self, rows: _Rows, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cells and values of an open tree's sums over a block; what lies in no open node comes last."""
        width = self.bins.cells + 1  # the last cell has the sums of the node
        nodes = 2**self.level
        f, tree = list(self.open.items())[k]
        weight = self.weights(rows, f)
        node = rows.leaf(tree) - (nodes - 1)
        node = np.where((weight > 0) & (node >= 0), node, nodes).astype(np.int64) * width
        g, h = _sums(self.fits[f], rows.y, weight, self.state(rows, f))
        index = np.concatenate([node[rows.row] + rows.cell, node + (width - 1)])
        return index, [np.concatenate([v[rows.row], v]) for v in (g, h)]

    def histograms(self, blocks: Iterable[_Rows]) -> Iterator[dict[str, np.ndarray]]:
        """Sums by cell: of all blocks of a task, or of each block if the cells are too many to hold."""
        size = 2**self.level * (self.bins.cells + 1)
        held = np.zeros((3, len(self.open), size)) if len(self.open) * size <= _DENSE_CELLS else None
        for rows in blocks:
            for k in range(len(self.open)):
                index, values = self.sums(rows, k)
                if held is None:
                    yield _cell_sums(index, values, size, k * size)
                    continue
                most = size + self.bins.cells + 1
                for into, v in zip(held, [*values, None]):
                    into[k] += np.bincount(index, v, most)[:size]
        if held is not None:
            cells = np.flatnonzero(held[2])
            yield {"cell": cells, **{c: v.reshape(-1)[cells] for c, v in zip("ghn", held)}}

    def many(self, table: DataFrame) -> dict[str, np.ndarray]:
        """Sums of the whole table by cell, added up by Spark."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in self.histograms(self.rows(_arrow_blocks(batches))):
                yield pa.RecordBatch.from_pydict(found)

        found = table.mapInArrow(rows, "cell long, g double, h double, n double")
        whole = found.groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()
        return {c: whole[c].to_numpy() for c in ("cell", *"ghn")}

    def few(self, held: RDD) -> dict[str, np.ndarray]:
        """Sums of each task by cell, of the held blocks."""
        return _joined(held.mapPartitions(lambda blocks: self.histograms(self.rows(blocks))).collect())

    def states(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i] for c in batch.schema.names}
                rows = _Rows(_plain(block), self.bins, self.kept)
                state = np.stack([self.state(rows, f) for f in range(len(self.fits))]).astype("<f8").tobytes()
                values = [block[c] for c in _BLOCK_SCHEMA.names] + [pa.scalar(state, pa.binary())]
                arrays = [pa.array([v.as_py()], v.type) for v in values]
                yield pa.RecordBatch.from_arrays(arrays, [*_BLOCK_SCHEMA.names, "state"])


def _joined(found: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, int) for c in ("cell", *"ghn")}


def _plain(block: dict[str, pa.Scalar]) -> dict:
    """Numbers as they are; bytes are not copied."""
    return {c: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for c, v in block.items()}


def _arrow_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _plain({c: batch.column(c)[i] for c in batch.schema.names})


def _held(table: DataFrame) -> RDD:
    """The written blocks, kept by the executors for the passes until the next write.

    To read the file and turn its wide cells into rows and Arrow again takes longer than to add them up.
    What is lost or does not fit is read again, from the table or the executor's disk.
    """
    names = table.columns
    return table.rdd.map(lambda row: dict(zip(names, row))).persist(StorageLevel.MEMORY_AND_DISK)


def _cell_sums(index: np.ndarray, values: list[np.ndarray], size: int, base: int) -> dict[str, np.ndarray]:
    cells, place, counts = np.unique(index, return_inverse=True, return_counts=True)
    own = cells < size
    sums = [np.bincount(place, v)[own] for v in values]
    return {"cell": cells[own] + base, "g": sums[0], "h": sums[1], "n": counts[own].astype(float)}


# --- splits --------------------------------------------------------------------------


def _filled(sums: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all cells, with those of the bins of zero, and of the nodes."""
    total, cells = sums[:, -1], sums[:, :-1].copy()
    known = np.add.reduceat(cells, bins.first, axis=1)
    cells[:, bins.first + bins.zero] += total[:, None] - known
    return cells, total


def _left(cells: np.ndarray, bins: Bins) -> np.ndarray:
    """Sums from a slot's first bin up to each of its bins."""
    cum = np.cumsum(cells, axis=1)
    before = np.concatenate([np.zeros((len(cells), 1)), cum], axis=1)[:, bins.first]
    sizes = np.diff(np.append(bins.first, bins.cells))
    return cum - np.repeat(before, sizes, axis=1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def gains(fit: Fit, g: np.ndarray, h: np.ndarray, n: np.ndarray, totals) -> np.ndarray:
    """What each cut wins, -inf where it is not allowed; arguments are the sums on its left."""
    tg, th, tn = (t[:, None] for t in totals)
    rg, rh, rn = tg - g, th - h, tn - n
    if fit.kind == "gradient":
        allowed = (n > 0.5) & (rn > 0.5)
        found = _ratio(n * rn, n + rn) * (_ratio(g, n) - _ratio(rg, rn)) ** 2
    elif fit.kind == "second_order":
        allowed = (n > 0.5) & (rn > 0.5) & (h >= fit.min_child) & (rh >= fit.min_child)
        found = 0.5 * (g**2 / (h + fit.l2) + rg**2 / (rh + fit.l2) - tg**2 / (th + fit.l2))
    else:
        allowed = np.ones(g.shape, bool)
        impurity = lambda pos, w: _ratio(2 * pos * (w - pos), w)
        found = impurity(tg, th) - impurity(g, h) - impurity(rg, rh)
    return np.where(allowed, found, -np.inf)


def leaf_value(fit: Fit, g: float, h: float) -> float:
    if fit.kind == "gradient":
        return fit.rate * g / h if h > 1e-150 else 0.0
    if fit.kind == "second_order":
        return fit.rate * g / (h + fit.l2)
    return float(g > h - g)


def _choose(found: np.ndarray) -> int | None:
    """The greatest gain; the earlier slot and cut win a tie, up to rounding."""
    best = found.max(initial=-np.inf)
    if not np.isfinite(best):
        return None
    scale = max(abs(best), 1e-12)
    return int(np.argmax(np.round(np.where(np.isfinite(found), found, best - 1e6 * scale) / scale, 9)))


def _grow(fit: Fit, tree: Tree, level: int, sums: np.ndarray, bins: Bins, allowed: np.ndarray) -> bool:
    """Split the nodes of a level; whether any was."""
    (g, tg), (h, th), (n, tn) = (_filled(s, bins) for s in sums)
    lg, lh, ln = (_left(x, bins) for x in (g, h, n))
    found = gains(fit, lg, lh, ln, (tg, th, tn))
    found[:, ~allowed] = -np.inf
    any_split = False
    for i in range(2**level):
        node = 2**level - 1 + i
        if tn[i] < 0.5:
            continue
        if level == 0:
            tree.value[0] = leaf_value(fit, tg[0], th[0])
        at = _choose(found[i])
        if at is None or (fit.kind != "stumps" and found[i, at] <= 1e-12):
            continue
        slot = int(np.searchsorted(bins.first, at, "right")) - 1
        tree.slot[node], tree.bin[node] = slot, at - bins.first[slot]
        tree.cut[node] = bins.cuts[slot][tree.bin[node]]
        tree.value[2 * node + 1] = leaf_value(fit, lg[i, at], lh[i, at])
        tree.value[2 * node + 2] = leaf_value(fit, tg[i] - lg[i, at], th[i] - lh[i, at])
        any_split = True
    return any_split


def _add_stump(fit: Fit, grown: Grown, tree: Tree, sums: np.ndarray, bins: Bins) -> None:
    """Vote of a stump from its weighted error; ends the fit if it makes none or is chance."""
    (g, tg), (h, th) = (_filled(s, bins) for s in sums[:2])
    wrong = min(tg[0], th[0] - tg[0])
    if tree.slot[0] >= 0:
        at = bins.first[tree.slot[0]] + tree.bin[0]
        lg, lh = _left(g, bins)[0, at], _left(h, bins)[0, at]
        sides = ((lg, lh, tree.value[1]), (tg[0] - lg, th[0] - lh, tree.value[2]))
        wrong = sum(w - pos if said else pos for pos, w, said in sides)
    error = max(0.0, float(wrong / th[0])) if th[0] > 0 else 0.5
    if error <= 1e-12:
        grown.trees.append(tree)
        grown.votes.append(1.0)
        grown.shifts.append(0.0)
        grown.stopped = True
        return
    if error >= 0.5:
        if not grown.trees:
            raise ValueError("the first tree is no better than chance")
        grown.stopped = True
        return
    alpha = fit.rate * math.log((1.0 - error) / error)
    grown.trees.append(tree)
    grown.votes.append(alpha)
    grown.shifts.append(math.log1p(error * math.expm1(alpha)))


# --- the loop ------------------------------------------------------------------------


def _allowed_cells(fit: Fit, bins: Bins, round_: int) -> np.ndarray:
    """Cells after which a cut may lie, of the slots that a tree looks at."""
    allowed = np.ones(bins.cells, bool)
    allowed[np.append(bins.first[1:], bins.cells) - 1] = False  # nothing lies right of a last bin
    if fit.columns < 1.0:
        rng = np.random.default_rng([fit.seed, round_])
        slots = len(bins.cuts)
        dropped = rng.permutation(slots)[max(1, int(fit.columns * slots)) :]
        sizes = np.diff(np.append(bins.first, bins.cells))
        hidden = np.zeros(slots, bool)
        hidden[dropped] = True
        allowed &= ~np.repeat(hidden, sizes)
    return allowed


def _first_margins(rows: DataFrame, fits: list[Fit], label: str) -> tuple[list[float], int]:
    """Log-odds of the label among the rows that a first-order fit sees, else 0; and the number of rows."""
    marks = sorted({f.leave_out[0] for f in fits if f.leave_out})
    counts = rows.groupBy(label, *marks).agg(F.count("*").alias("n")).collect()  # a row for each fold
    out = []
    for fit in fits:
        seen = [r for r in counts if not fit.leave_out or r[fit.leave_out[0]] != fit.leave_out[1]]
        positive = sum(r["n"] for r in seen if r[label] == 1)
        negative = sum(r["n"] for r in seen if r[label] != 1)
        known = fit.kind == "gradient" and positive and negative
        out.append(math.log(positive / negative) if known else 0.0)
    return out, sum(r["n"] for r in counts)


def fit_together(
    rows: DataFrame, fits: Sequence[Fit], features: str = "features", label: str = "label", bins: int = MAX_BINS
) -> list[Grown]:
    """Grow all ``fits`` in common passes over ``rows``; the label is 0 or 1.

    Cut points come from all rows, also those that a fit leaves out; its sums do not.
    """
    fits = list(fits)
    if not fits:
        return []
    kept = sorted({f.weight for f in fits if f.weight} | {f.leave_out[0] for f in fits if f.leave_out})
    source = rows.select(features, F.col(label).cast("double").alias("y"), *(F.col(c).cast("double") for c in kept))
    layout = Bins.of(slot_cuts(source, features, bins))
    # A pass over few rows is one short task. The blocks of many rows are dealt in equal shares, a task for
    # each core at least, whatever partitions the rows came in: every pass waits for its longest task.
    starts, count = _first_margins(source, fits, "y")
    parts = -(-count // ROWS_A_TASK) or 1
    binned = _bin_rows(source, layout, features, kept, parts)
    if parts > 1:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        binned = binned.repartition(max(min(cores, parts), -(-count // MOST_ROWS)))
    table = materialize(binned, "binned")
    grown = [Grown(start=s) for s in starts]
    if not layout.cells:
        return grown
    if len(fits) > 1 and parts == 1 and (blocks := _few_blocks(table)) is not None:
        return _whole(rows.sparkSession, blocks, fits, grown, layout, kept)
    held = _held(table)
    tasks = held.getNumPartitions()
    written = [0] * len(fits)
    width = layout.cells + 1

    def add_up(open_: dict[int, Tree], level: int, round_: int) -> dict[str, np.ndarray]:
        step = _Pass(fits, grown, layout, kept, written, open_, level, round_)
        # A row for each fit, node and bin; of a few tasks their sums as they are.
        size = len(open_) * 2**level * width
        few = size <= _DENSE_CELLS and tasks * size * 32 <= FEW_BYTES
        return step.few(held) if few else step.many(table)

    for round_ in _rounds(fits, grown, layout, add_up):
        if (round_ + 1) % _WRITE_EVERY == 0:
            step = _Pass(fits, grown, layout, kept, written)
            table = materialize(table.mapInArrow(step.states, f"{_BLOCK}, state binary"), "margins")
            held.unpersist()
            held = _held(table)
            tasks = held.getNumPartitions()
            written = [len(g.trees) for g in grown]
    held.unpersist()
    return grown


def _rounds(
    fits: list[Fit],
    grown: list[Grown],
    layout: Bins,
    add_up: Callable[[dict[int, Tree], int, int], dict[str, np.ndarray]],
) -> Iterator[int]:
    """Grow the trees of each round, whose number is given when they are done; ``add_up`` finds a level's sums."""
    width = layout.cells + 1
    for round_ in range(max(f.rounds for f in fits)):
        going = [i for i, f in enumerate(fits) if round_ < f.rounds and not grown[i].stopped]
        if not going:
            break
        allowed = {i: _allowed_cells(fits[i], layout, round_) for i in going}
        trees = {i: Tree.empty(1 if fits[i].kind == "stumps" else fits[i].depth) for i in going}
        open_ = dict(trees)
        level = 0
        while open_:
            size = len(open_) * 2**level * width
            sums = add_up(open_, level, round_)
            cells = np.stack([np.bincount(sums["cell"], sums[c], size) for c in "ghn"])
            cells = cells.reshape(3, len(open_), 2**level, width)
            further = {}
            for k, (i, tree) in enumerate(open_.items()):
                split = _grow(fits[i], tree, level, cells[:, k], layout, allowed[i])
                if fits[i].kind == "stumps":
                    _add_stump(fits[i], grown[i], tree, cells[:, k], layout)
                elif split and level + 1 < fits[i].depth:
                    further[i] = tree
            open_, level = further, level + 1
        for i in going:
            if fits[i].kind != "stumps":
                grown[i].trees.append(trees[i])
        yield round_


def _few_blocks(table: DataFrame) -> list[dict] | None:
    """The blocks of a table of few rows, unless their entries are too many to hand around."""
    size = sum((F.octet_length(c) for c in ("rows", "cells", "y", "kept")), F.lit(0).cast("long"))
    if (table.agg(F.sum(size)).first()[0] or 0) > WHOLE_BYTES:
        return None
    return [row.asDict() for row in table.orderBy("rid").collect()]


def _whole(
    spark: SparkSession, blocks: list[dict], fits: list[Fit], grown: list[Grown], layout: Bins, kept: list[str]
) -> list[Grown]:
    """Grow each fit in a task that sees all rows."""
    shared = spark.sparkContext.broadcast(blocks)

    def grow(i: int) -> Grown:
        # Each fit has its state beside the rows, which moves on by a tree each round.
        fit, own = fits[i], grown[i]
        rows = [_Rows(block, layout, kept) for block in shared.value]
        for part in rows:
            part.saved = np.full((1, part.n), own.start)

        def add_up(open_: dict[int, Tree], level: int, round_: int) -> dict[str, np.ndarray]:
            step = _Pass([fit], [own], layout, kept, [len(own.trees)], open_, level, round_)
            return _joined(list(step.histograms(rows)))

        done = len(own.trees)
        for _ in _rounds([fit], [own], layout, add_up):
            for part in rows:
                part.saved = _advance(fit, own, part, part.saved[0], done)[None]
            done = len(own.trees)
        return own

    try:
        # The longest fits begin first.
        order = sorted(range(len(fits)), key=lambda i: -fits[i].rounds * fits[i].depth)
        found = spark.sparkContext.parallelize(order, len(order)).map(lambda i: (i, grow(i))).collectAsMap()
    finally:
        shared.unpersist()
    return [found[i] for i in range(len(fits))]


def margin_sql(trees: Sequence[Tree], array: str) -> str:
    """The sum of the trees' values as one SQL expression over an array column of the slots."""

    def text(tree: Tree, node: int) -> str:
        if node >= len(tree.slot) or tree.slot[node] < 0:
            return f"{float(tree.value[node])!r}D"
        left, right = text(tree, 2 * node + 1), text(tree, 2 * node + 2)
        return f"if({array}[{int(tree.slot[node])}] <= {float(tree.cut[node])!r}D, {left}, {right})"

    terms = [text(tree, 0) for tree in trees] or ["0D"]
    while len(terms) > 1:  # a balanced sum keeps the expression flat
        terms = [f"({' + '.join(terms[i : i + 8])})" for i in range(0, len(terms), 8)]
    return terms[0]
