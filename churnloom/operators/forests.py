"""MLlib's tree and forest on rows dealt in equal shares, with the node of each row kept between levels.

A forest of some thousand rows is grown tree by tree instead, each in one task that sees all rows: MLlib
sums up every bin of every node, and most nodes of deep trees have a few rows and hundreds of bins. The
nodes are those of MLlib's rules (bins, bootstrap counts, slots drawn for each node, impurity, least rows,
pruning); they are written in the form of a saved forest, which MLlib loads. Its own scoring sends every
node as an object with each task, so such a forest scores by flat arrays of its nodes, an Arrow batch at a time.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Params
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.sources.storage import scratch_path, write_text

# The trees are grown by executors that need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows up to which a table keeps its partitions, and most rows of a task.
FEW_ROWS, TASK_ROWS = 20_000, 250_000
# Rows from which and up to which a tree of a forest is grown in one task, and most cells of its table.
LEAST_WHOLE, MOST_WHOLE, WHOLE_CELLS = 2_000, 20_000, 1 << 24
_NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
    "rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in equal shares, one for each core at least; few rows stay as they are.

    A written file of one row group is read by one task, however many cores there are.
    """
    n = rows.count()
    if n <= FEW_ROWS:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.select(*columns).repartition(max(min(cores, -(-n // FEW_ROWS)), -(-n // TASK_ROWS)))


class _Dealt:
    """A fit of dealt rows.

    ``cacheNodeIds`` keeps the node of each row and tree, so a level costs the same at every depth: else
    each level sends all trees to the tasks and walks every row down from the roots.
    """

    def _columns(self) -> list[str]:
        columns = [self.getFeaturesCol(), self.getLabelCol()]
        if self.isDefined(self.weightCol) and self.getWeightCol():
            columns.append(self.getWeightCol())
        return list(dict.fromkeys(columns))

    def _fit(self, dataset: DataFrame):
        return super()._fit(dealt(dataset, self._columns()))


class DealtTree(_Dealt, DecisionTreeClassifier):
    """One tree."""


class DealtForest(_Dealt, RandomForestClassifier):
    """A forest; which rows a tree draws depends on the partitions, as in MLlib.

    ``one_of_many`` is set for a forest of a comparison or search: its trees are grown whole on fewer
    rows too, where MLlib's jobs of each level are short by themselves but not for hundreds of forests.
    """

    one_of_many = False

    def _fit(self, dataset: DataFrame):
        n = dataset.count()
        if self.getNumTrees() > 1 and (self.one_of_many or n >= LEAST_WHOLE) and 1 < n <= MOST_WHOLE:
            table = whole_table(dataset, *self._columns(), most=WHOLE_CELLS // n)
            if table is not None:
                return self._grown_whole(dataset, *table)
        return super()._fit(dataset)

    def _grown_whole(self, dataset: DataFrame, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        spark = dataset.sparkSession
        slots, trees = x.shape[1], self.getNumTrees()
        cuts = [slot_cuts(x[:, j], weight, min(self.getMaxBins(), len(x))) for j in range(slots)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint16)
        plan = Growth(
            self.getMaxDepth(), slots_of_node(self.getFeatureSubsetStrategy(), slots), self.getImpurity(),
            self.getMinInstancesPerNode(), self.getMinWeightFractionPerNode() * float(weight.sum()),
            self.getMinInfoGain(), self.getSubsamplingRate(), self.getBootstrap(), self.getSeed(),
        )
        shared = spark.sparkContext.broadcast((binned, y, weight, cuts))

        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree in batch.column(0).to_pylist():
                    yield node_batch(tree, grow_tree(plan, tree, *shared.value))

        path = scratch_path(spark, "forest")
        tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)
        spark.range(0, trees, 1, tasks).mapInArrow(nodes, _NODES).write.parquet(f"{path}/data")
        shared.unpersist()
        own = {p.name: v for p, v in self._paramMap.items()}
        default = {p.name: v for p, v in self._defaultParamMap.items()}

        def metadata(kind: str, uid: str, skip: tuple[str, ...] = (), **more) -> str:
            chosen, others = ({k: v for k, v in d.items() if k not in skip} for d in (own, default))
            return json.dumps(
                {
                    "class": f"org.apache.spark.ml.classification.{kind}", "timestamp": time.time_ns() // 10**6,
                    "sparkVersion": spark.version, "uid": uid, "paramMap": chosen, "defaultParamMap": others, **more,
                }
            )

        alone = ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")
        each = [
            (i, metadata("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", alone, numFeatures=slots, numClasses=2), 1.0)
            for i in range(trees)
        ]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        whole = metadata("RandomForestClassificationModel", self.uid, numFeatures=slots, numClasses=2, numTrees=trees)
        write_text(spark, f"{path}/metadata/part-00000", whole + "\n")
        return self._copyValues(WholeForestModel(spark, path, self.uid, slots))


class WholeForestModel(RandomForestClassificationModel):
    """A forest written in MLlib's form, which MLlib loads when it is asked for more than scores.

    Its scores and importances are those of MLlib, from the same nodes. The written form lies with the
    intermediate tables of the application; ``write`` makes a copy as of any other model.
    """

    def __init__(self, spark: SparkSession, path: str, uid: str, slots: int):
        self._loaded = self._mllib = None
        super().__init__()
        self._resetUid(uid)
        self._path, self._slots = path, slots
        split, stats = F.col("nodeData.split"), F.col("nodeData.impurityStats")
        found = spark.read.schema(_NODES).parquet(f"{path}/data").select(
            "treeID", "nodeData.id", split["featureIndex"].alias("slot"), F.col("nodeData.leftChild").alias("left"),
            F.coalesce(F.get(split["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("cut"),
            stats[0].alias("negative"), stats[1].alias("positive"), "nodeData.gain",
        ).toArrow()
        column = {c: found[c].to_numpy() for c in found.column_names}
        order = np.lexsort([column["id"], column["treeID"]])
        column = {c: v[order] for c, v in column.items()}
        roots = np.flatnonzero(column["id"] == 0)
        # Children are numbered through all trees; the right one comes after the left one.
        begin = np.repeat(roots, np.diff(np.append(roots, len(order))))
        total = column["negative"] + column["positive"]
        self._importances = self._by_slot(column["treeID"], column["slot"], column["gain"] * total)
        share = [np.divide(column[c], total, out=np.zeros(len(total)), where=total > 0) for c in ("negative", "positive")]
        self._nodes = spark.sparkContext.broadcast((roots, column["slot"], column["cut"], column["left"] + begin, share))

    @property
    def _java_obj(self):
        if self._loaded is None and hasattr(self, "_path"):
            self._mllib = RandomForestClassificationModel.load(self._path)  # which gives its object back when it goes
            self._loaded = self._mllib._java_obj
        return self._loaded

    @_java_obj.setter
    def _java_obj(self, loaded) -> None:
        self._loaded = loaded

    def __del__(self) -> None:
        if self._loaded is not None and (self._mllib is None or self._loaded is not self._mllib._java_obj):
            super().__del__()

    def copy(self, extra=None):
        if self._loaded is None:
            return Params.copy(self, extra)
        return super().copy(extra)

    def _by_slot(self, tree: np.ndarray, slot: np.ndarray, won: np.ndarray) -> np.ndarray:
        """What the splits of each slot win: a share of each tree, then of all trees."""
        inner = slot >= 0
        sums = np.zeros((tree.max() + 1, self._slots))
        np.add.at(sums, (tree[inner], slot[inner]), won[inner])
        whole = sums.sum(axis=1, keepdims=True)
        shares = np.divide(sums, whole, out=np.zeros(sums.shape), where=whole > 0).sum(axis=0)
        return shares / shares.sum() if shares.sum() else shares

    @property
    def trees(self) -> list[DecisionTreeClassificationModel]:
        return [DecisionTreeClassificationModel(m) for m in list(self._call_java("trees"))]

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self._importances)

    def _votes(self, features: Column) -> Column:
        nodes = self._nodes

        @F.arrow_udf("array<double>")
        def votes(x: pa.Array) -> pa.Array:
            if x.null_count:
                raise ValueError("a row has no features")
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            found = count_votes(values, *nodes.value)
            return pa.ListArray.from_arrays(np.arange(0, 2 * len(x) + 1, 2, dtype=np.int32), pa.array(found.ravel()))

        return votes(vector_to_array(features))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getLeafCol() or self.isSet(self.thresholds):
            return super()._transform(dataset)
        names = self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()
        total = F.col("_votes")[0] + F.col("_votes")[1]
        made = {
            names[0]: array_to_vector("_votes"),
            names[1]: array_to_vector(F.transform("_votes", lambda v: v / total)),
            names[2]: (F.col("_votes")[1] > F.col("_votes")[0]).cast("double"),
        }
        scored = dataset.withColumn("_votes", self._votes(F.col(self.getFeaturesCol())))
        return scored.withColumns({n: c for n, c in made.items() if n}).drop("_votes")


def count_votes(
    x: np.ndarray, roots: np.ndarray, slot: np.ndarray, cut: np.ndarray, left: np.ndarray, share: list[np.ndarray]
) -> np.ndarray:
    """Sums of the trees' class shares for each row."""
    out = np.zeros((len(x), 2))
    for root in roots:
        node = np.full(len(x), root)
        row = np.flatnonzero(slot[node] >= 0)
        while len(row):
            at = node[row]
            node[row] = at = left[at] + (x[row, slot[at]] > cut[at])
            row = row[slot[at] >= 0]
        out += np.stack([part[node] for part in share], axis=1)
    return out


# --- a tree of all rows in one task --------------------------------------------------


def whole_table(
    dataset: DataFrame, features: str, label: str, weight: str | None = None, most: int = sys.maxsize
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Slots, labels and weights of all rows; None for more slots than ``most`` or labels other than both 0 and 1."""
    size = F.coalesce(F.unwrap_udt(features)["size"], F.size(F.unwrap_udt(features)["values"]))
    known = dataset.agg(F.max(size).alias("slots"), F.collect_set(F.col(label).cast("double")).alias("labels")).first()
    if not known["slots"] or known["slots"] > most or sorted(known["labels"]) != [0.0, 1.0]:
        return None
    found = dataset.select(
        vector_to_array(features).alias("x"),
        F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    ).toArrow()
    if any(found[c].null_count for c in ("x", "y", "w")):
        return None
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, known["slots"])
    y, w = (found[c].to_numpy() for c in "yw")
    if not np.isfinite(x).all() or not (w >= 0).all() or not w.sum():
        return None
    # The rows in an order of their own, so a tree's draw does not hang on the partitions.
    order = np.lexsort([*x.T, w, y])
    return x[order], y[order], w[order]


def slot_cuts(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Cut points of a slot as MLlib sets them: between its values if they are few, else at equal weights."""
    known, place = np.unique(values, return_inverse=True)
    middle = (known[:-1] + known[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    total = np.cumsum(np.bincount(place, weight))
    stride = total[-1] / bins
    cuts, target = [], stride
    for i in range(1, len(known)):
        if abs(total[i - 1] - target) < abs(total[i] - target):
            cuts.append(middle[i - 1])
            target += stride
    return np.array(cuts)


def slots_of_node(strategy: str, slots: int) -> int:
    """How many slots a node of a forest looks at."""
    named = {
        "auto": math.ceil(math.sqrt(slots)), "all": slots, "sqrt": math.ceil(math.sqrt(slots)),
        "log2": max(1, math.ceil(math.log2(slots))), "onethird": math.ceil(slots / 3.0),
    }
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(int(strategy), slots)
    return math.ceil(float(strategy) * slots)


@dataclass(frozen=True)
class Growth:
    """How the trees of a forest grow."""

    depth: int
    slots: int
    impurity: str = "gini"
    least_rows: int = 1
    least_weight: float = 0.0
    least_gain: float = 0.0
    rate: float = 1.0
    bootstrap: bool = True
    seed: int = 42


@dataclass
class Nodes:
    """A tree's nodes, children after their parents; a leaf has no children (-1)."""

    stats: np.ndarray  # weight of each class
    count: np.ndarray
    impurity: np.ndarray
    gain: np.ndarray
    prediction: np.ndarray
    left: np.ndarray
    right: np.ndarray
    slot: np.ndarray
    cut: np.ndarray


def impurity_of(kind: str, negative: np.ndarray, positive: np.ndarray) -> np.ndarray:
    total = negative + positive
    share = [np.divide(part, total, out=np.zeros(np.shape(total)), where=total > 0) for part in (negative, positive)]
    if kind == "gini":
        return np.where(total > 0, 1.0 - share[0] ** 2 - share[1] ** 2, 0.0)
    return sum(-s * np.log2(s, out=np.zeros(np.shape(s)), where=s > 0) for s in share)


def grow_tree(
    plan: Growth, tree: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray]
) -> Nodes:
    """A tree on its own draw of the rows, level by level; ``x`` holds bins."""
    rng = np.random.default_rng([plan.seed % (1 << 63), tree])
    n, slots = x.shape
    if plan.bootstrap:
        drawn = rng.poisson(plan.rate, n)
    else:
        drawn = (rng.random(n) < plan.rate).astype(int)
    row = np.flatnonzero(drawn)
    times = drawn[row].astype(float)
    mass = times * weight[row]
    sums = np.stack([mass * (y[row] == 0), mass * (y[row] == 1), times])  # of each row: both classes, rows
    node = np.zeros(len(row), np.int64)  # place of the row's node among the open ones
    width = max(len(c) for c in cuts) + 1
    stats = sums.sum(axis=1)[None]
    levels: list[Nodes] = []
    first = 0  # number of the level's first node
    opened = np.zeros(1, np.int64)
    for level in range(plan.depth + 1):
        k = len(stats)
        impurity = impurity_of(plan.impurity, stats[:, 0], stats[:, 1])
        here = Nodes(
            stats[:, :2], stats[:, 2], impurity, np.full(k, -1.0), (stats[:, 1] > stats[:, 0]).astype(float),
            np.full(k, -1), np.full(k, -1), np.full(k, -1), np.zeros(k),
        )
        levels.append(here)
        # Leaves of one class are not opened; MLlib tells them by their impurity.
        opened = np.flatnonzero(impurity > np.finfo(float).eps) if level < plan.depth else opened[:0]
        place = np.full(k, -1)
        place[opened] = np.arange(len(opened))
        node = place[node]
        row, sums, node = row[node >= 0], sums[:, node >= 0], node[node >= 0]
        if not len(opened):
            break
        found = best_splits(plan, rng, x, row, sums, node, stats[opened], impurity[opened], slots, width)
        split = np.flatnonzero(found["gain"] > 0)
        if not len(split):
            break
        at = opened[split]
        here.gain[at], here.slot[at] = found["gain"][split], found["slot"][split]
        here.cut[at] = [cuts[s][b] for s, b in zip(found["slot"][split], found["bin"][split])]
        here.left[at] = first + k + 2 * np.arange(len(split))
        here.right[at] = here.left[at] + 1
        child = np.full(len(opened), -1)
        child[split] = 2 * np.arange(len(split))
        inside = child[node] >= 0
        row, sums, node = row[inside], sums[:, inside], node[inside]
        node = child[node] + (x[row, found["slot"][node]] > found["bin"][node])
        stats = np.stack([np.bincount(node, s, 2 * len(split)) for s in sums], axis=1)
        first += k
    return pruned(levels)


def best_splits(
    plan: Growth, rng: np.random.Generator, x: np.ndarray, row: np.ndarray, sums: np.ndarray, node: np.ndarray,
    stats: np.ndarray, impurity: np.ndarray, slots: int, width: int,
) -> dict[str, np.ndarray]:
    """The slot and last bin on the left of each node's best split, and its gain (0: there is none).

    The rows are ordered by node, slot and bin, so only bins that a node has are looked at.
    """
    k, m = len(stats), plan.slots
    chosen = np.argsort(rng.random((k, slots)), axis=1)[:, :m] if m < slots else np.tile(np.arange(slots), (k, 1))
    place = x[row[:, None], chosen[node]].astype(np.int64)
    key = ((node[:, None] * m + np.arange(m)) * width + place).ravel()
    order = np.argsort(key)
    key = key[order]
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))  # last row of each bin
    key = key[last]
    segment = key // width
    total = np.cumsum(np.repeat(sums, m, axis=1)[:, order], axis=1)[:, last]
    begin = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    before = np.concatenate([np.zeros((3, 1)), total], axis=1)[:, begin]
    left = total - np.repeat(before, np.diff(np.append(begin, len(key))), axis=1)
    of = segment // m
    right = stats[of].T - left
    ends = np.zeros(len(key), bool)
    ends[np.append(begin[1:], len(key)) - 1] = True
    sides = [np.maximum(s[0], 0) + np.maximum(s[1], 0) for s in (left, right)]
    gain = impurity[of] - sum(
        w * impurity_of(plan.impurity, np.maximum(s[0], 0), np.maximum(s[1], 0)) for w, s in zip(sides, (left, right))
    ) / (sides[0] + sides[1])
    allowed = ~ends & (np.round(left[2]) >= plan.least_rows) & (np.round(right[2]) >= plan.least_rows)
    allowed &= (sides[0] >= plan.least_weight) & (sides[1] >= plan.least_weight)
    # Differences by rounding are no gain.
    gain = np.where(allowed & (gain >= plan.least_gain) & (gain > 1e-12), gain, 0.0)
    starts = np.searchsorted(of, np.arange(k))
    best = np.maximum.reduceat(gain, starts)
    hit = np.flatnonzero(gain == best[of])
    hit = hit[np.searchsorted(of[hit], np.arange(k))]
    return {"gain": best, "slot": chosen[of[hit], segment[hit] % m], "bin": key[hit] % width}


def pruned(levels: list[Nodes]) -> Nodes:
    """The nodes of all levels in order; two leaves that say the same become one."""
    parts = {name: np.concatenate([getattr(lv, name) for lv in levels]) for name in Nodes.__dataclass_fields__}
    nodes = Nodes(**parts)
    starts = np.cumsum([0, *(len(lv.gain) for lv in levels)])
    for begin, end in reversed(list(zip(starts, starts[1:]))):
        at = begin + np.flatnonzero(nodes.left[begin:end] >= 0)
        l, r = nodes.left[at], nodes.right[at]
        same = (nodes.left[l] < 0) & (nodes.left[r] < 0) & (nodes.prediction[l] == nodes.prediction[r])
        one = at[same]
        nodes.prediction[one] = nodes.prediction[nodes.left[one]]
        nodes.left[one] = nodes.right[one] = nodes.slot[one] = -1
        nodes.gain[one] = -1.0
    kept = np.zeros(len(nodes.gain), bool)
    kept[0] = True
    for begin, end in zip(starts, starts[1:]):
        at = begin + np.flatnonzero(kept[begin:end] & (nodes.left[begin:end] >= 0))
        kept[nodes.left[at]] = kept[nodes.right[at]] = True
    number = np.append(np.cumsum(kept) - 1, -1)  # -1 stays
    out = Nodes(**{name: getattr(nodes, name)[kept] for name in Nodes.__dataclass_fields__})
    out.left, out.right = number[out.left], number[out.right]
    return out


def node_batch(tree: int, nodes: Nodes) -> pa.RecordBatch:
    """The nodes as rows of a saved forest."""
    n = len(nodes.gain)
    inner = nodes.left >= 0
    numbers = lambda v, kind: pa.array(np.asarray(v), kind)
    pairs = pa.ListArray.from_arrays(np.arange(0, 2 * n + 1, 2, dtype=np.int32), pa.array(nodes.stats.ravel()))
    ends = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
    split = pa.StructArray.from_arrays(
        [
            numbers(np.where(inner, nodes.slot, -1), pa.int32()),
            pa.ListArray.from_arrays(ends, pa.array(nodes.cut[inner])),
            numbers(np.full(n, -1), pa.int32()),
        ],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    data = pa.StructArray.from_arrays(
        [
            numbers(np.arange(n), pa.int32()), numbers(nodes.prediction, pa.float64()),
            numbers(nodes.impurity, pa.float64()), pairs, numbers(np.round(nodes.count).astype(np.int64), pa.int64()),
            numbers(nodes.gain, pa.float64()), numbers(nodes.left, pa.int32()), numbers(nodes.right, pa.int32()), split,
        ],
        [
            "id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split",
        ],
    )
    return pa.RecordBatch.from_arrays([numbers(np.full(n, tree), pa.int32()), data], ["treeID", "nodeData"])
