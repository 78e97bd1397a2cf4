"""The classifiers: MLlib trees and forests, boosted stumps, and a stack of them all."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.operators.boosting import MAX_BINS, Fit, Grown, Tree, fit_together, margin_sql
from churnloom.operators.forests import DealtForest, DealtTree
from churnloom.operators.split import hash_folds
from churnloom.operators.weights import with_balanced_weights
from churnloom.schema import ID_COLUMN
from churnloom.sources.storage import materialize

SEED = 42
BALANCED, POSITIVE_WEIGHT = "weight", "pos_weight"
_OUTPUTS = ("rawPrediction", "probability", "prediction")


def positive_score(df: DataFrame, output: str = "score") -> DataFrame:
    """Replace a classifier's output columns by the probability of class 1."""
    scored = df.withColumn(output, vector_to_array("probability")[1])
    return scored.drop(*_OUTPUTS)


def _binary_outputs(df: DataFrame, score: Column, prediction: Column) -> DataFrame:
    return df.withColumns(
        {
            "probability": array_to_vector(F.array(1 - score, score)),
            "prediction": prediction.cast("double"),
        }
    )


class _Booster(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasSeed):
    """An estimator that grows its trees by :func:`fit_together`, alone or with others.

    ``maxBins`` bounds the cut points of a slot, plus 1.
    """

    maxBins = Param(Params._dummy(), "maxBins", "most cut points of a slot, plus 1", TypeConverters.toInt)

    def as_fit(self, leave_out: tuple[str, int] | None = None) -> Fit:
        raise NotImplementedError

    def as_model(self, grown: Grown) -> Model:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> Model:
        (grown,) = fit_together(
            dataset, [self.as_fit()], self.getFeaturesCol(), self.getLabelCol(), self.getOrDefault(self.maxBins)
        )
        return self.as_model(grown)


class AdaBoostClassifier(_Booster):
    """Boosted depth-1 trees: each round up-weights the rows the last tree got wrong.

    Stops early when a tree makes no error or is no better than chance.
    """

    @keyword_only
    def __init__(
        self, *, maxIter: int = 50, stepSize: float = 1.0, maxBins: int = MAX_BINS, seed: int = SEED
    ):
        super().__init__()
        self._setDefault(
            maxIter=50, stepSize=1.0, maxBins=MAX_BINS, seed=SEED, featuresCol="features", labelCol="label"
        )
        self._set(**self._input_kwargs)

    def as_fit(self, leave_out: tuple[str, int] | None = None) -> Fit:
        return Fit("stumps", self.getMaxIter(), 1, self.getStepSize(), seed=self.getSeed(), leave_out=leave_out)

    def as_model(self, grown: Grown) -> AdaBoostModel:
        trees = grown.trees
        inner = [t.slot[0] >= 0 for t in trees]
        model = AdaBoostModel()
        model._set(
            featuresCol=self.getFeaturesCol(),
            slots=[int(t.slot[0]) if i else 0 for t, i in zip(trees, inner)],
            cuts=[float(t.cut[0]) if i else math.inf for t, i in zip(trees, inner)],
            left=[int(t.value[1 if i else 0]) for t, i in zip(trees, inner)],
            right=[int(t.value[2 if i else 0]) for t, i in zip(trees, inner)],
            alphas=[float(v) for v in grown.votes],
        )
        return model._resetUid(self.uid)


class BoostedTreesClassifier(_Booster):
    """Gradient boosting by the logistic loss, of first or second order.

    First order: trees on the residuals, from the log-odds of the label on. Second order
    (``secondOrder``): splits and leaves by gradient and hessian with an L2 penalty ``l2`` and at
    least ``minChildWeight`` hessian in a child; ``weightCol`` weighs both. ``columnRate`` of the
    slots, drawn for each tree, and ``subsamplingRate`` of the rows take part in a tree.
    """

    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows of a tree", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "share of slots of a tree", TypeConverters.toFloat)
    secondOrder = Param(Params._dummy(), "secondOrder", "split by gradient and hessian", TypeConverters.toBoolean)
    l2 = Param(Params._dummy(), "l2", "penalty on leaf values", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a child", TypeConverters.toFloat)
    weightCol = Param(Params._dummy(), "weightCol", "row weights", TypeConverters.toString)

    @keyword_only
    def __init__(
        self,
        *,
        maxIter: int = 100,
        maxDepth: int = 3,
        stepSize: float = 0.1,
        subsamplingRate: float = 1.0,
        columnRate: float = 1.0,
        secondOrder: bool = False,
        l2: float = 1.0,
        minChildWeight: float = 1.0,
        weightCol: str = "",
        maxBins: int = MAX_BINS,
        seed: int = SEED,
    ):
        super().__init__()
        self._setDefault(
            maxIter=100, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, columnRate=1.0, secondOrder=False,
            l2=1.0, minChildWeight=1.0, weightCol="", maxBins=MAX_BINS, seed=SEED,
            featuresCol="features", labelCol="label",
        )
        self._set(**self._input_kwargs)

    def as_fit(self, leave_out: tuple[str, int] | None = None) -> Fit:
        value = self.getOrDefault
        return Fit(
            "second_order" if value(self.secondOrder) else "gradient",
            self.getMaxIter(),
            value(self.maxDepth),
            self.getStepSize(),
            value(self.l2),
            value(self.minChildWeight),
            value(self.subsamplingRate),
            value(self.columnRate),
            self.getSeed(),
            value(self.weightCol) or None,
            leave_out,
        )

    def as_model(self, grown: Grown) -> BoostedTreesModel:
        model = BoostedTreesModel()
        model._set(
            featuresCol=self.getFeaturesCol(),
            start=float(grown.start),
            sizes=[len(t.slot) for t in grown.trees],
            slots=[int(x) for t in grown.trees for x in t.slot],
            cuts=[float(x) for t in grown.trees for x in t.cut],
            values=[float(x) for t in grown.trees for x in t.value],
        )
        return model._resetUid(self.uid)


class BoostedTreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Sum of the trees' values, in one projection; the score is its logistic."""

    start = Param(Params._dummy(), "start", "margin before the first tree", TypeConverters.toFloat)
    sizes = Param(Params._dummy(), "sizes", "nodes of each tree, in heap order", TypeConverters.toListInt)
    slots = Param(Params._dummy(), "slots", "vector slot of each node, -1 for a leaf", TypeConverters.toListInt)
    cuts = Param(Params._dummy(), "cuts", "largest value on the left", TypeConverters.toListFloat)
    values = Param(Params._dummy(), "values", "value of each node", TypeConverters.toListFloat)

    def trees(self) -> list[Tree]:
        slots, cuts, values = (self.getOrDefault(p) for p in ("slots", "cuts", "values"))
        out, at = [], 0
        for n in self.getOrDefault("sizes"):
            part = slice(at, at + n)
            out.append(Tree(np.array(slots[part]), np.zeros(n, np.int64), np.array(cuts[part]), np.array(values[part])))
            at += n
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = F.expr(margin_sql(self.trees(), "_slots")) + F.lit(self.getOrDefault("start"))
        summed = dataset.withColumn("_slots", vector_to_array(self.getFeaturesCol())).withColumn("_margin", margin)
        score = 1 / (1 + F.exp(-F.col("_margin")))
        return _binary_outputs(summed, score, F.col("_margin") > 0).drop("_slots", "_margin")


class AdaBoostModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weighted vote of the stumps, in one projection; the score is the logistic of twice the mean vote."""

    slots = Param(Params._dummy(), "slots", "vector slot of each stump", TypeConverters.toListInt)
    cuts = Param(Params._dummy(), "cuts", "largest value on the left", TypeConverters.toListFloat)
    left = Param(Params._dummy(), "left", "class up to the cut", TypeConverters.toListInt)
    right = Param(Params._dummy(), "right", "class above the cut", TypeConverters.toListInt)
    alphas = Param(Params._dummy(), "alphas", "vote of each stump", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = [self.getOrDefault(p) for p in ("slots", "cuts", "left", "right", "alphas")]
        total = sum(parts[-1])
        x, margin = vector_to_array(self.getFeaturesCol()), F.lit(0.0)
        for slot, cut, left, right, alpha in zip(*parts):
            vote = F.when(x[slot] <= cut, 2 * left - 1).otherwise(2 * right - 1)
            margin = margin + F.lit(alpha / total) * vote
        voted = dataset.withColumn("_margin", margin)
        score = 1 / (1 + F.exp(-2 * F.col("_margin")))
        return _binary_outputs(voted, score, F.col("_margin") > 0).drop("_margin")


class StackingClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasSeed):
    """A balanced logistic regression on the out-of-fold scores of the base classifiers.

    Every base classifier is fitted once per fold for the scores, and once more on
    all rows for use; all boosters of all folds grow together.
    """

    folds = Param(Params._dummy(), "folds", "out-of-fold parts", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "row key that decides the fold", TypeConverters.toString)
    parallelism = Param(Params._dummy(), "parallelism", "fits at a time", TypeConverters.toInt)

    def __init__(self, base: list[Estimator], folds: int = 5, keyCol: str = ID_COLUMN):
        super().__init__()
        self.base = base
        self._setDefault(featuresCol="features", labelCol="label", seed=SEED, parallelism=6)
        self._set(folds=folds, keyCol=keyCol)

    def wanted(self) -> list[Wanted]:
        """Every base classifier on all rows, then without each fold."""
        return [(e, None) for e in self.base] + self._without_folds()

    def _without_folds(self) -> list[Wanted]:
        folds = self.getOrDefault(self.folds)
        return [(e, (stack_fold(folds), f)) for f in range(folds) for e in self.base]

    def _fit(self, dataset: DataFrame) -> StackingModel:
        return self.fit_shared(FitCache(self._folded(dataset)))

    def _folded(self, rows: DataFrame) -> DataFrame:
        return with_stack_folds(rows, self.getOrDefault(self.folds), self.getOrDefault(self.keyCol), self.getSeed())

    def fit_shared(self, cache: FitCache) -> StackingModel:
        """Fit on the cache's rows; its fits on all rows, and on its folds if it has them, are shared."""
        folds, label = self.getOrDefault(self.folds), self.getLabelCol()
        key, fold_column = self.getOrDefault(self.keyCol), stack_fold(folds)
        parallelism = self.getOrDefault(self.parallelism)
        inside = cache if fold_column in cache.rows.columns else FitCache(self._folded(cache.rows))
        if inside is cache:
            cache.fits(self.wanted(), parallelism)  # all in the same passes
        base = cache.fits([(e, None) for e in self.base], parallelism)
        parts = inside.fits(self._without_folds(), parallelism)
        held_out = None
        for fold in range(folds):
            outside = inside.rows.where(F.col(fold_column) == fold)
            own = parts[fold * len(self.base) : (fold + 1) * len(self.base)]
            scores = _stack_scores(own, outside).select(key, label, "_stack")
            held_out = scores if held_out is None else held_out.unionByName(scores)
        held_out = materialize(with_balanced_weights(held_out, label, "_weight"), "stack")
        n = held_out.count()
        top = LogisticRegression(
            featuresCol="_stack",
            labelCol=label,
            weightCol="_weight",
            maxIter=1000,
            # The penalty that goes with an inverse strength of 1 on the summed loss.
            regParam=1.0 / max(n, 1),
            standardization=False,
        ).fit(held_out)
        return StackingModel([top, *base])._resetUid(self.uid)


STACK_FOLDS = 5


def stack_fold(folds: int) -> str:
    """Name of the column with the fold of each row, for a stack of so many folds."""
    return f"stack_fold_{folds}"


def with_stack_folds(
    df: DataFrame, folds: int = STACK_FOLDS, key: str = ID_COLUMN, seed: int = SEED
) -> DataFrame:
    """``df`` written with the folds of a stack."""
    name = stack_fold(folds)
    return materialize(hash_folds(df, folds, key, seed, name), "stack-folds", name)


# Rows from which a fit fills the cluster and its memory, and the fits at a time from there on.
MANY_ROWS, FITS_OF_MANY = 1_000_000, 2

#: A classifier to fit, and the fold column and fold whose rows it does not see.
Wanted = tuple[Estimator, "tuple[str, int] | None"]


class FitCache:
    """Fitted classifiers of one training table by class, settings and fold left out.

    What is asked for twice is fitted once. Boosters of one call grow together in common passes;
    the others are fitted a few at a time.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self._known: dict[tuple, Model] = {}

    @staticmethod
    def _key(wanted: Wanted) -> tuple:
        estimator, left_out = wanted
        parts = estimator.base if isinstance(estimator, StackingClassifier) else []
        own = [sorted((p.name, v) for p, v in e.extractParamMap().items()) for e in (estimator, *parts)]
        return type(estimator).__name__, repr(own), left_out

    def fits(self, wanted: list[Wanted], parallelism: int = 2) -> list[Model]:
        missing = {self._key(w): w for w in wanted if self._key(w) not in self._known}
        tables: dict[tuple, list[tuple]] = {}
        for key, (estimator, _) in missing.items():
            if isinstance(estimator, _Booster):
                table = (estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getOrDefault("maxBins"))
                tables.setdefault(table, []).append(key)

        def boost(task: tuple) -> None:
            table, keys = task
            grown = fit_together(self.rows, [missing[k][0].as_fit(missing[k][1]) for k in keys], *table)
            self._known |= {k: missing[k][0].as_model(g) for k, g in zip(keys, grown)}

        def fit(key: tuple) -> None:
            estimator, left_out = missing[key]
            if isinstance(estimator, StackingClassifier) and left_out is None:
                self._known[key] = estimator.fit_shared(self)
                return
            rows = self.rows.where(F.col(left_out[0]) != left_out[1]) if left_out else self.rows
            own = estimator.copy()
            if isinstance(own, DealtForest):
                own.one_of_many = True
            self._known[key] = own.fit(rows)

        boosted = {k for keys in tables.values() for k in keys}
        tasks = [(boost, t) for t in tables.items()]
        tasks += [(fit, k) for k, (e, _) in missing.items() if k not in boosted and not isinstance(e, StackingClassifier)]
        if tasks:
            if len(tasks) > FITS_OF_MANY and self.rows.count() > MANY_ROWS:
                parallelism = min(parallelism, FITS_OF_MANY)
            run = inheritable_thread_target(self.rows.sparkSession)(lambda task: task[0](task[1]))
            with ThreadPool(parallelism) as pool:
                pool.map(run, tasks, chunksize=1)
        for key in missing:
            if key not in self._known:  # a stack: its parts are fitted by now, or by itself
                fit(key)
        return [self._known[self._key(w)] for w in wanted]

    def forget(self, models: list[Model]) -> None:
        """Drop models that nothing will ask for again."""
        gone = {id(m) for m in models}
        self._known = {k: m for k, m in self._known.items() if id(m) not in gone}


def _stack_scores(models: list[Model], df: DataFrame) -> DataFrame:
    names = [f"_score{i}" for i in range(len(models))]
    for name, model in zip(names, models):
        df = positive_score(model.transform(df), name)
    return VectorAssembler(inputCols=names, outputCol="_stack").transform(df).drop(*names)


class StackingModel(Model, MLReadable, MLWritable):
    """The fitted top model, then the base models in order."""

    def __init__(self, parts: list[Model] | None = None):
        super().__init__()
        self.parts = parts or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        top, *base = self.parts
        return top.transform(_stack_scores(base, dataset)).drop("_stack", "rawPrediction")

    def write(self) -> MLWriter:
        return _PartsWriter(self, self.parts)

    @classmethod
    def read(cls) -> MLReader:
        return _PartsReader(cls)

    @classmethod
    def _from_parts(cls, parts: list) -> StackingModel:
        return cls(parts)


class _PartsWriter(MLWriter):
    """Metadata, and each part model in a numbered folder."""

    def __init__(self, model: Model, parts: list):
        super().__init__()
        self.model, self.parts = model, parts

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.model, path, self.sparkSession, extraMetadata={"parts": len(self.parts)}
        )
        for i, part in enumerate(self.parts):
            part.write().save(f"{path}/part-{i:05d}")


class _PartsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Model:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        parts = [
            DefaultParamsReader.loadParamsInstance(f"{path}/part-{i:05d}", spark)
            for i in range(metadata["parts"])
        ]
        model = self.cls._from_parts(parts)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


@dataclass(frozen=True)
class ModelSpec:
    """A named classifier and the settings to try."""

    name: str
    build: Callable[..., Estimator]
    grid: list[dict] = field(default_factory=lambda: [{}])


def random_forest(**settings) -> Estimator:
    return DealtForest(weightCol=BALANCED, seed=SEED, **{"maxBins": MAX_BINS, "cacheNodeIds": True, **settings})


def gradient_boosting(**settings) -> Estimator:
    return BoostedTreesClassifier(seed=SEED, **settings)


def ada_boost(**settings) -> Estimator:
    return AdaBoostClassifier(seed=SEED, **settings)


def decision_tree(**settings) -> Estimator:
    return DealtTree(weightCol=BALANCED, seed=SEED, **{"maxBins": MAX_BINS, "cacheNodeIds": True, **settings})


def weighted_boosting(**settings) -> Estimator:
    """Second-order boosting with positives weighted by negatives-per-positive."""
    return BoostedTreesClassifier(secondOrder=True, seed=SEED, **{"weightCol": POSITIVE_WEIGHT, **settings})


def stacking(settings: dict[str, dict] | None = None, folds: int = 5) -> Estimator:
    """Forest, boosting, weighted boosting, boosted stumps and tree under a regression."""
    settings = settings or {}
    return StackingClassifier(
        [
            random_forest(**settings.get("random_forest", {})),
            gradient_boosting(**settings.get("gradient_boosting", {})),
            weighted_boosting(**settings.get("weighted_boosting", {})),
            ada_boost(**settings.get("ada_boost", {})),
            decision_tree(**settings.get("decision_tree", {})),
        ],
        folds=folds,
    )


def _product(**choices: list) -> list[dict]:
    grid = [{}]
    for name, values in choices.items():
        grid = [{**point, name: value} for point in grid for value in values]
    return grid


# The search grids. An unlimited depth is the deepest MLlib grows, 30; the
# least rows to split a node has no counterpart.
_DEEPEST = 30
BASE_SETTINGS = {
    "random_forest": {"numTrees": 100, "maxDepth": _DEEPEST},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1},
    "weighted_boosting": {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1},
    "ada_boost": {"maxIter": 50, "stepSize": 1.0},
    "decision_tree": {"maxDepth": _DEEPEST},
}


def full_specs() -> list[ModelSpec]:
    """The whole search: 24, 16, 4, 12, 32 and 1 candidates."""
    boosting = {"maxIter": [100, 200], "maxDepth": [3, 5], "stepSize": [0.1, 0.05]}
    return [
        ModelSpec(
            "random_forest",
            random_forest,
            _product(
                numTrees=[100, 200],
                maxDepth=[_DEEPEST, 10, 20],
                minInstancesPerNode=[1, 2],
                featureSubsetStrategy=["sqrt", "log2"],
            ),
        ),
        ModelSpec(
            "gradient_boosting",
            gradient_boosting,
            _product(**boosting, subsamplingRate=[1.0, 0.8]),
        ),
        ModelSpec("ada_boost", ada_boost, _product(maxIter=[50, 100], stepSize=[1.0, 0.5])),
        ModelSpec(
            "decision_tree",
            decision_tree,
            _product(
                maxDepth=[_DEEPEST, 10, 20],
                minInstancesPerNode=[1, 2],
                impurity=["gini", "entropy"],
            ),
        ),
        ModelSpec(
            "weighted_boosting",
            weighted_boosting,
            _product(
                **boosting, subsamplingRate=[1.0, 0.8], columnRate=[1.0, 0.8]
            ),
        ),
        ModelSpec("stacking", stacking, [{"settings": BASE_SETTINGS}]),
    ]


def base_specs() -> list[ModelSpec]:
    """Every classifier at its base settings: the whole comparison without the search."""
    builders = {
        "random_forest": random_forest,
        "gradient_boosting": gradient_boosting,
        "ada_boost": ada_boost,
        "decision_tree": decision_tree,
        "weighted_boosting": weighted_boosting,
    }
    specs = [ModelSpec(name, build, [BASE_SETTINGS[name]]) for name, build in builders.items()]
    return [*specs, ModelSpec("stacking", stacking, [{"settings": BASE_SETTINGS}])]


LIGHT_SETTINGS = {
    "random_forest": {"numTrees": 10, "maxDepth": 5},
    "gradient_boosting": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1},
    "weighted_boosting": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1},
    "ada_boost": {"maxIter": 5, "stepSize": 1.0},
    "decision_tree": {"maxDepth": 5},
}


def light_specs() -> list[ModelSpec]:
    """Small ensembles, for quick runs over any amount of rows."""
    builders = {
        "random_forest": random_forest,
        "gradient_boosting": gradient_boosting,
        "ada_boost": ada_boost,
        "decision_tree": decision_tree,
        "weighted_boosting": weighted_boosting,
    }
    grids = {name: [LIGHT_SETTINGS[name]] for name in builders}
    grids["decision_tree"] = [{"maxDepth": 3}, {"maxDepth": 5}]
    specs = [ModelSpec(name, build, grids[name]) for name, build in builders.items()]
    return [*specs, ModelSpec("stacking", stacking, [{"settings": LIGHT_SETTINGS, "folds": 2}])]
