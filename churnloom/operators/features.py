"""From customer columns to one feature vector, and the names behind its slots."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasInputCol,
    HasInputCols,
    HasLabelCol,
    HasOutputCol,
    HasOutputCols,
    HasSeed,
)
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.operators.forests import DealtForest
from churnloom.operators.impute import (
    NEIGHBOURS,
    KNNImputer,
    ModeImputer,
    NumericCoercer,
    Standardizer,
)
from churnloom.operators.ordered import running_totals
from churnloom.operators.weights import with_balanced_weights
from churnloom.sources.storage import materialize

# Fixed values of the feature selection.
SELECTOR_TREES = 100
SELECTOR_SEED = 42
# An unlimited depth is the deepest MLlib grows.
SELECTOR_DEPTH = 30
SELECTOR_BINS = 256

# Values of a text column up to which they travel in the plan and name their slots.
NAMED_CATEGORIES = 1000

ALL_FEATURES = "all_features"
FEATURES_COLUMN = "features"


def feature_names(df: DataFrame, column: str = FEATURES_COLUMN) -> list[str]:
    """Slot names from the vector column's metadata; ``feature_<i>`` where it has none."""
    meta = df.schema[column].metadata.get("ml_attr", {})
    named = {a["idx"]: a.get("name") for group in meta.get("attrs", {}).values() for a in group}
    size = meta.get("num_attrs", len(named))
    return [named.get(i) or f"feature_{i}" for i in range(size)]


def importance_table(
    spark: SparkSession, names: list[str], importances: list[float]
) -> DataFrame:
    """One row per vector slot: position, feature, importance."""
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, importances))]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n most important slots; the earlier slot wins a tie."""
    return importance.orderBy(F.col("importance").desc(), F.col("position").asc()).limit(n)


class ForestSelector(
    Estimator, HasInputCol, HasOutputCol, HasLabelCol, HasSeed,
    DefaultParamsReadable, DefaultParamsWritable,
):
    """Keep the slots whose importance in a class-balanced forest reaches the median."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = ALL_FEATURES,
        outputCol: str = FEATURES_COLUMN,
        labelCol: str = "label",
        numTrees: int = SELECTOR_TREES,
        maxDepth: int = SELECTOR_DEPTH,
        seed: int = SELECTOR_SEED,
    ):
        super().__init__()
        self._setDefault(
            inputCol=ALL_FEATURES,
            outputCol=FEATURES_COLUMN,
            labelCol="label",
            numTrees=SELECTOR_TREES,
            maxDepth=SELECTOR_DEPTH,
            seed=SELECTOR_SEED,
        )
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        # The weights and the forest read the encoded rows several times.
        encoded = materialize(dataset.select(self.getInputCol(), self.getLabelCol()), "encoded")
        weighted = with_balanced_weights(encoded, self.getLabelCol(), "_weight")
        forest = DealtForest(
            featuresCol=self.getInputCol(),
            labelCol=self.getLabelCol(),
            weightCol="_weight",
            numTrees=self.getOrDefault(self.numTrees),
            maxDepth=self.getOrDefault(self.maxDepth),
            maxBins=SELECTOR_BINS,
            cacheNodeIds=True,
            seed=self.getSeed(),
        ).fit(weighted)
        importances = forest.featureImportances.toArray()
        keep = np.flatnonzero(importances >= np.median(importances))
        return VectorSlicer(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            indices=[int(i) for i in keep],
        )


class CategoryIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Number the values of text columns in their order, however many there are.

    The distinct values of all columns are ranked by running totals into one dictionary table
    (column, value, index), which never meets the driver as a whole.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CategoryIndexerModel:
        names = self.getInputCols()
        values = dataset.select(*(F.col(c).cast("string").alias(c) for c in names)).unpivot([], names, "column", "value")
        known = values.where("value is not null").distinct().withColumn("one", F.lit(1))
        ranked = running_totals(known, ["column"], ["value"], ["one"])
        dictionary = materialize(
            ranked.select("column", "value", (F.col("one_cum") - 1).alias("index")), "categories", keep=True
        )
        model = CategoryIndexerModel(dictionary)
        return model._set(inputCols=names, outputCols=self.getOutputCols())._resetUid(self.uid)


class CategoryIndexerModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    """Each value's number as a double; unseen and missing ones have the number after the last.

    Columns of few values carry them in the plan, and as names of the slots; the others join the
    dictionary by value.
    """

    def __init__(self, dictionary: DataFrame | None = None):
        super().__init__()
        self.dictionary = dictionary
        self._sizes: dict[str, int] | None = None
        self._values: dict[str, list[str]] = {}

    def sizes(self) -> dict[str, int]:
        """Values of each column."""
        if self._sizes is None:
            counted = self.dictionary.groupBy("column").agg(F.count("*").alias("n")).collect()
            sizes = {row["column"]: row["n"] for row in counted}  # a row for each column
            few = [c for c, n in sizes.items() if n <= NAMED_CATEGORIES]
            rows = self.dictionary.where(F.col("column").isin(few)).orderBy("column", "index").collect() if few else []
            for row in rows:  # NAMED_CATEGORIES for each column at most
                self._values.setdefault(row["column"], []).append(row["value"])
            self._sizes = {c: sizes.get(c, 0) for c in self.getInputCols()}
        return self._sizes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes, outputs, joined = self.sizes(), {}, set()
        for name, output in zip(self.getInputCols(), self.getOutputCols()):
            size = sizes[name]
            if size <= NAMED_CATEGORIES:
                values = self._values.get(name, [])
                place = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), F.col(name).cast("string"))
                index = F.when(F.coalesce(place, F.lit(0)) > 0, place - 1)
                meta = {"type": "nominal", "vals": [*values, "__unknown"]}
            else:
                own = self.dictionary.where(F.col("column") == name).select(
                    F.col("value").alias(f"_value_{output}"), F.col("index").alias(f"_index_{output}")
                )
                dataset = dataset.join(own, F.col(name).cast("string") == F.col(f"_value_{output}"), "left")
                dataset = dataset.drop(f"_value_{output}")
                joined.add(f"_index_{output}")
                index = F.col(f"_index_{output}")
                meta = {"type": "nominal", "num_vals": size + 1}
            number = F.coalesce(index.cast("double"), F.lit(float(size)))
            outputs[output] = number.alias(output, metadata={"ml_attr": {"name": output, **meta}})
        kept = [c for c in dataset.columns if c not in outputs and c not in joined]
        return dataset.select(*kept, *outputs.values())

    def write(self) -> MLWriter:
        return _CategoryWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CategoryReader(cls)


class _CategoryWriter(MLWriter):
    """Metadata and the dictionary as a table."""

    def __init__(self, model: CategoryIndexerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.dictionary.write.parquet(f"{path}/dictionary")


class _CategoryReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/dictionary"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def encoding_stages(numeric: list[str], categorical: list[str], k: int = NEIGHBOURS) -> list:
    """Impute, scale and one-hot encode into one sparse vector: numeric slots, then categories.

    The indexer's extra slot for unseen and missing text is the one the encoder
    drops, so such a cell encodes as all zeros.
    """
    stages: list = []
    if numeric:
        stages += [
            NumericCoercer(inputCols=numeric),
            KNNImputer(inputCols=numeric, k=k),
            Standardizer(inputCols=numeric),
        ]
    if categorical:
        indexed = [f"{c}_index" for c in categorical]
        stages += [
            ModeImputer(inputCols=categorical),
            CategoryIndexer(inputCols=categorical, outputCols=indexed),
            OneHotEncoder(
                inputCols=indexed, outputCols=[f"{c}_onehot" for c in categorical], dropLast=True
            ),
        ]
    stages.append(
        VectorAssembler(
            inputCols=[*numeric, *(f"{c}_onehot" for c in categorical)], outputCol=ALL_FEATURES
        )
    )
    return stages


def preprocessing(
    numeric: list[str],
    categorical: list[str],
    k: int = NEIGHBOURS,
    selector_trees: int = SELECTOR_TREES,
    selector_depth: int = SELECTOR_DEPTH,
) -> Pipeline:
    """All stages up to the selected feature vector."""
    return Pipeline(
        stages=[
            *encoding_stages(numeric, categorical, k),
            ForestSelector(numTrees=selector_trees, maxDepth=selector_depth),
        ]
    )
