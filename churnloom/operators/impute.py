"""Nearest-neighbour, most-frequent and scaling stages for the preprocessing pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
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
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnloom.functions.expressions import nan_to_null
from churnloom.operators.clean import ALL_MISSING_FILL, coerce_numeric, column_modes
from churnloom.operators.ordered import running_totals
from churnloom.sources.storage import materialize

# Fixed value: neighbours averaged for one missing cell.
NEIGHBOURS = 5
BLOCK_SIZE = 64
FANOUT = 32
_KEY_BITS = 60
_COPIES = "_copies"


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _observed_mask(columns: list[Column]) -> Column:
    """A text with 1 at position i when column i has a value, else 0; any number of columns."""
    return F.concat(*(F.when(c.isNotNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns))


def _bit(mask: str, i: int) -> Column:
    return F.substring(mask, i + 1, 1) == "1"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


class _KNNParams(HasInputCols):
    k = Param(Params._dummy(), "k", "neighbours per missing cell", TypeConverters.toInt)

    def getK(self) -> int:
        return self.getOrDefault(self.k)


class KNNImputer(Estimator, _KNNParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing numbers with the mean of the k nearest fit rows that have the number.

    The distance is Euclidean over the columns present in both rows, scaled by
    sqrt(columns / columns present in both). Among equal distances the smaller
    coordinates (column by column, missing first) win. A cell without any comparable
    neighbour gets the column mean; a column never observed gets 0.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, k: int = NEIGHBOURS):
        super().__init__()
        self._setDefault(k=NEIGHBOURS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KNNImputerModel:
        columns = self.getInputCols()
        numbers = dataset.select(*(nan_to_null(F.col(c).cast("double")).alias(c) for c in columns))
        donors = materialize(numbers.groupBy(*columns).agg(F.count("*").alias(_COPIES)), "donors")
        return KNNImputerModel._from_donors(donors, columns, self.getK())._resetUid(self.uid)


class KNNImputerModel(Model, _KNNParams, MLReadable, MLWritable):
    """Exact neighbours without comparing every pair.

    Fit rows, collapsed to distinct coordinates, are sorted along a space-filling
    curve and cut into blocks of equal size; blocks are grouped into larger ones
    until a handful is left. Each incomplete row walks down from the top and keeps
    only the blocks whose bounding box may still hold one of its k nearest. The
    boxes bound the distances exactly, so no neighbour is lost. A tree is built per
    pair of patterns (columns the incomplete row has, columns the fit row has).
    """

    donors: DataFrame
    means: dict[str, float]

    def __init__(self) -> None:
        super().__init__()
        self._indexes: dict[tuple[str, ...], tuple[DataFrame, list[DataFrame]]] = {}
        self._known: DataFrame | None = None

    @classmethod
    def _from_donors(cls, donors: DataFrame, columns: list[str], k: int) -> KNNImputerModel:
        model = cls()
        model._set(inputCols=columns, k=k)
        model.donors = donors
        stats = donors.agg(
            *(
                F.try_divide(
                    F.sum(F.col(c) * F.col(_COPIES)),
                    F.sum(F.when(F.col(c).isNotNull(), F.col(_COPIES))),
                ).alias(f"mean_{i}")
                for i, c in enumerate(columns)
            ),
            *(F.min(c).alias(f"low_{i}") for i, c in enumerate(columns)),
            *(F.max(c).alias(f"high_{i}") for i, c in enumerate(columns)),
        ).first()
        model.means = {
            c: 0.0 if stats[f"mean_{i}"] is None else stats[f"mean_{i}"]
            for i, c in enumerate(columns)
        }
        model._low = [stats[f"low_{i}"] or 0.0 for i in range(len(columns))]
        model._width = max(
            ((stats[f"high_{i}"] or 0.0) - model._low[i] for i in range(len(columns))), default=0.0
        )
        return model

    def write(self) -> MLWriter:
        return _KNNWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KNNReader()

    # --- the blocks ------------------------------------------------------------------

    def _with_curve_key(self, spaces: DataFrame) -> DataFrame:
        """Add ``_curve``: interleaved bits of c0.., cut with one cell width in all directions."""
        d = len(self.getInputCols())
        used = min(d, _KEY_BITS)
        bits = max(1, _KEY_BITS // d)
        cell = self._width / (1 << bits) or 1.0
        steps = {}
        for i in range(used):
            step = F.floor((F.col(f"c{i}") - F.lit(self._low[i])) / F.lit(cell))
            inside = F.least(step, F.lit((1 << bits) - 1))
            steps[f"_s{i}"] = F.coalesce(inside, F.lit(0)).cast("bigint")
        terms = (
            f"shiftleft(shiftright(_s{i}, {b}) & 1L, {b * used + i})"
            for b in range(bits)
            for i in range(used)
        )
        return spaces.withColumns(steps).withColumn("_curve", F.expr(" + ".join(terms))).drop(*steps)

    def _index(self, masks: tuple[str, ...]) -> tuple[DataFrame, list[DataFrame]]:
        """(points with their block, box tables from the top down) for the given patterns."""
        if masks in self._indexes:
            return self._indexes[masks]
        columns = self.getInputCols()
        d = len(columns)
        x = [f"x{i}" for i in range(d)]
        base = self.donors.select(
            *(F.col(c).alias(x[i]) for i, c in enumerate(columns)),
            F.col(_COPIES).alias("n"),
            _observed_mask([F.col(c) for c in columns]).alias("mask"),
        )
        spaces = base.select(
            "*", F.explode(F.array(*(F.lit(m) for m in masks))).alias("recv_mask")
        ).where(
            _any([_bit("mask", i) & _bit("recv_mask", i) for i in range(d)])
            & _any([_bit("mask", i) & ~_bit("recv_mask", i) for i in range(d)])
        )
        # Only the columns both rows have count for the distance.
        spaces = spaces.select(
            "*", *(F.when(_bit("recv_mask", i), F.col(x[i])).alias(f"c{i}") for i in range(d))
        )
        # Points with the same coordinates tie at every distance, so the first k in the tie
        # order can be the only neighbours among them. Without this a value that half of
        # all rows have would keep half of all blocks.
        tied = Window.partitionBy("recv_mask", "mask", *(f"c{i}" for i in range(d))).orderBy(
            *(F.col(c).asc_nulls_first() for c in x)
        )
        spaces = (
            spaces.withColumn("_tie", F.row_number().over(tied))
            .where(F.col("_tie") <= self.getK())
            .drop("_tie")
        )
        spaces = self._with_curve_key(spaces).withColumn("_one", F.lit(1))
        space = ["recv_mask", "mask"]
        ranked = running_totals(spaces, space, ["_curve", *x], ["_one"])
        points = materialize(
            ranked.withColumn("block", F.floor((F.col("_one_cum") - 1) / BLOCK_SIZE)).drop(
                "_curve", "_one", "_one_cum", "_one_total"
            ),
            "points",
            keep=True,
        )
        boxes = materialize(
            points.groupBy(*space, "block").agg(
                F.sum("n").alias("n"),
                *(F.min(f"c{i}").alias(f"lo{i}") for i in range(d)),
                *(F.max(f"c{i}").alias(f"hi{i}") for i in range(d)),
            ),
            "boxes",
            keep=True,
        )
        top_block = boxes.agg(F.max("block")).first()[0]
        levels = [boxes.withColumnRenamed("block", "node")]
        while top_block is not None and top_block >= FANOUT:
            top_block //= FANOUT
            levels.append(
                levels[-1]
                .groupBy(*space, F.floor(F.col("node") / FANOUT).alias("node"))
                .agg(
                    F.sum("n").alias("n"),
                    *(F.min(f"lo{i}").alias(f"lo{i}") for i in range(d)),
                    *(F.max(f"hi{i}").alias(f"hi{i}") for i in range(d)),
                )
            )
        self._indexes[masks] = (points, levels[::-1])
        return self._indexes[masks]

    def _near_boxes(self, candidates: DataFrame) -> DataFrame:
        """Boxes that may hold one of the k nearest of their receiver, and a bound on its k-th square."""
        d = len(self.getInputCols())
        near, far = [], []
        for i in range(d):
            r, lo, hi = F.col(f"r{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
            gap = F.greatest(lo - r, r - hi, F.lit(0.0))
            reach = F.greatest(F.abs(r - lo), F.abs(hi - r))
            both = r.isNotNull() & lo.isNotNull()
            near.append(F.when(both, gap * gap).otherwise(F.lit(0.0)))
            far.append(F.when(both, reach * reach).otherwise(F.lit(0.0)))
        one = Window.partitionBy(*(f"r{i}" for i in range(d)), "recv_mask", "mask")
        nearest_first = one.orderBy("_far").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        k = self.getK()
        return (
            candidates.withColumns({"_near": _sum(near), "_far": _sum(far)})
            .withColumn("_held", F.sum("n").over(nearest_first))
            .withColumn("_limit", F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(one))
            .where(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit")))
            .select(*(f"r{i}" for i in range(d)), "recv_mask", "mask", "node", "_limit")
        )

    def _neighbour_means(self, receivers: DataFrame, masks: tuple[str, ...]) -> DataFrame:
        """For distinct incomplete rows r0..: the imputed value of each missing column."""
        d = len(self.getInputCols())
        k = self.getK()
        r = [f"r{i}" for i in range(d)]
        x = [f"x{i}" for i in range(d)]
        points, levels = self._index(masks)
        # At most FANOUT boxes per pair of patterns; their number of pairs is the data's, so
        # Spark decides from the measured size whether to broadcast.
        frontier = self._near_boxes(receivers.join(levels[0], "recv_mask"))
        for level in levels[1:]:
            children = level.withColumns(
                {"parent": F.floor(F.col("node") / FANOUT), "child": F.col("node")}
            ).drop("node")
            frontier = self._near_boxes(
                frontier.drop("_limit")
                .withColumnRenamed("node", "parent")
                .join(children, ["recv_mask", "mask", "parent"])
                .withColumnRenamed("child", "node")
            )
        squares = [
            F.when(
                F.col(r[i]).isNotNull() & F.col(f"c{i}").isNotNull(),
                (F.col(r[i]) - F.col(f"c{i}")) * (F.col(r[i]) - F.col(f"c{i}")),
            ).otherwise(F.lit(0.0))
            for i in range(d)
        ]
        shared = _sum([(_bit("recv_mask", i) & _bit("mask", i)).cast("int") for i in range(d)])
        nearest = [F.col("distance"), *(F.col(c).asc_nulls_first() for c in x)]
        pairs = (
            frontier.withColumnRenamed("node", "block")
            .join(points, ["recv_mask", "mask", "block"])
            # Added up in the order of the bound, so rounding loses no point that lies on it.
            .where(F.col("_limit").isNull() | (_sum(squares) <= F.col("_limit")))
            .withColumn("distance", F.lit(float(d)) / shared * _sum(squares))
        )
        wanted = [F.when(~_bit("recv_mask", i), F.col(x[i])).alias("value") for i in range(d)]
        cells = F.array(*(F.struct(F.lit(i).alias("target"), wanted[i]) for i in range(d)))
        per_cell = Window.partitionBy(*r, "target").orderBy(*nearest)
        taken = F.least(F.col("n"), F.lit(k) - (F.col("_held") - F.col("n")))
        # Each task ranks its own pairs first, so at most k per cell leave it.
        kept = (
            pairs.select(
                *r, "distance", *x, "n", F.inline(F.filter(cells, lambda c: c["value"].isNotNull()))
            )
            .withColumn("_rank", F.row_number().over(per_cell))
            .where(F.col("_rank") <= k)
            .withColumn(
                "_held",
                F.sum("n").over(per_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            )
            .withColumn("taken", taken)
            .where(F.col("taken") > 0)
        )
        here = [F.col("target") == i for i in range(d)]
        return kept.groupBy(*r).agg(
            *(
                F.try_divide(
                    F.sum(F.when(here[i], F.col("value") * F.col("taken"))),
                    F.sum(F.when(here[i], F.col("taken"))),
                ).alias(f"fill{i}")
                for i in range(d)
            )
        )

    def _fills(self, receivers: DataFrame) -> DataFrame | None:
        """Imputed values of the written receivers; None if there are no receivers.

        A pipeline transforms its fit rows once to fit what follows, and once more. So what the
        first table asked for is kept and not looked up again.
        """
        known = self._known
        if known is not None:
            r = [f"r{i}" for i in range(len(self.getInputCols()))]
            same = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) for c in r))
            receivers = materialize(receivers.alias("a").join(known.alias("k"), same, "left_anti"), "receivers")
        # At most one row per pattern of observed columns.
        patterns = receivers.select("recv_mask").distinct().collect()
        masks = tuple(sorted(row["recv_mask"] for row in patterns))
        if not masks:
            return known
        # Written once: every later stage of a pipeline reads the transformed rows again.
        found = materialize(self._neighbour_means(receivers, masks), "fills", keep=known is None)
        if known is None:
            self._known = found
            return found
        return known.unionByName(found)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.getInputCols()
        table = dataset.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in columns})
        incomplete = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
        # Equal incomplete rows are looked up once.
        receivers = materialize(
            table.where(incomplete)
            .select(*(F.col(c).alias(f"r{i}") for i, c in enumerate(columns)))
            .distinct()
            .withColumn("recv_mask", _observed_mask([F.col(f"r{i}") for i in range(len(columns))])),
            "receivers",
        )
        fills = self._fills(receivers)
        if fills is None:
            return table
        same = reduce(
            lambda a, b: a & b,
            (F.col(f"t.{c}").eqNullSafe(F.col(f"f.r{i}")) for i, c in enumerate(columns)),
        )
        filled = (
            table.where(incomplete)
            .alias("t")
            .join(fills.alias("f"), same, "left")
            .select(
                *(
                    F.coalesce(
                        F.col(f"t.{c}"),
                        F.col(f"f.fill{columns.index(c)}"),
                        F.lit(self.means[c]),
                    ).alias(c)
                    if c in columns
                    else F.col(f"t.{c}")
                    for c in table.columns
                )
            )
        )
        # Complete rows pass by without a shuffle.
        return table.where(~incomplete).unionByName(filled)


class _KNNWriter(MLWriter):
    def __init__(self, model: KNNImputerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.donors.write.parquet(f"{path}/donors")


class _KNNReader(MLReader):
    def load(self, path: str) -> KNNImputerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        params = metadata["paramMap"]
        donors = self.sparkSession.read.parquet(f"{path}/donors")
        model = KNNImputerModel._from_donors(
            donors, params["inputCols"], params.get("k", NEIGHBOURS)
        )
        return model._resetUid(metadata["uid"])


class NumericCoercer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Text cells of numeric columns to doubles, non-numbers to null."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return coerce_numeric(dataset, self.getInputCols())


class _FillParams(HasInputCols):
    fills = Param(Params._dummy(), "fills", "fill per column", TypeConverters.toListString)


class ModeImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing text with the most frequent value of the fit rows, smallest on a tie."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ModeImputerModel:
        columns = self.getInputCols()
        modes = column_modes(dataset, columns)
        fills = [modes[c] if modes[c] is not None else ALL_MISSING_FILL for c in columns]
        return ModeImputerModel(inputCols=columns, fills=fills)._resetUid(self.uid)


class ModeImputerModel(Model, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, fills: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.fillna(dict(zip(self.getInputCols(), self.getOrDefault(self.fills))))


class _ScaleParams(HasInputCols):
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "deviation per column", TypeConverters.toListFloat)


class Standardizer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Centre on the mean and divide by the population deviation; a constant column gives 0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> StandardizerModel:
        columns = self.getInputCols()
        row = dataset.agg(
            *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)),
            *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)),
        ).first()
        n = range(len(columns))
        return StandardizerModel(
            inputCols=columns,
            means=[row[f"m{i}"] or 0.0 for i in n],
            scales=[row[f"s{i}"] or 1.0 for i in n],
        )._resetUid(self.uid)


class StandardizerModel(Model, _ScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self,
        *,
        inputCols: list[str] | None = None,
        means: list[float] | None = None,
        scales: list[float] | None = None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        settings = zip(
            self.getInputCols(), self.getOrDefault(self.means), self.getOrDefault(self.scales)
        )
        return dataset.withColumns(
            {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in settings}
        )
