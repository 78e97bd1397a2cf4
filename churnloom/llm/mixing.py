"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted once into cells (source, language, topic) of tokens. Raking multiplies a
cell's tokens by the target share of its source over the present one, then the same for its
language and its topic, in turn, until the three marginals have their target shares. A round
reads the cell table, never the documents: however many documents a source has, it has at most
as many cells as there are pairs of a language and a topic. The weight of a cell's tokens
gives each of its documents a probability; a hash of the document's id and a seed decides, so
a rerun or another partitioning draws the same documents.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnloom.llm.tables import fresh, materialize

_LOG = logging.getLogger(__name__)

DIMENSIONS = ("source", "lang", "topic")
NULL = "(null)"

#: Topics of the production mix: the first rule that a text meets, else "prose".
TOPIC_RULES = (
    ("empty", r"^[ \t\r\n]*$"),
    ("contact", r"@[A-Za-z0-9-]+[.][A-Za-z]|[+][0-9][0-9 ().-]{7}"),
    ("licence", r"(?i)licen[sc]ed|all rights reserved"),
    ("table", r"[|][^|\n]*[|][^|\n]*[|]"),
    ("shouting", r"[A-Z]{2,}!!"),
    ("symbols", r"[*&%$#]{3}"),
)
#: Shares are raised to these powers, so that large groups give way to small ones.
TEMPERING = (("source", 0.7), ("lang", 0.8), ("topic", 0.9))


def topic(text: str = "text") -> Column:
    value = F.coalesce(F.col(text), F.lit(""))
    chain = reduce(lambda c, r: c.when(value.rlike(r[1]), r[0]), TOPIC_RULES, F.when(F.lit(False), ""))
    return chain.otherwise("prose")


def tokens(text: str = "text") -> Column:
    """Words of a text, at least 1, so that empty documents can be drawn too."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^ \\t\\r\\n]+"))).cast("long")


def cell_columns(docs: DataFrame, topic_column: Column) -> list[Column]:
    named = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_column}
    return [F.coalesce(named[d].cast("string"), F.lit(NULL)).alias(d) for d in DIMENSIONS]


def count_cells(docs: DataFrame, topic_column: Column, token_column: Column) -> DataFrame:
    """``tokens`` and ``docs`` of each cell; a null source, language or topic is a value of its own."""
    return (
        docs.select(*cell_columns(docs, topic_column), token_column.alias("tokens"))
        .groupBy(*DIMENSIONS)
        .agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("docs"))
    )


def tempered_targets(cells: DataFrame, tempering: tuple = TEMPERING) -> DataFrame:
    """Target ``share`` of each ``value`` of each ``dimension``: its own share to a power, rescaled."""
    return reduce(
        DataFrame.unionByName,
        [
            cells.groupBy(F.col(d).alias("value"))
            .agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
            .select(F.lit(d).alias("dimension"), "value", "share")
            for d, power in tempering
        ],
    )


def _rescaled(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """Targets of the values that occur, summing to 1 in each dimension."""
    there = reduce(
        DataFrame.unionByName,
        [cells.select(F.lit(d).alias("dimension"), F.col(d).alias("value")).distinct() for d in DIMENSIONS],
    )
    present = targets.join(there, ["dimension", "value"], "left_semi")
    sums = present.groupBy("dimension").agg(F.sum("share").alias("total"))
    return present.join(sums, "dimension").select(
        "dimension", "value", (F.col("share") / F.col("total")).alias("share")
    )


#: Rounds in one Spark job; convergence is looked at after each job.
ROUNDS_A_JOB = 5


class Unreachable(ValueError):
    """Targets that no weights of the cells can meet."""


def _gap(table: DataFrame) -> float:
    """Largest relative distance of a marginal from its target."""
    total = table.agg(F.sum("mass")).first()[0] or 0.0
    if total <= 0:
        return 0.0
    gaps = [
        table.groupBy(d).agg((F.sum("mass") / F.lit(total)).alias("got"), F.first(f"{d}_share").alias("share"))
        .where("share > 0").agg(F.max(F.abs(F.col("got") / F.col("share") - 1))).first()[0]
        for d in DIMENSIONS
    ]
    return max(g or 0.0 for g in gaps)


def rake(
    cells: DataFrame,
    targets: DataFrame,
    rounds: int = 500,
    tolerance: float = 1e-9,
    most_residual: float | None = 1e-6,
) -> DataFrame:
    """``cells`` with ``weight``: the factor that brings every marginal to its target share.

    A round fits each dimension once. Rounds end when the last one moved no cell by more than
    ``tolerance`` of itself. If that does not happen within ``rounds``, or the marginals end more
    than ``most_residual`` of their targets away from them, no weights of these cells meet all
    targets (a value may occur only with values of a smaller target), and :class:`Unreachable`
    is raised; with ``most_residual`` None the last weights are returned. ``residual`` is that
    distance, the same in all rows. A value without a target gets weight 0; targets of values that
    do not occur are spread over the others.
    """
    share = materialize(_rescaled(targets, cells), "targets")
    started = cells
    for d in DIMENSIONS:
        own = share.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("share").alias(f"{d}_share"))
        started = started.join(own, d, "left").fillna(0.0, [f"{d}_share"])
    table = materialize(started.withColumn("mass", F.col("tokens")), "cells")
    done = 0
    while done < rounds:
        for _ in range(min(ROUNDS_A_JOB, rounds - done)):
            table = table.withColumn("before", F.col("mass"))
            for d in DIMENSIONS:
                marginal = F.sum("mass").over(Window.partitionBy(d))
                table = table.withColumn(
                    "mass",
                    F.when(marginal > 0, F.col("mass") * (F.col(f"{d}_share") / marginal)).otherwise(0.0),
                )
            done += 1
        table = materialize(table, "raked")
        step = F.abs(F.col("mass") - F.col("before")) / F.greatest("mass", "before", F.lit(1e-300))
        if (table.agg(F.max(step)).first()[0] or 0.0) <= tolerance:
            break
        table = table.drop("before")
    residual = _gap(table)
    if most_residual is not None and residual > most_residual:
        raise Unreachable(f"after {done} rounds a marginal is {residual:.3g} of its target away from it")
    n = table.agg(F.sum("tokens")).first()[0] or 0.0
    return table.select(
        *DIMENSIONS,
        "tokens",
        "docs",
        (F.col("mass") * F.lit(n) / F.col("tokens")).alias("weight"),
        F.lit(residual).alias("residual"),
    )


def uniform(seed: int, id_column: str = "doc_id") -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    name = F.concat_ws("|", F.coalesce(F.col(id_column).cast("string"), F.lit(NULL)), F.lit(seed))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / float(16**12)


def mix(
    docs: DataFrame,
    targets: DataFrame | None = None,
    rate: float = 1.0,
    seed: int = 42,
    topic_column: Column | None = None,
    token_column: Column | None = None,
    most_residual: float | None = 1e-6,
    id_column: str = "doc_id",
) -> tuple[DataFrame, dict[str, str]]:
    """Documents drawn with calibrated probabilities, and the names of the columns added.

    A document's probability is ``rate`` times its cell's weight over the largest weight. So the
    expected tokens of the sample have the target marginals exactly, and with ``rate`` 1 no larger
    sample has them. ``targets`` (``dimension``, ``value``, ``share``) defaults to
    ``tempered_targets``. Given targets that cannot be met within ``most_residual`` of themselves are
    an error; the default ones are then met as far as they can be, and the residual is logged. Null sources, languages and topics are values of their own, null
    and empty texts weigh one token, rows with one id are drawn together, an empty table
    gives an empty sample. All columns stay; names that clash get a number.
    """
    topic_column = topic() if topic_column is None else topic_column
    token_column = tokens() if token_column is None else token_column
    cells = materialize(count_cells(docs, topic_column, token_column), "cells")
    own = targets is None
    targets = tempered_targets(cells) if own else targets
    raked = materialize(rake(cells, targets, most_residual=None if own else most_residual), "raked")
    residual = raked.agg(F.max("residual")).first()[0] or 0.0
    if residual > 1e-6:
        _LOG.warning("the sample misses a target by %.3g of it", residual)
    top = raked.agg(F.max("weight")).first()[0] or 1.0
    chances = raked.select(*DIMENSIONS, "weight", (F.col("weight") / F.lit(top) * F.lit(rate)).alias("probability"))
    names = {n: fresh(docs, f"mix_{n}") for n in (*DIMENSIONS, "tokens", "weight", "probability")}
    for n in ("weight", "probability"):
        chances = chances.withColumnRenamed(n, names[n])
    for d in DIMENSIONS:
        chances = chances.withColumnRenamed(d, names[d])
    cells_of = dict(zip(DIMENSIONS, cell_columns(docs, topic_column)))
    marked = docs.select(
        "*", *[cells_of[d].alias(names[d]) for d in DIMENSIONS], token_column.alias(names["tokens"])
    )
    keys = [names[d] for d in DIMENSIONS]
    drawn = marked.join(_small(chances), keys).where(uniform(seed, id_column) < F.col(names["probability"]))
    return drawn, names


#: Cells that are sent to every executor; with more, Spark joins by shuffle and splits hot cells.
BROADCAST_CELLS = 100_000


def _small(chances: DataFrame) -> DataFrame:
    return F.broadcast(chances) if chances.count() <= BROADCAST_CELLS else chances


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with ``weight`` and ``probability``, all other columns as they are."""
    drawn, names = mix(docs, **settings)
    added = {n: fresh(docs, n) for n in ("weight", "probability")}
    return drawn.select(*docs.columns, *[F.col(names[n]).alias(added[n]) for n in added])
