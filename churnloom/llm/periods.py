"""Runs of words that repeat with a period, found in tiles of the scale of the period.

Periods are dealt to octaves, ``m`` to ``2m - 1``. For an octave a text is exploded into tiles
that overlap: every ``2m`` words there is a boundary, and its tile takes in ``4m`` words before it
and ``3m`` after it. A tile is solved on its own, by two Z-functions at the boundary ``c``: they
give for every period ``q`` of the octave how many words from ``c`` on equal the words ``q``
earlier, and how many do before ``c``. Together that is a *fragment*: a stretch of positions
``i`` with ``word[i] == word[i + q]``, cut off where it leaves the tile.

A run of period ``q`` that has at least four periods is such a stretch of ``3q`` positions or
more, so a boundary falls into it that has ``m`` equal words to its right; its other boundaries of
that kind are ``2m`` apart, and tiles reach so far that their fragments touch and cover the run.
Boundaries without ``m`` equal words (seen by hashes of ``m`` words, which never miss one) are
passed over.

Fragments are shuffled by document and period and stitched where they touch. Stretches of
different periods that come to the same words are one run of the smallest of them: a longer period
of a run with four of them or more is a multiple of the smallest one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnloom.llm.tables import fresh, keyed, materialize, text_or_empty

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
_BLOCK = 1 << 20
PARTS = "array<struct<period:long,low:long,high:long>>"
SOLVED = f"n_words long, plain_sha256 string, words string, parts {PARTS}"
RUNS = "array<struct<start:long,period:long,length:long>>"


def least_stretch(period: int) -> int:
    """Positions equal to the one a period on that make a run."""
    return max(LEAST_LENGTH - period, (LEAST_EXPONENT - 1) * period)


def z_function(values: list[int]) -> list[int]:
    """For each place, how many values from there on equal those from the beginning on."""
    n = len(values)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and values[k] == values[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(codes: np.ndarray, at: int, m: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """Fragments (period, low, high) of the tile of the octave ``m`` with its boundary ``at``."""
    ahead, back = 3 * m, 2 * m
    right = codes[at : at + ahead].tolist()
    earlier = codes[at - 2 * m + 1 : at + ahead].tolist()
    z_right = z_function([*right, -1, *earlier])
    left = codes[max(0, at - back) : at][::-1].tolist()
    further = codes[max(0, at - 2 * back) : at - 1][::-1].tolist()
    z_left = z_function([*left, -1, *further])
    found = []
    for q in periods:
        after = z_right[len(right) + 1 + 2 * m - 1 - q]
        # No word lies that far back: the run begins with the text.
        before = z_left[len(left) + q] if q <= len(further) else 0
        if after == ahead or before == back or after + before >= least_stretch(q):
            found.append((q, at - q - before, at - q + after))
    return found


def fragments(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """Fragments (period, low, high) of all tiles of a text; those that touch are joined."""
    n, m = len(codes), 1
    hashes = (codes.astype(np.uint64) + np.uint64(1)) * _FIRST
    hashes ^= hashes >> _SHIFT
    out: list[tuple[int, int, int]] = []
    while LEAST_EXPONENT * m <= n:
        periods = np.arange(m, min(2 * m - 1, n // LEAST_EXPONENT) + 1)
        boundaries = np.arange(2 * m, n - m + 1, 2 * m)
        step = max(1, _BLOCK // m)
        found: list[tuple[int, int, int]] = []
        for first in range(0, len(boundaries), step):
            block = boundaries[first : first + step]
            equal = hashes[block][:, None] == hashes[block[:, None] - periods[None, :]]
            tile, which = np.nonzero(equal)
            edges = np.flatnonzero(np.diff(tile, prepend=-1))
            for begin, end in zip(edges, np.append(edges[1:], len(tile))):
                chosen = periods[which[begin:end]].tolist()
                found += solve_tile(codes, int(block[tile[begin]]), m, chosen)
        out += _joined(found)
        if len(hashes) > m:
            hashes = hashes[: len(hashes) - m] * _FIRST + hashes[m:] * _SECOND
            hashes ^= hashes >> _SHIFT
        m *= 2
    return out


def _joined(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for q, low, high in sorted(found):
        if out and out[-1][0] == q and low <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(out[-1][2], high))
        else:
            out.append((q, low, high))
    return out


def _solved(text: str | Column) -> Column:
    @F.pandas_udf(SOLVED)
    def solve(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = text.encode().split()  # bytes: ASCII white space only
            codes, _ = pd.factorize(np.array([*words, None], object)[:-1])
            parts = fragments(codes)
            joined = b" ".join(words)
            rows.append((len(words), hashlib.sha256(joined).hexdigest(), joined.decode() if parts else None, parts))
        return pd.DataFrame(rows, columns=["n_words", "plain_sha256", "words", "parts"])

    return solve(text)


def _runs(solved: DataFrame) -> DataFrame:
    """``row`` and ``runs``, in order of start and period, of the rows that have one."""
    pieces = solved.where("words is not null").select("row", F.inline("parts"))
    order = Window.partitionBy("row", "period").orderBy("low")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (
        pieces.withColumn("new", (F.col("low") > F.coalesce(before, F.lit(-1))).cast("int"))
        .withColumn("island", F.sum("new").over(order))
        .groupBy("row", "period", "island")
        .agg(F.min("low").alias("start"), F.max("high").alias("high"))
    )
    least = F.greatest(LEAST_LENGTH - F.col("period"), (LEAST_EXPONENT - 1) * F.col("period"))
    return (
        stitched.where(F.col("high") - F.col("start") >= least)
        .withColumn("end", F.col("high") + F.col("period"))
        .groupBy("row", "start", "end")
        .agg(F.min("period").alias("period"))
        .select("row", F.struct("start", "period", (F.col("end") - F.col("start")).alias("length")).alias("run"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("run")).alias("runs"))  # fewer than the row has words
    )


def _collapsed(words: Column, runs: Column) -> Column:
    """The words without those that a run repeats, joined by spaces."""

    @F.pandas_udf("string")
    def collapse(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, runs in zip(texts, found):
            if text is None or runs is None:
                out.append(None)
                continue
            words = np.array([*text.split(" "), None], object)[:-1]
            kept = np.ones(len(words), bool)
            for run in runs:
                kept[run["start"] + run["period"] : run["start"] + run["length"]] = False
            out.append(" ".join(words[kept]))
        return pd.Series(out, dtype=object)

    return collapse(words, runs)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``runs``, ``collapsed`` and ``collapsed_sha256``.

    Words are what ASCII white space separates. A run is a stretch of consecutive words with the
    smallest period ``q``, of six words and four periods at least, that no neighbouring word
    extends. ``collapsed`` is the text, joined by single spaces, without the words that any run
    holds after its first period; it is null where there is no run and so nothing to leave out.
    Null texts count as empty; they, empty ones and those of white space have no words and no
    run. Texts are taken whole, however long; a text of one word repeated is one run. Repeated
    rows give repeated result rows. Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    value = text_or_empty(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))
    solved = materialize(
        docs.select(F.col(id_column).alias("id"), _solved(value).alias("s"))
        .select("id", "s.*")
        .withColumn("row", F.monotonically_increasing_id()),
        "solved",
    )
    runs = materialize(_runs(solved), "runs")
    changed = solved.where("words is not null").select("row", "words").join(runs.hint("merge"), "row")
    changed = changed.select("row", "runs", _collapsed(F.col("words"), F.col("runs")).alias("collapsed"))
    return solved.drop("words", "parts").join(changed.hint("merge"), "row", "left").select(
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("runs", F.array().cast(RUNS)).alias("runs"),
        "collapsed",
        F.coalesce(F.sha2("collapsed", 256), "plain_sha256").alias("collapsed_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with every run cut to its first period; rows without a run stay as they are."""
    named, key = keyed(docs, id_column, text)
    found = periodic_runs(named, key, text).where("collapsed is not null").select(
        key, F.col("collapsed").alias(fresh(docs, "collapsed_text"))
    )
    cut = found.columns[1]
    joined = named.join(found.dropDuplicates([key]).hint("merge"), key, "left")
    return joined.withColumn(text, F.coalesce(cut, text)).select(*docs.columns)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Count, longest repetition and hashes of what ``periodic_runs`` found."""
    none = F.lit(None).cast("struct<start:long,period:long,length:long>")
    # Exact fractions; the runs are in order of start and period, so the first wins a tie.
    best = F.aggregate(
        "runs",
        none,
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return found.withColumn("best", best).select(
        id_column,
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def planted(id_column: str = "doc_id", text: str = "text") -> Column:
    """The text, in which for a tenth of the ids the words from some place on repeat.

    With h the CRC-32 of the decimal id: if h % 10 is 0 and the text has n words, the words from
    a = g % n on (g = h / 10) repeat the first 1 + (n - a) / (3 + g % 8) of them; divisions round
    down. Rows without an id stay as they are.
    """

    @F.pandas_udf("string")
    def plant(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for text, h in zip(texts, hashes.fillna(1).astype("int64")):
            words = text.encode().split() if h % 10 == 0 else []
            if words:
                n, g = len(words), int(h) // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                text = b" ".join(words).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    return plant(text_or_empty(text), F.crc32(F.col(id_column).cast("string").cast("binary")))
