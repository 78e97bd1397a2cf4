"""Removal of long repeated byte strings by ranking positions at growing lengths.

As in prefix doubling, Spark groups positions by the ranks of what lies on their two sides, in
rounds over growing lengths; equal pairs get one rank, and a position drops out as soon as its
pair is unique, since no longer string there can repeat, or once it is past the threshold.
Ranking every byte of the corpus would shuffle many times the corpus, so positions that share
their fate are ranked together:

1. *Anchors*, a quarter of the length. In each window of ``length`` bytes the seed
   (``length / 4`` bytes) with the smallest hash is the anchor; it depends on the window's bytes
   alone, so equal windows have the same anchor at the same place, and some 75 neighbouring
   windows share one. A run of windows with one anchor is a *stretch*. If its seed occurs nowhere
   else, no window of the stretch repeats. Stretches that are equal as a whole are one row with
   a count, however many copies there are: all their windows repeat.
2. *Bands*, nearly the length. Where one anchor has different stretches, at the edges of repeated
   passages, windows are taken in bands of ``BAND`` offsets from the anchor. What all windows of
   a band cover is ranked by the pair (bytes before the anchor, bytes from it on); a unique
   pair drops the band. A band that is equal as a whole to another repeats as a whole.
3. *Windows*, the length. The bands left, where a passage begins or ends, are ranked window by
   window.

Ranks are 64-bit hashes of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnloom.llm.tables import materialize, text_or_empty

_PIECE = 1 << 20
_PLACE_BITS = 21
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
STRETCH = "a long, b int, seed long, whole long, start int, n int, rel int"
#: Window offsets from the anchor that are ranked together.
BAND = 16
CONTEXT = "a long, b int, start int, n int, rel int, context binary"
BANDS = "a long, b int, start int, rel int, k int, low int, high int, left long, right long, hull long"
WINDOWS = "a long, b int, pos int, left long, right long"


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, and a random number for each byte."""

    def __init__(self, size: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.up = np.cumprod(np.full(size, _BASE, np.uint64))
        self.down = np.cumprod(np.full(size, inverse, np.uint64))
        rng = np.random.default_rng(5)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_powers: list[_Powers] = []


class Hashes:
    """Hashes of any substring of some bytes, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        if not _powers or len(_powers[-1].up) <= len(data):
            _powers[:] = [_Powers(max(len(data) + 1, _PIECE + (1 << 12)))]
        self.down = _powers[-1].down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_powers[-1].byte[data] * _powers[-1].up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else self.sums[:0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    covered = 1
    while 2 * covered <= width:
        values = np.minimum(values[:-covered], values[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of the texts: text number, seed hash, hash of the whole, start and number of windows, anchor."""
    seed, out = length // 4, []
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    for at in range(0, max(0, len(flat) - length + 1), _PIECE):
        data = flat[at : at + _PIECE + length - 1]
        hashes = Hashes(data)
        keys = hashes.every(seed)
        keys = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
        anchor = (_sliding_minimum(keys, length - seed + 1) & _PLACE).astype(np.int64)
        place = np.arange(len(anchor))
        text = np.searchsorted(begins, at + place, "right") - 1
        inside = at + place + length <= begins[text] + sizes[text]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(anchor)))
        kept = inside[first]
        first, n = first[kept], n[kept]
        whole = hashes.of(first, first + n + length - 1)
        whole = _mixed(whole + (n * 512 + anchor[first] - first).astype(np.uint64))
        own = hashes.of(anchor[first], anchor[first] + seed)
        rel = anchor[first] - first
        out.append((text[first], own, whole, first + at - begins[text[first]], n, rel))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out))


def _find_stretches(docs: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, seed, whole, start, n, rel = stretches([t.encode() for t in batch.text], length)
            yield pd.DataFrame({"a": batch.a.to_numpy()[text], "b": batch.b.to_numpy()[text],
                                "seed": seed.view(np.int64), "whole": whole.view(np.int64),
                                "start": start, "n": n, "rel": rel})

    return docs.select("a", "b", "text").mapInPandas(find, STRETCH)


def _find_contexts(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the stretches in ``parts``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, text, parts in zip(batch.a, batch.b, batch.text, batch.parts):
                data = text.encode()
                for part in parts:
                    start, n = part["start"], part["n"]
                    rows.append((a, b, start, n, part["rel"], data[start : start + n + length - 1]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTEXT.split(", ")], dtype=object)

    return docs.mapInPandas(find, CONTEXT)


def _joined(contexts) -> tuple[Hashes, np.ndarray]:
    """Hashes over all contexts, and where each begins."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return Hashes(np.frombuffer(b"".join(contexts), np.uint8)), begins


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` rows: its number repeated, and 0, 1, ... within it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _find_bands(contexts: DataFrame, length: int) -> DataFrame:
    band = min(BAND, length // 8)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            hashes, begins = _joined(batch.context)
            rel, n = batch.rel.to_numpy(np.int64), batch.n.to_numpy(np.int64)
            first = (rel - n + 1) // band
            row, step = _spread(rel // band - first + 1)
            k, rel = first[row] + step, rel[row]
            low, high = np.maximum(k * band, rel - n[row] + 1), np.minimum(k * band + band - 1, rel)
            anchor = begins[row] + rel
            left = hashes.of(anchor - k * band, anchor)
            right = hashes.of(anchor, anchor - k * band - (band - 1) + length)
            hull = hashes.of(anchor - high, anchor - low + length)
            yield pd.DataFrame({
                **{c: batch[c].to_numpy()[row] for c in ("a", "b", "start")},
                "rel": rel, "k": k, "low": low, "high": high,
                "left": _mixed(left + k.astype(np.uint64)).view(np.int64), "right": right.view(np.int64),
                "hull": _mixed(hull + (low * 512 + high).astype(np.uint64)).view(np.int64),
            })

    return contexts.mapInPandas(find, BANDS)


def _find_windows(bands: DataFrame, length: int) -> DataFrame:
    """Each window of the bands by its position, and the ranks before and from its anchor on."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            hashes, begins = _joined(batch.context)
            low, high = batch.low.to_numpy(np.int64), batch.high.to_numpy(np.int64)
            row, step = _spread(high - low + 1)
            offset, rel = low[row] + step, batch.rel.to_numpy(np.int64)[row]
            anchor = begins[row] + rel
            left = _mixed(hashes.of(anchor - offset, anchor) + offset.astype(np.uint64))
            yield pd.DataFrame({
                **{c: batch[c].to_numpy()[row] for c in ("a", "b")},
                "pos": batch.start.to_numpy(np.int64)[row] + rel - offset,
                "left": left.view(np.int64),
                "right": hashes.of(anchor, anchor - offset + length).view(np.int64),
            })

    return bands.mapInPandas(find, WINDOWS)


def _not_unique(rows: DataFrame, *rank: str) -> DataFrame:
    """The ranks that more than one row has, written."""
    counted = rows.groupBy(*rank).agg(F.count("*").alias("n")).where("n > 1").select(*rank)
    return materialize(counted, "ranks")


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """``a``, ``b`` and ``parts``: runs (start, end) of bytes covered by repeated strings.

    ``docs`` has the keys ``a``, ``b`` and ``text``.
    """
    every = materialize(_find_stretches(docs, length), "stretches")
    seeds = materialize(
        every.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "seeds"
    )
    shared = materialize(every.join(seeds, "seed", "left_semi"), "shared")
    wholes = materialize(
        shared.groupBy("seed", "whole").agg(
            F.count("*").alias("copies"), F.min(F.struct("a", "b", "start", "n", "rel")).alias("one")
        ),
        "wholes",
    )
    copied = wholes.where("copies > 1").select("whole", "seed")
    runs = shared.join(copied.hint("merge"), ["whole", "seed"], "left_semi").select(
        "a", "b", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")
    )
    varied = _not_unique(wholes, "seed")
    parts = materialize(
        wholes.join(varied.hint("merge"), "seed", "left_semi")
        .select("one.*")
        .groupBy("a", "b")
        .agg(F.collect_list(F.struct("start", "n", "rel")).alias("parts")),
        "parts",
    )
    texts = docs.select("a", "b", "text").join(parts.hint("merge"), ["a", "b"]).dropDuplicates(["a", "b"])
    contexts = materialize(_find_contexts(texts, length), "contexts")

    every_band = materialize(_find_bands(contexts, length), "bands")
    cores = _not_unique(every_band, "left", "right")
    shared_bands = materialize(every_band.join(cores.hint("merge"), ["left", "right"], "left_semi"), "bands")
    hulls = _not_unique(shared_bands, "hull")
    same = shared_bands.join(hulls.hint("merge"), "hull", "left_semi")
    position = F.col("start") + F.col("rel")
    same_runs = same.select(
        "a", "b", (position - F.col("high")).alias("start"), (position - F.col("low") + length).alias("end")
    )
    # Cores of bands that are not equal as a whole; one band of each kind is looked at.
    open_cores = materialize(
        shared_bands.join(hulls.hint("merge"), "hull", "left_anti").select("left", "right").distinct(), "cores"
    )
    kinds = shared_bands.join(open_cores.hint("merge"), ["left", "right"], "left_semi").groupBy(
        "left", "right", "hull"
    ).agg(F.min(F.struct("a", "b", "start", "rel", "low", "high")).alias("one"))
    looked = kinds.select("one.*").join(
        contexts.select("a", "b", "start", "context").hint("merge"), ["a", "b", "start"]
    )
    windows = materialize(_find_windows(looked, length), "windows")
    final = windows.join(
        _not_unique(windows, "left", "right").hint("merge"), ["left", "right"], "left_semi"
    ).select("a", "b", "pos")
    order = Window.partitionBy("a", "b").orderBy("pos")
    islands = (
        final.withColumn("island", F.col("pos") - F.row_number().over(order))
        .groupBy("a", "b", "island")
        .agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("end"))
        .select("a", "b", "start", "end")
    )
    # A document's runs are fewer than its bytes.
    return materialize(
        runs.unionByName(same_runs)
        .unionByName(islands)
        .groupBy("a", "b")
        .agg(F.collect_set(F.struct("start", "end")).alias("parts")),
        "repeated",
    )


def _merged(parts, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((p["start"], min(size, p["end"])) for p in parts):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeated(
    docs: DataFrame, length: int = 200, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``spans`` (start, end) removed, and the bytes ``kept``.

    A byte of the UTF-8 text is removed if a string of ``length`` bytes that covers it also
    starts somewhere else, in another row or the same one; overlapping occurrences count. Texts
    of fewer bytes, empty and null texts keep all they have. Repeated rows repeat each other.
    Other columns are ignored; an empty table gives an empty result. ``length`` must be a
    multiple of 4.
    """
    if length < 8 or length % 4:
        raise ValueError("length must be a multiple of 4, and 8 at least")
    value = text_or_empty(text)
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(F.col(id_column).cast("string"), value).alias("a"),
        F.pmod(F.crc32(value.cast("binary")), F.lit((1 << 31) - 1)).cast("int").alias("b"),
        value.alias("text"),
    )
    spans = repeated(rows.where(F.octet_length("text") >= length), length)

    @F.pandas_udf("n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, parts in batches:
            out = []
            for value, found in zip(texts, parts):
                data = value.encode()
                gone = _merged(found, len(data)) if found is not None else []
                edges = [0, *[x for span in gone for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), gone, kept))
            yield pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    joined = rows.join(spans, ["a", "b"], "left")
    return joined.select("id", cut("text", "parts").alias("cut")).select(
        F.col("id").alias(id_column), "cut.n_bytes", "cut.spans", "cut.kept"
    )


def digest(removed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and hashes of what ``remove_repeated`` found."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return removed.select(
        id_column,
        "n_bytes",
        lost.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

