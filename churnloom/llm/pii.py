"""Personal data: exact base spans, and a skip-chain conditional random field that adds to them.

Base spans of four kinds come from fixed patterns with checks. The random field then labels
mentions. Its graph has a node for each base span, for each other token with a digit or an at
sign (short numbers side by side are one), and for each word that is the local part of an address
in the document. An edge joins neighbours in the text (chain), and a node and the next one with
the same letters and digits, last digits or local part, however far away (skip). Base spans are
observed; loopy sum-product messages carry their labels along the edges, so that the mentions of
one entity in a document come out with one label. Nodes that end up with a kind at high
probability, outside base spans, are the added spans.

Potentials are trained here, piece by piece: Spark counts (token shape, label), (label, label)
along chains and (label, label) along skips over all documents, with base spans as labels. A node
that shares a key with a base span but is none may be a mention that the patterns miss: its label
is unknown, so it is in no count. It is scored by a masked shape, without the marks by which the
patterns tell a base span. The node potentials are a log-linear model of the shape's features
fitted to the counts, the edge potentials smoothed log ratios. The number of shapes is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the next two can only start where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9()+ -]+")
_WORD = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]+(?![A-Za-z0-9])")
_PLAIN = re.compile(r"[^0-9A-Za-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points: by kind in the order of ``KINDS``, then start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


@dataclass
class Token:
    start: int
    end: int
    shape: tuple[int, ...]
    keys: tuple[str, ...]
    label: int  # of the base span that covers it, else 0
    masked: tuple[int, ...] = ()
    linked: bool = False  # has no label, but shares a key with a base span


def _shape(token: str) -> tuple[int, ...]:
    digits = _digits(token)
    letters = sum(c.isalpha() for c in token)
    return (
        min(len(digits), 20),
        min(letters, 3),
        int("@" in token) + int("@" in token and "." in token.partition("@")[2]),
        min(token.count("."), 4),
        int(token[0] == "+") + 2 * int("(" in token),
        int(13 <= len(digits) <= 19 and luhn(digits)),
        int("-" in token),
    )


def _masked(token: str) -> tuple[int, ...]:
    """The shape without what the patterns ask for, in values that no whole shape has."""
    digits, letters = len(_digits(token)), sum(c.isalpha() for c in token)
    return (100 + sum(digits >= n for n in (1, 7, 13, 20)), 100 + min(letters, 1))


def _keys(token: str) -> tuple[str, ...]:
    """What mentions of one entity have in common: letters and digits, last digits, local part."""
    plain, digits = _PLAIN.sub("", token).lower(), _digits(token)
    local = _PLAIN.sub("", token.partition("@")[0]).lower() if "@" in token else ""
    keys = [k for k in (plain, local) if len(k) >= 4] + ([digits, digits[-7:]] if len(digits) >= 7 else [])
    return tuple(dict.fromkeys(keys))


def _token(text: str, start: int, end: int, keys: tuple[str, ...], label: int) -> Token:
    token = text[start:end]
    return Token(start, end, _shape(token), keys, label, _masked(token))


def _joins(one: Token, two: Token, text: str) -> bool:
    """Whether two tokens are short numbers side by side, as the groups of one phone number."""
    return (
        not one.label and not two.label and text[one.end : two.start].strip("()") in (" ", "-")
        and bool(_NUMBER.fullmatch(text, one.start, one.end) and _NUMBER.fullmatch(text, two.start, two.end))
        and len(_digits(text[two.start : two.end])) <= 6 and len(_digits(text[one.start : two.end])) <= 15
        and len(_digits(re.split(r"[ -]", text[one.start : one.end])[-1])) <= 6
    )


def tokens(text: str, spans: list[tuple[str, int, int]]) -> list[Token]:
    """Nodes in text order: base spans with the tokens they touch, other tokens, local parts."""
    covered = sorted((a, b, LABELS.index(kind)) for kind, a, b in spans)
    out, at, last = [], 0, -1
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _MARK.search(token):
            continue
        start = m.start() + len(token) - len(token.lstrip("\"'([{<,;:.!?*&%$#"))
        end = m.end() - len(token) + len(token.rstrip("\"')]}>,;:.!?*&%$#"))
        if start >= end:
            continue
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        inside = []
        while at + len(inside) < len(covered) and covered[at + len(inside)][0] < end:
            inside.append(covered[at + len(inside)])
        label = inside[0][2] if inside else 0
        if inside and last == at:  # another part of the span before
            out[-1] = _token(text, out[-1].start, end, out[-1].keys, label)
        elif inside:
            keys = dict.fromkeys(k for a, b, _ in inside for k in _keys(text[a:b]))
            out.append(_token(text, start, end, tuple(keys), label))
        else:
            out.append(_token(text, start, end, _keys(text[start:end]), 0))
        last = at if inside else -1
    found: list[Token] = []
    for token in out:
        if found and _joins(found[-1], token, text):
            start = found.pop().start
            token = _token(text, start, token.end, _keys(text[start : token.end]), 0)
        found.append(token)
    locals_ = {text[a:b].partition("@")[0].lower() for kind, a, b in spans if kind == "email"}
    locals_ = {x for x in locals_ if len(x) >= 4 and re.search(r"[a-z][._+-][a-z]", x) and not _DIGIT.search(x)}
    if locals_:
        for m in _WORD.finditer(text):
            word = m.group().strip(".-")
            if word.lower() in locals_ and text[m.end() : m.end() + 1] != "@":
                start = m.start() + m.group().index(word)
                found.append(_token(text, start, start + len(word), _keys(word), 0))
        found.sort(key=lambda t: t.start)
    known = {key for t in found if t.label for key in t.keys}
    for t in found:
        t.linked = not t.label and not known.isdisjoint(t.keys)
    return found


def edges(found: list[Token], text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Skip edges to the next token that shares a key; chain edges between other neighbours."""
    chain, skip, last = [], [], {}
    for i, token in enumerate(found):
        partners = {last[key] for key in token.keys if key in last}
        if i and i - 1 not in partners:
            if text[found[i - 1].end : token.start].count(" ") <= 1 and token.start - found[i - 1].end <= 4:
                chain.append((i - 1, i))
        skip += [(j, i) for j in sorted(partners)]
        last.update((key, i) for key in token.keys)
    return chain, skip


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.text:
            if not text:
                continue
            found = tokens(text, base_spans(text)) if "@" in text or _DIGIT.search(text) else []
            if not found:
                continue
            chain, skip = edges(found, text)
            seen = [not t.linked for t in found]
            for t, known in zip(found, seen):
                if known:
                    counts.update(("node", ",".join(map(str, x)), t.label, 0) for x in (t.shape, t.masked))
            counts.update(("chain", "", found[i].label, found[j].label) for i, j in chain if seen[i] and seen[j])
            counts.update(("skip", "", found[i].label, found[j].label) for i, j in skip if seen[i] and seen[j])
    rows = [(*key, n) for key, n in counts.items()]
    yield pd.DataFrame(rows, columns=["part", "shape", "a", "b", "n"], dtype=object)


def _features(shape: tuple[int, ...]) -> list[tuple[int, int]]:
    return [(i, value) for i, value in enumerate(shape)] + [(99, int(shape[0] >= 100))]


@dataclass
class SkipChainField:
    """Potentials: log scores of labels by shape, and of label pairs on chain and skip edges."""

    index: dict[tuple[int, int], int]
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def node(self, shape: tuple[int, ...]) -> np.ndarray:
        rows = [self.index[f] for f in _features(shape) if f in self.index]
        scores = self.weights[rows].sum(axis=0) if rows else np.zeros(len(LABELS))
        return scores - np.logaddexp.reduce(scores)

    def marginals(
        self, found: list[Token], chain: list, skip: list, rounds: int = 20, damping: float = 0.3
    ) -> np.ndarray:
        """Label probabilities of each token after loopy sum-product messages."""
        scores = np.array([self.node(t.masked if t.linked else t.shape) for t in found])
        for i, token in enumerate(found):
            if token.label:
                scores[i] = -50.0
                scores[i, token.label] = 0.0
        pairs = np.array(chain + skip, np.int64).reshape(-1, 2)
        if len(pairs):
            kind = np.array([0] * len(chain) + [1] * len(skip))
            table = np.stack([self.chain, self.skip])[kind]
            source = np.concatenate([pairs[:, 0], pairs[:, 1]])
            target = np.concatenate([pairs[:, 1], pairs[:, 0]])
            table = np.concatenate([table, table.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            messages = np.zeros((len(source), len(LABELS)))
            for _ in range(rounds):
                belief = scores.copy()
                np.add.at(belief, target, messages)
                out = np.logaddexp.reduce((belief[source] - messages[back])[:, :, None] + table, axis=1)
                out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
                step = np.abs(out - messages).max()
                messages = damping * messages + (1 - damping) * out
                if step < 1e-4:
                    break
            scores = scores.copy()
            np.add.at(scores, target, messages)
        return np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True))

    def spans(self, text: str | None, sure: float = 0.9) -> tuple[list, list]:
        """Base spans, and the spans that the field adds, both as (kind, start, end)."""
        base = base_spans(text)
        if not text or not ("@" in text or _DIGIT.search(text)):
            return base, []
        found = tokens(text, base)
        if all(t.label for t in found) or not found:
            return base, []
        chain, skip = edges(found, text)
        p = self.marginals(found, chain, skip)
        added = [
            (LABELS[k], t.start, t.end)
            for t, row in zip(found, p)
            if not t.label and (k := int(row.argmax())) and row[k] >= sure
        ]
        return base, added


def _pair_scores(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Smoothed log ratio of seen to independent label pairs, the same both ways."""
    joint = counts + counts.T + smoothing
    joint = joint / joint.sum()
    alone = joint.sum(axis=0)
    return np.log(joint) - np.log(alone)[:, None] - np.log(alone)[None, :]


def fit(docs: DataFrame, text: str = "text", steps: int = 300, penalty: float = 1e-4) -> SkipChainField:
    """Potentials from counts over all rows of ``docs``; their number follows the shapes, not the rows."""
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInPandas(
        _statistics, "part string, shape string, a int, b int, n long"
    )
    rows = parts.groupBy("part", "shape", "a", "b").agg(F.sum("n").alias("n"))
    counts = sorted(tuple(r) for r in rows.collect())  # bounded by the shapes
    size = len(LABELS)
    pair = {"chain": np.zeros((size, size)), "skip": np.zeros((size, size))}
    shapes: dict[tuple[int, ...], np.ndarray] = {}
    for part, shape, a, b, n in counts:
        if part == "node":
            key = tuple(map(int, shape.split(",")))
            shapes.setdefault(key, np.zeros(size))[a] += n
        else:
            pair[part][a, b] += n
    names = sorted({f for shape in shapes for f in _features(shape)})
    index = {f: i for i, f in enumerate(names)}
    weights = np.zeros((len(names), size))
    if shapes:
        design = np.zeros((len(shapes), len(names)))
        for i, shape in enumerate(shapes):
            design[i, [index[f] for f in _features(shape)]] = 1
        seen = np.array(list(shapes.values()))
        seen = seen / seen.sum()
        mass, speed = seen.sum(axis=1, keepdims=True), np.zeros_like(weights)
        for _ in range(steps):
            scores = design @ weights
            p = np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True))
            slope = design.T @ (seen - mass * p) - penalty * weights
            speed = 0.9 * speed + slope
            weights += speed
    return SkipChainField(index, weights, _pair_scores(pair["chain"]), _pair_scores(pair["skip"]))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sure: float = 0.9) -> DataFrame:
    """Per row of ``docs``: id, ``base`` and ``spans``, arrays of (kind, start, end).

    ``spans`` holds the base spans and those that the random field adds at probability
    ``sure`` or more, by kind and start. Offsets count code points, the end is exclusive. Null
    and empty texts have no spans; repeated rows are read each.
    """
    model = fit(docs, text)

    @F.pandas_udf(f"base {SPANS}, spans {SPANS}")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        order = {kind: i for i, kind in enumerate(KINDS)}
        for texts in batches:
            both = [model.spans(x, sure) for x in texts]
            whole = [sorted(base + new, key=lambda s: (order[s[0]], s[1:])) for base, new in both]
            yield pd.DataFrame({"base": [base for base, _ in both], "spans": whole})

    found = find(F.col(text).cast("string"))
    return docs.select(F.col(id_column), found.alias("found")).select(id_column, "found.base", "found.spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
