"""Min-max near-duplicates, periodic runs and conversation repair against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnloom.llm import conversations, minmax, periods, tables
from churnloom.llm.queries import QUERIES

WHITE = " \t\n\v\f\r"


def words_of(text):
    return (text or "").encode().split()


# --- op11 ----------------------------------------------------------------------------


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def classes(rows, size, percent):
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * len(sets[i] | sets[j]) and sets[j]:
                parent[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        smallest[find(i)].append(key)
    return [(key, len(sets[i]), min(smallest[find(i)])) for i, (key, _) in enumerate(rows)]


def near_rows(found):
    rows = found.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_near_duplicates_of_the_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert near_rows(QUERIES["op11_minmax"](spark, sf_dir)) == sorted(classes(docs, 2, 80))


@pytest.mark.parametrize("small,peels", [(24, 3), (2, 0)])
def test_chains_and_thresholds(spark, monkeypatch, small, peels):
    monkeypatch.setattr(minmax, "SMALL", small)
    monkeypatch.setattr(minmax, "PEELS", peels)
    rng = random.Random(3)
    rows = []
    for group in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 6, 11, 40, 120]))]
        for _ in range(12):  # each copy changes the one before it a little
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 20)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    rng.shuffle(rows)
    found = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    assert near_rows(found) == sorted(classes(rows, 2, 80))


@pytest.mark.parametrize("small,peels", [(24, 3), (2, 0), (2, 1)])
def test_buckets_with_several_components_lose_no_link(spark, monkeypatch, small, peels):
    """Bands of one permutation make large, mixed buckets; differences from the hub resolve them."""
    monkeypatch.setattr(minmax, "SMALL", small)
    monkeypatch.setattr(minmax, "PEELS", peels)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for family in range(6):
        words = base + [f"f{family}x{i}" for i in range(16)]
        for _ in range(8):
            rows.append((len(rows), " ".join([*words, *(f"r{rng.randrange(10**6)}" for _ in range(3))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_rows(minmax.near_duplicates(docs, shingle=1, bands=64, permutations=1))
    assert got == sorted(classes(rows, 1, 80))
    assert len({component for _, _, component in got}) > 1


def test_signature_ends_match_as_often_as_similarity():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    a, b = np.sort(values[:500]), np.sort(values[100:600])
    low, high = minmax.MinMax(500, 2).signatures([a, b])
    similarity = 400 / 600
    assert abs((low[0] == low[1]).mean() - similarity) < 0.06
    assert abs((high[0] == high[1]).mean() - similarity) < 0.06


def test_long_sets_over_several_chunks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (5, 100_000, 1, 40_000)]
    hashing = minmax.MinMax(3, 1)
    low, high = hashing.signatures(sets)
    for i, values in enumerate(sets):
        for p in range(3):
            moved = values * hashing.factor[p] + hashing.shift[p]
            assert low[i, p] == moved.min() and high[i, p] == moved.max()


def test_portions_keep_every_text_in_order(monkeypatch):
    monkeypatch.setattr(minmax, "_TEXTS", 50)
    texts = ["", "a" * 200, "b c d", "", "e " * 30, "f g", "h" * 50, ""]
    portions = list(minmax._portions(texts))
    assert [text for portion in portions for text in portion] == texts
    assert len(portions) > 1 and all(len(p) == 1 or sum(map(len, p)) <= 50 for p in portions)
    assert list(minmax._portions([])) == []
    whole = minmax.shingle_sets(texts, 2)
    apart = [found for portion in portions for found in minmax.shingle_sets(portion, 2)]
    assert all((a == b).all() for a, b in zip(whole, apart, strict=True))


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (1, None, 1), (2, "", 2), (3, " \n\t", 3), (4, "One", 4), (5, "one", 5), (5, "one", 5),
        (None, "one", 6), (6, long, 7), (7, long + " x", 8), (None, None, 9), (8, "É one", 1), (9, "é one", 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key int")
    got = minmax.near_duplicates(docs, shingle=2).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert len(got) == len(rows)
    assert by_id[1] == (0, 1, True) and by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True)
    assert by_id[4] == (1, 4, True) and by_id[5] == (1, 4, False)
    assert by_id[6] == (49_999, 6, True) and by_id[7] == (50_000, 6, False)
    assert by_id[8][1] == 8 and by_id[9][1] == 9  # only ASCII letters are lowered
    nameless = sorted((r.n_shingles, r.component_id or 0, r.kept) for r in got if r.doc_id is None)
    assert nameless == [(0, 0, True), (1, 4, False)]
    assert minmax.near_duplicates(docs.limit(0)).collect() == []


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z")], "doc_id string, text string")
    assert near_rows(minmax.near_duplicates(docs, shingle=2)) == [("a", 2, "a"), ("b", 2, "a")]



def test_differences_of_one_component_are_not_met(spark, monkeypatch):
    kept = {}
    plain = minmax.materialize
    monkeypatch.setattr(minmax, "materialize", lambda df, name: kept.setdefault(name, plain(df, name)))
    own, shared = list(range(15)), list(range(100, 115))
    rows = [(0, n, 100, 100, False, own) for n in (1, 2, 3)] + [(0, n, 100, 100, False, shared) for n in (5, 6)]
    differences = spark.createDataFrame(
        rows, "hub long, node long, n long, hub_n long, similar boolean, delta array<long>"
    )
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "linked long, label long")
    links = minmax._across(differences, labels, 80)
    assert [tuple(r) for r in links.collect()] == [(5, 6)]
    assert {r.hash for r in kept["met"].collect()} == set(shared)


def test_texts_reach_python_in_short_batches(spark, monkeypatch):
    keys = list(tables._BATCH)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x y z "), F.col("id") % 40).alias("text"))
    bounds = {}
    plain = minmax.materialize

    def noted(df, name):
        bounds[name] = [spark.conf.get(key) for key in keys]
        return plain(df, name)

    monkeypatch.setattr(minmax, "materialize", noted)
    before = [spark.conf.get(key) for key in keys]
    got = minmax.near_duplicates(docs, shingle=2).collect()
    assert len(got) == 3000 and sum(r.kept for r in got) == 40
    assert bounds["signed"] == bounds["sets"] == ["1000", "2m"] and bounds["nodes"] == before
    assert [spark.conf.get(key) for key in keys] == before

    def sizes(batches):
        for batch in batches:
            yield batch.assign(rows=len(batch), held=batch.text.str.len().sum())[["rows", "held"]]

    def largest(length):
        texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("a"), length).alias("text"))
        with tables.short_batches(spark):
            found = minmax.materialize(texts.mapInPandas(sizes, "rows long, held long"), "sizes")
        return tuple(found.agg(F.max("rows"), F.max("held")).first())

    assert largest(1)[0] <= 1000
    assert largest(10_000)[1] <= 2**21 + 10_000  # the text that passes the bound is in
    with pytest.raises(ZeroDivisionError), tables.short_batches(spark):
        1 / 0
    assert [spark.conf.get(key) for key in keys] == before


# --- op12 ----------------------------------------------------------------------------


def runs_by_force(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q) and i > start:
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((start, q, end - start) for (start, end), q in found.items())


def collapsed_by_force(words, runs):
    dropped = {i for start, q, length in runs for i in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def planted_by_force(doc_id, text):
    words, h = words_of(text), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and words:
        n = len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periods"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = planted_by_force(doc_id, text)
        codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        runs = runs_by_force([codes[w] for w in words]) if len(words) < 1500 else None
        row = got[doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=(None, None, None))
        milli = best[1] and 1000 * best[2] // best[1]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (
            len(runs), best[0], best[2], best[1], milli,
        )
        assert row.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode())
        assert row.collapsed_sha256 == sha(collapsed_by_force(words, runs))
    assert sum(r.n_runs > 0 for r in got.values()) > 3


@pytest.mark.parametrize("kinds", [1, 2, 3, 6, 40])
def test_fragments_give_all_runs(kinds):
    rng = random.Random(kinds)
    for _ in range(250):
        words = [rng.randrange(kinds) for _ in range(rng.randint(0, 160))]
        for _ in range(rng.randint(0, 3)):
            q, start = rng.randint(1, 18), rng.randrange(max(1, len(words)))
            for i in range(start + q, min(len(words), start + rng.randint(1, 130))):
                words[i] = words[i - q]
        got = {}
        for q, low, high in sorted(periods._joined(periods.fragments(np.array(words, np.int64)))):
            if high - low >= periods.least_stretch(q):
                got.setdefault((low, high + q), q)
        assert sorted((s, q, e - s) for (s, e), q in got.items()) == runs_by_force(words)


def test_runs_of_odd_texts(spark):
    long = "a b c " * 40_000
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "\v \f", "x"), (4, "ha " * 6, "x"), (4, "ha " * 6, "x"),
        (5, "ha " * 5, "x"), (None, "a b a b a b a b", "x"), (6, long, "x"), (7, "a a " * 7, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periods.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    plain = lambda i: [[tuple(x) for x in r.runs] for r in got if r.doc_id == i]
    assert plain(1) == plain(2) == plain(3) == plain(5) == [[]]
    assert plain(4) == [[(0, 1, 6)]] * 2
    assert plain(None) == [[(0, 2, 8)]]
    assert plain(6) == [[(0, 3, 120_000)]]
    assert plain(7) == [[(0, 1, 7)]]
    cut = sorted((r.doc_id or 0, r.text) for r in periods.without_repeats(docs).collect() if r.text)
    assert (4, "ha") in cut and (0, "a b") in cut and (6, "a b c") in cut and (5, "ha " * 5) in cut
    assert len(cut) == len(rows) - 2
    assert periods.digest(periods.periodic_runs(docs.limit(0))).collect() == []
    odd = spark.createDataFrame([(None, "a " * 9)], "doc_id long, text string")
    assert periods.digest(periods.periodic_runs(odd, text=periods.planted())).first().n_runs == 1


def test_stitching_takes_the_smallest_period(spark):
    """Fragments of a run that came from different tiles, and of a multiple of its period."""
    parts = [(2, 0, 5), (2, 4, 9), (2, 9, 12), (4, 0, 10), (5, 20, 40), (5, 38, 39), (1, 50, 54)]
    solved = spark.createDataFrame(
        [(1, "w", parts), (2, None, [])], f"row long, words string, parts {periods.PARTS}"
    )
    (row,) = periods._runs(solved).collect()
    assert [tuple(r) for r in row.runs] == [(0, 2, 14), (20, 5, 25)]


# --- op13 ----------------------------------------------------------------------------


def damage_by_force(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def repair_by_force(rows):
    """All states with their whole letters and turns, row by row."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"
        faults.append(fault)
        seen.add((role, text))
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def grown(table):
        """With inserts of up to two turns."""
        out = dict(table)
        for _ in range(2):
            for state, (cost, audit, turns) in list(out.items()):
                to = nexts[state]
                offer = (cost + 2, audit + "I", (*turns, (names[to], "")))
                out[to] = min(out.get(to, offer), offer)
        return out

    for (role, text), fault in zip(rows, faults):
        new = {}
        paths = [(state, v) for state, v in best.items()]
        for state, v in best.items():  # inserts kept apart by their number
            for _ in range(2):
                state, v = nexts[state], (v[0] + 2, v[1] + "I", (*v[2], (names[nexts[state]], "")))
                paths.append((state, v))
        for state, (cost, audit, turns) in paths:
            offers = [(state, (cost + 3, audit + "D", turns))]
            if fault not in ("b", "d"):
                extra = int(fault == "t")
                initial = role[:1]
                if (initial == "s" and state == "") or (initial in ("u", "a") and nexts[state] == initial):
                    offers.append((initial, (cost + extra, audit + "K", (*turns, (role, text)))))
                to = nexts[state]
                offers.append((to, (cost + 2 + extra, audit + "R", (*turns, (names[to], text)))))
            for to, offer in offers:
                new[to] = min(new.get(to, offer), offer)
        best = new
    ends = []
    for state, (cost, audit, turns) in best.items():
        for _ in range({"": 0, "s": 2, "u": 1, "a": 0}[state]):
            state = nexts[state]
            cost, audit, turns = cost + 2, audit + "I", (*turns, (names[state], ""))
        ends.append((cost, audit, turns))
    cost, audit, turns = min(ends)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = sha("\n".join(f"{r}:{t}" for r, t in turns).encode())
    return (*(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)


def report_by_force(rows):
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        damaged[conv]
    for conv, turn, role, text in damage_by_force(rows):
        damaged[conv].append((turn, role, text))
    out = {}
    for conv, found in damaged.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *repair_by_force([(r, t) for _, r, t in found]))
    return out


def report_rows(found):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in found.collect()
    }


def test_repair_of_the_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert report_rows(QUERIES["op13_conversations"](spark, sf_dir)) == report_by_force(rows)


def random_rows(rng, n, convs):
    texts = ["Yes.", "No", "", " \t", "Why?", "ok !", "ok! "]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    return [
        (rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice([*texts, None, f"t{i}."]))
        for i in range(n)
    ]


def test_repair_of_random_rows(spark):
    rows = random_rows(random.Random(7), 900, [None, *range(120)])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert report_rows(conversations.repair_damaged(table)) == report_by_force(rows)


def test_one_conversation_over_many_ranges_and_segments(spark):
    """One conversation holds most rows; its segments are solved apart and meet."""
    rng = random.Random(11)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"t{i}?"]))
            for i in range(9_000)]
    rows += random_rows(rng, 60, [0, 2, 3])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = report_rows(conversations.repair_damaged(table))
    assert found == report_by_force(rows)


def test_turns_make_up_the_repaired_text(spark):
    rows = random_rows(random.Random(13), 200, ["a", "b", "c", "d"])
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    done = conversations.repair(table)
    text = defaultdict(list)
    for r in done.turns.orderBy("key", "part", "segment").collect():
        text[r.key] += [f"{t.role}:{t.text}" for t in r.turns]
    for r in done.report.collect():
        assert r.repaired_sha256 == sha("\n".join(text[r.key]).encode())


def test_small_conversations_by_enumeration():
    """Cost and letters over every sequence of edits of up to four rows."""
    from itertools import product

    rng = random.Random(17)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "b", "", "c?"]))
                for _ in range(rng.randint(0, 4))]
        blank, duplicate, cut, illegal, cost, audit, _ = repair_by_force(rows)
        got = conversations._whole(rows)
        assert got[:6] == (blank, duplicate, cut, illegal, cost, audit)
        best = (10**9, "")
        letters = ["".join(p) for n in range(3) for p in product("I", repeat=n)]
        faults, seen = [], set()
        for row in rows:
            faults.append(conversations.fault_of(row[1], row in seen))
            seen.add(row)
        for choice in product(product(letters, "KRD"), repeat=len(rows)):
            for end in letters:
                state, spent = 0, 0
                for (role, _), fault, (inserts, letter) in zip(rows, faults, choice):
                    for _ in inserts:
                        state, spent = conversations.NEXT[state], spent + 2
                    if letter == "D":
                        spent += 3
                        continue
                    to = conversations.NEXT[state] if letter == "R" else conversations._kept_state(state, role[:1])
                    if fault in ("blank", "duplicate") or to is None:
                        break
                    state, spent = to, spent + 2 * (letter == "R") + (fault == "truncated")
                else:
                    for _ in end:
                        state, spent = conversations.NEXT[state], spent + 2
                    if state in (0, 3):
                        best = min(best, (spent, "".join(i + x for i, x in choice) + end))
        assert best == (cost, audit)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "assistant", "x " * 200_000 + "."), (2, None, None, None)]
    wide = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, "
                                 "key string, cost int")  # fmt: skip
    found = {r.conv_id: r for r in conversations.repair(wide).report.collect()}
    assert (found[1].cost, found[1].audit) == (0, "KK")
    assert (found[2].gaps, found[2].blank, found[2].cost, found[2].audit) == (0, 1, 3, "D")
    assert conversations.repair_damaged(wide.limit(0)).collect() == []
    equal = spark.createDataFrame([(1, 3, "user", "A.")] * 5, "conv_id long, turn long, role string, text string")
    row = conversations.repair(equal).report.first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (4, 4, 14, "KDDDDI")
