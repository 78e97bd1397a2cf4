"""Operators on documents against brute force, and their edge cases."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from churnloom.llm import contamination, importance, pii, simhash, suffix, templates, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, a null id, one very long text, clashing names."""
    texts = [None, "", " \n\t", "One two three four.", "One two three four.", "word " * 60_000]
    rows = [(i, t, "en", "s", 0, "x", 1.0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, row_key string, score double",
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# SimHash


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(documents):
    found = as_dict(simhash.near_duplicates(documents))
    prints = {r.doc_id: brute_fingerprint(r.text) for r in documents.collect()}
    assert {i: r.fp % (1 << 64) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == brute_components(prints, 3)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_join_every_pair_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    for fp in list(prints):
        for bits in (1, 2, 3, 4, 5):
            for _ in range(3):
                flips = rng.choice(64, bits, replace=False)
                prints.append(fp ^ sum(1 << int(b) for b in flips))
    prints = sorted({p if p < 1 << 63 else p - (1 << 64) for p in prints})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.links(nodes, radius).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= radius and r.a < r.b for r in links)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        x, y = find(r.a), find(r.b)
        parent[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == brute_components_signed(prints, radius)


def brute_components_signed(prints, radius):
    by = {p: p % (1 << 64) for p in prints}
    return brute_components(by, radius)


def test_simhash_radius_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_simhash_odd_rows(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    zero = [r for r in found if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 3, 5]
    assert [r.text for r in rows if r.doc_id is None] == ["no id here"]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_chains_of_links_are_one_component(spark):
    from churnloom.llm.components import component_labels

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r.node: r.label for r in component_labels(edges).collect()}
    assert labels == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# Decontamination


def brute_contamination(texts, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for name, text in items:
        words = split(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i : i + size])].add(name)
    out = {}
    for doc_id, text in texts:
        words = split(text)
        hit, names = np.zeros(len(words), bool), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit[i : i + size] = True
                    names |= found
        out[doc_id] = (len(words), int(hit.sum()), sorted(map(str, names)))
    return out


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 2000])
def test_contamination_equals_brute_force(spark, documents, sf_dir, block_bytes):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    extra = [(1000, None), (1001, ""), (1002, "of the"), (1003, "...")]
    items = items.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    found, column = contamination.matches(documents, items, block_bytes=block_bytes)
    rows = found.select(
        "doc_id",
        F.col(column)["n_words"].alias("n"),
        contamination.hit_words(F.col(column)["matches"]).alias("hit"),
        F.array_sort(F.array_distinct(F.col(column)["matches"]["item"])).alias("items"),
    ).collect()
    expected = brute_contamination(
        [(r.doc_id, r.text) for r in documents.collect()], [tuple(r) for r in items.collect()]
    )
    assert {r.doc_id: (r.n, r.hit, r["items"]) for r in rows} == expected
    assert any(e[1] for e in expected.values())


def test_longest_matches_have_their_places(spark):
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    docs = docs_of(spark, ["x y " + " ".join(words[3:20]) + " z", " ".join(words[:9])])
    found, column = contamination.matches(docs, items)
    rows = as_dict(found.select("doc_id", F.col(column)["matches"].alias("m")))
    assert [tuple(m) for m in rows[0].m] == [("7", 2, 3, 17)]
    assert rows[1].m == []


def test_contamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "One, TWO three"), (None, "four"), (2, None)], "item_id long, text string")
    found = contamination.contamination(odd, items).collect()
    assert len(found) == odd.count()
    assert sum(r.contaminated for r in found) == 4
    kept = contamination.remove_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    no_items = items.where("item_id = 99")
    assert contamination.contamination(odd, no_items).where("contaminated").count() == 0
    assert contamination.contamination(empty, items).count() == 0


# Personal data


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and brute_luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append((kind, *m.span()))
    return out


TRICKY = [
    "a@b.c@d.e x@y. @z.w a@@b.c u.v+w%x@h-1.co.uk, A@B.C-",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 01.002.0003.4 1.2.3 1..2.3.4 999999999999.1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112 4111  1111 41111111111111111111111",
    "+1 (407) 555-7710 +49.30.123456 ++12345678901 +1+2345678901 +12345678 +1       . +1234567890123456",
    "é😀 a@b.cd 😀 192.168.0.1 ﬀ +33 1 23 45 67 89",
    "0" * 5000 + " " + "1." * 3000 + "@" * 2000 + "+" * 2000 + "a" * 20000,
]


def test_base_spans_equal_the_patterns(documents):
    texts = TRICKY[:-1] + [r.text for r in documents.collect()]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("19.@+- (a"), 40)) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == brute_spans(text), text


def test_long_runs_take_linear_time():
    import time

    begin = time.time()
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "@" * 300_000, "1 " * 150_000):
        pii.base_spans(text)
    assert time.time() - begin < 20


def test_field_labels_repeats_of_an_entity(spark):
    """A token like one that is observed takes its label over a skip edge, whatever lies between."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        number = "".join(map(str, rng.integers(0, 10, 10)))
        texts.append(f"call +{number} now. " + "word " * 40 + f"+{number} again, room 12 and 7.5 of 3")
    model = pii.fit(docs_of(spark, texts))
    text = "call +4930123456 now. " + "word " * 40 + "or +4930123456x please, room 12"
    base, added = model.spans(text)
    assert base == brute_spans(text)
    found = pii.tokens(text, base)
    chain, skip = pii.edges(found, text)
    p = model.marginals(found, chain, skip)
    assert p.shape == (len(found), 5) and np.allclose(p.sum(axis=1), 1)
    alone = model.marginals(found, chain, [])
    mention = next(i for i, t in enumerate(found) if text[t.start : t.end].endswith("x"))
    phone = pii.LABELS.index("phone")
    assert p[mention, phone] >= alone[mention, phone]
    assert not any(text[a:b] == "12" for _, a, b in added)


def test_field_adds_repeats_that_the_patterns_miss(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(80):
        a, b, c, d = ("".join(map(str, rng.integers(0, 10, n))) for n in (3, 3, 4, 10))
        name = f"{own_words(i, 1)}.{own_words(i + 100, 1)}"
        texts.append(
            f"call +1 {a} {b} {c} now or write {name}@mail.com. " + "word " * 40
            + f"again +1 ({a}) {b}-{c}, {name}@mail.com, {a}-{b}-{c}; order {d}, later {d}, room {i} of 3"
        )
    model = pii.fit(docs_of(spark, texts))
    text = (
        "call +1 555 123 4567 now or write Jane.Doe@mail.com. " + "word " * 40
        + "or 555-123-4567, 555 123 4567, jane.doe; order 7778889999, later 7778889999, room 12 of 3"
    )
    base, added = model.spans(text)
    assert base == brute_spans(text)
    assert [(kind, text[a:b]) for kind, a, b in added] == [
        ("phone", "555-123-4567"), ("phone", "555 123 4567"), ("email", "jane.doe")
    ]


def test_personal_data_odd_rows(odd, empty):
    found = pii.personal_data(odd).collect()
    assert len(found) == odd.count() and all(r.base == [] for r in found)
    assert pii.personal_data(empty).count() == 0


# Line templates


def test_recurring_templates_are_dropped(spark):
    own = [f"alpha{'abcdefghij'[i]} beta gamma{'klmnopqrst'[i]} delta epsilon zeta eta theta iota" for i in range(10)]
    texts = [f"{line}\nPage {i} of 10 printed on host {i}x today\nend {line}" for i, line in enumerate(own)]
    texts.append("Page 3 of 10 printed\nsomething else entirely that is long enough to stay here")
    cleaned, count = templates.drop_recurring_lines(docs_of(spark, texts))
    rows = as_dict(cleaned)
    for i, line in enumerate(own):
        assert rows[i].text == f"{line}\nend {line}" and rows[i][count] == 1
    assert rows[10].text == texts[10] and rows[10][count] == 0


def test_templates_generalise_words_that_vary(spark):
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    line = "This page was written by {} for the readers of our site today"
    rest = "{0} is {0} as {0} would say {0} when {0} met {0} and then {0} left with {0} for {0} and {0}"
    texts = [line.format(n) + "\n" + rest.format(n * 2) for n in names]
    cleaned, count = templates.drop_recurring_lines(docs_of(spark, texts), min_docs=5)
    assert all(r[count] == 1 and "written" not in r.text for r in cleaned.collect())


def test_copies_are_left_whole(spark):
    texts = ["first line of the copy\nsecond line of the copy"] * 20 + ["something else"]
    cleaned, count = templates.drop_recurring_lines(docs_of(spark, texts))
    assert sorted(r.text for r in cleaned.collect()) == sorted(texts)
    assert cleaned.where(F.col(count) > 0).count() == 0


def own_words(i, n):
    """Words without a digit that only document ``i`` has."""
    return " ".join("".join("abcdefghij"[int(c)] for c in f"{i:03d}{k:03d}") for k in range(n))


def test_passages_are_dropped_whatever_their_share(spark):
    passage = own_words(999, 60)
    texts = [f"{passage}\n{own_words(i, 40)}" for i in range(6)]
    texts += [f"{own_words(50 + i, 200)}\n{passage}" for i in range(2)] + [passage]
    rows = as_dict(templates.without_recurring_lines(docs_of(spark, texts)))
    assert [rows[i].text for i in range(6)] == [own_words(i, 40) for i in range(6)]
    assert [rows[6 + i].text for i in range(2)] == [own_words(50 + i, 200) for i in range(2)]
    assert rows[8].text == ""


def test_copies_in_which_a_word_varies_are_left_whole(spark):
    texts = [f"{own_words(1, 30)} {w} end\n{own_words(2, 30)}" for w in ("ann", "bob", "cid", "dan", "eve", "fay")]
    rows = as_dict(templates.without_recurring_lines(docs_of(spark, texts)))
    assert [rows[i].text for i in range(6)] == texts


def test_copies_of_a_recurring_passage_are_left_whole(spark):
    passage = own_words(999, 60)
    texts = [f"{passage}\n{own_words(i, 9)}" for i in range(6)] + [passage] * 3
    rows = as_dict(templates.without_recurring_lines(docs_of(spark, texts)))
    assert [rows[i].text for i in range(9)] == [own_words(i, 9) for i in range(6)] + [passage] * 3


@pytest.mark.parametrize("n", [2, 3, 4])
def test_long_lines_of_few_documents_stay_in_one(spark, n):
    passage, short = own_words(999, 60), own_words(998, 19)
    texts = [f"{own_words(i, 30)}\n{passage}\n{short}" for i in range(n)]
    texts += [f"{own_words(800, 30)}\n{own_words(801, 30)}"] * 3
    rows = as_dict(templates.without_recurring_lines(docs_of(spark, texts)))
    assert sum(passage in rows[i].text for i in range(n)) == 1
    assert all(own_words(i, 30) in rows[i].text and short in rows[i].text for i in range(n))
    assert all(rows[i].text == texts[i] for i in range(n, n + 3))


def test_large_leaves_are_parsed_in_shards(spark):
    rows = [(1, i, f"the same start of line {chr(97 + i % 26)}{chr(97 + i // 26)} and the same end") for i in range(300)]
    rows += [(2, 1000 + i, f"x y z {chr(97 + i)} {chr(98 + i)} {chr(99 + i)} {chr(100 + i)}") for i in range(5)]
    found = spark.createDataFrame(rows, "leaf long, line_id long, line string")
    parsed = {r.line_id: r.template_id for r in templates.parse_templates(found, 0.8, shard=16).collect()}
    assert len(parsed) == len(rows)
    assert len({parsed[i] for i in range(300)}) == 1
    assert len({parsed[1000 + i] for i in range(5)}) == 5


def test_similar_lines_meet_among_thousands(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    lines = ["<*> <*> <*> " + " ".join(rng.choice(vocabulary, 9)) for _ in range(10_000)]
    for i in range(0, 4000, 2):  # pairs, some of which are similar only by what was made variable
        words = lines[i].split()
        for k in rng.choice(range(3, 12), rng.integers(1, 4), replace=False):
            words[k] = str(rng.choice([*vocabulary[:2], "<*>"]))
        lines[i + 1] = " ".join(words)
    lines += [f"<*> <*> <*> opened the door of room {w} for the guest" for w in ("red", "blue", "green", "gold", "grey")]
    lines = sorted(set(lines))
    found = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "leaf long, line_id long, line string")
    parsed = {r.line_id: r.template_id for r in templates.parse_templates(found, 0.8).collect()}
    assert len({parsed[i] for i, line in enumerate(lines) if "opened the door" in line}) == 1
    whole = templates.Leaf(0.8, shard=len(lines))
    numbers = [whole.add(line) for line in lines]
    assert len(set(numbers)) < len(lines) - 1000
    assert [parsed[i] for i in range(len(lines))] == [templates._hash(whole.template(n)) for n in numbers]


def test_templates_odd_rows(odd, empty):
    cleaned = templates.without_recurring_lines(odd)
    assert cleaned.columns == odd.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(map(tuple, cleaned.collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
    assert templates.without_recurring_lines(empty).count() == 0
    assert key


# Toxicity


def test_toxicity_ranks_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    yes, no = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.8
    assert scored.count() == docs.count()
    assert scored.where("predicted <> cast(score >= 0.3 as int)").count() == 0


def test_held_out_labels_are_not_read(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn(
        "toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    one, two = (as_dict(toxicity.score_documents(documents, x)) for x in (labels, turned))
    assert {i: r.score for i, r in one.items()} == {i: r.score for i, r in two.items()}


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(3, 1, 1), (4, 1, 1), (5, 1, 0), (0, 1, 0), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    found = toxicity.score_documents(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    none = labels.where("doc_id = 99")
    assert {r.score for r in toxicity.score_documents(odd, none).collect()} <= {0.0, float(1 / (1 + np.exp(500)))}
    assert toxicity.remove_toxic(odd, none).columns == odd.columns
    assert toxicity.score_documents(empty, labels).count() == 0


# Importance resampling


def test_resampling_prefers_the_target_and_is_exact(spark):
    rng = np.random.default_rng(0)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    texts = [" ".join(rng.choice(good if i % 2 else bad, 60)) for i in range(200)]
    docs = docs_of(spark, texts)
    target = docs.where("doc_id % 2 = 1 and doc_id < 60").select("doc_id")
    drawn = importance.resample(docs, target, 0.4)
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 80 and sum(i % 2 for i in ids) >= 78
    every = {r.doc_id: r.perturbed for r in importance.resample(docs, target, 1.0).collect()}
    assert sorted(ids) == sorted(sorted(every, key=lambda i: -every[i])[:80])


def test_cut_is_the_kth_largest(spark):
    values = [5, -3, 5, 9_000_000_000_000, -(1 << 63), (1 << 63) - 1, 0, -1]
    keys = spark.createDataFrame([(v,) for v in values], "sort_key long")
    for k in range(1, len(values) + 1):
        assert importance.top_k_cut(keys, k) == sorted(values, reverse=True)[k - 1]
    assert importance.top_k_cut(keys, len(values) + 1) is None


def test_resampling_odd_rows(odd, empty):
    target = odd.select("doc_id").where("doc_id = 3 or doc_id is null")
    drawn = importance.resample(odd, target, 1.0).collect()
    assert len(drawn) == odd.count()
    assert all(r.log_weight == 0 for r in drawn if r.doc_id in (0, 1, 2))
    assert importance.resample(empty, target, 0.5).count() == 0
    assert importance.resample(odd, target, 0.0).count() == 0


# Repeated byte strings


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if d else b""
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_rows(df, length):
    return [
        (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in suffix.digest(suffix.remove_repeated(df, length)).orderBy("doc_id").collect()
    ]


@pytest.mark.parametrize("length", [8, 40])
def test_removed_bytes_equal_brute_force(spark, length):
    rng = np.random.default_rng(length)
    passages = ["".join(rng.choice(list("abcdé "), rng.integers(1, 4 * length))) for _ in range(12)]
    texts = ["".join(rng.choice(passages + list("xyzwv"), rng.integers(0, 12))) for _ in range(120)]
    texts += [texts[0], "ab" * 100, "q" * (3 * length), "", None]
    assert repeated_rows(docs_of(spark, texts), length) == brute_removed(texts, length)


def test_removed_bytes_of_the_documents(documents):
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    expected = brute_removed(texts, 200)
    assert repeated_rows(documents, 200) == expected
    assert any(e[1] for e in expected)


def test_pieces_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abcdef"), 400)) for _ in range(6)]
    texts += [texts[0][50:300] + texts[1][10:250], texts[2][:399] + "z"]
    monkeypatch.setattr(suffix, "_PIECE", 97)
    rows = suffix.stretches([t.encode() for t in texts], 40)
    assert all(len(x) == len(rows[0]) for x in rows)
    covered = collections.Counter()
    for text, start, n, rel in zip(rows[0], rows[3], rows[4], rows[5]):
        assert 0 <= rel < n + 30
        covered.update((int(text), int(p)) for p in range(start, start + n))
    assert covered == collections.Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 39))


def test_suffix_odd_rows(spark, odd, empty):
    found = suffix.digest(suffix.remove_repeated(odd, 16)).collect()
    assert len(found) == odd.count()
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert by[3][0].n_removed == 19 and by[5][0].n_removed == 300_000 and by[0][0].n_bytes == 0
    assert suffix.remove_repeated(empty).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeated(odd, 10)
