"""Repetitive and unspaced texts in linear time; shares, targets and blocks at their limits."""

import time

import pytest
from pyspark.sql import functions as F

from churnloom.llm import contamination, importance, mixing, pii


def _seconds(work, size):
    start = time.perf_counter()
    work(size)
    return time.perf_counter() - start


def test_repeated_words_are_searched_in_linear_time():
    """Equal windows of item and document meet once for each place, not for each pair."""
    items = [("a", "no " * 20_000), ("b", "yes no " * 30)]
    tests = contamination.TestSuffixes(items, 10)
    counts, found = contamination._shard_matches(["no " * 20_000, "x " + "no " * 12], tests)
    assert counts.tolist() == [20_000, 13]
    assert len(found[0]) == 19_991 + 3
    matches = contamination._longest(counts, found, tests)
    assert matches == [[("a", 0, 0, 20_000)], [("a", 1, 0, 12)]]


def test_a_match_goes_on_where_its_item_does():
    items = [("a", " ".join(f"w{i}" for i in range(15)) + " " + " ".join(f"w{i}" for i in range(15)))]
    tests = contamination.TestSuffixes(items, 5)
    text = " ".join(f"w{i}" for i in [*range(3, 15), *range(0, 15), *range(2, 9)])
    (found,) = contamination._longest(*contamination._shard_matches([text], tests), tests)
    assert found[0] == ("a", 0, 3, 27)
    assert ("a", 27, 2, 7) in found


def test_repeated_words_of_the_table(spark):
    items = spark.createDataFrame([(1, "no " * 500), (2, "never " * 3)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "no " * 1200), (8, "never never"), (9, "x never never never y")], "doc_id long, text string")
    for size in (contamination.BLOCK_BYTES, 100):
        column = contamination.matches(docs, items, block_bytes=size)
        rows = {
            r.doc_id: (r.n, r.hit, r["items"])
            for r in column[0].select(
                "doc_id",
                F.col(column[1])["n_words"].alias("n"),
                contamination.hit_words(F.col(column[1])["matches"]).alias("hit"),
                F.array_sort(F.array_distinct(F.col(column[1])["matches"]["item"])).alias("items"),
            ).collect()
        }
        assert rows == {7: (1200, 1200, ["1"]), 8: (2, 0, []), 9: (5, 3, ["2"])}


def test_tokens_of_unspaced_text_take_linear_time():
    text = "a" * 1_000_000 + "1 b@c.de"
    start = time.perf_counter()
    base = pii.base_spans(text)
    found = pii.tokens(text, base)
    assert time.perf_counter() - start < 20
    assert [(t.start, t.end) for t in found] == [(0, 1_000_001), (1_000_002, 1_000_008)]


def test_share_of_no_good_label_is_zero(spark):
    schema = "doc_id long, quality int"
    assert importance.labelled_share(spark.createDataFrame([(1, 0), (2, 0)], schema)) == 0.0
    assert importance.labelled_share(spark.createDataFrame([(1, None)], schema)) == 1.0
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert importance.resample(docs, none, 0.0).count() == 0


def test_targets_that_cannot_be_met_are_an_error(spark):
    """Value a occurs with x only, so a cannot have more than x."""
    cells = spark.createDataFrame(
        [("a", "x", "t", 10.0, 1), ("b", "x", "t", 10.0, 1), ("b", "y", "t", 10.0, 1)],
        "source string, lang string, topic string, tokens double, docs long",
    )
    targets = [("source", "a", 0.9), ("source", "b", 0.1), ("lang", "x", 0.2), ("lang", "y", 0.8), ("topic", "t", 1.0)]
    targets = spark.createDataFrame(targets, "dimension string, value string, share double")
    with pytest.raises(mixing.Unreachable, match="of its target"):
        mixing.rake(cells, targets, rounds=40)
    rows = mixing.rake(cells, targets, rounds=40, most_residual=None).collect()
    assert {r.residual > 0.1 for r in rows} == {True}
