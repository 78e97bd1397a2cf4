import random

import numpy as np
import pytest

from churnloom.operators import drift, metrics, rules
from churnloom.schema import ColumnRule

RULES = (ColumnRule("x", "float"), ColumnRule("t", "string"), ColumnRule("absent", "int"))


def brute_ks(a, b):
    points = sorted(set(a) | set(b))
    return max(
        abs(sum(v <= p for v in a) / len(a) - sum(v <= p for v in b) / len(b)) for p in points
    )


def filled(values, numeric):
    known = [v for v in values if v is not None]
    if numeric:
        fill = float(np.median(known))
    else:
        fill = min(set(known), key=lambda v: (-known.count(v), v)) if known else "Unknown"
    return [fill if v is None else v for v in values]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ks_equals_brute_force(spark, seed):
    rng = random.Random(seed)

    def side(n, shift):
        return [
            (
                None if rng.random() < 0.2 else round(rng.gauss(shift, 1), 1),
                None if rng.random() < 0.3 else rng.choice("abcde"),
            )
            for _ in range(n)
        ]

    a, b = side(150, 0), side(90, 0.4)
    left, right = (spark.createDataFrame(s, "x double, t string") for s in (a, b))
    found = {r["column"]: r for r in drift.ks_statistics(left, right, RULES).collect()}
    assert set(found) == {"x", "t"}
    for i, (name, numeric) in enumerate((("x", True), ("t", False))):
        expected = brute_ks(filled([r[i] for r in a], numeric), filled([r[i] for r in b], numeric))
        assert found[name]["ks_statistic"] == pytest.approx(expected, abs=1e-12)
        assert found[name]["missing_reference"] == sum(r[i] is None for r in a)
        assert found[name]["n_current"] == len(b)


def test_table_does_not_drift_from_itself(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, None)], "x double, t string")
    for row in drift.drift_report(df, df, RULES).collect():
        assert (row["ks_statistic"], row["p_value"], row["drift_found"]) == (0.0, 1.0, False)


def test_side_without_values(spark):
    full = spark.createDataFrame([(float(i), "a") for i in range(50)], "x double, t string")
    empty = spark.createDataFrame([(None, None)] * 50, "x double, t string")
    found = {r["column"]: r for r in drift.drift_report(full, empty, RULES).collect()}
    assert found["x"]["ks_statistic"] is None and not found["x"]["drift_found"]
    # All text cells become one word that the other side does not have.
    assert found["t"]["ks_statistic"] == 1.0 and found["t"]["drift_found"]


def test_decision(spark):
    def decide(found, known, force=False):
        overall = spark.createDataFrame([(found,)], "overall_drift_found boolean")
        return drift.retrain_decision(overall, known, force).first()["decision"]

    assert decide(False, True) == "skip"
    assert decide(False, False) == "train"
    assert decide(True, True) == "train"
    assert decide(False, True, force=True) == "train"


def test_schema_report(spark):
    df = spark.createDataFrame([("a", 5, 1.5), ("z", None, 300.0)], "t string, n int, x double")
    declared = (
        ColumnRule("t", "string", allowed=("a", "b")),
        ColumnRule("n", "int", 0, 5),
        ColumnRule("x", "float", 0, 200),
        ColumnRule("gone", "int", 0, 1),
        ColumnRule("n", "float"),
    )
    report = rules.schema_report(df, declared).collect()
    failed = {(r["column"], r["rule"]) for r in report if not r["passed"]}
    assert failed == {("x", "max"), ("gone", "present"), ("n", "type")}
    strict = rules.schema_report(df, declared[:1], check_allowed=True)
    assert not rules.report_passed(strict)
    assert rules.report_passed(rules.schema_report(df, declared[:2]))


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_auc_equals_pair_counting(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), 0, round(rng.random(), 1)) for _ in range(300)]
    pos = [s for y, _, s in rows if y]
    neg = [s for y, _, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = scored(spark, rows)
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(pairs)
    assert metrics.roc_area(df).first()["area"] == pytest.approx(pairs)
    assert metrics.binary_metrics(df).first()["roc_auc"] == pytest.approx(pairs)


def test_metrics_without_positives(spark):
    row = metrics.binary_metrics(scored(spark, [(0, 0, 0.1), (0, 0, 0.2)])).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (1.0, 0.0, 0.0, 0.0)
    assert row["roc_auc"] is None


def test_curve_ends(spark):
    df = scored(spark, [(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.3), (0, 0, 0.1)])
    roc = [(r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).collect()]
    assert (0.0, 0.0) in roc and (1.0, 1.0) in roc and len(roc) == 5
    pr = metrics.pr_curve(df).collect()
    assert [(r["precision"], r["recall"]) for r in pr if r["threshold"] is None] == [(1.0, 0.0)]


def test_confusion_matrix_keeps_empty_cells(spark):
    cells = metrics.confusion_matrix(scored(spark, [(1, 1, 0.9)])).collect()
    assert {(r["actual"], r["predicted"]): r["n"] for r in cells} == {
        (0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1,
    }


def test_first_best_model_wins_a_tie(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (0, "a", 0.5), (2, "c", 0.1)], "position int, model string, f1_score double")
    assert metrics.pick_best(df).first()["model"] == "a"


def test_metrics_count_rows_without_score_and_null_groups(spark):
    from churnloom.operators import metrics

    rows = [("a", 1, 1, 0.9), ("a", 0, 0, None), ("a", 0, 1, 0.8), (None, 1, 1, 0.7), (None, 0, 0, 0.1), ("b", 0, 0, None)]
    df = spark.createDataFrame(rows, "g string, label int, prediction int, score double")
    names = ["g", "accuracy", "precision", "recall", "f1_score", "tn", "fp", "fn", "tp"]
    plain = {r["g"]: tuple(r) for r in metrics.threshold_metrics(df, ["g"]).select(names).collect()}
    scored = metrics.binary_metrics(df, ["g"])
    assert {r["g"]: tuple(r) for r in scored.select(names).collect()} == plain
    assert {r["g"]: r["roc_auc"] for r in scored.collect()} == {"a": 1.0, None: 1.0, "b": None}
    assert {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, ["g"]).collect()} == {"a": 1.0, None: 1.0, "b": None}
    assert metrics.roc_curve(df, ["g"]).where("g is null").count() == 3
