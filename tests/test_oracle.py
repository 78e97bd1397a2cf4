"""Every query of the library against its SQL; the others must return rows.

Model queries repeat a target that the features decide, which takes more rows than the
smallest tables have; they are compared at sf0.01. Those that boost a hundred rounds, or fit
all classifiers, take minutes each: ``python tests/compare.py`` runs them, and test_models.py
covers the same code with small ensembles.
"""

import __spark_entry__ as entry
import pytest
from churnloom.catalog.oracle import ORACLE
from churnloom.catalog.queries import QUERIES
from compare import compare, connect

LEARNED_DIR = "/root/testdata/sf0.01"
LEARNED = {"model_random_forest", "model_decision_tree", "model_adaboost"}
SLOW = {
    "gated_run", "forced_run", "model_stacking", "model_gbt", "model_weighted_gbt", "train",
    "model_report", "refit_best", "run_metrics", "grid_search", "model_roundtrip", "publish_model",
    "score_records", "score_request_records", "score_csv", "score_stream", "prediction_preview",
    "expected_features", "transform", "top_features",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW - LEARNED))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert compare(spark, duck, QUERIES[name], ORACLE[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_query_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(LEARNED))
def test_learned_query_equals_sql(spark, name):
    assert compare(spark, connect(LEARNED_DIR), QUERIES[name], ORACLE[name], LEARNED_DIR) == []


def test_entry_registers_the_library():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"Contract", "Churn", "n"} == set(rows[0].asDict())
