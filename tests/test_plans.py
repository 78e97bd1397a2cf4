"""Plans must stay distributed: no cross join, no Python rows, no sort of the data on one task."""

import re

import __spark_entry__ as entry
import pytest

from churnloom.catalog import tables

QUERIES = entry.queries()
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
)
NAMES = [
    "scan_customers", "ingest", "drop_duplicates", "duplicate_count", "null_counts", "fill_median",
    "box_total_by_churn", "tenure_histogram", "tenure_density", "prefix_sum", "grouped_quantiles",
    "holdout_split", "stratified_folds", "validate_ranges", "drift_report", "binary_metrics",
    "roc_curve", "pr_curve", "knn_impute", "standardize", "eda_report", "score_records",
]


def executed_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, sf_dir, name):
    plan = executed_plan(QUERIES[name](spark, sf_dir))
    for operator in FORBIDDEN:
        assert operator not in plan, operator
    lines = [re.sub(r"^[\s:|+\-*()0-9]+", "", line) for line in plan.splitlines()]
    for above, below in zip(lines, lines[1:]):
        # One task is fine for the end of a total, never for sorting rows.
        if below.startswith("Exchange SinglePartition"):
            assert not above.startswith(("Sort", "Window")), above


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    plan = executed_plan(QUERIES["contract_by_churn"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and not any("o_orderpriority" in s or "c_name" in s for s in schemas)


def test_running_totals_join_on_the_window_partitioning(spark, sf_dir):
    """The rows are shuffled once for the window and not again for the offsets."""
    plan = executed_plan(QUERIES["prefix_sum"](spark, sf_dir)).split("Initial Plan")[-1]
    on_slice = [l for l in plan.splitlines() if "Exchange hashpartitioning" in l and "_slice" in l]
    assert len(on_slice) == 2


def test_parts_are_read_from_one_written_table(spark, sf_dir):
    train, test = tables.separable_parts(spark, sf_dir)
    files = [*train.inputFiles(), *test.inputFiles()]
    assert files and not any(sf_dir in f for f in files)
    whole = tables.distinct_customers(spark, sf_dir)
    assert train.count() + test.count() == whole.count()
    assert train.columns == test.columns == whole.columns
