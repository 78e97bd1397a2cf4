import pytest
from pyspark.errors import PySparkException

from churnloom.operators import clean, profile, split, weights
from churnloom.operators.ordered import grouped_quantiles, prefix_sum


def values(df, column):
    return [row[column] for row in df.orderBy("id").collect()]


def test_missing_token_is_the_whole_cell(spark):
    df = spark.createDataFrame([(1, "na"), (2, "nab"), (3, "NA"), (4, None)], "id int, v string")
    assert values(clean.replace_missing_token(df), "v") == [None, "nab", "NA", None]


def test_numbers_from_text(spark):
    df = spark.createDataFrame(
        [(1, " "), (2, " 12 "), (3, "nan"), (4, "x"), (5, None), (6, "1e3")],
        "id int, TotalCharges string",
    )
    assert values(clean.coerce_numeric(df), "TotalCharges") == [None, 12.0, None, None, None, 1000.0]


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, None)], "id int, v string")
    once = clean.drop_duplicate_rows(df)
    assert once.count() == 3
    assert clean.drop_duplicate_rows(once).count() == 3
    assert clean.duplicate_count(df).first()[0] == 1
    assert clean.duplicate_count(once).first()[0] == 0


def test_empty_table_is_refused(spark):
    with pytest.raises(ValueError):
        clean.require_rows(spark.createDataFrame([], "id int"))


def test_target_must_be_there_and_complete(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, None)], "id int, Churn string")
    with pytest.raises(ValueError):
        clean.split_target(df.drop("Churn"))
    with pytest.raises(ValueError):
        clean.split_target(df)
    features, target = clean.split_target(df.na.drop())
    assert features.columns == ["id"] and target.columns == ["Churn"]


@pytest.mark.parametrize("bad", ["Maybe", None])
def test_unmapped_target_fails(spark, bad):
    df = spark.createDataFrame([(1, "Yes"), (2, bad)], "id int, Churn string")
    with pytest.raises(PySparkException):
        clean.encode_target(df).collect()


def test_flags_without_a_code_become_missing(spark):
    df = spark.createDataFrame(
        [(1, "Yes", "Male"), (2, "na", "Female"), (3, "No", "other")],
        "id int, Partner string, gender string",
    )
    coded = clean.encode_flags(df)
    assert values(coded, "Partner") == [1, None, 0]
    assert values(coded, "gender") == [1, 0, None]


def test_median_and_mode_fill(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b", None), (2, 2.0, "a", None), (3, 4.0, "b", None), (4, 10.0, "a", None), (5, None, None, None)],
        "id int, x double, t string, u string",
    )
    assert values(clean.fill_median(df, ["x"]), "x") == [1.0, 2.0, 4.0, 10.0, 3.0]
    filled = clean.fill_mode(df, ["t", "u"])
    assert values(filled, "t") == ["b", "a", "b", "a", "a"]
    assert values(filled, "u") == ["Unknown"] * 5


def test_columns_by_type(spark):
    df = spark.createDataFrame([(1, 2.0, "a", "Yes")], "id int, x double, t string, Churn string")
    assert clean.columns_by_type(df, id_columns=["id"]) == (["x"], ["t"])
    with pytest.raises(ValueError):
        clean.columns_by_type(df.select("Churn"))


def test_split_ignores_partitioning_and_covers_all(spark):
    df = spark.range(2000).selectExpr("concat('C', id) AS customerID")
    once = {r[0]: r[1] for r in split.holdout_split(df).collect()}
    again = {r[0]: r[1] for r in split.holdout_split(df.repartition(13)).collect()}
    assert once == again and len(once) == 2000
    assert 0.15 < sum(v == "test" for v in once.values()) / 2000 < 0.25


def test_exact_split_and_folds(spark):
    df = spark.range(1003).selectExpr(
        "concat('C', id) AS customerID", "if(id % 10 < 9, 'No', 'Yes') AS Churn"
    )
    parts = split.holdout_split_exact(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"test": 201, "train": 802}
    folds = split.stratified_folds(df, 5).groupBy("Churn", "fold").count().collect()
    for label in ("No", "Yes"):
        sizes = [r["count"] for r in folds if r["Churn"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_folds_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([("a", None), ("b", "Yes"), ("c", None)], "customerID string, Churn string")
    assert split.stratified_folds(df, 2).count() == 3


def test_weights_with_one_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert weights.scale_pos_weight(df).first()["scale_pos_weight"] == 1.0
    assert weights.class_weight_values(df) == {0: 1.0}


def test_prefix_sum_across_slices(spark):
    df = spark.range(5000).selectExpr("id % 997 AS v", "if(id < 4500, 'hot', 'cold') AS g")
    rows = prefix_sum(df.repartition(7), "v", ["g"]).collect()
    for group, total in (("hot", 4500), ("cold", 500)):
        part = sorted((r for r in rows if r["g"] == group), key=lambda r: r["v"])
        seen = 0
        for r in part:
            seen += r["n"]
            assert r["n_cum"] == seen and r["n_total"] == total


def test_prefix_sum_descending_without_groups(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    rows = {r["v"]: r["n_cum"] for r in prefix_sum(df, "v", descending=True).collect()}
    assert rows == {2.0: 2, 1.0: 3}


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    row = grouped_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "top": 1.0}).first()
    assert (row["q1"], row["m"], row["top"]) == (1.75, 3.0, 10.0)


def test_constant_column_histogram(spark):
    df = spark.createDataFrame([(5, "Yes"), (5, "No")], "tenure int, Churn string")
    filled = profile.histogram(df).where("n > 0").collect()
    assert {r["Churn"] for r in filled} == {"Yes", "No"} and len({r["bin"] for r in filled}) == 1
