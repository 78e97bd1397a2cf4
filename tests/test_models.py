import json
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnloom.operators import features, impute, models, score, tune
from churnloom.operators.impute import KNNImputer, KNNImputerModel, ModeImputer, Standardizer
from churnloom.plans import train as jobs
from churnloom.schema import FEATURES, TARGET, customer_schema, load_rules
from churnloom.sources import readers, writers
from churnloom.sources.derived import raw_customers, separable_target
from churnloom.sources.storage import materialize, scratch_path
from churnloom.streaming.scoring import score_stream

COLS = ["a", "b", "c", "d"]


def numbers(rng, n, hole):
    rows = []
    for i in range(n):
        row = [
            float(rng.randint(0, 1)),
            float(rng.randint(0, 30)),
            round(rng.uniform(0, 50), 1),
            round(rng.expovariate(1 / 300), 1),
        ]
        rows.append((i, *(None if rng.random() < hole else v for v in row)))
    return rows


def brute_knn(fit_rows, row, j, k=5):
    near = []
    for x in fit_rows:
        both = [i for i in range(4) if row[i] is not None and x[i] is not None]
        if x[j] is None or not both:
            continue
        d = 4 / len(both) * sum((row[i] - x[i]) ** 2 if i in both else 0.0 for i in range(4))
        near.append((d, [(v is not None, v or 0.0) for v in x], x[j]))
    near = sorted(near)[:k]
    if near:
        return sum(v for *_, v in near) / len(near)
    known = [x[j] for x in fit_rows if x[j] is not None]
    return sum(known) / len(known)


@pytest.mark.parametrize("block,fanout", [(64, 32), (4, 3)])
def test_knn_equals_brute_force(spark, monkeypatch, block, fanout):
    monkeypatch.setattr(impute, "BLOCK_SIZE", block)
    monkeypatch.setattr(impute, "FANOUT", fanout)
    rng = random.Random(block)
    fit_rows = numbers(rng, 250, 0.1)
    fit_rows += [(1000 + i, *fit_rows[0][1:]) for i in range(100)]  # one hot point
    other = numbers(rng, 40, 0.3) + [(500, None, None, None, None), (501, 0.0, 1e6, None, -1e6)]
    schema = "id int, a double, b double, c double, d double"
    model = KNNImputer(inputCols=COLS).fit(spark.createDataFrame(fit_rows, schema))
    found = {
        r["id"]: r for r in model.transform(spark.createDataFrame(other, schema)).collect()
    }
    points = [r[1:] for r in fit_rows]
    assert len(found) == len(other)
    for i, *row in other:
        for j, name in enumerate(COLS):
            expected = brute_knn(points, row, j) if row[j] is None else row[j]
            assert found[i][name] == pytest.approx(expected, abs=1e-9), (i, name)


def test_near_boxes_bound_the_kth_neighbour(spark):
    """Of the points of the boxes that are kept, those beyond the bound need no ranking."""
    fit = spark.range(400).selectExpr("cast(id as double) a", "cast(2 * id as double) b")
    model = KNNImputer(inputCols=["a", "b"]).fit(fit)
    asked = spark.createDataFrame([(100.0, None, "10")], "r0 double, r1 double, recv_mask string")
    points, levels = model._index(("10",))
    boxes = model._near_boxes(asked.join(levels[-1], "recv_mask"))
    met = boxes.withColumnRenamed("node", "block").join(points, ["recv_mask", "mask", "block"])
    inside = met.where("(c0 - r0) * (c0 - r0) <= _limit")
    assert inside.where("abs(c0 - r0) <= 2").count() == 5
    assert 5 <= inside.count() < 0.7 * met.count()
    filled = model.transform(spark.createDataFrame([(100.0, None)], "a double, b double")).first()
    assert filled.b == 200.0


def test_knn_of_tied_points_keeps_as_many_boxes_at_any_size(spark):
    """A row that has only a 0/1 column ties with half of all fit rows."""
    kept = []
    for n in (2_000, 8_000):
        fit = spark.range(n).selectExpr(
            "cast(id % 2 as double) a", "cast(id as double) b", "cast(id * 7 % 101 as double) c"
        )
        model = KNNImputer(inputCols=["a", "b", "c"]).fit(fit)
        asked = spark.createDataFrame([(0.0, None, None), (1.0, None, None)], "a double, b double, c double")
        rows = sorted(tuple(r) for r in model.transform(asked).collect())
        assert rows[0][:2] == (0.0, 4.0) and rows[1][:2] == (1.0, 5.0)
        (points, levels), = model._indexes.values()
        kept.append((points.count(), levels[-1].count()))
    assert kept[0] == kept[1]


def test_knn_of_65_columns(spark):
    names = [f"c{i}" for i in range(65)]
    fit = spark.createDataFrame([[float(i * j) for j in range(65)] for i in range(8)], names)
    new = spark.createDataFrame([[None if j in (0, 64) else 3.0 * j for j in range(65)]], ", ".join(f"{n} double" for n in names))
    row = KNNImputer(inputCols=names, k=1).fit(fit).transform(new).first()
    assert (row["c0"], row["c64"]) == (0.0, 192.0)


def test_knn_never_observed_column_and_reload(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    model = KNNImputer(inputCols=["a", "b"]).fit(df)
    rows = sorted(tuple(r) for r in model.transform(df).collect())
    assert rows == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    path = scratch_path(spark, "knn")
    model.write().save(path)
    again = KNNImputerModel.load(path).transform(df).collect()
    assert sorted(tuple(r) for r in again) == rows


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = Standardizer(inputCols=["a", "b"]).fit(df).transform(df).collect()
    assert sorted(tuple(r) for r in rows) == [(-1.0, 0.0), (1.0, 0.0)]


def test_unseen_and_missing_text_encode_as_zeros(spark):
    fit = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "t string, n double")
    new = spark.createDataFrame([("z", 1.0), ("y", 1.0), (None, 1.0)], "t string, n double")
    stages = features.encoding_stages(["n"], ["t"])
    done = Pipeline(stages=stages).fit(fit).transform(new)
    vectors = [list(r[0])[1:] for r in done.select(vector_to_array(features.ALL_FEATURES)).collect()]
    # The missing text takes the most frequent value, the smaller on a tie.
    assert vectors == [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    assert features.feature_names(done, features.ALL_FEATURES) == ["n", "t_onehot_x", "t_onehot_y"]


def test_mode_imputer_fills_all_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    assert {r["t"] for r in ModeImputer(inputCols=["t"]).fit(df).transform(df).collect()} == {"Unknown"}


@pytest.fixture(scope="module")
def customers(spark, sf_dir):
    """Distinct customers of the small tables whose target the features decide."""
    raw = materialize(raw_customers(spark, sf_dir).dropDuplicates(), "raw")
    return raw.withColumn(TARGET, separable_target())


@pytest.fixture(scope="module")
def prepared(spark, customers):
    from churnloom.operators.split import holdout_split
    from churnloom.plans.ingest import parts

    train, test = parts(materialize(holdout_split(customers), "split"))
    return jobs.transform(train, test, selector_trees=10, selector_depth=4)


@pytest.fixture(scope="module")
def model(prepared):
    tree = models.decision_tree(maxDepth=4).fit(prepared.train)
    return jobs.assemble_model(prepared, tree)


def scores(df):
    return {r["customerID"]: (r["prediction"], round(r["probability"], 9)) for r in df.collect()}


def test_every_classifier_beats_the_majority(prepared):
    for spec in models.light_specs():
        fitted, _ = tune.grid_search(prepared.train, spec)
        rows = tune.predictions(fitted, prepared.train).collect()
        right = sum(r["label"] == r["prediction"] for r in rows) / len(rows)
        positives = sum(r["label"] for r in rows) / len(rows)
        assert right > max(positives, 1 - positives), spec.name
        assert {r["prediction"] for r in rows} <= {0, 1}
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_boosted_stumps_stop_on_a_perfect_tree(spark, prepared):
    exact = prepared.train.withColumn("label", F.when(vector_to_array("features")[0] > 0, 1.0).otherwise(0.0))
    fitted = models.ada_boost(maxIter=5).fit(exact)
    assert len(fitted.getOrDefault("alphas")) == 1
    assert all(r["label"] == r["prediction"] for r in fitted.transform(exact).collect())


def test_search_takes_the_best_mean_f1(prepared):
    spec = models.ModelSpec("decision_tree", models.decision_tree, [{"maxDepth": 1}, {"maxDepth": 5}])
    fitted, found = tune.grid_search(prepared.train, spec)
    assert [c.position for c in found] == [0, 1]
    best = tune.best_candidate(found)
    assert best.cv_f1 == max(c.cv_f1 for c in found)
    assert fitted.getMaxDepth() == best.settings["maxDepth"]


def test_choice_by_fold_scores(prepared):
    specs = [
        models.ModelSpec("stump", models.decision_tree, [{"maxDepth": 1}]),
        models.ModelSpec("tree", models.decision_tree, [{"maxDepth": 4}]),
    ]
    trained = jobs.train(prepared, specs, select_on="cv")
    scores = {r["model"]: r["cv_f1"] for r in trained.report.collect()}
    assert trained.best_name == max(scores, key=scores.get)
    assert trained.best is trained.models[trained.best_name]


def test_every_setting_of_the_full_search_builds(spark):
    specs = models.full_specs()
    assert [len(s.grid) for s in specs] == [24, 16, 4, 12, 32, 1]
    for spec in [*specs, *models.base_specs()]:
        for settings in spec.grid:
            spec.build(**settings)


def test_a_column_of_any_number_of_values_is_encoded(spark, tmp_path):
    """200,000 values make as many slots, in their order; unseen and missing cells have none."""
    from pyspark.ml.feature import OneHotEncoder

    n = 200_000
    df = spark.range(n).selectExpr("concat('v', lpad(id, 6, '0')) AS t", "concat('k', id % 3) AS u")
    indexer = features.CategoryIndexer(inputCols=["t", "u"], outputCols=["t_index", "u_index"])
    encoder = OneHotEncoder(inputCols=["t_index", "u_index"], outputCols=["t_onehot", "u_onehot"])
    model = Pipeline(stages=[indexer, encoder]).fit(df)
    model.write().save(str(tmp_path / "m"))
    asked = spark.createDataFrame(
        [("v000000", "k0"), ("v199999", "k2"), ("v123456", None), ("new", "k9"), (None, "k1")], "t string, u string"
    )
    for fitted in (model, PipelineModel.load(str(tmp_path / "m"))):
        rows = {(r.t, r.u): (r.t_onehot, r.u_onehot) for r in fitted.transform(asked).collect()}
        places = {k: (list(t.indices), list(u.indices)) for k, (t, u) in rows.items()}
        assert places == {
            ("v000000", "k0"): ([0], [0]),
            ("v199999", "k2"): ([199_999], [2]),
            ("v123456", None): ([123_456], []),
            ("new", "k9"): ([], []),
            (None, "k1"): ([], [1]),
        }
        assert {(t.size, u.size) for t, u in rows.values()} == {(n, 3)}


def test_named_and_joined_categories_are_the_same(spark, monkeypatch):
    df = spark.range(500).selectExpr("concat('v', id % 37) AS t", "CASE WHEN id % 5 > 0 THEN concat('w', id) END AS u")
    indexer = features.CategoryIndexer(inputCols=["t", "u"], outputCols=["ti", "ui"])
    found = []
    for named in (10_000, 100, 1):
        monkeypatch.setattr(features, "NAMED_CATEGORIES", named)
        found.append(sorted(map(str, indexer.fit(df).transform(df).select("t", "u", "ti", "ui").collect())))
    assert found[0] == found[1] == found[2]


def test_records_as_json_rows(spark):
    lines = spark.createDataFrame(
        [('{"customerID": "a", "tenure": 5, "extra": {"x": 1}}',), ('{"customerID": "b", "MonthlyCharges": "7.5"}',)],
        "record string",
    )
    table = readers.json_records(lines)
    assert dict(table.dtypes) == {
        "customerID": "string", "tenure": "int", "MonthlyCharges": "double", "extra": "string"
    }
    rows = {r["customerID"]: r.asDict() for r in table.collect()}
    assert rows["a"] == {"customerID": "a", "tenure": 5, "MonthlyCharges": None, "extra": '{"x":1}'}
    assert rows["b"]["MonthlyCharges"] == 7.5 and rows["b"]["tenure"] is None
    with pytest.raises(ValueError, match="1 records"):
        readers.json_records(spark.createDataFrame([("{}",), ("nonsense",)], "record string"))
    with pytest.raises(ValueError, match="no record"):
        readers.json_records(lines.limit(0))


def test_saved_models_score_the_same(spark, prepared):
    for name in ("ada_boost", "stacking"):
        spec = next(s for s in models.light_specs() if s.name == name)
        fitted = spec.build(**spec.grid[0]).fit(prepared.train)
        path = scratch_path(spark, name)
        fitted.write().save(path)
        again = type(fitted).load(path)
        key = lambda r: r["customerID"]
        first = sorted(tune.predictions(fitted, prepared.test).collect(), key=key)
        assert first == sorted(tune.predictions(again, prepared.test).collect(), key=key)


def test_contract(spark, customers, model):
    records = customers.drop(TARGET)
    assert score.expected_features(model) == FEATURES
    with pytest.raises(score.ScoringSchemaError, match="tenure"):
        score.score(model, records.drop("tenure"))
    with pytest.raises(score.ScoringSchemaError, match="extra"):
        score.score(model, records.withColumn("extra", F.lit(1)))
    lenient = score.score(model, records.withColumn("extra", F.lit(1)), strict=False)
    shuffled = records.select(*reversed(records.columns))
    assert scores(lenient) == scores(score.score(model, shuffled))


def test_records_csv_and_stream_score_like_the_table(spark, customers, model):
    records = customers.drop(TARGET)
    expected = scores(score.score(model, records))
    assert len(expected) == records.count()

    path = scratch_path(spark, "csv")
    writers.write_table(records, path, "csv")
    assert scores(score.score(model, readers.scan_csv(spark, path))) == expected

    first = json.loads(writers.to_json_records(records).orderBy("record").first()["record"])
    one = score.score(model, readers.records_to_table(spark, first)).collect()
    assert len(one) == 1 and one[0]["prediction"] == expected[first["customerID"]][0]

    source, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    checkpoint = scratch_path(spark, "stream")
    halves = records.randomSplit([0.5, 0.5], 1)
    for half in halves:
        half.coalesce(1).write.mode("append").json(source)
        score_stream(spark, model, source, sink, checkpoint, files_per_trigger=1).awaitTermination()
    scored = spark.read.parquet(sink)
    assert scored.count() == len(expected) and scores(scored) == expected
    from churnloom.sources.storage import list_names, scratch_path as new_path

    folder = new_path(spark, "x").rsplit("/", 1)[0]
    before = [n for n in list_names(spark, folder) if n.startswith(("receivers", "fills"))]
    records.limit(7).coalesce(1).write.mode("append").json(source)
    score_stream(spark, model, source, sink, checkpoint).awaitTermination()
    after = [n for n in list_names(spark, folder) if n.startswith(("receivers", "fills"))]
    assert after == before


def test_untyped_records(spark, model):
    record = {c: "No" for c in FEATURES} | {
        "customerID": "x", "SeniorCitizen": "1", "tenure": 3, "MonthlyCharges": 20.5, "TotalCharges": 61.5,
    }
    table = readers.records_to_table(spark, [record, {**record, "customerID": "y"}])
    assert dict(table.dtypes)["tenure"] == "int" and dict(table.dtypes)["TotalCharges"] in ("double", "string")
    assert {r["prediction"] for r in score.score(model, table).collect()} <= {0, 1}
    with pytest.raises(ValueError):
        readers.records_to_table(spark, [])


def test_publish_and_find(spark, customers, model):
    uri = scratch_path(spark, "final")
    assert jobs.find_model(spark, [uri]) is None
    jobs.publish(model, uri)
    assert jobs.find_model(spark, ["nosuchscheme://x/y", uri]) == uri
    records = customers.drop(TARGET)
    loaded = jobs.load_model(uri)
    assert scores(score.score(loaded, records)) == scores(score.score(model, records))
    # The loaded model reads tables of the version in force; publishing it there keeps them.
    jobs.publish(loaded, uri)
    assert scores(score.score(jobs.load_model(uri), records)) == scores(score.score(model, records))


def test_a_publish_that_fails_leaves_the_former_model(spark, customers, model, monkeypatch):
    uri = scratch_path(spark, "half")
    jobs.publish(model, uri)
    before = jobs.current_version(spark, uri)

    def broken(*_):
        raise OSError("no space")

    monkeypatch.setattr(jobs, "write_text", broken)
    with pytest.raises(OSError):
        jobs.publish(model, uri)
    monkeypatch.undo()
    assert jobs.current_version(spark, uri) == before
    records = customers.drop(TARGET)
    assert score.score(jobs.load_model(uri), records).count() == records.count()
    nothing = scratch_path(spark, "unfinished")
    model.write().save(f"{nothing}/versions/1")
    assert jobs.find_model(spark, [nothing]) is None


RUN = {
    "specs": [models.ModelSpec("decision_tree", models.decision_tree, [{"maxDepth": 3}])],
    "selector_trees": 5,
    "selector_depth": 3,
}


def test_gate(spark, customers):
    uri = scratch_path(spark, "gate")
    runs = iter(scratch_path(spark, f"run-{i}") for i in range(9))
    first = jobs.run(customers, [uri], next(runs), **RUN)
    assert first.decision.first()["reason"] == "no published model"
    assert first.model_uri == uri and jobs.find_model(spark, [uri])
    assert {"train", "test", "setting"} == {r[0] for r in first.metrics.select("split").distinct().collect()}
    second = jobs.run(customers, [uri], next(runs), **RUN)
    drifted = second.validation.drift_found
    assert second.decision.first()["decision"] == ("train" if drifted else "skip")
    assert (second.trained is not None) == drifted
    broken = customers.withColumn("tenure", F.col("tenure") + 1000)
    with pytest.raises(ValueError, match="schema"):
        jobs.run(broken, [uri], next(runs), **RUN)
    with pytest.raises(ValueError, match="empty"):
        jobs.run(customers.where("false"), [uri], next(runs), **RUN)


def test_csv_missing_tokens(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,t,n\n1,NA,1\n2,na,x\n3, ,NULL\n4,,2\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = [tuple(r) for r in readers.scan_csv(spark, str(path), schema).orderBy("id").collect()]
    # A cell that is no number keeps the whole column as text, and every row.
    assert rows == [(1, None, "1"), (2, "na", "x"), (3, " ", None), (4, None, "2")]
    counts = {r["column"]: r["n_invalid"] for r in readers.invalid_cells(spark, str(path), schema).collect()}
    assert counts == {"id": 0, "t": 0, "n": 1}
    path.write_text("id,t,n\n1,NA,1\n2,na,\n")
    assert dict(readers.scan_csv(spark, str(path), schema).dtypes) == {"id": "int", "t": "string", "n": "int"}


def test_csv_quotes_and_line_ends(spark, tmp_path):
    rows = [(1, 'say ""hi"", you', "a,b"), (2, 'x "y" z', "two\nlines"), (3, '"', "")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    back = writers.write_table(df, str(tmp_path / "w"), "csv").orderBy("id").collect()
    assert [(r["id"], r["t"]) for r in back] == [(i, t) for i, t, _ in rows]
    assert back[1]["u"] == "two\nlines"
    read = readers.scan_csv(spark, str(tmp_path / "w"), df.schema).orderBy("id").collect()
    assert [r["t"] for r in read] == [t for _, t, _ in rows]


def test_csv_folder_with_two_column_orders_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,t\n1,2,x\n")
    (tmp_path / "b.csv").write_text("n,id,t\n3,4,y\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.scan_csv(spark, str(tmp_path)).collect()


def test_bad_number_fails_the_type_rule_and_loses_no_row(spark, customers, tmp_path):
    from churnloom.plans.ingest import ingest
    from churnloom.operators.rules import schema_report

    bad = customers.withColumn(
        "tenure", F.when(F.col("tenure") % 2 == 0, F.lit("abc")).otherwise(F.col("tenure").cast("string"))
    )
    writers.write_table(bad, str(tmp_path / "bad"), "csv")
    table = ingest(readers.scan_csv(spark, str(tmp_path / "bad")))
    assert table.count() == ingest(customers).count()
    failed = schema_report(table).where("not passed and rule = 'type' and column = 'tenure'")
    assert failed.count() == 1


def test_append_skips_empty_input(spark):
    path = scratch_path(spark, "append")
    df = spark.range(3)
    assert not writers.append_records(df.where("false"), path)
    assert writers.append_records(df, path) and writers.append_records(df, path)
    assert spark.read.parquet(path).count() == 6


def test_rules_from_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"columns": {"n": {"type": "int", "min": 0, "max": 9}, "t": {"type": "string", "allowed": ["a"]}}}))
    n, t = load_rules(str(path))
    assert (n.minimum, n.maximum, t.allowed) == (0, 9, ("a",))


def test_customer_schema():
    assert dict(customer_schema(raw=True).fieldNames() and [(f.name, f.dataType.typeName()) for f in customer_schema(raw=True)])["TotalCharges"] == "string"
    assert TARGET not in customer_schema(target=False).names


def test_knn_looks_up_new_rows_only(spark, monkeypatch):
    rng = random.Random(5)
    schema = "id int, a double, b double, c double, d double"
    fit_rows = numbers(rng, 120, 0.1)
    more = numbers(rng, 40, 0.3) + [(500, None, None, None, None)]
    asked = []
    means = KNNImputerModel._neighbour_means

    def spy(self, receivers, masks):
        asked.append(receivers.count())
        return means(self, receivers, masks)

    monkeypatch.setattr(KNNImputerModel, "_neighbour_means", spy)
    table = spark.createDataFrame(fit_rows, schema)
    both = spark.createDataFrame(fit_rows + more, schema)
    model = KNNImputer(inputCols=COLS).fit(table)
    model.transform(table).collect()
    found = sorted(map(tuple, model.transform(both).collect()))
    model.transform(table).collect()
    own = {row[1:] for row in fit_rows if None in row}
    assert asked == [len(own), len({row[1:] for row in more if None in row} - own)]
    fresh = KNNImputer(inputCols=COLS).fit(table)
    assert found == sorted(map(tuple, fresh.transform(both).collect()))


def test_the_train_query_searches_the_whole_grid(spark, monkeypatch):
    from churnloom.catalog import model_queries

    asked = []
    monkeypatch.setattr(model_queries, "_prepared", lambda *args: None)
    monkeypatch.setattr(jobs, "train", lambda prepared, specs: asked.extend(specs))
    model_queries._trained(spark, "no-such-folder")
    assert {s.name: len(s.grid) for s in asked} == {
        "random_forest": 24, "gradient_boosting": 16, "ada_boost": 4, "decision_tree": 12,
        "weighted_boosting": 32, "stacking": 1,
    }
