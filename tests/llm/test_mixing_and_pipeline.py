"""Raking against its definition and SQL, the pipeline against its stages, and the guard."""

import duckdb
import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from churnloom.llm import mixing, queries
from churnloom.llm.tables import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 5000)), 1)
            for i in range(9) for j in range(4) for k in range(3) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens double, docs long")


def test_marginals_meet_their_targets(cells):
    targets = mixing.tempered_targets(cells, (("source", 0.3), ("lang", 0.5), ("topic", 0.0)))
    raked = mixing.rake(cells, targets, rounds=60)
    share = {(r.dimension, r.value): r.share for r in targets.collect()}
    total = raked.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0]
    for d in mixing.DIMENSIONS:
        whole = sum(v for (dim, _), v in share.items() if dim == d)
        for r in raked.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("m")).collect():
            assert r.m / total == pytest.approx(share[d, r[d]] / whole, abs=1e-6)


def test_values_without_target_weigh_nothing(spark, cells):
    targets = mixing.tempered_targets(cells).where("value not in ('s0', 'l1')")
    targets = targets.unionByName(spark.createDataFrame([("source", "absent", 1e9)], targets.schema))
    for r in mixing.rake(cells, targets).collect():
        assert (r.weight == 0) == (r.source == "s0" or r.lang == "l1")


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.op1_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_mixing_equals_sql(spark, size):
    folder = f"/root/testdata/{size}"
    assert compare(spark, connect(folder), queries.op1_mixing, queries.ORACLE["op1_mixing"], folder) == []


def test_rate_scales_the_sample(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    whole, half = (mixing.mix(docs, rate=r)[0] for r in (1.0, 0.5))
    a, b = ({r.doc_id for r in x.select("doc_id").collect()} for x in (whole, half))
    assert b < a and 0.35 < len(b) / len(a) < 0.65


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y", "en", "b", 3),
            (4, "word " * 50_000, "de", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("weight", F.lit("w")).withColumn("mix_lang", F.lit("m"))
    drawn = mixing.mixed_documents(docs)
    assert drawn.columns == [*docs.columns, "weight_2", "probability"]
    kept = drawn.collect()
    assert 0 < len(kept) <= 5 and all(0 < r.probability <= 1 and r.weight == "w" for r in kept)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage keeps of the documents at sf0.01."""
    folder = "/root/testdata/sf0.01"
    docs = read(spark, folder, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), f"test_{name}")
        out.append(docs)
    return out


def test_stages_keep_columns_and_only_drop(staged):
    documents = staged[0]
    for before, after in zip(staged, staged[1:]):
        assert after.columns[: len(documents.columns)] == documents.columns
        lost = after.select("doc_id").exceptAll(before.select("doc_id"))
        assert lost.count() == 0
    assert 0 < staged[-1].count() < documents.count()


def test_toxicity_stage_equals_its_scores(spark, staged):
    scored = queries.op6_toxicity(spark, "/root/testdata/sf0.01").where("predicted = 0")
    assert {r.doc_id for r in scored.collect()} == {r.doc_id for r in staged[1].collect()}


def test_near_duplicate_stage_keeps_one_of_each_component(staged):
    from churnloom.llm.simhash import near_duplicates

    of = {r.doc_id: r.component_id for r in near_duplicates(staged[2]).collect()}
    assert sorted(r.doc_id for r in staged[3].collect()) == sorted(set(of.values()))


def test_no_contaminated_document_is_left(spark, staged):
    from churnloom.llm.contamination import contamination

    items = read(spark, "/root/testdata/sf0.01", "benchmark")
    before = contamination(staged[3], items)
    assert before.where("contaminated").count() == staged[3].count() - staged[4].count() > 0
    assert contamination(staged[4], items).where("contaminated").count() == 0


def test_mixing_stage_equals_sql(staged):
    from churnloom.llm.oracle import mixing_sql

    docs = staged[4].toPandas()
    con = duckdb.connect()
    con.register("kept", docs)
    rows = con.sql(mixing_sql("kept", "doc_id")).fetchall()
    got = [(r.doc_id, round(r.weight, 6), round(r.probability, 6)) for r in staged[5].collect()]
    assert sorted(got) == sorted(rows)


def test_run_equals_the_stages(spark, staged):
    ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect())
    assert ids == sorted(r.doc_id for r in staged[5].collect())
