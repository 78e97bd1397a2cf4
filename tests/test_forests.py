import random

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel
from pyspark.ml.linalg import Vectors

from churnloom.operators import features, forests, models


def _rows(spark, n=600):
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        x = [rng.choice([0.0, 1.0]), rng.uniform(0, 10), float(rng.randint(0, 4))]
        rows.append((Vectors.dense(x), float(x[0] + x[1] > 6 or rng.random() < 0.1), rng.choice([1.0, 2.0])))
    return spark.createDataFrame(rows, ["features", "label", "weight"])


def test_rows_of_one_partition_reach_every_core(spark, monkeypatch):
    monkeypatch.setattr(forests, "FEW_ROWS", 50)
    rows = _rows(spark).coalesce(1)
    shares = forests.dealt(rows, ["features", "label"])
    sizes = shares.rdd.glom().map(len).collect()
    assert len(sizes) == min(spark.sparkContext.defaultParallelism, 12)
    assert sum(sizes) == 600 and max(sizes) <= 2 * min(sizes)
    key = lambda r: (tuple(r["features"]), r["label"])
    assert sorted(map(key, shares.collect())) == sorted(map(key, rows.collect()))


def test_many_rows_make_more_tasks_than_cores(spark, monkeypatch):
    monkeypatch.setattr(forests, "FEW_ROWS", 50)
    monkeypatch.setattr(forests, "TASK_ROWS", 30)
    assert forests.dealt(_rows(spark), ["features"]).rdd.getNumPartitions() == 20


def test_few_rows_keep_their_partitions(spark):
    rows = _rows(spark, 40).coalesce(1)
    assert forests.dealt(rows, ["features", "label"]) is rows


def test_tree_is_that_of_mllib(spark, monkeypatch):
    monkeypatch.setattr(forests, "FEW_ROWS", 50)
    rows = _rows(spark)
    own = models.decision_tree(maxDepth=12)
    assert own.getCacheNodeIds()
    plain = DecisionTreeClassifier(weightCol="weight", seed=models.SEED, maxBins=models.MAX_BINS, maxDepth=12).fit(rows)
    assert own.fit(rows).toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_forests_keep_the_node_of_each_row(spark, monkeypatch):
    monkeypatch.setattr(forests, "FEW_ROWS", 50)
    seen = []
    fit = forests.DealtForest._fit

    def spy(self, dataset):
        seen.append(self.getCacheNodeIds())
        return fit(self, dataset)

    monkeypatch.setattr(forests.DealtForest, "_fit", spy)
    rows = _rows(spark)
    forest = models.random_forest(numTrees=3, maxDepth=4).fit(rows)
    assert forest.getNumTrees == 3 and forest.transform(rows).count() == 600
    features.ForestSelector(inputCol="features", outputCol="chosen", numTrees=3, maxDepth=4).fit(rows.drop("weight"))
    assert seen == [True, True]


def test_whole_trees_score_as_mllib_reads_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(forests, "LEAST_WHOLE", 500)
    rows = _rows(spark)
    forest = models.random_forest(numTrees=12, maxDepth=30).fit(rows)
    assert isinstance(forest, forests.WholeForestModel)
    forest.write().save(str(tmp_path / "m"))
    back = RandomForestClassificationModel.load(str(tmp_path / "m"))
    names = ("features", "rawPrediction", "probability", "prediction")
    pick = lambda m: sorted((tuple(r[0]), *r[1:]) for r in m.transform(rows).select(*names).collect())
    assert pick(forest) == pick(back) and forest.transform(rows).dtypes == back.transform(rows).dtypes
    assert np.allclose(forest.featureImportances.toArray(), back.featureImportances.toArray())
    assert (back.getNumTrees, back.uid, back.getMaxDepth()) == (12, forest.uid, 30)
    assert [t.depth for t in forest.trees] == [t.depth for t in back.trees]
    # Another order and other partitions of the rows give the same forest.
    again = models.random_forest(numTrees=12, maxDepth=30).fit(rows.orderBy("features").repartition(3))
    assert again.toDebugString.split("\n")[1:] == forest.toDebugString.split("\n")[1:]


def test_a_whole_tree_of_all_rows_is_that_of_mllib(spark):
    """Without a draw, and with all slots at each node, only one tree is right."""
    rows = _rows(spark)
    for settings in ({}, {"minInstancesPerNode": 9}, {"impurity": "entropy"}, {"maxBins": 12}, {"maxDepth": 3}):
        tree = DecisionTreeClassifier(weightCol="weight", **{"maxDepth": 30, "maxBins": 256, **settings}).fit(rows)
        x, y, w = forests.whole_table(rows, "features", "label", "weight")
        cuts = [forests.slot_cuts(x[:, j], w, settings.get("maxBins", 256)) for j in range(3)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        plan = forests.Growth(
            settings.get("maxDepth", 30), 3, settings.get("impurity", "gini"),
            settings.get("minInstancesPerNode", 1), bootstrap=False,
        )
        nodes = forests.grow_tree(plan, 0, binned, y, w, cuts)
        assert len(nodes.gain) == tree.numNodes
        own = np.zeros(3)
        np.add.at(own, nodes.slot[nodes.slot >= 0], (nodes.gain * nodes.stats.sum(axis=1))[nodes.slot >= 0])
        assert np.allclose(own / own.sum(), tree.featureImportances.toArray(), atol=1e-6)


def test_other_tables_are_left_to_mllib(spark, monkeypatch):
    monkeypatch.setattr(forests, "LEAST_WHOLE", 1)
    rows = _rows(spark, 60)
    assert forests.whole_table(rows, "features", "label", most=2) is None
    assert forests.whole_table(rows.where("label = 1"), "features", "label") is None
    three = rows.unionByName(_rows(spark, 3).selectExpr("features", "2D label", "weight"))
    fitted = models.random_forest(numTrees=2, maxDepth=3).fit(three)
    assert fitted.numClasses == 3 and not isinstance(fitted, forests.WholeForestModel)


def test_forests_of_a_comparison_grow_whole_on_few_rows(spark):
    rows = _rows(spark).withColumnRenamed("weight", models.BALANCED)
    wanted = models.random_forest(numTrees=5, maxDepth=8)
    assert not isinstance(wanted.fit(rows), forests.WholeForestModel)
    (fitted,) = models.FitCache(rows).fits([(wanted, None)])
    assert isinstance(fitted, forests.WholeForestModel) and fitted.uid == wanted.uid
