"""Boosters against plain NumPy versions, tree by tree, and fits that share their passes."""

import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnloom.operators import boosting, models, tune
from churnloom.operators.boosting import Fit, fit_together

N = 240


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.stack(
        [
            np.round(rng.normal(size=N), 1),
            rng.integers(0, 2, N),
            rng.integers(-2, 4, N),
            (rng.random(N) < 0.1).astype(float),
            np.zeros(N),
        ],
        axis=1,
    )
    y = (x[:, 0] + x[:, 1] - 0.3 * x[:, 2] + rng.normal(size=N) * 0.7 > 0.4).astype(float)
    return x, y, np.where(y == 1, 1.7, 1.0)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, w = data
    sparse = lambda r: Vectors.sparse(5, {j: r[j] for j in range(5) if r[j]})
    return spark.createDataFrame(
        [(i, y[i].item(), w[i].item(), i % 3, sparse(x[i]) if i % 2 else Vectors.dense(x[i])) for i in range(N)],
        ["customerID", "label", "w", "fold", "features"],
    ).repartition(5)


def cuts_of(x):
    return [[(a + b) / 2 for a, b in zip(u, u[1:])] for u in (np.unique(x[:, j]) for j in range(x.shape[1]))]


def first_best(options):
    """Greatest gain; the first of those that differ by rounding only."""
    best = max(options, key=lambda o: o[0])[0]
    return next(o for o in options if o[0] >= best - 1e-9 * abs(best))


def plain_tree(x, g, h, depth, split_gain, value):
    """(node, slot, cut) of the inner nodes, and the value for each row."""
    cuts, inner, said = cuts_of(x), [], np.zeros(len(x))

    def grow(node, at, level):
        said[at] = value(g[at], h[at])
        if level == depth:
            return
        options = []
        for slot, points in enumerate(cuts):
            for cut in points:
                left = at & (x[:, slot] <= cut)
                right = at & (x[:, slot] > cut)
                if left.any() and right.any():
                    gain = split_gain(g, h, left, right)
                    if gain is not None:
                        options.append((gain, slot, cut))
        if not options or (best := first_best(options))[0] <= 1e-12:
            return
        inner.append((node, best[1], best[2]))
        grow(2 * node + 1, at & (x[:, best[1]] <= best[2]), level + 1)
        grow(2 * node + 2, at & (x[:, best[1]] > best[2]), level + 1)

    grow(0, np.ones(len(x), bool), 0)
    return sorted(inner), said


def plain_boosting(x, y, w, fit, start):
    def newton(g, h, left, right):
        hl, hr = h[left].sum(), h[right].sum()
        if hl < fit.min_child or hr < fit.min_child:
            return None
        score = lambda s: g[s].sum() ** 2 / (h[s].sum() + fit.l2)
        return 0.5 * (score(left) + score(right) - score(left | right))

    def means(g, h, left, right):
        a, b = left.sum(), right.sum()
        return a * b / (a + b) * (g[left].mean() - g[right].mean()) ** 2

    second = fit.kind == "second_order"
    margin, trees = np.full(len(y), start), []
    for _ in range(fit.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        value = lambda g, h: fit.rate * g.sum() / (h.sum() + (fit.l2 if second else 0))
        inner, said = plain_tree(x, g, h, fit.depth, newton if second else means, value)
        margin = margin + said
        trees.append(inner)
    return trees, margin


def inner_nodes(tree):
    return [(i, int(tree.slot[i]), tree.cut[i]) for i in range(len(tree.slot)) if tree.slot[i] >= 0]


def same_trees(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert [n[:2] for n in a] == [n[:2] for n in b]
        assert np.allclose([n[2] for n in a], [n[2] for n in b])


@pytest.mark.parametrize(
    "fit",
    [
        Fit("second_order", 13, 3, 0.3, l2=1.0, min_child=1.0, weight="w"),
        Fit("second_order", 4, 4, 0.5, l2=0.2, min_child=3.0),
        Fit("gradient", 12, 3, 0.2),
    ],
    ids=["second", "second-deep", "first"],
)
def test_boosting_equals_a_plain_one(rows, data, fit):
    x, y, w = data
    (grown,) = fit_together(rows, [fit])
    start = np.log(y.sum() / (N - y.sum())) if fit.kind == "gradient" else 0.0
    assert grown.start == pytest.approx(start)
    trees, margin = plain_boosting(x, y, w if fit.weight else np.ones(N), fit, start)
    same_trees([inner_nodes(t) for t in grown.trees], trees)
    builder = models.BoostedTreesClassifier()
    got = builder.as_model(grown).transform(rows).select("customerID", "probability", "prediction").collect()
    p = {r.customerID: r.probability[1] for r in got}
    assert np.allclose([p[i] for i in range(N)], 1 / (1 + np.exp(-margin)))
    assert all(r.prediction == float(r.probability[1] > 0.5) for r in got)


def plain_samme(x, y, rounds, rate):
    w, out = np.full(N, 1.0 / N), []
    for _ in range(rounds):
        options = []
        for slot, points in enumerate(cuts_of(x)):
            for cut in points:
                sides = [x[:, slot] <= cut, x[:, slot] > cut]
                gini = sum(2 * w[s & (y == 1)].sum() * w[s & (y == 0)].sum() / w[s].sum() for s in sides)
                options.append((-gini, slot, cut, [float(w[s & (y == 1)].sum() > w[s & (y == 0)].sum()) for s in sides]))
        best = max(o[0] for o in options)
        _, slot, cut, (left, right) = next(o for o in options if o[0] >= best - 1e-9)
        said = np.where(x[:, slot] <= cut, left, right)
        error = w[said != y].sum() / w.sum()
        if error >= 0.5:
            break
        alpha = rate * np.log((1 - error) / error)
        out.append((slot, cut, left, right, alpha))
        w = w * np.where(said != y, np.exp(alpha), 1.0)
        w /= w.sum()
    return out


def test_stumps_equal_plain_samme(rows, data):
    x, y, _ = data
    model = models.ada_boost(maxIter=23, stepSize=0.8).fit(rows)
    expected = plain_samme(x, y, 23, 0.8)
    got = list(zip(*(model.getOrDefault(p) for p in ("slots", "cuts", "left", "right", "alphas"))))
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose(np.array(got), np.array(expected))


def test_fits_in_common_passes_equal_fits_alone(rows):
    fits = [
        Fit("gradient", 6, 2, leave_out=("fold", 1)),
        Fit("second_order", 3, 3, weight="w"),
        Fit("stumps", 11, 1, 1.0, leave_out=("fold", 0)),
        Fit("gradient", 4, 3, subsample=0.7, columns=0.6, seed=9),
    ]
    together = fit_together(rows, fits)
    for fit, grown in zip(fits, together):
        source = rows
        if fit.subsample < 1:  # which rows a tree draws hangs on the written table
            assert all(len(np.unique(t.slot[t.slot >= 0])) <= 3 for t in grown.trees)
            continue
        (alone,) = fit_together(source, [fit])
        assert [inner_nodes(t) for t in alone.trees] == [inner_nodes(t) for t in grown.trees]


def test_left_out_rows_do_not_count(rows):
    (out,) = fit_together(rows, [Fit("second_order", 2, 2, leave_out=("fold", 2))])
    (inside,) = fit_together(rows.where("fold <> 2"), [Fit("second_order", 2, 2)])
    assert out.trees[0].value[0] == pytest.approx(inside.trees[0].value[0])


def test_many_values_and_constant_slots(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=1500)
    rows = spark.createDataFrame(
        [(i, float(v > 0.1), Vectors.dense([1.0, v])) for i, v in enumerate(x)], ["customerID", "label", "features"]
    )
    model = models.weighted_boosting(maxIter=3, maxDepth=1, weightCol="").fit(rows)
    assert all(abs(t.cut[0] - 0.1) < 0.05 and t.slot[0] == 1 for t in model.trees())
    constant = spark.createDataFrame([(1, 1.0, Vectors.dense([2.0]))] * 3, ["customerID", "label", "features"])
    fitted = models.gradient_boosting(maxIter=2).fit(constant)  # nothing to split: one leaf
    assert fitted.transform(constant).first().prediction == 1.0
    assert all((t.slot == -1).all() for t in fitted.trees())


def test_boosted_model_persists(rows, tmp_path):
    model = models.weighted_boosting(maxIter=3, weightCol="w").fit(rows)
    model.write().save(str(tmp_path / "m"))
    back = models.BoostedTreesModel.load(str(tmp_path / "m"))
    pick = lambda m: [r.probability for r in m.transform(rows).orderBy("customerID").collect()]
    assert pick(model) == pick(back)


def test_search_goes_on_from_its_log(rows, tmp_path, monkeypatch):
    spec = models.ModelSpec("tree", models.gradient_boosting, [{"maxIter": 1, "maxDepth": d} for d in (1, 2, 3)])
    whole = tune.search(models.FitCache(rows), spec, batch=2)
    made = []

    def counting(kept, stop_after):
        cache = models.FitCache(rows)
        plain = cache.fits

        def fits(wanted, parallelism):
            if len(made) >= stop_after:
                raise KeyboardInterrupt
            made.extend(wanted)
            return plain(wanted, parallelism)

        monkeypatch.setattr(cache, "fits", fits)
        return cache

    uri = str(tmp_path / "log")
    with pytest.raises(KeyboardInterrupt):
        tune.search(counting(made, 4), spec, log=tune.ScoreLog(rows.sparkSession, uri), batch=2)
    assert len(made) == 4
    made.clear()
    again = tune.search(counting(made, 99), spec, log=tune.ScoreLog(rows.sparkSession, uri), batch=2)
    assert len(made) == 5 and again == whole
    assert json.loads(json.dumps([c.settings for c in again])) == spec.grid


def test_a_stack_shares_the_fits_of_the_comparison(rows, monkeypatch):
    calls = []
    plain = boosting.fit_together

    def counting(table, fits, *args):
        calls.append(len(list(fits)))
        return plain(table, fits, *args)

    monkeypatch.setattr(models, "fit_together", counting)
    small = {"maxIter": 2, "maxDepth": 2}
    base = [models.gradient_boosting(**small), models.ada_boost(maxIter=2)]
    stack = models.StackingClassifier(base, folds=5)
    cache = models.FitCache(models.with_stack_folds(rows))
    first = cache.fits([(e, None) for e in base])
    cache.fits([(stack, None)])
    assert calls == [2, 10]  # the two on all rows are not fitted again
    again = cache.fits([(models.gradient_boosting(**small), None)])
    assert again[0] is first[0] and calls == [2, 10]


def test_rows_are_written_in_blocks(rows, data, monkeypatch):
    tables = []
    plain = boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, *args: tables.append(plain(df, *args)) or tables[-1])
    (whole,) = fit_together(rows, [Fit("second_order", 11, 2, leave_out=("fold", 1))])
    assert [t.agg({"n": "sum"}).first()[0] for t in tables] == [N, N] and tables[0].count() < N / 5
    # Small blocks, cut in small slices, and cells that are too many to hold give the same trees.
    for name, value in (("BLOCK_ROWS", 7), ("SLICE_ROWS", 3), ("_DENSE_CELLS", 0), ("KNOWN_SLOTS", 1)):
        monkeypatch.setattr(boosting, name, value)
    (parts,) = fit_together(rows, [Fit("second_order", 11, 2, leave_out=("fold", 1))])
    assert [inner_nodes(t) for t in parts.trees] == [inner_nodes(t) for t in whole.trees]
    assert all(np.allclose(a.value, b.value) for a, b in zip(parts.trees, whole.trees))


def test_blocks_of_one_partition_are_dealt(rows, monkeypatch):
    tables = []
    plain = boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, *args: tables.append(plain(df, *args)) or tables[-1])
    (whole,) = fit_together(rows, [Fit("gradient", 2, 2)])
    for name, value in (("BLOCK_ROWS", 7), ("SLICE_ROWS", 3), ("ROWS_A_TASK", 10)):
        monkeypatch.setattr(boosting, name, value)
    (parts,) = fit_together(rows.coalesce(1), [Fit("gradient", 2, 2)])
    held = tables[1].groupBy(F.input_file_name()).agg({"n": "sum"}).collect()
    assert len(held) > 1 and max(r[1] for r in held) < N and sum(r[1] for r in held) == N
    assert [inner_nodes(t) for t in parts.trees] == [inner_nodes(t) for t in whole.trees]


def test_fits_of_few_rows_take_no_job_for_each_level(spark, rows, monkeypatch):
    fits = [
        Fit("gradient", 23, 3, leave_out=("fold", 1)),
        Fit("second_order", 25, 4, subsample=0.7, columns=0.6, weight="w"),
        Fit("stumps", 21, 1, 0.7),
    ]
    one = rows.coalesce(1)  # rows are numbered in the order they are written in
    with monkeypatch.context() as m:
        m.setattr(boosting, "WHOLE_BYTES", 0)
        passes = fit_together(one, fits)
    spark.sparkContext.setJobGroup("few-rows", "")
    whole = fit_together(one, fits)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-rows")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20
    for a, b in zip(whole, passes):
        assert (a.start, a.votes, a.shifts, a.stopped) == (b.start, b.votes, b.shifts, b.stopped)
        assert [inner_nodes(t) for t in a.trees] == [inner_nodes(t) for t in b.trees]
        assert all((x.value == y.value).all() for x, y in zip(a.trees, b.trees))
