"""Forests grown side by side against plain recursion, and the search over their settings."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrastat.operators import forests, learn
from terrastat.operators.search import FOREST_SPACE, Search


def table(n=300, seed=1, levels=12):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 4)) * levels / 4) / levels * 4
    y = 2 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, n)
    return pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(n), t=y, inner=np.arange(n) % 4 + 1)


def sample(p, **more):
    x = p[list("abcd")].to_numpy()
    cuts = [forests.cuts_of(x[:, f]) for f in range(4)]
    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    w = more.get("weights", np.zeros((len(p), 0)))
    return forests.Sample(list("abcd"), x, codes, cuts, p.t.to_numpy(), p.inner.to_numpy(), w)


def plain(x, y, w, depth, leaf, split):
    """One tree without drawing: the cut with the least squared error among all of them, the first on ties."""
    value = (w * y).sum() / w.sum()
    best = (1e-12 * (w * y * y).sum(), None)
    sse = (w * (y - value) ** 2).sum()
    if depth and len(y) >= max(split, 2 * leaf) and sse > best[0]:
        for f in range(x.shape[1]):
            for cut in forests.cuts_of(x[:, f]):
                left = x[:, f] <= cut
                if leaf <= left.sum() <= len(y) - leaf:
                    parts = [(w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (left, ~left)]
                    if sse - sum(parts) > best[0] * (1 + 1e-9):
                        best = (sse - sum(parts), (f, cut, left))
    if best[1] is None:
        return lambda r: value
    f, cut, left = best[1]
    below, above = (plain(x[m], y[m], w[m], depth - 1, leaf, split) for m in (left, ~left))
    return lambda r: below(r) if r[f] <= cut else above(r)


@pytest.mark.parametrize("depth, leaf, split", [(0, 1, 2), (1, 1, 2), (3, 5, 2), (12, 2, 9), (30, 1, 2)])
def test_tree_equals_plain_recursion(depth, leaf, split):
    p = table(150)
    w = np.random.default_rng(3).integers(0, 3, 150).astype(float)
    s = sample(p, weights=w[:, None])
    params = {"trees": 1, "depth": depth, "leaf": leaf, "split": split, "subset": "all", "bootstrap": False}
    got = forests.joined(s.features, [forests.grow(s, forests.job_of(params, 1, weight=0), 0, 1)])
    kept = w > 0
    # cuts lie halfway between values of the whole table: rows agree, values in between need not
    tree = plain(s.x[kept], s.y[kept], w[kept], depth, leaf, split)
    mine = got.predict(s.x[kept])
    assert mine == pytest.approx([tree(r) for r in s.x[kept]], abs=1e-9)


def test_both_ways_to_find_cuts_agree():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n, nodes, bins = int(rng.integers(5, 200)), int(rng.integers(1, 6)), int(rng.integers(2, 30))
        key = rng.integers(0, nodes, n) * bins + rng.integers(0, bins, n)
        w, y, c = rng.integers(1, 4, n).astype(float), rng.normal(0, 1, n), np.ones(n)
        dense = forests._best_cuts(np.tile(key, 40), bins, nodes, np.tile(w, 40), np.tile(w * y, 40), np.tile(c, 40) / 40, 2)
        sparse = forests._best_cuts(key, 10**6 * 0 + bins, nodes, w, w * y, c, 2) if nodes * bins > 4 * n else None
        if sparse is not None:
            assert np.isneginf(dense[1]).tolist() == np.isneginf(sparse[1]).tolist()
            ok = np.isfinite(dense[1])
            assert dense[0][ok].tolist() == sparse[0][ok].tolist() and dense[1][ok] / 40 == pytest.approx(sparse[1][ok])


def test_trees_do_not_depend_on_their_neighbours(monkeypatch):
    s = sample(table(200))
    job = forests.job_of({"trees": 7, "depth": 6, "leaf": 2, "subset": "sqrt"}, 9)
    whole = forests.joined(s.features, [forests.grow(s, job, 0, 7)])
    parts = forests.joined(s.features, [forests.grow(s, job, a, z) for a, z in ((0, 1), (1, 5), (5, 7))])
    assert (whole.predict_trees(s.x) == parts.predict_trees(s.x)).all()
    assert len({tuple(whole.predict_trees(s.x)[:, t]) for t in range(7)}) == 7


def test_forest_learns_and_leaves_folds_out(spark):
    p = table(400)
    d = spark.createDataFrame(p)
    model = learn.forest(list("abcd"), "t", {"trees": 30, "depth": 10, "leaf": 2, "subset": "all"}).fit(d)
    got = model.transform(d).toPandas()
    assert ((got.prediction - got.t) ** 2).mean() < 0.2 * got.t.var()
    importance = dict(zip("abcd", model.importances()))
    assert sum(importance.values()) == pytest.approx(1) and importance["a"] > importance["b"] > importance["d"]
    s = forests.held_sample(d, ["id"], list("abcd"), "t", "inner")
    job = forests.job_of({"trees": 25, "depth": 8, "leaf": 3, "subset": "log2"}, 4, left_out=2)
    grown = forests.joined(s.features, [forests.grow(s, job, 0, 25)])
    held = s.inner == 2
    want = math.sqrt(((grown.predict(s.x[held]) - s.y[held]) ** 2).mean())
    assert forests.left_out_errors(spark, [s], [job, job]) == pytest.approx([want, want])
    again = forests.held_sample(d.repartition(7), ["id"], list("abcd"), "t", "inner")
    assert (again.x == s.x).all() and (again.y == s.y).all()


def test_large_tables_go_through_spark(spark, monkeypatch):
    p = table(400)
    d = spark.createDataFrame(p)
    params = [{"trees": 8, "depth": 6, "leaf": 2, "subset": "all"}, {"trees": 8, "depth": 1, "leaf": 2, "subset": "all"}]
    small = learn.tune_forest(d, list("abcd"), "t", "inner", 4, params)
    monkeypatch.setattr(forests, "MOST_CELLS", 100)
    large = learn.tune_forest(d, list("abcd"), "t", "inner", 4, params)
    assert small[1] == large[1] == params[0] and large[3] == pytest.approx(small[3], rel=0.3)
    got = large[0].transform(d).toPandas()
    assert ((got.prediction - got.t) ** 2).mean() < 0.3 * got.t.var()
    assert large[0].importances().argmax() == 0
    models = learn.bootstrap_models(d, ["id"], list("abcd"), "t", params[0], 2, 5)
    assert learn.ensemble_predict(d, models).where("sd > 0").count() > 100


def test_missing_columns_of_a_forest_and_empty_rows(spark):
    d = spark.createDataFrame(table(50))
    model = learn.forest(["a"], "t", {"trees": 2, "depth": 2, "leaf": 1, "subset": "all"}).fit(d)
    assert model.transform(d.limit(0)).count() == 0
    assert model.transform(d.withColumn("t", F.lit("text")), "out").columns[-1] == "out"


# ------------------------------------------------------------------- search


def bowl(s):
    """A fixed function of forest settings with one best corner."""
    return ((s["trees"] - 320) / 500) ** 2 + ((s["depth"] - 22) / 25) ** 2 + ((s["leaf"] - 2) / 7) ** 2 + ((s["split"] - 4) / 13) ** 2 + 0.2 * (s["subset"] != "log2")


def run(seed, trials=50, batch=5):
    study = Search(FOREST_SPACE, seed)
    for _ in range(trials // batch):
        asked = study.ask(batch)
        study.tell(asked, [bowl(s) for s in asked])
    return study


def test_same_seed_same_trials():
    assert run(3).past == run(3).past and run(3).past != run(4).past
    for s, _ in run(5).past:
        for name, rule in FOREST_SPACE.items():
            assert rule[0] <= s[name] <= rule[1] if isinstance(rule, tuple) else s[name] in rule


def test_search_beats_random_draws():
    def at_random(seed):
        rng = random.Random(seed)
        draws = [{n: rng.randint(*r) if isinstance(r, tuple) else rng.choice(r) for n, r in FOREST_SPACE.items()} for _ in range(50)]
        return min(bowl(s) for s in draws)

    found, drawn = [run(seed).best()[1] for seed in range(20)], [at_random(seed) for seed in range(20)]
    assert np.mean(found) < 0.7 * np.mean(drawn) and sum(f < d for f, d in zip(found, drawn)) >= 14


def test_failed_trials_are_never_best():
    study = Search(FOREST_SPACE, 1)
    asked = study.ask(3)
    study.tell(asked, [math.nan, 2.0, 1.0])
    assert study.best() == (asked[2], 1.0)


def test_budget_tries_all_trials_on_every_table(spark):
    p = table(120)
    d = spark.createDataFrame(p)
    budget = learn.Budget(14, 7, 5, {**FOREST_SPACE, "trees": (2, 6), "depth": (1, 6)})
    one, two = learn.tune_tables([(d, list("abcd")), (d, ["d"])], ["id"], "t", "inner", 4, budget)
    for _, best, tried, scores in (one, two):
        assert len(tried) == len(scores) == 14 and best == tried[int(np.argmin(scores))]
    assert min(one[3]) < min(two[3])
    again = learn.tune_forest(d.repartition(5), list("abcd"), "t", "inner", 4, budget)
    assert again[2] == one[2] and again[3] == pytest.approx(one[3])


def test_exclusive_columns_are_one_category():
    """Columns of one category are cut from one pass over the rows, with the sums each would get by itself (ml_16_tuning, ml_18_final_model, src_12_model_bundle)."""
    rng = np.random.default_rng(8)
    n, level = 3000, rng.integers(0, 6, 3000)
    codes = np.c_[rng.integers(0, 9, n), level == 1, level == 2, rng.integers(0, 2, n), level == 4].astype(np.uint8)
    found, own = forests.exclusive(codes, [9, 2, 2, 2, 2])
    assert found == [1, 2, 4] and (own == np.select([level == 1, level == 2, level == 4], [1, 2, 3])).all()
    w = rng.integers(1, 4, n).astype(float)
    y, node = rng.normal(0, 1, n), rng.integers(0, 40, n)
    totals = [np.bincount(node, v, 40) for v in (w, w * y, w)]
    scores = forests._level_scores(node * 4 + own, 4, w, w * y, w, totals, 5)
    for i, f in enumerate(found):
        _best, want = forests._best_cuts(node * 2 + codes[:, f], 2, 40, w, w * y, w, 5)
        assert (np.isfinite(want) == np.isfinite(scores[:, i])).all() and np.isfinite(want).any()
        assert scores[np.isfinite(want), i] == pytest.approx(want[np.isfinite(want)], rel=1e-12)


def test_trees_grow_in_pieces(spark, monkeypatch):
    """Few trees at a time where a table is long give the same forests and errors; a table of 8 million cells is held (6 GB)."""
    rng = np.random.default_rng(9)
    x = np.c_[rng.normal(0, 1, (400, 2)), rng.integers(0, 2, 400)]
    cuts = [forests.cuts_of(x[:, f]) for f in range(3)]
    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    s = forests.Sample(["a", "b", "c"], x, codes, cuts, x[:, 0] + rng.normal(0, 1, 400), rng.integers(1, 3, 400), np.zeros((400, 0)))
    job = forests.job_of({"trees": 7, "depth": 6, "leaf": 2, "subset": "sqrt"}, 4, left_out=1)
    whole, = forests.fit_many(spark, [s], [job])
    error, = forests.left_out_errors(spark, [s], [job])
    monkeypatch.setattr(forests, "MOST_ROWS", 800)
    assert [len(f.roots) for f in forests.grow_in_pieces(s, job, 0, 7)] == [2, 2, 2, 1]
    pieces, = forests.fit_many(spark, [s], [job])
    assert all(np.array_equal(getattr(whole, c), getattr(pieces, c)) for c in forests.Forest._fields[1:])
    assert forests.left_out_errors(spark, [s], [job]) == pytest.approx([error], rel=1e-12)
    assert forests.MOST_CELLS >= 615_384 * 13


def test_nodes_of_an_ensemble_stay_with_their_tasks(spark, monkeypatch):
    """Members are grown and asked by the same tasks, or read one by one: the driver never has the nodes of all (ml_19_bootstrap_ensemble, 1 GB)."""
    p = table(300)
    d = spark.createDataFrame(p).repartition(3)
    params = {"trees": 12, "depth": 8, "leaf": 1, "subset": "all"}
    monkeypatch.setattr(learn, "fit_many", None)  # its nodes come to the driver
    models = learn.bootstrap_models(d, ["id"], list("abcd"), "t", params, 5, 3)
    near = learn.ensemble_predict(d, models).toPandas().set_index("id").sort_index()
    weights = np.stack([m.shared.value[0][0].weights for m in models[:1]])[0]
    s = sample(p, weights=weights.astype(float))
    each = np.stack([forests.joined(s.features, [forests.grow(s, m.jobs[m.number], 0, 12)]).predict(s.x) for m in models])
    assert near["mean"].to_numpy() == pytest.approx(each.mean(0)) and near["sd"].to_numpy() == pytest.approx(each.std(0, ddof=1))
    assert near.columns.tolist() == [*d.drop("id").columns, "mean", "sd"]
    monkeypatch.setattr(forests, "CHUNK", 64)
    twice = d.union(d).withColumn("id", F.lit(None).cast("long"))  # keys that are no keys
    got = learn.ensemble_predict(twice, models).toPandas()
    assert sorted(got["mean"].round(9)) == sorted([*near["mean"].round(9)] * 2)
    monkeypatch.setattr(forests, "MOST_CELLS", 100)  # rows that no task could hold
    far = learn.ensemble_predict(d, models).toPandas().set_index("id").sort_index()
    assert far["mean"].to_numpy() == pytest.approx(near["mean"].to_numpy()) and far["sd"].to_numpy() == pytest.approx(near["sd"].to_numpy())
    kept = learn.bootstrap_models(d, ["id"], list("abcd"), "t", params, 2, 5)
    assert all(isinstance(m, forests.Kept) for m in kept) and kept[0].read().predict(s.x).std() > 0.5


def test_trials_share_their_trees(spark, monkeypatch):
    """Trials that differ in depth, split size or number of trees have trees in common: they grow once, with the errors each trial has alone
    (ml_17_nested_cv, ml_17_nested_cv_summary, spa_09_rk_nested_cv, spa_11_rk_point_map, 6 GB)."""
    s = sample(table(500))._replace(weights=np.zeros((500, 0)))
    kinds = [(5, 6, 2, "all", 2), (9, 4, 7, "all", 2), (3, 12, 25, "all", 2), (4, 12, 25, "all", 1), (6, 3, 4, "sqrt", 3), (4, 9, 4, "log2", 3), (4, 9, 12, "log2", 3), (2, 0, 2, "all", 2)]
    jobs = [forests.job_of({"trees": t, "depth": d, "split": sp, "leaf": leaf, "subset": sub}, 42, left_out=f) for t, d, sp, sub, leaf in kinds for f in (1, 3)]
    alike = forests._alike([s], jobs)
    assert len(alike) == 2 * 4 and sum(whole.trees for whole, _ in alike) == 2 * (9 + 4 + 6 + 4)  # of 37 for each fold
    want = []
    for job in jobs:
        held = s.inner == job.left_out
        alone = forests.joined(s.features, [forests.grow(s, job, 0, job.trees)])
        want.append(math.sqrt(((alone.predict(s.x[held]) - s.y[held]) ** 2).mean()))
    grown = spark.sparkContext.accumulator(0)
    plain = forests.grow
    monkeypatch.setattr(forests, "grow", lambda *args, **more: grown.add(args[3] - args[2]) or plain(*args, **more))
    assert forests.left_out_errors(spark, [s], jobs) == pytest.approx(want, rel=1e-12)
    assert grown.value == 2 * (9 + 4 + 6 + 4)


def test_nodes_of_nested_validation_stay_with_their_tasks(spark, monkeypatch):
    """Models that only predict never come to the driver (ml_17_nested_cv, spa_09_rk_nested_cv, spa_11_rk_point_map, 6 GB)."""
    p = table(160)
    d, params = spark.createDataFrame(p), {"trees": 4, "depth": 5, "leaf": 2, "subset": "all"}
    plain, = learn.tune_tables([(d, list("abcd"))], ["id"], "t", "inner", 4, [params])
    monkeypatch.setattr(learn, "fit_many", None)
    apart, = learn.tune_tables([(d, list("abcd"))], ["id"], "t", "inner", 4, [params], apart=True)
    want, got = (m.transform(d).toPandas().set_index("id").prediction.sort_index() for m in (plain[0], apart[0]))
    assert got.to_numpy() == pytest.approx(want.to_numpy()) and got.std() > 0.5
    pred, _best = learn.nested_cv(d, ["id"], "t", list("abcd"), [], [params], outer=3, inner=2)
    assert pred.count() == 160 and pred.where("pred is null").count() == 0
