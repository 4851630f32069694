"""Work per row of searches, variograms and kriging stays small, with the results of plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrastat import session
from terrastat.operators import blocks, forests, kriging, learn, neighbours, prep, shapley, spatial, summary
from terrastat.plans import data, learning_q, mixed_q, registry


@pytest.mark.parametrize("k", [1, 8, 32])
@pytest.mark.parametrize("far", [0.0, 3.0, 400.0])
def test_queries_far_from_all_samples_meet_few_of_them(monkeypatch, k, far):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 0.12, (2, 4000))
    x[:40], y[:40] = 0.1, 0.45  # ties at the edge
    v, sid = rng.normal(size=4000), rng.permutation(4000)
    frame = neighbours._frame(x.min(), x.max(), y.min(), y.max())
    held = neighbours.Held.of(frame, sid, x, y, v)
    qx, qy = -0.5 + np.tile(np.arange(50) * 0.02, 5), far + 0.025 * np.repeat(np.arange(5), 50)
    met = []
    lowest = neighbours._lowest
    monkeypatch.setattr(neighbours, "_lowest", lambda d, n: met.append(d.size) or lowest(d, n))
    got, dist, *_ = held.nearest(qx, qy, k)
    apart = np.sqrt((qx[:, None] - x) ** 2 + (qy[:, None] - y) ** 2)
    order = np.lexsort((np.broadcast_to(sid, apart.shape), apart))[:, :k]
    assert (got == sid[order]).all() and (dist == np.take_along_axis(apart, order, axis=1)).all()
    if far:
        assert sum(met) <= 250 * (100 + 4 * k)  # it was up to all 4,000 for each


def test_lags_of_all_choices_come_from_one_pass():
    rng = np.random.default_rng(4)
    d = np.r_[rng.random(20000) * 0.5, 0.3 * np.arange(21) / 20, 0.3 * np.arange(14) / 13, 0.3, np.nextafter(0.3, 1), np.inf]
    n, s = rng.integers(1, 4, len(d)).astype(float), rng.random(len(d))
    bins = spatial.LagBins.of(range(6, 21), 0.3)
    for count in (None, n):
        got = bins.sums(d, count, s)
        ok = d <= 0.3
        c = np.ones(ok.sum()) if count is None else n[ok]
        for m in range(6, 21):
            lag = np.minimum((d[ok] / (0.3 / m)).astype(int), m - 1)
            mine = got[:, bins.n_lags == m]
            assert (mine[0] == np.bincount(lag, c, m)).all()
            assert mine[1] == pytest.approx(np.bincount(lag, c * d[ok], m)) and mine[2] == pytest.approx(np.bincount(lag, s[ok], m))


def test_search_reads_each_neighbourhood_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"sid": np.arange(120), "x": rng.random(120), "y": rng.random(120)})
    p["v"] = np.sin(6 * p.x) + rng.normal(0, 0.1, 120)
    p["inner"] = p.sid % 3 + 1
    d = spark.createDataFrame(p)
    args = (d, 0.4, spatial.variogram_candidates(0.4, 8), [6, 9], [True, False], 6, 3)
    keys = ["model", "n_lags", "weighted"]
    monkeypatch.setattr(kriging, "SHARED", 1)  # more variograms than tasks may hold: a row per neighbourhood and variogram
    joined = kriging.search_variogram(*args).toPandas().sort_values(keys)
    monkeypatch.setattr(kriging, "SHARED", 20_000)
    monkeypatch.setattr(kriging, "krige_neighbours", None)
    shared = kriging.search_variogram(*args).toPandas().sort_values(keys)
    assert len(shared) == 20 and (shared.n_folds == 3).all()
    assert shared[keys].to_numpy().tolist() == joined[keys].to_numpy().tolist()
    assert shared.rmse.to_numpy() == pytest.approx(joined.rmse.to_numpy(), rel=1e-9)


def test_attribution_plays_each_pattern_once(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 5)), 1)
    y = x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(0, 0.1, 600)
    cuts = [forests.cuts_of(x[:, f]) for f in range(5)]
    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    s = forests.Sample(list("abcde"), x, codes, cuts, y, np.zeros(600, int), np.zeros((600, 0)))
    model = forests.joined(s.features, [forests.grow(s, forests.job_of({"trees": 3, "depth": 9, "leaf": 2, "subset": "all"}, 1), 0, 3)])
    found, pairs = shapley.leaves(model), [(0, 1), (2, 4)]
    x[0, 0] = np.nan  # goes right everywhere
    played = []
    plain = shapley.Leaves.factors
    monkeypatch.setattr(shapley.Leaves, "factors", lambda self, met, t: played.append(met.shape[0]) or plain(self, met, t))
    phi, both = shapley.values(found, x), shapley.pair_values(found, x, pairs)
    assert max(played) <= 2**5  # patterns, not rows
    assert phi.sum(axis=1)[1:] == pytest.approx((model.predict(x) - shapley.expected(found))[1:])
    monkeypatch.setattr(shapley, "MOST_PLACES", 0)
    assert shapley.values(found, x) == pytest.approx(phi) and shapley.pair_values(found, x, pairs) == pytest.approx(both)


def test_one_forest_is_grown_by_all_tasks(spark, monkeypatch):
    p = pd.DataFrame({"a": np.arange(60.0), "t": np.arange(60.0) % 7})
    d, seen = spark.createDataFrame(p), []
    plain = forests._units
    monkeypatch.setattr(forests, "_units", lambda *args: seen.append(plain(*args)) or seen[-1])
    s = forests.held_sample(d, ["a"], ["a"], "t")
    job = forests.job_of({"trees": 40, "depth": 4, "leaf": 1, "subset": "all"}, 2)
    model = forests.fit_many(spark, [s], [job])[0]
    assert seen[0].count() >= 2 * spark.sparkContext.defaultParallelism  # it was 2: blocks of 20 trees
    whole = forests.joined(s.features, [forests.grow(s, job, 0, 40)])
    assert (model.predict_trees(s.x) == whole.predict_trees(s.x)).all()
    missing = np.array([[np.nan], [3.0]])
    assert model.predict_trees(missing).shape == (2, 40)


def test_pairs_are_met_once_for_all_folds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n = 700
    p = pd.DataFrame({"g": np.arange(n) % 2, "x": np.r_[rng.normal(0.2, 0.05, 500), rng.random(200)].round(3), "y": rng.normal(0.1, 0.1, n).round(3)})
    p["v"] = np.sin(6 * p.x) + rng.normal(0, 0.1, n)
    p["inner"] = rng.integers(1, 5, n)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)  # crowded cells: blocks of one fold inside parts of a cell
    d = spark.createDataFrame(p)
    sums = spatial.pair_sums(d, [5, 9], 0.4, ["g"], "inner").persist()
    total = 0
    for g, own in p.groupby("g"):
        dist = np.sqrt(np.subtract.outer(own.x.values, own.x.values) ** 2 + np.subtract.outer(own.y.values, own.y.values) ** 2)
        total += int(np.count_nonzero(np.triu(dist <= 0.4, 1)))
    assert sums.filter("n_lags = 5").agg({"n": "sum"}).first()[0] == total
    keys = ["g", "fold", "n_lags", "lag"]
    got = spatial.left_out_lag_means(sums, 4, ["g"]).toPandas().sort_values(keys)
    parts = [spatial.semivariogram(d.filter(F.col("inner") != f), [5, 9], 0.4, ["g"]).withColumn("fold", F.lit(f)).toPandas() for f in range(1, 5)]
    want = pd.concat(parts).sort_values(keys)
    assert (got[[*keys, "n"]].values == want[[*keys, "n"]].values).all()
    assert np.allclose(got[["h", "gamma"]].values, want[["h", "gamma"]].values, rtol=1e-10)
    whole = spatial.lag_means(sums, ["g"]).toPandas().sort_values(["g", "n_lags", "lag"])
    plain = spatial.semivariogram(d, [5, 9], 0.4, ["g"]).toPandas().sort_values(["g", "n_lags", "lag"])
    assert (whole.n.values == plain.n.values).all() and np.allclose(whole.gamma.values, plain.gamma.values, rtol=1e-10)
    sums.unpersist()


def test_samples_are_dealt_out_once_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    d = spark.range(6000).select((F.col("id") % 1500).alias("k"), (F.col("id") % 4).alias("depth"), F.rand(1).alias("v"))
    dealt = session.keyed(d, "k")
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == 30 and max(sizes) < 600
    grouped = dealt.groupBy("k", "depth").agg(F.avg("v").alias("v"))
    wide = prep.depth_wide(grouped, "k", "depth", [0, 1, 2, 3], "v", "d")
    assert wide.count() == 1500
    assert wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    plots = data.samples(t).groupBy("site", "lc", "depth", "plot").count()
    assert plots._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2  # rows and plots


def test_rows_of_many_measures_are_computed_once(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"site": rng.choice(["a", "b"], 400), "lc": rng.choice(["u", "v", "w"], 400), "depth": rng.integers(1, 4, 400), "y": rng.normal(size=400)})
    p["fixed"], p["fitted"] = p.y * 0.5, p.y * 0.9 + rng.normal(0, 0.1, 400)
    base, seen = spark.createDataFrame(p), spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    counted = base.mapInPandas(count, base.schema)
    measures = [lambda d: summary.axis_limits(d, "y", [["site"], ["lc"], ["site", "lc"]]), mixed_q.performance, mixed_q.diagnostics]
    for measure in measures:
        before = seen.value
        got = sorted(map(str, measure(counted).collect()))
        assert seen.value - before == 400
        assert got == sorted(map(str, measure(base).collect()))


def test_neighbouring_leaves_are_summed_once_per_cell(monkeypatch):
    """Rows of one cell of a group's cuts share its sum (ml_22_importance_validation, ml_23_dependence_rows, 6 GB)."""
    rng = np.random.default_rng(12)
    level = rng.integers(0, 4, 3000)
    x = np.c_[rng.normal(0, 1, (3000, 2)).round(1), *[(level == i).astype(float) for i in (1, 2, 3)]]
    cuts = [forests.cuts_of(x[:, f]) for f in range(5)]
    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    s = forests.Sample(list("abcde"), x, codes, cuts, x[:, 0] * x[:, 1] + level + rng.normal(0, 0.1, 3000), np.zeros(3000, int), np.zeros((3000, 0)))
    model = forests.joined(s.features, [forests.grow(s, forests.job_of({"trees": 3, "depth": 8, "leaf": 20, "subset": "all"}, 2), 0, 3)])
    rows = np.r_[x, [[np.nan, 0.3, 0.0, 1.0, 1.0]]]  # a missing value, and two levels at once
    seen = []
    plain = shapley._by_cells
    monkeypatch.setattr(shapley, "_by_cells", lambda g, edges, digits, cells, *more: seen.append(cells * len(g.value)) or plain(g, edges, digits, cells, *more))
    found, pairs = shapley.leaves(model), [(0, 1), (1, 3)]
    together = shapley.values(found, rows), shapley.pair_values(found, rows, pairs)
    assert sum(seen) < 0.5 * 2 * len(rows) * sum(len(g.value) for g in found)  # not every row with every leaf
    monkeypatch.setattr(shapley, "MOST_CELLS", 1)
    alone = shapley.leaves(model)
    assert max(g.group.max() for g in alone) > max(g.group.max() for g in found)
    assert shapley.values(alone, rows) == pytest.approx(together[0], abs=1e-12) and shapley.pair_values(alone, rows, pairs) == pytest.approx(together[1], abs=1e-12)
    assert together[0].sum(axis=1)[:-1] == pytest.approx((model.predict(rows) - shapley.expected(found))[:-1])


def test_attributions_are_computed_once(spark, tmp_path, monkeypatch):
    """Ranks and dependence read the attributions several times (ml_22_importance_validation, ml_23_dependence_rows, 6 GB)."""
    rng = np.random.default_rng(13)
    p = pd.DataFrame({"vec_id": np.arange(90), "label": np.arange(90) % 3, "embedding": rng.normal(0, 0.2, (90, 8)).tolist()})
    spark.createDataFrame(p).repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(learning_q, "FOREST", {"trees": 2, "depth": 3, "leaf": 2, "subset": "all"})
    seen = spark.sparkContext.accumulator(0)
    plain = shapley.attribution

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(shapley, "attribution", lambda *args: (phi := plain(*args)).mapInArrow(count, phi.schema))
    rho = registry.QUERIES["ml_22_importance_validation"](spark, str(tmp_path)).collect()
    assert len(rho) == 1 and rho[0]["n"] == 6 and seen.value == 90 * 6
    assert registry.QUERIES["ml_23_dependence_rows"](spark, str(tmp_path)).count() == 3 * 90 and seen.value == 2 * 90 * 6
