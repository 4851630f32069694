"""Components, screening, preparation, forests and attribution."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrastat.operators import index, learn, screen, shapley
from terrastat.operators import summary as s

# Published correlations (n = 1523) of six indicators, their
# eigenvalues, variable coordinates and weights.
NAMES = ["pH", "CEC", "clay", "K", "P", "C"]
R = {
    ("pH", "CEC"): 0.09185729779296176,
    ("pH", "clay"): 0.14242875741250263,
    ("pH", "K"): 0.08591363693040739,
    ("pH", "P"): -0.22525268104769033,
    ("pH", "C"): -0.31782910698493766,
    ("CEC", "clay"): 0.5793313725229384,
    ("CEC", "K"): 0.2733888726366658,
    ("CEC", "P"): 0.03991947210408468,
    ("CEC", "C"): 0.2839857167976758,
    ("clay", "K"): 0.20770798474454064,
    ("clay", "P"): -0.1994514825952583,
    ("clay", "C"): 0.08883244907349426,
    ("K", "P"): 0.09007068963526023,
    ("K", "C"): 0.3607527549800383,
    ("P", "C"): 0.38810722260492075,
}
EIGEN = [1.9386255190533572, 1.6540895037146492, 0.892734510029053, 0.7205227146897457, 0.4322649416958408, 0.36570499215769453]
CUMULATIVE = [32.289210330479435, 59.83926750550348, 74.70840653225133, 86.70923353769884, 93.90891882179896, 100.0]
COORD1 = [-0.055504635246942526, 0.7843256748916676, 0.6289089511254407, 0.6443428714670869, 0.25148231298683715, 0.6681544968522098]
COORD2 = [-0.6731357226599184, -0.3024423551488765, -0.5548010157983878, 0.008119232932819036, 0.7091424129297029, 0.5465833637384672]
CONTRIBUTION1 = [0.1589148860167945, 31.73210907667507, 20.40241732703693]
WEIGHTS = [0.14707274019536193, 0.20084494088221855, 0.1610468522868817, 0.16499906871665368, 0.15493980537267438, 0.17109659254620968]


@pytest.fixture(scope="module")
def published():
    r = np.eye(6)
    for (a, b), v in R.items():
        i, j = NAMES.index(a), NAMES.index(b)
        r[i, j] = r[j, i] = v
    return index.components(r, 1523)


def test_published_eigenvalues(spark, published):
    rows = index.eigen_table(spark, published[0]).orderBy("dim").collect()
    assert [r["eigenvalue"] for r in rows] == pytest.approx(EIGEN, abs=1e-11)
    assert [r["cumulative"] for r in rows] == pytest.approx(CUMULATIVE, abs=1e-9)


def test_published_coordinates_contributions_and_weights(spark, published):
    coords = index.coordinate_table(spark, NAMES, *published)
    got = {(r["variable"], r["dim"]): r["coord"] for r in coords.collect()}
    assert [got[(v, 1)] for v in NAMES] == pytest.approx(COORD1, abs=1e-10)
    assert np.abs([got[(v, 2)] for v in NAMES]) == pytest.approx(np.abs(COORD2), abs=1e-10)
    con = {(r["variable"], r["dim"]): r["contribution"] for r in index.contributions(coords).collect()}
    assert [con[(v, 1)] for v in NAMES[:3]] == pytest.approx(CONTRIBUTION1, abs=1e-8)
    w = {r["variable"]: r["weight"] for r in index.indicator_weights(coords, index.eigen_table(spark, published[0])).collect()}
    assert [w[v] for v in NAMES] == pytest.approx(WEIGHTS, abs=1e-11)


def test_published_strong_pairs(spark):
    pairs = [("N", "C", 0.9472803484549737), ("clay", "sand", -0.936251595489459), ("silt", "sand", -0.8506090872244346), ("clay", "silt", 0.6116551531065099), ("N", "sand", 0.02147333657811536)]
    d = s.pearson_p(spark.createDataFrame([(a, b, r, 1523) for a, b, r in pairs], "var1 string, var2 string, r double, n long"))
    assert s.significant_pairs(d).count() == 4
    assert {r["var1"] + r["var2"] for r in s.strong_pairs(d).collect()} == {"NC", "claysand", "siltsand"}


def test_no_component_above_the_threshold(spark):
    with pytest.raises(ValueError):
        index.retained(index.eigen_table(spark, np.array([0.9, 0.8])))


def collinear(n=400):
    rng = np.random.default_rng(4)
    p = pd.DataFrame(rng.normal(0, 1, (n, 3)), columns=list("abc"))
    p["d"] = p.a + p.b + rng.normal(0, 0.05, n)
    p["e"] = p.c * 2
    return p


def test_vif_equals_regression(spark):
    p = collinear()[list("abcd")]
    got = {r["predictor"]: r["vif"] for r in screen.vif(spark.createDataFrame(p), list("abcd")).collect()}
    for c in p.columns:
        x = np.column_stack([np.ones(len(p)), p.drop(columns=c)])
        e = p[c] - x @ np.linalg.lstsq(x, p[c], rcond=None)[0]
        assert got[c] == pytest.approx(p[c].var(ddof=0) / e.var(ddof=0), rel=1e-6)


def test_exact_dependence_is_infinite(spark):
    rows = screen.vif(spark.createDataFrame(collinear()), list("abcde")).collect()
    got = {r["predictor"]: (r["vif"], r["band"]) for r in rows}
    assert got["c"] == (np.inf, "perfect") and got["e"] == (np.inf, "perfect")


def test_elimination_keeps_priorities_and_logs_steps(spark):
    p = collinear()
    d = spark.createDataFrame(p)
    d = d.withColumn("a", F.when(F.rand(1) > 0.05, F.col("a")))
    kept, log = screen.eliminate(d, list("abcde"), priority=["d", "e"])
    names = [r["predictor"] for r in kept.collect()]
    assert {"d", "e"} <= set(names) and "c" not in names
    steps = log.orderBy("step").collect()
    assert [r["step"] for r in steps] == list(range(len(steps))) and not {r["dropped"] for r in steps} & {"d", "e"}
    free, _ = screen.eliminate(d, list("abcde"))
    assert all(r["vif"] < 10 for r in free.collect())


# ------------------------------------------------------------------ training


def rows(spark, n=200):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"id": np.arange(n), "f1": rng.normal(0, 1, n), "f2": rng.normal(0, 1, n), "soil": rng.choice(list("xyz"), n)})
    p["t"] = 2 * p.f1 - p.f2 + (p.soil == "y") + rng.normal(0, 0.1, n)
    return spark.createDataFrame(p)


def test_statistics_come_from_training_rows_only(spark):
    d = spark.createDataFrame([(1, 1, 10.0, "a"), (2, 1, None, "a"), (3, 2, 1.0, "b"), (4, 2, 3.0, "c"), (5, 3, None, "b")], "id int, fold int, v double, c string")
    med = {r["train_fold"]: r["median"] for r in learn.training_medians(d, ["v"], "fold", 3).collect()}
    assert med == {1: 2.0, 2: 10.0, 3: 3.0}
    mode = {r["train_fold"]: r["mode"] for r in learn.training_modes(d, ["c"], "fold", 3).collect()}
    assert mode == {1: "b", 2: "a", 3: "a"}
    lev = {(r["train_fold"], r["level"]): r["position"] for r in learn.training_levels(d, ["c"], "fold", 3).collect()}
    assert (1, "a") not in lev and lev[(1, "b")] == 0


def test_empty_column_is_filled_with_zero(spark):
    d = spark.createDataFrame([(1, None, "a")], "id int, v double, c string")
    out, names = learn.apply_statistics(d, learn.fit_statistics(d, ["v"], ["c"]), ["v"], ["c"])
    assert names == ["v"] and out.first()["v"] == 0.0


def test_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "c string").withColumn("v", F.lit(1.0))
    stats = learn.fit_statistics(train, ["v"], ["c"])
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "c string").withColumn("v", F.lit(None).cast("double"))
    out, names = learn.apply_statistics(new, stats, ["v"], ["c"])
    assert names == ["v", "c_b", "c_c"]
    assert [tuple(r) for r in out.select(*names).collect()] == [(1.0, 1.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]


SMALL = {"trees": 5, "depth": 4, "leaf": 1, "subset": "all"}


def test_nested_cv_predicts_every_row_once(spark):
    d = rows(spark, 90)
    pred, best = learn.nested_cv(d, ["id"], "t", ["f1", "f2"], ["soil"], [SMALL, {**SMALL, "depth": 1}], outer=3, inner=2)
    p = pred.toPandas()
    assert sorted(p.id) == list(range(90)) and p.fold.nunique() == 3
    assert best.count() == 3 and {r["depth"] for r in best.collect()} == {4}


def test_ensemble_mean_and_sd(spark):
    d = rows(spark, 80)
    models = learn.bootstrap_models(d, ["id"], ["f1", "f2"], "t", SMALL, 3, 5)
    got = learn.ensemble_predict(d, models).toPandas().set_index("id")
    each = np.stack([m.transform(d).toPandas().set_index("id").prediction.loc[got.index].to_numpy() for m in models])
    assert got["mean"].to_numpy() == pytest.approx(each.mean(0)) and got["sd"].to_numpy() == pytest.approx(each.std(0, ddof=1))


def by_definition(nodes, x, pairs):
    """Shapley values and pair interactions of one tree from all coalitions; ``nodes``: id -> (feature, cut, left, right, weight, prediction)."""
    k = len(x)

    def game(own, n=0):
        f, cut, left, right, weight, pred = nodes[n]
        if left < 0:
            return pred
        if f in own:
            return game(own, left if x[f] <= cut else right)
        return sum(nodes[c][4] / weight * game(own, c) for c in (left, right))

    def mean(rest, gain, scale):
        return sum(
            math.factorial(len(s)) * math.factorial(len(rest) - len(s)) / scale * gain(set(s)) for n in range(len(rest) + 1) for s in itertools.combinations(rest, n)
        )

    phi = [mean([j for j in range(k) if j != i], lambda s, i=i: game(s | {i}) - game(s), math.factorial(k)) for i in range(k)]
    both = [
        mean([f for f in range(k) if f not in (i, j)], lambda s, i=i, j=j: game(s | {i, j}) - game(s | {i}) - game(s | {j}) + game(s), 2 * math.factorial(k - 1))
        for i, j in pairs
    ]
    return np.array(phi), np.array(both)


def test_attributions_and_interactions_follow_their_definition(spark, tmp_path):
    rng = np.random.default_rng(8)
    names, pairs = ["f1", "f2", "f3", "f4"], [(0, 1), (0, 2), (1, 3)]
    p = pd.DataFrame(np.round(rng.normal(0, 1, (150, 4)), 1), columns=names).assign(id=np.arange(150))
    p["t"] = p.f1 * p.f2 + 2 * p.f3 - p.f4 * p.f1
    d = spark.createDataFrame(p)
    model = learn.forest(names, "t", {"trees": 3, "depth": 4, "leaf": 1, "subset": "all"}).fit(d)
    model.save(spark, str(tmp_path / "m"))
    nodes = spark.read.parquet(str(tmp_path / "m" / "nodes")).orderBy("node").collect()
    trees = {}
    for r in nodes:
        first = min(n["node"] for n in nodes if n["tree"] == r["tree"])
        child = [r[c] - first if r["feature"] >= 0 else -1 for c in ("left", "right")]
        trees.setdefault(r["tree"], {})[r["node"] - first] = (r["feature"], r["cut"], *child, r["weight"], r["value"])
    want = [[by_definition(t, x, pairs) for t in trees.values()] for x in p[names].to_numpy()[:25]]
    phi = np.array([np.mean([w[0] for w in row], axis=0) for row in want])
    both = np.array([np.mean([w[1] for w in row], axis=0) for row in want])
    found = shapley.leaves(model)
    assert shapley.values(found, p[names].to_numpy()[:25]) == pytest.approx(phi, abs=1e-10)
    assert shapley.pair_values(found, p[names].to_numpy()[:25], pairs) == pytest.approx(both, abs=1e-10)
    got = shapley.attribution(model, d, names)
    total = got.groupBy("id").agg(F.sum("phi").alias("s")).toPandas().set_index("id").s.sort_index()
    f = model.transform(d).toPandas().set_index("id").prediction.sort_index()
    assert total.to_numpy() == pytest.approx(f.to_numpy() - shapley.expected(found), abs=1e-9)
    assert {(r["id"], r["feature"]): r["value"] for r in got.collect()}[(7, "f3")] == p.f3[7]
    strength = {(r["a"], r["b"]): r["strength"] for r in shapley.interactions(model, d, names, names).collect()}
    mean = np.abs(shapley.pair_values(found, p[names].to_numpy(), pairs)).mean(axis=0)
    assert len(strength) == 6 and [strength[names[i], names[j]] for i, j in pairs] == pytest.approx(list(mean))
    assert learn.mean_abs_attribution(got).count() == 4


def test_interactions_of_an_additive_model_are_small(spark):
    d = rows(spark, 120).withColumn("t", F.col("f1") * F.col("f2") * 3)
    names = ["f1", "f2", "f3"]
    d = d.withColumn("f3", F.rand(2))
    model = learn.forest(names, "t", {**SMALL, "trees": 20, "depth": 6}).fit(d)
    got = {(r["a"], r["b"]): r["strength"] for r in shapley.interactions(model, d, names, names).collect()}
    assert got[("f1", "f2")] > 3 * max(got[("f1", "f3")], got[("f2", "f3")])


def test_attribution_of_a_single_leaf_is_zero(spark):
    d = rows(spark, 20)
    model = learn.forest(["f1", "f2"], "t", {**SMALL, "depth": 0}).fit(d)
    assert {r["phi"] for r in shapley.attribution(model, d, ["f1", "f2"]).collect()} == {0.0}
    assert shapley.attribution(model, d.limit(0), ["f1", "f2"]).count() == 0


def test_bundle_round_trip(spark, tmp_path):
    from terrastat.sources.sinks import load_bundle, save_bundle

    d = rows(spark, 50)
    stats = learn.fit_statistics(d, ["f1", "f2"], ["soil"])
    ready, names = learn.apply_statistics(d, stats, ["f1", "f2"], ["soil"])
    model = learn.forest(names, "t", SMALL).fit(ready)
    save_bundle(model, stats, str(tmp_path / "b"))
    again, back = load_bundle(spark, str(tmp_path / "b"))
    r2, n2 = learn.apply_statistics(d, back, ["f1", "f2"], ["soil"])
    assert n2 == names
    a = model.transform(ready).select("id", "prediction").toPandas().sort_values("id")
    b = again.transform(r2).select("id", "prediction").toPandas().sort_values("id")
    assert a.prediction.to_numpy() == pytest.approx(b.prediction.to_numpy())


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(9)
    o = rng.normal(5, 2, 300)
    p = o + rng.normal(0, 1, 300)
    d = spark.createDataFrame(pd.DataFrame({"obs": o, "pred": p}))
    m = s.metrics(d).first()
    rmse = np.sqrt(np.mean((o - p) ** 2))
    assert m["r2"] == pytest.approx(1 - ((o - p) ** 2).sum() / ((o - o.mean()) ** 2).sum())
    assert m["rpiq"] == pytest.approx(np.subtract(*np.percentile(o, [75, 25])) / rmse)
    assert m["ccc"] == pytest.approx(2 * np.cov(o, p, ddof=0)[0, 1] / (o.var() + p.var() + (o.mean() - p.mean()) ** 2))
    exact = s.metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "obs double, pred double")).first()
    assert exact["rpiq"] == 0.0 and exact["rmse"] == 0.0 and exact["rpd"] is None
