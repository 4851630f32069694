"""Components, screening, preparation, forests and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.operators import index, learn, screen, shapley
from terrastat.operators.ranks import assign_folds, spearman
from terrastat.operators.search import FOREST_SPACE
from terrastat.operators.summary import cv_summary, metrics
from terrastat.plans.data import BLOCK, BLOCK_COLUMNS, FEATURES, GAPPY, TRIPLE, block, gappy, survey, triple
from terrastat.plans.prep_q import PAIRS_SQL
from terrastat.plans.summary_q import poisson_sql
from terrastat.plans.registry import query, r, rnd
from terrastat.session import cut_lineage, local_table, new_path
from terrastat.sources import sinks

ABC = ["a", "b", "c"]


@query(
    "ml_01_standardise",
    "SELECT " + ", ".join(f"{r(f'min(z{c})', 6)} AS lo_{c}, {r(f'max(z{c})', 6)} AS hi_{c}, {r(f'avg(z{c} * z{c})', 6)} AS ss_{c}" for c in ABC) + " FROM (SELECT " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{c}" for c in ABC) + f" FROM {TRIPLE})",
)
def _(t):
    z = index.z_scores(triple(t), ABC)
    aggs = []
    for c in ABC:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.avg(F.col(c) * F.col(c)).alias(f"ss_{c}")]
    d = z.agg(*aggs)
    return rnd(d, 6, *d.columns)


# three variables: the characteristic cubic has a closed form
_M = f"(SELECT corr(a, b) AS r12, corr(a, c) AS r13, corr(b, c) AS r23, CAST(count(*) AS DOUBLE) AS n FROM {TRIPLE})"
_EIG = f"""(SELECT *, l * n / (n - 1) AS eigenvalue, 1 - l AS mu FROM (SELECT *, 1 + 2 * sqrt(s / 3) * cos(acos(greatest(-1, least(1, 3 * q / s * sqrt(3 / s)))) / 3 - 2 * pi() * (dim - 1) / 3) AS l
FROM (SELECT *, r12 * r12 + r13 * r13 + r23 * r23 AS s, r12 * r13 * r23 AS q FROM {_M}), (VALUES (1), (2), (3)) AS k(dim)))"""
_VEC = f"""(SELECT *, x / len AS x1, y / len AS x2, z / len AS x3 FROM (SELECT *, sqrt(x * x + y * y + z * z) * CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN sign(x) WHEN abs(y) >= abs(z) THEN sign(y) ELSE sign(z) END AS len
FROM (SELECT *, r12 * r23 - r13 * mu AS x, r13 * r12 - r23 * mu AS y, mu * mu - r12 * r12 AS z FROM {_EIG})))"""
_COORD = "(" + " UNION ALL ".join(f"SELECT '{c}' AS variable, dim, x{i} AS loading, x{i} * sqrt(eigenvalue) AS coord, eigenvalue FROM {_VEC}" for i, c in enumerate(ABC, 1)) + ")"


@query("ml_02_eigenvalues", f"SELECT dim, {r('eigenvalue', 8)} AS eigenvalue, {r('100 * eigenvalue / sum(eigenvalue) OVER ()', 7)} AS percentage, {r('100 * sum(eigenvalue) OVER (ORDER BY dim) / sum(eigenvalue) OVER ()', 7)} AS cumulative FROM {_EIG}")
def _(t):
    eigen, _c = index.principal_components(triple(t), ABC)
    return rnd(rnd(eigen, 8, "eigenvalue"), 7, "percentage", "cumulative")


@query("ml_02_eigenvalues_wide")
def _(t):
    return index.principal_components(block(t), BLOCK_COLUMNS)[0]


@query("ml_03_coordinates", f"SELECT variable, dim, {r('loading', 7)} AS loading, {r('coord', 7)} AS coord FROM {_COORD}")
def _(t):
    return rnd(index.principal_components(triple(t), ABC)[1], 7, "loading", "coord")


@query("ml_04_contributions", f"SELECT variable, dim, {r('100 * coord * coord / sum(coord * coord) OVER (PARTITION BY dim)', 6)} AS contribution FROM {_COORD}")
def _(t):
    return rnd(index.contributions(index.principal_components(triple(t), ABC)[1]), 6, "contribution")


@query("ml_05_retained_components", f"SELECT dim, {r('eigenvalue', 8)} AS eigenvalue FROM {_EIG} WHERE eigenvalue > 1")
def _(t):
    return rnd(index.retained(index.principal_components(triple(t), ABC)[0]).select("dim", "eigenvalue"), 8, "eigenvalue")


@query(
    "ml_06_indicator_weights",
    f"SELECT variable, dim, {r('w', 7)} AS weight_raw, {r('w / sum(w) OVER ()', 7)} AS weight FROM (SELECT variable, dim, abs(coord) * eigenvalue AS w, row_number() OVER (PARTITION BY variable ORDER BY abs(coord) DESC, dim) AS k FROM {_COORD} WHERE eigenvalue > 1) WHERE k = 1",
)
def _(t):
    eigen, coords = index.principal_components(triple(t), ABC)
    return rnd(index.indicator_weights(coords, eigen).select("variable", "dim", "weight_raw", "weight"), 7, "weight_raw", "weight")


@query(
    "ml_07_supplementary",
    f"SELECT dim, {r('(x1 * ra + x2 * rb + x3 * rc) / sqrt(l)', 7)} AS r FROM {_VEC}, (SELECT corr(a, extra) AS ra, corr(b, extra) AS rb, corr(c, extra) AS rc FROM {TRIPLE}) WHERE dim <= 2",
)
def _(t):
    return rnd(index.supplementary(triple(t), ABC, "extra", 2), 7, "r")


@query("ml_08_vif", f"SELECT 'a' AS predictor, {r('(1 - r23 * r23) / det', 7)} AS vif FROM (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM {_M}) UNION ALL SELECT 'b', {r('(1 - r13 * r13) / det', 7)} FROM (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM {_M}) UNION ALL SELECT 'c', {r('(1 - r12 * r12) / det', 7)} FROM (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM {_M})")
def _(t):
    return rnd(screen.vif(triple(t), ABC).select("predictor", "vif"), 7, "vif")


@query("ml_09_vif_elimination")
def _(t):
    kept, _log = screen.eliminate(block(t), BLOCK_COLUMNS, priority=["charge"])
    return kept


@query("ml_09_vif_log")
def _(t):
    return screen.eliminate(block(t), BLOCK_COLUMNS)[1]


@query("ml_09_vif_per_response")
def _(t):
    out = None
    for resp in ("price", "target"):
        kept, _log = screen.eliminate(gappy(t).withColumn("twice", F.col("price") * 2 + F.col("cust") / 1000), ["price", "cust", "twice"], response=resp)
        kept = kept.withColumn("response", F.lit(resp))
        out = kept if out is None else out.unionByName(kept)
    return out


_V3 = """(SELECT *, (1 - r23 * r23) / det AS v1, (1 - r13 * r13) / det AS v2, (1 - r12 * r12) / det AS v3 FROM
(SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM
(SELECT corr(price, net) AS r12, corr(price, charge) AS r13, corr(net, charge) AS r23 FROM {rows})))"""
# the worst goes first; of the two left both have the same factor, and the first goes if it reaches the limit
_STEP1 = f"""(SELECT *, greatest(v1, v2, v3) AS worst, CASE greatest(v1, v2, v3) WHEN v1 THEN ['price', 'net', 'charge'] WHEN v2 THEN ['net', 'price', 'charge'] ELSE ['charge', 'price', 'net'] END AS names,
1 / (1 - power(CASE greatest(v1, v2, v3) WHEN v1 THEN r23 WHEN v2 THEN r13 ELSE r12 END, 2)) AS pair FROM {_V3.format(rows=BLOCK)})"""


@query(
    "ml_09_vif_three",
    f"""SELECT predictor, {r('vif', 5)} AS vif FROM (SELECT unnest(CASE WHEN worst < 10 THEN ['price', 'net', 'charge'] WHEN pair < 10 THEN names[2:3] ELSE names[3:3] END) AS predictor,
unnest(CASE WHEN worst < 10 THEN [v1, v2, v3] WHEN pair < 10 THEN [pair, pair] ELSE [1e0] END) AS vif FROM {_STEP1})""",
)
def _(t):
    kept, _log = screen.eliminate(block(t), ["price", "net", "charge"])
    return rnd(kept.select("predictor", "vif"), 5, "vif")


@query(
    "ml_09_vif_three_log",
    f"SELECT 0 AS step, names[1] AS dropped, {r('worst', 2)} AS vif_at_drop FROM {_STEP1} WHERE worst >= 10 UNION ALL SELECT 1, names[2], {r('pair', 2)} FROM {_STEP1} WHERE worst >= 10 AND pair >= 10",
)
def _(t):
    return screen.eliminate(block(t), ["price", "net", "charge"])[1].select("step", "dropped", "vif_at_drop")


@query("ml_10_retained_correlations", f"SELECT var2 AS row_name, var1 AS col_name, {r('r', 8)} AS r FROM ({PAIRS_SQL})")
def _(t):
    return rnd(screen.retained_correlations(block(t), BLOCK_COLUMNS).select("row_name", "col_name", "r"), 8, "r")


# ------------------------------------------------------ train-only statistics

_FOLDED = f"(SELECT *, CAST(ntile(5) OVER (ORDER BY md5('123:' || o_orderkey), o_orderkey) AS INTEGER) AS fold FROM {GAPPY})"
_TRAIN = f"(SELECT k.f AS train_fold, d.* FROM {_FOLDED} d, (VALUES (1), (2), (3), (4), (5)) AS k(f) WHERE d.fold <> k.f)"


def folded(t):
    return assign_folds(gappy(t), ["o_orderkey"], 5, 123)


@query(
    "ml_11_training_medians",
    " UNION ALL ".join(f"SELECT train_fold, '{c}' AS variable, {r(f'median({c})', 3)} AS median FROM {_TRAIN} GROUP BY 1" for c in ("price", "cust")),
)
def _(t):
    return rnd(learn.training_medians(folded(t), ["price", "cust"], "fold", 5), 3, "median")


@query("ml_12_training_modes", f"SELECT train_fold, 'prio' AS variable, prio AS mode FROM (SELECT train_fold, prio, row_number() OVER (PARTITION BY train_fold ORDER BY count(*) DESC, prio) AS k FROM {_TRAIN} WHERE prio IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def _(t):
    return learn.training_modes(folded(t), ["prio"], "fold", 5)


@query("ml_13_training_levels", f"SELECT train_fold, 'prio' AS variable, prio AS level, CAST(row_number() OVER (PARTITION BY train_fold ORDER BY prio) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT train_fold, prio FROM {_TRAIN} WHERE prio IS NOT NULL)")
def _(t):
    return learn.training_levels(folded(t), ["prio"], "fold", 5)


_HOT = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_MODE = f"(SELECT prio FROM {GAPPY} WHERE prio IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, prio LIMIT 1)"


@query(
    "ml_14_apply_statistics",
    f"SELECT o_orderkey, {r(f'coalesce(price, (SELECT median(price) FROM {GAPPY}))', 3)} AS price, {r(f'coalesce(cust, (SELECT median(cust) FROM {GAPPY}))', 3)} AS cust, " + ", ".join(f'CAST(coalesce(prio, {_MODE}) = \'{lv}\' AS INTEGER)::DOUBLE AS "prio_{lv}"' for lv in _HOT) + f" FROM {GAPPY}",
)
def _(t):
    d = gappy(t)
    stats = learn.fit_statistics(d, ["price", "cust"], ["prio"])
    ready, names = learn.apply_statistics(d, stats, ["price", "cust"], ["prio"])
    return rnd(ready.select("o_orderkey", *names), 3, "price", "cust")


# -------------------------------------------------------------------- forests

FOREST = {"trees": 100, "depth": 12, "leaf": 2, "split": 4, "subset": "all"}
BUDGET = learn.Budget(50, 42, 10, {**FOREST_SPACE, "trees": (20, 60)})


def prepared(t):
    d = survey(t)
    stats = learn.fit_statistics(d, FEATURES, ["soil"])
    return learn.apply_statistics(d, stats, FEATURES, ["soil"])


@query("ml_15_forest")
def _(t):
    d, names = prepared(t)
    model = learn.forest(names, "target", FOREST).fit(d)
    return model.transform(d).select("id", F.col("target").alias("obs"), F.col("prediction").alias("pred"))


@query("ml_16_tuning")
def _(t):
    d, names = prepared(t)
    folds = cut_lineage(assign_folds(d, ["id"], 4, 1, out="inner"))
    _model, _best, tried, scores = learn.tune_forest(folds, names, "target", "inner", 4, BUDGET)
    rows = [(i, s["trees"], s["depth"], s["split"], s["leaf"], s["subset"], v) for i, (s, v) in enumerate(zip(tried, scores))]
    return local_table(t.spark, rows, "trial int, trees int, depth int, split int, leaf int, subset string, rmse double")


@query("ml_17_nested_cv")
def _(t):
    pred, _best = learn.nested_cv(survey(t), ["id"], "target", FEATURES, ["soil"], BUDGET, outer=5, inner=4)
    return pred


@query("ml_17_nested_cv_summary")
def _(t):
    pred, _best = learn.nested_cv(survey(t), ["id"], "target", FEATURES, ["soil"], BUDGET, outer=5, inner=4)
    m = metrics(pred.withColumn("response", F.lit("target")), ["response", "fold"])
    return cv_summary(m, ["response"], ["r2", "rmse", "mae", "rpiq", "ccc"])


def _final(t):
    return learn.final_model(survey(t), ["id"], "target", FEATURES, ["soil"], BUDGET, inner=4)


@query("ml_18_final_model")
def _(t):
    model, _stats, names, _best = _final(t)
    return learn.importances(model, names)


@query("src_12_model_bundle")
def _(t):
    model, stats, names, _best = _final(t)
    path = new_path(t.spark, "bundle")
    sinks.save_bundle(model, stats, path)
    again, back = sinks.load_bundle(t.spark, path)
    ready, _ = learn.apply_statistics(survey(t), back, FEATURES, ["soil"])
    return again.transform(ready).select("id", "prediction")


@query("ml_19_bootstrap_ensemble")
def _(t):
    d, names = prepared(t)
    models = learn.bootstrap_models(d, ["id"], names, "target", FOREST, 30, 11)
    return learn.ensemble_predict(d, models).select("id", "mean", "sd")


_E = "(SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:30]] AS p FROM embeddings)"


@query("ml_19_ensemble_statistics", f"SELECT vec_id AS id, {r('list_avg(p)', 7)} AS mean, {r('list_stddev_samp(p)', 7)} AS sd FROM {_E}")
def _(t):
    names = [f"p{i}" for i in range(30)]
    d = t.embeddings.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    mean, sd = learn.ensemble_statistics(names)
    return rnd(d.select("id", mean.alias("mean"), sd.alias("sd")), 7, "mean", "sd")


# one split on ten levels has an exact statement: the cut with the largest sum of squared sums over counts
STUMP = {"trees": 1, "depth": 1, "leaf": 1, "subset": "all", "bootstrap": False}
STUMPS = [{**STUMP, "depth": 0}, STUMP]  # no split or one
_ST = """(SELECT vec_id AS id, CAST(label AS DOUBLE) AS x, 3 * e[5] - 2 * e[6] + e[7] * e[8] * 10 + sin(e[1] * 12) + label * 0.05e0 AS target
FROM (SELECT *, [CAST(v AS DOUBLE) FOR v IN embedding] AS e FROM embeddings))"""


def stumps(t):
    return survey(t).select("id", F.col("soil").cast("double").alias("x"), "target")


def _cuts(rows: str, g: str, w: str = "1e0") -> str:
    """Per group ``g`` of ``rows``: best cut, mean at or below it, mean above, mean of all."""
    levels = f"(SELECT {g} AS g, x, sum({w}) AS n, sum({w} * target) AS s FROM {rows} GROUP BY 1, 2)"
    upto = f"(SELECT *, sum(n) OVER (PARTITION BY g ORDER BY x) AS nl, sum(s) OVER (PARTITION BY g ORDER BY x) AS sl, sum(n) OVER (PARTITION BY g) AS na, sum(s) OVER (PARTITION BY g) AS sa FROM {levels})"
    return f"(SELECT g, x AS cut, sl / nl AS ml, (sa - sl) / (na - nl) AS mr, sa / na AS m FROM {upto} WHERE nl < na QUALIFY row_number() OVER (PARTITION BY g ORDER BY sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) DESC, x) = 1)"


_SIDE = "CASE WHEN x <= cut THEN ml ELSE mr END"


def _scores(rows: str, g: str) -> str:
    """Per group ``g`` of ``rows (inner)``: mean error over four inner folds without a split and with one."""
    fits = _cuts(f"(SELECT d.*, {g} * 10 + f AS gi FROM {rows} d, range(1, 5) AS k(f) WHERE d.inner_fold <> f)", "gi")
    each = f"(SELECT g, sqrt(avg(power(target - m, 2))) AS e0, sqrt(avg(power(target - ({_SIDE}), 2))) AS e1 FROM (SELECT *, {g} * 10 + inner_fold AS gi FROM {rows}) JOIN {fits} ON g = gi GROUP BY 1)"
    return f"(SELECT g // 10 AS g, avg(e0) AS r0, avg(e1) AS r1 FROM {each} GROUP BY 1)"


_INNER = f"(SELECT *, 0 AS o, CAST(ntile(4) OVER (ORDER BY md5('{{seed}}:' || id), id) AS INTEGER) AS inner_fold FROM {_ST})"


@query("ml_15_stump", f"SELECT id, {r('target', 6)} AS obs, {r(_SIDE, 6)} AS pred FROM {_ST}, {_cuts(_ST, '0')}")
def _(t):
    d = stumps(t)
    model = learn.forest(["x"], "target", STUMP).fit(d)
    return rnd(model.transform(d).select("id", F.col("target").alias("obs"), F.col("prediction").alias("pred")), 6, "obs", "pred")


@query(
    "ml_16_tuning_stumps",
    f"SELECT k AS depth, {r('CASE k WHEN 0 THEN r0 ELSE r1 END', 8)} AS rmse FROM {_scores(_INNER.format(seed=1), 'o')}, (VALUES (0), (1)) AS v(k)",
)
def _(t):
    folds = cut_lineage(assign_folds(stumps(t), ["id"], 4, 1, out="inner"))
    _model, _best, tried, scores = learn.tune_forest(folds, ["x"], "target", "inner", 4, STUMPS)
    return rnd(local_table(t.spark, [(s["depth"], v) for s, v in zip(tried, scores)], "depth int, rmse double"), 8, "rmse")


_OUTER = f"(SELECT *, CAST(ntile(5) OVER (ORDER BY md5('123:' || id), id) AS INTEGER) AS fold FROM {_ST})"
_TRAINED = f"(SELECT *, CAST(ntile(4) OVER (PARTITION BY o ORDER BY md5((123 + o) || ':' || id), id) AS INTEGER) AS inner_fold FROM (SELECT d.*, o FROM {_OUTER} d, range(1, 6) AS k(o) WHERE d.fold <> o))"


@query(
    "ml_17_nested_cv_stumps",
    f"SELECT id, fold, {r('target', 6)} AS obs, {r(f'CASE WHEN r0 <= r1 THEN m ELSE {_SIDE} END', 6)} AS pred FROM {_OUTER} d JOIN {_cuts(_TRAINED, 'o')} c ON c.g = d.fold JOIN {_scores(_TRAINED, 'o')} e ON e.g = d.fold",
)
def _(t):
    pred, _best = learn.nested_cv(stumps(t), ["id"], "target", ["x"], [], STUMPS, outer=5, inner=4)
    return rnd(pred, 6, "obs", "pred")


_FINAL = f"SELECT id, {r(f'CASE WHEN r0 <= r1 THEN m ELSE {_SIDE} END', 6)} AS prediction FROM {_ST}, {_cuts(_ST, '0')}, {_scores(_INNER.format(seed=123), 'o')}"


def _final_stump(t):
    return learn.final_model(stumps(t), ["id"], "target", ["x"], [], STUMPS, inner=4)


@query("ml_18_final_stump", _FINAL)
def _(t):
    model, stats, _names, _best = _final_stump(t)
    ready, _ = learn.apply_statistics(stumps(t), stats, ["x"], [])
    return rnd(model.transform(ready).select("id", "prediction"), 6, "prediction")


@query("src_12_stump_bundle", _FINAL)
def _(t):
    model, stats, _names, _best = _final_stump(t)
    path = new_path(t.spark, "bundle")
    sinks.save_bundle(model, stats, path)
    again, back = sinks.load_bundle(t.spark, path)
    ready, _ = learn.apply_statistics(stumps(t), back, ["x"], [])
    return rnd(again.transform(ready).select("id", "prediction"), 6, "prediction")


_DRAWN = f"(SELECT *, {poisson_sql('u')} AS w FROM (SELECT d.*, b, (('0x' || substr(md5('11:' || b || ':' || id), 1, 8))::BIGINT / 4294967296e0) AS u FROM {_ST} d, range(1, 31) AS k(b)))"


@query(
    "ml_19_bootstrap_stumps",
    f"SELECT id, {r('avg(p)', 6)} AS mean, {r('stddev_samp(p)', 6)} AS sd FROM (SELECT id, {_SIDE} AS p FROM {_ST}, {_cuts(f'(SELECT * FROM {_DRAWN} WHERE w > 0)', 'b', 'w')}) GROUP BY 1",
)
def _(t):
    d = stumps(t)
    models = learn.bootstrap_models(d, ["id"], ["x"], "target", STUMP, 30, 11)
    return rnd(learn.ensemble_predict(d, models).select("id", "mean", "sd"), 6, "mean", "sd")


_PHI = f"(SELECT id, x, ({_SIDE}) - m AS phi FROM {_ST}, {_cuts(_ST, '0')})"


def _stump_phi(t):
    d = stumps(t)
    return shapley.attribution(learn.forest(["x"], "target", STUMP).fit(d), d, ["x"])


@query("ml_20_stump_attribution", f"SELECT id, 'x' AS feature, x AS value, {r('phi', 6)} AS phi FROM {_PHI}")
def _(t):
    return rnd(_stump_phi(t), 6, "phi")


@query("ml_20_stump_mean_attribution", f"SELECT 'x' AS feature, {r('avg(abs(phi))', 6)} AS mean_abs, count(*) AS n FROM {_PHI}")
def _(t):
    return rnd(learn.mean_abs_attribution(_stump_phi(t)), 6, "mean_abs")


@query("ml_23_stump_dependence", f"SELECT id, x AS value, {r('phi', 6)} AS phi FROM {_PHI}")
def _(t):
    return rnd(learn.dependence_rows(_stump_phi(t), 3).select("id", "value", "phi"), 6, "phi")


def _phi(t):
    d, names = prepared(t)
    model = learn.forest(names, "target", FOREST).fit(d)
    return model, d, names, shapley.attribution(model, d, names)


@query("ml_20_attribution")
def _(t):
    return _phi(t)[3]


@query("ml_20_mean_attribution")
def _(t):
    return learn.mean_abs_attribution(_phi(t)[3])


@query("ml_21_interactions")
def _(t):
    d, names = prepared(t)
    model = learn.forest(names, "target", FOREST).fit(d)
    return shapley.interactions(model, d, names, FEATURES)


# two features of two values each and a tree that asks for both: the joint effect follows from the four means
_HALVES = f"(SELECT id, CAST(x >= 5 AS DOUBLE) AS a, x % 2 AS b, target FROM {_ST})"
_QUARTERS = f"(SELECT a, b, count(*) AS n, avg(target) AS m FROM {_HALVES} GROUP BY 1, 2)"
_MEANS_OF = f"(SELECT *, sum(n * m) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS ma, sum(n) OVER (PARTITION BY a) AS na, sum(n * m) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS mb, sum(n) OVER (PARTITION BY b) AS nb, sum(n * m) OVER () / sum(n) OVER () AS mm, sum(n) OVER () AS nn FROM {_QUARTERS})"
_BOTH_WAYS = f"(SELECT *, sum(na * m) OVER (PARTITION BY b) / nn AS over_a, sum(nb * m) OVER (PARTITION BY a) / nn AS over_b, sum(n * ma * ma) OVER () >= sum(n * mb * mb) OVER () AS a_first FROM {_MEANS_OF})"


def _two(t):
    d = stumps(t).select("id", (F.col("x") >= 5).cast("double").alias("a"), F.pmod("x", F.lit(2.0)).alias("b"), "target")
    return d, learn.forest(["a", "b"], "target", {**STUMP, "depth": 2}).fit(d)


@query("ml_21_pair_strength", f"SELECT 'a' AS a, 'b' AS b, {r('sum(n * abs(m - CASE WHEN a_first THEN ma + over_a ELSE mb + over_b END + mm) / 2) / sum(n)', 8)} AS strength FROM {_BOTH_WAYS}")
def _(t):
    d, model = _two(t)
    return rnd(shapley.interactions(model, d, ["a", "b"], ["a", "b"]), 8, "strength")


_FIRST = "sum(n * power({m} - mm, 2))"
_SPLIT = f"(SELECT any_value(a_first) AS a_first, {_FIRST.format(m='ma')} AS ga, {_FIRST.format(m='mb')} AS gb, {_FIRST.format(m='m')} AS gm FROM {_BOTH_WAYS})"


@query(
    "ml_22_two_importances",
    f"SELECT 'a' AS feature, {r('CASE WHEN a_first THEN ga ELSE gm - gb END / gm', 8)} AS importance FROM {_SPLIT} UNION ALL SELECT 'b', {r('CASE WHEN a_first THEN gm - ga ELSE gb END / gm', 8)} FROM {_SPLIT}",
)
def _(t):
    return rnd(learn.importances(_two(t)[1], ["a", "b"]), 8, "importance")


@query("ml_22_importance_validation")
def _(t):
    model, _d, names, phi = _phi(t)
    both = cut_lineage(learn.mean_abs_attribution(phi).join(learn.importances(model, names), "feature"))  # ranks read it several times
    return spearman(both, "mean_abs", "importance")


@query("ml_23_dependence_rows")
def _(t):
    return learn.dependence_rows(_phi(t)[3], 3, exclude=["soil_"])
