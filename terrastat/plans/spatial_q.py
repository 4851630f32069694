"""Pixels, regions, variograms and kriging."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.operators import kriging, rk, spatial
from terrastat.operators.learn import Budget, apply_statistics
from terrastat.operators.ranks import assign_folds
from terrastat.operators.search import FOREST_SPACE
from terrastat.operators.summary import metrics
from terrastat.functions.scalar import nodata_to_null
from terrastat.plans.data import EDGES, FEATURES, INSIDE, LOCATED, NODATA, POINTS, RASTER, STRIP, TILE, TILE_OF, WIDTH, covariate_pixels, located, points, raster, region_edges, survey
from terrastat.plans.learning_q import STUMP, _OUTER, _SIDE, _ST, _TRAINED, _cuts
from terrastat.plans.registry import query, r, rnd
from terrastat.plans.windows_q import FILLED
from terrastat.session import local_table

MAX_LAG = 0.3
LAG_COUNTS = list(range(6, 21))
BUDGET = Budget(50, 42, 10, {**FOREST_SPACE, "trees": (20, 60)})


@query("spa_01_tile_index", f"SELECT row, col, {TILE_OF} AS tile FROM {RASTER}")
def _(t):
    return raster(t).select("row", "col", spatial.tile_index("row", "col", TILE, WIDTH).alias("tile"))


_KIND = "CAST(round_even(coalesce(kind, 1e0), 0) AS INTEGER)"


@query(
    "spa_02_tile_features",
    f"SELECT f.tile, f.row, f.col, {r('f.filled', 2)} AS price, {r('g.size', 2)} AS size, CAST({_KIND} = 2 AS INTEGER) AS kind_2, CAST({_KIND} = 3 AS INTEGER) AS kind_3 FROM {FILLED} f JOIN {RASTER} g ON g.row = f.row AND g.col = f.col WHERE g.size IS NOT NULL",
)
def _(t):
    wide = raster(t).withColumn("tile", spatial.tile_index("row", "col", TILE, WIDTH)).withColumn("price", nodata_to_null("price", NODATA))
    d = spatial.tile_features(wide, ["size"], {"price": 950.0, "size": 25.0}, {"kind": 1.0}, {"kind": [2, 3]})
    return rnd(d.select("tile", "row", "col", "price", "size", "kind_2", "kind_3"), 2, "price", "size")


def _lags(n: int, lag: float = MAX_LAG) -> str:
    return f"""(SELECT least(CAST(floor(h / ({lag}e0 / {n})) AS INTEGER), {n - 1}) AS lag, count(*) AS n, avg(h) AS h, avg(s) / 2 AS gamma FROM
(SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, (a.v - b.v) * (a.v - b.v) AS s FROM {POINTS} a JOIN {POINTS} b ON a.id < b.id) WHERE h <= {lag}e0 GROUP BY 1)"""


def samples(t):
    return points(t).select(F.col("id").alias("sid"), "x", "y", "v")


@query("spa_03_semivariogram", f"SELECT lag, n, {r('h', 9)} AS h, {r('gamma', 9)} AS gamma FROM {_lags(12)}")
def _(t):
    d = spatial.semivariogram(points(t).select("x", "y", "v"), [12], MAX_LAG)
    return rnd(d.select("lag", "n", "h", "gamma"), 9, "h", "gamma")


_CANDIDATES = spatial.variogram_candidates(MAX_LAG)
_SHAPE = """CASE model WHEN 'linear' THEN h WHEN 'power' THEN power(h, reach) WHEN 'gaussian' THEN 1 - exp(-power(1.75e0 * h / reach, 2))
WHEN 'exponential' THEN 1 - exp(-3 * h / reach) ELSE CASE WHEN h <= reach THEN 1.5e0 * h / reach - 0.5e0 * power(h / reach, 3) ELSE 1e0 END END"""
_SLOPE = """CASE model WHEN 'linear' THEN 0e0 WHEN 'power' THEN power(h, reach) * ln(h) WHEN 'gaussian' THEN -6.125e0 * h * h / power(reach, 3) * exp(-power(1.75e0 * h / reach, 2))
WHEN 'exponential' THEN -3 * h / (reach * reach) * exp(-3 * h / reach) ELSE CASE WHEN h <= reach THEN 1.5e0 * (h * h * h / power(reach, 4) - h / (reach * reach)) ELSE 0e0 END END"""


def _over(term: str) -> str:
    return f"list_sum([{term} FOR i IN range(1, len(hs) + 1)])"


def _straight(source: str) -> str:
    """Sill and nugget of each row's model at its range, the error, and half of minus its slope."""
    return f"""(SELECT *, {_over('ws[i] * power(ys[i] - sill * gs[i] - nugget, 2)')} AS sse, {_over('ws[i] * (ys[i] - sill * gs[i] - nugget) * sill * ds[i]')} AS down FROM
(SELECT *, CASE WHEN slope < 0 THEN 0e0 WHEN level < 0 THEN greatest(sgy / sgg, 0) ELSE slope END AS sill, CASE WHEN slope < 0 THEN sy / sw WHEN level < 0 THEN 0e0 ELSE level END AS nugget FROM
(SELECT *, (sy - slope * sg) / sw AS level FROM (SELECT *, coalesce((sw * sgy - sg * sy) / nullif(sw * sgg - sg * sg, 0), 0) AS slope FROM
(SELECT *, list_sum(ws) AS sw, {_over('ws[i] * gs[i]')} AS sg, {_over('ws[i] * ys[i]')} AS sy, {_over('ws[i] * gs[i] * gs[i]')} AS sgg, {_over('ws[i] * gs[i] * ys[i]')} AS sgy FROM
(SELECT *, [{_SHAPE} FOR h IN hs] AS gs, [{_SLOPE} FOR h IN hs] AS ds FROM ({source})))))))"""


def _fits(lags: str, families: tuple[str, ...], weights: str = "(true), (false)", keys: str = "") -> str:
    """Least-squares variograms by halving the bracket around the best candidate: one row per family and weighting.

    ``lags`` has ``h, gamma`` and the columns ``keys`` (each followed by a comma).
    """
    cand = ", ".join(f"('{m}', {c!r}::DOUBLE, {i})" for f in families for i, (m, c) in enumerate(sorted(x for x in _CANDIDATES if x[0] == f), 1))
    over = f"PARTITION BY {keys[:-2]}" if keys else ""
    return f"""(WITH RECURSIVE l AS (SELECT {keys}weighted, list(h ORDER BY h) AS hs, list(gamma ORDER BY h) AS ys, list(w ORDER BY h) AS ws, sum(w * gamma * gamma) AS syy FROM
(SELECT *, CASE WHEN weighted AND hi > lo THEN 1 / (1 + exp(-2.1972e0 / (0.1e0 * (hi - lo)) * (0.7e0 * (hi - lo) + lo - h))) ELSE 1e0 END AS w FROM
(SELECT *, min(h) OVER ({over}) AS lo, max(h) OVER ({over}) AS hi FROM {lags}), (VALUES {weights}) AS b(weighted)) GROUP BY ALL),
g AS (SELECT *, lag(reach) OVER (PARTITION BY {keys}weighted, model ORDER BY i) AS prev, lead(reach) OVER (PARTITION BY {keys}weighted, model ORDER BY i) AS next,
row_number() OVER (PARTITION BY {keys}weighted, model ORDER BY round(sse / syy, 10), i) AS k FROM {_straight(f"SELECT l.*, c.* FROM l, (VALUES {cand}) AS c(model, reach, i)")}),
b AS (SELECT {keys}weighted, model, hs, ys, ws, syy, reach AS first, coalesce(prev, reach / 100) AS lo, coalesce(next, reach) AS hi, 0 AS n FROM g WHERE k = 1
UNION ALL SELECT {keys}weighted, model, hs, ys, ws, syy, first, CASE WHEN down > 0 THEN reach ELSE lo END, CASE WHEN down > 0 THEN hi ELSE reach END, n + 1 FROM {_straight("SELECT *, (lo + hi) / 2 AS reach FROM b WHERE n < 60")}),
z AS (SELECT *, row_number() OVER (PARTITION BY {keys}weighted, model ORDER BY round(sse / syy, 10), coarse) AS k FROM {_straight("SELECT *, (lo + hi) / 2 AS reach, false AS coarse FROM b WHERE n = 60 UNION ALL SELECT *, first AS reach, true AS coarse FROM b WHERE n = 60")})
SELECT {keys}weighted, model, sill, CASE WHEN sill = 0 OR model = 'linear' THEN first ELSE reach END AS reach, nugget, sse FROM z WHERE k = 1)"""


@query(
    "spa_04_variogram_fit",
    f"SELECT weighted, model, {r('sill', 8)} AS sill, {r('reach', 8)} AS reach, {r('nugget', 8)} AS nugget FROM {_fits(_lags(12), spatial.VARIOGRAM_MODELS)}",
)
def _(t):
    emp = spatial.semivariogram(points(t).select("x", "y", "v"), [12], MAX_LAG)
    d = spatial.fit_variogram(emp, _CANDIDATES, [True, False], per_model=True)
    return rnd(d.drop("sse"), 8, "sill", "nugget", "reach")


def fitted(t):
    emp = spatial.semivariogram(points(t).select("x", "y", "v"), [12], MAX_LAG)
    cand = [c for c in _CANDIDATES if c[0] == "spherical"]
    return spatial.fit_variogram(emp, cand, [True]).select("model", "sill", "reach", "nugget")


@query("spa_05_variogram_search")
def _(t):
    folds = assign_folds(samples(t), ["sid"], 4, 1, out="inner")
    return kriging.search_variogram(folds, MAX_LAG, _CANDIDATES, LAG_COUNTS, [True, False], k=32)


# one neighbour takes all the weight whatever the variogram: the score of every setting is that of the nearest sample of other folds
_FOLDED = f"(SELECT *, CAST(ntile(4) OVER (ORDER BY md5('1:' || id), id) AS INTEGER) AS f FROM {POINTS})"
_LEFT_OUT = f"(SELECT a.f, a.v - arg_min(b.v, struct_pack(d := sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), i := b.id)) AS e FROM {_FOLDED} a JOIN {_FOLDED} b ON a.f <> b.f GROUP BY a.f, a.id, a.v)"


@query(
    "spa_05_nearest_search",
    f"SELECT model, CAST(n_lags AS INTEGER) AS n_lags, weighted, rmse, 4::BIGINT AS n_folds FROM (SELECT {r('avg(q)', 8)} AS rmse FROM (SELECT sqrt(avg(e * e)) AS q FROM {_LEFT_OUT} GROUP BY f)), (VALUES {', '.join(f'({m!r})' for m in spatial.VARIOGRAM_MODELS)}) AS m(model), (VALUES (6), (12)) AS n(n_lags), (VALUES (true), (false)) AS w(weighted)",
)
def _(t):
    folds = assign_folds(samples(t), ["sid"], 4, 1, out="inner")
    return rnd(kriging.search_variogram(folds, MAX_LAG, _CANDIDATES, [6, 12], [True, False], k=1), 8, "rmse")


@query("spa_07_local_kriging")
def _(t):
    return kriging.krige_local(located(t).select("qid", "x", "y"), samples(t), fitted(t), 32)


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_NEAR = f"(SELECT a.qid, b.x, b.y, b.v, {_D} AS d, row_number() OVER (PARTITION BY a.qid ORDER BY {_D}, b.id) AS k FROM {LOCATED} a, {POINTS} b)"


# two neighbours: weight of the first is 1/2 + (g02 - g01) / (2 g12)
@query(
    "spa_07_two_neighbour_kriging",
    f"""SELECT qid, {r('w * v1 + (1 - w) * v2', 7)} AS estimate, {r('w * g1 + (1 - w) * g2 + g1 - (1 - w) * g12', 7)} AS variance FROM (SELECT qid, v1, v2, g1, g2, g12, 0.5e0 + (g2 - g1) / (2 * g12) AS w FROM
(SELECT p.qid, p.v AS v1, q.v AS v2, p.d + 0.1e0 AS g1, q.d + 0.1e0 AS g2, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) + 0.1e0 AS g12 FROM {_NEAR} p JOIN {_NEAR} q ON p.qid = q.qid AND p.k = 1 AND q.k = 2))""",
)
def _(t):
    model = local_table(t.spark, [("linear", 1.0, 1.0, 0.1)], "model string, sill double, reach double, nugget double")
    return rnd(kriging.krige_local(located(t).select("qid", "x", "y"), samples(t), model, 2), 7, "estimate", "variance")


# without spatial structure all neighbours weigh the same: their mean, and the nugget plus the variance of that mean
@query(
    "spa_07_nugget_kriging",
    f"SELECT qid, {r('avg(v)', 8)} AS estimate, {r('0.1e0 * (1 + 1e0 / count(*))', 8)} AS variance FROM {_NEAR} WHERE k <= 32 GROUP BY qid",
)
def _(t):
    model = local_table(t.spark, [("linear", 0.0, 1.0, 0.1)], "model string, sill double, reach double, nugget double")
    return rnd(kriging.krige_local(located(t).select("qid", "x", "y"), samples(t), model, 32), 8, "estimate", "variance")


@query(
    "spa_08_combine",
    f"SELECT o_orderkey AS qid, {r('o_totalprice + coalesce(m, 0)', 2)} AS prediction FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def _(t):
    trend = t.orders.select(F.col("o_orderkey").alias("qid"), F.col("o_totalprice").alias("trend"))
    resid = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(F.max("l_quantity").alias("estimate"))
    return rnd(kriging.combine(trend, resid).select("qid", "prediction"), 2, "prediction")


def _nested(t):
    return rk.nested_cv_rk(survey(t), "target", FEATURES, ["soil"], BUDGET, MAX_LAG, n_lags=LAG_COUNTS, weighted=[True, False], k=32, outer=5, inner=4)


@query("spa_09_rk_nested_cv")
def _(t):
    out, _best = _nested(t)
    long = out.unpivot(["fold", "obs"], ["pred_rf", "pred_rk"], "model", "pred")
    return metrics(long, ["model", "fold"])


@query("spa_10_rk_final_model")
def _(t):
    fit = rk.final_rk(survey(t), "target", FEATURES, ["soil"], BUDGET, MAX_LAG, LAG_COUNTS, [True, False], k=32, inner=4)
    spread = fit["residuals"].agg(F.struct(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd_resid")).alias("s")).scalar()
    return fit["fitted"].withColumn("s", spread).select("model", "sill", "reach", "nugget", "s.n", "s.sd_resid")


@query("spa_11_rk_point_map")
def _(t):
    fit = rk.final_rk(survey(t), "target", FEATURES, ["soil"], BUDGET, MAX_LAG, LAG_COUNTS, [True, False], k=32, inner=4)
    ready, _ = apply_statistics(covariate_pixels(t), fit["stats"], FEATURES, ["soil"])
    out = rk.predict_map(ready, fit["model"], fit["residuals"], fit["fitted"], k=32)
    return out.select("qid", "x", "y", "trend", "prediction")


# a trend of one split and one neighbour: the prediction is the side's mean plus the residual of the nearest training sample
def stump_survey(t):
    return survey(t).select("id", "x", "y", F.col("soil").cast("double").alias("s"), "target")


def _final_stump(t):
    return rk.final_rk(stump_survey(t), "target", ["s"], [], [STUMP], MAX_LAG, [6, 12], [True, False], k=1, inner=4)


_RESID = f"(SELECT id, target - {_SIDE} AS e FROM {_ST}, {_cuts(_ST, '0')})"
_OF_SAMPLE = f"(SELECT p.id, p.x, p.y, e FROM {POINTS} p JOIN {_RESID} q ON q.id = p.id)"


@query("spa_10_stump_residuals", f"SELECT count(*) AS n, {r('stddev_samp(e)', 7)} AS sd_resid FROM {_RESID}")
def _(t):
    spread = _final_stump(t)["residuals"].agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd_resid"))
    return rnd(spread, 7, "sd_resid")


@query(
    "spa_11_stump_map",
    f"""SELECT qid, {r(_SIDE, 6)} AS trend, {r(f'{_SIDE} + e', 6)} AS prediction FROM (SELECT a.qid, any_value(a.s) AS x, arg_min(b.e, struct_pack(d := sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), i := b.id)) AS e
FROM (SELECT l.*, CAST(p_size % 10 AS DOUBLE) AS s FROM {LOCATED} l JOIN part ON p_partkey = qid) a, {_OF_SAMPLE} b GROUP BY a.qid), {_cuts(_ST, '0')}""",
)
def _(t):
    fit = _final_stump(t)
    px = covariate_pixels(t).select("qid", "x", "y", F.col("soil").cast("double").alias("s"))
    ready, _ = apply_statistics(px, fit["stats"], ["s"], [])
    return rnd(rk.predict_map(ready, fit["model"], fit["residuals"], fit["fitted"], k=1).select("qid", "trend", "prediction"), 6, "trend", "prediction")


_OUT = f"(SELECT d.id, d.fold, d.target, d.x, cut, ml, mr FROM {_OUTER} d JOIN {_cuts(_TRAINED, 'o')} c ON c.g = d.fold)"
_IN = f"(SELECT d.o, d.id, d.target - {_SIDE} AS e FROM {_TRAINED} d JOIN {_cuts(_TRAINED, 'o')} c ON c.g = d.o)"


@query(
    "spa_09_stump_cv",
    f"""SELECT id, fold, {r('target', 6)} AS obs, {r(_SIDE, 6)} AS pred_rf, {r(f'{_SIDE} + e', 6)} AS pred_rk FROM {_OUT} JOIN
(SELECT a.id AS aid, arg_min(i.e, struct_pack(d := sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), i := b.id)) AS e FROM {_OUT} q JOIN {POINTS} a ON a.id = q.id JOIN {_IN} i ON i.o = q.fold JOIN {POINTS} b ON b.id = i.id GROUP BY a.id) ON aid = id""",
)
def _(t):
    out, _best = rk.nested_cv_rk(stump_survey(t), "target", ["s"], [], [STUMP], MAX_LAG, n_lags=[6, 12], weighted=[True, False], k=1, outer=5, inner=4)
    return rnd(out.select("id", "fold", "obs", "pred_rf", "pred_rk"), 6, "obs", "pred_rf", "pred_rk")


@query(
    "spa_12_region_list",
    f"SELECT region, count(DISTINCT ring) AS n_parts, count(*) AS n_edges, {r('min(least(x1, x2))', 9)} AS x_min, {r('max(greatest(x1, x2))', 9)} AS x_max, {r('min(least(y1, y2))', 9)} AS y_min, {r('max(greatest(y1, y2))', 9)} AS y_max FROM {EDGES} GROUP BY 1",
)
def _(t):
    return rnd(spatial.region_list(region_edges(t), expected=5), 9, "x_min", "x_max", "y_min", "y_max")


def _inside(t):
    return spatial.pixels_in_regions(located(t), region_edges(t), STRIP).filter(F.col("price").isNotNull())


_VALID = f"(SELECT * FROM {INSIDE} WHERE price IS NOT NULL)"
_P = ["2.0", "21.2", "40.4", "59.6", "78.8", "98.0"]
_BREAKS = f"""(SELECT region, i, round(CASE WHEN i = 0 THEN least(b, floor(mn / 0.05e0) * 0.05e0) WHEN i = 5 THEN greatest(b, ceil(mx / 0.05e0) * 0.05e0) ELSE b END, 6) AS edge FROM
(SELECT region, i, mn, mx, (max(round_even(q / 0.05e0, 0) - i) OVER (PARTITION BY region ORDER BY i) + i) * 0.05e0 AS b FROM
({' UNION ALL '.join(f"SELECT region, {i} AS i, quantile_cont(price, {float(p) / 100:.3f}) AS q, min(price) AS mn, max(price) AS mx FROM {_VALID} GROUP BY 1" for i, p in enumerate(_P))})))"""


@query("spa_13_quantile_breaks", f"SELECT region, i, {r('edge', 6)} AS edge FROM {_BREAKS}")
def _(t):
    return rnd(spatial.quantile_breaks(_inside(t), "price", 5), 6, "edge")


@query(
    "spa_13_class_labels",
    f"SELECT region, i AS class, {r('edge', 6)} AS lo, {r('hi', 6)} AS hi, CASE i WHEN 0 THEN printf('< %.2f', hi) WHEN 4 THEN printf('> %.2f', edge) ELSE printf('%.2f–%.2f', edge, hi) END AS label FROM (SELECT *, lead(edge) OVER (PARTITION BY region ORDER BY i) AS hi FROM {_BREAKS}) WHERE hi IS NOT NULL",
)
def _(t):
    return rnd(spatial.class_table(spatial.quantile_breaks(_inside(t), "price", 5)), 6, "lo", "hi")


_CLASS = f"(SELECT v.region, v.qid, CAST(least(count(*), 5) - 1 AS INTEGER) AS class FROM {_VALID} v JOIN {_BREAKS} b ON b.region = v.region AND b.edge <= v.price GROUP BY 1, 2)"


@query("spa_14_class_assignment", f"SELECT region, qid, class FROM {_CLASS}")
def _(t):
    inside = _inside(t)
    return spatial.assign_classes(inside, spatial.quantile_breaks(inside, "price", 5), "price").select("region", "qid", "class")


@query("agg_29_class_counts", f"SELECT region, class, count(*) AS n FROM {_CLASS} GROUP BY 1, 2")
def _(t):
    inside = _inside(t)
    d = spatial.assign_classes(inside, spatial.quantile_breaks(inside, "price", 5), "price")
    return d.groupBy("region", "class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "spa_15_crop_extent",
    f"SELECT region, count(price) AS n_valid, count(*) AS n_pixels, {r('min(x)', 9)} AS x_min, {r('max(x)', 9)} AS x_max, {r('min(y)', 9)} AS y_min, {r('max(y)', 9)} AS y_max FROM {INSIDE} GROUP BY 1",
)
def _(t):
    d = spatial.crop_extents(spatial.pixels_in_regions(located(t), region_edges(t), STRIP), "price")
    return rnd(d, 9, "x_min", "x_max", "y_min", "y_max")
