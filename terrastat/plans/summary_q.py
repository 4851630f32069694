"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.operators import spatial
from terrastat.operators import summary as s
from terrastat.operators.ranks import spearman
from terrastat.plans.data import BLOCK, BLOCK_COLUMNS, GAPPY, INSIDE, POINTS, PREDICTED, ROWS, SAMPLES, STRIP, block, gappy, located, points, predicted, region_edges, rows, samples
from terrastat.plans.prep_q import PAIRS_SQL
from terrastat.plans.registry import query, r, rnd
from terrastat.plans.sources_q import PART_INDEX, part_index

NUMERIC = ["price", "cust"]


def _describe(cols, table, extra=""):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS sd, {r(f'min({c})', 4)} AS min, {r(f'max({c})', 4)} AS max, "
        f"{r(f'quantile_cont({c}, 0.5)', 4)} AS median, {r(f'100 * stddev_samp({c}) / avg({c})', 4)} AS cv{extra.format(c=c)} FROM {table}"
        for c in cols
    )


@query("agg_01_descriptive_summary", f"SELECT variable, min, max, mean, median, sd, cv FROM ({_describe(BLOCK_COLUMNS, BLOCK)})")
def _(t):
    cols = ["min", "max", "mean", "median", "sd", "cv"]
    return rnd(s.describe(block(t), BLOCK_COLUMNS).select("variable", *cols), 4, *cols)


_EXTRA = f", count(*) - count({{c}}) AS n_missing, {r('quantile_cont({c}, 0.25)', 4)} AS q25, {r('quantile_cont({c}, 0.75)', 4)} AS q75"


@query("agg_02_describe_missing", _describe(NUMERIC, GAPPY, _EXTRA))
def _(t):
    return rnd(s.describe(gappy(t), NUMERIC), 4, "mean", "sd", "min", "max", "median", "cv", "q25", "q75")


@query("agg_03_value_counts", f"SELECT prio, count(*) AS n FROM {GAPPY} GROUP BY 1")
def _(t):
    return s.value_counts(gappy(t), "prio")


@query("agg_04_range", f"SELECT {r('min(index_value)', 6)} AS lo, {r('max(index_value)', 6)} AS hi FROM {PART_INDEX}")
def _(t):
    return rnd(part_index(t).agg(F.min("index_value").alias("lo"), F.max("index_value").alias("hi")), 6, "lo", "hi")


@query(
    "agg_05_id_check",
    "SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (k IS NULL OR l_linenumber IS NULL), 0)::BIGINT AS n_null, (sum(n) - count(*))::BIGINT AS n_duplicates FROM (SELECT k, l_linenumber, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_orderkey END AS k, l_linenumber FROM lineitem) GROUP BY 1, 2)",
)
def _(t):
    d = t.lineitem.select(F.when(F.col("l_orderkey") % 17 != 0, F.col("l_orderkey")).alias("k"), "l_linenumber")
    return s.id_check(d, ["k", "l_linenumber"])


@query(
    "agg_06_missing_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count(*) AS n_rows, count({c}) = 0 AS empty FROM (SELECT *, NULL AS blank FROM {GAPPY})" for c in ("price", "cust", "prio", "blank")),
)
def _(t):
    return s.missing_profile(gappy(t).withColumn("blank", F.lit(None).cast("double")), ["price", "cust", "prio", "blank"])


@query("agg_07_dependency_check", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_o_orderstatus, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1")
def _(t):
    return s.dependency_violations(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("agg_08_design_counts", f"SELECT site, lc, count(DISTINCT plot) AS n_plots, count(*) AS n_samples FROM {SAMPLES} GROUP BY 1, 2")
def _(t):
    return s.design_counts(samples(t), ["site", "lc"], "plot")


@query(
    "agg_09_grouping_sets",
    f"SELECT site, lc, depth, CAST(GROUPING(depth, lc, site) AS INTEGER) AS grouping, count(*) AS n_samples, count(DISTINCT plot) AS n_plots FROM {SAMPLES} GROUP BY GROUPING SETS ((site), (lc), (depth), (site, lc), (lc, depth), (site, depth), ())",
)
def _(t):
    sets = [["site"], ["lc"], ["depth"], ["site", "lc"], ["lc", "depth"], ["site", "depth"], []]
    return s.grouping_set_counts(samples(t), sets, "plot")


@query("agg_10_pearson_pairs", f"SELECT var1, var2, {r('r', 8)} AS r, n FROM ({PAIRS_SQL})")
def _(t):
    return rnd(s.pearson_pairs(block(t), BLOCK_COLUMNS), 8, "r")


_GAP_PAIR = f"SELECT {r('corr(price, cust)', 8)} AS r, count(*) FILTER (price IS NOT NULL AND cust IS NOT NULL) AS n FROM {GAPPY}"


@query("agg_10_pearson_pairwise_complete", _GAP_PAIR)
def _(t):
    return rnd(s.pearson_pairs(gappy(t), ["price", "cust"]).select("r", "n"), 8, "r")


@query(
    "agg_10_pearson_matrix",
    "SELECT v1 AS var1, " + ", ".join(f"max(CASE WHEN v2 = '{c}' THEN {r('r', 8)} END) AS {c}" for c in BLOCK_COLUMNS) + f" FROM (SELECT var1 AS v1, var2 AS v2, r FROM ({PAIRS_SQL}) UNION ALL SELECT var2, var1, r FROM ({PAIRS_SQL}) UNION ALL SELECT c, c, 1e0 FROM (VALUES {', '.join(f'({c!r})' for c in BLOCK_COLUMNS)}) AS d(c)) GROUP BY 1",
)
def _(t):
    return rnd(s.pair_matrix(s.pearson_pairs(block(t), BLOCK_COLUMNS), BLOCK_COLUMNS), 8, *BLOCK_COLUMNS)


@query("agg_11_pearson_p")
def _(t):
    return s.pearson_p(s.pearson_pairs(block(t), BLOCK_COLUMNS))


# whole degrees of freedom: the t tail is a finite sum, one form for even and one for odd ones
_R_BY_NATION = "(SELECT c_nationkey AS nation, corr(c_acctbal, length(c_name) + c_custkey) AS r, count(*) AS n FROM customer GROUP BY 1)"
_ANGLE = f"(SELECT *, n - 2 AS v, atan(abs(r) / sqrt(1 - r * r)) AS th, unnest(range(0, (n - 2) // 2)) AS i FROM {_R_BY_NATION} WHERE n > 4)"


@query(
    "agg_11_pearson_p_small",
    f"""SELECT nation, {r('r', 8)} AS r, n, {r('1 - CASE WHEN v % 2 = 0 THEN sin(th) * sum(exp(lgamma(i + 0.5e0) - lgamma(i + 1)) / sqrt(pi()) * power(cos(th), 2 * i)) ELSE 2 / pi() * (th + sin(th) * cos(th) * sum(exp(lgamma(i + 1) - lgamma(i + 1.5e0)) * sqrt(pi()) / 2 * power(cos(th), 2 * i))) END', 8)} AS p
FROM {_ANGLE} GROUP BY nation, r, n, v, th""",
)
def _(t):
    x = F.length("c_name") + F.col("c_custkey")
    pairs = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.corr("c_acctbal", x.cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return rnd(s.pearson_p(pairs.filter("n > 4")), 8, "r", "p")


@query("agg_12_pair_table", f"SELECT var1, var2, {r('r', 8)} AS r, n, abs(r) > 0.75 AS strong FROM ({PAIRS_SQL})")
def _(t):
    d = s.pearson_pairs(block(t), BLOCK_COLUMNS).orderBy(F.abs("r").desc(), "var1", "var2")
    return rnd(d.withColumn("strong", F.abs("r") > 0.75), 8, "r")


@query("agg_13_weighted_index", f"SELECT p_partkey, {r('index_value', 8)} AS index_value, method FROM {PART_INDEX}")
def _(t):
    return rnd(part_index(t).select("p_partkey", "index_value", "method"), 8, "index_value")


def _metrics(table: str, by: str, pred: str = "pred") -> str:
    g = f"{by}, " if by else ""
    return f"""(SELECT {g}count(*) AS n, 1 - sum((obs - {pred}) * (obs - {pred})) / (count(*) * var_pop(obs)) AS r2, sqrt(avg((obs - {pred}) * (obs - {pred}))) AS rmse, avg(abs(obs - {pred})) AS mae,
(quantile_cont(obs, 0.75) - quantile_cont(obs, 0.25)) / sqrt(avg((obs - {pred}) * (obs - {pred}))) AS rpiq,
2 * covar_pop(obs, {pred}) / (var_pop(obs) + var_pop({pred}) + (avg(obs) - avg({pred})) * (avg(obs) - avg({pred}))) AS ccc,
stddev_samp(obs) / sqrt(avg((obs - {pred}) * (obs - {pred}))) AS rpd FROM {table} GROUP BY {by or 'ALL'})"""


METRIC = ["r2", "rmse", "mae", "rpiq", "ccc"]


@query("agg_14_regression_metrics", "SELECT fold, n, " + ", ".join(f"{r(m, 5)} AS {m}" for m in METRIC) + f" FROM {_metrics(PREDICTED, 'fold')}")
def _(t):
    return rnd(s.metrics(predicted(t), ["fold"]).select("fold", "n", *METRIC), 5, *METRIC)


@query("agg_15_pooled_metrics", f"SELECT response, {r('r2', 3)} AS r2, {r('rmse', 3)} AS rmse, {r('mae', 3)} AS mae, {r('rpd', 2)} AS rpd, {r('rpiq', 2)} AS rpiq, n FROM {_metrics(PREDICTED, 'response')}")
def _(t):
    return s.pooled_table(predicted(t), ["response"])


@query(
    "agg_16_model_comparison",
    "SELECT a.response, " + ", ".join(f"{r(f'a.{m}', 5)} AS rf_{m}, {r(f'b.{m}', 5)} AS rk_{m}" for m in ("r2", "rmse", "mae")) + f" FROM {_metrics(PREDICTED, 'response')} a JOIN {_metrics(PREDICTED, 'response', 'pred_b')} b USING (response)",
)
def _(t):
    d = s.compare_models(predicted(t).select("response", "obs", "pred", "pred_b"), {"rf": "pred", "rk": "pred_b"}, ["response"], ["r2", "rmse", "mae"])
    return rnd(d, 5, *[c for c in d.columns if c != "response"])


@query(
    "agg_17_cv_summary",
    "SELECT response, count(*) AS n_folds, " + ", ".join(f"{r(f'avg({m})', 5)} AS {m}_mean, {r(f'stddev_samp({m})', 5)} AS {m}_sd" for m in ("r2", "rmse", "rpiq")) + f" FROM {_metrics(PREDICTED, 'response, fold')} GROUP BY 1",
)
def _(t):
    d = s.cv_summary(s.metrics(predicted(t), ["response", "fold"]), ["response"], ["r2", "rmse", "rpiq"])
    return rnd(d, 5, *[c for c in d.columns if c.endswith(("_mean", "_sd"))])


_RES = f"(SELECT response, obs - pred_b AS e FROM {PREDICTED})"


def residuals(t):
    return predicted(t).select("response", (F.col("obs") - F.col("pred_b")).alias("e"))


@query(
    "agg_18_residual_moments",
    f"SELECT response, {r('m3 / power(m2, 1.5)', 6)} AS skewness, {r('m4 / (m2 * m2) - 3', 6)} AS excess_kurtosis FROM (SELECT response, avg(power(e - m, 2)) AS m2, avg(power(e - m, 3)) AS m3, avg(power(e - m, 4)) AS m4 FROM (SELECT response, e, avg(e) OVER (PARTITION BY response) AS m FROM {_RES}) GROUP BY 1)",
)
def _(t):
    return rnd(s.shape_moments(residuals(t), "e", ["response"]), 6, "skewness", "excess_kurtosis")


@query("agg_19_spread_by_group", f"SELECT response, {r('stddev_samp(e)', 5)} AS sd FROM {_RES} GROUP BY 1")
def _(t):
    return rnd(s.spread_by_group(residuals(t), "e", "response"), 5, "sd")


@query("agg_19_spread_ratio", f"SELECT {r('max(sd) / min(sd)', 8)} AS sd_ratio, max(sd) / min(sd) > 2 AS flagged FROM (SELECT stddev_samp(e) AS sd FROM {_RES} GROUP BY response)")
def _(t):
    return rnd(s.spread_ratio(s.spread_by_group(residuals(t), "e", "response")), 8, "sd_ratio")


# three groups: with two numerator degrees of freedom the F tail is (1 + 2F/d)^(-d/2)
@query(
    "agg_20_levene",
    f"""SELECT {r('f', 6)} AS F, 2e0 AS df1, d AS df2, {r('power(1 + 2 * f / d, -d / 2)', 8)} AS p FROM (SELECT (b / 2) / (w / d) AS f, d FROM
(SELECT sum(n * power(m - g, 2)) AS b, sum(n * v) AS w, CAST(sum(n) - 3 AS DOUBLE) AS d FROM
(SELECT response, count(*) AS n, avg(z) AS m, var_pop(z) AS v, any_value(g) AS g FROM
(SELECT response, z, avg(z) OVER () AS g FROM (SELECT response, abs(e - med) AS z FROM {_RES} JOIN (SELECT response, median(e) AS med FROM {_RES} GROUP BY 1) USING (response))) GROUP BY 1)))""",
)
def _(t):
    return rnd(rnd(s.levene(residuals(t), "e", "response"), 6, "F"), 8, "p")


@query(
    "agg_21_box_statistics",
    f"""SELECT site, {r('any_value(q1)', 6)} AS q1, {r('any_value(med)', 6)} AS median, {r('any_value(q3)', 6)} AS q3, {r('min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END)', 6)} AS whisker_low,
{r('max(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END)', 6)} AS whisker_high, {r('avg(y)', 6)} AS mean, count(*) AS n FROM {SAMPLES} JOIN (SELECT site, quantile_cont(y, 0.25) AS q1, median(y) AS med, quantile_cont(y, 0.75) AS q3 FROM {SAMPLES} GROUP BY 1) USING (site) GROUP BY 1""",
)
def _(t):
    d = s.box_stats(samples(t), "y", ["site"])
    return rnd(d, 6, "q1", "median", "q3", "whisker_low", "whisker_high", "mean")


def _whiskers(by: str) -> str:
    return f"""SELECT min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END) AS wl, max(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END) AS wh FROM {SAMPLES} JOIN (SELECT {by}, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM {SAMPLES} GROUP BY {by}) USING ({by}) GROUP BY {by}"""


@query(
    "agg_22_axis_limits",
    f"""SELECT {r('greatest(mn, least(p1, wl))', 6)} AS lo, {r('least(mx, greatest(p99, wh))', 6)} AS hi FROM (SELECT min(y) AS mn, max(y) AS mx, quantile_cont(y, 0.01) AS p1, quantile_cont(y, 0.99) AS p99 FROM {SAMPLES}),
(SELECT min(wl) AS wl, max(wh) AS wh FROM ({_whiskers('site')} UNION ALL {_whiskers('lc')} UNION ALL {_whiskers('site, lc')}))""",
)
def _(t):
    return rnd(s.axis_limits(samples(t), "y", [["site"], ["lc"], ["site", "lc"]]), 6, "lo", "hi")


@query("agg_23_regression_line", f"SELECT response, {r('regr_slope(pred, obs)', 8)} AS slope, {r('regr_intercept(pred, obs)', 3)} AS intercept FROM {PREDICTED} GROUP BY 1")
def _(t):
    return rnd(rnd(s.regression_line(predicted(t), ["response"]), 8, "slope"), 3, "intercept")


def _avg_rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY response ORDER BY {c}) + (count(*) OVER (PARTITION BY response, {c}) - 1) / 2e0"


@query("agg_24_spearman", f"SELECT response, count(*) AS n, {r('corr(a, b)', 8)} AS rho FROM (SELECT response, {_avg_rank('obs')} AS a, {_avg_rank('pred_b')} AS b FROM {PREDICTED}) GROUP BY 1")
def _(t):
    return rnd(spearman(predicted(t), "obs", "pred_b", ["response"]), 8, "rho")


@query("agg_25_group_means", f"SELECT site, lc, {r('avg(y)', 6)} AS mean_raw, count(*) AS n_samples, count(DISTINCT plot) AS n_plots FROM {SAMPLES} GROUP BY 1, 2")
def _(t):
    return rnd(s.group_means(samples(t), ["site", "lc"], "y", "plot"), 6, "mean_raw")


@query("agg_26_region_statistics", f"SELECT region, 'price' AS response, count(price) AS n_valid, {r('min(price)', 2)} AS min_value, {r('max(price)', 2)} AS max_value FROM {INSIDE} GROUP BY 1")
def _(t):
    inside = spatial.pixels_in_regions(located(t), region_edges(t), STRIP).withColumn("response", F.lit("price"))
    return rnd(spatial.region_statistics(inside, "price", ["region", "response"]), 2, "min_value", "max_value")


def poisson_sql(u: str) -> str:
    total, term, parts = 0.0, 0.36787944117144233, []
    for k in range(1, 12):
        total += term
        parts.append(f"(CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END)")
        term /= k
    return " + ".join(parts)


_LONG = "(SELECT vec_id AS id, 'f' || i AS feature, CAST(embedding[i] AS DOUBLE) AS phi FROM embeddings, (VALUES (1), (2), (3)) AS k(i))"
_U = "(('0x' || substr(md5('7:' || b || ':' || id), 1, 8))::BIGINT / 4294967296e0)"


@query(
    "agg_27_bootstrap_interval",
    f"""SELECT m.feature, {r('m.m', 8)} AS mean_abs, {r('b.lo', 8)} AS ci_lo, {r('b.hi', 8)} AS ci_hi FROM (SELECT feature, avg(abs(phi)) AS m FROM {_LONG} GROUP BY 1) m JOIN
(SELECT feature, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM (SELECT feature, b, sum(w * abs(phi)) / sum(w) AS v FROM (SELECT *, {poisson_sql('u')} AS w FROM (SELECT *, {_U} AS u FROM {_LONG}, range(1, 201) AS g(b))) GROUP BY 1, 2) GROUP BY 1) b USING (feature)""",
)
def _(t):
    e = F.col("embedding")
    wide = t.embeddings.select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(f"f{i + 1}") for i in range(3)])
    long = wide.unpivot(["id"], ["f1", "f2", "f3"], "feature", "phi")
    return rnd(s.bootstrap_interval(long, "id", ["feature"], "phi", 200, 0.90, 7), 8, "mean_abs", "ci_lo", "ci_hi")


@query(
    "agg_28_point_density",
    f"""SELECT id, {r('(k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())', 6)} AS density FROM (SELECT a.id, sum(exp(-0.5e0 * power(n, 1e0 / 3) * ((a.x - b.x) * (a.x - b.x) * vy - 2 * (a.x - b.x) * (a.y - b.y) * c + (a.y - b.y) * (a.y - b.y) * vx) / (vx * vy - c * c))) AS k
FROM {POINTS} a, {POINTS} b, (SELECT CAST(count(*) AS DOUBLE) AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM {POINTS}) GROUP BY a.id)""",
)
def _(t):
    return rnd(spatial.point_density(points(t).select("id", "x", "y")), 6, "density")


@query("agg_rows_by_factor", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT l_orderkey) AS n_plots FROM {ROWS} GROUP BY 1, 2")
def _(t):
    d = s.design_counts(rows(t), ["o_orderstatus", "o_orderpriority"], "l_orderkey")
    return d.select("o_orderstatus", "o_orderpriority", F.col("n_samples").alias("n"), "n_plots")
