"""Mixed models of a balanced table, whose random effects have closed forms.

Every vector is a plot with one value per depth, so the sums of squares between plots, between depths and of the rest are
all that the likelihood needs, and statements can follow the fit with its random intercept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.operators import contrasts as ct
from terrastat.operators import mixed as mx
from terrastat.operators import summary as s
from terrastat.plans.data import DEPTHS
from terrastat.plans.registry import Tables, query, r, rnd
from terrastat.session import local_table

PLAIN = mx.Design(["all"], ["all"], DEPTHS, [float(d - 4) for d in DEPTHS])
DEPTH = [("depth",)]
K = len(DEPTHS)


def balanced(t: Tables, shared: float = 1.0):
    """``K`` values of each vector, moved by ``shared`` times its first one."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = t.embeddings.select(F.col("vec_id").alias("plot"), F.get(e, F.lit(0)).alias("first"), F.posexplode(F.slice(e, 2, K)).alias("pos", "v"))
    y = F.col("v") + shared * F.col("first")
    return rows.select("plot", F.lit("all").alias("site"), F.lit("all").alias("lc"), (F.col("pos") + 1).alias("depth"), y.alias("y"))


def model(t: Tables, terms, structure="A", reml=True):
    return mx.fit(mx.collect_sums(balanced(t), PLAIN), terms, structure, reml)


_ROWS = f"(SELECT vec_id AS plot, CAST(d AS INTEGER) AS depth, CAST(embedding[d + 1] AS DOUBLE) + CAST(embedding[1] AS DOUBLE) AS y FROM embeddings, range(1, {K + 1}) AS k(d))"
_PARTS = f"(SELECT *, avg(y) OVER (PARTITION BY plot) AS p, avg(y) OVER (PARTITION BY depth) AS dd, avg(y) OVER () AS g FROM {_ROWS})"
_SQUARES = f"(SELECT CAST(count(DISTINCT plot) AS DOUBLE) AS m, CAST(count(*) AS DOUBLE) AS n, any_value(g) AS g, sum(power(p - g, 2)) AS ssb, sum(power(y - p, 2)) AS ssw, sum(power(y - p - dd + g, 2)) AS sse, sum(power(dd - g, 2)) AS ssd, sum(power(y - g, 2)) AS sst, var_pop(dd) AS vf FROM {_PARTS})"


def _reml(within: str, free: str) -> str:
    """Residual and plot variance under REML; on the boundary the residual takes all."""
    inner = f"(SELECT *, {within} / {free} AS msw, ssb / (m - 1) AS lam FROM {_SQUARES})"
    return f"(SELECT *, CASE WHEN lam > msw THEN msw ELSE ({within} + ssb) / ({free} + m - 1) END AS s2, greatest(lam - msw, 0) / {K} AS tau2 FROM {inner})"


_NULL = _reml("ssw", f"(m * {K - 1})")
_BY_DEPTH = _reml("sse", f"((m - 1) * {K - 1})")


@query("mix_02_balanced_effects", f"SELECT 'intercept' AS term, {r('g', 6)} AS estimate, {r(f'sqrt((s2 + {K} * tau2) / n)', 6)} AS se FROM {_NULL}")
def _(t):
    return rnd(mx.coefficient_table(t.spark, model(t, [])).select("term", "estimate", "se"), 6, "estimate", "se")


@query(
    "mix_02_balanced_variances",
    f"SELECT 'all' AS grp, {r('tau2', 5)} AS variance, {r('sqrt(tau2)', 5)} AS sd_or_correlation, sqrt(tau2) < 1e-4 AS at_boundary FROM {_NULL} UNION ALL SELECT 'residual', {r('s2', 5)}, {r('sqrt(s2)', 5)}, false FROM {_NULL}",
)
def _(t):
    d = mx.variance_table(t.spark, model(t, [])).select("grp", "variance", "sd_or_correlation", "at_boundary")
    return rnd(d, 5, "variance", "sd_or_correlation")


_LAM = "(ssb / m)"


def _deviance(within: str) -> str:
    """Twice the negative log-likelihood at the maximum with a random intercept inside its bounds."""
    return f"(n * (ln(2 * pi()) + 1) + m * {K - 1} * ln({within} / (m * {K - 1})) + m * ln({_LAM}))"


_FREE = "(n * (ln(2 * pi() * sst / n) + 1))"


def _criteria(models: dict[str, tuple[str, int]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS model, {k} AS k, {dev} AS dev, n, m FROM {_SQUARES}" for name, (dev, k) in models.items())
    parts = {"aic": "dev + 2 * k", "bic_nobs": "dev + ln(n) * k", "bic_nplots": "dev + ln(m) * k"}
    cols = ", ".join(f"{r(v, 4)} AS {c}, {r(f'{v} - min({v}) OVER ()', 4)} AS delta_{c}" for c, v in parts.items())
    return f"SELECT model, k, {r('-dev / 2', 4)} AS loglik, {cols} FROM ({rows})"


_CRITERIA = ["loglik", "aic", "bic_nobs", "bic_nplots", "delta_aic", "delta_bic_nobs", "delta_bic_nplots"]


@query("mix_04_balanced_structures", _criteria({"A": (_deviance("ssw"), 3), "N": (_FREE, 2)}))
def _(t):
    fits = {c: model(t, [], c, reml=False) for c in "AN"}
    return rnd(mx.criteria_table(t.spark, fits).select("model", "k", *_CRITERIA), 4, *_CRITERIA)


@query("mix_05_balanced_candidates", _criteria({"mean": (_deviance("ssw"), 3), "depth": (_deviance("sse"), K + 2)}))
def _(t):
    fits = {"mean": model(t, [], reml=False), "depth": model(t, DEPTH, reml=False)}
    return rnd(mx.criteria_table(t.spark, fits).select("model", "k", *_CRITERIA), 4, *_CRITERIA)


@query(
    "mix_06_balanced_ratio",
    f"SELECT {r('x', 4)} AS chi2, {K - 1} AS df, {r('exp(-x / 2) * (1 + x / 2 + x * x / 8)', 6)} AS p FROM (SELECT m * {K - 1} * ln(ssw / sse) AS x FROM {_SQUARES})",
)
def _(t):
    d = mx.lr_table(t.spark, [("depth", model(t, DEPTH, reml=False), model(t, [], reml=False))]).drop("term")
    return rnd(rnd(d, 4, "chi2"), 6, "p")


@query(
    "mix_07_balanced_r_squared",
    f"SELECT {r('vf', 6)} AS var_fixed, {r('tau2', 5)} AS var_random, {r('s2', 5)} AS var_resid, {r('vf / (vf + tau2 + s2)', 5)} AS r2_marginal, {r('(vf + tau2) / (vf + tau2 + s2)', 5)} AS r2_conditional FROM {_BY_DEPTH}",
)
def _(t):
    d = mx.r_squared(balanced(t), model(t, DEPTH))
    return rnd(rnd(d, 6, "var_fixed"), 5, "var_random", "var_resid", "r2_marginal", "r2_conditional")


@query("mix_08_balanced_icc", f"SELECT {r('tau2 / (tau2 + s2)', 5)} AS icc FROM {_NULL}")
def _(t):
    return local_table(t.spark, [(round(mx.icc(model(t, [])), 5),)], "icc double")


_SPEC = [("Depth", (), "depth", "M")]


def _tests(t):
    return {"M": model(t, DEPTH)}, ct.SATTERTHWAITE


# a mean's variance is a sum of two independent mean squares, a difference's is one of them
_LAMBDA = f"(s2 + {K} * tau2)"
_MEAN_DF = f"(m - 1) * power({_LAMBDA} + {K - 1} * s2, 2) / (power({_LAMBDA}, 2) + {K - 1} * s2 * s2)"


@query("mix_09_balanced_means", f"SELECT x_level, {r('emm', 6)} AS emm, {r('sqrt((tau2 + s2) / m)', 5)} AS se, {r(_MEAN_DF, 1)} AS df FROM (SELECT CAST(depth AS VARCHAR) AS x_level, avg(y) AS emm FROM {_ROWS} GROUP BY 1), {_BY_DEPTH}")
def _(t):
    fits, df2 = _tests(t)
    d = ct.marginal_means(t.spark, PLAIN, fits, _SPEC, df2).select("x_level", "emm", "se", "df")
    return rnd(rnd(rnd(d, 6, "emm"), 5, "se"), 1, "df")


_LEVELS = f"(SELECT depth, avg(y) AS v FROM {_ROWS} GROUP BY 1)"


@query("mix_10_balanced_contrasts", f"SELECT CAST(a.depth AS VARCHAR) AS a, CAST(b.depth AS VARCHAR) AS b, {r('a.v - b.v', 6)} AS estimate, {r('sqrt(2 * s2 / m)', 5)} AS se, (m - 1) * {K - 1} AS df FROM {_LEVELS} a JOIN {_LEVELS} b ON a.depth < b.depth, {_BY_DEPTH}")
def _(t):
    fits, df2 = _tests(t)
    d = ct.pairwise(t.spark, PLAIN, fits, _SPEC, df2).select("a", "b", "estimate", "se", "df")
    return rnd(rnd(rnd(d, 6, "estimate"), 5, "se"), 1, "df")


@query("mix_11_balanced_joint_test", f"SELECT {r(f'ssd / {K - 1} / s2', 4)} AS F, {K - 1}e0 AS df1, (m - 1) * {K - 1} AS df2 FROM {_BY_DEPTH}")
def _(t):
    fits, df2 = _tests(t)
    return rnd(rnd(ct.joint_tests(t.spark, PLAIN, fits, _SPEC, df2).select("F", "df1", "df2"), 4, "F"), 1, "df2")


# an even numerator gives the tail of F as a short sum
_TAIL = "power(x, a) * (1 + a * (1 - x) + a * (a + 1) / 2 * power(1 - x, 2))"


@query(
    "mix_06_balanced_term_test",
    f"SELECT 'depth' AS term, {r('f', 4)} AS F, {K - 1}e0 AS df1, d AS df2, {r(_TAIL, 7)} AS p FROM (SELECT f, d, d / (d + {K - 1} * f) AS x, d / 2 AS a FROM (SELECT ssd / {K - 1} / s2 AS f, (m - 1) * {K - 1} AS d FROM {_BY_DEPTH}))",
)
def _(t):
    d = ct.term_tests(t.spark, model(t, DEPTH))
    return rnd(rnd(rnd(d, 4, "F"), 1, "df2"), 7, "p")


@query("mix_16_balanced_effects", f"SELECT plot, {r('(p - g) / stddev_samp(p) OVER ()', 6)} AS scaled FROM (SELECT plot, any_value(p) AS p, any_value(g) AS g FROM {_PARTS} GROUP BY 1)")
def _(t):
    return rnd(mx.random_effects(balanced(t), model(t, DEPTH)).select("plot", "scaled"), 6, "scaled")


_FITTED = f"(SELECT *, dd + {K} * tau2 / (s2 + {K} * tau2) * (p - g) AS fitted FROM {_PARTS}, (SELECT s2, tau2 FROM {_BY_DEPTH}))"


@query("mix_16_balanced_fitted", f"SELECT depth, {r('avg(fitted)', 6)} AS mean, {r('stddev_samp(fitted)', 5)} AS sd, {r('avg(power((y - fitted), 2) / s2)', 4)} AS ms_std_resid FROM {_FITTED} GROUP BY 1")
def _(t):
    d = mx.fitted_rows(balanced(t), model(t, DEPTH)).groupBy("depth")
    d = d.agg(F.avg("fitted").alias("mean"), F.stddev_samp("fitted").alias("sd"), F.avg(F.col("std_resid") * F.col("std_resid")).alias("ms_std_resid"))
    return rnd(rnd(rnd(d, 6, "mean"), 5, "sd"), 4, "ms_std_resid")


@query("mix_17_balanced_performance", f"SELECT {r('sqrt(avg(power(y - dd, 2)))', 6)} AS rmse_marginal, {r('sqrt(avg(power(y - fitted, 2)))', 5)} AS rmse_conditional FROM {_FITTED}")
def _(t):
    rows = mx.fitted_rows(balanced(t), model(t, DEPTH))
    rmse = [s.metrics(rows.select(F.col("y").alias("obs"), F.col(c).alias("pred"))).select(F.col("rmse").alias(n)) for c, n in (("fixed", "rmse_marginal"), ("fitted", "rmse_conditional"))]
    return rnd(rnd(s.join_groups(rmse[0], rmse[1], []), 6, "rmse_marginal"), 5, "rmse_conditional")


@query("mix_18_balanced_spread", f"SELECT depth, {r('stddev_samp(y - fitted)', 5)} AS sd FROM {_FITTED} GROUP BY 1")
def _(t):
    rows = mx.fitted_rows(balanced(t), model(t, DEPTH)).withColumn("e", F.col("y") - F.col("fitted"))
    return rnd(s.spread_by_group(rows, "e", "depth").select("depth", "sd"), 5, "sd")


# values without their plot's mean have no plot variance: the fit must end on the boundary and say so
@query("mix_22_balanced_boundary", f"SELECT 'all' AS grp, 0e0 AS variance, true AS at_boundary UNION ALL SELECT 'residual', {r('ssw / (n - 1)', 5)}, false FROM {_SQUARES}")
def _(t):
    rows = balanced(t)
    level = rows.groupBy("plot").agg(F.avg("y").alias("level"))
    centred = rows.join(level, "plot").withColumn("y", F.col("y") - F.col("level"))
    f = mx.fit(mx.collect_sums(centred, PLAIN), [], "A")
    return rnd(mx.variance_table(t.spark, f).select("grp", "variance", "at_boundary"), 5, "variance")
