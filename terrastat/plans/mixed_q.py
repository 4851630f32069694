"""Mixed models, marginal means and contrasts.

Statements exist where a plain linear model gives the same answer in closed
form: with one coefficient per cell the fitted values are the cell means and
the covariance is the residual variance over the cell counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.config import DEPTH_SD_RATIO_LIMIT
from terrastat.operators import contrasts as ct
from terrastat.operators import mixed as mx
from terrastat.operators import summary as s
from terrastat.operators.prep import missing_cells, slope_levels
from terrastat.plans.data import COVERS, DEPTHS, DESIGN, MID_CM, SAMPLES, SITES, samples
from terrastat.plans.registry import Tables, query, r, rnd
from terrastat.session import cut_lineage, local_table

K = len(SITES) * len(COVERS) * len(DEPTHS)
BETWEEN = len(SITES) * len(COVERS)  # between-plot coefficients: the df of the t tests are plots minus these


def clustered(t: Tables):
    """Samples whose plots differ in level and in slope over depth, by their order's amounts."""
    d = samples(t, "o_totalprice", "o_custkey")
    y = F.col("y") + F.col("o_totalprice") / 10000.0 + (F.col("depth") - 4) * (F.col("o_custkey") % 97) / 20.0
    return d.select("plot", "site", "lc", "depth", y.alias("y"))


def sums(t):
    return mx.collect_sums(clustered(t), DESIGN)


def plain(t):
    """Sums of the unclustered response and the cell-mean model without random effects."""
    got = mx.collect_sums(samples(t), DESIGN)
    return got, mx.fit(got, mx.FIXED["M5"], "N", reml=True)


def df2(got: mx.Sums) -> float:
    return float(got.n_plots - BETWEEN)


_CELL = f"(SELECT site, lc, depth, count(*) AS n, avg(y) AS m FROM {SAMPLES} GROUP BY 1, 2, 3)"
_S2 = f"(SELECT sum(power(y - m, 2)) / (sum(1) - {K}) AS s2, sum(power(y - m, 2)) AS sse, sum(1) AS nobs FROM (SELECT y, avg(y) OVER (PARTITION BY site, lc, depth) AS m FROM {SAMPLES}))"
_PLOTS = f"(SELECT count(DISTINCT plot) AS nplots FROM {SAMPLES})"


@query(
    "mix_01_design_matrix",
    f"""SELECT depth, sum(1)::DOUBLE AS intercept, sum(CAST(site = 'O' AS INTEGER))::DOUBLE AS "site[O]", sum(CAST(lc = '3-MEDIUM' AS INTEGER))::DOUBLE AS "lc[3-MEDIUM]", sum(CAST(depth = 5 AS INTEGER))::DOUBLE AS "depth[5]",
sum(CAST(site = 'P' AND lc = '5-LOW' AS INTEGER))::DOUBLE AS "site[P]:lc[5-LOW]", sum(CAST(site = 'O' AND lc = '2-HIGH' AND depth = 4 AS INTEGER))::DOUBLE AS "site[O]:lc[2-HIGH]:depth[4]" FROM {SAMPLES} GROUP BY depth""",
)
def _(t):
    x = mx.design_columns(samples(t), DESIGN, mx.FIXED["M5"])
    names = ["intercept", "site[O]", "lc[3-MEDIUM]", "depth[5]", "site[P]:lc[5-LOW]", "site[O]:lc[2-HIGH]:depth[4]"]
    return x.groupBy("depth").agg(*[F.sum(f"`{n}`").alias(n) for n in names])


@query("mix_02_fixed_effects")
def _(t):
    return mx.coefficient_table(t.spark, mx.fit(sums(t), mx.FIXED["M3"], "E"))


@query("mix_02_variances")
def _(t):
    return mx.variance_table(t.spark, mx.fit(sums(t), mx.FIXED["M3"], "E"))


@query(
    "mix_02_cell_model",
    f"SELECT site, lc, depth, {r('m', 6)} AS fixed FROM {_CELL}",
)
def _(t):
    return rnd(mx.cell_predictions(t.spark, plain(t)[1]), 6, "fixed")


def _criteria(name: str, sse: str, k: int) -> str:
    ll = f"(-nobs / 2e0 * (ln(2 * pi() * {sse} / nobs) + 1))"
    return f"SELECT '{name}' AS model, {k} AS k, {ll} AS ll, nobs, nplots FROM {_S2}, {_SST}, {_PLOTS}"


_SST = f"(SELECT sum(power(y - m, 2)) AS sst FROM (SELECT y, avg(y) OVER () AS m FROM {SAMPLES}))"
_BOTH = f"({_criteria('cells', 'sse', K + 1)} UNION ALL {_criteria('mean', 'sst', 2)})"


@query(
    "mix_03_information_criteria",
    f"SELECT model, {r('ll', 4)} AS loglik, {r('-2 * ll + 2 * k', 4)} AS aic, {r('-2 * ll + ln(nobs) * k', 4)} AS bic_nobs, {r('-2 * ll + ln(nplots) * k', 4)} AS bic_nplots, {r('-2 * ll + 2 * k - min(-2 * ll + 2 * k) OVER ()', 4)} AS delta_aic FROM {_BOTH}",
)
def _(t):
    got = mx.collect_sums(samples(t), DESIGN)
    fits = {"cells": mx.fit(got, mx.FIXED["M5"], "N", False), "mean": mx.fit(got, [], "N", False)}
    cols = ["loglik", "aic", "bic_nobs", "bic_nplots", "delta_aic"]
    return rnd(mx.criteria_table(t.spark, fits).select("model", *cols), 4, *cols)


@query("mix_04_random_structures")
def _(t):
    got = sums(t)
    return mx.criteria_table(t.spark, {c: mx.fit(got, mx.FIXED["M3"], c, reml=False) for c in "ABCD"})


@query("mix_04_random_structures_reml")
def _(t):
    got = sums(t)
    fits = {c: mx.fit(got, mx.FIXED["M3"], c, reml=True) for c in "ABCDE"}
    kept = mx.retained_structure(fits)
    return mx.criteria_table(t.spark, fits).withColumn("retained", F.col("model") == kept)


@query("mix_05_fixed_candidates")
def _(t):
    got = sums(t)
    return mx.criteria_table(t.spark, {m: mx.fit(got, terms, "D", reml=False) for m, terms in mx.FIXED.items()})


def _lrt(got, structure: str, triple_against: str):
    ml = {m: mx.fit(got, terms, structure, reml=False) for m, terms in mx.FIXED.items()}
    return [
        ("site x lc", ml["M3"], ml["M2"]),
        ("site x depth", ml["M3"], ml["M1"]),
        ("lc x depth", ml["M4"], ml["M3"]),
        ("site x lc x depth", ml["M5"], ml[triple_against]),
    ]


@query("mix_06_likelihood_ratio")
def _(t):
    return mx.lr_table(t.spark, _lrt(sums(t), "D", "M3"))


@query("mix_06_likelihood_ratio_nested")
def _(t):
    return mx.lr_table(t.spark, _lrt(sums(t), "E", "M4"))


# even degrees of freedom: the chi-square tail is a finite Poisson sum
@query(
    "mix_06_cells_against_mean",
    f"SELECT {r('x', 4)} AS chi2, {K - 1} AS df, {r('sum(exp(-x / 2 + i * ln(x / 2) - lgamma(i + 1)))', 8)} AS p FROM (SELECT nobs * ln(sst / sse) AS x FROM {_S2}, {_SST}), range(0, {(K - 1) // 2}) AS g(i) GROUP BY x",
)
def _(t):
    got = mx.collect_sums(samples(t), DESIGN)
    d = mx.lr_table(t.spark, [("cells", mx.fit(got, mx.FIXED["M5"], "N", False), mx.fit(got, [], "N", False))])
    return rnd(rnd(d.drop("term"), 4, "chi2"), 8, "p")


@query("mix_07_r_squared")
def _(t):
    return mx.r_squared(clustered(t), mx.fit(sums(t), mx.FIXED["M3"], "D"))


@query(
    "mix_07_r_squared_cells",
    f"SELECT {r('vf', 8)} AS var_fixed, {r('s2', 6)} AS var_resid, {r('vf / (vf + s2)', 8)} AS r2_marginal FROM {_S2}, (SELECT var_pop(m) AS vf FROM (SELECT avg(y) OVER (PARTITION BY site, lc, depth) AS m FROM {SAMPLES}))",
)
def _(t):
    _got, f = plain(t)
    d = mx.r_squared(samples(t), f).select("var_fixed", "var_resid", "r2_marginal")
    return rnd(rnd(d, 8, "var_fixed", "r2_marginal"), 6, "var_resid")


@query("mix_08_icc")
def _(t):
    return local_table(t.spark, [(mx.icc(mx.fit(sums(t), [], "A")),)], "icc double")


def _means(by: str, panel: str, level: str, other: str) -> str:
    """Marginal means over ``other`` with equal weights, and their variance over the residual variance."""
    return f"(SELECT '{panel}' AS spec, {by} AS panel, CAST({level} AS VARCHAR) AS x_level, avg(m) AS emm, sum(1e0 / n) / (count(*) * count(*)) AS v FROM {_CELL} GROUP BY 2, 3)"


_EMM = {
    "Site": _means("'All'", "Site", "site", "lc, depth"),
    "Land cover": _means("'All'", "Land cover", "lc", "site, depth"),
    "Depth": _means("'All'", "Depth", "depth", "site, lc"),
    "Site x Land cover": _means("site", "Site x Land cover", "lc", "depth"),
    "Site x Depth": _means("site", "Site x Depth", "depth", "lc"),
}
_ALL = "(" + " UNION ALL ".join(f"SELECT * FROM {v}" for v in _EMM.values()) + ")"


@query("mix_09_marginal_means_cells", f"SELECT spec, panel, x_level, {r('emm', 6)} AS emm, {r('sqrt(v * s2)', 6)} AS se FROM {_ALL}, {_S2}")
def _(t):
    got, f = plain(t)
    d = ct.marginal_means(t.spark, DESIGN, {"M5": f}, ct.effect_sets("M5"), df2(got))
    return rnd(d.select("spec", "panel", "x_level", "emm", "se"), 6, "emm", "se")


@query("mix_09_marginal_means")
def _(t):
    got = sums(t)
    return ct.marginal_means(t.spark, DESIGN, {"M3": mx.fit(got, mx.FIXED["M3"], "D")}, ct.effect_sets(), df2(got))


_PAIR = f"(SELECT a.spec, a.panel, a.x_level AS a, b.x_level AS b, a.emm - b.emm AS estimate, sqrt((a.v + b.v) * s2) AS se FROM {_ALL} a JOIN {_ALL} b ON a.spec = b.spec AND a.panel = b.panel AND a.x_level < b.x_level, {_S2})"


@query("mix_10_contrasts_cells", f"SELECT spec, panel, a, b, {r('estimate', 6)} AS estimate, {r('se', 6)} AS se FROM {_PAIR}")
def _(t):
    got, f = plain(t)
    d = ct.pairwise(t.spark, DESIGN, {"M5": f}, ct.effect_sets("M5"), df2(got))
    return rnd(d.select("spec", "panel", "a", "b", "estimate", "se"), 6, "estimate", "se")


@query("mix_10_contrasts")
def _(t):
    got = sums(t)
    return ct.pairwise(t.spark, DESIGN, {"M3": mx.fit(got, mx.FIXED["M3"], "D")}, ct.effect_sets(), df2(got))


@query("mix_10_satterthwaite_contrasts")
def _(t):
    return ct.pairwise(t.spark, DESIGN, {"M3": mx.fit(sums(t), mx.FIXED["M3"], "D")}, ct.effect_sets(), ct.SATTERTHWAITE)


@query("mix_06_interaction_f")
def _(t):
    return ct.term_tests(t.spark, mx.fit(sums(t), mx.FIXED["M3"], "D"))


# independent means: the joint test is their weighted spread; four numerator df have a closed tail
@query(
    "mix_11_joint_test_cells",
    f"""SELECT panel, {r('f', 6)} AS F, 4e0 AS df1, d AS df2, {r('power(d / (d + 4 * f), d / 2) * (1 + d / 2 * (1 - d / (d + 4 * f)))', 8)} AS p_panel FROM
(SELECT panel, (sum(emm * emm / (v * s2)) - power(sum(emm / (v * s2)), 2) / sum(1 / (v * s2))) / 4 AS f, CAST(any_value(nplots) - {BETWEEN} AS DOUBLE) AS d FROM {_EMM['Site x Land cover']}, {_S2}, {_PLOTS} GROUP BY 1)""",
)
def _(t):
    got, f = plain(t)
    d = ct.joint_tests(t.spark, DESIGN, {"M5": f}, [("x", ("site",), "lc", "M5")], df2(got))
    return rnd(rnd(d.select("panel", "F", "df1", "df2", "p_panel"), 6, "F"), 8, "p_panel")


@query("mix_11_joint_tests")
def _(t):
    got = sums(t)
    specs = [("Land cover within site", ("site",), "lc", "M3"), ("Depth within site", ("site",), "depth", "M3")]
    return ct.joint_tests(t.spark, DESIGN, {"M3": mx.fit(got, mx.FIXED["M3"], "D")}, specs, df2(got))


@query("mix_11_satterthwaite_tests")
def _(t):
    specs = [("Land cover within site", ("site",), "lc", "M3"), ("Depth within site", ("site",), "depth", "M3")]
    return ct.joint_tests(t.spark, DESIGN, {"M3": mx.fit(sums(t), mx.FIXED["M3"], "D")}, specs, ct.SATTERTHWAITE)


@query("mix_12_pairwise_families")
def _(t):
    got = sums(t)
    fits = {m: mx.fit(got, mx.FIXED[m], "D") for m in ("M3", "M4")}
    return ct.pairwise(t.spark, DESIGN, fits, ct.pairwise_families("M3", "M4"), df2(got))


@query(
    "mix_12_site_families_cells",
    f"SELECT 'Site within land cover' AS spec, a.panel, a.x_level AS a, b.x_level AS b, {r('a.emm - b.emm', 6)} AS estimate, {r('sqrt((a.v + b.v) * s2)', 6)} AS se FROM {_means('lc', 'x', 'site', 'depth')} a JOIN {_means('lc', 'x', 'site', 'depth')} b ON a.panel = b.panel AND a.x_level < b.x_level, {_S2}",
)
def _(t):
    got, f = plain(t)
    fam = [x for x in ct.pairwise_families("M5") if x[0] == "Site within land cover"]
    d = ct.pairwise(t.spark, DESIGN, {"M5": f}, fam, df2(got))
    return rnd(d.select("spec", "panel", "a", "b", "estimate", "se"), 6, "estimate", "se")


@query("mix_13_letters")
def _(t):
    got = sums(t)
    fits, specs = {"M3": mx.fit(got, mx.FIXED["M3"], "D")}, ct.pairwise_families()
    return ct.letters(ct.marginal_means(t.spark, DESIGN, fits, specs, df2(got)), ct.pairwise(t.spark, DESIGN, fits, specs, df2(got)))


@query(
    "mix_14_cover_against_reference_cells",
    f"SELECT a.site, CAST(a.depth AS VARCHAR) AS depth, a.lc || ' - ' || b.lc AS contrast, {r('a.m - b.m', 6)} AS estimate, {r('sqrt(s2 / a.n + s2 / b.n)', 6)} AS se FROM {_CELL} a JOIN {_CELL} b ON a.site = b.site AND a.depth = b.depth AND b.lc = '1-URGENT' AND a.lc <> '1-URGENT', {_S2}",
)
def _(t):
    got, f = plain(t)
    tests, _m = ct.cover_against_reference(t.spark, DESIGN, f, df2(got))
    return rnd(tests.select("site", "depth", "contrast", "estimate", "se"), 6, "estimate", "se")


@query("mix_14_cover_against_reference")
def _(t):
    got = sums(t)
    return ct.cover_against_reference(t.spark, DESIGN, mx.fit(got, mx.FIXED["M5"], "D"), df2(got))[0]


def _t_p(t: str, nu: str) -> str:
    """Two-sided tail of Student t as the finite sum it is for whole degrees of freedom."""
    c2 = f"(ln({nu}) - ln({nu} + power({t}, 2)))"
    sine = f"abs({t}) / sqrt({nu} + power({t}, 2))"
    even = f"{sine} * list_sum([exp(lgamma(k + 0.5e0) - lgamma(k + 1) + k * {c2}) FOR k IN range(0, CAST({nu} / 2 AS BIGINT))]) / sqrt(pi())"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({nu})) + {sine} * exp({c2} / 2) * sqrt(pi()) / 2 * list_sum([exp(lgamma(k + 1) - lgamma(k + 1.5e0) + k * {c2}) FOR k IN range(0, CAST(({nu} - 1) / 2 AS BIGINT))]))"
    return f"greatest(0, 1 - CASE WHEN CAST({nu} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END)"


def _holm_sql(p: str, family: str, tie: str) -> str:
    """Step-down p inside a family, from a column that holds p."""
    return f"least(1, max(step) OVER (PARTITION BY {family} ORDER BY {p}, {tie} ROWS UNBOUNDED PRECEDING))"


def _holm_column(source: str, name: str, family: str, tie: str) -> str:
    steps = f"(SELECT *, (count(*) OVER (PARTITION BY {family}) - row_number() OVER (PARTITION BY {family} ORDER BY p, {tie}) + 1) * p AS step FROM {source})"
    return f"(SELECT * EXCLUDE (step), {_holm_sql('p', family, tie)} AS {name} FROM {steps})"


_TRIPLES = f"(SELECT *, {_t_p('(estimate / se)', 'nu')} AS p FROM (SELECT a.site, CAST(a.depth AS VARCHAR) AS depth, a.lc || ' - ' || b.lc AS contrast, a.m - b.m AS estimate, sqrt(s2 / a.n + s2 / b.n) AS se, CAST(nplots - {BETWEEN} AS DOUBLE) AS nu FROM {_CELL} a JOIN {_CELL} b ON a.site = b.site AND a.depth = b.depth AND a.lc < b.lc, {_S2}, {_PLOTS}))"
_TRIPLES = _holm_column(_TRIPLES, "p_holm_cell", "site, depth", "contrast")
_TRIPLES = _holm_column(_TRIPLES, "p_holm_site", "site", "depth, contrast")
_TRIPLES = _holm_column(_TRIPLES, "p_holm_all", "1", "site, depth, contrast")
_HOLMS = ["p", "p_holm_cell", "p_holm_site", "p_holm_all"]


@query("mix_15_cover_pairs_cells", f"SELECT site, depth, contrast, {r('estimate', 6)} AS estimate, {', '.join(f'{r(c, 7)} AS {c}' for c in _HOLMS)} FROM {_TRIPLES}")
def _(t):
    got, f = plain(t)
    d = ct.triple_pairs(t.spark, DESIGN, f, df2(got)).select("site", "depth", "contrast", "estimate", *_HOLMS)
    return rnd(rnd(d, 6, "estimate"), 7, *_HOLMS)


# three levels ordered by their means: who differs from whom leaves one way to share letters
_SITES = " UNION ALL ".join(f"SELECT * FROM {m}" for m in (_means("'All'", "Site", "site", "lc, depth"), _means("lc", "Site within land cover", "site", "depth"), _means("CAST(depth AS VARCHAR)", "Site within depth", "site", "lc")))
_SITE_PAIRS = f"(SELECT *, {_t_p('(estimate / se)', 'nu')} AS p FROM (SELECT a.spec, a.panel, a.x_level AS a, b.x_level AS b, a.emm - b.emm AS estimate, sqrt((a.v + b.v) * s2) AS se, CAST(nplots - {BETWEEN} AS DOUBLE) AS nu FROM ({_SITES}) a JOIN ({_SITES}) b ON a.spec = b.spec AND a.panel = b.panel AND a.x_level < b.x_level, {_S2}, {_PLOTS}))"
_SITE_PAIRS = _holm_column(_SITE_PAIRS, "p_holm", "spec, panel", "a || ' - ' || b")


@query(
    "mix_13_site_letters_cells",
    f"""WITH m AS MATERIALIZED (SELECT spec, panel, x_level, row_number() OVER (PARTITION BY spec, panel ORDER BY emm DESC) AS k FROM ({_SITES})), q AS MATERIALIZED (SELECT spec, panel, a, b, p_holm < 0.05 AS differ FROM {_SITE_PAIRS}),
d AS (SELECT q.spec, q.panel, bool_or(differ) FILTER (x.k + y.k = 3) AS d12, bool_or(differ) FILTER (x.k + y.k = 4) AS d13, bool_or(differ) FILTER (x.k + y.k = 5) AS d23 FROM q
JOIN m x ON x.spec = q.spec AND x.panel = q.panel AND x.x_level = q.a JOIN m y ON y.spec = q.spec AND y.panel = q.panel AND y.x_level = q.b GROUP BY 1, 2)
SELECT m.spec, m.panel, m.x_level, CASE k WHEN 1 THEN CASE WHEN d23 AND NOT d12 AND NOT d13 THEN 'ab' ELSE 'a' END
WHEN 2 THEN CASE WHEN NOT d12 AND d13 AND NOT d23 THEN 'ab' WHEN NOT d12 THEN 'a' ELSE 'b' END
ELSE CASE WHEN d12 AND NOT d13 AND NOT d23 THEN 'ab' WHEN d12 AND d13 AND d23 THEN 'c' WHEN NOT d13 AND (d12 OR NOT d23) THEN 'a' ELSE 'b' END END AS letter FROM m JOIN d ON d.spec = m.spec AND d.panel = m.panel""",
)
def _(t):
    got, f = plain(t)
    specs = [x for x in ct.pairwise_families("M5", "M5") if x[2] == "site"]
    return ct.letters(ct.marginal_means(t.spark, DESIGN, {"M5": f}, specs, df2(got)), ct.pairwise(t.spark, DESIGN, {"M5": f}, specs, df2(got)))


@query("mix_14_cell_means")
def _(t):
    got = sums(t)
    return ct.cover_against_reference(t.spark, DESIGN, mx.fit(got, mx.FIXED["M5"], "D"), df2(got))[1]


@query("mix_15_cover_pairs_three_holm")
def _(t):
    got = sums(t)
    return ct.triple_pairs(t.spark, DESIGN, mx.fit(got, mx.FIXED["M5"], "D"), df2(got))


@query("mix_16_random_effects")
def _(t):
    return mx.random_effects(clustered(t), mx.fit(sums(t), mx.FIXED["M3"], "D"))


@query("mix_16_fitted_rows")
def _(t):
    return mx.fitted_rows(clustered(t), mx.fit(sums(t), mx.FIXED["M3"], "D"))


def performance(rows):
    rows = cut_lineage(rows.select("y", "fixed", "fitted"))  # read several times
    long = rows.select(F.col("y").alias("obs"), F.col("fixed").alias("marginal"), F.col("fitted").alias("conditional")).unpivot(["obs"], ["marginal", "conditional"], "predictions", "pred")
    return s.metrics(long, ["predictions"]).select("predictions", "n", "sd_obs", "iqr_obs", "rmse", "rpd", "rpiq")


@query("mix_17_fit_performance")
def _(t):
    return performance(mx.fitted_rows(clustered(t), mx.fit(sums(t), mx.FIXED["M3"], "D")))


@query(
    "mix_17_fit_performance_cells",
    f"SELECT k AS predictions, nobs::BIGINT AS n, {r('sd', 6)} AS sd_obs, {r('iqr', 6)} AS iqr_obs, {r('sqrt(sse / nobs)', 6)} AS rmse, {r('sd / sqrt(sse / nobs)', 8)} AS rpd, {r('iqr / sqrt(sse / nobs)', 8)} AS rpiq FROM {_S2}, (SELECT stddev_samp(y) AS sd, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM {SAMPLES}), (VALUES ('marginal'), ('conditional')) AS v(k)",
)
def _(t):
    d = performance(mx.fitted_rows(samples(t), plain(t)[1]))
    return rnd(rnd(d, 6, "sd_obs", "iqr_obs", "rmse"), 8, "rpd", "rpiq")


def diagnostics(rows):
    """Shape of the residuals, Levene tests and spread by factor, as metric rows."""
    d = cut_lineage(rows.select("site", "lc", "depth", (F.col("y") - F.col("fitted")).alias("e")))  # read by every measure
    shape = s.shape_moments(d, "e")
    out = shape.select(F.lit("skewness").alias("metric"), F.col("skewness").alias("value")).unionByName(
        shape.select(F.lit("excess kurtosis").alias("metric"), F.col("excess_kurtosis").alias("value"))
    )
    for f in ("site", "depth"):
        out = out.unionByName(s.levene(d, "e", f).select(F.lit(f"Levene p, {f}").alias("metric"), F.col("p").alias("value")))
    for f in ("site", "depth", "lc"):
        sd = s.spread_by_group(d, "e", f).select(F.concat(F.lit(f"sd, {f} = "), F.col(f).cast("string")).alias("metric"), F.col("sd").alias("value"))
        out = out.unionByName(sd)
    ratio = s.spread_ratio(s.spread_by_group(d, "e", "depth"), DEPTH_SD_RATIO_LIMIT)
    return out.unionByName(ratio.select(F.lit("sd ratio, depth").alias("metric"), F.col("sd_ratio").alias("value")))


@query("mix_18_residual_diagnostics")
def _(t):
    return diagnostics(mx.fitted_rows(clustered(t), mx.fit(sums(t), mx.FIXED["M3"], "D")))


_RESID = f"(SELECT site, lc, depth, y - avg(y) OVER (PARTITION BY site, lc, depth) AS e FROM {SAMPLES})"
_SD = " UNION ALL ".join(f"SELECT 'sd, {f} = ' || {f} AS metric, {r('stddev_samp(e)', 6)} AS value FROM {_RESID} GROUP BY {f}" for f in ("site", "depth", "lc"))


@query("mix_18_residual_spread_cells", _SD)
def _(t):
    rows = mx.fitted_rows(samples(t), plain(t)[1]).withColumn("e", F.col("y") - F.col("fitted"))
    out = None
    for f in ("site", "depth", "lc"):
        sd = s.spread_by_group(rows, "e", f).select(F.concat(F.lit(f"sd, {f} = "), F.col(f).cast("string")).alias("metric"), F.col("sd").alias("value"))
        out = sd if out is None else out.unionByName(sd)
    return rnd(out, 6, "value")


@query("mix_19_figure_annotations")
def _(t):
    rows = cut_lineage(clustered(t))
    got = mx.collect_sums(rows, DESIGN)
    fits = {m: mx.fit(got, mx.FIXED[m], "D") for m in ("M3", "M4")}
    return ct.annotations(rows, DESIGN, fits, ct.panel_specs(), df2(got))


@query("mix_19_panel_counts", f"SELECT 'lc_within_site' AS spec, site AS panel, lc AS x_level, count(*) AS n_samples, count(DISTINCT plot) AS n_plots FROM {SAMPLES} GROUP BY 2, 3 UNION ALL SELECT 'depth_overall', 'All', CAST(depth AS VARCHAR), count(*), count(DISTINCT plot) FROM {SAMPLES} GROUP BY 3")
def _(t):
    specs = [x for x in ct.panel_specs() if x[0] in ("lc_within_site", "depth_overall")]
    return ct.panel_counts(samples(t), DESIGN, specs)


@query("mix_20_total_change_cells", f"SELECT panel, {r('estimate', 6)} AS estimate, {r('se', 6)} AS se FROM {_PAIR} WHERE spec = 'Site x Depth' AND a = '1' AND b = '7'")
def _(t):
    got, f = plain(t)
    pairs = ct.pairwise(t.spark, DESIGN, {"M5": f}, ct.pairwise_families("M5"), df2(got))
    return rnd(ct.total_change(pairs, DESIGN).select("panel", "estimate", "se"), 6, "estimate", "se")


@query("mix_21_slope_coding")
def _(t):
    rows = clustered(t)
    out = []
    for coding in ("cm", "log", "rank"):
        d = mx.Design(SITES, COVERS, DEPTHS, slope_levels(MID_CM, coding))
        f = mx.fit(mx.collect_sums(rows, d), mx.FIXED["M3"], "E")
        out.append((coding, f.aic, mx.is_singular(f)))
    best = min(a for _c, a, _s in out)
    return local_table(t.spark, [(c, a, sg, a - best) for c, a, sg in out], "coding string, aic_reml double, singular boolean, delta_aic double")


@query("mix_22_boundary_check")
def _(t):
    got = sums(t)
    f = mx.fit(got, mx.FIXED["M3"], "E")
    flagged = mx.variance_table(t.spark, f).withColumn("structure", F.lit("E"))
    if mx.is_singular(f):
        again = mx.variance_table(t.spark, mx.fit(got, mx.FIXED["M3"], "D")).withColumn("structure", F.lit("D"))
        flagged = flagged.unionByName(again)
    return flagged


@query("mix_23_run_summary")
def _(t):
    rows = cut_lineage(clustered(t))
    got = mx.collect_sums(rows, DESIGN)
    fits = {c: mx.fit(got, mx.FIXED["M3"], c) for c in "ABCDE"}
    kept = mx.retained_structure(fits)
    f = fits[kept]
    lrt = {name: p for name, _x, _d, p in mx.lr_table(t.spark, _lrt(got, kept, "M4")).collect()}
    r2 = mx.r_squared(rows, f)
    resid = cut_lineage(mx.fitted_rows(rows, f).select("depth", (F.col("y") - F.col("fitted")).alias("e")))
    shape = s.join_groups(s.shape_moments(resid, "e"), s.spread_ratio(s.spread_by_group(resid, "e", "depth")).select("sd_ratio"), [])
    gaps = missing_cells(rows, "plot", "depth", DEPTHS, []).agg(F.count(F.lit(1)).alias("missing"))
    d = s.join_groups(s.join_groups(r2, shape, []), gaps, [])
    labels = {"p_site_x_lc": "site x lc", "p_site_x_depth": "site x depth", "p_lc_x_depth": "lc x depth", "p_triple": "site x lc x depth"}
    return d.select(
        F.lit(kept).alias("structure"),
        F.lit(mx.is_singular(f)).alias("singular"),
        *[F.lit(float(lrt[v])).alias(k) for k, v in labels.items()],
        "r2_marginal",
        "r2_conditional",
        F.lit(mx.icc(mx.fit(got, [], "A"))).alias("icc"),
        "skewness",
        "excess_kurtosis",
        "sd_ratio",
        "missing",
    )
