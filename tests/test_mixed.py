"""Mixed models against dense matrices and closed forms."""

import itertools

import numpy as np
import pandas as pd
import pytest

from terrastat.operators import contrasts as ct
from terrastat.operators import mixed as mx

SITES, COVERS, DEPTHS = ["CH", "SE", "NW"], ["G", "F", "S"], [1, 2, 3, 4]
DESIGN = mx.Design(SITES, COVERS, DEPTHS, [-1.5, -0.5, 0.5, 1.5])


def survey(seed=1, plots=90, gaps=0.1):
    rng = np.random.default_rng(seed)
    out = []
    for p in range(plots):
        s, c = p % 3, (p // 3) % 3
        b0, b1 = rng.normal() * (0.1, 0.2, 0.15)[s], rng.normal() * (0.02, 0.05, 0.03)[s]
        for d, x in zip(DEPTHS, DESIGN.codes):
            if rng.random() >= gaps:
                out.append((f"p{p}", SITES[s], COVERS[c], d, 0.5 + 0.1 * s - 0.05 * c * s - 0.02 * d + b0 + b1 * x + rng.normal() * 0.05))
    return pd.DataFrame(out, columns=["plot", "site", "lc", "depth", "y"])


@pytest.fixture(scope="module")
def data(spark):
    p = survey()
    d = spark.createDataFrame(p)
    return p, d, mx.collect_sums(d, DESIGN)


def dense(p, terms, rel, reml):
    x = mx.cell_matrix(DESIGN, terms)
    at = [SITES.index(s) * 12 + COVERS.index(c) * 4 + DEPTHS.index(d) for s, c, d in zip(p.site, p.lc, p.depth)]
    xx, y, v = x[at], p.y.to_numpy(), np.eye(len(p))
    for _plot, g in p.groupby("plot"):
        z = np.column_stack([np.ones(len(g)), [DESIGN.codes[DEPTHS.index(d)] for d in g.depth]])
        r = rel[SITES.index(g.site.iloc[0])]
        v[np.ix_(g.index, g.index)] += z @ r @ r.T @ z.T
    vi = np.linalg.inv(v)
    a = xx.T @ vi @ xx
    b = np.linalg.solve(a, xx.T @ vi @ y)
    free = len(y) - (x.shape[1] if reml else 0)
    s2 = (y - xx @ b) @ vi @ (y - xx @ b) / free
    dev = free * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0)
    return dev, b, s2


@pytest.mark.parametrize("structure", ["A", "B", "C", "D", "E"])
@pytest.mark.parametrize("reml", [True, False])
def test_likelihood_from_sums_equals_dense_matrices(data, structure, reml):
    p, _d, sums = data
    rng = np.random.default_rng(2)
    rel = mx.relative_factor(structure, rng.uniform(0.1, 2, mx.n_random(structure, 3)), 3)
    x = mx.cell_matrix(DESIGN, mx.FIXED["M3"])
    dev, beta, _xvx, s2 = mx._profile(sums, x, rel, reml)
    want = dense(p, mx.FIXED["M3"], rel, reml)
    assert dev == pytest.approx(want[0], abs=1e-8) and beta == pytest.approx(want[1], abs=1e-9) and s2 == pytest.approx(want[2], rel=1e-9)


def test_optimum_is_a_minimum_and_structures_are_nested(data):
    _p, _d, sums = data
    fits = {c: mx.fit(sums, mx.FIXED["M3"], c) for c in "ABCDE"}
    assert all(f.converged for f in fits.values())
    ll = {c: f.loglik for c, f in fits.items()}
    assert ll["A"] <= ll["B"] + 1e-6 and ll["A"] <= ll["C"] + 1e-6 and ll["C"] <= ll["D"] + 1e-6 and ll["D"] <= ll["E"] + 1e-6 and ll["B"] <= ll["E"] + 1e-6
    f = fits["E"]
    x = mx.cell_matrix(DESIGN, mx.FIXED["M3"])
    rng = np.random.default_rng(0)
    rel = np.linalg.cholesky(f.random / f.sigma2 + 1e-12 * np.eye(2))
    for _ in range(20):
        moved = rel + np.tril(rng.normal(0, 0.05, rel.shape))
        assert mx._profile(sums, x, moved, True)[0] >= -2 * f.loglik - 1e-6
    assert [fits[c].n_params - len(fits[c].beta) - 1 for c in "ABCDE"] == [1, 3, 3, 6, 9]


def test_no_random_effects_is_least_squares(data):
    p, _d, sums = data
    f = mx.fit(sums, mx.FIXED["M1"], "N")
    x = mx.cell_matrix(DESIGN, mx.FIXED["M1"])
    at = [SITES.index(s) * 12 + COVERS.index(c) * 4 + DEPTHS.index(d) for s, c, d in zip(p.site, p.lc, p.depth)]
    b, rss, _r, _s = np.linalg.lstsq(x[at], p.y.to_numpy(), rcond=None)
    assert f.beta == pytest.approx(b, abs=1e-9) and f.sigma2 == pytest.approx(rss[0] / (len(p) - x.shape[1]))


def test_balanced_one_way_components(spark):
    p = survey(3, gaps=0.0)
    sums = mx.collect_sums(spark.createDataFrame(p), DESIGN)
    f = mx.fit(sums, [], "A")
    k, g = len(DEPTHS), p.groupby("plot").y
    msb = k * g.mean().var(ddof=1)
    msw = ((p.y - g.transform("mean")) ** 2).sum() / (len(p) - g.ngroups)
    assert f.sigma2 == pytest.approx(msw, rel=1e-4) and f.random[0, 0, 0] == pytest.approx((msb - msw) / k, rel=1e-3)
    assert mx.icc(f) == pytest.approx(f.random[0, 0, 0] / (f.random[0, 0, 0] + f.sigma2))


def test_random_effects_are_posterior_means(data):
    p, d, sums = data
    f = mx.fit(sums, mx.FIXED["M3"], "E")
    got = mx.fitted_rows(d, f).toPandas().set_index(["plot", "depth"])
    for plot, g in p.groupby("plot"):
        z = np.column_stack([np.ones(len(g)), [DESIGN.codes[DEPTHS.index(x)] for x in g.depth]])
        cov = f.random[SITES.index(g.site.iloc[0])]
        part = got.loc[plot].loc[list(g.depth)]
        v = z @ cov @ z.T + f.sigma2 * np.eye(len(g))
        b = cov @ z.T @ np.linalg.solve(v, g.y.to_numpy() - part.fixed.to_numpy())
        assert part.fitted.to_numpy() == pytest.approx(part.fixed.to_numpy() + z @ b, abs=1e-9)


def test_unmapped_level_is_an_error(spark):
    p = survey(plots=9)
    p.loc[0, "site"] = "??"
    with pytest.raises(ValueError):
        mx.collect_sums(spark.createDataFrame(p), DESIGN)


def test_design_columns_equal_the_cell_matrix(data):
    p, d, _s = data
    x = mx.cell_matrix(DESIGN, mx.FIXED["M5"])
    names = mx.column_names(DESIGN, mx.FIXED["M5"])
    got = mx.design_columns(d, DESIGN, mx.FIXED["M5"]).toPandas()
    at = [SITES.index(s) * 12 + COVERS.index(c) * 4 + DEPTHS.index(k) for s, c, k in zip(got.site, got.lc, got.depth)]
    assert (got[names].to_numpy() == x[at]).all()


# ------------------------------------------------------------------ contrasts


def test_means_contrasts_and_joint_tests(spark, data):
    _p, _d, sums = data
    f = mx.fit(sums, mx.FIXED["M3"], "D")
    cells = list(itertools.product(SITES, COVERS, DEPTHS))

    def vec(**kw):
        m = np.array([all(dict(zip(mx.FACTORS, c))[k] == v for k, v in kw.items()) for c in cells])
        return (m / m.sum()) @ f.x

    means = ct.marginal_means(spark, DESIGN, {"M3": f}, ct.effect_sets(), 80).toPandas()
    for r in means.itertuples():
        kw = {r.x_var: int(r.x_level) if r.x_var == "depth" else r.x_level}
        if r.facet_var:
            kw[r.facet_var] = r.panel
        v = vec(**kw)
        assert r.emm == pytest.approx(v @ f.beta) and r.se == pytest.approx(np.sqrt(v @ f.cov @ v))
        assert r.ci_high - r.emm == pytest.approx(r.emm - r.ci_low)
    pairs = ct.pairwise(spark, DESIGN, {"M3": f}, ct.pairwise_families(), 80).toPandas()
    assert len(pairs) == 3 + 3 + 6 + 3 * 3 + 3 * 6 + 3 * 3 + 4 * 3
    one = pairs[(pairs.spec == "Land cover within site") & (pairs.panel == "SE") & (pairs.a == "G") & (pairs.b == "S")].iloc[0]
    v = vec(site="SE", lc="G") - vec(site="SE", lc="S")
    assert one.estimate == pytest.approx(v @ f.beta) and one.se == pytest.approx(np.sqrt(v @ f.cov @ v))
    assert (pairs.p_holm >= pairs.p - 1e-15).all()
    tests = ct.joint_tests(spark, DESIGN, {"M3": f}, [("x", ("site",), "lc", "M3")], 80).toPandas().set_index("panel")
    lv = np.array([vec(site="NW", lc=c) - vec(site="NW", lc="G") for c in COVERS[1:]])
    want = (lv @ f.beta) @ np.linalg.solve(lv @ f.cov @ lv.T, lv @ f.beta) / 2
    assert tests.loc["NW", "F"] == pytest.approx(want) and tests.loc["NW", "df1"] == 2


def test_degrees_of_freedom_of_independent_rows(spark, data):
    """Without random effects every contrast has the residual degrees of freedom, under REML."""
    _p, _d, sums = data
    f = mx.fit(sums, mx.FIXED["M3"], "N")
    got = ct.pairwise(spark, DESIGN, {"M3": f}, ct.pairwise_families(), ct.SATTERTHWAITE).toPandas()
    assert got.df.to_numpy() == pytest.approx(sums.n_obs - len(f.beta), rel=1e-5)
    joint = ct.joint_tests(spark, DESIGN, {"M3": f}, [("x", ("site",), "lc", "M3")], ct.SATTERTHWAITE).toPandas()
    assert joint.df2.to_numpy() == pytest.approx(sums.n_obs - len(f.beta), rel=1e-5)


def test_degrees_of_freedom_between_and_within_plots(spark):
    """Balanced random intercept: differences of plots use the plots, differences inside plots the rest."""
    p = survey(7, gaps=0.0)
    sums = mx.collect_sums(spark.createDataFrame(p), DESIGN)
    f = mx.fit(sums, mx.FIXED["M3"], "A")
    got = ct.pairwise(spark, DESIGN, {"M3": f}, ct.pairwise_families(), ct.SATTERTHWAITE).toPandas()
    between = sums.n_plots - len(SITES) * len(COVERS)
    assert got[got.x_var == "lc"].df.to_numpy() == pytest.approx(between, rel=1e-3)
    within = sums.n_obs - sums.n_plots - len(SITES) * (len(DEPTHS) - 1)
    assert got[got.x_var == "depth"].df.to_numpy() == pytest.approx(within, rel=1e-3)
    terms = ct.term_tests(spark, f).toPandas().set_index("term")
    assert terms.loc["site x lc", "df1"] == 4 and terms.loc["site x lc", "df2"] == pytest.approx(between, rel=1e-3)
    assert terms.loc["site x depth", "df1"] == 6 and terms.loc["site x depth", "df2"] == pytest.approx(within, rel=1e-3)


def test_letters_are_shared_exactly_by_levels_that_do_not_differ():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(2, 7))
        levels = [f"L{i}" for i in range(n)]
        means = dict(zip(levels, rng.normal(size=n)))
        differ = {frozenset(p) for p in itertools.combinations(levels, 2) if rng.random() < 0.5}
        got = ct.letter_groups(levels, means, differ)
        for a, b in itertools.combinations(levels, 2):
            assert bool(set(got[a]) & set(got[b])) == (frozenset((a, b)) not in differ)
        assert "a" in got[max(levels, key=means.get)]


# Published means and letters of one panel (covers in the north-west).
def test_published_letter_pattern():
    means = {"Grassland": 0.4503, "Forest": 0.4237, "Shrubland": 0.3685, "Reforestation": 0.3657}
    differ = {frozenset(("Grassland", "Shrubland")), frozenset(("Grassland", "Reforestation"))}
    assert ct.letter_groups(list(means), means, differ) == {"Grassland": "a", "Forest": "ab", "Shrubland": "b", "Reforestation": "b"}


def test_annotations_cover_every_panel_and_level(spark, data):
    _p, d, sums = data
    fits = {m: mx.fit(sums, mx.FIXED[m], "D") for m in ("M3", "M4")}
    got = ct.annotations(d, DESIGN, fits, ct.panel_specs(), 80).toPandas()
    assert len(got) == 3 + 3 + 4 + 9 + 9 + 12 + 12 + 12 + 12
    assert (got.letter != "").all() and (got.n_samples > 0).all() and (got.df2 == 80).all()
    assert set(got[got.model == "M4"].figure) == {"lc_within_depth", "depth_within_lc"}


def test_three_holm_families_grow(spark, data):
    _p, _d, sums = data
    got = ct.triple_pairs(spark, DESIGN, mx.fit(sums, mx.FIXED["M5"], "D"), 80).toPandas()
    assert len(got) == 3 * 4 * 3
    assert (got.p_holm_cell <= got.p_holm_site + 1e-12).all() and (got.p_holm_site <= got.p_holm_all + 1e-12).all()


def test_reference_contrasts_and_cells(spark, data):
    _p, _d, sums = data
    tests, cells = ct.cover_against_reference(spark, DESIGN, mx.fit(sums, mx.FIXED["M5"], "D"), 80)
    t, c = tests.toPandas(), cells.toPandas().set_index(["site", "lc", "depth"])
    assert len(t) == 3 * 2 * 4 and len(c) == 36
    r = t.iloc[0]
    assert r.estimate == pytest.approx(c.loc[(r.site, r.lc, r.depth), "emm"] - c.loc[(r.site, "G", r.depth), "emm"])
    assert (t.ci_low <= t.estimate).all() and (t.estimate <= t.ci_high).all()


def test_likelihood_ratio_and_criteria(spark, data):
    _p, _d, sums = data
    ml = {m: mx.fit(sums, mx.FIXED[m], "D", reml=False) for m in ("M0", "M3")}
    row = mx.lr_table(spark, [("x", ml["M3"], ml["M0"])]).first()
    assert row["df"] == 2 * 2 + 2 * 3 and row["chi2"] == pytest.approx(2 * (ml["M3"].loglik - ml["M0"].loglik))
    crit = mx.criteria_table(spark, ml).toPandas().set_index("model")
    assert crit.delta_aic.min() == 0 and crit.loc["M3", "aic"] == pytest.approx(ml["M3"].aic)
    assert mx.retained_structure(ml) == crit.aic.idxmin() and mx.retained_structure(ml, "M0") == "M0"
