"""Linear mixed models with plots as grouping unit.

Rows of a plot share site and cover and differ by depth only, so the likelihood
needs the rows through sums over plots of equal design: counts per depth and
their cross products with each other and with the response. Spark computes those
sums in one pass; their number depends on the design (sites x covers x depth
sets), not on the rows. The optimiser then works on them alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastat.functions.scalar import code_lookup, factor_index
from terrastat.functions.tails import chi2_tail
from terrastat.session import local_table

FACTORS = ("site", "lc", "depth")
MAIN = [("site",), ("lc",), ("depth",)]
# The candidate fixed-effect structures.
FIXED = {
    "M0": MAIN,
    "M1": [*MAIN, ("site", "lc")],
    "M2": [*MAIN, ("site", "depth")],
    "M3": [*MAIN, ("site", "lc"), ("site", "depth")],
    "M4": [*MAIN, ("site", "lc"), ("site", "depth"), ("lc", "depth")],
    "M5": [*MAIN, ("site", "lc"), ("site", "depth"), ("lc", "depth"), ("site", "lc", "depth")],
}
# Random structures. A: random intercept, common variance.
# B: random intercept and slope, correlated, common variance.
# C: random intercept, variance per site.
# D: random intercept and slope, uncorrelated, variances per site.
# E: random intercept and slope, correlated, variances per site.


@dataclass(frozen=True)
class Design:
    """Column names and declared levels (the first level is the reference)."""

    sites: Sequence
    covers: Sequence
    depths: Sequence
    codes: Sequence[float]  # slope variable of each depth level
    plot: str = "plot"
    site: str = "site"
    lc: str = "lc"
    depth: str = "depth"
    y: str = "y"

    def levels(self, factor: str) -> Sequence:
        return {"site": self.sites, "lc": self.covers, "depth": self.depths}[factor]

    def column(self, factor: str) -> str:
        return {"site": self.site, "lc": self.lc, "depth": self.depth}[factor]

    def index(self, factor: str) -> Column:
        return factor_index(self.column(factor), self.levels(factor))

    def slope(self) -> Column:
        return code_lookup(self.depth, {d: float(c) for d, c in zip(self.depths, self.codes)})


def term_levels(design: Design, terms: Sequence[tuple]) -> list[tuple[tuple[str, int], ...]]:
    """Non-reference level combinations of every term, in column order."""
    out: list[tuple[tuple[str, int], ...]] = [()]
    for term in terms:
        for combo in itertools.product(*[range(1, len(design.levels(f))) for f in term]):
            out.append(tuple(zip(term, combo)))
    return out


def column_names(design: Design, terms: Sequence[tuple]) -> list[str]:
    parts = term_levels(design, terms)
    return ["intercept" if not p else ":".join(f"{f}[{design.levels(f)[i]}]" for f, i in p) for p in parts]


def design_columns(df: DataFrame, design: Design, terms: Sequence[tuple]) -> DataFrame:
    """Treatment-coded 0/1 columns: intercept, main effects, interactions."""
    cols = []
    for name, part in zip(column_names(design, terms), term_levels(design, terms)):
        c = F.lit(1.0)
        for f, i in part:
            c = c * (F.col(design.column(f)) == F.lit(design.levels(f)[i])).cast("double")
        cols.append(c.alias(name))
    return df.select("*", *cols)


def cell_matrix(design: Design, terms: Sequence[tuple]) -> np.ndarray:
    """Design row of every site x cover x depth cell."""
    cells = itertools.product(*[range(len(design.levels(f))) for f in FACTORS])
    parts = term_levels(design, terms)
    rows = []
    for cell in cells:
        at = dict(zip(FACTORS, cell))
        rows.append([float(all(at[f] == i for f, i in p)) for p in parts])
    return np.array(rows)


# ------------------------------------------------------------- sums over rows


@dataclass
class Sums:
    """Design sums on the driver: one entry per plot pattern and per cell."""

    design: Design
    n_obs: int
    n_plots: int
    yy: float
    cell_n: np.ndarray  # sites x covers x depths
    cell_y: np.ndarray
    site: np.ndarray  # per pattern
    cover: np.ndarray
    plots: np.ndarray
    z: np.ndarray  # pattern x (n, sum of code, sum of squared code)
    cc: np.ndarray  # pattern x depth x depth: summed outer products of depth counts
    ct: np.ndarray  # pattern x depth x 2: counts times (sum y, sum code*y)
    tt: np.ndarray  # pattern x 3: squares and product of (sum y, sum code*y)

    def __post_init__(self):
        group = self.site * len(self.design.covers) + self.cover  # patterns come sorted by group
        self.bounds = np.searchsorted(group, np.arange(len(self.design.sites) * len(self.design.covers) + 1))
        self.values = np.hstack([self.cc.reshape(len(group), -1), self.ct[:, :, 0], self.ct[:, :, 1]])

    def per_group(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the pattern values of each site x cover under several weights: group x weight x value."""
        return np.stack([weights[:, lo:hi] @ self.values[lo:hi] for lo, hi in itertools.pairwise(self.bounds)])


def pattern_sums(df: DataFrame, design: Design) -> DataFrame:
    """Per site, cover and (n, Z'Z) of the plots: summed cross products."""
    k = len(design.depths)
    rows = df.select(
        F.col(design.plot).alias("plot"),
        design.index("site").alias("s"),
        design.index("lc").alias("l"),
        design.index("depth").alias("d"),
        design.slope().alias("x"),
        F.col(design.y).cast("double").alias("y"),
    )
    plots = rows.groupBy("plot", "s", "l").agg(
        *[F.count_if(F.col("d") == j).cast("double").alias(f"c{j}") for j in range(k)],
        *[F.coalesce(F.sum(F.when(F.col("d") == j, F.col("y"))), F.lit(0.0)).alias(f"y{j}") for j in range(k)],
        F.sum("y").alias("t0"),
        F.sum(F.col("x") * F.col("y")).alias("t1"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.count_if(F.col("d").isNull() | F.col("y").isNull()).alias("bad"),
    )
    codes = [float(c) for c in design.codes]
    n = sum((F.col(f"c{j}") for j in range(k)), F.lit(0.0))
    s1 = sum((F.col(f"c{j}") * codes[j] for j in range(k)), F.lit(0.0))
    s2 = sum((F.col(f"c{j}") * codes[j] ** 2 for j in range(k)), F.lit(0.0))
    keyed = plots.withColumns({"n": n, "s1": F.round(s1, 9), "s2": F.round(s2, 9)})
    c = [F.col(f"c{j}") for j in range(k)]
    t0, t1 = F.col("t0"), F.col("t1")
    return keyed.groupBy("s", "l", "n", "s1", "s2").agg(
        F.count(F.lit(1)).alias("m"),
        *[F.sum(c[i] * c[j]).alias(f"cc_{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(c[i] * t0).alias(f"ct_{i}_0") for i in range(k)],
        *[F.sum(c[i] * t1).alias(f"ct_{i}_1") for i in range(k)],
        F.sum(t0 * t0).alias("tt_0"),
        F.sum(t0 * t1).alias("tt_1"),
        F.sum(t1 * t1).alias("tt_2"),
        *[F.sum(c[j]).alias(f"n_{j}") for j in range(k)],
        *[F.sum(f"y{j}").alias(f"y_{j}") for j in range(k)],
        F.sum("yy").alias("yy"),
        F.sum("bad").alias("bad"),
    )


def collect_sums(df: DataFrame, design: Design) -> Sums:
    """Run the aggregation and hand its few rows to the optimiser."""
    k, ns, nl = len(design.depths), len(design.sites), len(design.covers)
    p = pattern_sums(df, design).toArrow().to_pandas().sort_values(["s", "l"], ignore_index=True)
    if p["bad"].sum() or p[["s", "l"]].isna().any(axis=None):
        raise ValueError("missing response or a factor value outside the declared levels")
    cell_n, cell_y = np.zeros((ns, nl, k)), np.zeros((ns, nl, k))
    s, cover = p["s"].to_numpy(int), p["l"].to_numpy(int)
    for j in range(k):
        np.add.at(cell_n[:, :, j], (s, cover), p[f"n_{j}"].to_numpy(float))
        np.add.at(cell_y[:, :, j], (s, cover), p[f"y_{j}"].to_numpy(float))
    cc = np.zeros((len(p), k, k))
    for i in range(k):
        for j in range(i, k):
            cc[:, i, j] = cc[:, j, i] = p[f"cc_{i}_{j}"]
    ct = np.stack([np.stack([p[f"ct_{i}_{e}"] for e in (0, 1)], axis=-1) for i in range(k)], axis=1)
    return Sums(
        design, int(cell_n.sum()), int(p["m"].sum()), float(p["yy"].sum()), cell_n, cell_y, s, cover, p["m"].to_numpy(float),
        p[["n", "s1", "s2"]].to_numpy(float), cc, ct, p[["tt_0", "tt_1", "tt_2"]].to_numpy(float),
    )


# ------------------------------------------------------------------ likelihood


def n_random(structure: str, n_sites: int) -> int:
    return {"N": 0, "A": 1, "B": 3, "C": n_sites, "D": 2 * n_sites, "E": 3 * n_sites}[structure]


def relative_factor(structure: str, theta: np.ndarray, n_sites: int) -> np.ndarray:
    """Cholesky factor of the random covariance over the residual variance, per site."""
    f = np.zeros((n_sites, 2, 2))
    if structure == "A":
        f[:, 0, 0] = theta[0]
    elif structure == "B":
        f[:, 0, 0], f[:, 1, 0], f[:, 1, 1] = theta
    elif structure == "C":
        f[:, 0, 0] = theta
    elif structure == "D":
        f[:, 0, 0], f[:, 1, 1] = theta.reshape(n_sites, 2).T
    elif structure == "E":
        f[:, 0, 0], f[:, 1, 0], f[:, 1, 1] = theta.reshape(n_sites, 3).T
    return f


def _profile(sums: Sums, x: np.ndarray, rel: np.ndarray, reml: bool):
    """Deviance, coefficients, their unscaled covariance and residual variance at ``rel``."""
    k = len(sums.design.depths)
    code = np.asarray(sums.design.codes, float)
    ns, nl = len(sums.design.sites), len(sums.design.covers)
    d = rel @ rel.transpose(0, 2, 1)
    g = d[sums.site]
    n, s1, s2 = sums.z.T
    # A = D (I + Z'Z D)^-1, written out for two random effects
    m00, m01 = 1 + n * g[:, 0, 0] + s1 * g[:, 0, 1], n * g[:, 0, 1] + s1 * g[:, 1, 1]
    m10, m11 = s1 * g[:, 0, 0] + s2 * g[:, 0, 1], 1 + s1 * g[:, 0, 1] + s2 * g[:, 1, 1]
    det = m00 * m11 - m01 * m10
    a00 = (g[:, 0, 0] * m11 - g[:, 0, 1] * m10) / det
    a01 = (g[:, 0, 1] * m00 - g[:, 0, 0] * m01) / det
    a11 = (g[:, 1, 1] * m00 - g[:, 0, 1] * m01) / det
    logdet = float(sums.plots @ np.log(det))
    both = code[:, None] + code[None, :]
    prod = code[:, None] * code[None, :]
    w00, w01, w11 = sums.per_group(np.stack([a00, a01, a11])).transpose(1, 0, 2)
    c00, c01, c11 = (w[:, : k * k].reshape(-1, k, k) for w in (w00, w01, w11))
    inner = c00 + c01 * both + c11 * prod
    t0, t1 = slice(k * k, k * k + k), slice(k * k + k, None)
    side = w00[:, t0] + w01[:, t1] + code * (w01[:, t0] + w11[:, t1])
    cells = x.reshape(ns * nl, k, -1)
    full = -inner
    full[:, np.arange(k), np.arange(k)] += sums.cell_n.reshape(ns * nl, k)
    xvx = np.einsum("cip,cij,cjq->pq", cells, full, cells, optimize=True)
    xvy = np.einsum("cip,ci->p", cells, sums.cell_y.reshape(ns * nl, k) - side)
    yvy = sums.yy - float(a00 @ sums.tt[:, 0] + 2 * a01 @ sums.tt[:, 1] + a11 @ sums.tt[:, 2])
    chol = np.linalg.cholesky(xvx)
    beta = np.linalg.solve(xvx, xvy)
    rss = max(yvy - float(beta @ xvy), 1e-300)
    free = sums.n_obs - (len(beta) if reml else 0)
    s2_hat = rss / free
    dev = free * (math.log(2 * math.pi * s2_hat) + 1) + logdet
    if reml:
        dev += 2 * float(np.log(np.diag(chol)).sum())
    return dev, beta, xvx, s2_hat


def _minimise(fn, start: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton descent with central differences and step halving."""
    x, f = start.astype(float), fn(start)
    h = np.eye(len(x))

    def gradient(p):
        g = np.empty(len(p))
        for i in range(len(p)):
            e = 1e-5 * max(1.0, abs(p[i]))
            up, down = p.copy(), p.copy()
            up[i] += e
            down[i] -= e
            g[i] = (fn(up) - fn(down)) / (2 * e)
        return g

    g = gradient(x)
    h /= max(1.0, np.abs(g).max())
    for _ in range(steps):
        if np.abs(g).max() < 1e-5 * max(1.0, abs(f)) ** 0.5:
            return x, f, True
        step = -h @ g
        if step @ g > 0:
            h = np.eye(len(x)) / max(1.0, np.abs(g).max())
            step = -h @ g
        t, moved = 1.0, False
        for _ in range(40):
            new = x + t * step
            fnew = fn(new)
            if np.isfinite(fnew) and fnew <= f + 1e-4 * t * (step @ g):
                moved = True
                break
            t /= 2
        if not moved:
            return x, f, bool(np.abs(g).max() < 1e-2 * max(1.0, abs(f)) ** 0.5)
        gnew = gradient(new)
        s, yv = new - x, gnew - g
        if s @ yv > 1e-14:
            r = 1.0 / (s @ yv)
            i = np.eye(len(x))
            h = (i - r * np.outer(s, yv)) @ h @ (i - r * np.outer(yv, s)) + r * np.outer(s, s)
        done = abs(f - fnew) < 1e-11 * max(1.0, abs(f))
        x, f, g = new, fnew, gnew
        if done:
            return x, f, True
    return x, f, False


@dataclass
class Fit:
    """A fitted model: a few numbers per coefficient and site."""

    sums: Sums
    terms: Sequence[tuple]
    structure: str
    reml: bool
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    random: np.ndarray  # random covariance per site
    loglik: float
    converged: bool
    x: np.ndarray = field(repr=False)
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)

    @property
    def n_params(self) -> int:
        return len(self.beta) + n_random(self.structure, len(self.random)) + 1

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_params


def fit(sums: Sums, terms: Sequence[tuple], structure: str = "D", reml: bool = True) -> Fit:
    """Maximum likelihood (``reml=False``) or REML fit; structure ``N`` has no random effects."""
    ns = len(sums.design.sites)
    x = cell_matrix(sums.design, terms)
    q = n_random(structure, ns)

    def deviance(theta):
        return _profile(sums, x, relative_factor(structure, theta, ns), reml)[0]

    theta, ok = np.zeros(0), True
    if q:
        per = {"A": [1], "B": [1, 0, 0.5], "C": [1] * ns, "D": [1, 0.5] * ns, "E": [1, 0, 0.5] * ns}[structure]
        runs = [_minimise(deviance, scale * np.array(per, float)) for scale in (1.0, 0.2)]
        theta, _, ok = min(runs, key=lambda r: r[1])
    rel = relative_factor(structure, theta, ns)
    dev, beta, xvx, s2 = _profile(sums, x, rel, reml)
    return Fit(
        sums, terms, structure, reml, column_names(sums.design, terms), beta, s2 * np.linalg.inv(xvx), s2,
        s2 * rel @ rel.transpose(0, 2, 1), -dev / 2, ok, x, theta,
    )


# ----------------------------------------------------------- degrees of freedom


@dataclass
class VarianceCurvature:
    """Covariance of the variance parameters, and how the coefficients' covariance changes with each of them."""

    cov: np.ndarray
    slopes: np.ndarray  # parameter x coefficient x coefficient
    inverse: np.ndarray

    def degrees(self, rows: np.ndarray) -> np.ndarray:
        """Satterthwaite degrees of freedom of each contrast: twice its squared variance over the variance of that variance."""
        var = np.einsum("ij,jk,ik->i", rows, self.cov, rows)
        change = np.einsum("ij,pjk,ik->ip", rows, self.slopes, rows)
        spread = np.einsum("ip,pq,iq->i", change, self.inverse, change)
        return np.where(spread > 0, 2 * var * var / np.where(spread > 0, spread, 1.0), np.inf)


def curvature(f: Fit) -> VarianceCurvature:
    """From the Hessian of the (restricted) deviance in the relative factors and the residual sd, on the collected sums alone."""
    ns = len(f.sums.design.sites)
    free = f.sums.n_obs - (len(f.beta) if f.reml else 0)

    def parts(theta: np.ndarray) -> tuple[float, float, np.ndarray]:
        dev, _beta, xvx, s2 = _profile(f.sums, f.x, relative_factor(f.structure, theta, ns), f.reml)
        return dev - free * (math.log(2 * math.pi * s2) + 1), s2 * free, xvx

    def deviance(p: np.ndarray) -> float:
        fixed, rss, _ = parts(p[:-1])
        return free * math.log(2 * math.pi * p[-1] ** 2) + fixed + rss / p[-1] ** 2

    at = np.r_[f.theta, math.sqrt(f.sigma2)]
    step = 1e-3 * np.maximum(np.abs(at), 1e-2)
    q = len(at)
    hessian = np.empty((q, q))
    middle = deviance(at)
    for i in range(q):
        for j in range(i, q):
            e, g = np.eye(q)[i] * step[i], np.eye(q)[j] * step[j]
            if i == j:
                # five points: the error falls with the fourth power of the step
                far, near = deviance(at + 2 * e) + deviance(at - 2 * e), deviance(at + e) + deviance(at - e)
                hessian[i, i] = (-far + 16 * near - 30 * middle) / (12 * step[i] ** 2)
            else:
                value = deviance(at + e + g) - deviance(at + e - g) - deviance(at - e + g) + deviance(at - e - g)
                hessian[i, j] = hessian[j, i] = value / (4 * step[i] * step[j])
    values, turn = np.linalg.eigh(hessian)
    kept = values > 1e-8 * max(values.max(), 1e-300)  # directions on the boundary have no curvature
    inverse = 2 * (turn[:, kept] / values[kept]) @ turn[:, kept].T
    slopes = [2 * at[-1] * np.linalg.inv(parts(f.theta)[2])]
    for i in range(q - 1):
        e = np.eye(q - 1)[i] * step[i]
        up, down = (at[-1] ** 2 * np.linalg.inv(parts(f.theta + d)[2]) for d in (e, -e))
        slopes.insert(-1, (up - down) / (2 * step[i]))
    return VarianceCurvature(f.cov, np.array(slopes), inverse)


# ---------------------------------------------------------------------- tables


def coefficient_table(spark: SparkSession, f: Fit) -> DataFrame:
    rows = [(i, n, float(b), float(math.sqrt(v)), f.converged) for i, (n, b, v) in enumerate(zip(f.names, f.beta, np.diag(f.cov)))]
    return local_table(spark, rows, "i int, term string, estimate double, se double, converged boolean")


def variance_table(spark: SparkSession, f: Fit) -> DataFrame:
    """Variances and correlations with a boundary flag (sd < 1e-4 or |correlation| > .99)."""
    per_site = f.structure in "CDE"
    labels = list(f.sums.design.sites) if per_site else ["all"]
    rows = []
    for s, label in enumerate(labels):
        d = f.random[s]
        sd = np.sqrt(np.maximum(np.diag(d), 0.0))
        rows.append((str(label), "intercept", "", float(d[0, 0]), float(sd[0]), bool(sd[0] < 1e-4)))
        if f.structure in "BDE":
            rows.append((str(label), "slope", "", float(d[1, 1]), float(sd[1]), bool(sd[1] < 1e-4)))
        if f.structure in "BE":
            r = float(d[0, 1] / (sd[0] * sd[1])) if sd[0] * sd[1] > 0 else 0.0
            rows.append((str(label), "intercept", "slope", float(d[0, 1]), r, bool(abs(r) > 0.99)))
    rows.append(("residual", "", "", f.sigma2, math.sqrt(f.sigma2), False))
    return local_table(spark, rows, "grp string, term1 string, term2 string, variance double, sd_or_correlation double, at_boundary boolean")


def is_singular(f: Fit) -> bool:
    """A relative variance factor on the boundary."""
    rel = np.linalg.eigvalsh(f.random / f.sigma2)
    width = 2 if f.structure in "BDE" else 1
    return bool((np.sqrt(np.maximum(rel[:, -width:], 0.0)) < 1e-4).any())


def criteria_table(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """Parameters, log-likelihood, AIC, BIC by samples and by plots, differences to the best, and whether the optimiser converged."""
    rows = [(k, f.n_params, f.loglik, f.sums.n_obs, f.sums.n_plots, is_singular(f) if f.structure != "N" else False, f.converged) for k, f in fits.items()]
    df = local_table(spark, rows, "model string, k int, loglik double, n_obs long, n_plots long, singular boolean, converged boolean")
    return information_criteria(df)


def information_criteria(df: DataFrame) -> DataFrame:
    """AIC and BIC from ``k, loglik, n_obs, n_plots`` rows."""
    ll, k = F.col("loglik"), F.col("k")
    d = df.withColumns(
        {"aic": -2 * ll + 2 * k, "bic_nobs": -2 * ll + F.log(F.col("n_obs")) * k, "bic_nplots": -2 * ll + F.log(F.col("n_plots")) * k}
    )
    w = Window.partitionBy(F.lit(0))
    return d.withColumns({f"delta_{c}": F.col(c) - F.min(c).over(w) for c in ("aic", "bic_nobs", "bic_nplots")})


def lr_table(spark: SparkSession, tests: Sequence[tuple[str, Fit, Fit]]) -> DataFrame:
    """Likelihood-ratio tests of ``(term, full, reduced)`` ML fits."""
    rows = []
    for term, full, reduced in tests:
        chi2, df = 2 * (full.loglik - reduced.loglik), len(full.beta) - len(reduced.beta)
        rows.append((term, float(chi2), df, float(chi2_tail(max(chi2, 0.0), df))))
    return local_table(spark, rows, "term string, chi2 double, df int, p double")


def retained_structure(fits: dict[str, Fit], forced: str | None = None) -> str:
    return forced or min(fits, key=lambda s: (fits[s].aic, s))


# ------------------------------------------------------------- back to the rows


def _by_site(f: Fit, values: np.ndarray) -> Column:
    """Literal per site, chosen by the site column."""
    return code_lookup(f.sums.design.site, {s: float(v) for s, v in zip(f.sums.design.sites, values)})


def cell_predictions(spark: SparkSession, f: Fit) -> DataFrame:
    d = f.sums.design
    cells = list(itertools.product(d.sites, d.covers, d.depths))
    types = [("string" if isinstance(v[0], str) else "int") for v in (d.sites, d.covers, d.depths)]
    schema = f"{d.site} {types[0]}, {d.lc} {types[1]}, {d.depth} {types[2]}, fixed double"
    return local_table(spark, [(*c, float(v)) for c, v in zip(cells, f.x @ f.beta)], schema)


def fixed_fitted(df: DataFrame, f: Fit) -> DataFrame:
    """Rows with the fixed-effect prediction ``fixed`` and the slope variable ``dc``."""
    d = f.sums.design
    cells = F.broadcast(cell_predictions(df.sparkSession, f))  # sites x covers x depths rows
    return df.join(cells, [d.site, d.lc, d.depth]).withColumn("dc", d.slope())


def random_effects(df: DataFrame, f: Fit) -> DataFrame:
    """Predicted intercept and slope of each plot, and the intercept over its site's sd."""
    d = f.sums.design
    r = F.col(d.y) - F.col("fixed")
    p = fixed_fitted(df, f).groupBy(d.plot, d.site).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("dc").alias("s1"),
        F.sum(F.col("dc") * F.col("dc")).alias("s2"),
        F.sum(r).alias("r0"),
        F.sum(F.col("dc") * r).alias("r1"),
    )
    rel = f.random / f.sigma2
    p = p.withColumns({"g00": _by_site(f, rel[:, 0, 0]), "g01": _by_site(f, rel[:, 0, 1]), "g11": _by_site(f, rel[:, 1, 1])})
    c = F.col
    m00, m01 = 1 + c("n") * c("g00") + c("s1") * c("g01"), c("n") * c("g01") + c("s1") * c("g11")
    m10, m11 = c("s1") * c("g00") + c("s2") * c("g01"), 1 + c("s1") * c("g01") + c("s2") * c("g11")
    det = m00 * m11 - m01 * m10
    a00 = (c("g00") * m11 - c("g01") * m10) / det
    a01 = (c("g01") * m00 - c("g00") * m01) / det
    a11 = (c("g11") * m00 - c("g01") * m01) / det
    out = p.select(
        d.plot, d.site, (a00 * c("r0") + a01 * c("r1")).alias("intercept"), (a01 * c("r0") + a11 * c("r1")).alias("slope")
    )
    sd = out.groupBy(d.site).agg(F.stddev_samp("intercept").alias("_sd"))
    return out.join(F.broadcast(sd), d.site).withColumn("scaled", F.try_divide("intercept", "_sd")).drop("_sd")


def fitted_rows(df: DataFrame, f: Fit) -> DataFrame:
    """Rows with fixed and conditional fitted values and the standardised residual."""
    d = f.sums.design
    effects = random_effects(df, f).select(d.plot, "intercept", "slope")
    rows = fixed_fitted(df, f).join(effects, d.plot)
    fitted = F.col("fixed") + F.col("intercept") + F.col("slope") * F.col("dc")
    return rows.withColumn("fitted", fitted).withColumn("std_resid", (F.col(d.y) - F.col("fitted")) / math.sqrt(f.sigma2))


def r_squared(df: DataFrame, f: Fit) -> DataFrame:
    """Marginal and conditional R2: fixed, mean random and residual variance of the rows."""
    d0, d01, d1 = (_by_site(f, f.random[:, i, j]) for i, j in ((0, 0), (0, 1), (1, 1)))
    z = d0 + 2.0 * d01 * F.col("dc") + d1 * F.col("dc") * F.col("dc")
    v = fixed_fitted(df, f).agg(F.var_pop("fixed").alias("var_fixed"), F.avg(z).alias("var_random")).withColumn("var_resid", F.lit(f.sigma2))
    total = F.col("var_fixed") + F.col("var_random") + F.col("var_resid")
    return v.withColumn("r2_marginal", F.col("var_fixed") / total).withColumn("r2_conditional", (F.col("var_fixed") + F.col("var_random")) / total)


def icc(null_fit: Fit) -> float:
    """Share of the plot variance in a random-intercept model without fixed factors."""
    v = float(null_fit.random[0, 0, 0])
    return v / (v + null_fit.sigma2)
