"""Aggregations: profiles, quantiles, correlations, accuracy metrics, tests of spread."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.config import ALPHA, STRONG_R
from terrastat.functions.scalar import is_finite
from terrastat.functions.tails import f_test_p, t_test_p
from terrastat.session import broadcast_if_small, cut_lineage, fetched, local_table


# ---------------------------------------------------------------- quantiles


GRID = 256


def _with_brackets(rows: DataFrame, by: Sequence[str], brackets: DataFrame) -> DataFrame:
    """Rows with the size ``_n`` and the brackets ``_q`` of their group; a table without groups has one row of both."""
    if not by:
        one = brackets.first()
        each = [F.struct(*[F.lit(q[c]).cast("double").alias(c) for c in ("prob", "lo", "hi")]) for q in one["_q"]]
        return rows.withColumns({"_n": F.lit(one["_n"]), "_q": F.array(*each)})
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return rows.join(broadcast_if_small(brackets.select(*keys, "_n", "_q")), same).select(*rows.columns, "_n", "_q")


def _narrowed(base: DataFrame, by: Sequence[str], brackets: DataFrame, most: int, accuracy: int) -> DataFrame:
    """Brackets with more than ``most`` rows between their ends, cut to a few steps of a grid of percentiles of those rows."""
    rows = _with_brackets(base, by, brackets).select(*by, "_v", "_n", F.explode("_q").alias("_b")).filter(F.col("_v") <= F.col("_b.hi"))
    inside = F.when((F.col("_v") > F.col("_b.lo")) & (F.col("_v") < F.col("_b.hi")), F.col("_v"))
    met = rows.groupBy(*by, "_n", "_b").agg(
        F.count_if(F.col("_v") <= F.col("_b.lo")).alias("_below"),
        F.count(inside).alias("_in"),
        F.percentile_approx(inside, [i / GRID for i in range(GRID + 1)], accuracy).alias("_grid"),
    )
    h = (F.col("_n") - 1) * F.col("_b.prob")

    def step(rank: Column) -> Column:
        return F.floor((rank - F.col("_below")) * GRID / F.col("_in")).cast("int")

    lo = F.coalesce(F.get("_grid", step(F.floor(h)) - 1), F.col("_b.lo"))
    hi = F.coalesce(F.get("_grid", step(F.ceil(h)) + 2), F.col("_b.hi"))
    wide = F.col("_in") > most
    cut = F.struct(F.col("_b.prob").alias("prob"), F.when(wide, lo).otherwise(F.col("_b.lo")).alias("lo"), F.when(wide, hi).otherwise(F.col("_b.hi")).alias("hi"))
    return cut_lineage(met.groupBy(*by, "_n").agg(F.collect_list(cut).alias("_q")))


def exact_percentiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 2000,
    small: int = 20_000,
    most: int = 100_000,
) -> DataFrame:
    """Linear-interpolation percentiles as ``by, prob, n, percentile``, exact at any row count.

    The built-in ``percentile`` keeps every distinct value of a group in one
    buffer. Here a fixed-size sketch brackets each percentile, and sketches of
    the rows between its ends narrow it until at most about ``most`` of them are
    left: each round leaves 2 % of the rows, so four serve 1e11. Rows outside are
    only counted, values inside are ranked; a value held by many rows is one.
    """
    v = F.col(value).cast("double")
    base = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    eps = 4.0 / accuracy
    low = [max(0.0, p - eps) for p in probs]
    high = [min(1.0, p + eps) for p in probs]
    n = F.count("_v")

    def edges(whole: Column, points: list[float]) -> Column:
        sketch = F.percentile_approx("_v", points, accuracy)
        return F.when(n <= small, F.array(*[whole] * len(points))).otherwise(sketch)

    stats = base.groupBy(*by).agg(
        n.alias("_n"), edges(F.min("_v"), low).alias("_lo"), edges(F.max("_v"), high).alias("_hi")
    )
    each = [
        F.struct(F.lit(float(p)).alias("prob"), F.col("_lo")[i].alias("lo"), F.col("_hi")[i].alias("hi"))
        for i, p in enumerate(probs)
    ]
    brackets, largest = fetched(stats.select(*by, "_n", F.array(*each).alias("_q")), "_n")
    # rows that the sketch's error bound leaves between the ends of the largest bracket
    width = largest * (2 * eps + 2.0 / accuracy) if largest > small else 0.0
    while width > most:
        brackets = _narrowed(base, by, brackets, most, accuracy)
        width *= 4.0 / GRID + 2.0 / accuracy
    counted = (
        _with_brackets(base, by, brackets)
        .select(*by, "_v", "_n", F.explode("_q").alias("_q"))
        .filter(F.col("_v") <= F.col("_q.hi"))
        .groupBy(*by, F.col("_q.prob").alias("prob"), "_n", F.when(F.col("_v") >= F.col("_q.lo"), F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*by, "prob").orderBy(F.col("_v").asc_nulls_first())
    h = (F.col("_n") - 1) * F.col("prob")
    picked = (
        counted.withColumn("_cum", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*by, "prob", "_n")
        .agg(
            F.min(F.when(F.col("_cum") > F.floor(h), F.col("_v"))).alias("_a"),
            F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_v"))).alias("_b"),
        )
    )
    frac = h - F.floor(h)
    return picked.select(
        *by,
        "prob",
        F.col("_n").alias("n"),
        (F.col("_a") + frac * (F.col("_b") - F.col("_a"))).alias("percentile"),
    )


def percentile_columns(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles as columns, one row per group."""
    long = exact_percentiles(df, value, sorted(set(named.values())), by)
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("percentile"))).alias(c) for c, p in named.items()]
    )


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join of two one-row-per-group results; NULL groups meet, one-row results meet as scalars."""
    if not by:
        cols = right.columns
        one = right.select(F.struct(*cols).alias("_s")).scalar()
        return left.withColumn("_s", one).select(*left.columns, *[F.col(f"_s.{c}").alias(c) for c in cols])
    r = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return left.join(r, same).drop(*[f"_k{i}" for i in range(len(by))])


# ----------------------------------------------------------------- profiles


def to_long(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), "variable", "value")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, moments, quartiles, range, cv and missing values of each column."""
    long = to_long(df, columns, by)
    keys = [*by, "variable"]
    base = long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    q = percentile_columns(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, keys)
    return join_groups(base, q, keys).withColumn("cv", F.try_divide(F.col("sd"), F.col("mean")) * 100.0)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def id_check(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows, rows without id and repeats beyond the first, NULL counting as one value."""
    per_id = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    empty = F.lit(False)
    for c in ids:
        empty = empty | F.col(c).isNull()
    return per_id.agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(empty, F.col("_n"))), F.lit(0)).alias("n_null"),
        (F.sum("_n") - F.count(F.lit(1))).alias("n_duplicates"),
    )


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of each column and whether it is empty, in one scan."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    items = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing"), F.col("_n").alias("n_rows")) for c in columns]
    return agg.select(F.inline(F.array(*items))).withColumn("empty", F.col("n_missing") == F.col("n_rows"))


def dependency_violations(df: DataFrame, key: str, dependents: Sequence[str]) -> DataFrame:
    """Keys that occur with more than one value of a column they should determine."""
    counts = df.groupBy(key).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in dependents])
    bad = F.lit(False)
    for c in dependents:
        bad = bad | (F.col(f"n_{c}") > 1)
    return counts.filter(bad)


def design_counts(df: DataFrame, by: Sequence[str], plot: str) -> DataFrame:
    """Distinct plots and samples per cell; plots collapse before they are counted."""
    per_plot = df.groupBy(*by, plot).agg(F.count(F.lit(1)).alias("_n"))
    return per_plot.groupBy(*by).agg(F.count(plot).alias("n_plots"), F.sum("_n").alias("n_samples"))


def grouping_set_counts(df: DataFrame, sets: Sequence[Sequence[str]], plot: str) -> DataFrame:
    """Samples and plots over several groupings: ``columns, grouping, n_samples, n_plots``.

    Samples are counted per cell and the few cells rolled up. A plot lists its cells once and counts in each group of theirs, so
    the rows are neither repeated for every grouping nor for the distinct count.
    """
    cols = sorted({c for s in sets for c in s})
    types = {f.name: f.dataType for f in df.schema.fields}
    base = df.groupBy(*cols, plot).agg(F.count(F.lit(1)).alias("_n"))
    cells = base.groupBy(*cols).agg(F.sum("_n").alias("_n"))
    samples = cells.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().cast("int").alias("grouping"), F.sum("_n").alias("n_samples"))
    plots = base.filter(F.col(plot).isNotNull()).groupBy(plot).agg(F.collect_set(F.struct(*cols)).alias("_c"))
    at = [(sum(2 ** (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s), set(s)) for s in sets]

    def shown(bits: int, inside: set) -> Column:
        return F.transform("_c", lambda c: F.struct(F.lit(bits).alias("_g"), *[(c[k] if k in inside else F.lit(None).cast(types[k])).alias(f"_{k}") for k in cols]))

    groups = plots.select(F.inline(F.array_distinct(F.flatten(F.array(*[shown(*a) for a in at])))))
    counted = groups.groupBy("_g", *[f"_{c}" for c in cols]).agg(F.count(F.lit(1)).alias("n_plots"))
    same = [F.col("grouping") == F.col("_g"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]]
    return samples.join(broadcast_if_small(counted), same, "left").select(*cols, "grouping", "n_samples", F.coalesce("n_plots", F.lit(0)).alias("n_plots"))


def group_means(df: DataFrame, by: Sequence[str], value: str, plot: str) -> DataFrame:
    per_plot = df.groupBy(*by, plot).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per_plot.groupBy(*by).agg(
        (F.sum("_s") / F.sum("_n")).alias("mean_raw"), F.sum("_n").alias("n_samples"), F.count(plot).alias("n_plots")
    )


# ------------------------------------------------------------- correlations

WIDE_LIMIT = 6


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete r and n of every unordered pair.

    A few columns become one row per pair, summed per pair before the shuffle
    (one aggregate with a buffer set per pair outgrows the code generator).
    Many columns go through cross-product matrices.
    """
    if len(columns) > WIDE_LIMIT:
        return _pearson_pairs_wide(df, columns)
    pairs = list(combinations(columns, 2))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stacked = values.select(
        F.stack(F.lit(len(pairs)), *[x for a, b in pairs for x in (F.lit(a), F.lit(b), F.col(a), F.col(b))]).alias("var1", "var2", "_x", "_y")
    )
    return stacked.groupBy("var1", "var2").agg(F.corr("_x", "_y").alias("r"), F.count(F.col("_x") + F.col("_y")).alias("n"))


def _pearson_pairs_wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Many columns: each task sums its own cross products, one row per task and pair."""
    cols = list(columns)
    centre_row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    centre = np.array([centre_row[c] if centre_row[c] is not None else 0.0 for c in cols])
    left, right = np.triu_indices(len(cols), 1)

    def partial(batches):
        sums = np.zeros((6, len(left)))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            m = np.isfinite(x).astype(float)
            z = np.where(m > 0, x, 0.0)
            full = (m.T @ m, z.T @ m, m.T @ z, (z * z).T @ m, m.T @ (z * z), z.T @ z)
            sums += np.stack([f[left, right] for f in full])
        yield pd.DataFrame({"i": left, "j": right, **{f"s{k}": sums[k] for k in range(6)}})

    schema = "i int, j int, " + ", ".join(f"s{k} double" for k in range(6))
    s = (
        df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        .mapInPandas(partial, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    )
    cov = F.col("s5") - F.try_divide(F.col("s1") * F.col("s2"), F.col("s0"))
    vx = F.col("s3") - F.try_divide(F.col("s1") * F.col("s1"), F.col("s0"))
    vy = F.col("s4") - F.try_divide(F.col("s2") * F.col("s2"), F.col("s0"))
    names = F.array(*[F.lit(c) for c in cols])
    return s.select(
        names[F.col("i")].alias("var1"),
        names[F.col("j")].alias("var2"),
        F.try_divide(cov, F.sqrt(vx * vy)).alias("r"),
        F.col("s0").cast("long").alias("n"),
    )


def pearson_p(pairs: DataFrame) -> DataFrame:
    """Two-sided p of r with n - 2 degrees of freedom."""
    df = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(df, 1.0 - F.col("r") * F.col("r")))
    return pairs.withColumn("p", F.when(F.abs("r") >= 1.0, F.lit(0.0)).otherwise(t_test_p(t, df)))


def pair_matrix(pairs: DataFrame, columns: Sequence[str], value: str = "r", diagonal: float = 1.0) -> DataFrame:
    """Square matrix of a pair table, one row per variable."""
    spark = pairs.sparkSession
    diag = local_table(spark, [(c, c, diagonal) for c in columns], "var1 string, var2 string, v double")
    both = pairs.select("var1", "var2", F.col(value).alias("v"))
    flipped = both.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "v")
    return both.union(flipped).union(diag).groupBy("var1").pivot("var2", list(columns)).agg(F.first("v"))


def significant_pairs(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return pairs.filter(F.col("p") < alpha)


def strong_pairs(pairs: DataFrame, limit: float = STRONG_R, alpha: float = ALPHA) -> DataFrame:
    """Strong pairs among the significant ones."""
    return significant_pairs(pairs, alpha).filter(F.abs("r") > limit)


# ---------------------------------------------------------- accuracy metrics


def finite_pairs(df: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    return df.filter(is_finite(obs) & is_finite(pred))


def metrics(df: DataFrame, by: Sequence[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """R2, RMSE, MAE, RPIQ, CCC and RPD of finite observed/predicted pairs."""
    ok = finite_pairs(df, obs, pred)
    o, e = F.col(obs).cast("double"), F.col(obs).cast("double") - F.col(pred).cast("double")
    p = F.col(pred).cast("double")
    base = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(o).alias("_vo"),
        F.var_pop(p).alias("_vp"),
        F.covar_pop(o, p).alias("_cov"),
        F.avg(o).alias("_mo"),
        F.avg(p).alias("_mp"),
        F.stddev_samp(o).alias("_sd"),
    )
    iqr = percentile_columns(ok, obs, {"_q1": 0.25, "_q3": 0.75}, by)
    d = join_groups(base, iqr, by).withColumn("rmse", F.sqrt(F.col("_sse") / F.col("n")))
    spread = F.col("_vo") + F.col("_vp") + F.pow(F.col("_mo") - F.col("_mp"), F.lit(2.0))
    return d.select(
        *by,
        "n",
        (1.0 - F.try_divide(F.col("_sse"), F.col("n") * F.col("_vo"))).alias("r2"),
        "rmse",
        "mae",
        F.when(F.col("rmse") > 0, F.try_divide(F.col("_q3") - F.col("_q1"), F.col("rmse"))).otherwise(0.0).alias("rpiq"),
        F.when(spread > 0, F.try_divide(2.0 * F.col("_cov"), spread)).otherwise(0.0).alias("ccc"),
        F.try_divide(F.col("_sd"), F.col("rmse")).alias("rpd"),
        F.col("_sd").alias("sd_obs"),
        (F.col("_q3") - F.col("_q1")).alias("iqr_obs"),
    )


def pooled_table(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rounded metrics of pooled out-of-fold predictions; RPD and RPIQ are NULL at zero error."""
    m = metrics(df, by)
    exact = F.col("rmse") == 0
    return m.select(
        *by,
        F.round("r2", 3).alias("r2"),
        F.round("rmse", 3).alias("rmse"),
        F.round("mae", 3).alias("mae"),
        F.round(F.when(~exact, F.col("rpd")), 2).alias("rpd"),
        F.round(F.when(~exact, F.col("rpiq")), 2).alias("rpiq"),
        "n",
    )


def compare_models(df: DataFrame, models: dict[str, str], by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group with every model's metrics side by side."""
    long = df.unpivot([*by, "obs"], list(models.values()), "_m", "pred")
    m = metrics(long, [*by, "_m"])
    return m.groupBy(*by).agg(
        *[F.max(F.when(F.col("_m") == c, F.col(v))).alias(f"{name}_{v}") for name, c in models.items() for v in values]
    )


def cv_summary(fold_metrics: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sd of each metric over folds."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return fold_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def regression_line(df: DataFrame, by: Sequence[str] = (), x: str = "obs", y: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept")
    )


# ------------------------------------------------- distribution of residuals


def shape_moments(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.skewness(value).alias("skewness"), F.kurtosis(value).alias("excess_kurtosis"))


def spread_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.stddev_samp(value).alias("sd"))


def spread_ratio(groups: DataFrame, limit: float = 2.0) -> DataFrame:
    out = groups.agg((F.max("sd") / F.min("sd")).alias("sd_ratio"))
    return out.withColumn("flagged", F.col("sd_ratio") > limit)


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Median-centred Levene test: F, its degrees of freedom and p."""
    med = broadcast_if_small(percentile_columns(df, value, {"_med": 0.5}, [group]))
    z = df.join(med, group).select(group, F.abs(F.col(value) - F.col("_med")).alias("_z"))
    g = z.groupBy(group).agg(F.count("_z").alias("_n"), F.avg("_z").alias("_m"), F.var_pop("_z").alias("_v"))
    s = g.agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("_n").alias("_nt"),
        F.sum(F.col("_n") * F.col("_v")).alias("_within"),
        (
            F.sum(F.col("_n") * F.col("_m") * F.col("_m"))
            - F.pow(F.sum(F.col("_n") * F.col("_m")), F.lit(2.0)) / F.sum("_n")
        ).alias("_between"),
    )
    d1, d2 = (F.col("_k") - 1).cast("double"), (F.col("_nt") - F.col("_k")).cast("double")
    f = F.try_divide(F.col("_between") / d1, F.col("_within") / d2)
    return s.select(f.alias("F"), d1.alias("df1"), d2.alias("df2"), f_test_p(f, d1, d2).alias("p"))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the extreme values inside 1.5 IQR, mean and n."""
    q = percentile_columns(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    rows = join_groups(df.select(*by, F.col(value).cast("double").alias("_v")), broadcast_if_small(q), by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return rows.groupBy(*by).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(F.col("_v") >= F.col("q1") - reach, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= F.col("q3") + reach, F.col("_v"))).alias("whisker_high"),
        F.avg("_v").alias("mean"),
        F.count("_v").alias("n"),
    )


def axis_limits(df: DataFrame, value: str, groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Axis range: whiskers over several groupings against the 1 % and 99 % quantiles.

    Each grouping reads the rows several times: only what they need of them is stored, once.
    """
    df = cut_lineage(df.select(*dict.fromkeys(c for g in groupings for c in g), value))
    whiskers = None
    for g in groupings:
        w = box_stats(df, value, g).select("whisker_low", "whisker_high")
        whiskers = w if whiskers is None else whiskers.union(w)
    wh = whiskers.agg(F.min("whisker_low").alias("_wl"), F.max("whisker_high").alias("_wh"))
    ends = df.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    q = percentile_columns(df, value, {"_p01": 0.01, "_p99": 0.99})
    d = join_groups(join_groups(ends, q, []), wh, [])
    return d.select(
        F.greatest("_min", F.least("_p01", "_wl")).alias("lo"), F.least("_max", F.greatest("_p99", "_wh")).alias("hi")
    )


def bootstrap_interval(
    long: DataFrame, row_id: str, by: Sequence[str], value: str, n_boot: int, level: float, seed: int
) -> DataFrame:
    """Percentile interval of the mean of |value| over Poisson(1) resamples.

    A row's weight in a resample is a hash of both ids: no row order, no state,
    and every resample is a partial sum per task.
    """
    from terrastat.functions.scalar import hash_uniform, poisson_one

    w = poisson_one(hash_uniform(F.lit(str(seed)), F.col("_boot"), F.col(row_id)))
    resampled = (
        long.select(row_id, *by, F.abs(F.col(value)).alias("_v"))
        .withColumn("_boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
        .withColumn("_w", w)
        .groupBy(*by, "_boot")
        .agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("_m"))
    )
    tail = (1.0 - level) / 2.0
    ends = percentile_columns(resampled, "_m", {"ci_lo": tail, "ci_hi": 1.0 - tail}, by)
    means = long.groupBy(*by).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    return join_groups(means, ends, by)
