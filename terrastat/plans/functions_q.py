"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.config import PH_LABELS, SCORE_BINS, TEXTURE_CODE, TEXTURE_SCORE
from terrastat.functions import scalar as fn
from terrastat.functions import tails
from terrastat.operators.index import class_mismatches, classify
from terrastat.plans.data import POINTS, RASTER, TRANSFORM, points, raster
from terrastat.plans.registry import query, r, rnd
from terrastat.plans.sources_q import CLASS_OF, PART_INDEX, part_index

_PH = "(p_retailprice - 900) / 10 "
_BREAKS = SCORE_BINS["pH"][1:-1]
_CASE = "CASE " + " ".join(f"WHEN ph <= {b} THEN {lab}" for b, lab in zip(_BREAKS, PH_LABELS)) + f" ELSE {PH_LABELS[-1]} END"


@query("fn_01_right_closed_bins", f"SELECT p_partkey, CASE WHEN ph IS NOT NULL THEN {_CASE} END AS score FROM (SELECT p_partkey, CASE WHEN p_size = 13 THEN NULL ELSE {_PH} END AS ph FROM part)")
def _(t):
    ph = F.when(F.col("p_size") != 13, (F.col("p_retailprice") - 900) / 10)
    return t.part.select("p_partkey", fn.right_closed_bin(ph, SCORE_BINS["pH"], PH_LABELS).alias("score"))


@query("fn_02_index_class", f"SELECT p_partkey, {CLASS_OF} AS class FROM {PART_INDEX}")
def _(t):
    return classify(part_index(t), "index_value").select("p_partkey", "class")


@query("fn_03_class_consistency", f"SELECT count(*) FILTER ((index_value IS NULL) <> ({CLASS_OF} IS NULL)) AS n_mismatch, count(*) AS n_rows FROM {PART_INDEX}")
def _(t):
    return class_mismatches(classify(part_index(t), "index_value"), "index_value", "class")


@query("fn_04_standard_score", f"SELECT p_partkey, {r('p_size * 0.2e0', 6)} AS score FROM part")
def _(t):
    return rnd(t.part.select("p_partkey", fn.standard_score("p_size", 5).alias("score")), 6, "score")


_NAMES = list(TEXTURE_CODE)
_TEX = "CASE p_size % 13 " + " ".join(f"WHEN {i} THEN {TEXTURE_SCORE[TEXTURE_CODE[n]]}" for i, n in enumerate(_NAMES)) + " END"


@query("fn_05_texture_score", f"SELECT p_partkey, {_TEX} AS score FROM part")
def _(t):
    name = F.get(F.array(*[F.lit(n.lower()) for n in _NAMES]), F.col("p_size") % 13)
    code = fn.code_lookup(name, TEXTURE_CODE, upper=True)
    return t.part.select("p_partkey", fn.code_lookup(code, TEXTURE_SCORE).alias("score"))


_PV = "(CASE WHEN p_size = 50 THEN NULL ELSE power(10e0, -p_size / 10e0) END)"


@query(
    "fn_06_stars_and_bands",
    f"""SELECT p_partkey, CASE WHEN {_PV} < 0.001 THEN '***' WHEN {_PV} < 0.01 THEN '**' WHEN {_PV} < 0.05 THEN '*' ELSE '' END AS stars,
CASE WHEN p_size = 49 THEN 'perfect' WHEN p_size / 3e0 >= 10 THEN 'high' WHEN p_size / 3e0 >= 5 THEN 'moderate' ELSE 'low' END AS band FROM part""",
)
def _(t):
    p = F.when(F.col("p_size") != 50, F.pow(F.lit(10.0), -F.col("p_size") / 10.0))
    v = F.when(F.col("p_size") == 49, float("inf")).otherwise(F.col("p_size") / 3.0)
    return t.part.select("p_partkey", fn.significance_stars(p).alias("stars"), fn.vif_band(v).alias("band"))


@query("fn_07_format_p", f"SELECT p_partkey, CASE WHEN {_PV} IS NULL THEN '' WHEN {_PV} < 0.001 THEN printf('%.2e', {_PV}) ELSE printf('%.3f', {_PV}) END AS text FROM part")
def _(t):
    p = F.when(F.col("p_size") != 50, F.pow(F.lit(10.0), -F.col("p_size") / 10.0))
    return t.part.select("p_partkey", fn.format_p(p).alias("text"))


_SIG = "power(10e0, 3 - 1 - floor(log10(abs(v))))"


@query("fn_08_rounding", f"SELECT o_orderkey, round(v, 4) + 0e0 AS r4, round(v * {_SIG}) / {_SIG} AS s3 FROM (SELECT o_orderkey, o_totalprice / 7e0 AS v FROM orders)")
def _(t):
    v = F.col("o_totalprice") / 7.0
    return t.orders.select("o_orderkey", F.round(v, 4).alias("r4"), fn.round_significant(v, 3).alias("s3"))


# closed forms: chi-square with 2 and 4 df, F with 2 numerator df, t with 2 df
@query(
    "fn_09_tail_areas",
    f"""SELECT l_linenumber, {r('exp(-x / 2)', 12)} AS chi2_2, {r('exp(-x / 2) * (1 + x / 2)', 12)} AS chi2_4, {r('power(1 + 2 * x / 30, -15)', 12)} AS f_2_30, {r('1 - x / sqrt(2 + x * x)', 12)} AS t_2
FROM (SELECT l_linenumber, avg(l_quantity) / 5e0 AS x FROM lineitem GROUP BY 1)""",
)
def _(t):
    d = t.lineitem.groupBy("l_linenumber").agg((F.avg("l_quantity") / 5.0).alias("x"))
    x = F.col("x")
    return rnd(
        d.select(
            "l_linenumber",
            tails.chi2_test_p(x, F.lit(2.0)).alias("chi2_2"),
            tails.chi2_test_p(x, F.lit(4.0)).alias("chi2_4"),
            tails.f_test_p(x, F.lit(2.0), F.lit(30.0)).alias("f_2_30"),
            tails.t_test_p(x, F.lit(2.0)).alias("t_2"),
        ),
        12, "chi2_2", "chi2_4", "f_2_30", "t_2",
    )


@query("fn_10_pixel_coordinates", f"SELECT row, col, {r('-0.5e0 + (col + 0.5e0) * 0.02e0', 9)} AS x, {r('-0.5e0 + (row + 0.5e0) * 0.025e0', 9)} AS y, row AS row_back, col AS col_back FROM {RASTER}")
def _(t):
    d = raster(t).select("row", "col", fn.pixel_x("col", TRANSFORM).alias("x"), fn.pixel_y("row", TRANSFORM).alias("y"))
    return rnd(d.withColumns({"row_back": fn.pixel_row("y", TRANSFORM), "col_back": fn.pixel_col("x", TRANSFORM)}), 9, "x", "y")


_H = "(SELECT id, sqrt(x * x + y * y) AS h FROM " + POINTS + ")"


@query(
    "fn_11_variogram_models",
    f"""SELECT id, {r('2 * h + 0.1e0', 9)} AS linear, {r('2 * power(h, 1.5e0) + 0.1e0', 9)} AS power, {r('2 * (1 - exp(-power(h / (0.3e0 * 4 / 7), 2))) + 0.1e0', 9)} AS gaussian,
{r('2 * (1 - exp(-h / (0.3e0 / 3))) + 0.1e0', 9)} AS exponential, {r('CASE WHEN h <= 0.3e0 THEN 2 * (3 * h / (2 * 0.3e0) - power(h, 3) / (2 * power(0.3e0, 3))) + 0.1e0 ELSE 2.1e0 END', 9)} AS spherical FROM {_H}""",
)
def _(t):
    h = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    models = ["linear", "power", "gaussian", "exponential", "spherical"]
    d = points(t).select("id", *[fn.semivariance(F.lit(m), F.lit(2.0), F.lit(1.5 if m == "power" else 0.3), F.lit(0.1), h).alias(m) for m in models])
    return rnd(d, 9, *models)


@query(
    "fn_12_pretty_label",
    """SELECT p_partkey, CASE WHEN name = 'SMALL_30m' THEN 'Small plots' WHEN starts_with(name, 'PROMO_') THEN 'Offer = ' || substr(name, 7) ELSE replace(replace(name, '_30m', ''), '_', ' ') END AS label
FROM (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'PROMO_' || p_size ELSE p_type || '_30m' END AS name FROM part)""",
)
def _(t):
    name = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("PROMO_"), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_type"), F.lit("_30m")))
    d = t.part.select("p_partkey", name.alias("name"))
    return d.select("p_partkey", fn.pretty_label("name", {"SMALL_30m": "Small plots"}, {"PROMO": "Offer"}).alias("label"))


@query(
    "fn_13_contrast_label",
    "SELECT l.o_orderkey, o_orderstatus || ' - ' || o_orderpriority AS label, split_part(o_orderstatus || ' - ' || o_orderpriority, ' - ', 1) AS a, upper(split_part(o_orderstatus || ' - ' || o_orderpriority, ' - ', 2)) AS b FROM orders l",
)
def _(t):
    d = t.orders.select("o_orderkey", fn.contrast_label("o_orderstatus", "o_orderpriority").alias("label"))
    return d.select("o_orderkey", "label", fn.contrast_side("label", 0).alias("a"), F.upper(fn.contrast_side("label", 1)).alias("b"))


@query(
    "fn_14_break_labels",
    "SELECT p_partkey, CASE k WHEN 0 THEN printf('< %.2f', hi) WHEN 4 THEN printf('> %.2f', lo) ELSE printf('%.2f–%.2f', lo, hi) END AS label FROM (SELECT p_partkey, p_size % 5 AS k, (p_size % 5) / 4e0 AS lo, (p_size % 5 + 1) / 4e0 AS hi FROM part)",
)
def _(t):
    k = F.col("p_size") % 5
    return t.part.select("p_partkey", fn.break_label(k, F.lit(5), k / 4.0, (k + 1) / 4.0).alias("label"))


@query("fn_15_category_code", "SELECT p_partkey, CAST(round_even(p_size / 2e0, 0) AS INTEGER) AS code FROM part")
def _(t):
    return t.part.select("p_partkey", fn.category_code(F.col("p_size") / 2.0).alias("code"))
