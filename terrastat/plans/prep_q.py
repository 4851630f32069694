"""Projections, filters and predicates; set and reshape operators; sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.functions import scalar as fn
from terrastat.operators import prep
from terrastat.operators.ranks import top_per_group
from terrastat.operators.spatial import anchored
from terrastat.operators.summary import finite_pairs, pearson_p, pearson_pairs, strong_pairs
from terrastat.plans.data import BLOCK, BLOCK_COLUMNS, COVERS, DEPTHS, GAPPY, LOCATED, MID_CM, NODATA, PREDICTED, RASTER, block, gappy, located, predicted, raster
from terrastat.plans.registry import query, r, rnd
from terrastat.session import keyed
from terrastat.sources.tables import preview

_TEXT = "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE replace(printf('%.2f', o_totalprice), '.', ',') END"


def _levels(name: str, levels, value: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {lv!r} THEN {i}" for i, lv in enumerate(levels)) + f" END AS {name}"


@query("prj_01_decimal_comma", f"SELECT o_orderkey, {r('try_cast(replace(txt, chr(44), chr(46)) AS DOUBLE)', 2)} AS price FROM (SELECT o_orderkey, {_TEXT} AS txt FROM orders)")
def _(t):
    text = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")))
    d = prep.convert_columns(t.orders.select("o_orderkey", text.alias("txt")), {"txt": "price"})
    return rnd(d.select("o_orderkey", "price"), 2, "price")


@query("prj_02_factor", f"SELECT o_orderkey, {_levels('lc_index', COVERS[:4], 'o_orderpriority')} FROM orders")
def _(t):
    return t.orders.select("o_orderkey", fn.factor_index("o_orderpriority", COVERS[:4]).alias("lc_index"))


@query("prj_03_code_map", "SELECT p_partkey, CASE upper(p_type) WHEN 'STANDARD' THEN 'ST' WHEN 'ECONOMY' THEN 'EC' WHEN 'LARGE' THEN 'LA' END AS code FROM part")
def _(t):
    codes = {"STANDARD": "ST", "ECONOMY": "EC", "LARGE": "LA"}
    return t.part.select("p_partkey", fn.code_lookup(F.lower("p_type"), codes, upper=True).alias("code"))


@query("prj_04_unmatched_keys", "SELECT DISTINCT p_type FROM part WHERE upper(p_type) NOT IN ('STANDARD', 'ECONOMY', 'LARGE')")
def _(t):
    return prep.unmatched_keys(t.part, "p_type", {"STANDARD": 1, "ECONOMY": 2, "LARGE": 3}, upper=True)


@query("prj_05_group_id", "SELECT regexp_replace(l_orderkey || '_' || l_linenumber, '_[0-9]+$', '') AS plot, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    ids = t.lineitem.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("sample"))
    return ids.groupBy(fn.group_id("sample").alias("plot")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_06_centred_rank", "SELECT l_orderkey, l_linenumber - 4 AS dc, CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END AS is_a FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 4).alias("dc"), fn.indicator("l_returnflag", "A").alias("is_a"))


def _coding(value: str) -> str:
    rows = ", ".join(f"({d}, {value.format(cm=f'{c}e0', i=f'{i}e0')})" for i, (d, c) in enumerate(zip(DEPTHS, MID_CM), 1))
    return f"(SELECT d, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS dc FROM (VALUES {rows}) AS t(d, v))"


@query(
    "prj_07_slope_coding",
    " UNION ALL ".join(
        f"SELECT '{k}' AS coding, l_linenumber, {r('dc', 9)} AS dc, count(*) AS n FROM lineitem JOIN {_coding(v)} ON d = l_linenumber GROUP BY ALL"
        for k, v in {"cm": "{cm}", "log": "ln({cm})", "rank": "{i}"}.items()
    ),
)
def _(t):
    coded = {
        k: t.lineitem.select("l_linenumber", prep.slope_code("l_linenumber", DEPTHS, MID_CM, k).alias("dc")).groupBy("l_linenumber", "dc").agg(F.count(F.lit(1)).alias("n"))
        for k in ("cm", "log", "rank")
    }
    return rnd(prep.union_tagged(coded, "coding"), 9, "dc")


@query("prj_08_unit_conversion", f"SELECT l_orderkey, {r('l_quantity / 10', 6)} AS qty FROM lineitem")
def _(t):
    return rnd(t.lineitem.select("l_orderkey", (F.col("l_quantity") / 10).alias("qty")), 6, "qty")


_WHOLE = "price IS NOT NULL AND cust IS NOT NULL AND prio IS NOT NULL"


@query(
    "prj_09_complete_cases",
    f"SELECT count(*) AS n_rows, count(*) FILTER ({_WHOLE}) AS n_complete, count(*) - count(*) FILTER ({_WHOLE}) AS n_excluded, (count(*) - count(*) FILTER ({_WHOLE})) / count(*) > 0.1 AS warn FROM {GAPPY}",
)
def _(t):
    return prep.excluded_count(gappy(t), ["price", "cust", "prio"])


@query("prj_10_drop_null_response", f"SELECT o_orderkey, {r('target', 6)} AS target FROM {GAPPY} WHERE target IS NOT NULL")
def _(t):
    return rnd(prep.complete_cases(gappy(t), ["target"]).select("o_orderkey", "target"), 6, "target")


@query(
    "prj_11_nodata_to_null",
    f"SELECT row, col, CASE WHEN isnan(v) OR isinf(v) OR abs(v + 9999) <= 1e-8 + 1e-5 * 9999 THEN NULL ELSE {r('v', 2)} END AS value FROM (SELECT row, col, CASE WHEN size = 13 THEN 'NaN'::DOUBLE WHEN size = 17 THEN 'Infinity'::DOUBLE ELSE price END AS v FROM {RASTER})",
)
def _(t):
    v = F.when(F.col("size") == 13, float("nan")).when(F.col("size") == 17, float("inf")).otherwise(F.col("price"))
    return rnd(raster(t).select("row", "col", fn.nodata_to_null(v, NODATA).alias("value")), 2, "value")


@query("prj_12_available_columns", f"SELECT l_orderkey, {r('price', 2)} AS price, {r('tax', 2)} AS tax FROM {BLOCK}")
def _(t):
    b = block(t)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cols = prep.available_columns(b, ["price", "tax", "elevation"])
    return rnd(b.select("l_orderkey", *cols), 2, *cols)


@query("prj_13_prefix_exclusion", "SELECT feature, count(*) AS n FROM (SELECT p_type || '_' || p_brand AS feature FROM part) WHERE NOT starts_with(feature, 'SMALL') AND NOT starts_with(feature, 'PROMO') GROUP BY 1")
def _(t):
    d = t.part.select(F.concat_ws("_", "p_type", "p_brand").alias("feature"))
    return prep.exclude_prefixes(d, "feature", ["SMALL", "PROMO"]).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, count(*) AS n FROM {BLOCK}"
    for i, a in enumerate(BLOCK_COLUMNS)
    for b in BLOCK_COLUMNS[i + 1 :]
)


@query("prj_14_strong_pairs", f"SELECT var1, var2, {r('r', 8)} AS r, n FROM ({PAIRS_SQL}) WHERE abs(r) > 0.75")
def _(t):
    return rnd(strong_pairs(pearson_p(pearson_pairs(block(t), BLOCK_COLUMNS))).drop("p"), 8, "r")


@query("prj_15_anchor_mask", f"SELECT row, col FROM {LOCATED} WHERE price IS NOT NULL AND size IS NOT NULL")
def _(t):
    return anchored(located(t), ["price", "size"]).select("row", "col")


_MESSY = f"(SELECT obs, CASE WHEN l_orderkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN '-Infinity'::DOUBLE ELSE pred END AS pred FROM {PREDICTED})"


@query("prj_16_finite_pairs", f"SELECT count(*) AS n, {r('avg(pred)', 4)} AS mean_pred FROM {_MESSY} WHERE pred IS NOT NULL AND NOT isnan(pred) AND NOT isinf(pred) AND obs IS NOT NULL")
def _(t):
    k = F.col("l_orderkey")
    pred = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, None).when(k % 13 == 0, float("-inf")).otherwise(F.col("pred"))
    d = finite_pairs(predicted(t).withColumn("pred", pred))
    return rnd(d.agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred")), 4, "mean_pred")


# ------------------------------------------------------------ sorts and limits


@query("srt_01_sort", f"SELECT var1, var2, {r('r', 8)} AS r, row_number() OVER (ORDER BY abs(round(r, 8)) DESC, var1, var2) AS position FROM ({PAIRS_SQL})")
def _(t):
    pairs = rnd(pearson_pairs(block(t), BLOCK_COLUMNS), 8, "r").select("var1", "var2", "r")
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.abs("r").desc(), "var1", "var2")  # one row per pair of columns
    return pairs.orderBy(F.abs("r").desc(), "var1", "var2").withColumn("position", F.row_number().over(w).cast("long"))


@query(
    "srt_02_top_per_group",
    "SELECT p_type, p_partkey, rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rank FROM part) WHERE rank <= 10",
)
def _(t):
    d = top_per_group(t.part, ["p_type"], [F.col("p_size").desc(), F.col("p_partkey")], 10)
    return d.select("p_type", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("srt_03_preview", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20")
def _(t):
    return preview(t.orders.select("o_orderkey", "o_orderpriority"), 20, "o_orderkey")


_DECLARED = ["3-MEDIUM", "5-LOW", "1-URGENT", "4-NOT SPECIFIED", "2-HIGH"]


@query("srt_04_level_order", f"SELECT o_orderpriority, {_levels('position', _DECLARED, 'o_orderpriority')}, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    d = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("position", fn.factor_index("o_orderpriority", _DECLARED)).orderBy("position")


# -------------------------------------------------------- set and reshape ops


@query(
    "set_01_union_all",
    f"SELECT 'status' AS grouping, o_orderstatus AS level, count(*) AS n, {r('avg(o_totalprice)', 4)} AS mean FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*), {r('avg(o_totalprice)', 4)} FROM orders GROUP BY 2",
)
def _(t):
    parts = {
        name: t.orders.groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))
        for name, c in {"status": "o_orderstatus", "priority": "o_orderpriority"}.items()
    }
    return rnd(prep.union_tagged(parts, "grouping"), 4, "mean")


@query("set_02_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def _(t):
    return t.orders.select("o_custkey", "o_orderstatus").distinct()


@query("set_03_difference", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    served = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return t.customer.select(F.col("c_custkey").alias("custkey")).subtract(served)


@query(
    "set_04_pooled_values",
    f"SELECT o_orderstatus, count(*) AS n, {r('min(v)', 2)} AS lo, {r('max(v)', 2)} AS hi FROM (SELECT o_orderstatus, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1",
)
def _(t):
    plots = t.orders.select("o_orderkey", "o_orderstatus")
    lines = t.lineitem.join(plots, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderstatus", F.col("l_extendedprice").alias("v"))
    pooled = t.orders.select("o_orderstatus", F.col("o_totalprice").alias("v")).unionByName(lines)
    return rnd(pooled.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), 2, "lo", "hi")


@query(
    "set_05_wide_long",
    "SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN l_linenumber = {d} THEN {r('v', 4)} END) AS d{d}" for d in DEPTHS) + " FROM (SELECT l_orderkey, l_linenumber, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    lines = keyed(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    per = lines.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))
    return prep.depth_wide(per, "l_orderkey", "l_linenumber", DEPTHS, "v", "d")


@query(
    "set_05_long_melt",
    f"SELECT variable, count(value) AS n, {r('sum(value)', 1)} AS total FROM {BLOCK} UNPIVOT (value FOR variable IN (qty, disc, tax, price)) GROUP BY 1",
)
def _(t):
    from terrastat.operators.summary import to_long

    long = to_long(block(t), ["qty", "disc", "tax", "price"])
    return rnd(long.groupBy("variable").agg(F.count("value").alias("n"), F.sum("value").alias("total")), 1, "total")
