"""Window functions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrastat.functions.scalar import nodata_to_null
from terrastat.operators import ranks
from terrastat.operators.index import best_component
from terrastat.operators.learn import training_rows
from terrastat.operators.smooth import lowess
from terrastat.operators.spatial import fill_gaps, tile_index
from terrastat.plans.data import NODATA, POINTS, PREDICTED, RASTER, TILE, TILE_OF, WIDTH, points, predicted, raster
from terrastat.plans.registry import query, r, rnd

_PRIO = "(SELECT o_orderpriority AS level, sum(o_totalprice) AS v FROM orders GROUP BY 1)"


@query("win_01_cumulative_share", f"SELECT level, {r('100 * v / sum(v) OVER ()', 8)} AS percentage, {r('sum(100 * v) OVER (ORDER BY level) / sum(v) OVER ()', 8)} AS cumulative FROM {_PRIO}")
def _(t):
    v = t.orders.groupBy(F.col("o_orderpriority").alias("level")).agg(F.sum("o_totalprice").alias("v"))
    return rnd(ranks.cumulative_share(v, "v", ["level"]).drop("v"), 8, "percentage", "cumulative")


_COORD = "(SELECT p_type AS variable, CAST(substr(p_brand, 7) AS INTEGER) AS dim, avg(p_retailprice) - 950 AS coord FROM part GROUP BY 1, 2)"


@query("win_02_best_component", f"SELECT variable, dim, {r('coord', 6)} AS coord FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY abs(coord) DESC, dim) AS k FROM {_COORD}) WHERE k = 1")
def _(t):
    c = t.part.groupBy(F.col("p_type").alias("variable"), F.substring("p_brand", 7, 9).cast("int").alias("dim")).agg((F.avg("p_retailprice") - 950).alias("coord"))
    return rnd(best_component(c), 6, "coord")


_P = "(SELECT o_orderstatus AS family, o_custkey AS test, avg(o_orderkey % 1000) / 100000e0 AS p FROM orders GROUP BY 1, 2)"


@query(
    "win_03_holm",
    f"SELECT family, test, {r('p', 9)} AS p, {r('least(1, max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING))', 11)} AS p_holm FROM (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p AS step FROM {_P})",
)
def _(t):
    p = t.orders.groupBy(F.col("o_orderstatus").alias("family"), F.col("o_custkey").alias("test")).agg((F.avg(F.col("o_orderkey") % 1000) / 100000.0).alias("p"))
    return rnd(rnd(ranks.holm_long(p, "p", ["family"], "test"), 9, "p"), 11, "p_holm")


_P5 = "(SELECT o_orderstatus AS family, o_orderpriority AS test, avg(o_orderkey % 1000) / 100000e0 AS p FROM orders GROUP BY 1, 2)"


@query(
    "win_03_holm_families",
    f"SELECT family, test, {r('least(1, max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING))', 11)} AS p_holm FROM (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p AS step FROM {_P5})",
)
def _(t):
    p = t.orders.groupBy(F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("test")).agg((F.avg(F.col("o_orderkey") % 1000) / 100000.0).alias("p"))
    return rnd(ranks.holm(p, "p", ["family"], tie=["test"]).drop("p"), 11, "p_holm")


@query("win_04_first_per_panel", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(t):
    return ranks.top_per_group(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("win_05_outer_folds", "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY md5('123:' || o_orderkey), o_orderkey) AS INTEGER) AS fold FROM orders")
def _(t):
    return ranks.assign_folds(t.orders.select("o_orderkey"), ["o_orderkey"], 5, 123)


@query(
    "win_05_inner_folds",
    "SELECT f AS train_fold, c_custkey, CAST(ntile(4) OVER (PARTITION BY f ORDER BY md5('9:' || c_custkey), c_custkey) AS INTEGER) AS inner_fold FROM (SELECT c_custkey, ntile(5) OVER (ORDER BY md5('123:' || c_custkey), c_custkey) AS fold FROM customer), (VALUES (1), (2), (3), (4), (5)) AS k(f) WHERE fold <> f",
)
def _(t):
    outer = ranks.assign_folds(t.customer.select("c_custkey"), ["c_custkey"], 5, 123)
    train = training_rows(outer, "fold", 5)
    return ranks.assign_folds(train, ["c_custkey"], 4, 9, by=["train_fold"], out="inner_fold").select("train_fold", "c_custkey", "inner_fold")


@query("win_06_sample_rows", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def _(t):
    return ranks.sample_rows(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 500, 42)


@query(
    "win_06_sample_per_group",
    "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 100",
)
def _(t):
    return ranks.sample_rows(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 100, 42, ["o_orderstatus"])


def _near(line: str, along: str, forward: bool) -> str:
    if forward:
        return f"nullif(first_value(v IGNORE NULLS) OVER (PARTITION BY tile, {line} ORDER BY {along} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 950e0)"
    return f"nullif(last_value(v IGNORE NULLS) OVER (PARTITION BY tile, {line} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 950e0)"


FILLED = f"""(SELECT tile, row, col, CASE WHEN v IS NOT NULL THEN v WHEN avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY tile) < 0.001 THEN 950e0
ELSE coalesce({_near('row', 'col', False)}, {_near('row', 'col', True)}, {_near('col', 'row', False)}, {_near('col', 'row', True)}, 950e0) END AS filled
FROM (SELECT row, col, {TILE_OF} AS tile, CASE WHEN price = -9999 THEN NULL ELSE price END AS v FROM {RASTER}))"""


@query("win_07_gap_fill", f"SELECT tile, row, col, {r('filled', 2)} AS filled FROM {FILLED}")
def _(t):
    px = raster(t).select(tile_index("row", "col", TILE, WIDTH).alias("tile"), "row", "col", nodata_to_null("price", NODATA).alias("v"))
    return rnd(fill_gaps(px, "v", 950.0).select("tile", "row", "col", "filled"), 2, "filled")


@query(
    "win_08_rolling_mean",
    f"SELECT o_orderstatus, o_orderkey, {r('sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25', 2)} AS smooth FROM orders",
)
def _(t):
    d = ranks.rolling_mean(t.orders, ["o_orderstatus"], "o_custkey", "o_orderkey", "o_totalprice", 25)
    return rnd(d.select("o_orderstatus", "o_orderkey", "smooth"), 2, "smooth")


# the statement inverts the series of the normal distribution by Newton steps from a rough rational start
_ODD = [math.prod(range(1, 2 * k + 2, 2)) for k in range(75)]


def _newton(name: str, p: str, source: str, steps: int = 4) -> str:
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    start = f"sign({p} - 0.5e0) * ({t} - (2.515517e0 + 0.802853e0 * {t} + 0.010328e0 * {t} * {t}) / (1 + 1.432788e0 * {t} + 0.189269e0 * {t} * {t} + 0.001308e0 * {t} * {t} * {t}))"
    out = f"(SELECT *, {start} AS {name} FROM {source})"
    for _ in range(steps):
        series = f"list_sum([power({name}, 2 * i - 1) / [{', '.join(f'{float(v)!r}' for v in _ODD)}][i] FOR i IN range(1, {len(_ODD) + 1})])"
        out = f"(SELECT * EXCLUDE ({name}), {name} - (0.5e0 - {p}) * sqrt(2 * pi()) * exp({name} * {name} / 2) - {series} AS {name} FROM {out})"
    return out


@query(
    "win_10_normal_scores",
    f"SELECT response, obs, n_rows, {r('a', 6)} AS score_first, {r('b', 6)} AS score_last FROM "
    + _newton("b", "pb", _newton("a", "pa", "(SELECT response, obs, count(*) AS n_rows, (min(k) - 0.5e0) / any_value(n) AS pa, (max(k) - 0.5e0) / any_value(n) AS pb FROM "
    f"(SELECT response, obs, row_number() OVER (PARTITION BY response ORDER BY obs) AS k, count(*) OVER (PARTITION BY response) AS n FROM {PREDICTED}) GROUP BY 1, 2)")),
)
def _(t):
    return rnd(ranks.normal_scores(predicted(t), "obs", ["response"]), 6, "score_first", "score_last")


_IMP = "(SELECT p_brand AS response, p_type AS feature, abs(avg(p_retailprice) - 950) AS v FROM part GROUP BY 1, 2)"


def _importance(t):
    return t.part.groupBy(F.col("p_brand").alias("response"), F.col("p_type").alias("feature")).agg(F.abs(F.avg("p_retailprice") - 950).alias("v"))


@query("win_11_share_of_maximum", f"SELECT response, feature, {r('v / max(v) OVER (PARTITION BY response)', 8)} AS share FROM {_IMP}")
def _(t):
    return rnd(ranks.share_of_group_max(_importance(t), "v", ["response"], "share").drop("v"), 8, "share")


@query(
    "win_12_best_across_groups",
    f"SELECT feature, {r('max(s)', 8)} AS best, row_number() OVER (ORDER BY round(max(s), 10) DESC, feature) AS position FROM (SELECT feature, v / max(v) OVER (PARTITION BY response) AS s FROM {_IMP}) GROUP BY 1 ORDER BY position LIMIT 3",
)
def _(t):
    shares = ranks.share_of_group_max(_importance(t), "v", ["response"], "s")
    best = shares.groupBy("feature").agg(F.max("s").alias("best"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.round("best", 10).desc(), "feature")  # one row per feature
    return rnd(best.withColumn("position", F.row_number().over(w).cast("long")).filter("position <= 3"), 8, "best")


_D = "abs(b.x - a.x) / CASE WHEN a.h > 0 THEN a.h ELSE 1 END"
_TRICUBE = f"CASE WHEN {_D} <= 0.001 THEN 1e0 WHEN {_D} >= 0.999 THEN 0e0 ELSE power(1 - power({_D}, 3), 3) END"


def _lowess_sql() -> str:
    """Four fits, each by a join of the table with itself, with bisquare weights from the residuals in between."""
    steps = """p0 AS MATERIALIZED (SELECT id, x, v AS y, row_number() OVER (ORDER BY x, id) - 1 AS p, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 0.4e0 + 1e-10) AS BIGINT) AS k FROM """ + POINTS + """),
m AS MATERIALIZED (SELECT a.x + b.x AS m FROM p0 a JOIN p0 b ON b.p = a.p + a.k),
p1 AS MATERIALIZED (SELECT a.id, a.x, a.y, a.p, a.k, (SELECT count(*) FROM m WHERE m.m < 2 * a.x) AS l FROM p0 a),
r0 AS MATERIALIZED (SELECT a.*, greatest(a.x - lo.x, hi.x - a.x) AS h, 1e0 AS rw FROM p1 a JOIN p0 lo ON lo.p = a.l JOIN p0 hi ON hi.p = a.l + a.k - 1)"""
    for i in range(4):
        steps += f", f{i} AS MATERIALIZED (SELECT id, x, y, p, l, k, h, s FROM (SELECT id, x, y, p, l, k, h, CASE WHEN s0 <= 0 THEN y WHEN s0 * s2 - s1 * s1 <= 1e-12 * s0 * s0 THEN t0 / s0 ELSE (t0 * s2 - s1 * t1) / (s0 * s2 - s1 * s1) END AS s FROM (SELECT id, x, y, p, l, k, h, sum(w) AS s0, sum(w * dx) AS s1, sum(w * dx * dx) AS s2, sum(w * yb) AS t0, sum(w * dx * yb) AS t1 FROM (SELECT a.id, a.x, a.y, a.p, a.l, a.k, a.h, b.x - a.x AS dx, b.y AS yb, {_TRICUBE} * b.rw AS w FROM r{i} a JOIN r{i} b ON b.p >= a.l AND b.p < a.l + a.k) GROUP BY ALL)))"
        if i < 3:
            steps += f", r{i + 1} AS MATERIALIZED (SELECT id, x, y, p, l, k, h, CASE WHEN med <= 0 OR u <= 0.001 THEN 1e0 WHEN u >= 0.999 THEN 0e0 ELSE power(1 - u * u, 2) END AS rw FROM (SELECT *, abs(y - s) / (6 * med) AS u FROM (SELECT *, median(abs(y - s)) OVER () AS med FROM f{i})))"
    return f"WITH {steps} SELECT id, {r('x', 9)} AS x, {r('y', 9)} AS y, {r('s', 8)} AS smooth FROM f3"


@query("win_09_lowess", _lowess_sql())
def _(t):
    return rnd(lowess(points(t).select("id", "x", F.col("v").alias("y"))), 9, "x", "y").withColumn("smooth", F.round("smooth", 8))
