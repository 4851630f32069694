"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.config import ALPHA
from terrastat.operators import prep, spatial
from terrastat.operators.neighbours import nearest_samples
from terrastat.plans.data import COVERS, DEPTHS, GRID, INSIDE, LOCATED, POINTS, RASTER, SAMPLES, SITES, STRIP, located, points, raster_path, region_edges, samples
from terrastat.plans.registry import query, r, rnd
from terrastat.sources.raster import sample_raster

_ROWCOL = "CAST(floor((y - (-0.5e0)) / 0.025e0) AS BIGINT) AS row, CAST(floor((x - (-0.5e0)) / 0.02e0) AS BIGINT) AS col"


@query(
    "join_01_nearest_pixel",
    f"SELECT p.id, p.row, p.col, {r('g.size', 2)} AS size, {r('g.price', 2)} AS price FROM (SELECT id, {_ROWCOL} FROM {POINTS}) p LEFT JOIN {RASTER} g ON g.row = p.row AND g.col = p.col",
)
def _(t):
    d = sample_raster(points(t), t.spark, raster_path(t), GRID, ["size", "price"])
    return rnd(d.select("id", "row", "col", "size", "price"), 2, "size", "price")


@query(
    "join_02_band_assembly",
    f"SELECT p.id, {r('g.price', 2)} AS price, {r('g.size', 2)} AS size, g.kind FROM (SELECT id, {_ROWCOL} FROM {POINTS}) p JOIN {RASTER} g ON g.row = p.row AND g.col = p.col",
)
def _(t):
    d = sample_raster(points(t), t.spark, raster_path(t), GRID, ["price", "size", "kind"], "inner")
    return rnd(d.select("id", "price", "size", "kind"), 2, "price", "size")


_EST = "(SELECT o_orderstatus AS site, o_orderpriority AS lc, avg(o_totalprice) AS est FROM orders GROUP BY 1, 2)"
_TST = "(SELECT o_orderstatus AS site, o_orderpriority AS lc, avg(o_custkey % 100) / 1000e0 AS p FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2)"


@query(
    "join_03_estimates_tests",
    f"SELECT e.site, e.lc, {r('est', 4)} AS est, {r('p', 8)} AS p, coalesce(p < 0.05, false) AS significant FROM {_EST} e LEFT JOIN {_TST} s ON s.site = e.site AND s.lc = e.lc",
)
def _(t):
    by = [F.col("o_orderstatus").alias("site"), F.col("o_orderpriority").alias("lc")]
    est = t.orders.groupBy(*by).agg(F.avg("o_totalprice").alias("est"))
    tests = t.orders.filter("o_orderpriority <> '1-URGENT'").groupBy(*by).agg((F.avg(F.col("o_custkey") % 100) / 1000.0).alias("p"))
    d = prep.estimates_with_tests(est, tests, ["site", "lc"], "p", ALPHA)
    return rnd(rnd(d, 4, "est"), 8, "p")


@query(
    "join_04_letter_tables",
    """SELECT lo.lc, lo.site, lo.letter AS lower_letter, upper(up.letter) AS upper_letter FROM
(SELECT site, lc, chr(CAST(96 + rank() OVER (PARTITION BY site ORDER BY n DESC, lc) AS INTEGER)) AS letter FROM (SELECT o_orderstatus AS site, o_orderpriority AS lc, count(*) AS n FROM orders GROUP BY 1, 2)) lo
JOIN (SELECT site, lc, chr(CAST(96 + rank() OVER (PARTITION BY lc ORDER BY n DESC, site) AS INTEGER)) AS letter FROM (SELECT o_orderstatus AS site, o_orderpriority AS lc, count(*) AS n FROM orders GROUP BY 1, 2)) up
ON up.site = lo.site AND up.lc = lo.lc""",
)
def _(t):
    from pyspark.sql import Window

    n = t.orders.groupBy(F.col("o_orderstatus").alias("site"), F.col("o_orderpriority").alias("lc")).agg(F.count(F.lit(1)).alias("n"))

    def letters(panel, level, name):
        w = Window.partitionBy(panel).orderBy(F.col("n").desc(), level)
        return n.select("site", "lc", F.chr(F.lit(96) + F.rank().over(w)).alias(name))

    low, up = letters("site", "lc", "lower_letter"), letters("lc", "site", "upper_letter")
    return low.join(up, ["site", "lc"]).select("lc", "site", "lower_letter", F.upper("upper_letter").alias("upper_letter"))


_VALUES = {"site": SITES, "lc": COVERS, "depth": DEPTHS}


def _values(name: str) -> str:
    return f"(VALUES {', '.join(f'({v!r})' for v in _VALUES[name])}) AS {name[0]}({name})"


@query(
    "join_05_factor_grid",
    f"SELECT g.site, g.lc, g.depth, d.n, {r('d.mean', 6)} AS mean FROM (SELECT site, lc, depth FROM {_values('site')}, {_values('lc')}, {_values('depth')}) g LEFT JOIN (SELECT site, lc, depth, count(*) AS n, avg(y) AS mean FROM {SAMPLES} GROUP BY 1, 2, 3) d ON d.site = g.site AND d.lc = g.lc AND d.depth = g.depth",
)
def _(t):
    return rnd(prep.grid_cells(samples(t), _VALUES, [F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")]), 6, "mean")


@query(
    "join_06_missing_cells",
    f"SELECT p.site, depth, count(*) AS n_missing FROM (SELECT DISTINCT plot, site, lc FROM {SAMPLES}) p, {_values('depth')} WHERE NOT EXISTS (SELECT 1 FROM {SAMPLES} o WHERE o.plot = p.plot AND o.depth = d.depth) GROUP BY 1, 2",
)
def _(t):
    gaps = prep.missing_cells(samples(t), "plot", "depth", DEPTHS, ["site", "lc"])
    return gaps.groupBy("site", "depth").agg(F.count(F.lit(1)).alias("n_missing"))


_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(
    "join_07_near_pairs",
    f"SELECT a.id, sum(CASE WHEN {_DIST} <= 0.2e0 AND a.id <> b.id THEN 1 ELSE 0 END)::BIGINT AS n_near, {r(f'sum(CASE WHEN {_DIST} <= 0.2e0 AND a.id <> b.id THEN {_DIST} ELSE 0 END)', 8)} AS sum_h, {r(f'sum(CASE WHEN {_DIST} <= 0.2e0 AND a.id <> b.id THEN (a.v - b.v) * (a.v - b.v) ELSE 0 END)', 8)} AS sum_sq FROM {POINTS} a, {POINTS} b GROUP BY a.id",
)
def _(t):
    return rnd(spatial.near_pair_sums(points(t), 0.2), 8, "sum_h", "sum_sq")


@query(
    "join_08_nearest_neighbours",
    f"SELECT qid, sid, rank, {r('d', 9)} AS d FROM (SELECT a.qid, b.id AS sid, {_DIST} AS d, row_number() OVER (PARTITION BY a.qid ORDER BY {_DIST}, b.id) AS rank FROM {LOCATED} a, {POINTS} b) WHERE rank <= 8",
)
def _(t):
    s = points(t).select(F.col("id").alias("sid"), "x", "y", "v")
    d = nearest_samples(located(t).select("qid", "x", "y"), s, 8)
    return rnd(d.select("qid", "sid", F.col("rank").cast("long").alias("rank"), "d"), 9, "d")


@query("join_09_point_in_polygon", f"SELECT qid, region FROM {INSIDE}")
def _(t):
    return spatial.pixels_in_regions(located(t), region_edges(t), STRIP).select("qid", "region")


_MEANS = f"(SELECT site, lc, avg(y) AS m FROM {SAMPLES} GROUP BY 1, 2)"


@query(
    "join_10_level_pairs",
    f"SELECT a.site, a.lc AS a, b.lc AS b, {r('a.m - b.m', 6)} AS estimate FROM {_MEANS} a JOIN {_MEANS} b ON a.site = b.site AND a.lc < b.lc",
)
def _(t):
    from terrastat.functions.scalar import factor_index

    means = samples(t).groupBy("site", "lc").agg(F.avg("y").alias("m")).withColumn("i", factor_index("lc", COVERS))
    return rnd(prep.level_pairs(means, ["site"], "i", "lc", "m"), 6, "estimate")


@query(
    "join_10_against_reference",
    f"SELECT a.site, a.lc AS a, b.lc AS b, {r('a.m - b.m', 6)} AS estimate FROM {_MEANS} a JOIN {_MEANS} b ON a.site = b.site AND a.lc > b.lc AND b.lc = '1-URGENT'",
)
def _(t):
    from terrastat.functions.scalar import factor_index

    means = samples(t).groupBy("site", "lc").agg(F.avg("y").alias("m")).withColumn("i", factor_index("lc", COVERS))
    return rnd(prep.against_reference(means, ["site"], "i", "lc", "m"), 6, "estimate")


@query(
    "join_11_weight_alignment",
    f"SELECT CAST(position AS INTEGER) AS position, score, {r('w', 8)} AS weight FROM (VALUES (0, '1-URGENT', 'u_score'), (1, '5-LOW', 'l_score'), (2, '3-MEDIUM', 'm_score')) AS e(position, name, score) JOIN (SELECT o_orderpriority AS name, sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) AS w FROM orders GROUP BY 1) USING (name)",
)
def _(t):
    total = t.orders.agg(F.sum("o_totalprice").alias("s")).scalar()
    w = t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.sum("o_totalprice").alias("s")).select("name", (F.col("s") / total).alias("w"))
    return rnd(prep.align_weights(w, "name", "w", {"1-URGENT": "u_score", "5-LOW": "l_score", "3-MEDIUM": "m_score"}), 8, "weight")
