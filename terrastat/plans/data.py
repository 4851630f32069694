"""The given tables in the roles of the survey: samples, points, pixels, regions, predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.operators.mixed import Design
from terrastat.plans.registry import Tables, is_key
from terrastat.session import keyed
from terrastat.sources.raster import Grid, raster_of
from terrastat.sources.tables import polygon_edges

# ------------------------------------------------- samples: plot x depth rows

SITES = ["F", "O", "P"]
COVERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DEPTHS = [1, 2, 3, 4, 5, 6, 7]
MID_CM = [5.0, 15.0, 25.0, 35.0, 55.0, 75.0, 95.0]
DESIGN = Design(SITES, COVERS, DEPTHS, [float(d - 4) for d in DEPTHS])


def samples(t: Tables, *more: str) -> DataFrame:
    """One response per plot and depth, with the factors of the plot and ``more`` columns of its order."""
    lines = keyed(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    per = lines.groupBy("l_orderkey", "l_linenumber").agg((F.avg("l_extendedprice") / 1000.0).alias("y"))
    plots = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", *more)
    return per.join(plots, per.l_orderkey == plots.o_orderkey).select(
        F.col("l_orderkey").alias("plot"),
        F.col("l_linenumber").alias("depth"),
        F.col("o_orderstatus").alias("site"),
        F.col("o_orderpriority").alias("lc"),
        "y",
        *more,
    )


SAMPLES = """(SELECT l_orderkey AS plot, l_linenumber AS depth, o_orderstatus AS site, o_orderpriority AS lc, y
FROM (SELECT l_orderkey, l_linenumber, avg(l_extendedprice) / 1000e0 AS y FROM lineitem GROUP BY 1, 2)
JOIN orders ON o_orderkey = l_orderkey)"""


def rows(t: Tables) -> DataFrame:
    """Raw rows with their plot's factors."""
    return t.lineitem.join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority"), "l_orderkey"
    )


ROWS = "(SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"

# ----------------------------------------------------------- predictor columns

BLOCK_COLUMNS = ["qty", "disc", "tax", "price", "net", "charge"]


def block(t: Tables) -> DataFrame:
    """Collinear block: price, price after discount, price after tax, and their parts."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
        net.alias("net"),
        (net * (1 + F.col("l_tax"))).alias("charge"),
    )


BLOCK = """(SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_extendedprice AS price,
l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"""


def triple(t: Tables) -> DataFrame:
    """Three moderately correlated indicators: price, discount amount and tax amount."""
    p, d, x = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select(p.alias("a"), (p * d).alias("b"), (p * (1 - d) * x).alias("c"), F.col("l_quantity").alias("extra"))


TRIPLE = """(SELECT l_extendedprice AS a, l_extendedprice * l_discount AS b,
l_extendedprice * (1 - l_discount) * l_tax AS c, l_quantity AS extra FROM lineitem)"""


def gappy(t: Tables) -> DataFrame:
    """Order rows with missing values and a category."""
    return t.orders.select(
        "o_orderkey",
        F.when(~is_key("o_orderkey", 11), F.col("o_totalprice")).alias("price"),
        F.when(~is_key("o_custkey", 7), F.col("o_custkey").cast("double")).alias("cust"),
        F.when(~is_key("o_orderkey", 13), F.col("o_orderpriority")).alias("prio"),
        F.when(~is_key("o_orderkey", 5), F.col("o_totalprice") / 1000.0 + F.col("o_custkey")).alias("target"),
    )


GAPPY = """(SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS cust,
CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS prio,
CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000e0 + o_custkey END AS target FROM orders)"""


def predicted(t: Tables) -> DataFrame:
    """Observed and predicted values with a response key and a fold."""
    return t.lineitem.select(
        "l_orderkey",
        F.col("l_returnflag").alias("response"),
        (F.pmod("l_orderkey", F.lit(5)) + 1).cast("int").alias("fold"),
        F.col("l_extendedprice").alias("obs"),
        (F.col("l_quantity") * 1500.0 + F.col("l_extendedprice") / 2.0).alias("pred"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred_b"),
    )


PREDICTED = """(SELECT l_orderkey, l_returnflag AS response, CAST(l_orderkey % 5 + 1 AS INTEGER) AS fold, l_extendedprice AS obs,
l_quantity * 1500e0 + l_extendedprice / 2e0 AS pred, l_extendedprice * (1 - l_discount) AS pred_b FROM lineitem)"""

# --------------------------------------------------------------------- points


def points(t: Tables) -> DataFrame:
    """Places with a value that varies smoothly in space beside its own noise."""
    e = F.col("embedding")
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        e[0].cast("double").alias("x"),
        e[1].cast("double").alias("y"),
        (F.sin(e[0].cast("double") * 8.0) + F.cos(e[1].cast("double") * 6.0) / 2.0 + e[2].cast("double")).alias("v"),
        "label",
    )


POINTS = """(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
sin(CAST(embedding[1] AS DOUBLE) * 8e0) + cos(CAST(embedding[2] AS DOUBLE) * 6e0) / 2e0 + CAST(embedding[3] AS DOUBLE) AS v, label FROM embeddings)"""


FEATURES = ["f1", "f2", "f3", "f4"]


def survey(t: Tables) -> DataFrame:
    """Points with covariates, a category and a response that depends on covariates and place."""
    e = F.col("embedding")
    f = [e[i + 4].cast("double") for i in range(4)]
    y = 3.0 * f[0] - 2.0 * f[1] + f[2] * f[3] * 10.0 + F.sin(e[0].cast("double") * 12.0) + F.col("label") * 0.05
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        e[0].cast("double").alias("x"),
        e[1].cast("double").alias("y"),
        *[c.alias(n) for c, n in zip(f, FEATURES)],
        F.col("label").cast("string").alias("soil"),
        y.alias("target"),
    )


# --------------------------------------------------------------------- pixels

WIDTH = 50
TILE = 16
TRANSFORM = (0.02, 0.0, -0.5, 0.0, 0.025, -0.5)
NODATA = -9999.0


def raster(t: Tables) -> DataFrame:
    """Raster with three bands per pixel; one has nodata gaps."""
    return t.part.select(
        F.floor(F.col("p_partkey") / WIDTH).cast("long").alias("row"),
        F.pmod("p_partkey", F.lit(WIDTH)).cast("long").alias("col"),
        F.when(F.col("p_size") % 7 == 0, NODATA).otherwise(F.col("p_retailprice")).alias("price"),
        F.col("p_size").cast("double").alias("size"),
        F.when(F.col("p_size") % 5 == 0, None).otherwise((F.length("p_type") % 4).cast("double")).alias("kind"),
    )


RASTER = f"""(SELECT p_partkey // {WIDTH} AS row, p_partkey % {WIDTH} AS col,
CASE WHEN p_size % 7 = 0 THEN -9999e0 ELSE p_retailprice END AS price, CAST(p_size AS DOUBLE) AS size,
CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(length(p_type) % 4 AS DOUBLE) END AS kind FROM part)"""

BANDS = ["price", "size", "kind"]


def pixels(t: Tables) -> DataFrame:
    """Long pixel table ``band, row, col, value``."""
    return raster(t).unpivot(["row", "col"], BANDS, "band", "value")


GRID = Grid(WIDTH, TILE, TRANSFORM)


def raster_path(t: Tables) -> str:
    """The pixel table as a tiled raster, written once."""
    return raster_of(pixels(t), GRID, f"{t.folder}/part.parquet")


PIXELS = f"(SELECT row, col, band, value FROM {RASTER} UNPIVOT INCLUDE NULLS (value FOR band IN (price, size, kind)))"

TILE_OF = f"((row // {TILE}) * {-(-WIDTH // TILE)} + (col // {TILE}) + 1)"


def located(t: Tables) -> DataFrame:
    """Pixels with centre coordinates in the plane of the points."""
    from terrastat.functions.scalar import nodata_to_null, pixel_x, pixel_y

    return raster(t).select(
        (F.col("row") * WIDTH + F.col("col")).alias("qid"),
        "row",
        "col",
        pixel_x("col", TRANSFORM).alias("x"),
        pixel_y("row", TRANSFORM).alias("y"),
        nodata_to_null("price", NODATA).alias("price"),
        "size",
    )


def covariate_pixels(t: Tables) -> DataFrame:
    """Pixels with covariates from columns of the part table, in the ranges of the survey's."""
    from terrastat.functions.scalar import pixel_x, pixel_y

    row, column = F.floor(F.col("p_partkey") / WIDTH), F.pmod("p_partkey", F.lit(WIDTH))
    return t.part.select(
        F.col("p_partkey").alias("qid"),
        pixel_x(column, TRANSFORM).alias("x"),
        pixel_y(row, TRANSFORM).alias("y"),
        ((F.col("p_size") - 25.5) / 100.0).alias("f1"),
        ((F.col("p_retailprice") - 950.0) / 200.0).alias("f2"),
        ((F.length("p_name") - 12) / 30.0).alias("f3"),
        ((F.substring("p_brand", 7, 9).cast("double") - 12.0) / 40.0).alias("f4"),
        F.pmod("p_size", F.lit(10)).cast("string").alias("soil"),
    )


LOCATED = f"""(SELECT row * {WIDTH} + col AS qid, row, col, -0.5e0 + (col + 0.5e0) * 0.02e0 AS x, -0.5e0 + (row + 0.5e0) * 0.025e0 AS y,
CASE WHEN price = -9999e0 THEN NULL ELSE price END AS price, size FROM {RASTER})"""

# -------------------------------------------------------------------- regions

# Corners of a concave outline, scaled and shifted by the region key.
OUTLINE = [(0.00, 0.00), (0.30, 0.02), (0.28, 0.40), (0.15, 0.18), (0.02, 0.42)]


def region_vertices(t: Tables) -> DataFrame:
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("cx"), F.lit(y).alias("cy")) for i, (x, y) in enumerate(OUTLINE)]))
    k = F.col("r_regionkey")
    return t.region.withColumn("c", corner).select(
        F.col("r_name").alias("region"),
        F.lit(1).alias("ring"),
        F.col("c.seq").alias("seq"),
        (F.col("c.cx") * (1.0 + k * 0.1) - 0.5 + k * 0.17).alias("x"),
        (F.col("c.cy") * (1.0 + k * 0.05) - 0.5 + k * 0.13).alias("y"),
    )


def region_edges(t: Tables) -> DataFrame:
    return polygon_edges(region_vertices(t))


_CORNERS = ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(OUTLINE))
VERTICES = f"""(SELECT r_name AS region, 1 AS ring, seq, cx * (1e0 + r_regionkey * 0.1e0) - 0.5e0 + r_regionkey * 0.17e0 AS x,
cy * (1e0 + r_regionkey * 0.05e0) - 0.5e0 + r_regionkey * 0.13e0 AS y FROM region, (VALUES {_CORNERS}) AS o(seq, cx, cy))"""
EDGES = f"""(SELECT a.region, a.ring, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {VERTICES} a JOIN {VERTICES} b
ON a.region = b.region AND b.seq = (a.seq + 1) % {len(OUTLINE)})"""
STRIP = 0.1

INSIDE = f"""(SELECT p.*, e.region FROM {LOCATED} p JOIN {EDGES} e ON (e.y1 > p.y) <> (e.y2 > p.y)
AND p.x < e.x1 + (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1)
GROUP BY ALL HAVING count(*) % 2 = 1)"""
