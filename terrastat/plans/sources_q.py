"""Sources, sinks and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from terrastat.functions.scalar import nodata_to_null, right_closed_bin, code_lookup, standard_score
from terrastat.operators.index import classify, weighted_index
from terrastat.operators.spatial import tile_index
from terrastat.operators.summary import value_counts
from terrastat.plans.data import BANDS, EDGES, GRID, LOCATED, NODATA, PIXELS, POINTS, RASTER, TILE, TILE_OF, WIDTH, located, pixels, points, raster, raster_path, region_edges
from terrastat.plans.registry import Tables, query, r, rnd
from terrastat.session import new_path
from terrastat.sources import sinks, tables
from terrastat.sources.raster import read_raster_window

# Fixed values of the example index on parts.
SIZE_BINS = [float("-inf"), 10, 20, 30, 40, float("inf")]
PRICE_BINS = [float("-inf"), 910, 930, 950, 960, 970, 980, 990, 995, float("inf")]
TYPE_SCORE = {"STANDARD": 1, "ECONOMY": 2, "MEDIUM": 3, "LARGE": 4, "SMALL": 5}
PART_WEIGHTS = {"size_score": 0.5, "price_score": 0.3, "type_score": 0.2}

_SIZE = "CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 20 THEN 2 WHEN p_size <= 30 THEN 3 WHEN p_size <= 40 THEN 4 ELSE 5 END * 0.2e0"
_PRICE = """CASE WHEN p_retailprice <= 910 THEN 1 WHEN p_retailprice <= 930 THEN 2 WHEN p_retailprice <= 950 THEN 3 WHEN p_retailprice <= 960 THEN 4
WHEN p_retailprice <= 970 THEN 5 WHEN p_retailprice <= 980 THEN 4 WHEN p_retailprice <= 990 THEN 3 WHEN p_retailprice <= 995 THEN 2 ELSE 1 END * 0.2e0"""
_TYPE = "CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LARGE' THEN 4 WHEN 'SMALL' THEN 5 END * 0.2e0"
PART_INDEX = f"""(SELECT *, size_score * 0.5e0 + price_score * 0.3e0 + type_score * 0.2e0 AS index_value,
CASE WHEN type_score IS NULL THEN 'insufficient' ELSE 'complete_3_indicators' END AS method
FROM (SELECT *, {_SIZE} AS size_score, {_PRICE} AS price_score, {_TYPE} AS type_score FROM part))"""
CLASS_OF = """CASE WHEN index_value <= 0.25 THEN 'Very low' WHEN index_value <= 0.5 THEN 'Low' WHEN index_value <= 0.75 THEN 'Moderate'
WHEN index_value <= 0.9 THEN 'High' WHEN index_value > 0.9 THEN 'Very high' END"""


def part_scores(t: Tables):
    return t.part.withColumns(
        {
            "size_score": standard_score(right_closed_bin("p_size", SIZE_BINS, [1, 2, 3, 4, 5]), 5),
            "price_score": standard_score(right_closed_bin("p_retailprice", PRICE_BINS, [1, 2, 3, 4, 5, 4, 3, 2, 1]), 5),
            "type_score": standard_score(code_lookup("p_type", TYPE_SCORE), 5),
        }
    )


def part_index(t: Tables):
    return weighted_index(part_scores(t), PART_WEIGHTS)


@query("flagship_index_classes", f"SELECT class, count(*) AS n FROM (SELECT {CLASS_OF} AS class FROM {PART_INDEX}) GROUP BY class")
def flagship(t):
    return value_counts(classify(part_index(t), "index_value"), "class")


@query("src_01_delimited_scan", f"SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, {r('s_acctbal', 2)} AS s_acctbal FROM supplier")
def _(t):
    path = new_path(t.spark, "supplier")
    t.supplier.write.option("sep", ";").option("header", True).csv(path)
    back = tables.read_delimited(t.spark, path)
    return rnd(back.select("s_suppkey", "s_name", F.col("s_acctbal").try_cast("double").alias("s_acctbal")), 2, "s_acctbal")


@query("src_02_semicolon_scan", f"SELECT c_custkey, c_mktsegment, {r('c_acctbal', 2)} AS c_acctbal FROM customer")
def _(t):
    path = new_path(t.spark, "customer")
    t.customer.write.option("sep", ";").option("header", True).csv(path)
    schema = StructType([StructField("c_custkey", LongType()), StructField("c_mktsegment", StringType()), StructField("c_acctbal", DoubleType())])
    back = tables.read_semicolon(t.spark, path, schema, ["c_custkey", "c_mktsegment", "c_acctbal"], ["c_acctbal"])
    return rnd(back.select("c_custkey", "c_mktsegment", "c_acctbal"), 2, "c_acctbal")


@query("src_03_stage_reload", f"SELECT o_orderkey, {r('o_totalprice', 2)} AS o_totalprice FROM orders")
def _(t):
    path = new_path(t.spark, "stage")
    df = t.orders.select("o_orderkey", "o_totalprice")
    sinks.write_table(df, path)
    return rnd(tables.read_stage(t.spark, path, df.schema), 2, "o_totalprice")


@query("src_04_point_layer", f"SELECT id, {r('x', 6)} AS x, {r('y', 6)} AS y, label FROM {POINTS}")
def _(t):
    e = F.col("embedding")
    return rnd(tables.point_layer(t.embeddings, "vec_id", e[0], e[1], ["label"]), 6, "x", "y")


_COLUMNS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query(
    "src_05_layer_inspection",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{ty}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM orders"
        for i, (c, ty) in enumerate(_COLUMNS, 1)
    ),
)
def _(t):
    return tables.inspect_layer(t.orders)


@query(
    "src_06_band_discovery",
    f"""SELECT coalesce(f.band, w.band) AS band, CASE WHEN f.band IS NULL THEN 'missing' WHEN w.band IS NULL THEN 'unexpected' ELSE 'present' END AS status
FROM (SELECT DISTINCT band FROM {PIXELS}) f FULL JOIN (VALUES ('price'), ('size'), ('slope')) AS w(band) ON f.band = w.band""",
)
def _(t):
    path = new_path(t.spark, "pixels")
    pixels(t).write.partitionBy("band").parquet(path)
    return tables.discover_bands(t.spark, path, ["price", "size", "slope"])


def tiled(t: Tables):
    return pixels(t).withColumn("tile", tile_index("row", "col", TILE, WIDTH))


@query(
    "src_07_window_read",
    f"""SELECT row, col, {r('value', 4)} AS value FROM {PIXELS} WHERE band = 'size' AND row BETWEEN 0 AND 1000000 AND col BETWEEN 16 AND 31""",
)
def _(t):
    strip = read_raster_window(t.spark, raster_path(t), GRID, "size", 0, TILE, 1_000_001, TILE)
    return rnd(strip.select("row", "col", "value"), 4, "value")


@query(
    "src_08_region_edges",
    f"SELECT region, ring, seq, {r('x1', 9)} AS x1, {r('y1', 9)} AS y1, {r('x2', 9)} AS x2, {r('y2', 9)} AS y2 FROM {EDGES}",
)
def _(t):
    return rnd(region_edges(t), 9, "x1", "y1", "x2", "y2")


@query("src_09_result_sink", f"SELECT 'csv' AS format, count(*) AS n, {r('sum(l_quantity)', 1)} AS total FROM lineitem UNION ALL SELECT 'parquet', count(*), {r('sum(l_quantity)', 1)} FROM lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_quantity")
    out = None
    for fmt in ("csv", "parquet"):
        path = new_path(t.spark, fmt)
        sinks.write_table(df, path, fmt)
        back = t.spark.read.schema(df.schema).option("header", True).format(fmt).load(path)
        one = back.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")).select(F.lit(fmt).alias("format"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return rnd(out, 1, "total")


@query("src_10_two_projection_sink", f"SELECT p_partkey, {r('index_value', 6)} AS index_value, method FROM {PART_INDEX}")
def _(t):
    full, summary = new_path(t.spark, "full"), new_path(t.spark, "summary")
    sinks.write_full_and_summary(part_index(t), ["p_partkey", "index_value", "method"], full, summary)
    return rnd(t.spark.read.parquet(summary), 6, "index_value")


@query(
    "src_11_tile_sink",
    f"""SELECT 'size_map' AS response, CAST(tile AS INTEGER) AS tile, count(*) AS n, count(*) FILTER (price = -9999) AS n_nodata FROM (SELECT *, {TILE_OF} AS tile FROM {RASTER}) GROUP BY tile""",
)
def _(t):
    path = new_path(t.spark, "tiles")
    px = raster(t).select(
        F.lit("size_map").alias("response"), tile_index("row", "col", TILE, WIDTH).alias("tile"), "row", "col", nodata_to_null("price", NODATA).alias("value")
    )
    sinks.write_tiles(px, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("response", "tile").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == NODATA).alias("n_nodata"))


@query(
    "src_13_result_cache",
    f"SELECT o_orderpriority, count(*) AS n, {r('avg(o_totalprice)', 4)} AS mean FROM orders GROUP BY 1",
)
def _(t):
    path = new_path(t.spark, "cache")
    result = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))
    sinks.materialise_once(result, path)
    return rnd(sinks.materialise_once(result, path), 4, "mean")


@query(
    "src_14_available_outputs",
    """SELECT CAST(p AS INTEGER) AS position, d.response, f.response IS NOT NULL AS available
FROM (VALUES (0, 'A'), (1, 'B'), (2, 'N'), (3, 'R'), (4, 'Z')) AS d(p, response) LEFT JOIN (SELECT DISTINCT l_returnflag AS response FROM lineitem) f ON f.response = d.response""",
)
def _(t):
    path = new_path(t.spark, "outputs")
    t.lineitem.select(F.col("l_returnflag").alias("response"), "l_quantity").write.partitionBy("response").parquet(path)
    return tables.available_outputs(t.spark.read.parquet(path), "response", ["A", "B", "N", "R", "Z"])


@query(
    "src_15_tile_log",
    f"""SELECT tile, count(price) AS n_valid_pixels, CASE WHEN count(price) = 0 THEN 'nodata' ELSE 'ok' END AS status
FROM (SELECT row, col, price, {TILE_OF} AS tile FROM {LOCATED}) GROUP BY tile""",
)
def _(t):
    return sinks.tile_log(located(t).withColumn("tile", tile_index("row", "col", TILE, WIDTH)), "price")
