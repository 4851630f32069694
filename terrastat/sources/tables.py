"""Scans: delimited text, stage tables, point layers, pixel tables, polygon edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from terrastat.session import local_table

SEPARATORS = (";", ",", "\t", "|")


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))


def require_path(spark: SparkSession, path: str, hint: str = "") -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(f"not found: {path}. {hint}".strip())


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All-text scan of delimited files whose separator is taken from the header line."""
    require_path(spark, path)
    header = spark.read.text(path).first()
    line = header[0] if header else ""
    sep = max(SEPARATORS, key=line.count)
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    if len(df.columns) < 2:
        raise ValueError(f"only one column in {path}: no known separator in its header")
    return df


def read_semicolon(
    spark: SparkSession, path: str, schema: StructType, required: Sequence[str], numeric: Sequence[str]
) -> DataFrame:
    """Semicolon text with required columns; a numeric column that does not parse is an error."""
    require_path(spark, path)
    text = spark.read.option("sep", ";").option("header", True).csv(path)
    require_columns(text, required)
    types = {f.name: f.dataType for f in schema.fields}
    cols = []
    for name in text.columns:
        if name in numeric:
            cols.append(F.col(name).cast("double").alias(name))
        elif name in types:
            cols.append(F.col(name).cast(types[name]).alias(name))
        else:
            cols.append(F.col(name))
    return text.select(*cols)


def read_stage(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Table written by an earlier stage, with its declared schema."""
    require_path(spark, path, "Run the earlier stage first.")
    return spark.read.schema(schema).parquet(path)


def point_layer(df: DataFrame, id_col: str, x, y, attributes: Sequence[str] = ()) -> DataFrame:
    """Points as ``id, x, y`` and attributes; the geometry column is dropped."""
    return df.select(
        F.col(id_col).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), *attributes
    )


def inspect_layer(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, table rows and missing values (one scan)."""
    agg = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_na_{c}") for c in df.columns]
    )
    items = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("_rows").alias("n_rows"),
            F.col(f"_na_{f.name}").alias("n_missing"),
        )
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return agg.select(F.inline(F.array(*items)))


def preview(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def discover_bands(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """Bands of a pixel table and the expected ones that are absent, from its partition values."""
    require_path(spark, path)
    found = spark.read.parquet(path).select(F.col("band").cast("string")).distinct()
    wanted = local_table(spark, [(b,) for b in expected], "band string")
    return (
        found.withColumn("_here", F.lit(True))
        .join(wanted.withColumn("_wanted", F.lit(True)), "band", "full")
        .select(
            "band",
            F.when(F.col("_here").isNull(), "missing")
            .when(F.col("_wanted").isNull(), "unexpected")
            .otherwise("present")
            .alias("status"),
        )
    )


def read_window(pixels: DataFrame, band: str, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """Pixels of one band inside a window; band and bounds reach the scan as filters."""
    return pixels.filter(
        (F.col("band") == band)
        & F.col("row").between(row0, row0 + height - 1)
        & F.col("col").between(col0, col0 + width - 1)
    )


def polygon_edges(vertices: DataFrame, region: str = "region", ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Closed rings given as vertices ``(region, ring, seq, x, y)`` to edges."""
    from pyspark.sql import Window

    require_columns(vertices, [region, ring, seq, "x", "y"])
    w = Window.partitionBy(region, ring).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        region,
        ring,
        seq,
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"),
        F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"),
    )


def available_outputs(found: DataFrame, key: str, declared: Sequence[str]) -> DataFrame:
    """Declared outputs in their order, each marked available or not."""
    spark = found.sparkSession
    order = local_table(spark, [(i, d) for i, d in enumerate(declared)], f"position int, {key} string")
    have = found.select(F.col(key).cast("string").alias(key)).distinct().withColumn("_have", F.lit(True))
    return order.join(have, key, "left").select("position", key, F.col("_have").isNotNull().alias("available"))
