"""Sinks: result tables, tile rasters, model bundles, cached results, tile logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.config import EXPORT_NODATA
from terrastat.operators.forests import Forest
from terrastat.sources.tables import _exists, read_stage


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_full_and_summary(df: DataFrame, summary_cols: Sequence[str], full_path: str, summary_path: str) -> None:
    """Full table and a column subset; the subset is read from the written table, not recomputed."""
    write_table(df, full_path)
    write_table(read_stage(df.sparkSession, full_path, df.schema).select(*summary_cols), summary_path)


def write_tiles(df: DataFrame, path: str, value: str = "value") -> None:
    """Prediction band as FLOAT, one folder per response and tile, gaps as the export nodata value."""
    (
        df.withColumn(value, F.coalesce(F.col(value), F.lit(EXPORT_NODATA)).cast("float"))
        .repartition("response", "tile")
        .write.mode("overwrite")
        .partitionBy("response", "tile")
        .parquet(path)
    )


def save_bundle(model: Forest, fit_stats: DataFrame, path: str) -> None:
    """Fitted forest beside the statistics it was fitted with."""
    model.save(fit_stats.sparkSession, f"{path}/model")
    write_table(fit_stats, f"{path}/fit_stats")


def load_bundle(spark: SparkSession, path: str) -> tuple[Forest, DataFrame]:
    return Forest.load(spark, f"{path}/model"), spark.read.parquet(f"{path}/fit_stats")


def materialise_once(df: DataFrame, path: str) -> DataFrame:
    """Stored result when a finished write is present, else compute and store it."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        write_table(df, path)
    return read_stage(spark, path, df.schema)


def tile_log(pixels: DataFrame, value: str, tile: str = "tile") -> DataFrame:
    """Valid pixels per tile and the tile status."""
    return (
        pixels.groupBy(tile)
        .agg(F.count(value).alias("n_valid_pixels"))
        .withColumn("status", F.when(F.col("n_valid_pixels") == 0, "nodata").otherwise("ok"))
    )
