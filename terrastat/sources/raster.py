"""Tiled raster tables: a folder per band and group of tiles, rows in order inside, so that a few points read a few files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.functions.scalar import pixel_col, pixel_row
from terrastat.session import broadcast_if_small, new_path

#: Pixels aimed at in one group of tiles (a file of each band), and distinct pixels asked for that may be broadcast (24 bytes each).
GROUP_PIXELS = 4_000_000
MOST_KEYS = 200_000


class Grid(NamedTuple):
    """Rows and columns of a raster, its tiles, and where it lies."""

    n_columns: int
    tile: int
    transform: Sequence[float]

    def group(self, row: Column, column: Column) -> Column:
        """Number of the group of tiles of a pixel: some neighbouring tiles of one line of tiles, or whole lines where they are short."""
        across = -(-self.n_columns // self.tile)
        wide = min(across, max(1, GROUP_PIXELS // (self.tile * self.tile)))
        groups = -(-across // wide)
        lines = max(1, GROUP_PIXELS // (self.tile * self.tile * across)) if groups == 1 else 1
        return (F.floor(row / (self.tile * lines)) * groups + F.floor(column / (self.tile * wide))).cast("long")


def write_raster(pixels: DataFrame, grid: Grid, path: str) -> None:
    """``pixels(band, row, col, value)`` partitioned by band and group of tiles, sorted by row and column inside."""
    placed = pixels.select("band", "row", "col", "value", grid.group(F.col("row"), F.col("col")).alias("tiles"))
    placed.repartition("band", "tiles").sortWithinPartitions("band", "tiles", "row", "col").write.partitionBy("band", "tiles").parquet(path)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row long, col long, value double, band string, tiles long").parquet(path)


def read_raster_window(spark: SparkSession, path: str, grid: Grid, band: str, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """Pixels of one band inside a window: folders are chosen by band and group, row groups by their rows."""
    row, column = F.col("row"), F.col("col")
    last_row, last_col = row0 + height - 1, col0 + width - 1
    first, last = (grid.group(F.lit(r), F.lit(c)) for r, c in ((row0, col0), (last_row, last_col)))
    inside = row.between(row0, last_row) & column.between(col0, last_col) & F.col("tiles").between(first, last)
    return read_raster(spark, path).filter((F.col("band") == band) & inside)


def located_points(points: DataFrame, grid: Grid) -> DataFrame:
    """Points with the row and column of the pixel they fall in."""
    return points.withColumn("row", pixel_row("y", grid.transform)).withColumn("col", pixel_col("x", grid.transform))


def _asked(located: DataFrame, grid: Grid) -> DataFrame:
    """Distinct pixels under the points, with their group; points beside the raster ask for none."""
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("col") < grid.n_columns)
    return located.where(inside).select("row", "col", grid.group(F.col("row"), F.col("col")).alias("tiles")).distinct()


def pixels_at(spark: SparkSession, path: str, grid: Grid, bands: Sequence[str], located: DataFrame) -> DataFrame:
    """``row, col`` and one column per band for the pixels under the points.

    The points become distinct pixels. Few of them (counted) are broadcast: Spark prunes the folders of other groups while it plans the
    scan, and no pixel is shuffled. Of many, only the groups are broadcast, of which there are no more than folders; the pixels of
    those groups are then joined by shuffling.
    """
    asked = _asked(located, grid)
    pixels = read_raster(spark, path).where(F.col("band").isin(*bands))
    if asked.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        found = pixels.join(F.broadcast(asked), ["tiles", "row", "col"], "left_semi")
    else:
        groups = asked.select("tiles").distinct()
        found = pixels.join(F.broadcast(groups), "tiles", "left_semi").join(asked.hint("merge"), ["tiles", "row", "col"], "left_semi")
    return found.groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def sample_raster(points: DataFrame, spark: SparkSession, path: str, grid: Grid, bands: Sequence[str], how: str = "left") -> DataFrame:
    """Value of each band at each point of ``points(x, y, ...)``: adds ``row, col`` and the bands, NULL beside the raster.

    ``how="inner"`` keeps only points on pixels of the raster.
    """
    located = located_points(points, grid)
    return located.join(broadcast_if_small(pixels_at(spark, path, grid, bands, located)), ["row", "col"], how)


_WRITTEN: dict[tuple, str] = {}


def raster_of(pixels: DataFrame, grid: Grid, source: str) -> str:
    """Path of ``pixels`` as a tiled raster, written once for each state of the files below ``source`` and session."""
    spark = pixels.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    state = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, grid.n_columns, grid.tile, state)
    if key not in _WRITTEN:
        path = new_path(spark, "raster")
        write_raster(pixels, grid, path)
        _WRITTEN[key] = path
    return _WRITTEN[key]
