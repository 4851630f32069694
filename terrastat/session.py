"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def get_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrastat")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = os.environ.get("TERRASTAT_LOCAL_DIR")
    if not folder:
        folder = os.environ["TERRASTAT_LOCAL_DIR"] = tempfile.mkdtemp(prefix="terrastat-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/terrastat/{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Survives the loss of executors; used where a table feeds many later jobs.
    """
    path = new_path(df.sparkSession, "stage")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task whose groups and joins stay inside a key.
TASK_ROWS = 250_000


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to as many tasks as leave each about ``TASK_ROWS`` rows (counted), but no fewer than usual.

    Groups and joins whose keys hold ``key`` follow without another shuffle, and what one task holds does not grow with the table:
    the stated number also keeps adaptive execution from merging them by their packed size.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, math.ceil(df.count() / TASK_ROWS)), key)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    """A few driver-side rows as a table, through Arrow."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=types), fields)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Broadcast ``df`` when it has at most ``max_rows`` rows, else leave the join to shuffle.

    The rows fetched for the check are the ones broadcast, so ``df`` runs once.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def fetched(df: DataFrame, count: str, max_rows: int = 20_000) -> tuple[DataFrame, int]:
    """``df`` as a table that costs nothing to read again, and its largest ``count`` (0 without rows).

    At most ``max_rows`` rows come to the driver; a longer table is stored.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return df.sparkSession.createDataFrame(rows, df.schema), max(rows.column(count).to_pylist(), default=0)
    kept = cut_lineage(df)
    return kept, kept.agg(F.max(count)).first()[0]
