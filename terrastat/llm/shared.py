"""Scratch tables in the folder that all executors share, and components of a link table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.session import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: lost executors cost no recomputation of what came before."""
    path = f"{shared_folder(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable over ``links (a, b)``, for every node that has a link to another.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by joins and replaces
    both ends of each link by what it points at, until no link joins two roots.
    """
    own = links.sparkSession
    e = stored(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    known = None
    while not e.isEmpty():
        both = e.select(F.col("v").alias("node"), F.col("u").alias("p")).union(e.select(F.col("u").alias("node"), F.col("v").alias("p")))
        up = stored(both.groupBy("node").agg(F.min("p").alias("p")).select("node", F.least("node", "p").alias("p")))
        while True:
            far = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
            jumped = stored(up.join(far, "p").select("node", "p", "q"))
            moved = jumped.where("p <> q").isEmpty()
            up = jumped.select("node", F.col("q").alias("p"))
            if moved:
                break
        if known is None:
            known = up.select("node", F.col("p").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), F.col("p").alias("next"))
            known = stored(known.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = e.join(up.select(F.col("node").alias("u"), F.col("p").alias("pu")), "u")
        left = left.join(up.select(F.col("node").alias("v"), F.col("p").alias("pv")), "v")
        e = stored(left.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u <> v").distinct())
    if known is None:
        return own.createDataFrame([], "node long, root long")
    return known
