"""Composite index: threshold scores, component-derived weights, weighted sum, classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastat.config import CLASS_BREAKS, CLASS_LABELS
from terrastat.functions.scalar import right_closed_bin
from terrastat.operators.summary import pearson_pairs
from terrastat.session import local_table

COMPLETE, INSUFFICIENT = "complete", "insufficient"


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and divided by the population sd of one pass."""
    one = df.agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).alias("_z")
    ).scalar()
    d = df.withColumn("_z", one)
    return d.withColumns(
        {c: F.try_divide(F.col(c) - F.col(f"_z.m_{c}"), F.col(f"_z.s_{c}")) for c in columns}
    ).drop("_z")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Correlations of complete rows and their number; k x k numbers reach the driver."""
    pairs = pearson_pairs(df.na.drop(subset=list(columns)), columns).collect()
    at = {c: i for i, c in enumerate(columns)}
    r = np.eye(len(columns))
    for p in pairs:
        i, j = at[p["var1"]], at[p["var2"]]
        r[i, j] = r[j, i] = p["r"] if p["r"] is not None else 0.0
    return r, int(pairs[0]["n"])


def components(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending, times n/(n-1)) and loadings, largest |loading| positive."""
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0) * n / (n - 1), vectors[:, order]
    top = np.abs(np.round(vectors, 12)).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(len(values))])


def eigen_table(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """Eigenvalue, percentage and running percentage of each component."""
    total = float(values.sum())
    rows = [(i + 1, float(v), 100.0 * float(v) / total) for i, v in enumerate(values)]
    df = local_table(spark, rows, "dim int, eigenvalue double, percentage double")
    w = Window.partitionBy(F.lit(0)).orderBy("dim").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cumulative", F.sum("percentage").over(w))


def coordinate_table(spark: SparkSession, columns: Sequence[str], values: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """Loading and coordinate (loading times root eigenvalue) of each variable and component."""
    rows = [
        (c, d + 1, float(loadings[i, d]), float(loadings[i, d] * np.sqrt(values[d])))
        for i, c in enumerate(columns)
        for d in range(len(values))
    ]
    return local_table(spark, rows, "variable string, dim int, loading double, coord double")


def principal_components(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Eigen table and coordinates from one correlation pass."""
    r, n = correlation_matrix(df, columns)
    values, loadings = components(r, n)
    return eigen_table(df.sparkSession, values), coordinate_table(df.sparkSession, columns, values, loadings)


def contributions(coords: DataFrame) -> DataFrame:
    sq = F.col("coord") * F.col("coord")
    return coords.select(
        "variable", "dim", (100.0 * sq / F.sum(sq).over(Window.partitionBy("dim"))).alias("contribution")
    )


def retained(eigen: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Components above the threshold; none is an error."""
    kept = eigen.filter(F.col("eigenvalue") > threshold)
    if kept.isEmpty():
        raise ValueError(f"no component with eigenvalue > {threshold}")
    return kept


def indicator_weights(coords: DataFrame, eigen: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Weight |coordinate| x eigenvalue on the retained component where it is largest, summing to 1."""
    size = F.abs("coord")
    best = Window.partitionBy("variable").orderBy(F.col("abs_loading").desc(), "dim")
    picked = (
        coords.join(retained(eigen, threshold).select("dim", "eigenvalue"), "dim")
        .withColumn("abs_loading", size)
        .withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") == 1)
    )
    raw = F.col("abs_loading") * F.col("eigenvalue")
    total = F.sum("weight_raw").over(Window.partitionBy(F.lit(0)))
    return (
        picked.select("variable", "dim", "abs_loading", "eigenvalue", raw.alias("weight_raw"))
        .withColumn("weight", F.col("weight_raw") / total)
    )


def best_component(coords: DataFrame) -> DataFrame:
    """Component with the largest |coordinate| of each variable, the first on ties."""
    w = Window.partitionBy("variable").orderBy(F.abs("coord").desc(), "dim")
    return coords.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def supplementary(df: DataFrame, columns: Sequence[str], extra: str, n_dims: int) -> DataFrame:
    """Correlation of an outside variable with the row scores of the first components."""
    r, n = correlation_matrix(df, columns)
    values, loadings = components(r, n)
    z = z_scores(df.na.drop(subset=list(columns)), columns)
    aggs = []
    for d in range(n_dims):
        score = sum((F.col(c) * float(loadings[i, d]) for i, c in enumerate(columns)), F.lit(0.0))
        aggs.append(F.corr(score, F.col(extra)).alias(f"d{d + 1}"))
    rows = F.array(*[F.struct(F.lit(d + 1).alias("dim"), F.col(f"d{d + 1}").alias("r")) for d in range(n_dims)])
    return z.filter(F.col(extra).isNotNull()).agg(*aggs).select(F.inline(rows))


def weighted_index(df: DataFrame, weights: Mapping[str, float], out: str = "index_value") -> DataFrame:
    """Weighted sum of the scores, only where every score exists."""
    whole = F.lit(True)
    total = F.lit(0.0)
    for c, w in weights.items():
        whole = whole & F.col(c).isNotNull()
        total = total + F.col(c) * float(w)
    return df.withColumn(out, F.when(whole, total)).withColumn(
        "method", F.when(whole, f"{COMPLETE}_{len(weights)}_indicators").otherwise(INSUFFICIENT)
    )


def classify(df: DataFrame, value: str, out: str = "class", breaks=CLASS_BREAKS, labels=CLASS_LABELS) -> DataFrame:
    return df.withColumn(out, right_closed_bin(value, breaks, labels))


def class_mismatches(df: DataFrame, value: str, cls: str) -> DataFrame:
    """Rows whose class and value are not missing together."""
    return df.agg(F.count_if(F.col(value).isNull() != F.col(cls).isNull()).alias("n_mismatch"), F.count(F.lit(1)).alias("n_rows"))
