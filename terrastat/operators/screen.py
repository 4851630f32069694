"""Collinearity screening on one correlation pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.config import VIF_LIMIT
from terrastat.functions.scalar import significance_stars, vif_band
from terrastat.operators.index import correlation_matrix
from terrastat.operators.summary import exact_percentiles, pearson_p, pearson_pairs, to_long
from terrastat.session import local_table


def vif_values(r: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse correlation matrix; infinite where a column depends on the others."""
    out = np.full(len(r), np.inf)
    for j in range(len(r)):
        others = [i for i in range(len(r)) if i != j]
        if not others:
            out[j] = 1.0
            continue
        coef = np.linalg.lstsq(r[np.ix_(others, others)], r[others, j], rcond=1e-12)[0]
        unexplained = 1.0 - float(r[others, j] @ coef)
        out[j] = 1.0 / unexplained if unexplained > 1e-12 else np.inf
    return out


def _vif_table(spark, columns: Sequence[str], values) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return local_table(spark, rows, "predictor string, vif double").withColumn("band", vif_band("vif"))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    r, _ = correlation_matrix(df, columns)
    return _vif_table(df.sparkSession, columns, vif_values(r))


def median_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values replaced by the column median."""
    med = exact_percentiles(to_long(df, columns), "value", [0.5], ["variable"]).collect()
    fill = {m["variable"]: m["percentile"] for m in med}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill.get(c))) for c in columns})


def eliminate(
    df: DataFrame, columns: Sequence[str], priority: Sequence[str] = (), response: str | None = None, limit: float = VIF_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """Stepwise removal of the worst non-priority predictor while its VIF reaches the limit.

    Returns the retained predictors with their VIF and the removal log. One
    correlation pass serves all steps: dropping a predictor is dropping a row
    and column. With ``response`` only rows where it is present take part.
    """
    rows = df if response is None else df.filter(F.col(response).isNotNull())
    r, _ = correlation_matrix(median_filled(rows, columns), columns)
    keep, log = list(range(len(columns))), []
    while len(keep) >= 2:
        values = vif_values(r[np.ix_(keep, keep)])
        worst = [(v, i) for v, i in zip(values, keep) if columns[i] not in priority and v >= limit]
        if not worst:
            break
        v, i = max(worst, key=lambda t: (t[0], -t[1]))
        log.append((len(log), columns[i], round(float(v), 2), "high_vif_nonpriority"))
        keep.remove(i)
    spark = df.sparkSession
    final = _vif_table(spark, [columns[i] for i in keep], vif_values(r[np.ix_(keep, keep)]))
    return final, local_table(spark, log, "step int, dropped string, vif_at_drop double, reason string")


def retained_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle of the correlations with significance stars."""
    pairs = pearson_p(pearson_pairs(df, columns))
    return pairs.select(
        F.col("var2").alias("row_name"), F.col("var1").alias("col_name"), "r", "p", significance_stars("p").alias("stars")
    )
