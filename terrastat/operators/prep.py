"""Row preparation: codes, complete cases, missing cells, unmatched keys, alignment."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.config import EXCLUDED_SHARE_WARNING
from terrastat.functions.scalar import code_lookup, decimal_comma
from terrastat.session import local_table


def convert_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Decimal-comma text columns as DOUBLE under their final names."""
    return df.withColumns({new: decimal_comma(old) for old, new in mapping.items()})


def unmatched_keys(df: DataFrame, column: str, mapping: Mapping, upper: bool = False) -> DataFrame:
    """Distinct values that the code map does not know."""
    known = local_table(df.sparkSession, [(k,) for k in mapping], f"_key {df.schema[column].dataType.simpleString()}")
    key = F.upper(F.col(column)) if upper else F.col(column)
    return df.filter(F.col(column).isNotNull()).select(column).distinct().join(known, key == F.col("_key"), "left_anti")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def excluded_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, complete rows, excluded rows and whether the excluded share is above the warning level."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(whole).alias("n_complete"))
    out = out.withColumn("n_excluded", F.col("n_rows") - F.col("n_complete"))
    share = F.try_divide(F.col("n_excluded"), F.col("n_rows"))
    return out.withColumn("warn", F.coalesce(share > EXCLUDED_SHARE_WARNING, F.lit(False)))


def available_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Wanted columns that exist, in their order; the rest is reported."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        warnings.warn(f"columns not found: {missing}", stacklevel=2)
    return [c for c in wanted if c in df.columns]


def exclude_prefixes(df: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.col(column).startswith(p)
    return df.filter(~bad)


def slope_levels(levels: Sequence[float], coding: str) -> list[float]:
    """Depth levels centred and scaled over the levels: ``cm``, ``log`` or ``rank``."""
    import math

    if coding == "cm":
        v = [float(x) for x in levels]
    elif coding == "log":
        v = [math.log(x) for x in levels]
    elif coding == "rank":
        v = [float(i) for i in range(1, len(levels) + 1)]
    else:
        raise ValueError("coding must be cm, log or rank")
    mean = sum(v) / len(v)
    sd = math.sqrt(sum((x - mean) ** 2 for x in v) / (len(v) - 1))
    return [(x - mean) / sd for x in v]


def slope_code(column: str, keys: Sequence, levels: Sequence[float], coding: str) -> Column:
    return code_lookup(column, dict(zip(keys, slope_levels(levels, coding))))


def level_grid(df: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of declared factor levels, built by exploding literal arrays."""
    grid = df.sparkSession.range(1).select()
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def grid_cells(df: DataFrame, levels: Mapping[str, Sequence], aggs: Sequence[Column]) -> DataFrame:
    """The factor grid with the aggregates of each cell, empty cells included."""
    return level_grid(df, levels).join(df.groupBy(*levels).agg(*aggs), list(levels), "left")


def missing_cells(df: DataFrame, plot: str, depth: str, levels: Sequence, keep: Sequence[str]) -> DataFrame:
    """Plot x depth cells of the complete design without an observation, with the plot's factors."""
    plots = df.select(plot, *keep).distinct()
    design = plots.withColumn(depth, F.explode(F.array(*[F.lit(v) for v in levels])))
    return design.join(df.select(plot, depth), [plot, depth], "left_anti")


def estimates_with_tests(est: DataFrame, tests: DataFrame, on: Sequence[str], p: str, alpha: float) -> DataFrame:
    """Left join of test results; a missing test is not significant."""
    return est.join(tests, list(on), "left").withColumn("significant", F.coalesce(F.col(p) < alpha, F.lit(False)))


def level_pairs(means: DataFrame, panel: Sequence[str], idx: str, label: str, value: str) -> DataFrame:
    """Each pair of levels (lower index first) inside a panel, with the difference."""
    a = means.select(*panel, F.col(idx).alias("_i"), F.col(label).alias("a"), F.col(value).alias("_va"))
    b = means.select(*panel, F.col(idx).alias("_j"), F.col(label).alias("b"), F.col(value).alias("_vb"))
    joined = a.join(b, list(panel)).filter(F.col("_i") < F.col("_j"))
    return joined.select(*panel, "a", "b", (F.col("_va") - F.col("_vb")).alias("estimate"))


def against_reference(means: DataFrame, panel: Sequence[str], idx: str, label: str, value: str) -> DataFrame:
    """Each level minus the reference level (index 0) of its panel."""
    ref = means.filter(F.col(idx) == 0).select(*panel, F.col(label).alias("b"), F.col(value).alias("_vb"))
    rest = means.filter(F.col(idx) > 0).select(*panel, F.col(label).alias("a"), F.col(value).alias("_va"))
    return rest.join(ref, list(panel)).select(*panel, "a", "b", (F.col("_va") - F.col("_vb")).alias("estimate"))


def align_weights(weights: DataFrame, name: str, weight: str, mapping: Mapping[str, str]) -> DataFrame:
    """Weights under their score names in the declared order; a missing weight is an error."""
    spark = weights.sparkSession
    want = local_table(spark, [(i, k, v) for i, (k, v) in enumerate(mapping.items())], f"position int, {name} string, score string")
    aligned = want.join(weights.select(name, weight), name, "left")
    checked = F.when(F.col(weight).isNull(), F.raise_error(F.concat(F.lit("missing weight: "), F.col(name)))).otherwise(F.col(weight))
    return aligned.select("position", "score", checked.cast("double").alias("weight"))


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with the table's name in a column."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def depth_wide(df: DataFrame, key: str, depth: str, levels: Sequence[int], value: str, prefix: str) -> DataFrame:
    """One column per depth, in one aggregate (a pivot groups by key and depth first)."""
    return df.groupBy(key).agg(*[F.first(F.when(F.col(depth) == lv, F.col(value)), ignorenulls=True).alias(f"{prefix}{lv}") for lv in levels])
