"""Global ranks, folds and running sums without a single-task sort.

Rows are put in a stored global order by one range partitioning and numbered
inside their runs (``ordered``); folds cut the rows by the first digits of a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.functions.scalar import normal_quantile
from terrastat.operators.ordered import before_runs, numbered, rolling_sums
from terrastat.session import broadcast_if_small


def _offsets(totals: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    """Sum of the earlier buckets and of all buckets; ``totals`` has one row per bucket."""
    w = Window.partitionBy(*by).orderBy(bucket)
    return totals.withColumn(
        "_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_total", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def hash_rank(df: DataFrame, ids: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_rank`` (from 0) and ``_total`` in md5 order of the row id.

    The md5 spreads unique ids evenly, so its first digits make equal buckets.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    rows = df.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, 3))
    offsets = _offsets(rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")), by, "_b").drop("_n")
    w = Window.partitionBy(*by, "_b").orderBy("_h", *ids)
    return (
        rows.join(offsets, [*by, "_b"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(w) - 1)
        .drop("_h", "_b", "_before")
    )


def ntile_of(rank: Column, total: Column, k: int) -> Column:
    """Tile number (from 1) of a rank; the first ``total mod k`` tiles hold one row more."""
    size = F.floor(total / k).cast("long")
    extra = F.pmod(total, F.lit(k))
    wide = extra * (size + 1)
    first = F.floor(F.try_divide(rank, size + 1)) + 1
    rest = extra + F.floor(F.try_divide(rank - wide, size)) + 1
    return F.when(rank < wide, first).otherwise(rest).cast("int")


def assign_folds(
    df: DataFrame, ids: Sequence[str], k: int, seed: int, by: Sequence[str] = (), out: str = "fold"
) -> DataFrame:
    """Shuffled folds 1..k whose sizes differ by one row at most."""
    ranked = hash_rank(df, ids, seed, by)
    return ranked.withColumn(out, ntile_of(F.col("_rank"), F.col("_total"), k)).drop("_rank", "_total")


def sample_rows(df: DataFrame, ids: Sequence[str], n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows (per group) without replacement, in md5 order of the id."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    if not by:
        return df.orderBy(key, *ids).limit(n)
    w = Window.partitionBy(*by).orderBy("_h", *ids)
    return (
        df.withColumn("_h", key).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_h", "_r")
    )


def value_counts_before(df: DataFrame, value: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Distinct values with ``_count``, the rows before them ``_below`` and the group ``_total``.

    Equal values collapse first, so one value held by many rows is one row here; they are put in order by one range partitioning.
    """
    by = list(by)
    vals = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("long").alias("_count"))
    )
    rows = numbered(vals, by, [value], "_count")
    runs = before_runs(rows.groupBy(*by, "_run").agg(F.sum("_count").alias("_n")), by)
    return rows.join(runs, "_run").withColumn("_below", F.col("_before") + F.col("_in")).drop("_run", "_in", "_before")


def average_rank() -> Column:
    """Mean rank of tied values, from the columns of ``value_counts_before``."""
    return F.col("_below") + (F.col("_count") + 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks over rows where both values are present."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    pairs = both.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_m"))
    rx = value_counts_before(both, x, by).select(*by, x, average_rank().alias("_rx"), F.col("_total").alias("_tn"))
    ry = value_counts_before(both, y, by).select(*by, y, average_rank().alias("_ry"))
    # ranks average to (n + 1) / 2, so centred sums need no second pass
    cx = F.col("_rx") - (F.col("_tn") + 1) / 2.0
    cy = F.col("_ry") - (F.col("_tn") + 1) / 2.0
    sums = (
        pairs.join(rx, [*by, x])
        .join(ry, [*by, y])
        .groupBy(*by)
        .agg(
            F.sum("_m").alias("n"),
            F.sum(F.col("_m") * cx * cy).alias("_xy"),
            F.sum(F.col("_m") * cx * cx).alias("_xx"),
            F.sum(F.col("_m") * cy * cy).alias("_yy"),
        )
    )
    return sums.select(*by, "n", F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"))


def holm(df: DataFrame, p: str, family: Sequence[str], out: str = "p_holm", tie: Sequence[str] = ()) -> DataFrame:
    """Holm step-down p within each family of a result table (families of a few dozen tests)."""
    order = Window.partitionBy(*family).orderBy(F.col(p), *tie)
    size = F.count(F.col(p)).over(Window.partitionBy(*family))
    step = (size - F.row_number().over(order) + 1) * F.col(p)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_step", step)
        .withColumn(out, F.least(F.lit(1.0), F.max("_step").over(running)))
        .drop("_step")
    )


def holm_long(df: DataFrame, p: str, family: Sequence[str], tie: str, out: str = "p_holm") -> DataFrame:
    """Holm step-down p in families of any size, unique ``tie``; no family is sorted in one task."""
    family = list(family)
    placed = _placed(df, [p, tie], family).withColumn("_step", (F.col("_total") - F.col("_pos")) * F.col(p))
    earlier = Window.partitionBy(*family).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*family, "_run").agg(F.max("_step").alias("_n"))
    ends = broadcast_if_small(ends.select("_run", F.max("_n").over(earlier).alias("_so_far")))
    inside = F.max("_step").over(Window.partitionBy("_run").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    done = placed.join(ends, "_run").withColumn(out, F.least(F.lit(1.0), F.greatest(inside, F.col("_so_far"))))
    return done.drop("_step", "_so_far", "_pos", "_total", "_run")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark prunes to ``n`` per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def share_of_group_max(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Value over the group maximum; a group whose maximum is not positive keeps its values."""
    top = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(top > 0, F.col(value) / top).otherwise(F.col(value)))


def _placed(df: DataFrame, order: Sequence[str], by: list[str]) -> DataFrame:
    """``positions`` with the run of each row."""
    rows = numbered(df, by, order)
    runs = before_runs(rows.groupBy(*by, "_run").agg(F.count(F.lit(1)).alias("_n")), by)
    return rows.join(runs, "_run").withColumn("_pos", F.col("_before") + F.col("_in")).drop("_in", "_before")


def positions(df: DataFrame, order: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_pos`` (from 0) and ``_total``: the place of each row in its group by ``order``, ties by a unique id."""
    return _placed(df, [order, tie], list(by)).drop("_run")


def rolling_mean(df: DataFrame, by: Sequence[str], order: str, tie: str, value: str, window: int) -> DataFrame:
    """Centred moving average over ``window`` rows; outside the series counts as zero, as does a missing value.

    Every mean is a direct sum of its window (see ``rolling_sums``), so decimals survive series of any length.
    """
    sums = rolling_sums(df.select(*by, order, tie, value), by, [order, tie], value, window // 2, (window - 1) // 2)
    return sums.withColumn("smooth", F.col("_sum") / float(window)).drop("_sum")


def normal_scores(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the normal quantile of ``(rank - 0.5) / n`` at their first and last rank."""
    v = value_counts_before(df, value, by)
    n = F.col("_total").cast("double")
    return v.select(
        *by,
        value,
        F.col("_count").alias("n_rows"),
        normal_quantile((F.col("_below") + 0.5) / n).alias("score_first"),
        normal_quantile((F.col("_below") + F.col("_count") - 0.5) / n).alias("score_last"),
    )


def cumulative_share(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Percentage of the total and its running sum over a short ordered table (components)."""
    w = Window.partitionBy(*by).orderBy(*order)
    pct = 100.0 * F.col(value) / F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn("percentage", pct).withColumn(
        "cumulative", F.sum("percentage").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
