"""Rows in one global order: a single range partitioning, what crosses the partitions goes through a table of a row per run.

A run is what a partition holds of a group. An unpartitioned window would send all rows to one task, and one per group those of
a large group; here rows are numbered inside their run while they are sorted, and the runs of a group are summed by a
window over their table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrastat.session import broadcast_if_small, cut_lineage


def types_of(df: DataFrame, columns: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{c}` {types[c]}" for c in columns]


class Runs:
    """Tells the runs of a sorted partition apart, batch after batch."""

    def __init__(self, by: Sequence[str]):
        self.by, self.last, self.run = list(by), None, -1

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """Number of the run of each row."""
        n = batch.num_rows
        begins = np.zeros(n, dtype=bool)
        for c in self.by:
            codes = batch.column(c).dictionary_encode("encode").indices.to_numpy()
            begins[1:] |= codes[1:] != codes[:-1]
        first = tuple(batch.column(c)[0].as_py() for c in self.by)
        begins[0] = self.last is None or first != self.last
        self.last = tuple(batch.column(c)[n - 1].as_py() for c in self.by)
        out = self.run + np.cumsum(begins)
        self.run = int(out[-1])
        return out


def sorted_rows(df: DataFrame, by: Sequence[str], keys: Sequence[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str) -> DataFrame:
    """``df`` range partitioned and sorted by group and keys, ``fn`` applied to each partition, stored."""
    order = [*by, *keys]
    return cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(fn, ", ".join([*types_of(df, df.columns), added])))


def numbered(df: DataFrame, by: Sequence[str], keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Adds ``_run`` (ascending along the order) and ``_in``: the rows, or their ``weight``, before each row in its run."""
    by = list(by)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, base, carry, last = Runs(by), TaskContext.get().partitionId() << 33, 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            run = runs.of(batch)
            w = np.ones(len(run), dtype=np.int64) if weight is None else batch.column(weight).to_numpy().astype(np.int64)
            before = np.cumsum(w) - w + (carry if run[0] == last else 0)
            begin = np.flatnonzero(np.r_[run[0] != last, run[1:] != run[:-1]])
            shift = np.zeros(len(run), dtype=np.int64)
            shift[begin] = before[begin] - np.r_[0, before[begin]][: len(begin)] if len(begin) else 0
            before = before - np.cumsum(shift)
            carry, last = int(before[-1] + w[-1]), int(run[-1])
            yield batch.append_column("_run", pa.array(run + base)).append_column("_in", pa.array(before))

    return sorted_rows(df, by, keys, number, "_run long, _in long")


def before_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``_run, _before, _total`` from one row ``by, _run, _n`` per run."""
    w = Window.partitionBy(*by).orderBy("_run")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return broadcast_if_small(runs.select("_run", before.alias("_before"), total.alias("_total")))


# ------------------------------------------------------------ moving sums


def moving_sums(v: np.ndarray, left: int, right: int) -> np.ndarray:
    """Sum of ``v[i - left : i + right + 1]``, outside counted as zero, from sums of at most one window's values each."""
    w, n = left + right + 1, len(v)
    padded = np.zeros(-(-(n + 2 * w) // w) * w)
    padded[left : left + n] = v
    rows = padded.reshape(-1, w)
    ahead, behind = np.cumsum(rows, axis=1).ravel(), np.cumsum(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n)
    return np.where(at % w == 0, behind[at], behind[at] + ahead[at + w - 1])


def rolling_sums(df: DataFrame, by: Sequence[str], keys: Sequence[str], value: str, left: int, right: int) -> DataFrame:
    """Adds ``_sum``: the total of ``value`` (missing as zero) from ``left`` rows before to ``right`` rows after, inside the group.

    Partitions are summed directly while they are sorted. A window that reaches over the edge of its partition gets the rest from
    the last and first values of the runs beside it, a few values per run that are handed over by a window over runs.
    """
    by = list(by)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else held[0]
        run = Runs(by).of(batch)
        v = np.nan_to_num(batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        end = np.r_[begin[1:], len(run)]
        inside = np.concatenate([moving_sums(v[a:z], left, right) for a, z in zip(begin, end)])
        at = np.arange(len(run))
        place, rest = at - begin[run], end[run] - 1 - at
        missing_left = np.where(run == 0, np.maximum(0, left - place), 0)
        missing_right = np.where(run == run[-1], np.maximum(0, right - rest), 0)
        base = TaskContext.get().partitionId() << 33
        edge = ((run == 0) & (place < right)) | ((run == run[-1]) & (rest < left))
        cols = {"_run": pa.array(run + base), "_sum": pa.array(inside), "_left": pa.array(missing_left), "_right": pa.array(missing_right)}
        cols |= {"_place": pa.array(place), "_rest": pa.array(rest), "_edge": pa.array(edge), "_whole": pa.array(end[run] - begin[run])}
        out = pa.Table.from_batches([batch])
        for name, col in cols.items():
            out = out.append_column(name, col)
        yield from out.to_batches(max_chunksize=65_536)

    added = "_run long, _sum double, _left long, _right long, _place long, _rest long, _edge boolean, _whole long"
    rows = sorted_rows(df, by, keys, add, added)
    helpers = ["_run", "_left", "_right", "_place", "_rest", "_edge", "_whole", "_heads", "_tails", "_before", "_after"]
    if left + right == 0:
        return rows.drop(*helpers)
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    v = F.when(F.isnan(v), 0.0).otherwise(v)
    pair = F.struct("_place", v.alias("v"))
    edges = rows.where("_edge").groupBy(*by, "_run").agg(
        F.array_sort(F.collect_list(F.when(F.col("_place") < right, pair))).alias("_heads"),
        F.array_sort(F.collect_list(F.when(F.col("_rest") < left, pair))).alias("_tails"),
        F.min("_whole").alias("_whole"),
    )
    edges = cut_lineage(edges)
    # runs between two partitions' edges may be shorter than the window: then more than one of them is needed
    short = edges.agg(F.min("_whole")).first()[0]
    if short is None:
        return rows.drop(*helpers)
    steps = min(max(left, right), 1 + -(-max(left, right) // short))
    w = Window.partitionBy(*by).orderBy("_run")
    tails = F.flatten(F.collect_list(F.col("_tails.v")).over(w.rowsBetween(-steps, -1)))
    heads = F.flatten(F.collect_list(F.col("_heads.v")).over(w.rowsBetween(1, steps)))
    halo = broadcast_if_small(edges.select(F.col("_run").alias("_of"), tails.alias("_before"), heads.alias("_after")))
    joined = rows.join(halo, (F.col("_run") == F.col("_of")) & ((F.col("_left") > 0) | (F.col("_right") > 0)), "left").drop("_of")

    def total(part):
        return F.coalesce(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))

    want = F.least(F.col("_left"), F.size("_before").cast("long")).cast("int")
    last = F.when(want > 0, F.slice("_before", F.size("_before") - want + 1, want))
    first = F.when(F.col("_right") > 0, F.slice("_after", F.lit(1), F.col("_right").cast("int")))
    return joined.withColumn("_sum", F.col("_sum") + total(last) + total(first)).drop(*helpers)
