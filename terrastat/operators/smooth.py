"""Locally weighted regression of long series.

The tricube weight is a polynomial of degree nine on each side of the point asked for, so rows far from the edges of a window need not be
read one by one: chunks of rows enter with their centred moments, neighbouring chunks as one node of a binary tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.operators.ranks import positions, value_counts_before
from terrastat.operators.summary import join_groups, percentile_columns
from terrastat.session import broadcast_if_small, cut_lineage

#: Rows of a chunk, and chunks that the shared directory may hold (240 bytes each); longer series get longer chunks.
CHUNK = 512
MOST_CHUNKS = 65_536
#: Moments of x and of x times y: the weight has degree 9, and is multiplied by x squared or by x and y.
X_MOMENTS, XY_MOMENTS = 12, 11
#: Weight 1 within .001 of the radius, 0 beyond .999.
NEAR, FAR = 0.001, 0.999
SUMS = ("s0", "s1", "s2", "t0", "t1")


# ----------------------------------------------------------------- moments


class Nodes(NamedTuple):
    """Places from and to, smallest and largest x, centre, and moments about the centre of some runs of rows."""

    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    mx: np.ndarray
    mxy: np.ndarray

    def take(self, rows: np.ndarray) -> Nodes:
        return Nodes(*[a[rows] for a in self])


def _moved(m: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Moments about a centre that lies ``by`` lower: sums of ``(u + by) ** j`` from those of ``u ** j``."""
    out = np.zeros_like(m)
    powers = by[:, None] ** np.arange(m.shape[1])
    for j in range(m.shape[1]):
        for i in range(j + 1):
            out[:, j] += comb(j, i) * powers[:, j - i] * m[:, i]
    return out


class Tree:
    """Chunks of one series and the nodes over 2, 4, 8, ... of them."""

    def __init__(self, chunks: Nodes):
        self.levels = [chunks]
        while len(self.levels[-1].begin) > 1:
            below = self.levels[-1]
            n = len(below.begin) // 2 * 2
            a, b = below.take(np.arange(0, n, 2)), below.take(np.arange(1, n, 2))
            low, high = np.minimum(a.low, b.low), np.maximum(a.high, b.high)
            centre = (low + high) / 2
            mx, mxy = (_moved(p, a.centre - centre) + _moved(q, b.centre - centre) for p, q in ((a.mx, b.mx), (a.mxy, b.mxy)))
            self.levels.append(Nodes(a.begin, b.end, low, high, centre, mx, mxy))

    def over(self, a: int, b: int) -> Nodes | None:
        """The few nodes that make up the chunks from ``a`` to ``b - 1``."""
        out, level = [], 0
        while a < b:
            nodes = self.levels[level]
            if a % 2:
                out.append(nodes.take(np.array([a])))
                a += 1
            if b % 2 and a < b:
                b -= 1
                out.append(nodes.take(np.array([b])))
            a, b, level = a // 2, b // 2, level + 1
        return Nodes(*[np.concatenate(p) for p in zip(*out)]) if out else None


def moment_sums(nodes: Nodes, side: float, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The five sums of each ``x`` with radius ``h`` over nodes that lie wholly inside its window, on one side of it."""
    a = (nodes.centre[None, :] - x[:, None]) / h[:, None]
    scaled = [[m[None, :, j] / h[:, None] ** j for j in range(m.shape[2 - 1])] for m in (nodes.mx, nodes.mxy)]
    powers = [np.ones_like(a)]
    for _ in range(X_MOMENTS - 1):
        powers.append(powers[-1] * a)

    def about(m: int, parts: list[np.ndarray]) -> np.ndarray:
        """Sums of ``((row - x) / h) ** m``."""
        return sum(comb(m, j) * powers[m - j] * parts[j] for j in range(m + 1)).sum(axis=1)

    def weighted(extra: int, parts: list[np.ndarray]) -> np.ndarray:
        p = [about(m + extra, parts) for m in (0, 3, 6, 9)]
        return p[0] - 3 * side * p[1] + 3 * p[2] - side * p[3]

    of_x, of_xy = scaled
    return np.stack([weighted(0, of_x), h * weighted(1, of_x), h * h * weighted(2, of_x), weighted(0, of_xy), h * weighted(1, of_xy)], axis=1)


def row_sums(place: np.ndarray, x: np.ndarray, y: np.ndarray, rw: np.ndarray, qx: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The five sums of each query over single rows; rows outside its window count nothing."""
    dx = x[None, :] - qx[:, None]
    d = np.abs(dx) / h[:, None]
    w = np.where(d <= NEAR, 1.0, np.where(d >= FAR, 0.0, (1 - np.minimum(d, 1.0) ** 3) ** 3))
    w = np.where((place[None, :] >= begin[:, None]) & (place[None, :] < end[:, None]), w * rw[None, :], 0.0)
    return np.stack([w.sum(1), (w * dx).sum(1), (w * dx * dx).sum(1), w @ y, (w * dx) @ y], axis=1)


# ------------------------------------------------------------------- Spark


def _neighbourhoods(df: DataFrame, by: list[str], frac: float) -> DataFrame:
    """Rows with position, window start ``_l``, window size ``_k`` and radius ``_h``.

    The window of ``k`` nearest rows starts at the first place ``l`` with
    ``x[l] + x[l+k] >= 2 x``, so its start is a count of smaller sums.
    """
    rows = cut_lineage(positions(df, "x", "id", by).withColumn("_k", F.greatest(F.floor(F.col("_total") * frac + 1e-10), F.lit(1))))
    ahead = rows.select(*by, (F.col("_pos") - F.col("_k")).alias("_pos"), F.col("x").alias("_ahead"))
    steps = rows.join(ahead, [*by, "_pos"]).select(*by, (F.col("x") + F.col("_ahead")).alias("_m"), F.lit(1).alias("_w"))
    asked = rows.select(*by, (2.0 * F.col("x")).alias("_m"), F.lit(0).alias("_w"))
    below = value_counts_before(steps.unionByName(asked), "_m", by, weight=F.col("_w")).select(*by, "_m", F.col("_below").alias("_l"))
    rows = rows.withColumn("_m", 2.0 * F.col("x")).join(below, [*by, "_m"]).drop("_m")
    at = rows.select(*by, F.col("_pos").alias("_p"), F.col("x").alias("_xp"))
    lo = at.select(*by, F.col("_p").alias("_l"), F.col("_xp").alias("_xl"))
    hi = at.select(*by, F.col("_p").alias("_r"), F.col("_xp").alias("_xr"))
    rows = rows.withColumn("_r", F.col("_l") + F.col("_k") - 1).join(lo, [*by, "_l"]).join(hi, [*by, "_r"])
    return rows.withColumn("_h", F.greatest(F.col("x") - F.col("_xl"), F.col("_xr") - F.col("x"))).drop("_r", "_xl", "_xr")


def _arrays(batch: pa.RecordBatch, i: int, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c)[i].values.to_numpy() for c in names]


def _keys(batch: pa.RecordBatch, by: Sequence[str]) -> list[tuple]:
    return list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows


def _chunks(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """``by, chunk`` and arrays of its rows in order."""
    fields = ["_pos", "x", "y", "_rw", "_l", "_k", "_h"]
    packed = rows.groupBy(*by, F.floor(F.col("_pos") / size).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_r"))
    return packed.select(*by, "chunk", *[F.col(f"_r.{c}").alias(c) for c in fields])


def _trees(chunks: DataFrame, by: list[str]) -> dict[tuple, Tree]:
    """The tree of every series, from one short row per chunk."""
    names = ["begin", "end", "low", "high", "centre"]
    types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                place, x, y, rw = _arrays(batch, i, ["_pos", "x", "y", "_rw"])
                centre = (x[0] + x[-1]) / 2
                u = (x - centre)[:, None] ** np.arange(X_MOMENTS)
                out.append((float(place[0]), float(place[-1] + 1), x[0], x[-1], centre, rw @ u, (rw * y) @ u[:, :XY_MOMENTS]))
            cols = [pa.array(c, pa.float64()) for c in list(zip(*out))[:5]] + [pa.array([list(v) for v in c], pa.list_(pa.float64())) for c in list(zip(*out))[5:]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], *cols], names=[*by, *names, "mx", "mxy"])

    schema = ", ".join([*[f"{c} {types[c]}" for c in by], *[f"{n} double" for n in names], "mx array<double>, mxy array<double>"])
    found = chunks.select(*by, "_pos", "x", "y", "_rw").mapInArrow(summed, schema).toArrow().combine_chunks()
    keys = _keys(found, by)
    of: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        of.setdefault(key, []).append(i)
    cols = [found.column(n).to_numpy() for n in names]
    moments = [np.array(found.column(n).to_pylist(), dtype=float).reshape(-1, w) for n, w in (("mx", X_MOMENTS), ("mxy", XY_MOMENTS))]
    out = {}
    for key, rows in of.items():
        rows = np.array(rows)[np.argsort(cols[0][rows])]
        out[key] = Tree(Nodes(*[c[rows] for c in cols], *[m[rows] for m in moments]))
    return out


def _reach(tree: Tree, own: int, x: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[list[tuple[float, int, int]], np.ndarray]:
    """Runs of chunks that lie wholly inside all windows (side, from, to), and the chunks that must be read row by row."""
    c = tree.levels[0]
    met = (c.end > begin.min()) & (c.begin < end.max())
    inside = met & (c.begin >= begin.max()) & (c.end <= end.min()) & (c.low > (x - FAR * h).max()) & (c.high < (x + FAR * h).min())
    inside[own] = False
    at = np.arange(len(met))
    runs = []
    for side, mine in ((-1.0, inside & (at < own)), (1.0, inside & (at > own))):
        edge = np.flatnonzero(np.diff(np.r_[0, mine.astype(np.int8), 0]))
        runs += [(side, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return runs, np.flatnonzero(met & ~inside)


def _fit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Weighted straight line at every row; ``_rw`` is the robustness weight."""
    total = rows.count()
    chunks = cut_lineage(_chunks(rows, by, max(CHUNK, -(-total // MOST_CHUNKS))))
    shared = rows.sparkSession.sparkContext.broadcast(_trees(chunks, by))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keyed = [f"{c} {types[c]}" for c in by]
    asked = ["_pos", "x", "_l", "_k", "_h"]

    def query(batch: pa.RecordBatch, i: int, names: Sequence[str]) -> tuple[np.ndarray, ...]:
        place, x, begin, k, h = _arrays(batch, i, names)
        return place, x, begin, begin + k, np.where(h > 0, h, 1.0)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the nodes inside all windows of a chunk, and the chunks it still has to meet."""
        for batch in batches:
            for i, key in enumerate(_keys(batch, by)):
                tree, own = shared.value[key], batch.column("chunk")[i].as_py()
                place, x, begin, end, h = query(batch, i, asked)
                runs, rest = _reach(tree, own, x, begin, end, h)
                sums = np.zeros((len(x), len(SUMS)))
                for side, a, b in runs:
                    sums += moment_sums(tree.over(a, b), side, x, h)
                cols = [pa.array([v], batch.schema.field(c).type) for c, v in zip(by, key)] + [pa.array([own])]
                cols += [pa.array([v], pa.list_(pa.float64())) for v in sums.T] + [pa.array([rest], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*by, "chunk", *SUMS, "rest"])

    form = ", ".join([*keyed, "chunk long", *[f"{s} array<double>" for s in SUMS], "rest array<long>"])
    far = cut_lineage(chunks.select(*by, "chunk", *asked).mapInArrow(wide, form))
    pairs = far.select(*by, "chunk", F.explode("rest").alias("other")).join(chunks.select(*by, "chunk", *[F.col(c).alias(f"q{c}") for c in asked]), [*by, "chunk"])
    other = chunks.select(*by, F.col("chunk").alias("other"), *[F.col(c).alias(f"r{c}") for c in ("_pos", "x", "y", "_rw")])
    met = pairs.join(other, [*by, "other"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(_keys(batch, by)):
                place, x, begin, end, h = query(batch, i, [f"q{c}" for c in asked])
                sums = row_sums(*_arrays(batch, i, ["r_pos", "rx", "ry", "r_rw"]), x, begin, end, h)
                cols = [pa.array([v] * len(x), batch.schema.field(c).type) for c, v in zip(by, key)] + [pa.array(place)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(v)) for v in sums.T]], names=[*by, "_pos", *SUMS])

    near = met.select(*by, *[f"q{c}" for c in asked], "r_pos", "rx", "ry", "r_rw").mapInArrow(close, ", ".join([*keyed, "_pos long", *[f"{s} double" for s in SUMS]]))
    places = chunks.select(*by, "chunk", "_pos").join(far.drop("rest"), [*by, "chunk"])
    spread = places.select(*by, F.explode(F.arrays_zip("_pos", *SUMS)).alias("_z")).select(*by, "_z.*")
    s = near.unionByName(spread).groupBy(*by, "_pos").agg(*[F.sum(c).alias(c) for c in SUMS])
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = F.try_divide(F.col("t0") * F.col("s2") - F.col("s1") * F.col("t1"), det)
    flat = det <= 1e-12 * F.col("s0") * F.col("s0")
    level = F.when(flat, F.try_divide(F.col("t0"), F.col("s0"))).otherwise(line)
    return rows.join(s.select(*by, "_pos", "s0", level.alias("_fit")), [*by, "_pos"]).withColumn(
        "smooth", F.when(F.col("s0") > 0, F.col("_fit")).otherwise(F.col("y"))
    ).drop("s0", "_fit")


def lowess(df: DataFrame, by: Sequence[str] = (), frac: float = 0.4, robust: int = 3) -> DataFrame:
    """Robust local-linear trend ``by, id, x, y, smooth`` of ``df(by, id, x, y)``.

    Tricube weights over the ``frac`` nearest rows and ``robust`` bisquare reweightings. Chunks of consecutive rows meet, row by row,
    only the chunks at the edges of their windows and themselves; what lies between enters by moments, so the work grows as n log n whatever the share.
    """
    by = list(by)
    rows = cut_lineage(_neighbourhoods(df.select(*by, "id", "x", "y"), by, frac).withColumn("_rw", F.lit(1.0)))
    for step in range(robust + 1):
        fitted = _fit(rows, by)
        if step == robust:
            return fitted.select(*by, "id", "x", "y", "smooth")
        fitted = cut_lineage(fitted.withColumn("_a", F.abs(F.col("y") - F.col("smooth"))))
        med = percentile_columns(fitted, "_a", {"_med": 0.5}, by)
        u = F.try_divide(F.col("_a"), 6.0 * F.col("_med"))
        weight = F.when((F.col("_med") <= 0) | (u <= 0.001), 1.0).when(u >= 0.999, 0.0).otherwise(F.pow(1.0 - u * u, F.lit(2.0)))
        rows = cut_lineage(join_groups(fitted, broadcast_if_small(med) if by else med, by).withColumn("_rw", weight).drop("_a", "_med", "smooth"))
    return rows
