"""Exact Shapley values and interactions of forests, along the paths of their trees.

A coalition's value is the mean over the leaves that its members lead to; at a split of another feature a row goes both ways,
by the training weight of the children. A leaf's game is a product over the features of its path, so both indices follow
from the coefficients of a short polynomial, and a row is explained by itself: no background rows, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.operators.forests import Forest, gathered

#: Leaves and rows met at once, places of a leaf whose patterns are tabulated (256 of them).
LEAVES = 128
ROWS = 64
MOST_PLACES = 8
#: Cells into which the cuts of a group of neighbouring leaves may divide the rows, and rows that meet a group together.
MOST_CELLS = 4096
TOGETHER = 131_072


@dataclass
class Leaves:
    """Leaves whose paths use the same number of features: a row's feature lies in (low, high] or the leaf is left for ``share``."""

    feature: np.ndarray  # leaf x place
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray  # leaf
    group: np.ndarray  # leaf; ascending

    def part(self, a: int, z: int) -> Leaves:
        return Leaves(*[c[a:z] for c in (self.feature, self.low, self.high, self.share, self.value, self.group)])

    def met(self, x: np.ndarray) -> np.ndarray:
        """Row x leaf x place: whether the row's own value leads towards the leaf."""
        v = x[:, self.feature]
        return ((~(v <= self.low)) & ((v <= self.high) | np.isinf(self.high))).astype(float)

    def factors(self, met: np.ndarray, t: float) -> np.ndarray:
        """Row x leaf x place: what a place leaves of the leaf when its feature is a member with probability ``t``."""
        return self.share * (1.0 - t) + met * t


def leaves(model: Forest) -> list[Leaves]:
    """The leaves of a fitted forest, as many numbers as the model has nodes."""
    pieces: dict[int, list[tuple]] = {}
    group, ends_of = 0, {}  # neighbouring leaves, as long as their cuts make few cells
    for root, end in zip(model.roots.tolist(), [*model.roots.tolist()[1:], len(model.feature)]):
        feature, cut, left, right, value, weight = (getattr(model, c)[root:end].tolist() for c in ("feature", "cut", "left", "right", "value", "weight"))
        found: dict[int, list] = {}
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            n, path_of = todo.pop()
            if feature[n] < 0:
                places = sorted(path_of.items())
                ends_of = {f: ends_of.get(f, frozenset()) | {low, high} - {-math.inf, math.inf} for f, (low, high, _) in places} | {f: e for f, e in ends_of.items() if f not in path_of}
                if math.prod(len(e) + 1 for e in ends_of.values()) > MOST_CELLS:
                    group, ends_of = group + 1, {f: frozenset({low, high} - {-math.inf, math.inf}) for f, (low, high, _) in places}
                found.setdefault(len(places), []).append((*(([f for f, _ in places], *zip(*[p for _, p in places])) if places else ([], (), (), ())), value[n], group))
                continue
            low, high, share = path_of.get(feature[n], (-math.inf, math.inf, 1.0))
            for child, ends in ((left[n] - root, (low, min(high, cut[n]))), (right[n] - root, (max(low, cut[n]), high))):
                todo.append((child, {**path_of, feature[n]: (*ends, share * weight[child] / weight[n])}))
        for m, rows in found.items():  # arrays tree by tree: the leaves of all as objects would fill the driver
            pieces.setdefault(m, []).append((*(np.array([r[i] for r in rows], float).reshape(len(rows), m) for i in range(4)), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])))
    out = []
    for m, some in sorted(pieces.items()):
        f, lo, hi, z, value, number = (np.concatenate([p[i] for p in some]) for i in range(6))
        out.append(Leaves(f.astype(int), lo, hi, z, value / len(model.roots), number))
    return out


def expected(found: Sequence[Leaves]) -> float:
    """The value of the empty coalition: what the attributions of a row and this add up to is its prediction."""
    return float(sum((g.value * g.share.prod(axis=1)).sum() for g in found))


def _nodes(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that integrate polynomials of that degree over [0, 1] exactly."""
    t, w = np.polynomial.legendre.leggauss(degree // 2 + 1)
    return (t + 1) / 2, w / 2


def _by_rows(found: Sequence[Leaves], x: np.ndarray, width: int, game: Callable[[Leaves, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the leaves of ``game(leaves, met)``, which gives ``width`` numbers for each row and leaf: (rows, width).

    What a group of leaves gives depends only on the cell of its cuts in which a row lies: the group is summed once for every cell
    that has rows, and looked up for the rows.
    """
    out = np.zeros((width, len(x)))
    found = [g for g in found if g.feature.shape[1]]
    edges = [np.unique(np.concatenate([v[(g.feature == f) & np.isfinite(v)] for g in found for v in (g.low, g.high)] or [np.zeros(0)])) for f in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
    number = np.arange(max((int(g.group[-1]) for g in found if len(g.group)), default=-1) + 2)
    begins = [np.searchsorted(g.group, number).tolist() for g in found]
    for k in range(len(number) - 1):
        parts = [g.part(b[k], b[k + 1]) for g, b in zip(found, begins) if b[k] < b[k + 1]]
        if not parts:
            continue
        place = np.concatenate([np.r_[p.feature.ravel(), p.feature.ravel()] for p in parts])
        end = np.concatenate([np.r_[p.low.ravel(), p.high.ravel()] for p in parts])
        own = {f: np.unique(end[(place == f) & np.isfinite(end)]) for f in np.unique(place).tolist()}
        key, step = np.zeros(len(x), dtype=np.int64), 1
        for f, e in own.items():
            key += (np.r_[0, np.searchsorted(e, edges[f], "right")] * step)[codes[f]]
            step *= len(e) + 1
        if step <= max(MOST_CELLS, len(x)):
            filled = np.zeros(step, dtype=bool)
            filled[key] = True
            cells = np.flatnonzero(filled)
            at = (np.cumsum(filled) - 1)[key]
        else:  # a leaf with many places by itself
            cells, at = np.unique(key, return_inverse=True)
        digits, step = {}, 1
        for f, e in own.items():
            digits[f] = cells // step % (len(e) + 1)
            step *= len(e) + 1
        total = np.zeros((len(cells), width))
        for part in parts:
            for a in range(0, len(part.value), LEAVES):
                total += _by_cells(part.part(a, a + LEAVES), own, digits, len(cells), width, game)
        for c in np.flatnonzero(total.any(axis=0)).tolist():
            out[c] += np.ascontiguousarray(total[:, c])[at]
    return out.T


def _by_cells(g: Leaves, edges: dict[int, np.ndarray], digits: dict[int, np.ndarray], cells: int, width: int, game: Callable[[Leaves, np.ndarray], np.ndarray]) -> np.ndarray:
    """What a few leaves with equally many places give in each cell. The game is played once for every pattern of met places, or for each cell
    if there are many places."""
    m = g.feature.shape[1]
    out = np.zeros((cells, width))
    tabled = m <= MOST_PLACES
    steps = []
    for f in np.unique(g.feature).tolist():
        leaf, place = np.nonzero(g.feature == f)
        v = np.r_[edges[f], np.inf][:, None]
        met = ~(v <= g.low[leaf, place]) & ((v <= g.high[leaf, place]) | np.isinf(g.high[leaf, place]))
        bits = np.zeros((len(v), len(g.value)), dtype=np.int64)
        bits[:, leaf] = met.astype(np.int64) << place
        steps.append((digits[f], bits))
    if tabled:
        every = (np.arange(1 << m)[:, None, None] >> np.arange(m) & 1).astype(float)
        table = np.ascontiguousarray(game(g, np.broadcast_to(every, (1 << m, len(g.value), m))).swapaxes(0, 1)).reshape(-1, width)
        told = np.flatnonzero(table.any(axis=0))
        table = np.ascontiguousarray(table[:, told])
    rows = max(1, ROWS * LEAVES // len(g.value)) if tabled else ROWS
    for i in range(0, cells, rows):
        own = sum(bits[digit[i : i + rows]] for digit, bits in steps)
        if tabled:
            at = own + (np.arange(len(g.value)) << m)
            out[i : i + rows, told] = table.take(at.ravel(), axis=0).reshape(*at.shape, len(told)).sum(axis=1)
        else:
            out[i : i + rows] = game(g, (own[:, :, None] >> np.arange(m) & 1).astype(float)).sum(axis=1)
    return out


def values(found: Sequence[Leaves], x: np.ndarray) -> np.ndarray:
    """Shapley value of every row and feature.

    The weights of the coalitions by size are integrals of t^s (1 - t)^(n - 1 - s): a value is the integral over t of a product over the other
    places, which a few points give exactly. The product of all places is divided by one place's factor (above 0 inside the range).
    """

    def game(g: Leaves, met: np.ndarray) -> np.ndarray:
        mean = np.zeros(met.shape)
        for t, w in zip(*_nodes(g.feature.shape[1] - 1)):
            each = g.factors(met, t)
            mean += (w * each.prod(axis=2) * g.value)[:, :, None] / each
        mean *= met - g.share
        out = np.zeros((*met.shape[:2], x.shape[1]))
        for i in range(met.shape[2]):
            out[:, np.arange(met.shape[1]), g.feature[:, i]] = mean[:, :, i]
        return out

    return _by_rows(found, x, x.shape[1], game)


def pair_values(found: Sequence[Leaves], x: np.ndarray, pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """Shapley interaction value of every row and pair: half of the joint effect, as it stands at (i, j) and at (j, i)."""
    number = np.full((x.shape[1], x.shape[1]), -1)
    for k, (i, j) in enumerate(pairs):
        number[i, j] = number[j, i] = k

    def game(g: Leaves, met: np.ndarray) -> np.ndarray:
        n = met.shape[2]
        out = np.zeros((*met.shape[:2], len(pairs)))
        parts = [(w, e, e.prod(axis=2) * g.value) for t, w in zip(*_nodes(n - 2)) for e in [g.factors(met, t)]]
        for i in range(n):
            for j in range(i + 1, n):
                k = number[g.feature[:, i], g.feature[:, j]]
                own = np.flatnonzero(k >= 0)
                if len(own):
                    mean = sum(w * p[:, own] / (e[:, own, i] * e[:, own, j]) for w, e, p in parts) / 2
                    out[:, own, k[own]] = (met[:, own, i] - g.share[own, i]) * (met[:, own, j] - g.share[own, j]) * mean
        return out

    return _by_rows([g for g in found if g.feature.shape[1] >= 2], x, len(pairs), game)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all tasks, in few pieces: they are few for a file, costly to explain, and share what is summed for their cells."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def attribution(model: Forest, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Shapley values of the forest for every row: ``id, feature, value, phi``; they add up to the prediction minus ``expected``."""
    shared = rows.sparkSession.sparkContext.broadcast(leaves(model))
    k = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(batches, TOGETHER):
            phi = values(shared.value, np.concatenate([_matrix(b, k) for b in some]))
            for batch in some:
                own, phi = phi[: batch.num_rows], phi[batch.num_rows :]
                ends = pa.array(np.arange(len(own) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.ListArray.from_arrays(ends, pa.array(own.ravel()))], names=["id", "x", "phi"])

    plain = rows.select("id", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    told = _spread(plain).mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, x array<double>, phi array<double>")
    each = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("x").alias("value"), F.col("phi").alias("phi"))
    return told.select("id", F.inline(each))


def interactions(model: Forest, rows: DataFrame, features: Sequence[str], top: Sequence[str]) -> DataFrame:
    """Mean absolute interaction value of each pair of ``top`` features over the rows: ``a, b, strength``."""
    shared = rows.sparkSession.sparkContext.broadcast(leaves(model))
    k = len(features)
    names = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    pairs = [(features.index(a), features.index(b)) for a, b in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(pairs)), 0
        for some in gathered(batches, TOGETHER):
            x = np.concatenate([_matrix(b, k) for b in some])
            total += np.abs(pair_values(shared.value, x, pairs)).sum(axis=0)
            n += len(x)
        cols = [pa.array([p[i] for p in names], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(total), pa.array([n] * len(names), pa.int64())], names=["a", "b", "total", "n"])

    plain = rows.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    parts = _spread(plain).mapInArrow(run, "a string, b string, total double, n long")
    return parts.groupBy("a", "b").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("strength"))
