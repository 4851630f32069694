"""Random forests as tables of nodes. Tables of a checked size are held by every task, which grows blocks of trees of any forest; larger ones
are fitted by Spark ML. Many forests (folds, settings, resamples) are one job, as the unit of work is a block of trees. Forests that are
many together never meet in one place: a task predicts with the trees it grew, or forests lie in the shared folder and are read one by one."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.session import cut_lineage, local_table, new_path

#: Cells (rows times features) of a table that tasks may hold: 96 MB on the driver, a byte each in a task. Rows of all trees that grow side by side in a task.
MOST_CELLS = 12_000_000
MOST_ROWS = 1_000_000
#: Cuts tried per feature, and trees that one unit of work grows.
BINS = 64
TREES = 20
HEAVY = 50  # trees from which rows are dealt out to all tasks to be predicted
CELLS = 2_000_000
CHUNK = 16_384  # rows whose predictions travel together


# ------------------------------------------------------------------- models


class Forest(NamedTuple):
    """Nodes of all trees; a row goes left where its value is not above the cut. ``feature`` is -1 at a leaf."""

    features: list[str]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    def reached(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: (rows, trees)."""
        trees, k = len(self.roots), max(1, x.shape[1])
        values, children = x.ravel(), np.stack([self.right, self.left], axis=1).ravel()
        at, moving = np.tile(self.roots, len(x)), np.arange(len(x) * trees)
        node, begin = at, np.repeat(np.arange(len(x)) * k, trees)
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.all():
                moving, node, f, begin = moving[inner], node[inner], f[inner], begin[inner]
            if not len(moving):
                return at.reshape(len(x), trees)
            node = children[2 * node + (values[begin + f] <= self.cut[node])]
            at[moving] = node

    def predict_trees(self, x: np.ndarray) -> np.ndarray:
        """Prediction of every tree for rows of feature values: (rows, trees)."""
        return self.value[self.reached(x)]

    def cut_back(self, depth: int, least: int) -> np.ndarray:
        """For every node the one where a row on its way there ends if trees are ``depth`` deep and nodes of less than ``least`` weight are not split."""
        stand, nodes = np.arange(len(self.feature)), self.roots
        for level in range(len(stand)):
            nodes = nodes[self.feature[nodes] >= 0]
            if not len(nodes):
                break
            above = stand[nodes]
            ended = (above != nodes) | (level >= depth) | (self.weight[nodes] < least)
            for child in (self.left[nodes], self.right[nodes]):
                stand[child] = np.where(ended, above, child)
            nodes = np.r_[self.left[nodes], self.right[nodes]]
        return stand

    def predict(self, x: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // max(1, len(self.roots)))
        return np.concatenate([np.zeros(0), *[self.predict_trees(x[a : a + step]).mean(axis=1) for a in range(0, len(x), step)]])

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return with_predictions(df, {out: self})

    def importances(self) -> np.ndarray:
        """Share of each feature in the decrease of squared error, averaged over the trees."""
        total = np.zeros(len(self.features))
        ends = np.r_[self.roots[1:], len(self.feature)]
        for a, z in zip(self.roots, ends):
            inner = np.flatnonzero(self.feature[a:z] >= 0) + a
            own = np.bincount(self.feature[inner], self.gain[inner], len(total))
            total += own / own.sum() if own.sum() > 0 else 0.0
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        """The nodes as a table, a row per node."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        cols = [tree, np.arange(len(tree)), *[getattr(self, c) for c in ("feature", "cut", "left", "right", "value", "weight", "gain")]]
        rows = list(zip(*[c.tolist() for c in cols]))
        schema = "tree long, node long, feature long, cut double, `left` long, `right` long, value double, weight double, gain double"
        local_table(spark, rows, schema).write.mode("overwrite").parquet(f"{path}/nodes")
        local_table(spark, [(i, f) for i, f in enumerate(self.features)], "position int, feature string").write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().sort_by("node")
        features = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
        cols = {c: nodes.column(c).to_numpy() for c in ("tree", "feature", "cut", "left", "right", "value", "weight", "gain")}
        tree = cols.pop("tree")
        return cls(features, np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]), **cols)


def joined(features: Sequence[str], parts: Sequence[dict[str, np.ndarray]]) -> Forest:
    """One forest from blocks of trees whose nodes are numbered block by block."""
    base = np.cumsum([0, *[len(p["feature"]) for p in parts]]).tolist()
    shifted = [{**p, "roots": p["roots"] + b, "left": p["left"] + b, "right": p["right"] + b} for p, b in zip(parts, base)]
    return Forest(list(features), **{c: np.concatenate([p[c] for p in shifted]) for c in Forest._fields[1:]})


class Kept(NamedTuple):
    """A forest whose nodes lie in the shared folder: ``read`` brings them, and only while they are needed."""

    features: list[str]
    trees: int
    read: Callable[[], Forest]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return with_predictions(df, {out: self})


class Planned(NamedTuple):
    """A forest still to be grown, by the tasks that predict with it: what they all hold (``Sample`` and jobs, broadcast) and its place among the jobs."""

    features: list[str]
    trees: int
    shared: Any
    jobs: list[Job]
    number: int

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return with_predictions(df, {out: self})


def trees_of(model: Forest | Kept | Planned) -> int:
    return len(model.roots) if isinstance(model, Forest) else model.trees


def with_predictions(df: DataFrame, models: Mapping[str, Forest | Kept | Planned]) -> DataFrame:
    """One column per model, all in one pass; the models must have the same features. Many trees cost more than moving the rows to all tasks.

    The driver and the tasks hold one model at a time.
    """
    planned = {n: m for n, m in models.items() if isinstance(m, Planned)}
    if planned and len(planned) == len(models) and len({id(m.shared) for m in planned.values()}) == 1:
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        told = _predicted(rows, planned)
        if told is not None:
            return rows.join(told, "_row").select(*df.columns, *models)
        df = rows.drop("_row")
    if planned:
        models = dict(models) | dict(zip(planned, _kept([*planned.values()], df.sparkSession)))
    if sum(map(trees_of, models.values())) >= HEAVY:
        df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    features = next(iter(models.values())).features
    context = df.sparkSession.sparkContext
    shared = {n: context.broadcast(m.read() if isinstance(m, Kept) else m) for n, m in models.items()}
    k = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(batches, CHUNK):
            batch = pa.Table.from_batches(some).combine_chunks()
            x = batch.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            out = batch.drop_columns(["_x"])
            for name, one in shared.items():
                out = out.append_column(name, pa.array(one.value.predict(x)))
                if len(shared) > 1:
                    one.__dict__.pop("_value", None)  # it would stay in the worker
            yield from out.to_batches()

    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{n}` double" for n in models]])
    return df.withColumn("_x", F.array(*[F.col(f).cast("double") for f in features])).mapInArrow(run, types)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches until they have ``most`` rows or 64 MB together."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.num_rows for b in some) >= most or sum(b.nbytes for b in some) >= 64 << 20:
            yield some
            some = []
    if some:
        yield some


def _predicted(rows: DataFrame, models: Mapping[str, Planned]) -> DataFrame | None:
    """``_row`` and a column per model, by tasks that hold all rows and grow the trees; None if there are too many rows for that.

    Nodes stay where they were grown: what travels is one sum per row, model and task.
    """
    first, spark = next(iter(models.values())), rows.sparkSession
    k = len(first.features)
    table = rows.select("_row", F.array(*[F.col(f).cast("double") for f in first.features]).alias("x")).limit(MOST_CELLS // max(1, k) + 1).toArrow()
    if table.num_rows * k > MOST_CELLS:
        return None
    row = table.column("_row").to_numpy()
    held = spark.sparkContext.broadcast((row, table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)))
    shared, place = first.shared, {m.number: i for i, m in enumerate(models.values())}
    trees = [m.trees for m in models.values()]
    names = list(models)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, jobs = shared.value
        x = held.value[1]
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, a, z in (units[i] for i in batch.column("id").to_pylist()):
                total = found.setdefault(j, np.zeros(len(x)))
                for forest in grow_in_pieces(tables[jobs[j].table], jobs[j], a, z):
                    total += forest.predict(x) * len(forest.roots)
        for j, total in found.items():
            starts = range(0, len(x), CHUNK)
            cols = [pa.array([*starts], pa.int64()), pa.array([place[j]] * len(starts), pa.int32()), pa.array([total[i : i + CHUNK].astype("<f8").tobytes() for i in starts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["start", "model", "sums"])

    def means(part: pa.Table) -> pa.Table:
        start = part.column("start")[0].as_py()
        own = held.value[0][start : start + CHUNK]
        total = np.zeros((len(names), len(own)))
        order = part.sort_by([("model", "ascending"), ("task", "ascending")])  # the same sums whichever task came first
        for i, s in zip(order.column("model").to_pylist(), order.column("sums")):
            total[i] += np.frombuffer(s.as_buffer(), "<f8")
        return pa.table([pa.array(own), *[pa.array(t / n) for t, n in zip(total, trees)]], names=["_row", *names])

    units = [(j, a, z) for j, a, z in _blocks(first.jobs, _few(spark, [first.jobs[j] for j in place])) if j in place]  # in this order a task meets few models
    told = _dealt(spark, units).mapInArrow(sums, "start long, model int, sums binary").withColumn("task", F.spark_partition_id())
    return told.groupBy("start").applyInArrow(means, ", ".join(["_row long", *[f"`{n}` double" for n in names]]))


# ------------------------------------------------------------ growing trees


class Sample(NamedTuple):
    """A training table that every task holds: rows in the order of their ids, features cut into bins, row weights."""

    features: list[str]
    x: np.ndarray
    codes: np.ndarray
    cuts: list[np.ndarray]
    y: np.ndarray
    inner: np.ndarray
    weights: np.ndarray

    def bins(self) -> Sample:
        """Without the values: bins are enough to grow trees and to predict the rows themselves."""
        return self._replace(x=np.zeros((0, len(self.features))))


class Job(NamedTuple):
    """One forest: its table, the inner fold it leaves out (0: none), the column of weights (-1: none), settings and seed."""

    table: int
    left_out: int
    weight: int
    trees: int
    depth: int
    leaf: int
    split: int
    subset: str
    bootstrap: bool
    seed: int


def job_of(params: Mapping, seed: int, table: int = 0, left_out: int = 0, weight: int = -1) -> Job:
    return Job(table, left_out, weight, int(params["trees"]), int(params["depth"]), int(params["leaf"]), int(params.get("split", 2)), params["subset"], params.get("bootstrap", True), seed)


def cuts_of(x: np.ndarray) -> np.ndarray:
    """Halfway between neighbouring values, or between quantiles of a feature with many."""
    values = np.unique(x)
    if len(values) > BINS:
        values = np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1), method="inverted_cdf"))
    return (values[:-1] + values[1:]) / 2


def subset_size(rule: str, n: int) -> int:
    return max(1, {"all": n, "sqrt": int(math.sqrt(n)), "log2": int(math.log2(n)) if n > 1 else 1}[rule])


def _best_cuts(key: np.ndarray, bins: int, nodes: int, w: np.ndarray, wy: np.ndarray, n: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the best bin to end the left side and its value of the criterion; -inf where no cut leaves enough rows."""
    if nodes * bins <= 4 * len(key):
        sums = [np.bincount(key, v, nodes * bins).reshape(nodes, bins).cumsum(axis=1) for v in ((w, wy) if n is w else (w, wy, n))]
        sums += sums[:1] if n is w else []
        lw, ly, ln = (s[:, :-1] for s in sums)
        tw, ty, tn = (s[:, -1:] for s in sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = ly * ly / lw + (ty - ly) ** 2 / (tw - lw)
        score = np.where((ln >= leaf) & (tn - ln >= leaf), score, -np.inf)
        best = score.argmax(axis=1)
        return best, score[np.arange(nodes), best]
    bits = len(key).bit_length()  # few rows per node: cuts between neighbouring rows instead of all bins
    order = np.sort((key.astype(np.int64) << bits) | np.arange(len(key))) & ((1 << bits) - 1)  # a stable order; whole numbers sort faster than positions
    key = key[order]
    node = key // bins
    begin = np.searchsorted(node, np.arange(nodes))
    sums = [np.cumsum(v[order]) for v in ((w, wy) if n is w else (w, wy, n))]
    sums += sums[:1] if n is w else []
    before = [np.r_[0.0, s][begin] for s in sums]
    end = np.r_[begin[1:], len(key)]
    lw, ly, ln = (s - b[node] for s, b in zip(sums, before))
    tw, ty, tn = ((np.r_[0.0, s][end] - b)[node] for s, b in zip(sums, before))
    between = np.r_[(key[1:] != key[:-1]) & (node[1:] == node[:-1]), False]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = ly * ly / lw + (ty - ly) ** 2 / (tw - lw)
    score = np.where(between & (ln >= leaf) & (tn - ln >= leaf), score, -np.inf)
    top = np.full(nodes, -np.inf)
    filled = end > begin
    top[filled] = np.maximum.reduceat(score, begin[filled])
    hit = np.flatnonzero(score == top[node])
    first, at = np.unique(node[hit], return_index=True)
    best = np.zeros(nodes, dtype=np.int64)
    best[first] = key[hit[at]] % bins
    return best, top


def exclusive(codes: np.ndarray, bins: Sequence[int]) -> tuple[list[int], np.ndarray]:
    """Features of two bins of which no row has more than one in its upper bin, as the levels of a category, and each row's level (0: none)."""
    found, level = [], np.zeros(len(codes), dtype=np.int64)
    for f, b in enumerate(bins):
        if b == 2 and not level[codes[:, f] > 0].any():
            found.append(f)
            level[codes[:, f] > 0] = len(found)
    return found, level


def _level_scores(key: np.ndarray, levels: int, w: np.ndarray, wy: np.ndarray, n: np.ndarray, totals: Sequence[np.ndarray], leaf: int) -> np.ndarray:
    """Per node and level but the first the criterion of the cut that puts the level's rows right; all levels from one pass over the rows."""
    tw, ty, tn = (v[:, None] for v in totals)
    sums = [np.bincount(key, v, len(tw) * levels).reshape(-1, levels)[:, 1:] for v in ((w, wy) if n is w else (w, wy, n))]
    rw, ry, rn = sums + (sums[:1] if n is w else [])
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (ty - ry) ** 2 / (tw - rw) + ry * ry / rw
    return np.where((rn >= leaf) & (tn - rn >= leaf), score, -np.inf)


def _rows_of(asked: np.ndarray, node: np.ndarray, row: np.ndarray, w: np.ndarray, wy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nodes that are asked for, and of their rows the place of the node among them, number, weight, weighted value and count."""
    who = np.flatnonzero(asked)
    if len(who) == len(asked):
        return who, node, row, w, wy, n
    mine = np.flatnonzero(asked[node])
    own = w.take(mine)
    return who, (np.cumsum(asked) - 1).take(node.take(mine)), row.take(mine), own, wy.take(mine), own if n is w else n.take(mine)


def grow(sample: Sample, job: Job, first: int, last: int, coded: bool = False) -> dict[str, np.ndarray]:
    """Trees ``first`` to ``last - 1`` of a forest, level by level side by side; a tree depends on its seed and number alone.

    ``coded``: cuts are numbers of bins, for rows that are given by their bins.
    """
    base = np.ones(len(sample.y)) if job.weight < 0 else sample.weights[:, job.weight]
    rows = np.flatnonzero((base > 0) & (sample.inner != job.left_out if job.left_out else True))
    draws = [np.random.default_rng([job.seed, t]) for t in range(first, last)]
    times = [np.bincount(r.integers(0, len(rows), len(rows)), minlength=len(rows)) if job.bootstrap and len(rows) else np.ones(len(rows), dtype=np.int64) for r in draws]
    drawn = [np.flatnonzero(t) for t in times]
    tree = np.repeat(np.arange(len(draws)), [len(d) for d in drawn])
    row, n = (np.concatenate([np.zeros(0, dtype=kind), *some]).astype(kind) for some, kind in (([rows[d] for d in drawn], np.int64), ([t[d] for t, d in zip(times, drawn)], float)))
    w = n if job.weight < 0 else n * base[row]
    wy = w * sample.y[row]
    m, k = subset_size(job.subset, len(sample.features)), len(sample.features)
    out: dict[str, list[np.ndarray]] = {c: [] for c in [*Forest._fields[2:], "tree"]}
    columns = np.ascontiguousarray(sample.codes.T)
    bundle, level = exclusive(sample.codes, [len(c) + 1 for c in sample.cuts])
    bundle = bundle if len(bundle) > 1 else []
    every_cut, first_cut = np.concatenate([*sample.cuts, np.zeros(1)]), np.cumsum([0, *map(len, sample.cuts)])
    node, of_tree, total = tree, np.arange(len(draws)), 0
    for depth in range(job.depth + 1):
        count = len(of_tree)
        tw, ty = (np.bincount(node, v, count) for v in (w, wy))
        tn = tw if n is w else np.bincount(node, n, count)
        square = np.bincount(node, wy * sample.y[row], count)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(tw > 0, ty / tw, 0.0)
        spread = square - value * ty
        able = (tn >= max(job.split, 2 * job.leaf)) & (spread > 1e-12 * (square + 1e-300)) & (depth < job.depth)
        score, feature, cut_bin = np.full(count, -np.inf), np.full(count, -1), np.zeros(count, dtype=np.int64)
        if able.any():
            if m < k:
                chance = np.concatenate([draws[t].random((c, k)) for t, c in enumerate(np.bincount(of_tree, minlength=len(draws))) if c])
                allowed = chance.argsort(axis=1).argsort(axis=1) < m
            else:
                allowed = np.ones((count, k), dtype=bool)
            everyone = None
            together = None
            for f in range(k):
                bins = len(sample.cuts[f]) + 1
                if bins < 2:
                    continue
                if f in bundle:
                    if together is None:
                        if m < k:
                            who, number, rows_of, own, own_wy, own_n = _rows_of(able & allowed[:, bundle].any(axis=1), node, row, w, wy, n)
                        else:
                            everyone = everyone or _rows_of(able, node, row, w, wy, n)
                            who, number, rows_of, own, own_wy, own_n = everyone
                        key = number * (len(bundle) + 1)
                        key += level[rows_of]
                        together = who, _level_scores(key, len(bundle) + 1, own, own_wy, own_n, (tw[who], ty[who], tn[who]), job.leaf)
                    who, scores = together
                    got = np.where(allowed[who, f], scores[:, bundle.index(f)], -np.inf)
                    best = np.zeros(len(who), dtype=np.int64)
                else:
                    if m < k or everyone is None:
                        everyone = _rows_of(able & allowed[:, f], node, row, w, wy, n)
                    who, number, rows_of, own, own_wy, own_n = everyone
                    if not len(rows_of):
                        continue
                    key = number * bins
                    key += columns[f].take(rows_of)
                    best, got = _best_cuts(key, bins, len(who), own, own_wy, own_n, job.leaf)
                better = got > score[who] * (1 + 1e-13) + 1e-300
                score[who[better]], feature[who[better]], cut_bin[who[better]] = got[better], f, best[better]
        gained = score - value * ty
        feature[~(gained > 1e-12 * np.maximum(spread, 1e-300))] = -1
        split = feature >= 0
        children = total + count + 2 * (np.cumsum(split) - 1)
        cut = np.where(split, cut_bin, 0.0) if coded else np.where(split, every_cut[first_cut[feature] + np.where(split, cut_bin, 0)], 0.0)
        nodes = {"tree": of_tree, "feature": feature, "cut": cut, "left": np.where(split, children, -1), "right": np.where(split, children + 1, -1), "value": value, "weight": tw, "gain": np.where(split, gained, 0.0)}
        for c, v in nodes.items():
            out[c].append(v)
        total += count
        if not split.any():
            break
        keep = np.flatnonzero(split[node])
        same = n is w
        if len(keep) < len(row):
            row, w, wy, node = row.take(keep), w.take(keep), wy.take(keep), node.take(keep)
            n = w if same else n.take(keep)
        right = columns.ravel().take((feature * len(sample.y)).take(node) + row) > cut_bin.take(node)
        node = (children - total).take(node)
        node += right
        of_tree = np.repeat(of_tree[split], 2)
    whole = {c: np.concatenate(v) for c, v in out.items()}
    return _by_tree(whole, len(draws))


def grow_in_pieces(sample: Sample, job: Job, first: int, last: int, coded: bool = False) -> Iterator[Forest]:
    """Trees ``first`` to ``last - 1``, as many at a time as keep to ``MOST_ROWS``."""
    step = max(1, MOST_ROWS // max(1, len(sample.y)))
    for a in range(first, last, step):
        yield joined(sample.features, [grow(sample, job, a, min(a + step, last), coded)])


def _by_tree(nodes: dict[str, np.ndarray], trees: int) -> dict[str, np.ndarray]:
    """Nodes that were numbered level by level over all trees, renumbered tree by tree."""
    owner = nodes.pop("tree")
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    out = {c: v[order] for c, v in nodes.items()}
    for c in ("left", "right"):
        out[c] = np.where(out[c] >= 0, place[out[c]], -1)
    out["roots"] = np.searchsorted(owner[order], np.arange(trees))
    return out


# ------------------------------------------------------------------- Spark


def held_sample(df: DataFrame, ids: Sequence[str], features: Sequence[str], label: str, inner: str | None = None, weights: Sequence = ()) -> Sample | None:
    """The table as one that tasks may hold, or None if it has more than ``MOST_CELLS`` cells."""
    whole = all(f.dataType.simpleString() == "tinyint" for f in df.select(*weights).schema)
    place = {c: i for i, c in enumerate(features)}
    cols = [F.col(c).alias(f"_i{i}") for i, c in enumerate(ids) if c not in place] + [F.array(*[F.col(f).cast("double") for f in features]).alias("x")]
    cols += [F.col(label).cast("double").alias("y"), (F.col(inner) if inner else F.lit(0)).cast("int").alias("inner")]
    cols += [F.array(*[w if whole else w.cast("double") for w in weights]).alias("w")] if weights else []
    most = MOST_CELLS * 8 // max(1, 8 * len(features) + (1 if whole else 8) * len(weights))  # small whole numbers take a byte
    table = df.select(*cols).limit(most + 1).toArrow()
    n = table.num_rows
    if n > most:
        return None
    x, w = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, k) if k else np.zeros((n, 0)) for c, k in (("x", len(features)), ("w", len(weights))))
    if ids:
        by = [pa.array(x[:, place[c]]) if c in place else table.column(f"_i{i}") for i, c in enumerate(ids)]
        order = pc.sort_indices(pa.table(by, names=[str(i) for i in range(len(ids))]), [(str(i), "ascending") for i in range(len(ids))]).to_numpy()
        x, w, by = x[order], w[order], None
    else:
        order = np.arange(n)
    y, fold = (table.column(c).to_numpy()[order] for c in ("y", "inner"))
    del table
    cuts = [cuts_of(x[:, f]) if n else np.zeros(0) for f in range(len(features))]
    codes = np.zeros((n, len(features)), dtype=np.uint8)
    for f, c in enumerate(cuts):
        codes[:, f] = np.searchsorted(c, x[:, f])
    return Sample(list(features), x, codes, cuts, y, fold, w)


def _held(spark: SparkSession, samples: Sequence[Sample], jobs: Sequence[Job]):
    """What every task holds: the tables as bins, and the jobs."""
    return spark.sparkContext.broadcast(([s.bins() for s in samples], list(jobs)))


def _blocks(jobs: Sequence[Job], most: int = TREES) -> list[tuple[int, int, int]]:
    """Blocks of trees (job, first, last), the units of work."""
    return [(j, a, min(a + most, job.trees)) for j, job in enumerate(jobs) for a in range(0, job.trees, most)]


def _few(spark: SparkSession, jobs: Sequence[Job]) -> int:
    """Trees of a block, so that a few forests keep all tasks busy too."""
    return min(TREES, max(1, sum(job.trees for job in jobs) // (4 * spark.sparkContext.defaultParallelism)))


def _dealt(spark: SparkSession, units: Sequence[tuple[int, int, int]]) -> DataFrame:
    """One row per block of trees: its place in ``units``, neighbours in one task."""
    return spark.range(0, len(units), 1, max(1, min(len(units), 4 * spark.sparkContext.defaultParallelism)))


def _units(spark: SparkSession, units: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The blocks of trees of a job whose results go to the driver."""
    return _dealt(spark, units)


_KINDS = {"roots": "<i4", "feature": "<i4", "cut": "<f8", "left": "<i4", "right": "<i4", "value": "<f8", "weight": "<f8", "gain": "<f8"}


def _grown(dealt: DataFrame, shared, units: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The nodes of each block of trees, a row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, jobs = shared.value
        for batch in batches:
            for j, a, z in (units[i] for i in batch.column("id").to_pylist()):
                sample = tables[jobs[j].table]
                got = joined(sample.features, [f._asdict() for f in grow_in_pieces(sample, jobs[j], a, z)])
                cols = [pa.array([getattr(got, c).astype(kind).tobytes()], pa.binary()) for c, kind in _KINDS.items()]
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([a], pa.int32()), *cols], names=["job", "a", *_KINDS])

    return dealt.mapInArrow(run, ", ".join(["job int, a int", *[f"`{c}` binary" for c in _KINDS]]))


def _forest(features: Sequence[str], blocks: pa.Table) -> Forest:
    parts = [{c: np.frombuffer(b[c], kind) for c, kind in _KINDS.items()} for b in blocks.sort_by("a").to_pylist()]
    return joined(features, parts)


def fit_many(spark: SparkSession, samples: Sequence[Sample], jobs: Sequence[Job]) -> list[Forest]:
    """All forests in one job; what comes back is their nodes."""
    units = _blocks(jobs, _few(spark, jobs))
    blocks = _grown(_units(spark, units), _held(spark, samples, jobs), units).toArrow()
    return [_forest(samples[job.table].features, blocks.filter(pc.equal(blocks.column("job"), j))) for j, job in enumerate(jobs)]


def plan_many(spark: SparkSession, samples: Sequence[Sample], jobs: Sequence[Job]) -> list[Planned]:
    """All forests, to be grown when rows are predicted."""
    shared = _held(spark, samples, jobs)
    return [Planned(samples[job.table].features, job.trees, shared, list(jobs), j) for j, job in enumerate(jobs)]


def _kept(models: Sequence[Planned], spark: SparkSession) -> list[Kept]:
    """The forests grown into the shared folder."""
    first, own = models[0], {m.number for m in models}
    if any(m.shared is not first.shared for m in models):
        return [_kept([m], spark)[0] for m in models]
    units = [u for u in _blocks(first.jobs, _few(spark, [m.jobs[m.number] for m in models])) if u[0] in own]
    nodes = cut_lineage(_grown(_dealt(spark, units), first.shared, units))
    return [Kept(m.features, m.trees, lambda m=m: _forest(m.features, nodes.filter(F.col("job") == m.number).toArrow())) for m in models]


def _alike(samples: Sequence[Sample], jobs: Sequence[Job]) -> list[tuple[Job, list[int]]]:
    """Jobs whose trees are one another's upper parts: the job that grows them all, and its members.

    Where all features are tried, depth and split size only say where a tree ends; where features are drawn, only the depth does. ``sqrt`` and
    ``log2`` may draw equally many. Trees of the same number start from the same draws.
    """
    found: dict[tuple, list[int]] = {}
    for j, job in enumerate(jobs):
        k = len(samples[job.table].features)
        m = subset_size(job.subset, k)
        found.setdefault((job.table, job.left_out, job.weight, job.leaf, job.bootstrap, job.seed, m, job.split if m < k else 0, j if job.weight >= 0 else -1), []).append(j)
    return [(jobs[own[0]]._replace(trees=max(jobs[j].trees for j in own), depth=max(jobs[j].depth for j in own), split=min(jobs[j].split for j in own)), own) for own in found.values()]


def _spread_evenly(jobs: Sequence[Job], sizes: Sequence[int], units: Sequence[tuple[int, int, int]], tasks: int) -> list[tuple[int, int, int]]:
    """The blocks of trees in an order whose equal pieces cost about the same; ``sizes``: rows times features tried of each job."""
    cost = [(z - a) * sizes[j] * (2 + min(jobs[j].depth, 20)) for j, a, z in units]
    room = [(i + 1) * len(units) // tasks - i * len(units) // tasks for i in range(tasks)]
    load, own = [0.0] * tasks, [[] for _ in range(tasks)]
    for i in sorted(range(len(units)), key=lambda i: -cost[i]):
        t = min((t for t in range(tasks) if len(own[t]) < room[t]), key=load.__getitem__)
        own[t].append(units[i])
        load[t] += cost[i]
    return [u for some in own for u in some]


def left_out_errors(spark: SparkSession, samples: Sequence[Sample], jobs: Sequence[Job]) -> list[float]:
    """Root mean squared error of each forest on the rows of the inner fold it left out, all in one job. Trees that jobs have in common grow once."""
    whole, members = zip(*_alike(samples, jobs)) if jobs else ((), ())
    tasks = 4 * spark.sparkContext.defaultParallelism
    units = _blocks(whole, max(1, sum(w.trees for w in whole) // tasks))
    sizes = [len(samples[w.table].y) * (1 + subset_size(w.subset, len(samples[w.table].features))) for w in whole]
    units = _spread_evenly(whole, sizes, units, max(1, min(len(units), tasks)))
    shared = _held(spark, samples, jobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, all_jobs = shared.value
        for batch in batches:
            for i, a, z in (units[n] for n in batch.column("id").to_pylist()):
                sample, own = tables[whole[i].table], [j for j in members[i] if all_jobs[j].trees > a]
                x = sample.codes[sample.inner == whole[i].left_out]
                sums = {j: np.zeros(len(x)) for j in own}
                for forest in grow_in_pieces(sample, whole[i], a, min(z, max(all_jobs[j].trees for j in own)), coded=True):
                    at, told = forest.reached(x), {}
                    for j in own:
                        job = all_jobs[j]
                        ends = job.depth, max(job.split, 2 * job.leaf)
                        if job.trees > a:
                            if len(members[i]) > 1 and ends not in told:
                                told[ends] = forest.value[forest.cut_back(*ends)][at]
                            each = told[ends] if ends in told else forest.value[at]
                            sums[j] += each[:, : job.trees - a].sum(axis=1)
                    a += len(forest.roots)
                for j, total in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["job", "sums"])

    def error(parts: pa.Table) -> pa.Table:
        tables, all_jobs = shared.value
        j = parts.column("job")[0].as_py()
        y = tables[all_jobs[j].table].y[tables[all_jobs[j].table].inner == all_jobs[j].left_out]
        total = sum(np.frombuffer(p.as_buffer(), "<f8") for p in parts.column("sums"))
        return pa.table([pa.array([j], pa.int32()), pa.array([math.sqrt(np.mean((total / all_jobs[j].trees - y) ** 2)) if len(y) else math.nan])], names=["job", "e"])

    parts = _units(spark, units).mapInArrow(run, "job int, sums binary")
    found = {r["job"]: r["e"] for r in parts.groupBy("job").applyInArrow(error, "job int, e double").collect()}
    return [float(found.get(j, math.nan)) for j in range(len(jobs))]


def fit_large(df: DataFrame, features: Sequence[str], label: str, params: Mapping, seed: int, weight: str | None = None) -> Forest:
    """A forest on a table that no task could hold, by Spark ML, as nodes (no minimum split size there)."""
    return keep_large(df, features, label, params, seed, weight).read()


def keep_large(df: DataFrame, features: Sequence[str], label: str, params: Mapping, seed: int, weight: str | None = None) -> Kept:
    """``fit_large`` whose nodes stay in the shared folder until they are read."""
    rf = RandomForestRegressor(
        featuresCol="_v", labelCol=label, numTrees=int(params["trees"]), maxDepth=min(30, int(params["depth"])), minInstancesPerNode=int(params["leaf"]),
        featureSubsetStrategy=params["subset"], bootstrap=params.get("bootstrap", True), seed=seed, cacheNodeIds=True,
    )
    if weight:
        rf = rf.setWeightCol(weight)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_v"), rf]).fit(df)
    path = new_path(df.sparkSession, "forest")
    model.stages[-1].save(path)
    return Kept(list(features), int(params["trees"]), lambda: _read_large(df.sparkSession, path, features))


def _read_large(spark: SparkSession, path: str, features: Sequence[str]) -> Forest:
    node = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats")[0].alias("weight"), "nodeData.leftChild", "nodeData.rightChild", "nodeData.gain",
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
    )
    got = node.toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    tree, number, feature, cut, weight = (got.column(c).to_numpy() for c in ("treeID", "id", "feature", "cut", "weight"))
    place, inner = tree.astype(np.int64) << 32 | number, got.column("leftChild").to_numpy() >= 0
    child = [np.where(inner, np.searchsorted(place, tree.astype(np.int64) << 32 | np.maximum(got.column(c).to_numpy(), 0)), -1) for c in ("leftChild", "rightChild")]
    values = [np.where(inner, feature, -1), np.where(inner, cut, 0.0), *child, got.column("prediction").to_numpy(), weight, np.where(inner, got.column("gain").to_numpy() * weight, 0.0)]
    return Forest(list(features), np.flatnonzero(number == 0), *values)
