"""Product codes of vectors: exact integer k-means per part over anchors-hierarchy metric trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.llm.shared import stored
from terrastat.session import broadcast_if_small

#: Vectors under one set of trees, and points below which a ball is not split.
BLOCK = 1024
LEAF = 64
#: Slack of the ownership test: what float rounding could hide is left to the exact distances.
SLACK = 1.0 + 1e-9
FAR = np.iinfo(np.int64).max
CHUNK = 8192


# ------------------------------------------------------------------- balls


class Ball(NamedTuple):
    """Rows within ``sqrt(r2)`` of ``pivot``, with their sum; a ball without children is a leaf."""

    rows: np.ndarray
    pivot: np.ndarray
    r2: int
    total: np.ndarray
    children: tuple[Ball, Ball] | None


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def _ball(x: np.ndarray, rows: np.ndarray, children: tuple[Ball, Ball] | None = None) -> Ball:
    total = children[0].total + children[1].total if children else x[rows].sum(axis=0)
    pivot = total // len(rows)
    return Ball(rows, pivot, int(_squared(x[rows], pivot).max()), total, children)


def anchors(x: np.ndarray, k: int) -> np.ndarray:
    """Owner of each row among at most ``k`` anchors.

    Each new anchor is the row farthest from its own; it takes the rows nearer to it, and looks only at rows at least half the
    gap between both anchors away from theirs (nearer ones cannot move, by the triangle inequality).
    """
    places, owner = [0], np.zeros(len(x), dtype=np.int64)
    dist = np.sqrt(_squared(x, x[0]).astype(float))
    while len(places) < k:
        new = int(dist.argmax())
        if dist[new] == 0.0:
            break
        gap = np.sqrt(_squared(x[places], x[new]).astype(float))
        seen = np.flatnonzero(dist >= gap[owner] / 2 / SLACK)
        own = np.sqrt(_squared(x[seen], x[new]).astype(float))
        taken = own < dist[seen]
        dist[seen[taken]], owner[seen[taken]] = own[taken], len(places)
        places.append(new)
    return owner


def grow(x: np.ndarray, rows: np.ndarray) -> Ball:
    """Middle-out tree: anchors first, joined upwards two by two into the smallest balls, each split downwards the same way."""
    whole = _ball(x, rows)
    if len(rows) <= LEAF or whole.r2 == 0:
        return whole
    owner = anchors(x[rows], int(np.ceil(np.sqrt(len(rows)))))
    order = np.argsort(owner, kind="stable")
    parts = np.split(rows[order], np.flatnonzero(np.diff(owner[order])) + 1)
    if len(parts) == 1:
        return whole
    balls = [grow(x, p) for p in parts]
    n = len(balls)
    pivots, radii = np.array([b.pivot for b in balls], dtype=float), np.sqrt([float(b.r2) for b in balls])
    cover = (np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(-1)) + radii[:, None] + radii[None]) / 2
    cover[np.tril_indices(n)] = np.inf
    for _ in range(n - 1):
        a, b = divmod(int(cover.argmin()), n)
        balls[a] = _ball(x, np.concatenate([balls[a].rows, balls[b].rows]), (balls[a], balls[b]))
        cover[b, :] = cover[:, b] = np.inf
        pivots[a], radii[a] = balls[a].pivot, np.sqrt(float(balls[a].r2))
        reach = (np.sqrt(((pivots - pivots[a]) ** 2).sum(-1)) + radii + radii[a]) / 2
        live = np.array([not np.isinf(cover[a, j]) or not np.isinf(cover[j, a]) for j in range(n)])
        up, down = live & (np.arange(n) > a), live & (np.arange(n) < a)
        cover[a, up], cover[down, a] = reach[up], reach[down]
        last = balls[a]
    return last


def flattened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in tree order, and the nodes: left, right (-1: leaf), from, to, squared radius, pivot, sum; node 0 is the root."""
    root = grow(x, np.arange(len(x)))
    w = x.shape[1]
    order, nodes, pending = [], [], [(root, None, 0)]
    at = 0
    while pending:
        ball, parent, side = pending.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        nodes.append([-1, -1, at, at + len(ball.rows), ball.r2, *ball.pivot.tolist(), *ball.total.tolist()])
        if ball.children is None:
            order.append(ball.rows)
            at += len(ball.rows)
        else:
            pending += [(ball.children[1], me, 1), (ball.children[0], me, 0)]
    return np.concatenate(order), np.array(nodes, dtype=np.int64).reshape(-1, 5 + 2 * w)


class Forest(NamedTuple):
    """The trees of one part over several blocks, rows and nodes numbered through."""

    points: np.ndarray
    nodes: np.ndarray
    roots: np.ndarray


def _forest(points: list[np.ndarray], nodes: list[np.ndarray]) -> Forest:
    sizes, rows = np.array([len(n) for n in nodes]), np.array([len(p) for p in points])
    first, base = np.cumsum(sizes) - sizes, np.cumsum(rows) - rows
    every = np.concatenate(nodes)
    shift = np.repeat(first, sizes)
    every[:, :2] = np.where(every[:, :2] >= 0, every[:, :2] + shift[:, None], -1)
    every[:, 2:4] += np.repeat(base, sizes)[:, None]
    return Forest(np.concatenate(points), every, first)


def owned_balls(forest: Forest, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """Settles every row: ``(nodes, None, entries)`` for balls owned whole, ``(rows, distances, entries)`` for rows of the leaves.

    A ball's list of candidate entries goes to its children. An entry leaves the list when the hyperplane halfway to the one
    nearest to the pivot is farther than the ball's radius; the last one left owns the ball.
    """
    w = book.shape[1]
    gaps = _squared(book[:, None], book[None]).astype(float)
    front, live = forest.roots, np.ones((len(forest.roots), len(book)), dtype=bool)
    while len(front):
        node = forest.nodes[front]
        d2 = _squared(node[:, None, 5 : 5 + w], book[None])
        best = np.where(live, d2, FAR).argmin(axis=1)
        lead = (d2 - np.take_along_axis(d2, best[:, None], 1)).astype(float)
        live &= ~((lead > 0) & (lead * lead > 4.0 * node[:, 4:5] * gaps[best] * SLACK))
        single, leaf = live.sum(axis=1) == 1, node[:, 0] < 0
        yield front[single], None, best[single]
        open_leaf = ~single & leaf
        counts = (node[open_leaf, 3] - node[open_leaf, 2]).astype(np.int64)
        rows = np.repeat(node[open_leaf, 2] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        allowed = np.repeat(live[open_leaf], counts, axis=0)
        for i in range(0, len(rows), CHUNK):
            some = rows[i : i + CHUNK]
            near = np.where(allowed[i : i + CHUNK], _squared(forest.points[some][:, None], book[None]), FAR)
            entry = near.argmin(axis=1)
            yield some, np.take_along_axis(near, entry[:, None], 1)[:, 0], entry
        inner = ~single & ~leaf
        front, live = np.concatenate([node[inner, 0], node[inner, 1]]), np.concatenate([live[inner], live[inner]])


def round_sums(forest: Forest, book: np.ndarray) -> np.ndarray:
    """Rows owned by each entry and their sum, ``(entries, 1 + width)``."""
    k, w = book.shape
    out = np.zeros((k, 1 + w), dtype=np.int64)
    for where, dist, entry in owned_balls(forest, book):
        if dist is None:
            node = forest.nodes[where]
            np.add.at(out[:, 0], entry, node[:, 3] - node[:, 2])
            np.add.at(out[:, 1:], entry, node[:, 5 + w :])
        else:
            np.add.at(out[:, 0], entry, 1)
            np.add.at(out[:, 1:], entry, forest.points[where])
    return out


def assigned(forest: Forest, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row."""
    entries, dists = np.zeros(len(forest.points), dtype=np.int64), np.zeros(len(forest.points), dtype=np.int64)
    for where, dist, entry in owned_balls(forest, book):
        if dist is None:
            counts = forest.nodes[where, 3] - forest.nodes[where, 2]
            rows = np.repeat(forest.nodes[where, 2] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            own = np.repeat(entry, counts)
            entries[rows], dists[rows] = own, _squared(forest.points[rows], book[own])
        else:
            entries[where], dists[where] = entry, dist
    return entries, dists


# ------------------------------------------------------------------- Spark


def _kept(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, v``: rows without a missing or non-finite component, as integers ``floor(scale * x)``."""

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.select("vec_id", "label", "embedding").where(ok).select("vec_id", "label", whole.alias("v"))


def _trees(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """One row per block of vectors: ids, labels, and for every part the points in tree order, that order, and the nodes."""
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"ids array<{types['vec_id']}>, labels array<{types['label']}>, points array<binary>, places array<binary>, nodes array<binary>"
    most = int(np.sqrt(float(1 << 61) / (parts * width)) / 2)

    def block(batch: pa.Table) -> pa.RecordBatch:
        flat = batch.column("v").combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        if (sizes != parts * width).any():
            raise ValueError(f"all vectors must have {parts * width} components; found {sorted(set(sizes.tolist()))[:3]}")
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)
        if np.abs(x).max() > most:
            raise ValueError(f"scaled components beyond {most} would overflow the squared distances")
        points, places, nodes = [], [], []
        for p in range(parts):
            own = np.ascontiguousarray(x[:, p])
            order, tree = flattened(own)
            points.append(own[order].astype("<i4").tobytes())
            places.append(order.astype("<i4").tobytes())
            nodes.append(tree.astype("<i8").tobytes())
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        cols = {"ids": [ids], "labels": [labels], "points": [points], "places": [places], "nodes": [nodes]}
        kinds = [pa.list_(batch.schema.field("vec_id").type), pa.list_(batch.schema.field("label").type), *[pa.list_(pa.binary())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds)], names=list(cols))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            held = pa.Table.from_batches(rest)
            while held.num_rows >= BLOCK:
                yield block(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
            rest = held.to_batches()
        if rest:
            yield block(pa.Table.from_batches(rest))

    return kept.mapInArrow(build, schema)


def _forests(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[int, Forest]]:
    """The forest of every part of a batch of blocks."""
    points, nodes = batch.column("points").to_pylist(), batch.column("nodes").to_pylist()
    for p in range(parts):
        yield p, _forest(
            [np.frombuffer(b[p], "<i4").astype(np.int64).reshape(-1, width) for b in points],
            [np.frombuffer(b[p], "<i8").reshape(-1, 5 + 2 * width) for b in nodes],
        )


def _some(batches: Iterator[pa.RecordBatch], rows: int = 16) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def learn_codebooks(trees: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks ``(part, entry, width)`` after ``rounds`` of assigning and averaging; every task returns only its sums."""
    books = start.copy()
    parts, k, width = books.shape
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            out = np.zeros((parts, k, 1 + width), dtype=np.int64)
            for batch in _some(batches):
                for p, forest in _forests(batch, parts, width):
                    out[p] += round_sums(forest, books[p])
            place = np.arange(out.size)
            held = out.ravel() != 0
            yield pa.RecordBatch.from_arrays([pa.array(place[held], pa.int32()), pa.array(out.ravel()[held], pa.int64())], names=["place", "n"])

        parted = trees.select("points", "nodes").mapInArrow(sums, "place int, n long")
        found = parted.groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        table = [[[0] * (1 + width) for _ in range(k)] for _ in range(parts)]
        for place, n in found:
            p, rest = divmod(place, k * (1 + width))
            table[p][rest // (1 + width)][rest % (1 + width)] = int(n)
        books = np.array([[[s // e[0] for s in e[1:]] if e[0] else books[p, i].tolist() for i, e in enumerate(t)] for p, t in enumerate(table)], dtype=np.int64)
    return books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Codes of ``vectors(vec_id, embedding, label)``: ``vec_id, label, code, error, label_error, codebooks_sha256``.

    Blocks of vectors get one anchors-hierarchy tree per part, kept with the balls' sums and counts in the shared folder; every
    round passes the candidate entries down these trees, and only 64-bit sums leave a task. All arithmetic is exact.

    Rows whose vector is null, empty, or holds a null or non-finite component are dropped. Codebooks start from the rows with
    the smallest ``vec_id`` (null ids last, equal ids by vector); with fewer kept rows than ``entries`` they have that many
    entries. Repeated rows count each. Null labels are one group. An empty table gives no rows; other columns are ignored. Vectors of another length than
    the first, lengths that ``parts`` does not divide, and components too large for 64-bit squared distances are errors.
    """
    kept = _kept(vectors, scale)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    columns = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if not seeds:
        empty = vectors.sparkSession.createDataFrame([], columns)
        return empty.withColumn("label_error", F.lit(0).cast("long")).withColumn("codebooks_sha256", F.lit(""))
    if any(len(r.v) % parts for r in seeds):
        raise ValueError(f"{parts} parts do not divide vectors of {len(seeds[0].v)} components")
    width = len(seeds[0].v) // parts
    if any(len(r.v) != parts * width for r in seeds):
        raise ValueError("vectors differ in length")
    trees = stored(_trees(kept, parts, width))
    start = np.array([[r.v[p * width : (p + 1) * width] for r in seeds] for p in range(parts)], dtype=np.int64)
    books = learn_codebooks(trees, start, rounds)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            ids, labels = batch.column("ids"), batch.column("labels")
            n = len(ids.flatten())
            base = np.repeat(ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0], np.diff(ids.offsets.to_numpy()))
            places, codes, error = batch.column("places").to_pylist(), np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
            for p, forest in _forests(batch, parts, width):
                entry, dist = assigned(forest, books[p])
                row = base + np.concatenate([np.frombuffer(b[p], "<i4") for b in places])
                codes[row, p] = entry
                error[row] += dist
            text = codes.tobytes().hex()
            step = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [ids.flatten(), labels.flatten(), pa.array([text[i : i + step] for i in range(0, step * n, step)]), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    coded = stored(trees.mapInArrow(finish, columns))
    of_label = broadcast_if_small(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("codebooks_sha256", F.lit(codebook_digest(books)))
