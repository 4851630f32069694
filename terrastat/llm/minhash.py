"""Near duplicates by min-max hashing: both ends of every permutation are kept, bands find candidates, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays
from terrastat.llm.shared import components, stored
from terrastat.session import broadcast_if_small

PERMUTATIONS = 48
ROWS = 4
CHUNK = 64
STAR_ROUNDS = 2
BLOCK = 128


def _min_max(values: np.ndarray, bounds: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest and largest value of each set under each permutation ``x -> (x xor s) * m``: one evaluation, two entries."""
    flips, factors = arrays.multipliers(permutations, 21), arrays.multipliers(permutations, 22)
    out = np.zeros((len(bounds) - 1, 2 * permutations), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at = bounds[:-1][full]
        for p in range(permutations):
            v = (values ^ flips[p]) * factors[p]
            out[full, 2 * p] = np.minimum.reduceat(v, at)
            out[full, 2 * p + 1] = np.maximum.reduceat(v, at)
    return out


def signatures(docs: DataFrame, words: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: size and 128-bit identity of its shingle set, and one hash per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            w = arrays.split_words(texts)
            values, bounds = arrays.shingles(arrays.word_hashes(w), w.first, words)
            n = len(texts)
            size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for d in range(n):
                own = np.unique(values[bounds[d] : bounds[d + 1]])
                size[d] = len(own)
                one[d], two[d] = arrays.mix(own).sum(dtype=np.uint64), arrays.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
            ends = _min_max(values, bounds, permutations)
            bands = ends.reshape(n, -1, rows)
            keys = arrays.mix((bands * arrays.multipliers(rows, 23)).sum(axis=2, dtype=np.uint64) ^ arrays.multipliers(bands.shape[1], 24))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), arrays.signed(one), arrays.signed(two), arrays.lists(keys.view(np.int64), pa.int64())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Of ``pairs (a, b)`` those whose full shingle sets have ``100 * intersection >= similarity * union``.

    The partners of one ``a`` are dealt to chunks of about 64, so a text with many partners is read by many tasks;
    a task holds the set of one ``a`` and streams its partners.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(many, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), cast(ceil(n / {CHUNK}.0) as int))").alias("chunk"))
    heads = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    rows = heads.union(dealt.select("a", "chunk", F.lit(1), "b")).join(texts, "doc_id")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch, found in arrays.slices(batches):
            w = arrays.split_words(found)
            values, bounds = arrays.shingles(arrays.word_hashes(w), w.first, words)
            a, chunk, role, b = (batch.column(c).to_pylist() for c in ("a", "chunk", "role", "doc_id"))
            left, right = [], []
            for i in range(len(found)):
                these = np.unique(values[bounds[i] : bounds[i + 1]])
                if role[i] == 0:
                    head, own = (a[i], chunk[i]), these
                elif head == (a[i], chunk[i]):
                    small, large = sorted((len(these), len(own)))
                    if 100 * small < similarity * large:
                        continue
                    both = len(np.intersect1d(these, own, assume_unique=True))
                    if 100 * both >= similarity * (small + large - both):
                        left.append(a[i])
                        right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.select("a", "chunk", "role", "doc_id", "text").mapInArrow(run, "a long, b long")


def shingle_lists(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles``: the distinct shingle hashes of each text, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            w = arrays.split_words(texts)
            values, bounds = arrays.shingles(arrays.word_hashes(w), w.first, words)
            own = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            at = pa.array(np.r_[0, np.cumsum([len(x) for x in own])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, arrays.signed(np.concatenate(own)))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def linked_in_tile(left: list[np.ndarray], right: list[np.ndarray], similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all (left, right) sets with ``100 * intersection >= similarity * union``."""
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    own, other = inverse[: size_l.sum()], inverse[size_l.sum() :]
    owner = np.repeat(np.arange(len(right)), size_r)
    begin = np.r_[0, np.cumsum(size_l)]
    mark = np.zeros(int(inverse.max(initial=0)) + 1)
    found = []
    for i in range(len(left)):
        mark[own[begin[i] : begin[i + 1]]] = 1
        both = np.bincount(owner, mark[other], len(right))
        mark[own[begin[i] : begin[i + 1]]] = 0
        j = np.flatnonzero(100 * both >= similarity * (size_l[i] + size_r - both))
        found.append((np.full(len(j), i), j))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def cross_links(open_rows: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """All confirmed links between documents of different ``root`` that some band connects; ``open_rows (band, doc_id, root)``.

    Documents that bands connect form a cluster. Its rows are dealt to blocks of about ``BLOCK``, large components to blocks
    of their own, and blocks meet in tiles, except blocks of one component. A tile is compared in memory, so pairs never
    become rows: only links come out.
    """
    heads = open_rows.groupBy("band").agg(F.min("doc_id").alias("b"))
    cluster = components(open_rows.join(heads, "band").select(F.col("doc_id").alias("a"), "b")).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    members = stored(open_rows.select("doc_id", "root").distinct().join(cluster, "doc_id"))
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("n")).withColumn("large", F.expr(f"n >= {BLOCK // 2}"))
    pooled = sizes.where("not large").groupBy("cluster").agg(F.sum("n").alias("rest"))
    sizes = sizes.join(pooled, "cluster", "left")
    small = F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("root"), F.ceil(F.col("rest") / BLOCK)).cast("string"))
    big = F.concat_ws(":", F.lit("b"), F.col("root").cast("string"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK)).cast("string"))
    placed = members.join(sizes, ["cluster", "root"]).withColumn("block", F.when(F.col("large"), big).otherwise(small))
    placed = stored(placed.select("doc_id", "root", "cluster", "block", F.when(F.col("large"), F.col("root")).alias("of")))
    blocks = placed.select("cluster", "block", "of").distinct()
    other = blocks.select("cluster", F.col("block").alias("second"), F.col("of").alias("of2"))
    tiles = blocks.join(other, "cluster").where("block <= second and (of is null or of2 is null or of <> of2)")
    tiles = stored(tiles.select("cluster", F.col("block").alias("first"), "second", F.xxhash64("cluster", "block", "second").alias("tile")))
    sides = tiles.select("cluster", F.col("first").alias("block"), "tile", F.lit(0).alias("side"))
    sides = sides.union(tiles.select("cluster", "second", "tile", F.lit(1)))
    lists = stored(shingle_lists(texts.join(placed.select("doc_id"), "doc_id", "left_semi"), words))
    rows = placed.join(sides, ["cluster", "block"]).join(lists, "doc_id").select("tile", "side", "doc_id", "root", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[], []]
        tile = None

        def flush() -> pa.RecordBatch:
            i, j = linked_in_tile([r[2] for r in held[0]], [r[2] for r in held[1]], similarity) if held[0] and held[1] else ((), ())
            pairs = [(held[0][x], held[1][y]) for x, y in zip(i, j) if held[0][x][1] != held[1][y][1]]
            return pa.RecordBatch.from_arrays([pa.array([p[k][0] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            flat, at = batch.column("shingles").values.to_numpy(), batch.column("shingles").offsets.to_numpy()
            for n, r in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "doc_id", "root")))):
                if r[0] != tile:
                    if tile is not None:
                        yield flush()
                    tile, held = r[0], [[], []]
                held[r[1]].append((r[2], r[3], flat[at[n] : at[n + 1]].view(np.uint64).copy()))
        if tile is not None:
            yield flush()

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs (doc_id, text, ...)``.

    Sets are distinct ``words``-word shingles of the text with A-Z in lower case, a shorter text being one shingle. Equal
    sets collapse to their smallest ``doc_id`` before anything is compared. 2 * ``permutations`` min-max values in bands of
    ``rows`` give a pair of similarity 0.8 a shared band with a chance above 0.99997: both ends of a permutation are never one
    element, so small sets miss most, 2.2e-5 with 4 of 5 shared and 3.2e-6 in large sets. Every confirmed link is exact.
    Within a band's bucket members are first compared with one head per component, several times, which is linear in the
    bucket; documents of different components that bands still connect are then compared all with all, in tiles, so no
    link is given up.

    Missing or blank texts have 0 shingles and stay alone. A missing ``doc_id`` gives a missing component and ``kept``.
    Rows that repeat a ``doc_id`` must repeat its text. Other columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signs = stored(signatures(plain, words, permutations, rows))
    sets = signs.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
    sets = stored(sets.agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")))
    entries = sets.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    head = F.min(F.struct("doc_id", "n")).alias("head")
    shared = entries.groupBy("band").agg(F.count("*").alias("size"), head).where("size > 1").drop("size")
    entries = stored(entries.join(shared, "band"))

    texts = stored(plain.join(entries.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id"]))
    fits = f"100 * least(n, m) >= {similarity} * greatest(n, m)"
    first = entries.select("doc_id", "n", F.col("head.doc_id").alias("a"), F.col("head.n").alias("m")).where("a <> doc_id").where(fits)
    tested = stored(first.select("a", F.col("doc_id").alias("b")).distinct())
    links = stored(confirmed(tested, texts, words, similarity))
    roots = components(links)
    for turn in range(STAR_ROUNDS + 1):
        label = F.coalesce("root", "doc_id").alias("root")
        now = entries.select("band", "doc_id", "n").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n", label)
        split = now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
        now = stored(now.join(split, "band"))
        if now.isEmpty():
            break
        if turn == STAR_ROUNDS:
            links = links.union(stored(cross_links(now, texts, words, similarity)))
            roots = components(links)
            break
        parts = now.groupBy("band", "root").agg(F.count("*").alias("size"), F.min_by(F.struct("doc_id", "n"), F.xxhash64("doc_id", F.lit(turn))).alias("head"))
        main = parts.groupBy("band").agg(F.max_by(F.struct("root", "head"), F.struct("size", "root")).alias("x"))
        main = main.select("band", F.col("x.root").alias("main"), F.col("x.head.doc_id").alias("a"), F.col("x.head.n").alias("m"))
        pairs = now.join(main, "band").where("root <> main").where(fits).select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b"))
        pairs = stored(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            new = stored(confirmed(pairs, texts, words, similarity))
            tested, links = tested.union(pairs), links.union(new)
            if not new.isEmpty():
                roots = components(links)
    known = sets.select("set_a", "set_b", "n_shingles", F.col("doc_id").alias("node")).join(roots, "node", "left")
    known = known.select("set_a", "set_b", "n_shingles", F.coalesce("root", "node").alias("root"))
    return signs.join(known, ["set_a", "set_b", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        (F.col("doc_id") == F.coalesce("root", "doc_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest ``doc_id``; its columns stay as they are.

    Rows without ``doc_id`` cannot be compared and stay. Rows that repeat a ``doc_id`` are one document, which stays if one of
    them does.
    """
    groups = near_duplicates(docs, **options).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = stored(groups.where("not kept").select("doc_id"))
    return docs.join(broadcast_if_small(gone, 200_000), "doc_id", "left_anti").select(*docs.columns)
