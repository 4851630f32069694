"""Benchmark passages in training texts: BM25 over an inverted index of test items with block-max pruning, then overlap checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays
from terrastat.llm.shared import stored
from terrastat.session import broadcast_if_small

PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
PUNCTUATION_BYTES = bytes(np.flatnonzero(PUNCTUATION).tolist())
BLOCK = 16
#: Words of test items in one index, which every task holds; more items make more indexes, one scan each.
INDEX_WORDS = 1_000_000
#: Items of fewer words have no statistics to score by: they are looked for as they are.
LEAST_WORDS = 5
#: Letters of scripts that set no blanks between words.
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\ua000-\ua4cf\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
#: Leading bytes by which such an item is looked up.
ANCHOR = 8
GRAM = 3
K1, B = 1.2, 0.75


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without marks at their ends, and the bounds per text; words of marks alone are left out."""
    w = arrays.split_words(texts)
    if not len(w.starts):
        return np.zeros(0, np.uint64), w.first
    b = w.buffer
    at = np.arange(len(b))
    last = np.maximum.accumulate(np.where(PUNCTUATION[b], -1, at))
    after = np.minimum.accumulate(np.where(PUNCTUATION[b], len(b), at)[::-1])[::-1]
    starts, ends = after[w.starts], last[w.ends - 1] + 1
    full = starts < np.minimum(ends, w.ends)
    first = np.r_[0, np.cumsum(full)][w.first]
    return arrays.hash_ranges(arrays.LOWER[b], starts[full], ends[full]), first


class ItemIndex:
    """Postings of terms by item with normalised BM25 impacts: an item scores 1 against itself.

    Items are numbered in blocks of ``BLOCK``; each term knows its largest impact in the list and in each block.
    """

    def __init__(self, ids: list[int], words: list[np.ndarray], df: dict[int, int], n_items: int, mean_words: float, answer_share: float):
        self.ids = np.array(ids, np.int64)
        self.span = max([64, *map(len, words)])
        term, item, impact = [], [], []
        for i, w in enumerate(words):
            t, tf = np.unique(w, return_counts=True)
            idf = np.array([math.log1p((n_items - df[int(x)] + 0.5) / (df[int(x)] + 0.5)) for x in t.view(np.int64)])
            score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_words))
            term.append(t)
            item.append(np.full(len(t), i))
            impact.append(score / score.sum())
        term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
        order = np.lexsort((item, term))
        self.terms, begin = np.unique(term[order], return_index=True)
        self.item, self.impact = item[order], impact[order]
        self.begin = np.r_[begin, len(order)]
        self.n_blocks = -(-len(ids) // BLOCK)
        cell = np.searchsorted(self.terms, term[order]) * self.n_blocks + self.item // BLOCK
        cells, start = np.unique(cell, return_index=True)
        self.block, self.block_max = cells % self.n_blocks, np.maximum.reduceat(self.impact, start)
        self.block_begin = np.searchsorted(cells, np.arange(len(self.terms) + 1) * self.n_blocks)
        self.list_max = np.maximum.reduceat(self.impact, begin)
        self.parts = [self._parts(w, answer_share) for w in words]

    @staticmethod
    def _parts(w: np.ndarray, share: float) -> tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]:
        """Question and answer of an item, each as (words in a run, hashes of its runs)."""
        cut = len(w) - max(GRAM, round(share * len(w))) if len(w) >= 2 * GRAM else 0
        both = (w[:cut], w[cut:]) if cut else (w, w)
        return tuple((k := min(GRAM, len(p)), np.unique(arrays.window_hashes(p, k))) for p in both)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) with a score of ``least`` or more; ``passage, term`` are distinct pairs.

        As in block-max WAND nothing is scored that bounds rule out: first the sums of list maxima of a passage, then the
        sums of block maxima of a passage and block; only postings of blocks that may reach ``least`` are read.
        """
        floor = least - 1e-9
        alive = np.bincount(passage, self.list_max[term], n) >= floor
        keep = alive[passage]
        passage, term = passage[keep], term[keep]
        number = np.cumsum(alive) - 1
        p, back = number[passage], np.flatnonzero(alive)

        def expand(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = begin[term + 1] - begin[term]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            return np.repeat(np.arange(len(term)), size), step + np.repeat(begin[term], size)

        pair, at = expand(self.block_begin)
        bound = np.bincount(p[pair] * self.n_blocks + self.block[at], self.block_max[at], len(back) * self.n_blocks)
        live = (bound >= floor).reshape(len(back), self.n_blocks)
        keep = live.any(axis=1)[p]
        p, term = p[keep], term[keep]
        pair, at = expand(self.begin)
        keep = live[p[pair], self.item[at] // BLOCK]
        cell = p[pair[keep]] * len(self.ids) + self.item[at[keep]]
        cells, inverse = np.unique(cell, return_inverse=True)
        score = np.bincount(inverse, self.impact[at[keep]], len(cells)) if len(cells) else np.zeros(0)
        hit = score >= floor
        return back[cells[hit] // len(self.ids)], cells[hit] % len(self.ids), score[hit]


def unspaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts in lower case without blanks, each text closed by a blank, their bounds, and the place before."""
    buffer, at = arrays.joined(texts)
    keep = ~arrays.BLANK[buffer]
    keep[at[1:] - 1] = True
    run = np.r_[0, np.cumsum(keep)]
    return arrays.LOWER[buffer[keep]], run[at], np.flatnonzero(keep), at


def anchors(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each place as one number."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out |= buffer[np.minimum(at + j, len(buffer) - 1)].astype(np.uint64) << np.uint64(8 * j)
    return out


class ShortItems:
    """Items of fewer than ``LEAST_WORDS`` words by all of their words, or by all of their bytes where a script sets no blanks."""

    def __init__(self, ids: list[int], words: list[np.ndarray], runs: list[bytes | None]):
        self.by_words, self.by_bytes = [], []
        for k in range(1, LEAST_WORDS):
            own = [(int(arrays.window_hashes(w, k)[0]), i) for i, w, r in zip(ids, words, runs) if r is None and len(w) == k]
            if own:
                own.sort()
                self.by_words.append((k, np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))
        for size in range(1, ANCHOR + 1):
            own = [(r, i) for i, r in zip(ids, runs) if r is not None and min(len(r), ANCHOR) == size]
            if own:
                table: dict[int, list[tuple[bytes, int]]] = {}
                for r, i in own:
                    table.setdefault(int.from_bytes(r[:size], "little"), []).append((r, i))
                leads = np.zeros(256, bool)
                leads[[r[0] for r, _ in own]] = True
                self.by_bytes.append((size, np.array(sorted(table), np.uint64), table, leads))

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, words before its first place) of each item in each text."""
        found: dict[tuple[int, int], int] = {}
        if self.by_words:
            hashes, first = plain_words(texts)
            for k, keys, ids in self.by_words:
                runs = arrays.window_hashes(hashes, k)
                low, high = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
                for a in np.flatnonzero(high > low).tolist():
                    d = int(np.searchsorted(first, a, side="right") - 1)
                    if a + k <= first[d + 1]:
                        for i in ids[low[a] : high[a]].tolist():
                            found.setdefault((d, i), a - int(first[d]))
        if self.by_bytes:
            buffer, bound, place, start = unspaced(texts)
            whole = buffer.tobytes()
            for size, keys, table, leads in self.by_bytes:
                at = np.flatnonzero(leads[buffer])
                key = anchors(buffer, at, size)
                hit = np.isin(key, keys)
                for a, x in zip(at[hit].tolist(), key[hit].tolist()):
                    d = int(np.searchsorted(bound, a, side="right") - 1)
                    for r, i in table[x]:
                        if (d, i) not in found and whole.startswith(r, a):
                            before = texts[d][: int(place[a] - start[d])]
                            n = len(plain_words([before])[0])
                            found[d, i] = n - (n > 0 and not arrays.BLANK[before[-1]] and not PUNCTUATION[before[-1]])
        return [(d, i, n) for (d, i), n in found.items()]


def _worded(items: DataFrame) -> DataFrame:
    """``item_id, words, run, size`` per item with words; ``run`` are the bytes of a short item in a script without blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            hashes, first = plain_words(texts)
            bare = [unspaced([t])[0].tobytes()[:-1].strip(PUNCTUATION_BYTES) if n < LEAST_WORDS and UNSPACED.search(t.decode()) else None for t, n in zip(texts, np.diff(first))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), arrays.signed(hashes)), pa.array(bare, pa.binary()), pa.array([len(t.decode().strip()) for t in texts], pa.int32())],
                names=["item_id", "words", "run", "points"],
            )

    plain = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = plain.mapInArrow(run, "item_id long, words array<long>, run binary, points int").withColumn("size", F.size("words"))
    return found.where("size > 0 and points > 1").drop("points")


def _short(items: DataFrame) -> Iterator[ShortItems]:
    """All items of fewer than ``LEAST_WORDS`` words, in parts of at most about ``INDEX_WORDS`` words."""
    own = _worded(items).where(f"size < {LEAST_WORDS}").dropDuplicates(["item_id", "words", "run"])
    shards = -(-(own.agg(F.sum("size")).first()[0] or 0) // INDEX_WORDS)
    for k in range(shards):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect()
        yield ShortItems([r.item_id for r in rows], [np.array(r.words, np.int64).view(np.uint64) for r in rows], [None if r.run is None else bytes(r.run) for r in rows])


def _indexes(items: DataFrame, answer_share: float) -> Iterator[ItemIndex]:
    """Indexes over all items, each of at most about ``INDEX_WORDS`` words; term statistics are those of all items."""
    found = stored(_worded(items).where(f"size >= {LEAST_WORDS}").dropDuplicates(["item_id", "words"]))
    total = found.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    if not total.n:
        return
    shards = -(-total.words // INDEX_WORDS)
    part = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    df = found.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for k in range(shards):
        own = found.where(part == k)
        rows = own.orderBy("item_id", "size").collect()
        terms = own.select(F.explode("words").alias("term")).distinct()
        counts = {r.term: r.df for r in (df.join(terms, "term") if shards > 1 else df).collect()}
        if rows:
            yield ItemIndex([r.item_id for r in rows], [np.array(r.words, np.int64).view(np.uint64) for r in rows], counts, total.n, total.words / total.n, answer_share)


def _search(docs: DataFrame, index: ItemIndex, least: float, question: float, answer: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch, texts in arrays.slices(batches):
            hashes, first = plain_words(texts)
            count = np.diff(first)
            own = np.maximum(1, -(-count // ix.span) - 1)  # passages of two spans, one span apart
            base = np.r_[0, np.cumsum(own)]
            slot = np.minimum(np.searchsorted(ix.terms, hashes), len(ix.terms) - 1)
            known = np.flatnonzero(ix.terms[slot] == hashes)
            doc = np.repeat(np.arange(len(texts)), count)[known]
            step = (known - first[doc]) // ix.span
            head, tail = step < own[doc], step > 0
            passage = np.r_[base[doc[head]] + step[head], base[doc[tail]] + step[tail] - 1]
            term = np.r_[slot[known[head]], slot[known[tail]]]
            pairs = np.unique(passage * len(ix.terms) + term)
            hits = ix.retrieve(pairs // len(ix.terms), pairs % len(ix.terms), int(base[-1]), least)
            grams = {k: arrays.window_hashes(hashes, k) for k in range(1, GRAM + 1)}
            out: list[tuple] = []
            for p, i, s in zip(*(h.tolist() for h in hits)):
                d = int(np.searchsorted(base, p, side="right") - 1)
                a = int(first[d] + (p - base[d]) * ix.span)
                z = min(a + 2 * ix.span, int(first[d + 1]))
                q, r = (float(np.isin(g, grams[k][a : max(a, z - k + 1)]).mean()) for k, g in ix.parts[i])
                if q >= question and r >= answer:
                    out.append((d, int(ix.ids[i]), a - int(first[d]), s, q, r))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]],
                names=["doc_id", "item_id", "passage_start", "bm25", "question_overlap", "answer_overlap"],
            )

    return docs.mapInArrow(run, "doc_id long, item_id long, passage_start long, bm25 double, question_overlap double, answer_overlap double")


def _search_short(docs: DataFrame, items: ShortItems) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            d, i, n = zip(*got) if (got := shared.value.find(texts)) else [()] * 3
            one = pa.array(np.ones(len(d)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(d, pa.int64())), pa.array(i, pa.int64()), pa.array(n, pa.int64()), one, one, one],
                names=["doc_id", "item_id", "passage_start", "bm25", "question_overlap", "answer_overlap"],
            )

    return docs.mapInArrow(run, "doc_id long, item_id long, passage_start long, bm25 double, question_overlap double, answer_overlap double")


def benchmark_hits(
    docs: DataFrame, items: DataFrame, least: float = 0.6, question: float = 0.6, answer: float = 0.6, answer_share: float = 0.25
) -> DataFrame:
    """One row per document and test item that it holds: the best passage's start (in words), BM25 share and overlaps.

    Every passage of ``docs (doc_id, text)`` is a query: windows of twice the longest item's words (64 at least), half
    overlapping, so any run as long as an item lies whole in one. Items with ``least`` or more of their own BM25 score are
    checked: the shares of their question's and their answer's three-word runs that the passage holds. ``items (item_id,
    text)`` has one text per item, whose last ``answer_share`` is taken as the answer. Words are compared in lower case
    without marks at their ends. An item of fewer than five words is held where all of its words stand in a row, or all of its
    letters where its script sets no blanks (blanks are passed over then); its passage starts there and its shares are 1.
    Items of one letter or of marks alone prove nothing and are left out, as are missing ids and texts; repeated rows count as one; ties go to the first passage. Documents without a hit, without text or without an id have
    no row; other columns are ignored.
    """
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in _indexes(items, answer_share):
        one = _search(plain, index, least, question, answer)
        found = one if found is None else found.union(one)
    for part in _short(items):
        one = _search_short(plain, part)
        found = one if found is None else found.union(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, passage_start long, bm25 double, question_overlap double, answer_overlap double")
    best = F.max_by(F.struct("passage_start", "bm25", "question_overlap", "answer_overlap"), F.struct(F.col("question_overlap") + F.col("answer_overlap"), "bm25", -F.col("passage_start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; rows without ``doc_id`` or text stay."""
    hits = stored(benchmark_hits(docs, items, **options).select("doc_id").distinct())
    return docs.join(broadcast_if_small(hits, 200_000), "doc_id", "left_anti").select(*docs.columns)
