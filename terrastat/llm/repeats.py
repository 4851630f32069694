"""Removal of long byte strings that occur twice: buckets of suffixes around shared anchors, sorted block by block with cover-sample ranks.

A window of ``length`` bytes has an anchor: the place of its smallest short-gram hash. Equal windows have equal anchors, so only
suffixes that begin at the same distance before equal anchors can agree. Runs of windows with one anchor are the rows; runs
whose anchor occurs once are done after one count, equal runs after one more, and the rest goes to the sorter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays
from terrastat.llm.shared import stored

LENGTH = 400
GRAM = 32
#: Period of the cover sample; the ranks reach over LENGTH - PERIOD bytes.
PERIOD = 16
#: Bytes of context sorted at once, and contexts of one anchor that one task may hold; larger buckets are cut narrower.
BLOCK_BYTES = 1_000_000
MOST_CONTEXTS = 256
WIDTHS = (64, 8, 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        factors = np.full(max(n, 1 << 20), base, np.uint64)
        factors[0] = 1
        _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers[name][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` bytes, from running sums of a polynomial modulo 2**64. Only proposes, never decides."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("on", _STEP, len(data)), out=run[1:])
    return arrays.mix((run[k:] - run[:-k]) * _power("back", _BACK, len(data) - k + 1))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` consecutive values, in a fixed number of passes."""
    n = len(x) - w + 1
    filled = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    filled[: len(x)] = x
    rows = filled.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def digest(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def anchor_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, key, first window start, anchor minus start, windows) of each run of windows with one anchor."""
    data, at = arrays.joined(texts, b"\0")
    hashes = gram_hashes(data, gram)
    w = length - gram + 1
    if len(hashes) < w:
        return (np.zeros(0, np.int64),) * 5
    mask = np.uint64((1 << 30) - 1)
    low = sliding_minimum((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), w)
    size = np.diff(at) - 1
    windows = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + at[:-1][text]
    anchor = (low[start] & mask).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.zeros(0, np.int64)
    n = np.diff(np.r_[begin, len(text)])
    lo, who = start[begin], text[begin]
    return who, hashes[anchor[begin]].view(np.int64), lo - at[who], anchor[begin] - lo, n


def runs_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            who, key, lo, off, n = anchor_runs(texts, length, gram)
            same = [digest(texts[d][a : a + m + length - 1], b"%d" % o) for d, a, o, m in zip(who.tolist(), lo.tolist(), off.tolist(), n.tolist())]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            cols = [pa.array(x, k) for x, k in zip((key, np.array(same, np.int64), lo, off, n), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(who)), *cols], names=["row", "key", "same", "lo", "off", "n"])

    return docs.select("row", "text").mapInArrow(run, "row long, key long, same long, lo int, off int, n int")


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their columns, first column first."""
    out = np.unique(columns[0], return_inverse=True)[1].astype(np.uint64)
    for c in columns[1:]:
        values, inverse = np.unique(c, return_inverse=True)
        out = np.unique(out * np.uint64(len(values)) + inverse.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return out


def sorted_repeats(bodies: list[bytes], group: np.ndarray, off: np.ndarray, n: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its ``n`` windows of ``length`` bytes another context of its ``group`` has at the same
    distance from the anchor.

    Contexts are laid out with their anchors at multiples of ``PERIOD``. Suffixes of one bucket (group, distance) then differ
    by 0 modulo the period, and the multiples of the period are the cover for that. Their ranks over ``length - PERIOD`` bytes
    are made once by doubling; a bucket is ordered by the rank at the next cover position, the up to ``PERIOD`` bytes before
    and behind it decide the ties that are left. No suffix is ever read to its full length.
    """
    pad = (-off) % PERIOD
    size = np.array([len(b) for b in bodies])
    room = -(-(pad + size) // PERIOD) * PERIOD + PERIOD
    base = np.r_[0, np.cumsum(room)[:-1]]
    text = np.zeros(int(room.sum()) + length + 2 * PERIOD, np.uint8)
    text = text[: len(text) // PERIOD * PERIOD]
    for b, x in zip(bodies, (base + pad).tolist()):
        text[x : x + len(b)] = np.frombuffer(b, np.uint8)
    blocks = text.view(">u8").reshape(-1, PERIOD // 8)
    by_size = {1: ranks(*(blocks[:, j].astype(np.uint64) for j in range(PERIOD // 8)))}

    def joined(one: int, two: int) -> np.ndarray:
        ahead = np.zeros(len(blocks), np.uint64)
        ahead[: len(blocks) - one] = by_size[two][one:]
        return ranks(by_size[one], ahead)

    need, have, step = (length - PERIOD) // PERIOD, 0, 1
    rank = None
    while step <= need:  # the binary digits of the reach, long ones first in the end
        if step > 1:
            by_size[step] = joined(step // 2, step // 2)
        step *= 2
    for part in sorted(by_size, reverse=True):
        if need & part:
            if rank is None:
                rank, have = by_size[part], part
            else:
                ahead = np.zeros(len(blocks), np.uint64)
                ahead[: len(blocks) - have] = by_size[part][have:]
                rank, have = ranks(rank, ahead), have + part
    owner = np.repeat(np.arange(len(bodies)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    x = (base + pad)[owner] + k
    bucket = group[owner] * (length + 1) + (off[owner] - k) % (length + 1)
    cover = -(-x // PERIOD)
    key = bucket.astype(np.uint64) * np.uint64(len(blocks)) + rank[cover]
    values, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    tied = np.flatnonzero(times[inverse] > 1)
    hit = np.zeros(len(x), bool)
    if len(tied):
        head = cover[tied] * PERIOD - x[tied]
        c = np.arange(PERIOD)
        rest = text[x[tied][:, None] + np.where(c < head[:, None], c, length - PERIOD + c)]
        words = np.ascontiguousarray(rest).view(">u8")
        same = ranks(inverse[tied], *(words[:, j].astype(np.uint64) for j in range(PERIOD // 8)))
        hit[tied] = np.bincount(same.astype(np.int64))[same.astype(np.int64)] > 1
    return np.split(hit, np.cumsum(n)[:-1])


SPANS = "row long, lo int, hi int"
CONTEXT = "key long, row long, lo int, off int, n int, many boolean, body binary"


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], names=["row", "lo", "hi"])


def sort_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of the contexts, whose buckets are small; a task sorts a bounded block of buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            keys, lo, off, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3, 4))
            group = np.unique(keys, return_inverse=True)[1]
            out = []
            for r, hits in zip(rows, sorted_repeats([r[6] for r in rows], group, off, n, length)):
                if not r[5] and hits.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, hits.astype(np.int8), 0]))
                    out += [(r[1], r[2] + int(a), r[2] + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]
            return _spans(out)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "lo", "off", "n", "many", "body"))):
                if size > BLOCK_BYTES and held[-1][0] != r[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield flush(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def narrower(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts cut at multiples of ``width`` windows from the anchor; the bytes that all windows of a cut share join its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, row, lo, off, n, many, body in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "lo", "off", "n", "many", "body"))):
                for c in range(-off // width, (n - 1 - off) // width + 1):
                    a, z = max(0, c * width + off), min(n, (c + 1) * width + off)
                    own = body[a : z - 1 + length]
                    shared = body[(c + 1) * width + off - 1 : c * width + off + length]
                    out.append((digest(b"%d %d " % (key, c), shared), digest(own, b"%d" % (off - a)), row, lo + a, off - a, z - a, many, own))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "same", "row", "lo", "off", "n", "many", "body"])

    return contexts.mapInArrow(run, CONTEXT.replace("row long", "same long, row long"))


def finished(rows: DataFrame) -> DataFrame:
    """Digest rows: bytes, removed bytes, maximal removed runs and the hash of what is left of ``text`` without ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            left = [without(t, s) for t, s in zip(texts, batch.column("spans").to_pylist())]
            sha, gone, count = zip(*left) if left else ((), (), ())
            numbers = [pa.array(c, pa.int64()) for c in ([len(t) for t in texts], gone, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs (doc_id, text)``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or another; strings are
    judged on the texts as given and never cross texts. Missing texts count as empty; texts shorter than ``length`` keep
    everything. ``doc_id`` may be missing or repeated: rows are told apart by a number stored with their text in the shared folder,
    so ``docs`` is read once and may come out in any order. Other columns are ignored; an empty table gives no rows.

    ``length`` must be a multiple of ``PERIOD``.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = stored(plain.withColumn("row", F.monotonically_increasing_id()))
    runs = stored(runs_of(plain, length, gram))
    one = F.min(F.struct("row", "lo", "off", "n")).alias("first")
    kinds = runs.groupBy("key", "same").agg(F.count("*").alias("times"), one)
    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("times").alias("all"), F.min("times").alias("least")).where("all > 1").drop("all")
    kinds = stored(kinds.join(keys, "key"))
    whole = runs.join(kinds.where("times > 1").select("key", "same"), ["key", "same"]).select("row", F.struct("lo", (F.col("lo") + F.col("n") + length - 1).alias("hi")).alias("span"))
    mixed = kinds.where("kinds > 1 and least = 1").select("first.row", F.struct("key", "first.lo", "first.off", "first.n", (F.col("times") > 1).alias("many")).alias("ask"))
    known = whole.groupBy("row").agg(F.collect_list("span").alias("spans"))
    asked = mixed.groupBy("row").agg(F.collect_list("ask").alias("asked"))
    both = plain.join(known.join(asked, "row", "full"), "row", "left")

    # one pass over the texts: rows without open questions are finished, the others are kept with their questions
    form = "row long, doc_id long, text string, spans array<struct<lo:int,hi:int>>, asked array<struct<key:long,lo:int,off:int,n:int,many:boolean>>"
    table = stored(_finish_or_keep(both.select("row", "doc_id", "text", "spans", "asked"), form))
    open_rows = table.where("kept_sha256 is null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            out = []
            for row, text, questions in zip(batch.column("row").to_pylist(), texts, batch.column("asked").to_pylist()):
                out += [(q["key"], row, q["lo"], q["off"], q["n"], q["many"], text[q["lo"] : q["lo"] + q["n"] + length - 1]) for q in questions]
            cols = list(zip(*out)) if out else [()] * 7
            form = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, form)], names=["key", "row", "lo", "off", "n", "many", "body"])

    contexts = open_rows.select("row", "text", "asked").mapInArrow(cut, CONTEXT)
    found = []
    large = kinds.where(f"kinds > {MOST_CONTEXTS} and least = 1").select("key").distinct()
    if large.isEmpty():
        found.append(sort_buckets(contexts, length))
    else:
        large = stored(large)
        found.append(sort_buckets(contexts.join(large, "key", "left_anti"), length))
        rest = contexts.join(large, "key", "left_semi")
        for width in WIDTHS:
            cuts = stored(narrower(rest, width, length))
            times = cuts.groupBy("key", "same").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("times"))
            per_key = times.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("times").alias("all"), F.min("times").alias("least")).where("all > 1").drop("all")
            times = stored(times.join(per_key, "key"))
            marked = cuts.join(times, ["key", "same"])
            found.append(marked.where("times > 1 and not many").select("row", "lo", (F.col("lo") + F.col("n") + length - 1).alias("hi")))
            if width == 1:
                break
            single = marked.where("kinds > 1 and least = 1").withColumn("many", F.col("times") > 1).groupBy("key", "same")
            single = single.agg(F.min(F.struct("row", "lo", "off", "n", "many", "body")).alias("x"), F.first("kinds").alias("kinds")).select("key", "x.*", "kinds")
            single = stored(single)
            found.append(sort_buckets(single.where(f"kinds <= {MOST_CONTEXTS}").drop("kinds"), length))
            rest = single.where(f"kinds > {MOST_CONTEXTS}").drop("kinds")
            if rest.isEmpty():
                break
    more = found[0]
    for f in found[1:]:
        more = more.unionByName(f)
    more = more.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    rows = open_rows.select("row", "doc_id", "text", "spans").join(more, "row", "left")
    empty = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")
    last = finished(rows.withColumn("spans", F.concat(F.coalesce("spans", empty), F.coalesce("more", empty))))
    return table.where("kept_sha256 is not null").select(last.columns).unionByName(last)


def _finish_or_keep(both: DataFrame, form: str) -> DataFrame:
    done = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            spans, asked = batch.column("spans").to_pylist(), batch.column("asked")
            closed = np.array([not a for a in asked.to_pylist()])
            out = {c: [None] * len(texts) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for i in np.flatnonzero(closed):
                kept, removed, count = without(texts[i], spans[i])
                out["n_bytes"][i], out["n_removed"][i], out["n_spans"][i], out["kept_sha256"][i] = len(texts[i]), removed, count, kept
            text = pa.array([None if c else t for c, t in zip(closed, texts)], pa.binary()).cast(pa.string())
            cols = [batch.column("row"), batch.column("doc_id"), text, batch.column("spans"), asked]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string())], names=["row", "doc_id", "text", "spans", "asked", *out])

    return both.mapInArrow(run, f"{form}, {done}")


def without(text: bytes, spans: list[dict] | None) -> tuple[str, int, int]:
    """Hash of ``text`` without its spans, bytes removed, maximal removed runs."""
    h, at, removed, runs = hashlib.sha256(), 0, 0, 0
    reached = -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if lo > reached:
            runs += 1
            h.update(text[at:lo])
            removed += hi - lo
        else:
            removed += max(0, hi - reached)
        reached = at = max(reached, hi)
    h.update(text[at:])
    return h.hexdigest(), removed, runs
