"""Text quality by a byte-level convolutional network: learned filters, overlapping chunks over the whole text, max pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays

BLOCK = 32
CHANNELS = 16
HIDDEN = 32
WIDTH = 3
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 32_000_000
EPOCHS = 8


class ByteNet:
    """Filters over ``WIDTH`` bytes, averaged over chunks of two blocks that overlap by one, a layer on each chunk, the largest
    value of each unit over all chunks, one probability."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "filters": r.normal(0, 0.5, (WIDTH, 256, CHANNELS)),
            "bias": np.zeros(CHANNELS),
            "mix": r.normal(0, 2.0 / np.sqrt(CHANNELS), (CHANNELS, HIDDEN)),
            "shift": r.normal(0, 0.1, HIDDEN),
            "out": r.normal(0, 0.1, HIDDEN),
            "last": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes with every text filled up by zeros to whole blocks (two at least), and the first block of each (with the end)."""
        blocks = np.array([max(2, -(-(len(t) + WIDTH - 1) // BLOCK)) for t in texts])
        data = b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, blocks)) + b"\0" * (WIDTH - 1)
        return np.frombuffer(data, np.uint8), np.r_[0, np.cumsum(blocks)]

    @staticmethod
    def _ahead(data: np.ndarray, first: np.ndarray, j: int) -> np.ndarray:
        """The byte ``j`` places on; behind the end of a text stand zeros, not the next text."""
        out = data[j : len(data) - WIDTH + 1 + j]
        if j:
            out = out.copy()
            for k in range(1, j + 1):
                out[first[1:] * BLOCK - k] = 0
        return out

    def _conv(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = self.p["filters"][0][self._ahead(data, first, 0)]
        for j in range(1, WIDTH):
            x += self.p["filters"][j][self._ahead(data, first, j)]
        x += self.p["bias"]
        return np.maximum(x, 0, out=x)

    def forward(self, data: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        active = self._conv(data, first)
        blocks = active.reshape(-1, BLOCK, CHANNELS).sum(axis=1)
        whole = np.ones(len(blocks), bool)
        whole[first[1:] - 1] = False
        at = np.flatnonzero(whole)  # a chunk begins at every block but a text's last
        chunks = (blocks[at] + blocks[at + 1]) / (2 * BLOCK)
        hidden = np.maximum(chunks @ self.p["mix"] + self.p["shift"], 0)
        bounds = first[:-1] - np.arange(len(first) - 1)
        pooled = np.maximum.reduceat(hidden, bounds, axis=0)
        return {"active": active, "at": at, "chunks": chunks, "hidden": hidden, "bounds": bounds, "pooled": pooled, "logit": pooled @ self.p["out"] + self.p["last"]}

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        data, first = self.laid_out(texts)
        f = self.forward(data, first)
        n = len(texts)
        d = (1 / (1 + np.exp(-f["logit"])) - y) * weight / weight.sum()
        g = {"last": np.array([d.sum()]), "out": f["pooled"].T @ d}
        back = d[:, None] * self.p["out"]
        doc = np.repeat(np.arange(n), np.diff(np.r_[f["bounds"], len(f["hidden"])]))
        row, unit = np.nonzero((f["hidden"] == f["pooled"][doc]) & (f["hidden"] > 0))
        _, one = np.unique(doc[row] * HIDDEN + unit, return_index=True)  # the first of equals
        row, unit = row[one], unit[one]
        rows, slot = np.unique(row, return_inverse=True)
        local = np.zeros((len(rows), HIDDEN), np.float32)
        local[slot, unit] = back[doc[row], unit]
        g["mix"], g["shift"] = f["chunks"][rows].T @ local, local.sum(axis=0)
        to_chunk = local @ self.p["mix"].T / (2 * BLOCK)
        to_block = np.zeros((len(f["active"]) // BLOCK, CHANNELS), np.float32)
        np.add.at(to_block, f["at"][rows], to_chunk)
        np.add.at(to_block, f["at"][rows] + 1, to_chunk)
        touched = np.flatnonzero(np.any(to_block != 0, axis=1))
        where = (touched[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        to_byte = np.repeat(to_block[touched], BLOCK, axis=0) * (f["active"][where] > 0)
        g["bias"] = to_byte.sum(axis=0)
        g["filters"] = np.zeros((WIDTH, 256, CHANNELS))
        for j in range(WIDTH):
            cell = self._ahead(data, first, j)[where].astype(np.int64)[:, None] * CHANNELS + np.arange(CHANNELS)
            g["filters"][j] = np.bincount(cell.ravel(), to_byte.ravel(), 256 * CHANNELS).reshape(256, CHANNELS)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 48, rate: float = 0.01, seed: int = 3) -> "ByteNet":
        """Adam on cross entropy, both classes with the same total weight."""
        r = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        m, v, step = ({k: np.zeros(x.shape) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(texts), batch):
                own = order[a : a + batch]
                g = self.gradients([texts[i] for i in own], y[own], weight[own])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, x in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    x -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(*self.laid_out(texts))["logit"].astype(np.float64), -60, 60)))


def learn_quality(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, epochs: int = EPOCHS) -> ByteNet | None:
    """A network from the texts of ``docs`` where ``learn`` holds and ``labels.quality`` is known; ``None`` without both classes.

    At most ``rows`` labelled rows are drawn, those of the lowest id hashes and up to half of each class, with whole texts of
    ``size`` bytes together, passing over those that do not fit; both bounds are parameters. Labels that repeat an id count once, the worse one.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    plain = docs.where(learn).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = plain.select("doc_id").join(marked, "doc_id")
    drawn = [ids.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for k in (0, 1)]
    held = plain.join(drawn[0].union(drawn[1]).dropDuplicates(["doc_id"]), "doc_id").withColumn("bytes", F.octet_length("text"))
    small = held.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).toPandas().assign(order=lambda t: t.doc_id.map(lambda i: arrays.mix(np.array([i], np.int64).view(np.uint64))[0]))
    taken, total = [], 0
    for i, n in small.sort_values(["order", "doc_id"])[["doc_id", "bytes"]].itertuples(index=False):
        if total + n <= size:  # what does not fit is passed over
            taken.append((int(i),))
            total += int(n)
    if not taken:
        return None
    got = held.join(docs.sparkSession.createDataFrame(taken, "doc_id long"), "doc_id").select("doc_id", "text", "y").orderBy("doc_id", "text").collect()
    y = np.array([r.y for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return ByteNet().fit([r.text.encode() for r in got], y, epochs)


def quality_scores(docs: DataFrame, model: ByteNet | None, cut: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` per row of ``docs (doc_id, text)``; ``predicted`` is 1 where the score is ``cut`` or more.

    Only the bytes of the text enter the score; a missing text counts as empty, which is one chunk of zeros. Without a model
    every score is 0.5. ``doc_id`` may be missing or repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches, limit=400_000):
            score = model.scores(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double, predicted int")
