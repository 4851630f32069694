"""Language by hyperdimensional profiles: permuted random letter vectors bound into trigram vectors, bundled, compared by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays

DIMENSIONS = 1024
MOST_LANGUAGES = 4096
GROUP = 256


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """A random vector of +1 and -1 per code point, the same in every process."""
    seeds = arrays.mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + arrays.multipliers(dimensions // 64, 41))
    bits = np.unpackbits(seeds.view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def document_vectors(texts: list[bytes], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of the trigram vectors of each text, weighted by the root of how often each occurs, and the letters per text.

    Letters are lower-case; anything else is one blank between words. A trigram ``abc`` is ``p(p(a)) * p(b) * c``, where ``p``
    shifts a vector by one place.
    """
    n = len(texts)
    pieces = [np.frombuffer((" " + t.decode("utf-8", "replace").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) for p in pieces])
    points = np.concatenate(pieces)
    owner = np.repeat(np.arange(n), size)
    points = np.where(letters()[points], points, 0)
    keep = np.r_[True, (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])]  # one blank between words, and at both ends of a text
    points, owner = points[keep], owner[keep]
    seen = np.bincount(owner[points != 0], minlength=n)
    alphabet, code = np.unique(points, return_inverse=True)
    vectors = letter_vectors(alphabet, dimensions)
    k = len(alphabet)
    whole = (owner[2:] == owner[:-2]) & (points[1:-1] != 0)
    grams = ((code[:-2] * k + code[1:-1]) * k + code[2:])[whole]
    distinct, gram = np.unique(grams, return_inverse=True)
    bound = np.roll(vectors, 2, axis=1)[distinct // (k * k)] * np.roll(vectors, 1, axis=1)[distinct // k % k] * vectors[distinct % k]
    bound = bound.astype(np.float32)
    who = owner[1:-1][whole]
    out = np.zeros((n, dimensions), np.float32)
    for a in range(0, n, GROUP):
        lo, hi = np.searchsorted(who, [a, a + GROUP])
        rows = min(GROUP, n - a)
        times = np.bincount((who[lo:hi] - a) * len(distinct) + gram[lo:hi], minlength=rows * len(distinct)).reshape(rows, len(distinct))
        out[a : a + rows] = np.sqrt(times, dtype=np.float32) @ bound
    return out, seen


def prototypes(rows: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages of ``rows (text, lang)`` and the unit bundle of their documents, each document with the same weight.

    Tasks bundle their own rows by language first, so what is shuffled is one vector per task and language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch, texts in arrays.slices(batches):
            v, seen = document_vectors(texts, dimensions)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in set(langs[seen > 0]):
                total[name] = total.get(name, 0) + v[(langs == name) & (seen > 0)].sum(axis=0, dtype=np.float64)
        names = sorted(total)
        flat = np.stack([total[x] for x in names]) if names else np.zeros((0, dimensions))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), arrays.lists(flat, pa.float64())], names=["lang", "v"])

    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sums.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [r.lang for r in found]
    table = np.array([[e.x for e in r.v] for r in found]).reshape(len(names), dimensions)
    if len(names):
        table /= np.linalg.norm(table, axis=1, keepdims=True)
    return names, table


def identify(docs: DataFrame, learn: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs (doc_id, text, lang)``, learned from its rows where ``learn`` holds.

    Documents and prototypes are compared after the mean prototype is taken off both; ``score`` is the cosine to the chosen
    prototype itself, 0 at least. Ties go to the first name. A missing text or one without a letter is ``und`` with 0, and so
    is everything if nothing can be learned. Rows without ``lang`` teach nothing; other columns are ignored.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names, table = prototypes(docs.where(learn & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), dimensions)
    middle = table.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    axes = table - middle
    axes /= np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            v, seen = document_vectors(texts, dimensions)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            pred, score = np.array(["und"] * len(texts), dtype=object), np.zeros(len(texts))
            if names:
                best = ((v - middle) @ axes.T).argmax(axis=1)
                pred = np.where(seen > 0, np.array(names, dtype=object)[best], "und")
                score = np.where(seen > 0, np.clip((v * table[best]).sum(axis=1), 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return plain.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double")
