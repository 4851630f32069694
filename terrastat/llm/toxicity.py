"""Severity of toxic language by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays
from terrastat.llm.decontaminate import plain_words
from terrastat.llm.shared import stored

FEATURES = 4096
SAMPLE = 20_000
GRADES = 4
MARKERS = 64


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit features of all words, their bounds per text, and a 64-bit identity of each text's words with their counts."""
    hashes, first = plain_words(texts)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(arrays.mix(hashes), out=total[1:])
    return (hashes >> np.uint64(32)).astype(np.uint32), first, total[first[1:]] - total[first[:-1]]


def _copies(rows: DataFrame) -> DataFrame:
    """``doc_id, copy`` per row of ``rows (doc_id, text)``; rows with the same words equally often have the same ``copy``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), arrays.signed(_features(texts)[2])], names=["doc_id", "copy"])

    return rows.mapInArrow(run, "doc_id long, copy long")


def _word_lists(rows: DataFrame) -> DataFrame:
    """``doc_id, copy, words`` with the distinct features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            terms, first, copy = _features(texts)
            found = [np.unique(terms[first[d] : first[d + 1]]).view(np.int32) for d in range(len(texts))]
            at = pa.array(np.r_[0, np.cumsum([len(f) for f in found])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), arrays.signed(copy), pa.ListArray.from_arrays(at, pa.array(np.concatenate(found)))], names=["doc_id", "copy", "words"])

    return rows.mapInArrow(run, "doc_id long, copy long, words array<int>")


def _marked_words(rows: DataFrame, terms: np.ndarray, marks: np.ndarray) -> DataFrame:
    """``doc_id, copy, slots, marks``: places in ``terms`` of each text's distinct features, and how many of its words are in ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            words, first, copy = _features(texts)
            slots, times = [], np.zeros(len(texts), np.int64)
            for d in range(len(texts)):
                own, count = np.unique(words[first[d] : first[d + 1]], return_counts=True)
                slots.append(np.flatnonzero(np.isin(terms, own)))
                times[d] = count[np.isin(own, marks)].sum()
            bounds = pa.array(np.r_[0, np.cumsum([len(f) for f in slots])], pa.int32())
            cols = [batch.column("doc_id"), arrays.signed(copy), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(slots), pa.int32())), pa.array(times)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "copy", "slots", "marks"])

    return rows.mapInArrow(run, "doc_id long, copy long, slots array<int>, marks long")


class Severity:
    """Weights of word features and ordered thresholds: P(grade > j) = logistic(features . weights - threshold j)."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights, self.thresholds = terms[order], weights[order], thresholds

    def values(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sum of weights of the distinct known features of each text."""
        n = len(first) - 1
        if not len(self.terms) or not len(words):
            return np.zeros(n)
        slot = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[slot] == words)
        text = np.searchsorted(first, known, side="right") - 1
        pairs = np.unique(text * len(self.terms) + slot[known])
        return np.bincount(pairs // len(self.terms), self.weights[pairs % len(self.terms)], n)

    def above(self, values: np.ndarray) -> np.ndarray:
        """P(grade > j) for every j, in columns."""
        return 1 / (1 + np.exp(-np.clip(values[:, None] - self.thresholds, -500, 500)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, penalty: float = 0.02, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood weights and thresholds of the cumulative logit model on 0/1 features, with a small ridge.

    The thresholds are a first one and positive gaps, so they stay ordered; all parameters move together by Adam.
    """
    n = len(grades)
    w = np.zeros(n_features)
    share = np.array([max((grades > j).mean(), 0.5 / n) for j in range(n_grades - 1)])
    first = np.log((1 - share[0]) / share[0])
    cuts = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(cuts), 0.1))
    theta = np.r_[w, first, gaps]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:n_features], theta[n_features] + np.r_[0, np.cumsum(np.exp(theta[n_features + 1 :]))]
        x = np.bincount(rows, w[columns], n)
        s = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -60, 60)))
        upper = np.c_[np.ones(n), s]  # P(grade >= g)
        lower = np.c_[s, np.zeros(n)]  # P(grade > g)
        at = np.arange(n), grades
        p = np.maximum(upper[at] - lower[at], 1e-12)
        du, dl = (upper * (1 - upper))[at] / p, (lower * (1 - lower))[at] / p
        gx = -(du - dl)
        gt = np.zeros(len(t))
        np.add.at(gt, grades[grades > 0] - 1, du[grades > 0])
        np.add.at(gt, grades[grades < n_grades - 1], -dl[grades < n_grades - 1])
        gw = np.bincount(columns, gx[rows], n_features) + penalty * w
        gg = np.cumsum(gt[::-1])[::-1]
        grad = np.r_[gw, gg[0], gg[1:] * np.exp(theta[n_features + 1 :])]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.r_[0, np.cumsum(np.exp(theta[n_features + 1 :]))]


def learn_severity(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample: int = SAMPLE, grades: int = GRADES) -> Severity | None:
    """A model from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; ``None`` unless both classes occur.

    The labels say only whether a text is toxic. Grade 0 is a text that is not; toxic texts get grades from 1 by how many words
    they have of those that mark toxic texts, cut at quantiles. The ``features`` words that separate the classes best come
    from counts over all labelled rows, equal texts counted once; the regression itself is fitted on at most ``sample`` labelled
    rows, those of the lowest hashes, with up to half of them toxic. Both bounds are parameters. A feature is 32 bits of a word's
    hash. Labels meet identities of texts first, so only the features of labelled texts that count are moved, and once.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = _copies(plain).groupBy("doc_id", "copy").agg(F.count("*").alias("n")).join(marked, "doc_id")
    # one of equal texts, toxic if a label of any says so; rows that repeat both id and text share one count
    one = stored(known.groupBy("copy").agg(F.max("y").alias("y"), F.min(F.struct("doc_id", "n")).alias("of")).select("of.doc_id", "copy", "y", (1 / F.col("of.n")).alias("share")))
    size = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None
    # a merge join at every size: the labelled texts have no bound that would allow a broadcast
    terms = _word_lists(plain).join(one.hint("merge"), ["doc_id", "copy"]).select("y", "share", F.explode("words").alias("term"))
    counts = terms.groupBy("term").agg(F.round(F.sum(F.col("share") * F.col("y"))).alias("a"), F.round(F.sum(F.col("share") * (1 - F.col("y")))).alias("b")).where("a + b >= 3")
    gap = F.expr(f"ln((a + 0.5) / ({size[1]} - a + 0.5)) - ln((b + 0.5) / ({size[0]} - b + 0.5))")
    spread = F.expr(f"sqrt(1 / (a + 0.5) + 1 / ({size[1]} - a + 0.5) + 1 / (b + 0.5) + 1 / ({size[0]} - b + 0.5))")
    best = counts.select("term", gap.alias("gap"), spread.alias("spread")).where("abs(gap) > spread")
    best = best.orderBy(F.expr("spread - abs(gap)"), "term").limit(features).collect()
    terms = np.array([r.term for r in best], np.int32).view(np.uint32)
    marks = np.array([r.term for r in best if r.gap - 2 * r.spread > 2][:MARKERS], np.int32).view(np.uint32)
    drawn = [one.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for y, k in ((1, sample // 2), (0, sample - min(size[1], sample // 2)))]
    rows = stored(drawn[0].union(drawn[1]).select("doc_id", "copy", "y"))  # at most ``sample``, so broadcast
    texts = plain.join(F.broadcast(rows.select("doc_id").distinct()), "doc_id")
    cells = _marked_words(texts, terms, marks).join(F.broadcast(rows), ["doc_id", "copy"])
    got = cells.groupBy("doc_id", "copy").agg(F.first("y").alias("y"), F.first("slots").alias("slots"), F.first("marks").alias("marks")).orderBy("doc_id", "copy").collect()
    y = np.array([r.y for r in got])
    marks_of = np.array([r.marks for r in got])
    cuts = np.quantile(marks_of[y == 1], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, marks_of, side="right"), 0)
    n = np.array([len(r.slots) for r in got])
    columns = np.array([s for r in got for s in r.slots], np.int64)
    weights, thresholds = fit_ordinal(np.repeat(np.arange(len(got)), n), columns, np.minimum(grade, grades - 1), len(terms), grades)
    return Severity(terms, weights, thresholds)


def severity(docs: DataFrame, model: Severity | None, cut: float = 0.3) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` per row of ``docs (doc_id, text)``.

    ``severity`` is the expected grade, the sum of P(grade > j); ``grade`` the likeliest one (the lower of equals); ``toxic`` is
    true where P(grade > 0) is ``cut`` or more. The whole text counts; a missing or blank one has no features and is scored by the
    thresholds alone. Without a model all is 0. ``doc_id`` may be missing or repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches):
            n = len(texts)
            above = model.above(model.values(*_features(texts)[:2])) if model else np.zeros((n, 1))
            each = np.c_[np.ones(n), above] - np.c_[above, np.zeros(n)]
            cols = [pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= cut)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
