"""Quality rules whose cut-offs come from labelled holdouts with an exact binomial bound on false rejection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terrastat.llm import arrays
from terrastat.session import broadcast_if_small

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words")


def _lines(w: arrays.Words, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them equal to an earlier one."""
    n = len(w.first) - 1
    breaks = np.union1d(np.flatnonzero(w.buffer == 10), w.text_start[1:] - 1)
    starts, ends = np.r_[0, breaks[:-1] + 1], breaks
    word_at = np.searchsorted(w.starts, starts)
    full = (word_at < len(w.starts)) & (w.starts[np.minimum(word_at, len(w.starts) - 1)] < ends) if len(w.starts) else np.zeros(len(starts), bool)
    starts, ends = starts[full], ends[full]
    text = np.searchsorted(w.text_start, starts, side="right") - 1
    keys = arrays.mix(arrays.hash_ranges(w.buffer, starts, ends, 3) ^ arrays.multipliers(n, 31)[text]) if len(starts) else np.zeros(0, np.uint64)
    _, firsts = np.unique(keys, return_index=True)
    again = np.ones(len(keys), dtype=bool)
    again[firsts] = False
    return np.bincount(text, minlength=n), np.bincount(text[again], minlength=n)


def _repeated(w: arrays.Words, hashes: np.ndarray) -> np.ndarray:
    """Per text: words inside windows of eight words that occur twice or more in the text."""
    n = len(w.first) - 1
    text = np.repeat(np.arange(n), w.counts)
    windows = arrays.window_hashes(hashes, WINDOW)
    if not len(windows):
        return np.zeros(n, np.int64)
    whole = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :])
    keys = arrays.mix(windows[whole] ^ arrays.multipliers(n, 32)[text[whole]])
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int64)
    twice = whole[times[inverse] > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=n)


def text_counts(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """The columns of ``docs``, without ``text`` unless ``keep``, and the counts of ``COUNTS`` (long) per row.

    Words are runs without ASCII blanks; lines are cut at line feeds and count if they hold a word. A missing text has none of
    anything. ``docs`` must not have columns with the names of the counts.
    """
    carried = [f for f in docs.schema.fields if keep or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrays.slices(batches, text):
            w = arrays.split_words(texts)
            n = len(texts)
            owner = np.repeat(np.arange(n), w.counts)
            lead = arrays.LEADS[w.buffer]
            per_text = lambda flags: np.add.reduceat(np.r_[flags, 0].astype(np.int64), w.text_start[:-1])
            blank = arrays.BLANK[w.buffer]
            hashes = arrays.word_hashes(w, lower=False)
            plain = np.r_[0, np.cumsum((w.buffer >= 128) | np.isin(w.buffer, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)))]
            marks = plain[w.ends] == plain[w.starts]
            seen = np.unique(arrays.mix(hashes ^ arrays.multipliers(n, 33)[owner]), return_index=True)[1]
            lines, again = _lines(w, lead)
            out = {
                "n_words": w.counts,
                "word_chars": per_text(lead & ~blank),
                "n_symbols": per_text(SYMBOLS[w.buffer]),
                "n_dup_lines": again,
                "n_repeat_words": _repeated(w, hashes),
                "n_lines": lines,
                "n_upper": per_text((w.buffer >= 65) & (w.buffer <= 90)),
                "n_marks": np.bincount(owner[marks], minlength=n),
                "n_distinct_words": np.bincount(owner[seen], minlength=n),
            }
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in carried], *[pa.array(out[c].astype(np.int64)) for c in COUNTS]],
                names=[*[f.name for f in carried], *COUNTS],
            )

    return docs.mapInArrow(run, StructType([*carried, *[StructField(c, LongType()) for c in COUNTS]]))


class Measure(NamedTuple):
    """A value of which too much is bad, and the cut-offs that may be chosen, from loose to tight."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


#: Named parameters, set before any label is seen.
MEASURES = (
    Measure("symbols", "n_symbols / greatest(word_chars, 1)", (0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    Measure("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.7, 0.5, 0.4, 0.3, 0.2)),
    Measure("repeats", "n_repeat_words / greatest(n_words, 1)", (0.3, 0.2, 0.15, 0.1, 0.05)),
    Measure("long_words", "word_chars / greatest(n_words, 1)", (20.0, 15.0, 12.0, 10.0, 8.0, 7.0)),
    Measure("short_words", "-word_chars / greatest(n_words, 1)", (-2.0, -2.5, -3.0, -3.5, -4.0)),
    Measure("upper", "n_upper / greatest(word_chars, 1)", (0.7, 0.5, 0.4, 0.3, 0.2)),
    Measure("marks", "n_marks / greatest(n_words, 1)", (0.4, 0.3, 0.2, 0.1, 0.05)),
    Measure("few_words", "-n_distinct_words / greatest(n_words, 1)", (-0.03, -0.05, -0.1, -0.15, -0.2, -0.3, -0.4)),
)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exact but for rounding; summed from ``k`` down until nothing more is added."""
    if k >= n:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, i = 1.0, 1.0, k
    while i > 0:
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        i -= 1
        if term < 1e-18 * total:
            break
    return min(1.0, math.exp(top + math.log(total)))


def chosen_cutoffs(strata: list[dict], measures: tuple[Measure, ...], risk: float, error: float) -> dict[str, list[float | None]]:
    """Per stratum one cut-off per measure, or ``None`` where no cut-off can be vouched for.

    A cut-off is admitted if a false rejection rate of ``risk / len(measures)`` or more would show so few rejected good
    rows with a chance of at most ``error`` divided by all tests of all strata (Bonferroni). So with a chance of
    ``1 - error`` no stratum loses more than ``risk`` of its good rows. Of the admitted ones the cut-off that rejects most
    bad rows is taken, the loosest among equals.
    """
    each = risk / len(measures)
    tests = sum(len(m.cutoffs) for m in measures) * max(1, len(strata))
    out: dict[str, list[float | None]] = {}
    for s in strata:
        picks: list[float | None] = []
        for i, m in enumerate(measures):
            best, most = None, 0
            for j, cut in enumerate(m.cutoffs):
                k, n, bad = s[f"good_{i}_{j}"], s["good"], s[f"bad_{i}_{j}"]
                if n and k < n * each and binomial_tail(k, n, each) <= error / tests and bad > most:
                    best, most = cut, bad
            picks.append(best)
        out[s["stratum"]] = picks
    return out


MOST_STRATA = 4096


BASE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def learned_cutoffs(rows: DataFrame, labels: DataFrame, risk: float, error: float, measures: tuple[Measure, ...]) -> DataFrame:
    """``stratum, cuts``: one cut-off per measure or null, from the labelled rows of ``rows (doc_id, stratum, text)``."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = text_counts(rows).where(f"not ({BASE})").join(marked, "doc_id")
    over = {(i, j): F.expr(f"{m.value} > {cut}") for i, m in enumerate(measures) for j, cut in enumerate(m.cutoffs)}
    sums = [F.sum(((F.col("quality") == q) & hit).cast("long")).alias(f"{n}_{i}_{j}") for (i, j), hit in over.items() for q, n in ((1, "good"), (0, "bad"))]
    good = F.sum((F.col("quality") == 1).cast("long")).alias("good")
    strata = [r.asDict() for r in held.groupBy("stratum").agg(good, *sums).limit(MOST_STRATA + 1).collect()]
    if len(strata) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata: give a coarser one")
    picks = list(chosen_cutoffs(strata, measures, risk, error).items())
    return broadcast_if_small(rows.sparkSession.createDataFrame(picks, "stratum string, cuts array<double>"))


def rejected_by(measures: tuple[Measure, ...], cuts: Column) -> Column:
    """Names of the measures over their cut-offs, comma-joined."""
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(F.expr(m.value) > cuts[i], F.lit(m.name)) for i, m in enumerate(measures)])))


def stratum_of(stratum: str | Column) -> Column:
    return F.coalesce((F.col(stratum) if isinstance(stratum, str) else stratum).cast("string"), F.lit("?")).alias("stratum")


def quality_rules(
    docs: DataFrame, labels: DataFrame, stratum: str | Column = "lang", risk: float = 0.05, error: float = 0.05, measures: tuple[Measure, ...] = MEASURES
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` per row of ``docs (doc_id, text, stratum)``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated windows. ``kept`` is false for those
    and for rows over a cut-off of their stratum. Labels (``doc_id``, ``quality``) are the holdout: nothing else is fitted
    on them, and rows that fail the base rules do not count there. Strata without enough good labels, so also unseen ones
    and empty label tables, get no cut-offs: their rows stand by the base rules. A missing stratum is one of its own. A
    missing ``doc_id`` is judged like any other row. Repeated labels of one document count once, the worse one. Other
    columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stratum_of(stratum))
    cuts = learned_cutoffs(plain, labels, risk, error, measures)
    rows = text_counts(plain).withColumn("base_failed", F.expr(BASE)).join(cuts, "stratum", "left").withColumn("rejected_by", rejected_by(measures, F.col("cuts")))
    kept = (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "rejected_by")


def passing(
    docs: DataFrame, labels: DataFrame, stratum: str | Column = "lang", risk: float = 0.05, error: float = 0.05, measures: tuple[Measure, ...] = MEASURES
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, judged where they are read."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stratum_of(stratum))
    cuts = learned_cutoffs(plain, labels, risk, error, measures)
    inner = [f"column_{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(c).alias(i) for c, i in zip(docs.columns, inner)], stratum_of(stratum))
    rows = text_counts(named, inner[docs.columns.index("text")], keep=True).where(f"not ({BASE})").join(cuts, "stratum", "left").where(rejected_by(measures, F.col("cuts")) == "")
    return rows.select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner)])
