"""What learned operators return, worked out again by loops over letters, words and chunks."""

import math
import random

import numpy as np
from fixtures_llm import awkward, awkward_texts, words
from pyspark.sql import functions as F

from terrastat.llm import quality
from terrastat.llm.decontaminate import benchmark_hits, plain_words
from terrastat.llm.langid import identify, letter_vectors, prototypes
from terrastat.llm.quality import ByteNet, quality_scores
from terrastat.llm.toxicity import Severity, severity


def plain_bundle(text, dimensions):
    """Trigram vectors of one text, bound and bundled letter by letter; None without a letter."""
    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not kept.strip():
        return None
    padded = " " + " ".join(kept.split()) + " "
    vector = {c: letter_vectors(np.array([0 if c == " " else ord(c)]), dimensions)[0].astype(int) for c in set(padded)}
    times = {}
    for i in range(1, len(padded) - 1):
        if padded[i] != " ":
            times[padded[i - 1 : i + 2]] = times.get(padded[i - 1 : i + 2], 0) + 1
    total = np.zeros(dimensions)
    for (a, b, c), n in times.items():
        bound = np.array([vector[a][d - 2] * vector[b][d - 1] * vector[c][d] for d in range(dimensions)])
        total += math.sqrt(n) * bound
    return total / np.linalg.norm(total)


def test_languages_equal_plain_binding_and_cosine(spark):
    texts = [t for t in awkward_texts() if t is None or len(t) < 5000]
    rows = [(i, t, ["en", "de", "fr"][i % 3]) for i, t in enumerate(texts)] + [(100 + i, " ".join(words(20, i, 60)), ["en", "de"][i % 2]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for _, t, lang in rows:
        v = plain_bundle(t, 64)
        if v is not None:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    table = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    middle = table.mean(axis=0)
    axes = [(t - middle) / np.linalg.norm(t - middle) for t in table]
    got = {r.doc_id: r for r in identify(docs, F.lit(True), 64).collect()}
    for i, t, _ in rows:
        v = plain_bundle(t, 64)
        if v is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        near = [float((v - middle) @ a) for a in axes]
        best = near.index(max(near))
        if sorted(near)[-1] - sorted(near)[-2] > 1e-5:
            assert got[i].lang_pred == names[best]
            assert abs(got[i].score - max(0.0, float(v @ table[best]))) < 1e-5


def test_equal_languages_go_to_the_first_name(spark):
    rows = [(i, "the same words", lang) for i, lang in enumerate(["b", "a", "c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert prototypes(docs.select("text", "lang"), 64)[0] == ["a", "b", "c"]
    assert {r.lang_pred for r in identify(docs, F.lit(True), 64).collect()} == {"a"}


def test_quality_equals_a_plain_loop_over_filters_chunks_and_maxima(spark):
    net = ByteNet(seed=4)
    r = np.random.default_rng(6)
    net.p = {k: v + r.normal(0, 0.3, v.shape).astype(np.float32) for k, v in net.p.items()}
    p = {k: v.astype(float) for k, v in net.p.items()}
    texts = [t for t in awkward_texts() if t is None or len(t) < 800]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {q.doc_id: q for q in quality_scores(docs, net).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        blocks = max(2, -(-(len(data) + quality.WIDTH - 1) // quality.BLOCK))
        data = data + b"\0" * (blocks * quality.BLOCK + quality.WIDTH - 1 - len(data))
        active = [np.maximum(sum(p["filters"][j][data[a + j]] for j in range(quality.WIDTH)) + p["bias"], 0) for a in range(blocks * quality.BLOCK)]
        best = np.full(quality.HIDDEN, -np.inf)
        for b in range(blocks - 1):
            chunk = sum(active[b * quality.BLOCK : (b + 2) * quality.BLOCK]) / (2 * quality.BLOCK)
            best = np.maximum(best, np.maximum(chunk @ p["mix"] + p["shift"], 0))
        score = 1 / (1 + math.exp(-float(best @ p["out"] + p["last"][0])))
        assert abs(got[i].score - score) < 1e-4 and got[i].predicted == (got[i].score >= 0.3)


def test_severity_equals_a_dictionary_of_words(spark):
    vocabulary = [f"bad{i}" for i in range(6)]
    hashes = plain_words([w.encode() for w in vocabulary])[0]
    terms = (hashes >> np.uint64(32)).astype(np.uint32)
    weights, thresholds = np.array([2.0, 1.0, -1.0, 0.5, 0.0, 3.0]), np.array([0.5, 1.5, 4.0])
    model, table = Severity(terms, weights, thresholds), dict(zip(vocabulary, weights))
    r = random.Random(3)
    texts = [None, "", "Bad0, bad0 BAD1!", *[" ".join(r.choice([*vocabulary, "x", "y."]) for _ in range(r.randint(1, 9))) for _ in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for q in severity(docs, model).collect():
        own = {w.strip(".,!").lower() for w in (texts[q.doc_id] or "").split()}
        x = sum(table.get(w, 0.0) for w in own)
        above = [1 / (1 + math.exp(-(x - t))) for t in thresholds]
        each = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert abs(q.severity - sum(above)) < 1e-9 and q.grade == each.index(max(each))
        assert abs(q.p_toxic - above[0]) < 1e-9 and q.toxic == (above[0] >= 0.3)


def test_equally_likely_grades_give_the_lower(spark):
    docs = spark.createDataFrame([(1, "nothing known")], "doc_id long, text string")
    equal = Severity(np.zeros(0, np.uint32), np.zeros(0), np.array([0.0]))
    assert [(q.grade, q.p_toxic) for q in severity(docs, equal).collect()] == [(0, 0.5)]


def test_repeated_items_change_nothing(spark):
    items = [(i, " ".join(words(20 + i % 7, i, 300))) for i in range(30)]
    docs = []
    for i, t in items:
        own = t.split()
        own[i % len(own)] = "changed"
        docs.append((i, " ".join([*words(40, 500 + i, 300), *own, *words(30, 700 + i, 300)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = spark.createDataFrame(items, "item_id long, text string")
    many = one.union(one.where("item_id % 2 = 0")).union(one.where("item_id = 3")).repartition(3)
    got, more = (sorted(map(tuple, benchmark_hits(d, x).collect())) for x in (one, many))
    assert got == more and len(got) >= 25
    assert benchmark_hits(awkward(spark), many).count() == 0
