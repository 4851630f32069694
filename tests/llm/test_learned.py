"""Held-out accuracy, gradients and exact sums of the trained operators, and brute-force search of test items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import awkward, crc, empty, given, have_given, words
from pyspark.sql import functions as F

from terrastat.llm import arrays, recurrent
from terrastat.llm.decontaminate import ItemIndex, benchmark_hits, plain_words
from terrastat.llm.langid import identify
from terrastat.llm.quality import ByteNet, learn_quality, quality_scores
from terrastat.llm.recurrent import Network, Spelling, language_scores
from terrastat.llm.toxicity import fit_ordinal, learn_severity, severity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# decontamination


def test_every_planted_item_is_found_and_nothing_else(spark):
    if not have_given():
        pytest.skip("no tables")
    docs, items = given(spark), given(spark, "benchmark")
    got = {(r.doc_id, r.item_id) for r in benchmark_hits(docs, items).collect()}
    texts = [(r.item_id, r.text) for r in items.collect()]
    assert got == {(d.doc_id, i) for d in docs.collect() for i, t in texts if t in d.text}


def test_retrieval_equals_scoring_everything():
    r = random.Random(4)
    items = [np.array([r.randrange(60) for _ in range(r.randint(5, 40))], np.uint64) for _ in range(150)]
    df = Counter(int(t) for w in items for t in set(w.tolist()))
    index = ItemIndex(list(range(150)), items, df, 150, 20.0, 0.25)
    pairs = sorted({(p, t) for p in range(80) for t in [r.randrange(len(index.terms)) for _ in range(r.randint(0, 45))]})
    passage, term = np.array([p for p, _ in pairs]), np.array([t for _, t in pairs])
    table = np.zeros((len(index.terms), 150))
    for t in range(len(index.terms)):
        at = slice(index.begin[t], index.begin[t + 1])
        table[t, index.item[at]] = index.impact[at]
    full = np.zeros((80, 150))
    np.add.at(full, passage, table[term])
    for least in (0.3, 0.6):
        p, i, s = index.retrieve(passage, term, 80, least)
        assert sorted(zip(p.tolist(), i.tolist())) == [tuple(x) for x in np.argwhere(full >= least - 1e-9).tolist()]
        assert np.allclose(s, full[p, i])


def test_awkward_items_and_documents(spark):
    items = spark.createDataFrame([(1, " ".join(words(40, 77))), (2, None), (None, "a b c d e f g"), (3, "x"), (1, " ".join(words(40, 77)))], "item_id long, text string")
    body = " ".join(words(9000, 78, 4000))
    marked = body[:20000] + " " + ", ".join(words(40, 77)).replace("a", "A") + ". " + body[20000:]
    docs = spark.createDataFrame([(1, marked), (2, body), (3, None), (None, marked), (4, "")], "doc_id long, text string")
    got = benchmark_hits(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].question_overlap == 1
    assert benchmark_hits(awkward(spark), items).count() == 0 and benchmark_hits(docs, items.limit(0)).count() == 0
    assert benchmark_hits(empty(spark), items).count() == 0


def test_words_lose_marks_at_their_ends_only():
    a, first = plain_words([b'The (cat\'s) "hat," -- THE', "é! É".encode(), b"..."])
    b, _ = plain_words([b"the cat's hat the"])
    assert np.diff(first).tolist() == [4, 2, 0] and a[:4].tolist() == b.tolist()


# language


def test_languages_of_held_out_documents(spark):
    if not have_given():
        pytest.skip("no tables")
    docs = given(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = {r.doc_id: r for r in identify(docs, ~held).collect()}
    rows = [r for r in docs.collect() if crc(r.doc_id) % 3 == 1]
    assert len(rows) > 30 and sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_letters_no_language(spark):
    got = {r.doc_id: r for r in identify(awkward(spark), F.lit(True)).where("doc_id is not null").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[7].lang_pred in ("en", "de")
    assert {r.lang_pred for r in identify(awkward(spark), F.lit(False)).collect()} == {"und"}
    assert identify(empty(spark), F.lit(True)).count() == 0


# quality


def test_quality_gradients():
    r = random.Random(3)
    texts = [bytes(r.choice(b"abc #") for _ in range(n)) for n in (0, 1, 40, 200)]
    y, weight = np.array([1, 0, 1, 0]), np.ones(4)
    net = ByteNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.forward(*net.laid_out(texts))["logit"]
        return float((np.log1p(np.exp(z)) - y * z).mean())

    g = net.gradients(texts, y, weight)
    for name, at in (("last", (0,)), ("out", (3,)), ("mix", (2, 5)), ("shift", (7,)), ("filters", (1, 97, 4)), ("bias", (6,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_quality_of_held_out_documents(spark):
    good = [(i, " ".join(words(60, i, 500)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "###" for w in words(60, i, 500)), 0) for i in range(60)]
    docs = spark.createDataFrame(good + bad + [(None, None, 1), (5000, "", None)], "doc_id long, text string, quality int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = learn_quality(docs, docs.select("doc_id", "quality"), ~held, epochs=40)
    got = {r.doc_id: r for r in quality_scores(docs, model).collect()}
    assert len(got) == 212 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    out = [(d, y) for d, _, y in good + bad if crc(d) % 5 == 0]
    assert sum(got[d].predicted == y for d, y in out) >= 0.9 * len(out)
    assert learn_quality(docs, docs.where("quality = 1").select("doc_id", "quality"), ~held) is None
    assert {r.score for r in quality_scores(awkward(spark), None).collect()} == {0.5}
    assert quality_scores(empty(spark), model).count() == 0 and quality_scores(awkward(spark), model).count() == awkward(spark).count()


# toxicity


def test_ordinal_fit_finds_known_weights():
    r = np.random.default_rng(1)
    x = r.random((6000, 3)) < 0.5
    z = x @ np.array([2.0, -1.0, 0.5]) + r.logistic(size=6000)
    grades = (z > 0.5).astype(int) + (z > 2).astype(int)
    rows, columns = np.nonzero(x)
    w, t = fit_ordinal(rows, columns, grades, 3, 3)
    assert np.allclose(w, [2.0, -1.0, 0.5], atol=0.25) and np.allclose(t, [0.5, 2.0], atol=0.25)


def test_severity_grows_with_marked_words(spark):
    plain = [(i, " ".join(words(50, i, 300)), 0) for i in range(200)]
    rude = [(1000 + i, " ".join([*words(40, 300 + i, 300), *random.Random(i).sample(["zxidiot", "zxmoron", "zxscum", "zxtrash"], 1 + i % 4)]), 1) for i in range(80)]
    docs = spark.createDataFrame(plain + rude, "doc_id long, text string, toxic int")
    model = learn_severity(docs, docs.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in severity(docs, model).collect()}
    assert sum(got[d].toxic for d, _, _ in rude) >= 76 and sum(got[d].toxic for d, _, _ in plain) <= 4
    assert np.mean([got[1000 + i].severity for i in range(0, 80, 4)]) < np.mean([got[1000 + i].severity for i in range(3, 80, 4)])
    assert list(model.thresholds) == sorted(model.thresholds) and all(0 <= r.severity <= 3 for r in got.values())
    assert learn_severity(docs, docs.where("toxic = 0").select("doc_id", "toxic")) is None
    assert severity(awkward(spark), model).count() == awkward(spark).count() and severity(empty(spark), model).count() == 0


def test_equal_texts_count_once_and_repeated_rows_change_nothing(spark):
    rows = [(i, " ".join([*words(30, i, 200), *(["zxscum"] if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    more = docs.union(docs.where("doc_id < 9")).union(spark.createDataFrame([(500 + i, rows[0][1], 1) for i in range(40)] + [(None, "zxscum", 0), (700, None, None)], docs.schema))
    one, two = (learn_severity(d, d.select("doc_id", "toxic")) for d in (docs, more))
    assert np.array_equal(one.terms, two.terms) and len(one.terms) and np.allclose(one.weights, two.weights)
    same = spark.createDataFrame([(i, f"only{i}", i % 2) for i in range(20)], "doc_id long, text string, toxic int")
    assert not len(learn_severity(same, same.select("doc_id", "toxic")).terms)  # no word in three texts


# recurrent scores


def test_base_scores_equal_plain_counting(spark):
    docs = awkward(spark)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(False))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    counts = Counter(x for d, t in rows if d is not None and crc(d) % 7 != 2 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for limit in (recurrent.FREQUENT, 5):
        old, recurrent.FREQUENT = recurrent.FREQUENT, limit
        try:
            got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in language_scores(docs, learn).collect()), key=repr)
        finally:
            recurrent.FREQUENT = old
        want = [(d, len(x := tokens(t)), sum(counts[k] > 0 for k in x), n, round(sum(math.log10((counts[k] + 1) / (n + v + 1)) for k in x), 6)) for d, t in rows]
        assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=repr)]
        assert np.allclose([g[4] for g in got], [w[4] for w in sorted(want, key=repr)], atol=1e-4)
    assert language_scores(empty(spark), learn).count() == 0
    assert all(np.isfinite(r.score) for r in language_scores(docs, F.lit(False)).collect())


def test_distinct_words_are_hashed_once(spark, monkeypatch):
    """Every byte is inside a word or a blank as the pattern says; the hashes are those of the words as they stand."""
    texts = [b"", b" ", b"  The the\x0bcat\t", b"", b"cat a\x00b \x00 \xff\xfe The", *[bytes([i, 65, i]) for i in range(256)]]
    seen, plain = [], arrays.word_hashes
    monkeypatch.setattr(arrays, "word_hashes", lambda w: seen.append(len(w.starts)) or plain(w))
    for part in ([], [b""], texts, texts[:5], [b"\n\n"]):
        w, got = arrays.split_words(part), recurrent.token_stream(part)
        assert np.array_equal(got.hashes[got.code], plain(w)) and np.array_equal(got.counts, w.counts)
        words = [x for t in part for x in re.findall(rb"[^\x20\x09-\x0D]+", t.lower())]
        assert seen.pop() == len(got.hashes) == len(set(words))


def test_softmax_without_largest_sums_only_where_powers_stay_finite():
    net, r = small_net(), np.random.default_rng(6)
    assert all(calm for _, calm in net.outputs(1.0))
    given, target, fresh = r.integers(0, 150, (6, 3)), r.integers(0, 150, (6, 3)), np.zeros((6, 3), bool)
    want = net._window(given, target, fresh, np.zeros((3, recurrent.SIZE), np.float32))[1]
    log = net.log_probability(np.full((150, recurrent.SIZE), 0.5, np.float32), np.arange(150))
    net.p["class_bias"] = net.p["class_bias"] + 150  # all alike, so that nothing changes
    net.p["member_bias1"] = net.p["member_bias1"] - 150
    assert [calm for _, calm in net.outputs(1.0)][:3] == [False, True, False]
    got = net._window(given, target, fresh, np.zeros((3, recurrent.SIZE), np.float32))[1]
    assert all(np.allclose(got[n], want[n], atol=1e-4) for n in got)
    assert np.allclose(net.log_probability(np.full((150, recurrent.SIZE), 0.5, np.float32), np.arange(150)), log, atol=1e-3)


def test_texts_of_several_slices_are_scored_side_by_side(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(1 + i % 9))) for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string").coalesce(1)
    learn = F.col("doc_id") % 2 == 0
    rows = []
    for tokens, size in ((recurrent.ASKED, recurrent.SLICE), (40, 30), (1, 1)):
        monkeypatch.setattr(recurrent, "ASKED", tokens)
        monkeypatch.setattr(recurrent, "SLICE", size)
        rows.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in language_scores(docs, learn).collect()})
    assert len(rows[0]) == 62 and all(rows[0].keys() == x.keys() for x in rows)
    for i, (n, known, base, score) in rows[0].items():
        assert all(x[i][:2] == (n, known) and np.allclose(x[i][2:], (base, score), rtol=1e-3) for x in rows)


def small_net():
    net = Network(np.array([50.0, 3, *(2000 / np.arange(1, 200))]), seed=1, classes=16)
    r = np.random.default_rng(2)
    net.p = {k: (v + r.normal(0, 0.2, v.shape) * (v > -1e3)).astype(np.float32) for k, v in net.p.items()}
    return net


def test_probabilities_of_the_next_word_add_up_to_one():
    net = small_net()
    h = np.random.default_rng(3).normal(size=(1, recurrent.SIZE)).astype(np.float32)
    k = net.k
    assert len(set(zip(net.of.tolist(), net.slot.tolist()))) == k and len(set(net.width.tolist())) > 1
    total = np.exp(net.log_probability(np.repeat(h, k, axis=0), np.arange(k))).sum()
    assert abs(total - 1) < 1e-4
    spelling = Spelling(np.random.default_rng(1).integers(0, 9, 65536))
    assert np.allclose(np.exp(spelling.log).sum(axis=1), 1)


def test_state_is_carried_through_whole_documents():
    net, r = small_net(), np.random.default_rng(4)
    docs = [r.integers(0, 200, n) for n in (1, 700, 30, 3)]
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    got = net.score(np.concatenate(docs), first)
    given = net.p["embed"] @ net.p["in"] + net.p["bias"]
    for d, score in zip(docs, got):
        h, before, total = np.zeros((1, recurrent.SIZE), np.float32), 0, 0.0
        for t in d:
            h = net.step(given[[before]], h)[0]
            total += net.log_probability(h, np.array([t]))[0]
            before = t
        assert abs(total - score) < 1e-2 * max(1, abs(score) / 100)


def test_recurrent_gradients_and_training():
    net = small_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(5)
    given, target = r.integers(0, 150, (6, 3)), r.integers(0, 150, (6, 3))
    target[4:, 2] = -1
    fresh = np.zeros((6, 3), bool)
    fresh[0] = fresh[3, 1] = True

    def loss():
        h, total, count = np.zeros((3, recurrent.SIZE)), 0.0, 0
        table = net.p["embed"] @ net.p["in"] + net.p["bias"]
        for t in range(6):
            h = net.step(table[given[t]], np.where(fresh[t][:, None], 0, h))[0]
            used = target[t] >= 0
            total -= net.log_probability(h[used], target[t][used]).sum()
            count += used.sum()
        return total / count

    g = net._window(given, target, fresh, np.zeros((3, recurrent.SIZE)))[1]
    for name, at in (("state", (3, 40)), ("state", (2, 5)), ("in", (1, 20)), ("bias", (33,)), ("class", (4, 1)), ("member_bias0", (0, 2)), ("member0", (1, 5, 3)), ("member1", (1, 0, 6)), ("member_bias1", (0, 5)), ("embed", (int(given[2, 0]), 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        up = loss()
        net.p[name][at] = old - 1e-4
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-4 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))
    net = Network(np.r_[50.0, 0, np.full(40, 100.0)])
    docs = [np.r_[np.tile([2 + i % 20, 3 + i % 20], 30), 0] for i in range(64)]
    flat, first = np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])]
    before = net.score(flat, first).sum()
    for _ in range(6):
        net.train(docs)
    assert net.score(flat, first).sum() > 0.7 * before


def test_scores_equal_a_plain_loop_with_the_full_softmax():
    """Gates, classes and members written out for one word after the other, over all words of the vocabulary."""
    net, r = small_net(), np.random.default_rng(8)
    p = {k: v.astype(float) for k, v in net.p.items()}
    docs = [r.integers(0, net.k, n) for n in (5, 40, 1)]
    got = net.score(np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])])
    level = np.searchsorted(net.first, net.of, side="right") - 1
    for d, score in zip(docs, got):
        h, before, total = np.zeros(recurrent.SIZE), 0, 0.0
        for t in d:
            x, m = p["embed"][before] @ p["in"] + p["bias"], h @ p["state"]
            z, u = (1 / (1 + np.exp(-(x[a : a + recurrent.SIZE] + m[a : a + recurrent.SIZE]))) for a in (0, recurrent.SIZE))
            n = np.tanh(x[2 * recurrent.SIZE :] + u * m[2 * recurrent.SIZE :])
            h = (1 - z) * n + z * h
            classes = np.exp(h @ p["class"] + p["class_bias"])
            every = np.zeros(net.k)
            for w in range(net.k):
                v, c = level[w], net.of[w]
                members = np.exp(h @ p[f"member{v}"][c - net.first[v]] + p[f"member_bias{v}"][c - net.first[v]])
                every[w] = classes[c] / classes.sum() * members[net.slot[w]] / members.sum()
            assert abs(every.sum() - 1) < 1e-6
            total += math.log(every[t])
            before = t
        assert abs(total - score) < 1e-3 * max(1, abs(score))


def test_frequent_words_have_few_others_in_their_class():
    share = 1 / np.arange(1, 8193)
    widths = recurrent.class_widths(share / share.sum(), recurrent.CLASSES)
    assert len(widths) <= recurrent.CLASSES and sum(widths) >= 8192 and widths == sorted(widths)
    of = np.repeat(np.arange(len(widths)), widths)[:8192]
    assert (share / share.sum() * np.array(widths)[of]).sum() < 64  # 96 with classes of equal size


def test_long_documents_are_taught_in_pieces(monkeypatch):
    """Every token is a target once, and its input is the token before it."""
    monkeypatch.setattr(recurrent, "LONG", 7)
    docs = [np.arange(2, 2 + n) for n in (20, 7, 3, 1)]
    net, seen = Network(np.full(40, 10.0)), []

    def window(given, target, fresh, h, g):
        for t in range(len(target)):
            for j in np.flatnonzero(target[t] >= 0):
                seen.append((int(target[t, j]), int(given[t, j]), bool(fresh[t, j])))
        for v in g.values():
            v.fill(0)
        return h, g

    monkeypatch.setattr(net, "_window", window)
    assert net.train(docs) == 31
    want = [(t, t - 1 if t > 2 else 0, i % 7 == 0) for d in docs for i, t in enumerate(d.tolist())]
    assert sorted(seen) == sorted(want)


def test_every_text_teaches_in_one_round_and_copies_spread(spark):
    same = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, same) for i in range(600)] + [(None, same), (5, None), (6, "")], "doc_id long, text string")
    rounds = [docs.where(recurrent.teaches(turn)).count() for turn in range(recurrent.ROUNDS)]
    assert sum(rounds) == docs.count() and min(rounds) > 100
    # a network at its unigram start gives the same words the same score in any order
    asked = spark.createDataFrame([(1001, same), (1002, " ".join(reversed(same.split())))], docs.schema)
    got = {r.doc_id: r.score for r in language_scores(docs.union(asked), F.coalesce(F.col("doc_id"), F.lit(0)) < 1000).collect()}
    assert got[1001] > got[1002] + 0.1


def test_a_lesson_in_parts_goes_on_with_its_moments():
    docs = [np.r_[np.tile([2 + i % 20, 3 + i % 20], 30), 0] for i in range(64)]
    net, past = Network(np.r_[50.0, 0, np.full(40, 100.0)]), {}
    assert [net.train(part, past=past) for part in (docs[:30], docs[30:], [])] == [30 * 61, 34 * 61, 0]
    assert past["turn"] == 2 * -(-61 // recurrent.WINDOW)


def test_transitions_count_each_word_as_often_as_it_occurs(spark):
    texts = ["Ab ab  ca", " ab\n", "", None, "b"] * 8
    want = Counter()
    for x in texts:
        for word in WORD.findall(lower(x)):
            want.update(zip(b"\0" + word.encode(), word.encode() + b"\0"))
    for parts in (1, 5):
        table = recurrent.corpus_counts(spark.createDataFrame([(x,) for x in texts], "text string").repartition(parts))[1]
        assert {divmod(int(c), 256): table[c] for c in np.flatnonzero(table)} == want
