import hashlib
import random

import numpy as np
import pytest
from fixtures_llm import awkward, empty, given, have_given, words

from terrastat.llm import repeats


def brute(rows, length=400):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = True
    out = []
    for (d, _), t, g in zip(rows, texts, gone):
        runs = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        out.append((d, len(t), int(g.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("table", ["awkward", "given"])
def test_equals_all_windows(spark, table):
    if table == "given" and not have_given():
        pytest.skip("no tables")
    docs = awkward(spark) if table == "awkward" else given(spark)
    got = sorted(map(tuple, repeats.repeated_strings(docs).collect()), key=repr)
    assert got == brute(pairs(docs))


def test_a_source_that_reads_in_another_order_each_time(spark):
    """Row numbers are stored with the texts, so spans cannot go to other rows."""
    rows = skewed(60, 9)

    def shuffled(batches):
        for b in batches:
            yield b.sample(frac=1)  # no seed: another order at every evaluation

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).mapInPandas(shuffled, "doc_id long, text string")
    assert [r.doc_id for r in docs.collect()] != [r.doc_id for r in docs.collect()]
    assert sorted(map(tuple, repeats.repeated_strings(docs).collect()), key=repr) == brute(rows)


def skewed(n, seed=3):
    """Copies, mutated copies, one passage in many texts at many places, a run of one byte, repeats inside a text."""
    r = random.Random(seed)
    passage, base = " ".join(words(90, 50, 900)), " ".join(words(260, 51, 900))
    rows = []
    for i in range(n):
        own = " ".join(words(r.randint(20, 120), 100 + i, 900))
        kind = i % 5
        if kind == 0:
            text = own[:40] + passage + own[40:]
        elif kind == 1:
            text = base
        elif kind == 2:
            at = r.randrange(len(base))
            text = base[:at] + "#" + base[at + 1 :]
        elif kind == 3:
            text = own + own if i % 2 else own
        else:
            text = "a" * r.randint(380, 500) + own
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("most", [repeats.MOST_CONTEXTS, 3])
def test_skewed_tables_with_and_without_narrowing(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    rows = skewed(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.repeated_strings(docs).collect()), key=repr) == brute(rows)


def test_sorter_against_plain_comparison():
    r = random.Random(1)
    for length in (48, 400):
        for _ in range(20):
            core = bytes(r.choice(b"ab") for _ in range(900))
            bodies, group, off, n = [], [], [], []
            for i in range(12):
                count = r.randint(1, 60)
                o = r.randint(0, count)
                at = 300 - o
                body = bytearray(core[at : at + count + length - 1])
                if r.random() < 0.7:
                    body[r.randrange(len(body))] ^= 1
                bodies.append(bytes(body))
                group.append(r.randint(0, 2))
                off.append(o)
                n.append(count)
            got = repeats.sorted_repeats(bodies, np.array(group), np.array(off), np.array(n), length)
            for i in range(12):
                for k in range(n[i]):
                    mine = bodies[i][k : k + length]
                    want = any(
                        j != i and group[j] == group[i] and 0 <= (m := k - off[i] + off[j]) < n[j] and bodies[j][m : m + length] == mine for j in range(12)
                    )
                    assert got[i][k] == want


def test_empty_table(spark):
    assert repeats.repeated_strings(empty(spark)).count() == 0
