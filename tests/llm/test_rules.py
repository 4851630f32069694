from collections import Counter

import pytest
from fixtures_llm import awkward, empty, given, have_given

from terrastat.llm.rules import MEASURES, binomial_tail, chosen_cutoffs, quality_rules

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def base_of(text):
    text = text or ""
    ws = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    inside = {j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(ws) < 20 or 100 * len(inside) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


@pytest.mark.parametrize("table", ["awkward", "given"])
def test_counts_equal_plain_loops(spark, table):
    if table == "given" and not have_given():
        pytest.skip("no tables")
    docs = awkward(spark) if table == "awkward" else given(spark)
    labels = spark.createDataFrame([(7, 1), (12, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = quality_rules(docs, labels)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = sorted(map(tuple, got.select(*names).collect()), key=repr)
    want = sorted([(r.doc_id, *base_of(r.text)) for r in docs.collect()], key=repr)
    assert rows == want
    assert got.where("kept and base_failed").count() == 0


def test_too_few_labels_reject_nothing(spark):
    got = quality_rules(awkward(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert got.where("kept = base_failed").count() == 0
    assert quality_rules(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_junk_goes_and_good_rows_stay_below_the_risk(spark):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 97}{'abcdefghij'[j % 10]}" for j in range(60)), "en") for i in range(4000)]
    bad = [(10_000 + i, " ".join(f"w{(i + j * j) % 89}x###" for j in range(60)), "en") for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()}
    assert not any(got[i] for i, _, _ in bad)
    assert sum(not got[i] for i, _, _ in good) <= 0.05 * len(good)


def test_binomial_tail_and_correction():
    from math import comb

    for k, n, p in ((0, 50, 0.01), (3, 200, 0.05), (40, 100, 0.3), (5, 5, 0.2)):
        assert abs(binomial_tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    row = {"stratum": "a", "good": 5000} | {f"{g}_{i}_{j}": (0 if g == "good" else 5) for g in ("good", "bad") for i, m in enumerate(MEASURES) for j in range(len(m.cutoffs))}
    assert chosen_cutoffs([row], MEASURES, 0.05, 0.05)["a"] == [m.cutoffs[0] for m in MEASURES]
    assert chosen_cutoffs([row | {"good": 200}], MEASURES, 0.05, 0.05)["a"] == [None] * len(MEASURES)
