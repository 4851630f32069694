import random

import pytest
from fixtures_llm import awkward, empty, given, have_given, words

from terrastat.llm.minhash import near_duplicates


def shingle_set(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\x0b\x0c\r":
        text = text.replace(b, " ")
    ws = [w for w in text.split(" ") if w]
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(groups[root(i)])
        out.append((d, len(sets[i]), c, None if d is None else d == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("table", ["awkward", "given"])
def test_equals_all_pairs(spark, table, k):
    if table == "given" and not have_given():
        pytest.skip("no tables")
    docs = awkward(spark) if table == "awkward" else given(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(docs, words=k).collect()), key=repr) == brute(rows, k)


def test_large_group_of_mutated_copies_and_a_chain(spark):
    r = random.Random(5)
    base = words(200, 9, 3000)
    rows = []
    for i in range(120):
        mine = list(base)
        for _ in range(r.randint(0, 9)):
            mine[r.randrange(len(mine))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(mine)))
    step = words(220, 10, 3000)
    for i in range(25):  # each linked with the next only
        rows.append((1000 - i, " ".join(step[i * 4 : i * 4 + 120])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(docs, words=4).collect()), key=repr) == brute(rows, 4)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_copies_that_are_alike_but_not_linked_meet_in_tiles(spark):
    r = random.Random(8)
    base = words(120, 19, 3000)
    rows = []
    for i in range(330):
        mine = list(base)
        for p in r.sample(range(len(mine)), r.choice([1, 2, 3, 3, 4])):
            mine[p] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(mine)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(docs, words=4).collect()), key=repr) == brute(rows, 4)
