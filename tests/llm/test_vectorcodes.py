import hashlib
import math
import random

import numpy as np
import pytest

from terrastat.llm import vectorcodes as V
from terrastat.llm.vectorcodes import encode

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ids string, of int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Full distances in Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    ints = [[math.floor(scale * x) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:entries]
    w = len(ints[0]) // parts

    def piece(i, p):
        return ints[i][p * w : (p + 1) * w]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    books = [[piece(i, p) for i in order] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = [near(piece(i, p), books[p])[0] for i in range(len(kept))]
            for e in range(len(books[p])):
                mine = [piece(i, p) for i in range(len(kept)) if own[i] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, r in enumerate(kept):
        got = [near(piece(i, p), books[p]) for p in range(parts)]
        out.append([r[0], r[2], "".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got)])
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    return sorted((repr((a, c, e, total[b], sha)) for a, b, c, e in out))


def found(spark, rows, **more):
    df = encode(spark.createDataFrame(rows, SCHEMA), **more)
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in df.collect())


def vectors(n, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, 16))
    x = (centres[r.integers(0, 5, n)] + spread * r.normal(size=(n, 16))).astype(np.float32)
    return [(int(i), [float(v) for v in row], int(i) % 3 if i % 7 else None, "x", "y", 1) for i, row in enumerate(x)]


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_codes_equal_full_distances(spark, spread):
    rows = vectors(300, 3, spread)
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = vectors(40, 5)
    rows += [rows[3], rows[3], (None, rows[2][1], 1, None, None, None), (7, rows[9][1], 2, "", "", 0)]  # repeats, no id, an id twice
    rows += [(90, None, 1, None, None, None), (91, [], 1, None, None, None), (92, [None] * 16, 1, None, None, None)]
    rows += [(93, [float("nan")] * 16, 1, None, None, None), (94, [float("inf")] + [0.0] * 15, 1, None, None, None)]
    rows += [(95, [-0.0001] * 16, None, None, None, None)]  # floors go down
    assert found(spark, rows) == plain(rows)


def test_fewer_rows_than_entries_ties_and_empty(spark):
    same = [(i, [0.5] * 16, 1, None, None, None) for i in range(5)]
    assert found(spark, same) == plain(same)
    got = found(spark, same)
    assert all("0000000000000000" in g for g in got)  # ties take the lower index
    assert found(spark, []) == []


def test_a_vector_of_another_length_is_an_error(spark):
    rows = vectors(20, 1) + [(99, [1.0] * 8, 1, None, None, None)]
    with pytest.raises(Exception, match="components"):
        found(spark, rows)


def test_many_blocks_agree_with_one_pass(spark):
    """5,000 vectors in several blocks and tasks against plain numpy, a hot place holding a third of them."""
    r = np.random.default_rng(2)
    x = r.normal(size=(5000, 16)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, [float(v) for v in row], i % 2, "", "", 0) for i, row in enumerate(x)]
    ints = np.floor(x.astype(np.float64) * 4096).astype(np.int64)
    total = np.zeros(5000, dtype=np.int64)
    codes = np.zeros((5000, 8), dtype=int)
    for p in range(8):
        part = ints[:, 2 * p : 2 * p + 2]
        book = part[:16].copy()
        for _ in range(6):
            own = ((part[:, None] - book[None]) ** 2).sum(-1).argmin(1)
            for e in range(16):
                if (own == e).any():
                    book[e] = part[own == e].sum(0) // (own == e).sum()
        d = ((part[:, None] - book[None]) ** 2).sum(-1)
        codes[:, p], total = d.argmin(1), total + d.min(1)
    got = {q.vec_id: q for q in encode(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(got[i].error == total[i] and bytes.fromhex(got[i].code) == bytes(codes[i].tolist()) for i in range(5000))


def test_balls_hold_their_rows_and_own_most_of_them():
    x = np.concatenate([np.random.default_rng(s).normal(c * 4000, 50, size=(200, 3)).astype(np.int64) for s, c in enumerate(range(-2, 3))])
    order, nodes = V.flattened(x)
    assert sorted(order) == list(range(len(x)))
    for n in nodes:
        own = x[order[n[2] : n[3]]]
        assert (own.sum(0) == n[8:]).all() and ((own - n[5:8]) ** 2).sum(1).max() == n[4]
    forest = V._forest([x[order]], [nodes])
    book = np.array([[c * 4000] * 3 for c in range(-2, 3)])
    whole = sum((nodes[w, 3] - nodes[w, 2]).sum() for w, d, _ in V.owned_balls(forest, book) if d is None)
    assert whole == len(x)  # separated groups are owned as balls, no row is looked at
