import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from fixtures_llm import given, have_given

from terrastat.llm import conversations as C
from terrastat.llm.conversations import damaged, repair_report, repaired

SCHEMA = "conv_id long, turn long, role string, text string, at string, marks long, edits int"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(own):
    """Forward recursion over whole audits, no checkpoints."""
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
    marks, seen = [], set()
    for _, role, text in own:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        marks.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, state, inserted):
        """Cheapest (cost, audit, lines) of the rows from ``i``."""
        ways = []
        if i == len(own) and state in (0, 3):
            ways.append((0, "", ()))
        if inserted < 3:
            c, a, lines = best(i, 3 if state == 2 else 2, inserted + 1)
            ways.append((c + 2, "I" + a, (("assistant" if state == 2 else "user") + ":", *lines)))
        if i < len(own):
            _, role, text = own[i]
            c, a, lines = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, lines))
            if marks[i] not in ("blank", "duplicate"):
                late = marks[i] == "truncated"
                if (to := keep.get((state, role[:1]))) is not None:
                    c, a, lines = best(i + 1, to, 0)
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(i + 1, 3 if state == 2 else 2, 0)
                ways.append((c + 2 + late, "R" + a, (f"{'assistant' if state == 2 else 'user'}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()), key=lambda w: w[:2])

    cost, audit, lines = best(0, 0, 0)
    turns = [t for t, *_ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha), list(lines)


def expected(rows):
    return sorted(((conv, *plain(own)[0]) for conv, own in plain_damage(rows).items()), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def awkward(seed=1, n=60):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "System", "usr"]
    texts = ["Hi.", "Yes!", "no end", "", None, " \t\n\x0b\x0c\r", "漢字。", "What?\n", "é.\x85", "end. \x1f", "...", "a. b"]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 12)):
            rows.append((conv, turn + r.choice([0, 0, 0, 3]), r.choice(roles), r.choice(texts)))
    rows += [(None, t, "user", f"q{t}?") for t in range(5)] + [(7, None, "user", "first?"), (7, None, None, None), (8, -4, "assistant", "x" * 300_000)]
    rows += [rows[0], rows[1], (9, 2, "user", "tie a."), (9, 2, "user", "tie b."), (9, 2, "assistant", "tie b.")]
    return [(*x, "a", 1, 2) for x in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_plain_search(spark, seed):
    rows = awkward(seed)
    random.Random(seed).shuffle(rows)
    assert found(repair_report(damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)))) == expected(rows)


@pytest.mark.skipif(not have_given(), reason="no tables")
def test_given_conversations(spark):
    rows = [tuple(r) for r in given(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(repair_report(damaged(given(spark, "conversations")))) == expected(rows)


def test_empty_and_wholly_dropped(spark):
    assert found(repair_report(damaged(spark.createDataFrame([], SCHEMA)))) == []
    lost = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = found(repair_report(damaged(spark.createDataFrame([(3, lost, "user", "x.", "", 0, 0)], SCHEMA))))
    assert got == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_are_the_digest(spark):
    rows = awkward(3, 20)
    df = damaged(spark.createDataFrame(rows, SCHEMA))
    by = {}
    for r in repaired(df).orderBy("place").collect():
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, own in plain_damage(rows).items():
        assert by.get(conv, []) == plain(own)[1]


def test_long_conversation_over_blocks_and_tasks(spark, monkeypatch):
    """A third of all rows in one conversation, blocks of eight rows, identical rows in masses."""
    monkeypatch.setattr(C, "BLOCK_BITS", 3)
    r = random.Random(4)
    rows = [(0, t // 2, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", f"{t}!", ""])) for t in range(400)]
    rows += [(0, 500, "user", "again.")] * 300 + [(1 + i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(800)]
    rows = [(*x, "", 0, 0) for x in rows]
    got = found(repair_report(damaged(spark.createDataFrame(rows, SCHEMA).repartition(6))))
    import sys

    sys.setrecursionlimit(20_000)
    assert got == expected(rows)


def test_checkpoints_lose_nothing():
    """Blocks chained by their transfer costs give what one long block gives."""
    rng = np.random.default_rng(5)
    codes = rng.choice([0, 1, 2, 3, 1, 2, 5, 9, 17, 18, 2], size=(6, 97))
    whole = C.walk(codes, np.tile(C.END, (6, 1)))[:, 0]
    after = np.tile(C.END, (6, 1))
    ends = []
    for i in range(90, -1, -10):
        ends.append((i, after))
        after = (C.transfer(codes[:, i : i + 10]) + after[:, None, :]).min(axis=2)
    state = np.zeros(6, dtype=int)
    for i, end in reversed(ends):
        part = C.walk(codes[:, i : i + 10], end)
        own = part[np.arange(6), state]
        assert (own == whole[:, i : i + 10]).all()
        for b in range(6):
            for e, c in zip(own[b], codes[b, i : i + 10]):
                for _ in range(e >> 2):
                    state[b] = C.NEXT[state[b]]
                state[b] = state[b] if e & 3 == 0 else C.AFTER[c & 3][state[b]] if e & 3 == 2 else C.NEXT[state[b]]
