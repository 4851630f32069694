"""Log-likelihood of whole documents under a gated recurrent network with a class-factored softmax over words."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays
from terrastat.llm.shared import stored

#: Words of the network's own vocabulary, all others are spelled; output classes aimed at, and the smallest and largest of them.
WORDS = 8190
CLASSES = 64
NARROW, WIDE = 4, 1024
SIZE = 16
#: Steps of truncated backpropagation, texts side by side, tokens of a text taught in one piece, rounds of averaging that share the texts among them.
WINDOW = 24
STREAMS = 256
LONG = 512
ROUNDS = 3
RATE = 0.04
#: Tokens that a task holds before it trains on them.
LESSON = 2_000_000
#: Tokens that a task scores side by side: the longest text takes as many steps as it has tokens, however few others run beside it.
ASKED = 5_000_000
#: Distinct words that a task counts before it passes them on.
HELD = 500_000
#: Frequent words whose counts every task holds; the counts of all others are joined.
FREQUENT = 400_000
SLICE = 6_000_000
END, OTHER = 0, 1
PIECE = 8192


class Tokens(NamedTuple):
    """Words of consecutive texts: ``code[first[d]:first[d + 1]]`` are those of text ``d``, as places among the distinct ones."""

    words: arrays.Words
    hashes: np.ndarray
    code: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def token_stream(texts: list[bytes]) -> Tokens:
    """Words with A-Z in lower case; each distinct one is hashed once."""
    text = pa.large_utf8()
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(text)))
    coded = split.flatten().dictionary_encode()
    distinct, code, first = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    none = pc.index(distinct, pa.scalar("", text)).as_py()  # before a blank at the start and after one at the end
    if none >= 0:
        filled = code != none
        first = np.r_[0, np.cumsum(filled)][first]
        code = code[filled]
        code = code - (code > none)
        distinct = pa.concat_arrays([distinct[:none], distinct[none + 1 :]])
    _, at, held = pc.binary_join_element_wise(distinct, pa.scalar("", text), pa.scalar(" ", text)).buffers()
    n = len(distinct)
    at = np.frombuffer(at, np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    buffer = np.frombuffer(held, np.uint8)[: at[-1]] if n else np.zeros(0, np.uint8)
    w = arrays.Words(buffer, at, at[:-1], at[1:] - 1, np.arange(n + 1))
    return Tokens(w, arrays.word_hashes(w), code, first)


class Spelling:
    """Bytes of a word from its byte before; 0 stands before the first and after the last. Sums to one over all words."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(256, 256) + 0.05
        self.log = np.log(table / table.sum(axis=1, keepdims=True))

    @staticmethod
    def cells(w: arrays.Words) -> np.ndarray:
        """Transition at every place of the buffer: inside words, into them and out of them; elsewhere -1."""
        b = np.where(arrays.BLANK[w.buffer], 0, arrays.LOWER[w.buffer]).astype(np.int64)
        before = np.r_[0, b[:-1]]
        return np.where((b == 0) & (before == 0), -1, before * 256 + b)

    def words(self, w: arrays.Words) -> np.ndarray:
        """Log probability of each word's spelling."""
        cell = self.cells(w)
        run = np.r_[0, np.cumsum(np.where(cell >= 0, self.log.ravel()[np.maximum(cell, 0)], 0.0))]
        return run[w.ends + 1] - run[w.starts]


def class_widths(share: np.ndarray, classes: int) -> list[int]:
    """Members of each class, powers of two, over symbols whose shares fall.

    A token pays for the members of its class, so a class at a place is as wide as one over the root of the share there: that makes
    the least mean cost for a number of classes. Frequent symbols meet a few others, rare ones many.
    """

    def cut(scale: float) -> list[int]:
        out, at = [], 0
        while at < len(share):
            width = 2 ** round(math.log2(scale / math.sqrt(share[at])))
            out.append(int(min(WIDE, max(NARROW, width, out[-1] if out else 0))))
            at += out[-1]
        return out

    low, high = 1e-6, 1e6
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if len(cut(mid)) > classes else (low, mid)
    return cut(high)


class Network:
    """Word vectors, one gated recurrent layer, class softmax and a softmax over the members of the class.

    Classes of one width are a level; the members of a level's classes are one array.
    """

    def __init__(self, counts: np.ndarray, seed: int = 5, classes: int = CLASSES):
        """``counts`` by vocabulary number; the output starts as the unigram model."""
        r = np.random.default_rng(seed)
        k = len(counts)
        share = (counts + 0.5) / (counts + 0.5).sum()
        order = np.argsort(-share, kind="stable")
        widths = np.array(class_widths(share[order], classes))
        begin = np.cumsum(widths) - widths
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        self.k, self.c = k, len(widths)
        self.of = np.searchsorted(begin, place, side="right") - 1
        self.slot = place - begin[self.of]
        self.first = np.flatnonzero(np.r_[True, np.diff(widths) > 0])  # first class of each level
        self.width = widths[self.first]
        self.level = [(v, c - self.first[v]) for c, v in enumerate(np.searchsorted(self.first, np.arange(self.c), side="right") - 1)]
        self.p = {
            "embed": r.normal(0, 0.3, (k, SIZE)),
            "in": r.normal(0, 0.25, (SIZE, 3 * SIZE)),
            "state": r.normal(0, 0.25, (SIZE, 3 * SIZE)),
            "bias": np.zeros(3 * SIZE),
            "class": np.zeros((SIZE, self.c)),
            "class_bias": np.log(np.bincount(self.of, share, self.c)),
        }
        for v, (a, z) in enumerate(zip(self.first, [*self.first[1:], self.c])):
            filled = np.zeros((z - a, self.width[v]))
            mine = (self.of >= a) & (self.of < z)
            filled[self.of[mine] - a, self.slot[mine]] = share[mine]
            with np.errstate(divide="ignore"):
                self.p[f"member_bias{v}"] = np.maximum(np.log(filled / filled.sum(axis=1, keepdims=True)), -1e4)
            self.p[f"member{v}"] = np.zeros((z - a, SIZE, self.width[v]))
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def views(self, values: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of a vector in the shapes of the weights."""
        out, at = {}, 0
        for n, v in self.p.items():
            out[n] = values[at : at + v.size].reshape(v.shape)
            at += v.size
        return out

    def load(self, values: np.ndarray) -> "Network":
        self.p = self.views(values.astype(np.float32))
        return self

    def step(self, given: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state from the input's gate sums and the state: update, reset, candidate.

        One row per stream; quick on transposed arrays, where the streams of a unit and the units of a gate lie side by side.
        """
        mixed = (self.p["state"].T @ h.T).T
        gates = given[:, : 2 * SIZE] + mixed[:, : 2 * SIZE]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :SIZE], gates[:, SIZE:]
        inner = mixed[:, 2 * SIZE :]
        n = r * inner
        n += given[:, 2 * SIZE :]
        np.tanh(n, out=n)
        after = h - n
        after *= z
        after += n
        return after, z, r, n, inner

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of the targets by class, and for each class that occurs its level, its place there and its run."""
        of = self.of[target].astype(np.int16)  # 16 bits are sorted digit by digit
        order = np.argsort(of, kind="stable")
        of = of[order]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        return order, [(*self.level[of[a]], int(a), int(z)) for a, z in zip(begin, [*begin[1:], len(of)])]

    def outputs(self, reach: float) -> list[tuple[np.ndarray, bool]]:
        """Weights of the classes and of the members of each level, their biases as a last row, and whether they are calm.

        Calm ones need no largest sum taken off: for states up to ``reach`` no power overflows and no class has only powers that vanish.
        """
        out = []
        for name in ("class", *(f"member{v}" for v in range(len(self.first)))):
            weights, biases = self.p[name], self.p[name.replace("class", "class_bias").replace("member", "member_bias")]
            far = np.abs(weights).sum(axis=-2) * reach
            calm = (biases + far).max() < 80 and (biases - far).max(axis=-1).min() > -80
            out.append((np.concatenate([weights, biases[..., None, :]], axis=-2), bool(calm)))
        return out

    def log_probability(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        (classes, calm), *levels = self.outputs(max(1.0, float(np.abs(states).max(initial=0))))

        def chosen(weights: np.ndarray, calm: bool, x: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Log of the softmax of each column at one place."""
            s = weights.T @ x
            if not calm:
                s -= s.max(axis=0)
            own = s[at, np.arange(len(at))]
            return own - np.log(np.ones(len(s), s.dtype) @ np.exp(s, out=s))

        for a in range(0, len(target), 65536):
            t = target[a : a + 65536]
            of, log, inside = self.of[t], np.empty(len(t)), np.empty(len(t))
            h = np.ones((SIZE + 1, len(t)), states.dtype)
            h[:SIZE] = states[a : a + 65536].T
            for b in range(0, len(t), 2048):  # what stays in the cache
                log[b : b + 2048] = chosen(classes, calm, h[:, b : b + 2048], of[b : b + 2048])
            order, runs = self.by_class(t)
            h, slot = h.take(order, axis=1), self.slot[t[order]]
            for v, i, first, last in runs:
                weights, quiet = levels[v][0][i], levels[v][1]
                step = max(64, 200_000 // weights.shape[1])
                for b in range(first, last, step):
                    z = min(b + step, last)
                    inside[b:z] = chosen(weights, quiet, h[:, b:z], slot[b:z])
            log[order] += inside
            out[a : a + 65536] = log
        return out

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each document ``ids[first[d]:first[d + 1]]``.

        Documents run side by side, longest first, in windows of steps; the state of a document goes from window to window
        until its last token, so a document of any length is scored whole.
        """
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        given = np.ascontiguousarray((self.p["embed"] @ self.p["in"] + self.p["bias"]).T)
        total = np.zeros(len(size))
        h = np.zeros((len(size), SIZE), np.float32)
        begin, longest = first[:-1][order], int(size.max(initial=0))
        previous = np.full(len(size), END)
        running = np.searchsorted(-size[order], -np.arange(longest), side="left")  # documents longer than t
        t = 0
        while t < longest:
            states, targets, who, held = [], [], [], 0
            while t < longest and held < 200_000:
                n = int(running[t])
                h = self.step(given.take(previous[:n], axis=1).T, h[:n])[0]
                previous = ids[begin[:n] + t]
                states.append(h.T)
                targets.append(previous)
                who.append(np.arange(n))
                held += n
                t += 1
            log = self.log_probability(np.concatenate(states, axis=1).T, np.concatenate(targets))
            total += np.bincount(order[np.concatenate(who)], log, len(size))
        return total

    def train(self, docs: list[np.ndarray], rate: float = RATE, past: dict | None = None) -> int:
        """Truncated backpropagation over ``docs``, ``STREAMS`` side by side, each stream piece after piece; Adam.

        Returns the tokens seen. Documents are taught in pieces of up to ``LONG`` tokens, so that no stream is much longer than
        the others; a piece begins with a state of zero and the token before it, and its state is carried over windows.
        ``past`` holds the steps and moments of earlier calls, which this one goes on with.
        """
        pieces = [(d, a, min(a + LONG, len(d))) for d in docs for a in range(0, len(d), LONG)]
        streams = [[] for _ in range(min(STREAMS, len(pieces)))]
        load = [(0, j) for j in range(len(streams))]
        for d, a, z in sorted(pieces, key=lambda p: p[1] - p[2]):
            held, j = load[0]
            streams[j].append((d, a, z))
            heapq.heapreplace(load, (held + z - a, j))
        length = max((held for held, _ in load), default=0)
        target = np.full((length, len(streams)), -1, np.int32)
        given = np.full((length, len(streams)), END, np.int32)
        fresh = np.zeros((length, len(streams)), bool)
        for j, s in enumerate(streams):
            at = 0
            for d, a, z in s:
                n = z - a
                target[at : at + n, j], given[at + 1 : at + n, j], fresh[at, j] = d[a:z], d[a : z - 1], True
                if a:
                    given[at, j] = d[a - 1]
                at += n
        h = np.zeros((len(streams), SIZE), np.float32)
        past = {} if past is None else past
        values = self.flat()
        self.p, g = self.views(values), self.views(np.empty_like(values))
        if not past:
            past |= {"turn": 0, "m": np.zeros_like(values), "v": np.zeros_like(values)}
        change = g["embed"].base
        for a in range(0, length, WINDOW):
            h = self._window(given[a : a + WINDOW], target[a : a + WINDOW], fresh[a : a + WINDOW], h, g)[0]
            past["turn"] += 1
            fast, slow = rate / (1 - 0.9 ** past["turn"]), 1 / (1 - 0.99 ** past["turn"])
            root = math.sqrt(0.01 * slow)
            for i in range(0, len(values), PIECE):  # what stays in the cache; moments are sums, not means
                x, m, v, d = (y[i : i + PIECE] for y in (values, past["m"], past["v"], change))
                m *= 0.9
                m += d
                np.square(d, out=d)
                v *= 0.99
                v += d
                np.sqrt(v, out=d)
                d += 1e-6 / root
                np.divide(m, d, out=d)
                d *= 0.1 * fast / root
                x -= d
        return int((target >= 0).sum())

    def _window(self, given: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, g: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """State after a window of steps and the gradients of its mean loss, written into ``g`` if given."""
        p = self.p
        g = {n: np.empty_like(v) for n, v in p.items()} if g is None else g
        g["embed"].fill(0)
        words = given.ravel()
        embedded = p["embed"][words]
        sums = p["in"].T @ embedded.reshape(*given.shape, SIZE).transpose(0, 2, 1)
        sums += p["bias"][:, None]
        steps, out, keep = [], [], (~fresh).astype(np.float32)
        for t in range(len(given)):
            h = h * keep[t][:, None]
            after, *parts = self.step(sums[t].T, h)
            steps.append((h, *parts))
            out.append(after.T)
            h = after
        # from here on a row for each unit, its steps and streams side by side
        before, z, r, n, inner = (np.stack([y.T for y in x], axis=1) for x in zip(*steps))
        used = np.flatnonzero(target >= 0)
        goal = target.ravel()[used]
        states = np.ones((SIZE + 1, len(goal)), h.dtype)
        np.concatenate(out, axis=1).take(used, axis=1, out=states[:SIZE], mode="clip")
        back = np.empty((SIZE, len(goal)), h.dtype)
        (classes, calm), *levels = self.outputs(1.0)
        change, of = np.zeros_like(classes), self.of[goal]
        for a in range(0, len(goal), 1024):
            x = states[:, a : a + 1024]
            change += self._softmax(classes, calm, x, of[a : a + 1024], len(goal), back[:, a : a + 1024])
        g["class"][:], g["class_bias"][:] = change[:SIZE], change[SIZE]
        self._members(states, goal, levels, back, g)
        to_out = np.zeros((SIZE, given.size), back.dtype)
        to_out[:, used] = back
        to_out = to_out.reshape(SIZE, *given.shape)
        # what a change of the state after a step does to the sums of its gates
        to_n = (1 - z) * (1 - n * n)
        by_gate = np.stack([(before - n) * z * (1 - z), to_n * inner * r * (1 - r), to_n * r])
        own = np.empty((3 * SIZE, *given.shape), by_gate.dtype)
        gates, dh = own.reshape(by_gate.shape), np.zeros((SIZE, given.shape[1]), back.dtype)
        for t in range(len(given) - 1, -1, -1):
            d = to_out[:, t] = to_out[:, t] + dh
            np.multiply(d, by_gate[:, :, t], out=gates[:, :, t])
            dh = (d * z[:, t] + p["state"] @ own[:, t]) * keep[t]
        flat = own.reshape(3 * SIZE, -1)
        g["state"][:] = before.reshape(SIZE, -1) @ flat.T
        np.multiply(to_out, to_n, out=own[2 * SIZE :])
        g["bias"][:] = flat.sum(axis=1)
        g["in"][:] = embedded.T @ flat.T
        order = np.argsort(words.astype(np.uint16) if self.k <= 65536 else words, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(words[order]) > 0])
        g["embed"][words[order[begin]]] = np.add.reduceat((flat.T @ p["in"].T)[order], begin)
        return h, g

    @staticmethod
    def _softmax(weights: np.ndarray, calm: bool, x: np.ndarray, at: np.ndarray, count: int, back: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Gradients of the weights for the columns of ``x`` with targets ``at``, one of ``count`` each; those of ``x`` go to ``back``."""
        s = weights.T @ x
        if not calm:
            s -= s.max(axis=0)
        np.exp(s, out=s)
        total = np.ones(len(s), s.dtype) @ s
        s.reshape(-1)[at * len(at) + np.arange(len(at))] -= total
        total *= count
        np.divide(weights[:SIZE] @ s, total, out=back)
        return np.matmul(x / total, s.T, out=out)

    def _members(self, states: np.ndarray, goal: np.ndarray, levels: list[tuple[np.ndarray, bool]], back: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """Writes the gradients of the members' weights and biases to ``out``; adds those of ``states`` (a row for each unit) to ``back``."""
        order, runs = self.by_class(goal)
        x, slot, more = states.take(order, axis=1), self.slot[goal[order]], np.empty_like(back)
        change = [np.zeros_like(weights) for weights, _ in levels]
        for v, i, a, z in runs:
            weights, calm = levels[v]
            self._softmax(weights[i], calm, x[:, a:z], slot[a:z], len(goal), more[:, a:z], change[v][i])
        for v, d in enumerate(change):
            out[f"member{v}"][:], out[f"member_bias{v}"][:] = d[:, :SIZE], d[:, SIZE]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        back += more.take(place, axis=1)


class Vocabulary:
    """Number in the network of a word by its hash; words outside are ``OTHER``."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order + 2

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), OTHER)
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[slot] == hashes, self.number[slot], OTHER)


def documents(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers with the end token after each document, and the new bounds."""
    return np.insert(ids, first[1:], END), first + np.arange(len(first))


def corpus_counts(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """How often each word of ``rows (text)`` occurs, by its hash, and the byte transitions of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = np.zeros(65536, np.int64)
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def told(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words), np.int32)), arrays.signed(words), pa.array(n)], names=["kind", "key", "n"])

        for _, texts in arrays.slices(batches, limit=SLICE):
            tokens = token_stream(texts)
            times = np.bincount(tokens.code, minlength=len(tokens.hashes))
            cell, often = Spelling.cells(tokens.words), np.repeat(times, np.diff(tokens.words.text_start))
            spelled += np.bincount(cell[cell >= 0], often[cell >= 0], 65536).astype(np.int64)
            both, at = np.unique(np.concatenate([words, tokens.hashes]), return_inverse=True)
            words, n = both, np.bincount(at, np.concatenate([n, times])).astype(np.int64)
            if len(words) > HELD:
                yield told(words, n)
                words, n = words[:0], n[:0]
        yield told(words, n)
        cell = np.flatnonzero(spelled)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(cell), np.int32)), pa.array(cell), pa.array(spelled[cell])], names=["kind", "key", "n"])

    both = stored(rows.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    table = np.zeros(65536)
    for r in both.where("kind = 1").collect():  # 65,536 cells at most
        table[r.key] = r.n
    return both.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c")), table


def teaches(turn: int) -> Column:
    """Whether a row of ``doc_id, text`` teaches in round ``turn``: each does in one round, copies of a text in different ones."""
    return F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS)) == turn


def averaged(rows: DataFrame, start: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary, turn: int) -> np.ndarray:
    """Weights after one round: every task trains on its texts of this round, the results are averaged by tokens.

    What is shuffled is pieces of weights of every task, added up in two steps, so it grows with the tasks.
    """
    session = rows.sparkSession
    shared = session.sparkContext.broadcast((start, counts, vocabulary))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, seen, vocab = shared.value
        net, past, weight = Network(seen).load(values), {}, 0
        docs: list[np.ndarray] = []
        held = 0
        for _, texts in arrays.slices(batches, limit=SLICE):
            tokens = token_stream(texts)
            ids, first = documents(vocab.ids(tokens.hashes).astype(np.int32)[tokens.code], tokens.first)
            docs += [ids[first[d] : first[d + 1]] for d in range(len(texts))]
            held += len(ids)
            if held >= LESSON:
                weight += net.train(docs, RATE / (1 + turn), past)
                docs, held = [], 0
        weight += net.train(docs, RATE / (1 + turn), past)
        if not weight:
            return
        flat = net.flat()
        parts = [flat[a : a + PIECE] for a in range(0, len(flat), PIECE)]
        at = pa.array(np.r_[0, np.cumsum([len(x) for x in parts])], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), float(weight))), pa.ListArray.from_arrays(at, pa.array(flat, pa.float32()))], names=["piece", "weight", "v"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            flat, offsets = batch.column("v").values.to_numpy(), batch.column("v").offsets.to_numpy()
            for i, (piece, weight) in enumerate(zip(batch.column("piece").to_pylist(), batch.column("weight").to_pylist())):
                s = sums.setdefault(piece, [0.0, 0.0])
                s[0] += weight
                s[1] = s[1] + weight * flat[offsets[i] : offsets[i + 1]].astype(np.float64)
        for piece, (weight, v) in sums.items():
            mean = (v / weight).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([weight]), pa.ListArray.from_arrays(pa.array([0, len(mean)], pa.int32()), pa.array(mean))], names=["piece", "weight", "v"])

    form = "piece int, weight double, v array<float>"
    taught = rows.mapInArrow(teach, form)
    once = taught.repartition("piece", F.pmod(F.xxhash64("weight"), F.lit(8))).mapInArrow(add, form)
    got = once.repartition("piece").mapInArrow(add, form).collect()  # the weights of one network
    return np.concatenate([np.array(r.v, np.float32) for r in sorted(got, key=lambda r: r.piece)]) if got else start


def language_scores(docs: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs (doc_id, text)``.

    Tokens are words with A-Z in lower case and one end per document. ``base_score`` is the add-one unigram score and ``score``
    the network's, both log10 of the whole text, learned from rows where ``learn`` holds. All of these are counted: words,
    spelling and the network's unigram start; its weights are trained on another share of the rows in each of ``ROUNDS``
    rounds, so that each row teaches once, in every task, and averaged. Words outside the network's vocabulary are one symbol
    of it and spelled byte by byte after it; the probabilities of all texts add up to one.

    A missing text is empty and has the end alone; with nothing to learn from, counts are 0 and the network is uniform over
    its two symbols. ``doc_id`` may be missing or repeated; other columns are ignored.
    """
    session = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    lessons = plain.where("learn").select("doc_id", "text")
    counts, spelled = corpus_counts(lessons.select("text"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = lessons.count()
    n_train, n_distinct = (total.n or 0) + ends, total.v + (ends > 0)
    top = counts.orderBy(F.col("c").desc(), "word").limit(FREQUENT).toArrow()
    frequent, times = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    vocabulary = Vocabulary(frequent[:WORDS])
    inside = times[:WORDS]
    known = np.r_[ends, max(0, (total.n or 0) - inside.sum()), inside].astype(np.float64)
    weights = Network(known).flat()
    for turn in range(ROUNDS):
        weights = averaged(lessons.where(teaches(turn)).select("text"), weights, known, vocabulary, turn)
    order = np.argsort(frequent)
    shared = session.sparkContext.broadcast((weights, known, vocabulary, frequent[order], times[order], spelled))
    all_of = float(n_train + n_distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, seen, vocab, words, c, cells = shared.value
        net, spelling = Network(seen).load(values), Spelling(cells)
        gain = np.log10(c + 1.0)
        waiting: list[tuple] = []
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            """Rows of the waiting slices, their texts scored side by side."""
            asked, sizes = [w[0] for w in waiting], np.concatenate([[0], *[w[1] for w in waiting]])
            score = net.score(np.concatenate([np.zeros(0, np.int32), *asked]), np.cumsum(sizes))
            at = 0
            for _, size, spelled_score, doc_id, learns, known_words, base, rare in waiting:
                own = score[at : at + len(size)] + spelled_score
                at += len(size)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, learns, pa.array(size), known_words, base, pa.array(own / np.log(10)), rare],
                    names=["doc_id", "learn", "n_tokens", "n_known", "base", "score", "rare"],
                )

        for batch, texts in arrays.slices(batches, limit=SLICE):
            tokens = token_stream(texts)
            n, counts = len(texts), tokens.counts
            doc = np.repeat(np.arange(n), counts)
            distinct, inverse = tokens.hashes, tokens.code
            numbers = vocab.ids(distinct).astype(np.int32)[inverse]
            ids, first = documents(numbers, tokens.first)
            other = numbers == OTHER
            spelled_score = np.bincount(doc[other], spelling.words(tokens.words)[inverse[other]], n)
            slot = np.minimum(np.searchsorted(words, distinct), max(0, len(words) - 1))
            hit = (words[slot] == distinct if len(words) else np.zeros(len(distinct), bool))[inverse]
            base = np.bincount(doc[hit], gain[slot[inverse[hit]]], n) + np.log10(ends + 1.0) - (counts + 1) * np.log10(all_of)
            pairs, tf = np.unique(doc[~hit] * len(distinct) + inverse[~hit], return_counts=True)
            at = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(distinct)))
            rare = pa.StructArray.from_arrays([arrays.signed(distinct[pairs % max(1, len(distinct))]), pa.array(tf, pa.int32())], names=["word", "tf"])
            every = pa.array(np.arange(n))
            waiting.append(
                (
                    ids,
                    np.diff(first),
                    spelled_score,
                    batch.column("doc_id").take(every),  # a copy: a part of the batch would hold its texts
                    batch.column("learn").take(every),
                    pa.array(np.bincount(doc[hit], minlength=n) + int(ends > 0)),
                    pa.array(base),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), rare),
                )
            )
            held += len(ids)
            if held >= ASKED:
                yield from told()
                waiting, held = [], 0
        yield from told()

    form = "doc_id long, learn boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:long,tf:int>>"
    scored = stored(plain.mapInArrow(run, form).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("e")).select("row", F.col("e.word").alias("word"), F.col("e.tf").alias("tf"))
    sums = rare.join(counts, "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("gain"))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "learn",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )
