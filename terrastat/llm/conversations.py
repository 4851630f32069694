"""Repair of conversation structure: cheapest edits by a square-root checkpointed dynamic programme over blocks of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.llm.shared import stored

#: States of the role pattern ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
STATES = 4
#: State after a kept row by its initial (system, user, assistant, other); -1: not allowed.
AFTER = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: State after an inserted or re-roled row, and the role it then has.
NEXT = np.array([2, 2, 3, 2])
NEXT_ROLE = ("user", "user", "assistant", "user")
#: Costs of the edits, and what an undeleted truncated row adds. A conversation may end in the states whose inserts are listed here.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LAST_INSERTS = np.array([0, 2, 1, 0])
END = LAST_INSERTS * INSERT
NEVER = 1 << 40
#: Marks of a row beside its initial (0 to 3): blank, duplicate, truncated, and no row at all.
BLANK, DUPLICATE, CUT, ABSENT = 4, 8, 16, 32
#: Rows of a block: 2 to this power. A block's vectors are kept at every square root of its rows.
BLOCK_BITS = 12
TOGETHER = 256
BLANKS = "\t\n\x0b\x0c\r "


# ------------------------------------------------------------------- blocks


def back(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost to go before one row of each block (inserts included) from the cost to go after it; ``after`` is (blocks, columns, state)."""
    code = code[:, None]
    must, late = (code & (BLANK | DUPLICATE)) > 0, np.where(code & CUT, TRUNCATED, 0)
    move = AFTER[code[:, 0] & 3]
    out = np.empty_like(after)
    for s in range(STATES):
        kept = np.take_along_axis(after, np.maximum(move[:, s], 0)[:, None, None], axis=2)[:, :, 0]
        kept = np.where((move[:, s] < 0)[:, None] | must, NEVER, kept + KEEP + late)
        put = np.where(must, NEVER, after[:, :, NEXT[s]] + REROLE + late)
        out[:, :, s] = np.minimum(np.minimum(kept, put), after[:, :, s] + DELETE)
    u, a = out[:, :, 2].copy(), out[:, :, 3].copy()
    out[:, :, 2], out[:, :, 3] = np.minimum(u, a + INSERT), np.minimum(a, u + INSERT)
    for s in (0, 1):
        out[:, :, s] = np.minimum(out[:, :, s], out[:, :, NEXT[s]] + INSERT)
    return np.where((code & ABSENT)[:, :, None] > 0, after, out)


def transfer(codes: np.ndarray) -> np.ndarray:
    """Cheapest cost through each block from every state to every state."""
    cost = np.full((len(codes), STATES, STATES), NEVER, dtype=np.int64)
    cost[:, np.arange(STATES), np.arange(STATES)] = 0
    for i in range(codes.shape[1] - 1, -1, -1):
        cost = back(codes[:, i], cost)
    return np.minimum(cost, NEVER).transpose(0, 2, 1)


def walk(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Edits of each block from every state it may be entered in: letter (0 to 3 for D, I, K, R) plus 4 times the inserts before the row.

    Going back, cost vectors are stored at every square root of the rows only. Going forward, the vectors between two of them
    are computed again, and the least letter that still leads to the cheapest end is taken.
    """
    n, rows = codes.shape
    step = max(1, int(np.ceil(np.sqrt(rows))))
    marks = {rows: ends[:, None, :].astype(np.int64)}
    cost = marks[rows]
    for i in range(rows - 1, -1, -1):
        cost = back(codes[:, i], cost)
        if i % step == 0:
            marks[i] = cost
    edits = np.zeros((n, STATES, rows), dtype=np.uint8)
    state = np.tile(np.arange(STATES), (n, 1))
    for start in range(0, rows, step):
        stop = min(start + step, rows)
        costs = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            costs.append(back(codes[:, i], costs[-1]))
        costs.reverse()
        for i in range(start, stop):
            before, after = costs[i - start][:, 0], costs[i - start + 1][:, 0]
            code = codes[:, i][:, None]
            late = np.where(code & CUT, TRUNCATED, 0)
            must, absent = (code & (BLANK | DUPLICATE)) > 0, (code & ABSENT) > 0
            inserts = np.zeros((n, STATES), dtype=np.uint8)
            for _ in range(STATES):
                left = np.take_along_axis(before, state, axis=1)
                delete = np.take_along_axis(after, state, axis=1) + DELETE == left
                more = ~absent & ~delete & (np.take_along_axis(before, NEXT[state], axis=1) + INSERT == left)
                if not more.any():
                    break
                inserts += more
                state = np.where(more, NEXT[state], state)
            move = AFTER[codes[:, i] & 3][np.arange(n)[:, None], state]
            keep = ~must & (move >= 0) & (np.take_along_axis(after, np.maximum(move, 0), axis=1) + KEEP + late == left)
            letter = np.where(delete, 0, np.where(keep, 2, 3))
            edits[:, :, i] = letter + 4 * inserts
            state = np.where(absent | delete, state, np.where(keep, move, NEXT[state]))
    return edits


def _padded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch of similar length: their places, codes with absent rows at the end, and lengths."""
    codes = batch.column("codes")
    offsets = codes.offsets.to_numpy()
    flat = codes.values.to_numpy()
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    for i in range(0, len(order), TOGETHER):
        own = order[i : i + TOGETHER]
        grid = np.full((len(own), int(sizes[own].max())), ABSENT, dtype=np.int64)
        for r, b in enumerate(own):
            grid[r, : sizes[b]] = flat[offsets[b] : offsets[b + 1]]
        yield own, grid, sizes[own]


# -------------------------------------------------------------------- Spark


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, gone`` after a fixed damage by ``crc32(conv_id:turn) % 20``; missing values are one blank there.

    0 drops the row (``gone``, so that its conversation stays known), 1 empties the text, 2 takes away ``.``, ``!`` and ``?``, 3 repeats the row,
    4 makes it the user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("how"))
    how = F.col("how")
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(how == 3, 1).otherwise(0)))
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (how == 0).alias("gone"))


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)


def ordered(rows: DataFrame) -> DataFrame:
    """Stored rows with ``at``, ascending along the conversations; long conversations spread over many tasks and files.

    Order: turn (missing first), then SHA-256 of role and text; equal rows are interchangeable and may part.
    """
    keys = ["conv_id", "turn", "digest", "spread"]
    rows = rows.select("conv_id", "turn", "role", "text", "gone", _digest().alias("digest"))
    rows = rows.withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread")
    return stored(placed.withColumn("at", F.monotonically_increasing_id()))


def _blocks(rows: DataFrame) -> DataFrame:
    """``conv_id, first, codes``: up to 4,096 neighbouring rows of one conversation, a byte's worth of marks each."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.coalesce(F.try_subtract(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(1)), F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    light = rows.where(~F.col("gone")).select("conv_id", "at", "digest", initial.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    firsts = light.where(~F.col("blank")).groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    mark = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    marked = light.join(firsts, "at", "left").select("conv_id", "at", (F.col("initial") + mark).cast("int").alias("code"))
    grouped = marked.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("r"))
    return stored(grouped.select("conv_id", F.col("r")[0]["at"].alias("first"), F.col("r.code").alias("codes")))


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = batch.column("first").to_numpy()
        for own, codes, _ in _padded(batch):
            cost = transfer(codes).reshape(len(own), -1)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(own)), pa.array(first[own]), pa.array(cost.tolist(), pa.list_(pa.int64()))], names=["conv_id", "first", "cost"])


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from the last to the first: the cost to go after each, one vector held at a time."""
    known, vector = None, END
    for batch in batches:
        out = []
        for conv, cost in zip(batch.column("conv_id").to_pylist(), batch.column("cost").to_pylist()):
            if known != (conv,):
                known, vector = (conv,), END
            out.append(vector.tolist())
            vector = (np.array(cost).reshape(STATES, STATES) + vector[None]).min(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(out, pa.list_(pa.int64()))], names=["first", "after"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.array(batch.column("after").to_pylist(), dtype=np.int64).reshape(-1, STATES)
        first = batch.column("first").to_numpy()
        for own, codes, sizes in _padded(batch):
            edits = walk(codes, ends[own])
            every = [[edits[i, s, : sizes[i]].tobytes() for s in range(STATES)] for i in range(len(own))]
            marks = [codes[i, : sizes[i]].astype(np.uint8).tobytes() for i in range(len(own))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(pa.array(own)), pa.array(first[own]), pa.array(marks, pa.binary()), pa.array(every, pa.list_(pa.binary()))],
                names=["conv_id", "at", "marks", "edits"],
            )


def planned(rows: DataFrame) -> DataFrame:
    """Rows of ``ordered`` together with the edits of their block, sorted by conversation: what a replay reads from first to last."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = _blocks(rows)
    costs = blocks.mapInArrow(_transfers, f"conv_id {kind}, first long, cost array<long>")
    chained = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first")).mapInArrow(_costs_after, "first long, after array<long>")
    walks = blocks.join(chained, "first").mapInArrow(_walks, f"conv_id {kind}, at long, marks binary, edits array<binary>")
    texts = rows.select("conv_id", "at", F.lit(1).alias("part"), "turn", "role", "text", "gone")
    both = texts.unionByName(walks.withColumn("part", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")


class _Replay:
    """One conversation read from first to last: counts, edits and repaired rows as they come; only the audit grows with it."""

    def __init__(self, conv_id: object):
        self.conv_id, self.state, self.initial = conv_id, 0, None
        self.turns, self.turn, self.low = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0
        self.marks, self.edits, self.place = b"", b"", 0

    def block(self, marks: bytes, edits: list[bytes]) -> None:
        self.marks, self.edits, self.place = marks, edits[self.state], 0

    def insert(self) -> tuple[str, str, str]:
        role = NEXT_ROLE[self.state]
        self.state = int(NEXT[self.state])
        return self.line("I", INSERT, role, "")

    def line(self, letter: str, cost: int, role: str, text: str) -> tuple[str, str, str]:
        self.audit.append(letter)
        self.cost += cost
        self.sha.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1
        return letter, role, text

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Repaired rows ``(edit, role, text)`` that one row brings."""
        mark, edit = self.marks[self.place], self.edits[self.place]
        self.place += 1
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.turn = turn if self.low is None else self.low, turn
        self.blank += (mark & BLANK) > 0
        self.duplicate += (mark & DUPLICATE) > 0
        self.truncated += (mark & CUT) > 0
        pair = None if self.initial is None else self.initial + role[:1]
        self.illegal += pair is not None and pair not in ("su", "ua", "au")
        self.initial = role[:1]
        for _ in range(edit >> 2):
            yield self.insert()
        late = TRUNCATED if mark & CUT else 0
        if edit & 3 == 0:
            self.audit.append("D")
            self.cost += DELETE
        elif edit & 3 == 2:
            self.state = int(AFTER[mark & 3][self.state])
            yield self.line("K", KEEP + late, role, text)
        else:
            put = NEXT_ROLE[self.state]
            self.state = int(NEXT[self.state])
            yield self.line("R", REROLE + late, put, text)

    def finish(self) -> Iterator[tuple[str, str, str]]:
        for _ in range(int(LAST_INSERTS[self.state])):
            yield self.insert()

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _replays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Replay, str | None, str | None, str | None]]:
    """Repaired rows, and at the end of each conversation a row without an edit."""
    now = None
    for batch in batches:
        for conv, part, turn, role, text, gone, marks, edits in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "gone", "marks", "edits")]):
            if now is None or conv != now.conv_id:
                if now is not None:
                    yield from ((now, *line) for line in now.finish())
                    yield now, None, None, None
                now = _Replay(conv)
            if part == 0:
                now.block(marks, edits)
            elif not gone:
                yield from ((now, *line) for line in now.row(turn, role, text))
    if now is not None:
        yield from ((now, *line) for line in now.finish())
        yield now, None, None, None


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, sized: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[sized]) if sized is not None else 0
        if len(held) == 4096 or size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired rows of ``ordered``-ready conversations (``conv_id, turn, role, text, gone``)."""
    plan = planned(ordered(conversations))
    kind = plan.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows(first: pa.RecordBatch) -> Iterator[tuple]:
            for now, edit, role, text in _replays(_chain(first, batches)):
                if edit is not None:
                    yield now.conv_id, now.lines - 1, edit, role, text

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            yield from _in_batches(rows(batch), schema, 4)

    return plan.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of each conversation (``conv_id, turn, role, text, gone``).

    Rows stand in the order of ``ordered``. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (the last
    character that is no blank is none of ``.!?``). Edits: keep 0, another role 2, delete 3 (required for blank and duplicate
    rows), insert an empty row 2; truncated rows that stay add 1. The audit has the initials of the cheapest edits that give roles ``(s?(ua)+)?``, and
    of equal cost the least in ASCII order.

    Blocks of up to 4,096 neighbouring rows are reduced to the cost from state to state, which a chain per conversation turns into the cost after each
    block; then every block is walked on its own, from each state it may be entered in, and a last pass reads each
    conversation from first to last for the digest, which no other order can give, holding one batch of rows.

    Missing ids are one conversation; missing roles and texts count as they come (``damaged`` makes them a blank); missing turns come first
    and are left out of ``gaps``. Repeated rows are duplicates. A conversation whose rows are all ``gone`` has zeros, an empty audit and the
    digest of nothing. An empty table gives no rows; other columns are ignored.
    """
    plan = planned(ordered(conversations))
    kind = plan.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            ends = (now.report() for now, edit, *_ in _replays(_chain(first, batches)) if edit is None)
            yield from _in_batches(ends, schema, 7)

    return plan.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
