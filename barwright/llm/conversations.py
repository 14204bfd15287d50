"""Repair of the structure of conversations by run-length dynamic programming.

A conversation is a row of symbols, what kind of role a turn has and what is wrong with it. Equal
symbols in a row are one run. What a turn costs, from each state of the order of roles to each other
one, is a small matrix in min-plus arithmetic, insertions before the turn included; a run is passed
by the binary powers of its matrix, kept once computed. From the end back these give the cost of the
rest at each run, by which the edits are then read off from the start on.

Turns are put in order by ranges, so a conversation of any length is spread over tasks in parts.
Parts of cut conversations, at most two for each task, are joined by their matrices, read off from
every state, and chosen by where the part before them ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm import flat
from barwright.scratch import stored

SPACES = " \t\n\x0b\x0c\r"
#: What edits cost: deleting a turn, inserting an empty one, giving another role, and leaving a turn
#: that is cut off.
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
#: Turns of a run that are read off together.
BLOCK = 4096

# roles are other, system, user, assistant; faults are none, blank, duplicate, truncated
_NAMES = ("", "system", "user", "assistant")
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
# states are begun, and after a system, user or assistant turn; it may end in the first and last
_FOLLOWS = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
_ASKED = (2, 2, 3, 2)
_THEN = tuple(_FOLLOWS[s, _ASKED[s]] for s in range(4))
_END = (0, 2 * INSERT, INSERT, 0)
_STATES, _NEVER = range(4), 1 << 60
# what a symbol allows: 0 is a turn that must go, else one more than twice the role, plus one if cut off
_CLASS = np.array([0 if fault in (_BLANK, _DUPLICATE) else 1 + 2 * role + (fault == _TRUNCATED) for role in range(4) for fault in range(4)])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True

Vector = tuple[int, ...]


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of ``turns``, damaged in fixed ways by a hash of the first two: of
    twenty turns, about one each is dropped, emptied, robbed of its ends of sentences, repeated, and
    given to the user. A null role or text is one space, as nulls are in what is hashed."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = turns.filter(fate != 0).select(
        "conv_id",
        "turn",
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    )
    return changed.drop("copy")


def in_order(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, part, pos, turn, role, text`` of all turns, and ``conv_id, part, pos, symbol``.

    Turns of a conversation are in order by ``turn``, nulls first; those of one turn by role, by the
    first 64 characters of the text and by its hash. ``pos`` grows along a conversation, ``part`` is the
    task that put its rows in order. Null ids are one conversation; a null role or text is one space.
    ``symbol`` is four times the kind of role plus the first fault: blank, repeated (role and text were
    there before) or truncated. Repeated rows stay, other columns are left out, an empty table gives
    empty ones; conversations and texts may have any length.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # rows that are equal in all of it are spread by their number
    order = ["conv_id", "turn", "role", F.left("text", F.lit(64)), F.md5("text"), "spread"]
    rows = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
    rows = stored(rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "turn", "role", "text"), "turns")

    told_apart = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    first = rows.groupBy("conv_id", told_apart.alias("content")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    kind = F.left("role", F.lit(1))
    code = F.when(kind == "s", 1).when(kind == "u", 2).when(kind == "a", 3).otherwise(0)
    fault = F.when(trimmed == "", _BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), _TRUNCATED).otherwise(0)
    narrow = rows.select("conv_id", "part", "pos", code.alias("code"), fault.alias("fault"))
    seen = narrow.join(first, "pos", "left")
    repeated = F.when((F.col("fault") != _BLANK) & F.col("first").isNull(), _DUPLICATE).otherwise(F.col("fault"))
    symbols = seen.select("conv_id", "part", "pos", (4 * F.col("code") + repeated).cast("byte").alias("symbol"))
    return rows, symbols


def repair(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``conv_id, part, start, audit, cost, blank, duplicate, truncated, illegal`` of each part of a
    conversation, from the tables of :func:`in_order`.

    ``audit`` has the initials of the cheapest edits in order (delete, insert, keep, rerole), the
    least one of equally cheap ones, that leave roles in order: nothing, or a system turn or none and
    then user and assistant in turns. Blank and repeated turns have to go. ``start`` is the state that
    the part before it ends in. ``cost`` is that from this part on. ``illegal`` counts neighbours that
    do not follow each other, the last turn of the part before it included.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"])
    parts = symbols.groupBy("conv_id", "part").agg(ordered.alias("symbols"))
    whole = Window.partitionBy("conv_id")
    along = whole.orderBy("part")
    parts = parts.select(
        "conv_id",
        "part",
        "symbols",
        F.lag(F.element_at("symbols", -1)).over(along).alias("before"),
        F.lead("part").over(along).isNull().alias("last"),
    )
    parts = stored(parts, "parts")
    cut = parts.filter("before is not null or not last")
    kind = parts.schema["conv_id"].dataType.simpleString()
    passed = cut.mapInArrow(_passed, f"conv_id {kind}, part int, costs array<bigint>")
    chains = passed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("chain"))
    ends = chains.mapInArrow(_ends, f"c {kind}, p int, rest array<bigint>")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    # at most two rows for each task that put turns in order
    known = parts.join(F.broadcast(ends), same, "left").select("conv_id", "part", "symbols", "before", "rest")
    schema = f"conv_id {kind}, part int, whole boolean, costs array<bigint>, exits array<int>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    read = stored(known.mapInArrow(_read_off, schema), "audits")
    exits = read.filter("not whole").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "exits"))).alias("chain"))
    starts = exits.mapInArrow(_starts, f"c {kind}, p int, start int")
    chosen = read.join(F.broadcast(starts), same, "left").withColumn("start", F.coalesce("start", F.lit(0)))
    return chosen.select("conv_id", "part", "start", F.get("audits", "start").alias("audit"), F.get("costs", "start").alias("cost"), "blank", "duplicate", "truncated", "illegal")


def conversations(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation, from
    the tables of :func:`in_order` and :func:`repair`. ``gaps`` are the numbers between the least and
    the largest turn that none has; 0 if all are null."""
    counts = ["blank", "duplicate", "truncated", "illegal"]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    told = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], F.min_by("cost", "part").alias("cost"), audit.alias("audit"))
    turns = rows.filter("turn is not null").select("conv_id", "turn").distinct()
    wide = "decimal(38,0)"
    between = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("*").cast(wide)
    gaps = turns.groupBy("conv_id").agg(between.cast("bigint").alias("gaps"))
    told = told.select("conv_id", F.lit(None).cast("bigint").alias("gaps"), *counts, "cost", "audit")
    nothing = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in [*counts, "cost", "audit"]]
    both = told.union(gaps.select("conv_id", "gaps", *nothing)).groupBy("conv_id")
    return both.agg(F.coalesce(F.max("gaps"), F.lit(0)).alias("gaps"), *[F.max(c).alias(c) for c in [*counts, "cost", "audit"]])


def repaired(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``conv_id, part, line, edit, role, text``: the turns that are left, edited, by ``part`` and
    ``line`` within a conversation; an inserted one has an empty text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = _beside(rows, parts).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return flat.in_small_batches(dealt).mapInArrow(_lines, f"conv_id {kind}, part int, line int, edit string, role string, text string")


def digests(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the SHA-256 of the ``role:text`` of the turns that are left, joined
    by line breaks. A digest takes its text in order, so each conversation passes through one task,
    in a stream of which only a batch is held."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = _beside(rows, parts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return flat.in_small_batches(dealt).mapInArrow(_digested, f"conv_id {kind}, repaired_sha256 string")


def _beside(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns, and before those of each part its edits."""
    nothing = F.lit(None).cast("string")
    edits = parts.select("conv_id", "part", F.lit(-1).cast("bigint").alias("pos"), "start", "audit", nothing.alias("role"), nothing.alias("text"))
    return edits.union(rows.select("conv_id", "part", "pos", F.lit(None).cast("int"), nothing, "role", "text"))


# ---- costs and edits of one part


def _times(a: list[Vector], b: list[Vector]) -> list[Vector]:
    return [tuple(min(_NEVER, *(row[k] + b[k][t] for k in _STATES)) for t in _STATES) for row in a]


def _applied(a: list[Vector], v: Vector) -> Vector:
    return tuple(min(row[t] + v[t] for t in _STATES) for row in a)


def _moves(cls: int, state: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a turn in a state, by the initial: the cost and the state after it."""
    yield "D", DELETE, state
    if cls:
        role, cut = divmod(cls - 1, 2)
        if (state, role) in _FOLLOWS:
            yield "K", CUT_OFF * cut, _FOLLOWS[state, role]
        yield "R", REROLE + CUT_OFF * cut, _THEN[state]


@lru_cache(maxsize=1024)
def _power(cls: int, k: int) -> list[Vector]:
    """The costs of 2**k turns of a class, from each state to each other one."""
    if k:
        return _times(_power(cls, k - 1), _power(cls, k - 1))
    insertions = [tuple(0 if s == t else _NEVER for t in _STATES) for s in _STATES]
    one = [tuple(0 if s == t else INSERT if t == _THEN[s] else _NEVER for t in _STATES) for s in _STATES]
    for _ in _STATES:
        insertions = _times(insertions, one)
    turn = []
    for s in _STATES:
        costs = [_NEVER] * 4
        for _, cost, t in _moves(cls, s):
            costs[t] = min(costs[t], cost)
        turn.append(tuple(costs))
    return _times(insertions, turn)


def _bits(n: int) -> Iterator[int]:
    return (k for k in range(n.bit_length()) if n >> k & 1)


def _rest_before(cls: int, turns: int, rest: Vector) -> Vector:
    """The cost of the rest from each state before a run, by that after it."""
    for k in _bits(turns):
        rest = _applied(_power(cls, k), rest)
    return rest


@lru_cache(maxsize=65536)
def _choices(cls: int, rest: Vector) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """The cost of the rest before a turn, and for each state the cheapest edits up to the turn, the
    least by name of equally cheap ones, and the state after it."""
    before = _applied(_power(cls, 0), rest)
    chosen = []
    for s in _STATES:
        edits = ""
        while True:
            moves = [(name, t) for name, cost, t in _moves(cls, s) if cost + rest[t] == before[s]]
            if moves and moves[0][0] == "D":
                break
            if INSERT + before[_THEN[s]] == before[s]:
                edits, s = edits + "I", _THEN[s]
            else:
                break
        chosen.append((edits + moves[0][0], moves[0][1]))
    return before, tuple(chosen)


def _runs(symbols: np.ndarray) -> list[tuple[int, int]]:
    """``(class, turns)`` of each run."""
    classes = _CLASS[symbols]
    at = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    return list(zip(classes[at].tolist(), np.diff(np.append(at, len(classes))).tolist(), strict=True))


def _unrolled(symbols: np.ndarray, rest: Vector | None, starts: tuple[int, ...]) -> tuple[list[int], list[int], list[str]]:
    """For each state to start from: the cost from there on, the state at the end, and the edits.
    ``rest`` is the cost of what follows from each state, None if nothing does."""
    runs = _runs(symbols)
    after, v = [], _END if rest is None else rest
    for cls, turns in reversed(runs):
        after.append(v)
        v = _rest_before(cls, turns, v)
    states, edits = list(starts), [[] for _ in starts]
    for (cls, turns), end in zip(runs, reversed(after), strict=True):
        while turns:
            block = (turns - 1) % BLOCK + 1
            turns -= block
            w = _rest_before(cls, turns, end)
            steps = []
            for _ in range(block):
                least = min(w)  # costs count by their differences
                w, chosen = _choices(cls, tuple(x - least for x in w))
                steps.append(chosen)
            for chosen in reversed(steps):
                for k, s in enumerate(states):
                    edit, states[k] = chosen[s]
                    edits[k].append(edit)
    if rest is None:
        for k, s in enumerate(states):
            edits[k].append("I" * (_END[s] // INSERT))
            states[k] = 3 if s else 0
    return [v[s] for s in starts], states, ["".join(e) for e in edits]


@lru_cache(maxsize=1 << 14)
def _short(symbols: bytes) -> tuple[list[int], list[int], list[str]]:
    return _unrolled(np.frombuffer(symbols, np.int8), None, (0,))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = []
        for symbols in _lists(batch.column(2)):
            matrix = [tuple(0 if s == t else _NEVER for t in _STATES) for s in _STATES]
            for cls, turns in _runs(symbols):
                for k in _bits(turns):
                    matrix = _times(matrix, _power(cls, k))
            costs.append([c for row in matrix for c in row])
        yield pa.record_batch({"conv_id": batch.column(0), "part": batch.column(1), "costs": pa.array(costs, pa.list_(pa.int64()))})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost of what follows each part of a conversation but the last."""
    for batch in batches:
        for row in range(batch.num_rows):
            rest, parts, rests = _END, [], []
            chain = batch.column(1)[row].as_py()
            for step, following in zip(chain[-2::-1], chain[:0:-1], strict=True):
                costs = following["costs"]
                rest = _applied([tuple(costs[k : k + 4]) for k in range(0, 16, 4)], rest)
                parts.append(step["part"])
                rests.append(list(rest))
            ids = batch.column(0).take(pa.array([row] * len(parts), pa.int32()))
            yield pa.record_batch({"c": ids, "p": pa.array(parts, pa.int32()), "rest": pa.array(rests, pa.list_(pa.int64()))})


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each part of a conversation starts in."""
    for batch in batches:
        for row in range(batch.num_rows):
            state, parts, starts = 0, [], []
            for step in batch.column(1)[row].as_py():
                parts.append(step["part"])
                starts.append(state)
                state = step["exits"][state]
            ids = batch.column(0).take(pa.array([row] * len(parts), pa.int32()))
            yield pa.record_batch({"c": ids, "p": pa.array(parts, pa.int32()), "start": pa.array(starts, pa.int32())})


def _read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, rests = batch.column(3).to_pylist(), batch.column(4)
        out: dict[str, list] = {name: [] for name in ("whole", "costs", "exits", "audits", "blank", "duplicate", "truncated", "illegal")}
        for row, symbols in enumerate(_lists(batch.column(2))):
            rest = tuple(rests[row].as_py()) if rests[row].is_valid else None
            begins = before[row] is None
            if begins and rest is None and len(symbols) <= 64:
                read = _short(symbols.tobytes())
            else:
                read = _unrolled(symbols, rest, (0,) if begins else tuple(_STATES))
            faults, roles = symbols & 3, symbols >> 2
            follows = roles if begins else np.append(before[row] >> 2, roles)
            counts = np.bincount(faults, minlength=4)
            values = (begins and rest is None, *read, *counts[1:].tolist(), int((~_LEGAL[follows[:-1], follows[1:]]).sum()))
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        types = {"whole": pa.bool_(), "costs": pa.list_(pa.int64()), "exits": pa.list_(pa.int32()), "audits": pa.list_(pa.string())}
        columns = {name: pa.array(values, types.get(name, pa.int64())) for name, values in out.items()}
        yield pa.record_batch({"conv_id": batch.column(0), "part": batch.column(1), **columns})


# ---- turns that are left


class _Part:
    """The edits of a part, taken turn by turn."""

    def __init__(self, start: int, audit: str):
        self.state, self.audit, self.at = start, audit, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._asked(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._asked(), text
        elif edit == "K":
            self.state = _FOLLOWS[self.state, "sua".index(role[0]) + 1]
            yield edit, role, text

    def _asked(self) -> str:
        role = _NAMES[_ASKED[self.state]]
        self.state = _THEN[self.state]
        return role


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``conv_id, part`` and edit, role and text of what is left; for each part first one with none."""
    part, name = _Part(0, ""), (None, None)
    for batch in batches:
        ids, parts, _, starts, audits, roles, texts = (c.to_pylist() for c in batch.columns)
        for conv, at, start, audit, role, text in zip(ids, parts, starts, audits, roles, texts, strict=True):
            if audit is not None:
                for line in part.inserted():  # after the last turn
                    yield *name, line
                part, name = _Part(start, audit), (conv, at)
                yield *name, None
            else:
                for line in part.turn(role, text):
                    yield *name, line
    for line in part.inserted():
        yield *name, line


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, rows, line, held = None, [], 0, 0

    def table() -> pa.RecordBatch:
        names = ("conv_id", "part", "line", "edit", "role", "text")
        return pa.record_batch([pa.array([r[k] for r in rows], schema[k]) for k in range(6)], names=names)

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for batch in batches:
            schema = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield batch

    for conv, part, what in _edited(watched()):
        line = line + 1 if what else -1
        if what:
            rows.append((conv, part, line, *what))
            held += len(what[2])
        if len(rows) >= 4096 or held > flat.CHUNK_BYTES:
            yield table()
            rows, held = [], 0
    if rows:
        yield table()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, ids, values, current, digest, any_line = None, [], [], (), None, False

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    def table() -> pa.RecordBatch:
        return pa.record_batch({"conv_id": pa.array(ids, kind), "repaired_sha256": pa.array(values, pa.string())})

    for conv, _, what in _edited(watched()):
        if what is None:
            if (conv,) != current:
                if current:
                    ids.append(current[0])
                    values.append(digest.hexdigest())
                current, digest, any_line = (conv,), hashlib.sha256(), False
                if len(ids) >= 4096:
                    yield table()
                    ids, values = [], []
            continue
        _, role, text = what
        joint = "\n" if any_line else ""
        digest.update(f"{joint}{role}:{text}".encode())
        any_line = True
    if current:
        ids.append(current[0])
        values.append(digest.hexdigest())
        yield table()
