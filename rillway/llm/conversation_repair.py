"""Conversations brought into turn order by the cheapest edits, found by a Viterbi search that emits early.

The states are what the repaired roles spell so far. Every state keeps one survivor, the cheapest and
among equals ASCII-least edits that lead to it. Survivors are leaves of a tree of back pointers with
reference counts; as soon as they share an ancestor, the edits up to there are certain and leave.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.sources.fields import named

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
ROLE = {"u": "user", "a": "assistant"}

# Repaired roles spell (s?(ua)+)?: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STEP = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# The role that an edit may choose, user or assistant, follows from the state.
CHOSEN = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
# What ends a conversation in each state: inserted turns.
CLOSING = {EMPTY: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}
# EXCESS[p][q]: whatever follows, p can be completed for at most so much more than q.
EXCESS = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))

# Unresolved texts beyond so many bytes wait in a file of the task.
SPOOL_BYTES = 16 << 20
BATCH_BYTES = 4 << 20


def _moves(state: int, initial: str) -> list[tuple[str, int, int]]:
    """(edits, next state, cost) that keep or rename a row.

    Inserted turns come right before a row that stays, as one that is inserted before deleted rows
    spells a greater text at the same cost; two before one row cost more than the detour is worth.
    """
    out = []
    for before in ("", INSERT):
        at = STEP[state][CHOSEN[state]] if before else state
        cost = COST[INSERT] * len(before)
        if initial in STEP[at]:
            out.append((before + KEEP, STEP[at][initial], cost + COST[KEEP]))
        out.append((before + REROLE, STEP[at][CHOSEN[at]], cost + COST[REROLE]))
    return out


MOVES = {(state, initial): _moves(state, initial) for state in STEP for initial in "sua"}
_OTHER = {state: _moves(state, "") for state in STEP}


class Node:
    """A run of one edit. ``refs`` counts its children, and itself once while it is a survivor."""

    __slots__ = ("parent", "edit", "run", "refs", "depth")

    def __init__(self, parent: Node | None, edit: str = ""):
        self.parent, self.edit, self.run, self.refs = parent, edit, 1, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _less(a: Node, a_edits: str, b: Node, b_edits: str) -> bool:
    """Whether the edits of survivor a, then ``a_edits``, spell less than those of b.

    Both spell edits of the same rows and end in a row's edit, so neither begins the other. What both
    have in common is cut off at their last common ancestor; all the rest is compared, run by run.
    """
    one, other = [(e, 1) for e in reversed(a_edits)], [(e, 1) for e in reversed(b_edits)]
    while a is not b:
        if a.depth >= b.depth:
            one.append((a.edit, a.run))
            a = a.parent
        else:
            other.append((b.edit, b.run))
            b = b.parent
    left = right = 0
    while True:
        if not left:
            if not one:
                return bool(other or right)
            x, left = one.pop()
        if not right:
            if not other:
                return False
            y, right = other.pop()
        if x != y:
            return x < y
        both = min(left, right)
        left, right = left - both, right - both


class Survivors:
    """The search over one conversation. ``push`` takes a row and gives the edits that became certain."""

    def __init__(self):
        self.root = Node(None)
        self.root.refs = 1
        self.best = {EMPTY: (0, self.root)}

    def push(self, initial: str, must_delete: bool, truncated: bool) -> Iterator[tuple[str, int]]:
        found: dict[int, tuple[int, Node, str]] = {}
        for state, (cost, node) in self.best.items():
            moves = [(DELETE, state, COST[DELETE])]
            if not must_delete:
                extra = TRUNCATED_COST * truncated
                moves += [(e, q, c + extra) for e, q, c in MOVES.get((state, initial), _OTHER[state])]
            for edits, q, more in moves:
                new = (cost + more, node, edits)
                old = found.get(q)
                if old is None or new[0] < old[0] or new[0] == old[0] and _less(node, edits, old[1], old[2]):
                    found[q] = new
        # A state that another beats whatever follows will not be in the cheapest edits.
        found = {
            q: f for q, f in found.items() if all(found[p][0] + EXCESS[p][q] >= f[0] for p in found)
        }
        uses = Counter(id(node) for _, node, _ in found.values())
        before, self.best = self.best, {}
        for q, (cost, node, edits) in found.items():
            leaf = node
            for edit in edits:
                if leaf is node and leaf is not self.root and uses[id(node)] == 1 and leaf.edit == edit:
                    leaf.run += 1
                else:
                    leaf = Node(leaf, edit)
            leaf.refs += 1
            self.best[q] = (cost, leaf)
        for _, node in before.values():
            self._release(node)
        yield from self._certain()

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent:
            node = node.parent
            node.refs -= 1

    def _certain(self) -> Iterator[tuple[str, int]]:
        """Edits from the root to the last ancestor of all survivors, which becomes the root."""
        if self.root.refs != 1:
            return
        path, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while self.root.refs == 1 and path:
            self.root = path.pop()
            self.root.parent = None
            yield self.root.edit, self.root.run

    def finish(self) -> Iterator[tuple[str, int]]:
        last = None
        for state, (cost, node) in self.best.items():
            new = (cost + COST[INSERT] * len(CLOSING[state]), node, CLOSING[state])
            if last is None or new[0] < last[0] or new[0] == last[0] and _less(node, new[2], last[1], last[2]):
                last = new
        _, node, edits = last
        path = []
        while node is not self.root:
            path.append((node.edit, node.run))
            node = node.parent
        yield from reversed(path)
        yield from ((e, 1) for e in edits)


class Waiting:
    """Rows whose edit is not certain yet, in order; beyond a bound their texts wait in a file."""

    def __init__(self, most: int = SPOOL_BYTES):
        self.rows: deque[tuple] = deque()
        self.held, self.most, self.file = 0, most, None

    def push(self, row: tuple, text: str | None) -> None:
        place = None
        if text is not None:
            if self.held + len(text) <= self.most:
                self.held += len(text)
            else:
                self.file = self.file or tempfile.TemporaryFile()
                data = text.encode("utf-8", "surrogatepass")
                place, text = (self.file.seek(0, 2), len(data)), None
                self.file.write(data)
        self.rows.append((*row, text, place))

    def pop(self) -> tuple:
        *row, text, place = self.rows.popleft()
        if place:
            self.file.seek(place[0])
            text = self.file.read(place[1]).decode("utf-8", "surrogatepass")
        elif text is not None:
            self.held -= len(text)
        if self.file and not self.rows:
            self.file.close()
            self.file = None
        return (*row, text)


def edits_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edits of one conversation's rows (turn, role, text, fault), in order, as they become certain.

    Gives (edit, turn, role, text, old_role, fault, cost); deleted rows lose role and text.
    """
    search, waiting, state = Survivors(), Waiting(), EMPTY

    def made(certain: Iterator[tuple[str, int]]) -> Iterator[tuple]:
        nonlocal state
        for edit, run in certain:
            for _ in range(run):
                if edit == INSERT:
                    state = STEP[state][CHOSEN[state]]
                    yield edit, None, ROLE["u" if state == USER else "a"], "", None, None, COST[edit]
                    continue
                turn, old, fault, text = waiting.pop()
                if edit == DELETE:
                    yield edit, turn, None, None, old, fault, COST[edit]
                    continue
                state = STEP[state][old[:1] if edit == KEEP else CHOSEN[state]]
                role = old if edit == KEEP else ROLE["u" if state == USER else "a"]
                yield edit, turn, role, text, old, fault, COST[edit] + TRUNCATED_COST * (fault == "truncated")

    for turn, role, text, fault in rows:
        must_delete = fault in ("blank", "duplicate")
        waiting.push((turn, role, fault), None if must_delete else text)
        yield from made(search.push(role[:1], must_delete, fault == "truncated"))
    yield from made(search.finish())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        # Row by row: a batch may hold long texts.
        yield from zip(*((v.as_py() for v in c) for c in batch.columns))


def _by_conversation(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its rows) for rows that lie together; the rows are read as they are used."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def same() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        yield key, same()


_EDIT_FIELDS = [
    ("place", T.LongType(), pa.int64()), ("edit", T.StringType(), pa.string()), ("turn", T.LongType(), pa.int64()),
    ("role", T.StringType(), pa.string()), ("text", T.StringType(), pa.string()), ("old_role", T.StringType(), pa.string()),
    ("fault", T.StringType(), pa.string()), ("cost", T.LongType(), pa.int64()),
]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    kind = pa.null()

    def typed(batches):
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    def packed() -> pa.RecordBatch:
        kinds = [kind, *(arrow for _, _, arrow in _EDIT_FIELDS)]
        columns = [pa.array(c, k) for c, k in zip(zip(*held), kinds)]
        held.clear()
        return pa.record_batch(columns, ["conv", *(name for name, _, _ in _EDIT_FIELDS)])

    size = 0
    for conv, rows in _by_conversation(_rows(typed(batches))):
        for place, made in enumerate(edits_of(rows)):
            held.append((conv, place, *made))
            size += len(made[3] or "") + 100
            if size > BATCH_BYTES:
                yield packed()
                size = 0
    if held:
        yield packed()


def with_faults(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, fault), the rows of a conversation together and in order of turn.

    A null role or text is one space. Rows of one turn go by role and text, so that equal rows are
    adjacent; nulls come first. ``fault`` is the first of blank (no character but white space),
    duplicate (role and text seen earlier), truncated (last such character not one of ``.!?``).
    One shuffle, by conversation; a sort that spills, no group in memory.
    """
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    filled = lambda c: F.coalesce(named(c), F.lit(" "))
    rows = turns.select(
        named(conv).alias("conv"), named(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text")
    ).repartition("conv")
    same = Window.partitionBy("conv", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy("turn")
    seen = rows.withColumn("seen", F.row_number().over(same))
    ordered = seen.sortWithinPartitions("conv", "turn", "role", "text", "seen")
    fault = (
        F.when(body == "", "blank")
        .when(F.col("seen") > 1, "duplicate")
        .when(~F.substring(body, -1, 1).isin(*ENDS), "truncated")
    )
    return ordered.select("conv", "turn", "role", "text", fault.alias("fault"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, edit, turn, role, text, old_role, fault, cost): the cheapest edits, in order.

    Edits: K keeps a row (0), R gives it the role user or assistant (2), D deletes it (3, required for
    blank rows and duplicates), I inserts an empty turn (2); a truncated row that stays costs 1 more.
    The roles that stay begin with s, u, a so that they spell ``(s?(ua)+)?``; of equally cheap edits
    the ASCII-least are taken. Any other role, also an empty one, fits nowhere as it is. The repaired
    conversation is the rows with a role, by ``place``.

    The null conversation is one like others; conversations without rows give none; other columns
    are left out, whatever their names. A conversation streams through one task, which keeps only what
    is not certain yet: a run of equal edits per survivor, and rows whose texts go to a file of the task
    beyond ``SPOOL_BYTES``. A lost executor recomputes from the shuffle.
    """
    rows = with_faults(turns, conv, turn, role, text)
    schema = T.StructType([rows.schema["conv"], *[T.StructField(name, kind) for name, kind, _ in _EDIT_FIELDS]])
    return rows.mapInArrow(_repaired, schema)


_SUMMARY = [
    *[(name, T.LongType(), pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", T.StringType(), pa.string()), ("repaired_sha256", T.StringType(), pa.string()),
]
LEGAL = {"su", "ua", "au"}


def _one_summary(edits: Iterator[tuple]) -> tuple:
    faults, turns, illegal, cost = Counter(), 0, 0, 0
    first = last = before = None
    audit, digest, begun = bytearray(), hashlib.sha256(), False
    for _, edit, turn, role, text, old_role, fault, price in edits:
        audit += edit.encode()
        cost += price
        if edit != INSERT:
            faults[fault] += 1
            illegal += before is not None and before[:1] + old_role[:1] not in LEGAL
            before = old_role
            if turn is not None:
                turns += turn != last
                first, last = turn if first is None else first, turn
        if role is not None:
            digest.update((begun * "\n" + role + ":" + text).encode("utf-8", "surrogatepass"))
            begun = True
    gaps = last - first + 1 - turns if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit.decode(), digest.hexdigest()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.null()

    def typed(batches):
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    names = ["conv", *(name for name, _, _ in _SUMMARY)]

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), [kind, *(k for _, _, k in _SUMMARY)])], names)

    held, size = [], 0
    for conv, edits in _by_conversation(_rows(typed(batches))):
        held.append((conv, *_one_summary(edits)))
        size += len(held[-1][-2]) + 200
        if size > BATCH_BYTES:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def summarise(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: what was wrong, the cost, the edits, a digest of the result.

    It reads the edits as ``repair`` gives them, in order, without a further shuffle. The digest is
    SHA-256 over one text, which only one task can compute; it holds no more than a row of it.
    """
    schema = T.StructType([edits.schema["conv"], *[T.StructField(name, kind) for name, kind, _ in _SUMMARY]])
    return edits.mapInArrow(_summaries, schema)


def no_summary(summary: DataFrame) -> list[Column]:
    """The columns of a summary, with the values of a conversation without rows where there is none."""
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return [F.coalesce(F.col(name), empty.get(name, F.lit(0))).alias(name) for name, _, _ in _SUMMARY]
