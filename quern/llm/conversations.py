"""Structure repair of conversations: faults of rows, and the cheapest edits that give a well-formed order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits. A truncated row that stays costs as much as one that is inserted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: what the repaired part ends with. It may end with nothing at all or with an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What is missing where a conversation ends in a state.
MISSING = {NOTHING: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
#: SLACK[a][b]: whatever follows a path in state b, a path in state a can be continued for no more than this above it.
SLACK = {
    NOTHING: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {NOTHING: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {NOTHING: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {NOTHING: DELETE, SYSTEM: 0, USER: INSERT},
}
LEGAL = {"su", "ua", "au"}
#: Results of a batch.
BATCH = 4096


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as they arrive after damage that CRC32 of ``conv_id:turn`` chooses, of 20 cases:
    0 drops a row (it stays as ``dropped``, for its conversation's sake), 1 empties its text, 2 takes out its marks,
    3 repeats it, 4 makes its role ``user``. A null is read as one space, but a null turn stays null for the order."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(case <= 1, "").when(case == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(case == 0, "").when(case == 4, "user").otherwise(space("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (case == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def faulted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``, in order within a conversation, all of which is in one partition: blank (no character but ASCII
    white space), duplicate (an earlier row of the conversation has its role and text), truncated (the last such
    character is none of ``.!?``) or null, the first that applies.

    Rows stand by turn, null first, then by role and text. A conversation is sorted on disk if it must be, never gathered.
    """
    whole = rows if "dropped" in rows.columns else rows.withColumn("dropped", F.lit(False))
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    fault = (
        F.when(F.col("dropped"), None)
        .when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return whole.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)))


@dataclass(slots=True)
class Edit:
    """A node of the backpointer tree; ``held`` counts the edits and survivors that hang on it."""

    parent: Edit | None
    letter: str
    role: str | None = None
    text: str | None = None
    held: int = 1


@dataclass(slots=True)
class Survivor:
    cost: int
    last: Edit
    order: int


@dataclass(slots=True)
class Repair:
    """The cheapest edits of one conversation as its rows pass, ASCII-least among ties.

    A survivor is kept for each state that can still win. Their edits form a tree; a node on which nothing hangs any more goes
    at once, and edits that all survivors share are decided: ``row`` hands them on and forgets them. So what is held is
    the stretch of rows over which survivors still differ.

    Survivors that tie are compared by all their unresolved edits. Each ends with an edit of the latest row, so none
    begins another, and whichever is less stays less with any edits that follow: ``order`` holds that comparison, and a row
    extends it by the letters that it adds.
    """

    root: Edit = field(default_factory=lambda: Edit(None, ""))
    alive: dict[int, Survivor] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.alive[NOTHING] = Survivor(0, self.root, 0)

    def row(self, role: str, text: str, fault: str | None) -> Iterator[Edit]:
        """Take the next row; the edits that it decides."""
        best: dict[int, tuple] = {}
        for state, path in self.alive.items():
            inserted: list[int] = []
            for _ in range(3):
                for price, letter, to, name in _choices(state, role, fault):
                    new = (path.cost + INSERT * len(inserted) + price, path.order, "I" * len(inserted) + letter, inserted, path.last, name)
                    if to not in best or new[:3] < best[to][:3]:
                        best[to] = new
                state = AFTER[state]
                inserted = [*inserted, state]
        beaten = {b for b, x in best.items() for a, y in best.items() if a != b and x[0] > y[0] + SLACK[a][b]}
        before, self.alive = self.alive, {}
        for order, (state, (cost, _, letters, inserted, last, name)) in enumerate(sorted(best.items(), key=lambda x: x[1][1:3])):
            if state not in beaten:
                last = Edit(self._inserted(last, inserted), letters[-1], name, text)
                last.parent.held += 1
                self.alive[state] = Survivor(cost, last, order)
        for path in before.values():
            self._release(path.last)
        return self._decided()

    def finish(self) -> tuple[int, Iterator[Edit]]:
        """The cost, and the edits that were not decided yet."""
        ends = {s: (p.cost + INSERT * len(MISSING[s]), p.order) for s, p in self.alive.items()}
        state = min(ends, key=ends.get)
        last = self._inserted(self.alive[state].last, MISSING[state])
        return ends[state][0], iter(self._between(last))

    def _inserted(self, last: Edit, states: list[int]) -> Edit:
        for s in states:
            last.held += 1
            last = Edit(last, "I", NAMES[s], "", 0)
        return last

    def _release(self, edit: Edit) -> None:
        edit.held -= 1
        while edit.held == 0 and edit is not self.root:
            edit = edit.parent
            edit.held -= 1

    def _between(self, last: Edit) -> list[Edit]:
        """The edits after the root, up to ``last``."""
        edits = []
        while last is not self.root:
            edits.append(last)
            last = last.parent
        return edits[::-1]

    def _decided(self) -> Iterator[Edit]:
        if self.root.held > 1:
            return
        for edit in self._between(next(iter(self.alive.values())).last):
            self.root, edit.parent = edit, None
            yield edit
            if edit.held > 1 or any(p.last is edit for p in self.alive.values()):
                return


def _choices(state: int, role: str, fault: str | None) -> Iterator[tuple[int, str, int, str | None]]:
    """``(cost, letter, next state, new role)`` of each edit of a row."""
    yield DELETE, "D", state, None
    if fault not in ("blank", "duplicate"):
        more, to = TRUNCATED if fault == "truncated" else 0, AFTER[state]
        if role[:1] == NAMES[to][0]:
            yield more, "K", to, role
        elif role[:1] == "s" and state == NOTHING:
            yield more, "K", SYSTEM, role
        yield more + REROLE, "R", to, NAMES[to]


@dataclass(slots=True)
class Account:
    """Figures and edits of one conversation while its rows pass."""

    faults: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0})
    illegal: int = 0
    turns: list[int] = field(default_factory=list)
    distinct: int = 0
    before: str | None = None
    audit: list[str] = field(default_factory=list)
    sha: object = field(default_factory=hashlib.sha256)
    begun: bool = False
    repair: Repair = field(default_factory=Repair)

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> Iterator[Edit]:
        if turn is not None:
            self.distinct += not self.turns or self.turns[1] != turn
            self.turns = [self.turns[0] if self.turns else turn, turn]
        if fault:
            self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        return self.repair.row(role, text, fault)

    def note(self, edits: Iterator[Edit]) -> None:
        for e in edits:
            self.audit.append(e.letter)
            if e.role is not None:
                self.sha.update(f"{chr(10) if self.begun else ''}{e.role}:{e.text}".encode())
                self.begun = True

    def result(self, id: object) -> tuple:
        cost, edits = self.repair.finish()
        self.note(edits)
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (id, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.sha.hexdigest())


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one: ``(conv_id, turn, role, text, dropped, fault)``."""
    for b in batches:
        columns = [b.column(c) for c in ("conv_id", "turn", "role", "text", "dropped", "fault")]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _accounts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A row for each conversation."""
    account, at = None, None
    for id, turn, role, text, dropped, fault in _in_order(batches):
        if account is None or id != at:
            if account is not None:
                yield account.result(at)
            account, at = Account(), id
        if not dropped:
            account.note(account.row(turn, role, text, fault))
    if account is not None:
        yield account.result(at)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A row for each edit."""
    repair, at, step = None, None, 0

    def numbered(edits: Iterator[Edit]) -> Iterator[tuple]:
        nonlocal step
        for e in edits:
            step += 1
            yield (at, step, e.letter, e.role, e.text if e.role is not None else None)

    for id, _, role, text, dropped, fault in _in_order(batches):
        if repair is None or id != at:
            if repair is not None:
                yield from numbered(repair.finish()[1])
            repair, at, step = Repair(), id, 0
        if not dropped:
            yield from numbered(repair.row(role, text, fault))
    if repair is not None:
        yield from numbered(repair.finish()[1])


def _streamed(rows: DataFrame, read: Callable, columns: str) -> DataFrame:
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {columns}"
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in columns.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        first = next(batches, None)
        if first is None:
            return
        arrow = pa.schema([first.schema.field("conv_id"), *(pa.field(n, kinds[t]) for n, t in zip(names, types, strict=True))])

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for row in read(chained()):
            held.append(row)
            if len(held) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return faulted(rows).select("conv_id", "turn", "role", "text", "dropped", "fault").mapInArrow(run, schema)


def edits(rows: DataFrame) -> DataFrame:
    """``(conv_id, step, edit, role, text)``: the cheapest edits of each conversation in order, from 1. A row that is deleted
    has neither role nor text; the others, in order, are the repaired conversation. See ``accounts`` for the rows."""
    return _streamed(rows, _edits, "step long, edit string, role string, text string")


def accounts(rows: DataFrame) -> DataFrame:
    """One row for each ``conv_id``, null included, of ``rows(conv_id, turn, role, text[, dropped])``: missing turns, faults of
    each kind, adjacent roles that may not follow each other, the cost and the letters of the cheapest edits (Keep, Rerole,
    Delete, Insert), and SHA-256 of the repaired lines ``role:text``.

    Roles and texts must not be null (``damaged`` reads them as one space); a role is known by its first letter, a role
    of another one, or none, can be changed or deleted only. A conversation of dropped rows alone has no faults, no edits and the
    digest of an empty text. Rows with equal turns stand by role and text; repeated rows are duplicates. An empty table
    gives no rows; other columns are not read.

    A conversation passes through one task row by row, as its digest and audit do by nature; a task holds only undecided edits.
    """
    return _streamed(rows, _accounts, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
