"""Repair of conversations: generalised LR parsing of a role grammar with weighted edits.

A conversation's rows, by turn, are read as roles. Rows with a fault are found first: blank (no character but white space), duplicate
(its role and text stand in an earlier row) or truncated (its last such character ends no sentence); the first that holds counts. The
parser then looks for the cheapest edits whose roles the grammar derives: keep (K, 0), rerole to user or assistant (R, 2), delete
(D, 3; the only edit of blank and duplicate rows), insert an empty user or assistant turn anywhere (I, 2); a truncated row that
stays adds 1. Of equally cheap edits those with the smallest audit (the edits' letters in order, as ASCII) win.

SLR tables are made from ``GRAMMAR``. Stacks share their lower parts (each top points at what is below it). After every row tops of
equal state are merged: the one of least (cost, audit) stays. That is exact as tops of one state have the same continuations here.
Audits aren't kept but ranked: of two audits of the same rows neither begins with the other before turns are inserted after the
last one, so their order stays whatever is added.

Which of two tops wins may be open until the last row (of many user's turns in a row, the first edit depends on whether they are even or
odd in number), so rows don't wait for it. Forward, every row gets the links from its tops to the tops before; backward, the
links are followed from the cheapest top that accepts. Both passes stream, and hold a few tops.

Spark partitions rows by conversation once; duplicates are found in a window by text hash, and the passes' orders are local sorts, which
spill. A conversation's order and digest make it one task's work, but nothing holds it as a group.

Null turns come first; rows of one turn go by role, then text. Null roles and texts are one space each here. Null ids make one
conversation. Repeated rows are duplicates; empty texts are blank; long texts are rows like others. A conversation without
rows to parse can be named by a row with ``here`` false: it gives one row without action. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\x0b\x0c\r"
#: s: system, u: user, a: assistant; upper case: derived.
GRAMMAR = (("C", ""), ("C", "B"), ("C", "sB"), ("B", "P"), ("B", "BP"), ("P", "ua"))
ROLES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1


class Tables:
    """SLR tables of a grammar whose first rule's left side is the start: shift[state, token], reduce[state, token], goto[state, symbol]."""

    def __init__(self, grammar: tuple[tuple[str, str], ...]):
        self.rules = (("^", grammar[0][0]), *grammar)
        self.shift, self.reduce, self.goto = {}, {}, {}
        self.tokens = {x for _, right in grammar for x in right if x.islower()}
        follow = self._follow()
        states: dict[frozenset, int] = {}
        todo = [self._closure({(0, 0)})]
        states[todo[0]] = 0
        while todo:
            items = todo.pop()
            here = states[items]
            for symbol in sorted({self.rules[r][1][at] for r, at in items if at < len(self.rules[r][1])}):
                after = self._closure({(r, at + 1) for r, at in items if self.rules[r][1][at : at + 1] == symbol})
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                (self.goto if symbol.isupper() else self.shift)[here, symbol] = states[after]
            for r, at in items:
                if at == len(self.rules[r][1]):
                    for token in follow[self.rules[r][0]]:
                        self.reduce[here, token] = r

    def _closure(self, items: set[tuple[int, int]]) -> frozenset:
        while True:
            new = {(k, 0) for r, at in items for k, (left, _) in enumerate(self.rules) if self.rules[r][1][at : at + 1] == left} - items
            if not new:
                return frozenset(items)
            items = items | new

    def _follow(self) -> dict[str, set[str]]:
        """No rule here begins with a symbol that derives nothing, so a symbol's first tokens are those of its rules' first symbols."""
        first = {left: set() for left, _ in self.rules}
        follow = {left: set() for left, _ in self.rules}
        follow["^"].add("$")
        for _ in self.rules:
            for left, right in self.rules:
                first[left] |= first.get(right[:1], {right[:1]} - {""})
        for _ in self.rules:
            for left, right in self.rules:
                for at, symbol in enumerate(right):
                    if symbol in follow:
                        follow[symbol] |= first.get(right[at + 1], {right[at + 1]}) if right[at + 1 :] else follow[left]
        return follow


class Top:
    """A top of the graph-structured stack: a state, what is below it, and the order of the cheapest edits that lead here: their cost, the rank
    of the audit of the top it comes from (``origin``, before the last row), and what was inserted since then."""

    __slots__ = ("state", "below", "cost", "rank", "origin", "added", "letters")

    def __init__(self, state: int, below: Top | None, cost: int, rank: int, origin: int, added: str = "", letters: str = ""):
        self.state, self.below, self.cost, self.rank, self.origin, self.added, self.letters = state, below, cost, rank, origin, added, letters

    def edited(self, state: int, below: Top | None, cost: int, letter: str, token: str = "") -> Top:
        return Top(state, below, self.cost + cost, self.rank, self.origin, self.added + token, self.letters + letter)

    def order(self) -> tuple:
        return self.cost, self.rank, self.letters


class Parser:
    """Reads a conversation row by row. ``add`` gives the links of a row: ``state,state before,tokens inserted before it,letter`` for every
    top, separated by spaces. ``close`` gives the state that wins and the tokens inserted at the end."""

    def __init__(self, tables: Tables):
        self.tables, self.start = tables, [Top(0, None, 0, 0, 0)]
        self.tops = self.start

    def _after(self, top: Top, token: str) -> tuple[int, Top] | None:
        """The state after a token and what is then below it; None if the grammar has no such continuation."""
        node = top
        while (rule := self.tables.reduce.get((node.state, token))) is not None:
            left, right = self.tables.rules[rule]
            if left == "^":
                return node.state, node
            for _ in right:
                node = node.below
            node = Top(self.tables.goto[node.state, left], node, 0, 0, 0)
        state = self.tables.shift.get((node.state, token))
        return None if state is None else (state, node)

    @staticmethod
    def _offer(tops: dict[int, Top], top: Top) -> bool:
        better = top.state not in tops or top.order() < tops[top.state].order()
        if better:
            tops[top.state] = top
        return better

    def _with_inserted(self) -> list[Top]:
        """The tops, also those that inserted turns reach or make cheaper."""
        tops, todo = {x.state: x for x in self.tops}, list(self.tops)
        while todo:
            top = todo.pop()
            if tops[top.state] is top:
                for token in ROLES:
                    if (to := self._after(top, token)) is not None and self._offer(tops, new := top.edited(*to, INSERT, "I", token)):
                        todo.append(new)
        return list(tops.values())

    def add(self, role: str, fault: str) -> str:
        tops: dict[int, Top] = {}
        cut = CUT if fault == "truncated" else 0
        for top in self._with_inserted():
            self._offer(tops, top.edited(top.state, top.below, DELETE, "D"))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] in self.tables.tokens and (to := self._after(top, role[0])) is not None:
                self._offer(tops, top.edited(*to, cut, "K"))
            for token, name in ROLES.items():
                if name != role and (to := self._after(top, token)) is not None:
                    self._offer(tops, top.edited(*to, REROLE + cut, "R"))
        found = sorted(tops.values(), key=lambda x: (x.rank, x.letters))
        self.tops = [Top(x.state, x.below, x.cost, rank, x.state) for rank, x in enumerate(found)]
        return " ".join(f"{x.state},{x.origin},{x.added},{x.letters[-1]}" for x in found)

    def close(self) -> str:
        best = min((x for x in self._with_inserted() if self._after(x, "$") is not None), key=Top.order)
        self.tops = self.start
        return f"{best.origin},{best.added}"


class Tracer:
    """Follows a conversation's links from its last row to its first."""

    def __init__(self, tables: Tables):
        self.entered = {state: token for (_, token), state in tables.shift.items()}
        self.state = 0

    def end(self, closed: str) -> str:
        """The tokens inserted after the last row."""
        state, added = closed.split(",")
        self.state = int(state)
        return added

    def row(self, links: str, role: str) -> tuple[str, str, str]:
        """A row's letter, its role after the edit, and the tokens inserted before it."""
        _, origin, added, letter = next(x for x in map(lambda y: y.split(","), links.split(" ")) if int(x[0]) == self.state)
        role = ROLES[self.entered[self.state]] if letter == "R" else role
        self.state = int(origin)
        return letter, role, added


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here, fault and nth (for a steady order of equal rows), partitioned by conversation."""
    rows = rows.repartition("conv_id")
    said = F.btrim("text", F.lit(SPACES))
    again = W.partitionBy("conv_id", "h1", "h2", "here").orderBy(F.asc_nulls_first("turn"))
    pair = F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), pair), "h2": F.xxhash64(F.lit(2), pair)}).withColumn("nth", F.row_number().over(again))
    fault = F.when(said == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "here", fault.alias("fault"), "nth")


def passed(rows: DataFrame, schema: T.StructType, step) -> DataFrame:
    """``step`` as a generator over a partition's rows in their order: it takes and yields tuples; batches go on at about a MiB."""
    kinds = [arrow(f.dataType) for f in schema.fields]
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)

        held, size = [], 0
        for row in step(each()):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, str))
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], schema.names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], schema.names)

    return rows.mapInArrow(run, schema)


def arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def forward(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, turn, role, text, here, fault) in order, with their number, links, and the end of the last row of a conversation. A row
    that isn't here has no number; it comes after the others of its conversation and goes on only if there are none."""
    parser, held, n = Parser(Tables(GRAMMAR)), None, 0
    for conv, turn, role, text, here, fault in rows:
        if held and held[0] != conv:
            yield (*held, parser.close() if n else None)
            held, n = None, 0
        if here:
            if held:
                yield (*held, None)
            held = (conv, turn, role, text, fault, n, parser.add(role, fault))
            n += 1
        elif not held:
            held = (conv, None, None, None, None, None, None)
    if held:
        yield (*held, parser.close() if n else None)


def backward(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Edits (conv_id, at, nth, turn, action, role, text, cost, fault, said_as) from a conversation's last row to its first."""
    tracer = Tracer(Tables(GRAMMAR))

    def inserted(conv, at: int, tokens: str) -> Iterator[tuple]:
        for nth in reversed(range(len(tokens))):
            yield conv, at, nth, None, "I", ROLES[tokens[nth]], "", INSERT, None, None

    for conv, turn, role, text, fault, at, links, closed in rows:
        if at is None:
            yield conv, *[None] * 9
            continue
        if closed is not None:
            yield from inserted(conv, at + 1, tracer.end(closed))
        letter, name, added = tracer.row(links, role)
        cost = DELETE if letter == "D" else (REROLE if letter == "R" else 0) + (CUT if fault == "truncated" else 0)
        yield conv, at, len(added), turn, letter, name, text, cost, fault, role
        yield from inserted(conv, at, added)


def repair(conversations: DataFrame, keys: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), here: str | None = None) -> DataFrame:
    """The edits of every conversation in order within a partition: conv_id, turn (null for inserted turns), action (K, R, D, I), role
    (after the edit; a deleted row's own), text, cost, fault (of the row: blank, duplicate, truncated or none) and said_as (its role before).

    ``here``: a boolean column that is false for rows which only name their conversation."""
    conv, turn, role, text = keys
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"), known(text).alias("text"), (F.col(here) if here else F.lit(True)).alias("here"))
    rows = faults(rows).sortWithinPartitions("conv_id", F.desc("here"), F.asc_nulls_first("turn"), "role", "text", "nth").drop("nth")
    conv_kind = rows.schema["conv_id"]
    linked = passed(rows, typed(conv_kind, "turn long, role string, text string, fault string, at long, links string, closed string"), forward)
    linked = linked.sortWithinPartitions("conv_id", F.desc("at"))
    edits = passed(linked, typed(conv_kind, "at long, nth int, turn long, action string, role string, text string, cost long, fault string, said_as string"), backward)
    return edits.sortWithinPartitions("conv_id", "at", "nth").drop("at", "nth")


def typed(conv: T.StructField, rest: str) -> T.StructType:
    return T.StructType([conv, *T.StructType.fromDDL(rest).fields])


def digest(rows: Iterable[tuple]) -> Iterator[tuple]:
    state = None
    for conv, turn, action, role, text, cost, fault, before in rows:
        if state is None or conv != state.conv:
            if state:
                yield state.row()
            state = Digest(conv)
        if action is not None:
            state.add(turn, action, role, text, cost, fault, before)
    if state:
        yield state.row()


class Digest:
    """What is returned of one conversation."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost, self.audit = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, []
        self.low = self.high = self.before = None
        self.turns, self.hash, self.kept = 0, hashlib.sha256(), 0

    def add(self, turn: int | None, action: str, role: str, text: str, cost: int, fault: str | None, before: str | None) -> None:
        self.audit.append(action)
        self.cost += cost
        if action != "I":
            if fault:
                self.faults[fault] += 1
            if self.before is not None and self.before[:1] + before[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = before
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
        if action != "D":
            self.hash.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.kept += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation, from ``repair``'s rows as they lie: gaps, blank, duplicate, truncated, illegal (adjacent roles before the repair whose
    initials aren't su, ua or au), cost, audit, repaired_sha256. No shuffle; texts are hashed as they pass."""
    return passed(edits, typed(edits.schema["conv_id"], "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"), digest)


def damage(conversations: DataFrame, keys: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """conv_id, turn, role, text, here: rows damaged by crc32 of ``conv_id:turn`` in twenty kinds (nulls: one space): 0 drops the row (here is
    false), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's; others stay."""
    conv, turn, role, text = keys
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), known(role).alias("role"), known(text).alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    by = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", by.alias("role"), said.alias("text"), (F.col("kind") != 0).alias("here"), F.explode(times).alias("copy")).drop("copy")
