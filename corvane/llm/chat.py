"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. A conversation's turns are rendered
prefix by prefix; comparing each output with the one before locates the new turn's span, and an output that
doesn't continue the one before shows that the template rewrites history. An assistant turn is rendered
twice more with probe texts, whose common prefix and suffix bound the text inside the span: the loss mask.

Every prefix is true: a template may number turns, look far back, or rewrite and undo it again. Of a template that is known to be local
(``window``: a turn's output depends on the first turn and the ``window - 1`` before it at most) only so much of a prefix is rendered, and work is in
proportion to the turns. The joined output is still held against one rendering of the whole conversation, and where they differ
every true prefix is rendered.

Rows go by turn, then role and text; null role and text count as empty; rows with a null conversation
id make one conversation. Repeated rows are repeated turns, empty and very long texts are texts like others, an empty table
gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turns = list[tuple[str, str]]
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before every character that begins or ends a control string."""
    return re.sub(r"([\\#<:])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_template(turns: Turns) -> str:
    return "".join(f"### {escape(role)}: {escape(text)} </turn>\n" for role, text in turns)


def read_turns(formatted: str) -> Turns:
    """The turns of a text made by turn_template; ValueError if it holds anything else."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


class Incremental:
    """Renders one conversation turn by turn."""

    def __init__(self, template: Callable[[Turns], str], window: int | None):
        self.template, self.window, self.held, self.before = template, window, [], template([])

    def add(self, role: str, text: str, trained: bool) -> tuple[str, int, int, bool]:
        """(text appended, start and end of the trained part in it, whether the template rewrote what was there)."""
        if self.window and len(self.held) >= self.window:
            self.held = [self.held[0], *self.held[len(self.held) - self.window + 2 :]]
            self.before = self.template(self.held)
        now = self.template([*self.held, (role, text)])
        same = len(self.before) if now.startswith(self.before) else len(os.path.commonprefix([now, self.before]))
        new, rewrites = now[same:], same < len(self.before)
        start = end = 0
        if trained:
            a, b = (self.template([*self.held, (role, x)]) for x in "AB")
            head = len(os.path.commonprefix([a, b]))
            tail = len(os.path.commonprefix([a[:head:-1], b[:head:-1]]))
            start, end = max(0, head - same), len(new) - tail
        self.held.append((role, text))
        self.before = now
        return new, start, end, rewrites


def rendered(turns: Turns, template: Callable[[Turns], str], trained_roles: tuple[str, ...], window: int | None) -> list[tuple[str, int, int, bool]]:
    """What each turn appends, the trained part in it, and whether the template rewrote what was there.

    If anything was rewritten, the appended texts don't join to the rendering; they are what each turn added after the
    part that stayed."""
    one = Incremental(template, window)
    out = [one.add(r, t, r in trained_roles) for r, t in turns]
    if not window or len(turns) <= window or "".join([template([]), *(x[0] for x in out)]) == template(turns):
        return out
    return rendered(turns, template, trained_roles, None)


def format_turns(
    conversations: DataFrame,
    template: Callable[[Turns], str] = turn_template,
    trained_roles: tuple[str, ...] = ("assistant",),
    window: int | None = None,
    keys: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
) -> DataFrame:
    """One row per turn, in order within a partition: conv_id, position, role, formatted (what the turn appends),
    loss_start, loss_end (in formatted; equal: nothing is trained), rewrites. ``window`` is for local templates alone.

    One shuffle by conversation; rows are sorted and streamed, so a task holds one conversation at a time."""
    conv, turn, role, text = keys
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([rows.schema["conv_id"]]).add("position", "long").add("role", "string").add("formatted", "string")
    schema = schema.add("loss_start", "long").add("loss_end", "long").add("rewrites", "boolean")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def table(kind, conversations: list[tuple]) -> pa.RecordBatch:
        ids = [c for c, turns in conversations for _ in turns]
        got = [(i, r, *x) for _, turns in conversations for i, ((r, _), x) in enumerate(zip(turns, rendered(turns, template, trained_roles, window), strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(list(x), k) for x, k in zip(zip(*got, strict=True), kinds, strict=True))], schema.names)

    def run(batches):
        held: list[tuple] = []
        size, kind = 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not held or c != held[-1][0]:
                    if size > 1 << 20:
                        yield table(kind, held)
                        held, size = [], 0
                    held.append((c, []))
                held[-1][1].append((r, t))
                size += len(t) + 1
        if held:
            yield table(kind, held)

    return rows.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewrites. Takes format_turns' rows as they lie; no shuffle."""
    schema = T.StructType([turns.schema["conv_id"]]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long")
    schema = schema.add("loss_sha256", "string").add("formatted_chars", "long").add("rewrites", "boolean")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        current, state, done = None, None, []

        def flush():
            ids = pa.array([c for c, *_ in done], type=kind)
            rest = zip(*(x for _, *x in done), strict=True)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(list(x), k) for x, k in zip(rest, kinds, strict=True))], schema.names)

        def close():
            n, turns_hash, chars, loss_hash, formatted, rewrites = state
            done.append((current, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted, rewrites))

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, text, start, end, rewrites in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
                if state is None or c != current:
                    if state is not None:
                        close()
                    current, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(text[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] |= rewrites
            if len(done) >= 1000:
                yield flush()
                done.clear()
        if state is not None:
            close()
            yield flush()

    return turns.mapInArrow(run, schema)
