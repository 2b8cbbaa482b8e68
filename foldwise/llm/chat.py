"""Chat formatting by incremental black-box rendering (operator 7).

A template is any function from a list of (role, text) turns to a string. Turns are added one
by one; each prefix is rendered and compared with the output before: what was appended is the
new turn's span, and an output that does not begin with the one before shows a template that
rewrites history. The text's place inside the span comes from a second rendering in which a
marker stands for the text. No knowledge of the template is used.

The default template escapes its control strings inside texts, so its output can be read back.

Every turn is rendered after its whole conversation so far, which the task then holds, and the
work grows with the square of its turns. Only for templates known to join turns that are
rendered one by one (LOCAL) is a window of turns enough: there the task never holds a
conversation. Conversations stream through a task in order of turn. Defined results: a null text or role is an empty one; a null conv_id is a
conversation of its own; turns sort by number (null first), then role and text, and repeated
rows are turns of their own; other columns are not read; an empty table gives an empty
result; texts of any length are formatted whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns that one rendering covers under a template of LOCAL; older ones of a longer conversation leave the window.
WINDOW_TURNS = 32
MARKER = "\ue0f1\ue0f2\ue0f3"

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in NAMES.items()}
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
END = "</turn>\n"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def role_name(role: str) -> str:
    """Known roles by their name; any other after "=", with a backslash before ":" and "\\"."""
    return NAMES.get(role) or "=" + re.sub(r"[\\:]", r"\\\g<0>", role)


def role_of(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name[1:], flags=re.S) if name.startswith("=") else _ROLES[name]


def default_template(turns: list[Turn]) -> str:
    return "".join(f"### {role_name(r)}: {escape(t)}{END}" for r, t in turns)


#: Templates whose output is that of each turn alone, joined.
LOCAL = {default_template}


def read_turn(piece: str) -> Turn:
    """(role, text) of one formatted turn of the default template."""
    head = _HEADER.match(piece)
    if not head or not piece.endswith(END):
        raise ValueError("not a turn of this template")
    return role_of(head[1]), unescape(piece[head.end():-len(END)])


class RewritesHistory(ValueError):
    """A longer prefix did not begin with the rendering of the shorter one."""


class IncrementalRenderer:
    """Spans of successive turns under a template of which nothing is known; with a window, under
    one for which the turns before the window do not matter."""

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window and max(2, window)
        self.turns: list[Turn] = []
        self.out = ""

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        """(appended string, begin and end of the text in it)."""
        if self.window and len(self.turns) >= self.window:  # go on from the last half of the window
            self.turns = self.turns[-(self.window // 2):]
            self.out = self.template(self.turns)
        marker = MARKER
        while marker in text or marker in self.out:
            marker += MARKER
        whole = self.template([*self.turns, (role, text)])
        marked = self.template([*self.turns, (role, marker)])
        if not whole.startswith(self.out) or not marked.startswith(self.out):
            at = len(os.path.commonprefix([whole, self.out]))
            raise RewritesHistory(f"turn {len(self.turns)} changes earlier output from character {at} on")
        piece, frame = whole[len(self.out):], marked[len(self.out):]
        begin = frame.find(marker)
        if begin < 0:
            begin = end = len(piece)  # the template drops this turn's text
        else:
            end = len(piece) - (len(frame) - begin - len(marker))
            if piece[:begin] != frame[:begin] or piece[end:] != frame[begin + len(marker):]:
                raise RewritesHistory(f"the frame of turn {len(self.turns)} depends on its text")
        self.turns.append((role, text))
        self.out = whole
        return piece, begin, end


def rewrites_history(template: Template, turns: list[Turn]) -> bool:
    r = IncrementalRenderer(template)
    try:
        for role, text in turns:
            r.add(role, text)
    except RewritesHistory:
        return True
    return False


def format_turns(df: DataFrame, template: Template = default_template, window: int | None = None,
                 loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, nth, piece, text_begin, text_end, in_loss, rewrites), conversations in order.

    The formatted conversation is its pieces in a row; `in_loss` marks turns whose text is
    learned. Without a `window`, templates of LOCAL have one of WINDOW_TURNS and others none. `rewrites` is true from the first turn on that changes earlier output; that
    turn and those after it have no piece.
    """
    if window is None and template in LOCAL:
        window = WINDOW_TURNS
    empty = F.lit("")
    turns = df.select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"),
                      F.coalesce(df["role"].cast("string"), empty).alias("role"),
                      F.coalesce(df["text"].cast("string"), empty).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, nth long, piece string, text_begin long, text_end long, in_loss boolean, rewrites boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nth, renderer = (), 0, None
        for batch in batches:
            rows = []
            cols = [batch.column(i).to_pylist() for i in (0, 2, 3)]
            for conv, role, text in zip(*cols):
                if current != (conv,):
                    current, nth, renderer = (conv,), 0, IncrementalRenderer(template, window)
                piece = begin = end = None
                if renderer:
                    try:
                        piece, begin, end = renderer.add(role, text)
                    except RewritesHistory:
                        renderer = None
                rows.append((conv, nth, piece, begin, end, role in loss_roles, renderer is None))
                nth += 1
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(),
                                                                  pa.int64(), pa.bool_(), pa.bool_()])]
            if rows:
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return turns.mapInArrow(run, schema)


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Read the formatted turns back, conversation by conversation, in the order and partitions
    in which :func:`format_turns` left them; running digests hold no conversation whole."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, rewrites boolean")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = (), None

        def row(s):
            return (current[0], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["rewrites"])
        for batch in batches:
            done = []
            for t in batch.to_pylist():
                if current != (t["conv_id"],):
                    if current:
                        done.append(row(state))
                    current = (t["conv_id"],)
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0,
                             "rewrites": False}
                state["rewrites"] |= t["rewrites"]
                if t["piece"] is None:
                    continue
                role, text = read_turn(t["piece"])
                state["n"] += 1
                state["chars"] += len(t["piece"])
                state["turns"].update(f"{role}\n{text}\n".encode())
                if t["in_loss"]:
                    learned = unescape(t["piece"][t["text_begin"]:t["text_end"]])
                    state["loss"].update(learned.encode())
                    state["loss_chars"] += len(learned)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=_arrow(schema))
        if current:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(state)))], schema=_arrow(schema))
    return turns.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
