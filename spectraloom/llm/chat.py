"""Chat formatting with a grammar round trip.

Method. A conversation is a sequence of turns, each rendered with its role's opening and closing marks. The grammar is
deterministic: outside a turn an opening mark must follow, inside a turn text runs to the closing mark. Every
rendered turn is parsed again and compared with its source; where the text contains something that the grammar reads
as a mark, that place is escaped by a backslash and the turn is rendered again, until the parse gives the source back.
Reading a text, a backslash before a control string (with any backslashes before it) is dropped.

The loss mask covers the assistants' texts.

Rows are sorted within conversations (one shuffle by conversation) and read as a stream, so no conversation is ever
held in memory: digests and counts grow turn by turn.

Defined cases: null text and null role are empty strings; rows without a conversation id form one conversation; equal
turn numbers are in the order of role and text; repeated rows are turns of their own; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Opening and closing marks by role; other roles carry their name.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [AS] ", " [/ROLE]")
#: All control strings; none is the beginning of another one.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[AS]", "[/ROLE]"]
FOUND = re.compile(r"(\\*)(" + "|".join(re.escape(x) for x in CONTROL) + ")")


def escaped(text: str, places) -> str:
    """The text with one more backslash before the control strings at ``places`` (numbers of matches)."""
    number = -1

    def one(match):
        nonlocal number
        number += 1
        return ("\\" if number in places else "") + match.group()
    return FOUND.sub(one, text)


def unescaped(text: str) -> str:
    return FOUND.sub(lambda m: m.group()[1:] if m.group(1) else m.group(), text)


def parse(rendered: str):
    """Turns (role, text) of a rendered conversation, each with the span of its text; ValueError if it has no parse."""
    at, turns, marks = 0, [], [m for m in FOUND.finditer(rendered) if not m.group(1)]
    opening = {o.strip(): (role, c.strip()) for role, (o, c) in MARKS.items()}
    i = 0
    while at < len(rendered):
        if i >= len(marks) or marks[i].start() != at:
            raise ValueError(f"no turn opens at {at}")
        mark = marks[i].group()
        if mark == "[ROLE]":
            parts = marks[i:i + 3]
            if [m.group() for m in parts] != ["[ROLE]", "[AS]", "[/ROLE]"]:
                raise ValueError(f"a role without its marks at {at}")
            role = unescaped(inside(rendered, parts[0], parts[1]))
            start, stop = parts[1].end() + 1, parts[2].start() - 1
            text, last, i = unescaped(inside(rendered, parts[1], parts[2])), parts[2], i + 3
        elif mark in opening and i + 1 < len(marks) and marks[i + 1].group() == opening[mark][1]:
            role, last = opening[mark][0], marks[i + 1]
            start, stop = marks[i].end() + 1, last.start() - 1
            text, i = unescaped(inside(rendered, marks[i], last)), i + 2
        else:
            raise ValueError(f"{mark} at {at} does not open a turn")
        turns.append((role, text, start, stop))
        at = last.end()
    return turns


def inside(rendered, left, right):
    a, b = left.end(), right.start()
    if b - a < 2 or rendered[a] != " " or rendered[b - 1] != " ":
        raise ValueError(f"no text between the marks at {a}")
    return rendered[a + 1:b - 1]


def join(role: str, text: str, role_written: str, text_written: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + text_written + MARKS[role][1]
    return OTHER[0] + role_written + OTHER[1] + text_written + OTHER[2]


def render(role: str, text: str) -> str:
    """One turn; conflicting places are escaped until the parse of the result gives the turn back."""
    role_places, text_places = set(), set()
    in_role, in_text = len(FOUND.findall(role)), len(FOUND.findall(text))
    while True:
        rendered = join(role, text, escaped(role, role_places), escaped(text, text_places))
        try:
            if [(r, t) for r, t, _, _ in parse(rendered)] == [(role, text)]:
                return rendered
        except ValueError:
            pass
        if len(text_places) < in_text:        # the next conflict from the left
            text_places.add(len(text_places))
        elif role not in MARKS and len(role_places) < in_role:
            role_places.add(len(role_places))
        else:
            raise AssertionError(f"no rendering of {role!r}, {text!r}")


def quick(role: str, text: str) -> str:
    """The same; all places at once where there are many."""
    n = len(FOUND.findall(text))
    if n > 20:
        rendered = join(role, text, escaped(role, range(len(FOUND.findall(role)))), escaped(text, range(n)))
        if [(r, t) for r, t, _, _ in parse(rendered)] != [(role, text)]:
            raise AssertionError(f"no rendering of {role!r}")
        return rendered
    return render(role, text)


def turn_rows(batches):
    for batch in batches:
        roles, texts = (["" if v is None else v for v in batch.column(i).to_pylist()] for i in (2, 3))
        rendered = [quick(r, t) for r, t in zip(roles, texts)]
        read = [parse(x)[0] for x in rendered]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(rendered, pa.string()),
            pa.array([r for r, _, _, _ in read], pa.string()), pa.array([t for _, t, _, _ in read], pa.string()),
            pa.array([a if r == "assistant" else -1 for r, _, a, _ in read], pa.int64()),
            pa.array([b if r == "assistant" else -1 for r, _, _, b in read], pa.int64())],
            ["conv_id", "turn", "formatted", "role", "text", "loss_start", "loss_stop"])


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn: its rendering, what the parser reads from it, and the span of the loss mask in it (-1: none).

    A conversation's formatted text is the concatenation of its turns' renderings.
    """
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(turn_rows, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, "
                                      "role string, text string, loss_start long, loss_stop long")


def digest_rows(batches):
    """Sorted turns to one row per conversation, as a stream; the loss text is read back from the rendering."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state, kind = None, None

    def rows(found):
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    def closed(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        kind, done = batch.column(0).type, []
        for conv, _, formatted, role, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(closed(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if a >= 0:
                loss = unescaped(formatted[a:b])
                state[3] += len(loss)
                state[4].update(loss.encode())
            state[5] += len(formatted)
        if done:
            yield rows(done)
    if state is not None:
        yield rows([closed(state)])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation what the formatted text holds, from ``format_turns``."""
    kind = dict(turns.dtypes)["conv_id"]
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(digest_rows, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long"))
