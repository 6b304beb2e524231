"""Chat formatting with a grammar round trip.

Template, turn after turn with nothing between::

    user       [INST] text [/INST]
    system     <<SYS>>text<</SYS>>
    assistant  text</s>
    any other  [ROLE name]text[/ROLE]     (name percent-encoded; null has no name)

``parse`` is a deterministic parser of this grammar: the next characters say
which turn begins, and the turn's first closing string ends it. A turn is first
rendered as it is. If parsing it doesn't give back its role and text, its text
is escaped: each control string in it gets a backslash after its first
character, and one that has backslashes there already gets one more, so that
removing one undoes it. Parsing always removes one; the loop ends when the parse
is identical with the source, at the latest after the first escape. No closing
string overlaps itself, so that turns parse alike alone and in a conversation.

The loss mask covers the texts of assistants: the offsets of each segment.

Rows are spread by conversation and sorted by turn; a conversation streams
through its task, whatever its length, and only one turn is held at a time.

Null texts are empty texts and null roles the role ''; turns of a conversation
are ordered by (turn, role, text), so that ties and repeated rows have one
order; a null conv_id is a conversation of its own, the null one. Texts are kept whole,
however long. Only conv_id, turn, role and text are read, so that other columns can't
clash. An empty table has the query's own conversation -7 alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

#: A control string with any backslashes after its first character.
CONTROL = re.compile(r"(<(?=\\*(?:/s>|<SYS>>|</SYS>>))|\[(?=\\*(?:/?INST\]|/ROLE\]|ROLE[ \]])))(\\*)")
ESCAPED = re.compile(r"(<(?=\\+(?:/s>|<SYS>>|</SYS>>))|\[(?=\\+(?:/?INST\]|/ROLE\]|ROLE[ \]])))\\")
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
ROLE = re.compile(r"\[ROLE(?: ([\w.~%-]*))?\]", re.ASCII)


def frame(role: str) -> tuple[str, str]:
    if role in FRAMES:
        return FRAMES[role]
    return (f"[ROLE {quote(role, safe='')}]" if role else "[ROLE]"), "[/ROLE]"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, and where the text stands) of each turn; ValueError where the grammar doesn't hold."""
    at = 0
    while at < len(rendered):
        if rendered.startswith("[INST] ", at):
            role, start = "user", at + 7
        elif rendered.startswith("<<SYS>>", at):
            role, start = "system", at + 7
        elif m := ROLE.match(rendered, at):
            role, start = unquote(m[1] or ""), m.end()
        else:
            role, start = "assistant", at
        close = frame(role)[1]
        end = rendered.find(close, start)
        if end < 0:
            raise ValueError(f"no {close!r} after {start}")
        yield role, unescape(rendered[start:end]), start, end
        at = end + len(close)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where its text stands, after as many escapes as its round trip needs."""
    before, after = frame(role)
    shown = text
    for _ in range(3):
        segment = before + shown + after
        try:
            turns = list(parse(segment))
        except ValueError:
            turns = []
        if [t[:2] for t in turns] == [(role, text)]:
            return segment, turns[0][2], turns[0][3]
        shown = escape(shown)
    raise AssertionError("the template can't hold this text")


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.string()), ("is_loss", pa.bool_()), ("text_start", pa.int64()), ("text_end", pa.int64())])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, position, first = None, 0, True
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            position = 0 if first or c != conv else position + 1
            conv, first = c, False
            segment, a, b = render(role or "", text or "")
            out.append((c, position, segment, role == "assistant", a, b))
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), SEGMENTS)], schema=SEGMENTS) if out else pa.RecordBatch.from_pylist([], SEGMENTS)


def format_chat(turns: DataFrame) -> DataFrame:
    """The segments of all conversations, each conversation's together in a partition and in order.

    A conversation's rendered text is its segments joined; text_start and
    text_end (code points) say where the turn's text stands in its segment, and
    is_loss whether training learns it.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    # null conversations and others alike by their hash
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_rendered, "conv_id long, position long, segment string, is_loss boolean, text_start long, text_end long")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads conversations back from their segments, in order."""
    done: list[tuple] = []
    conv = state = None

    def close() -> None:
        n, turns, chars, loss, total = state
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    def flush() -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in done], t.type) for i, t in enumerate(DIGEST)]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=DIGEST)

    for batch in batches:
        for c, position, segment, is_loss, a, b in zip(*(batch.column(n).to_pylist() for n in SEGMENTS.names)):
            if position == 0:
                if state:
                    close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if is_loss:
                learnt = unescape(segment[a:b])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(segment)
        yield flush()
    if state:
        close()
        yield flush()


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation: turns and loss text as parsed from the segments of ``format_chat``."""
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return segments.mapInArrow(_digested, fields)


def op10(spark, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
