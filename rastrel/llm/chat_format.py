"""Chat formatting by prefix-target expansion.

Every assistant turn ends an example: all turns before it are context, its reply alone is trainable.
A conversation's examples share their prefixes, so each turn is formatted once and an example is
the segments from 0 to its own; `examples` lays them out in full, `read_examples` reads them back.
Conversations are streamed in turn order; one example and the turns after it are held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import SLICE_BYTES

#: The template's control strings. A turn is OPEN, role, ": ", text, CLOSE.
OPEN, CLOSE = "### ", " </turn>\n"
ASSISTANT = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the text in it). Roles are capitalised where that is reversible, else marked."""
    title = role.capitalize()
    name = title if role.isalpha() and role.isascii() and role.islower() else "@" + escape(role).replace(":", "\\:")
    head = f"{OPEN}{name}: "
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a segment."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    name, body = found.groups()
    role = re.sub(r"\\(\\|:|###|</turn>)", r"\1", name[1:]) if name[0] == "@" else name.lower()
    return role, unescape(body)


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, ix, segment, context_chars, loss_start, loss_end long, example long) for every row of turns.

    ix numbers a conversation's rows from 0 by turn, ties by role and text, null turns last. An assistant's row
    ends example 0, 1, ...; its loss span is the reply within the segment. Other rows have an empty span and
    no example of their own. context_chars is the length of all segments before. Null roles and texts are empty;
    rows with a null conversation make up one. Repeated rows are turns of their own; further columns are ignored, whatever
    they are named. Texts of any length are formatted whole, a row at a time. An empty table gives an empty result."""
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv").sortWithinPartitions("conv", F.asc_nulls_last("turn"), "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ix, chars, example = object(), 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != now:
                    now, ix, chars, example = conv, 0, 0, 0
                segment, a, b = format_turn(role, text)
                trained = role == ASSISTANT
                out.append((conv, ix, segment, chars, a if trained else 0, b if trained else 0, example if trained else None))
                ix, chars, example = ix + 1, chars + len(segment), example + trained
            types = (batch.schema.field("conv").type, pa.int64(), pa.string(), *[pa.int64()] * 4)
            names = ("conv", "ix", "segment", "context_chars", "loss_start", "loss_end", "example")
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    return rows.mapInArrow(run, f"conv {kind}, ix long, segment string, context_chars long, loss_start long, loss_end long, example long").withColumnRenamed("conv", conv_col)


def examples(found: DataFrame, conv_col: str = "conv_id", tails: bool = False) -> DataFrame:
    """(conv, example, text, loss_start, loss_end): each example in full, from segments().

    Takes segments() as it comes, a conversation at a time, so a null conversation has its examples as any other.
    With tails, each conversation ends with a row of no example, whose text is the turns after its last reply.
    The characters of the result grow with the square of a conversation's turns, as the method's examples do; a task holds
    one example and the turns after it, so a conversation must fit a task's memory."""
    kind = found.schema[conv_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (conv_col, "example", "text", "loss_start", "loss_end")
        now, prefix, after, started = None, "", [], False
        for batch in batches:
            types = (batch.schema.field(conv_col).type, pa.int64(), pa.string(), pa.int64(), pa.int64())
            out, size = [], 0

            def flush(rows: list[tuple], types: tuple = types) -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

            for conv, ix, segment, example, chars, a, b in zip(*(batch.column(c).to_pylist() for c in (conv_col, "ix", "segment", "example", "context_chars", "loss_start", "loss_end")), strict=True):
                if not ix:
                    if started and tails:
                        out.append((now, None, "".join(after), 0, 0))
                    now, prefix, after, started = conv, "", [], True
                after.append(segment)
                if example is not None:
                    prefix, after = prefix + "".join(after), []
                    out.append((conv, example, prefix, chars + a, chars + b))
                    size += len(prefix)
                    if size > SLICE_BYTES:
                        yield flush(out)
                        out, size = [], 0
            yield flush(out)
        if started and tails:
            yield flush([(now, None, "".join(after), 0, 0)])

    return found.select(conv_col, "ix", "segment", "example", "context_chars", "loss_start", "loss_end").mapInArrow(run, f"`{conv_col}` {kind}, example long, text string, loss_start long, loss_end long")


def read_examples(found: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, the columns of read_back(): from examples() with tails, as it comes.

    Each reply is read at its example's own loss span. An example must repeat its predecessor, as it is compared,
    and its further turns are parsed; formatted_chars is the length of the last example and of the tail."""
    kind = found.schema[conv_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        n, said, chars, loss, last = 0, hashlib.sha256(), 0, hashlib.sha256(), ""
        for batch in batches:
            types = (batch.schema.field(conv_col).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done: list[tuple] = []
            for conv, example, text, a, b in zip(*(batch.column(c).to_pylist() for c in (conv_col, "example", "text", "loss_start", "loss_end")), strict=True):
                if example is None:
                    new = text
                elif text.startswith(last):
                    new = text[len(last) :]
                    trained = unescape(text[a:b])
                    chars += len(trained)
                    loss.update(trained.encode())
                else:
                    raise ValueError("an example does not repeat the one before it")
                # Only a turn's end holds CLOSE unescaped.
                for part in new.split(CLOSE)[:-1]:
                    role, body = parse_turn(part + CLOSE)
                    n += 1
                    said.update(f"{role}\n{body}\n".encode())
                if example is not None:
                    last = text
                    continue
                done.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), len(last) + len(text)))
                n, said, chars, loss, last = 0, hashlib.sha256(), 0, hashlib.sha256(), ""
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in done], t) for k, (c, t) in enumerate(zip(names, types, strict=True))})

    return found.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(found: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the segments of each conversation hold: n_turns, digests of all turns and of all trainable text.

    Takes segments() as it comes: rows of a conversation together and in order. Digests are kept up row by row."""
    kind = found.schema[conv_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        state: list | None = None
        kept: pa.DataType | None = None

        def close(states: list[list]) -> pa.RecordBatch:
            rows = [(c, n, t.hexdigest(), chars, loss.hexdigest(), whole) for c, n, t, chars, loss, whole in states]
            types = (kept, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

        for batch in batches:
            kept, done = batch.schema.field(conv_col).type, []
            for conv, ix, segment, a, b in zip(*(batch.column(c).to_pylist() for c in (conv_col, "ix", "segment", "loss_start", "loss_end")), strict=True):
                if not ix:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(segment)
                trained = unescape(segment[a:b])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(trained)
                state[4].update(trained.encode())
                state[5] += len(segment)
            yield close(done)
        if state:
            yield close([state])

    return found.select(conv_col, "ix", "segment", "loss_start", "loss_end").mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
