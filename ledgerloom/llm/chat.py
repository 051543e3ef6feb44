"""Chat formatting by event sourcing: logs are folded into final messages, rendered with turn marks, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, tune

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*+): ((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.S)
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its escaped text starts and ends in it. A role without a name of its own is written behind @."""
    head = OPEN + NAMES.get(role, "@" + escape(role).replace(":", "\\:")) + BETWEEN
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        name = turn[1]
        out.append((unescape(name[1:]) if name[0] == "@" else ROLES[name], unescape(turn[2])))
        at = turn.end()
    return out


#: Kinds of events, in the order in which those of equal seq apply.
EVENTS = ["message", "regenerate", "edit", "delta", "delete"]


def from_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log that a table of turns stands for: each row opens a message of its own and streams its text into it.

    Messages have ids of their own, so that repeated rows stay apart.
    """
    named = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("seq"), F.monotonically_increasing_id().cast("string").alias("message"),
                        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    none = F.lit(None).cast("string")
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("event"), role.alias("role"), text.alias("text"))
    both = F.array(event("message", F.col("role"), none), event("delta", none, F.col("text")))
    return named.select("conv_id", "seq", "message", F.explode(both).alias("e")).select("conv_id", "seq", "e.event", "message", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages of a log events(conv_id, seq, event, message, role, text).

    event: 'message' begins a message or replaces it, 'delta' adds to its text, 'edit' replaces its text, 'regenerate'
    empties it (later deltas write it anew), 'delete' takes it out; others are ignored. A message is known by conv_id and message; its place is
    its first event's seq; events apply by seq, of equal seq in the order of EVENTS, role and text. An event without
    a message id is a message by itself if it has a text to give ('message', 'delta', 'edit'), else it is ignored. Null
    roles and texts of such a message stay null, others count as empty. Messages are dealt out by conversation and message, so a long conversation is folded
    by many tasks; a task holds one message at a time. An empty log gives no rows.
    """
    tune(events.sparkSession)
    rank = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event"))
    known = events.withColumn("rank", rank).where("rank > 0")
    alone = known.where("message is null and event in ('message', 'delta', 'edit')").select("conv_id", "seq", "role", "text")
    named = known.where("message is not null").select("conv_id", "message", "seq", "event", "role", "text", "rank")
    spread = named.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "rank", "role", "text").drop("rank")
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, first, role, text, live = None, None, "", [], False
        for part in parts:
            for conv, message, seq, event, r, t in zip(*(c.to_pylist() for c in part.columns)):
                if (conv, message) != key:
                    if key and live:
                        yield key[0], first, role, "".join(text)
                    key, first, role, text, live = (conv, message), seq, "", [], False
                if event == "message":
                    role, text, live = r or "", [t or ""], True
                elif event == "delta":
                    text.append(t or "")
                    role, live = r or role, True
                elif event == "edit":
                    text, live = [t or ""], True
                elif event == "regenerate":
                    text = []
                elif event == "delete":
                    text, live = [], False
        if key and live:
            yield key[0], first, role, "".join(text)

    folded = spread.mapInArrow(lambda parts: batches(schema, rows(parts), 256), "conv_id long, seq long, role string, text string")
    return alone.unionByName(folded)


PARTS = "conv_id long, part long, formatted string, loss array<struct<start:long,end:long>>"


def format_conversations(messages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, loss) of messages(conv_id, seq, role, text): whole turns in order of seq.

    A part has at most part_chars code points, or one turn; the parts of a conversation, joined in order, are its
    formatted text. loss: spans of the part that hold assistant texts. Ties of seq go by role and the turn as written; null seq comes
    first; null conv_id is one conversation. Turns are escaped and written where they are, before they are dealt out; a task then
    streams over its conversations and holds one part at a time. An empty table gives no rows.
    """
    tune(messages.sparkSession)
    written = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("turn", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def turns_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            conv, seq, roles, texts = part.columns
            done = [render(r or "", t or "") for r, t in zip(roles.to_pylist(), texts.to_pylist())]
            columns = [conv, seq, roles.fill_null(""), *(pa.array([x[i] for x in done], written.types[3 + i]) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, schema=written)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, number, turns, spans, size = None, 0, [], [], 0
        for part in parts:
            for conv, role, turn, a, b in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "turn", "a", "b"))):
                if turns and (conv != at or size + len(turn) > part_chars):
                    yield at, number, "".join(turns), spans
                    turns, spans, size, number = [], [], 0, number + 1
                if conv != at:
                    at, number = conv, 0
                if role == "assistant":
                    spans.append({"start": size + a, "end": size + b})
                turns.append(turn)
                size += len(turn)
        if turns:
            yield at, number, "".join(turns), spans

    rendered = messages.select("conv_id", "seq", "role", "text").mapInArrow(turns_of, "conv_id long, seq long, role string, turn string, a long, b long")
    spread = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "turn")
    return spread.mapInArrow(lambda parts: batches(schema, rows(parts), 64), PARTS)


def digests(parts: DataFrame) -> DataFrame:
    """What format_conversations' parts say when read back: one row a conversation.

    Reads parts as they come: those of a conversation in order, in one partition, as format_conversations gives them.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches_: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, begun = None, False
        turns = loss = None
        n = chars = formatted_chars = 0
        for batch in batches_:
            for conv, _, formatted, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != at:
                    if begun:
                        yield at, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars
                    at, begun, turns, loss, n, chars, formatted_chars = conv, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text in read(formatted):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in spans:
                    text = unescape(formatted[span["start"] : span["end"]])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    chars += len(text)
                formatted_chars += len(formatted)
        if begun:
            yield at, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars

    return parts.mapInArrow(lambda b: batches(schema, rows(b), 1024), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
