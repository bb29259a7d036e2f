"""Chat formatting by event-sourced reconstruction of conversation logs.

A log row is an event (conv_id, seq, kind, turn, role, text; and ``message``, a number, where a turn
has several messages). Logs are dealt in ranges of conversation, turn and message and sorted by
sequence number, then folded into final messages in one streaming pass that holds a single message
at a time; a message is never cut by a range, a long conversation is spread over many tasks:

- ``message`` opens a new message of its turn with its role and text;
- ``delta`` adds text to the turn's open message;
- ``edit`` replaces its text (and its role, where one is given);
- ``regenerate`` empties it, so that later deltas write it anew;
- ``delete`` takes it back.

Events that find no open message of their turn open one. Messages are rendered as
``<turn role>text</turn>`` and a line feed. Inside texts and roles, ``\\``, ``<`` and ``>`` are
preceded by a backslash, so no text can look like a mark and reading back is exact.

Defined results: a null text or role is empty, unknown kinds raise; a very long text or conversation
is formatted whole; ties of turn and seq go by kind, role and text; rows that repeat a whole event
count each; conversations without events, or with deleted messages only, have no row; a null conv_id
is a conversation of its own; an empty log gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, stored

KINDS = ("message", "delta", "edit", "regenerate", "delete")
TRAINED_ROLE = "assistant"
_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)

SEGMENT = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted message and where the loss mask covers it (empty but for the trained role)."""
    head, body = f"<turn {escape(role)}>", escape(text)
    span = (len(head), len(head) + len(body)) if role == TRAINED_ROLE else (0, 0)
    return f"{head}{body}</turn>\n", *span


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) messages of a formatted text; raises if anything in it isn't one."""
    at, out = 0, []
    for m in _MARK.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return out


@dataclass
class _Open:
    key: tuple = (None, None)
    role: str = ""
    parts: list[str] = field(default_factory=list)
    live: bool = False


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of the final messages of sorted events (conv_id, turn, kind, role, text).

    A turn is any value that tells one message's events from the next one's.
    """
    now = _Open()
    for conv, turn, kind, role, text in events:
        if (conv, turn) != now.key or kind == "message" or not now.live:
            if now.live:
                yield now.key[0], now.role, "".join(now.parts)
            now = _Open((conv, turn), role or "", [], kind != "delete")
        if kind in ("message", "delta"):
            now.parts.append(text or "")
        elif kind == "edit":
            now.role, now.parts = role or now.role, [text or ""]
        elif kind == "regenerate":
            now.role, now.parts = role or now.role, []
        elif kind == "delete":
            now.live = False
        else:
            raise ValueError(f"unknown kind of event: {kind!r}")
    if now.live:
        yield now.key[0], now.role, "".join(now.parts)


def format_log(log: DataFrame) -> DataFrame:
    """conv_id, position, role, formatted, loss_start, loss_end: one row for each final message.

    A conversation's formatted text is its rows' ``formatted`` by position.
    """

    def events(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for conv, turn, message, kind, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                yield conv, (turn, message), kind, role, text

    def convert(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments() -> Iterator[tuple]:
            last, position = object(), 0
            for conv, role, text in fold(events(parts)):
                position = position + 1 if conv == last else 0
                last = conv
                made, start, end = render(role, text)
                yield conv, position, role, made, start, end

        yield from batches(segments(), SEGMENT)

    numbered = log if "message" in log.columns else log.withColumn("message", F.lit(0).cast("long"))
    dealt = numbered.repartitionByRange("conv_id", "turn", "message")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "message", "seq", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "role", "text")
    told = ordered.select(F.col("conv_id").cast("long"), "turn", F.col("message").cast("long"), "kind", "role", "text")
    made = told.mapInArrow(convert, "conv_id long, position long, role string, formatted string, loss_start long, loss_end long")
    # Positions start anew in each range: they go on from those of the earlier ranges of a conversation.
    made = stored(made.withColumn("part", F.spark_partition_id()), "segments")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = made.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before)).where("before is not null")
    # At most one row for each range, as only its first conversation can have begun in an earlier one.
    later = F.broadcast(counted.select(F.col("conv_id").alias("later_conv"), F.col("part").alias("later_part"), "before"))
    placed = made.join(later, made["conv_id"].eqNullSafe(later["later_conv"]) & (made["part"] == later["later_part"]), "left")
    return placed.withColumn("position", F.col("position") + F.coalesce("before", F.lit(0))).select(*SEGMENT.names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the segments of :func:`format_log`.

    A digest of a whole conversation can only be made in one pass over it: one task streams it,
    holding a batch of segments at a time.
    """

    def convert(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> Iterator[tuple]:
            now = None
            for part in parts:
                for conv, text, start, end in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if now is None or now[0] != conv:
                        if now is not None:
                            yield _result(now)
                        now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said in read_back(text):
                        now[1] += 1
                        now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    covered = unescape(text[start:end])
                    now[3] += len(covered)
                    now[4].update(covered.encode("utf-8", "surrogatepass"))
                    now[5] += len(text)
            if now is not None:
                yield _result(now)

        yield from batches(finished(), DIGESTS)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        convert, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _result(now: list) -> tuple:
    return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of final messages (conv_id, turn, role, text) as a log that ends in them.

    Each message is streamed in one of four ways, by its number in its turn, its turn and its length:
    as an opening half and a delta; as a first answer that is regenerated; as a draft that is edited;
    or after a message that is deleted again. Rows of one turn stay apart: they are numbered by role
    and text.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    told = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order).cast("long"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, size)
    whole, none = F.col("text"), F.lit(None).cast("string")

    def event(step: int, kind: str, text, before: int = 0):
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(before).alias("before"))

    ways = [
        F.array(event(0, "message", first), event(1, "delta", rest)),
        F.array(event(0, "message", rest), event(1, "regenerate", none), event(2, "delta", first), event(3, "delta", rest)),
        F.array(event(0, "message", first), event(1, "edit", whole)),
        F.array(event(0, "message", rest, 1), event(1, "delete", none, 1), event(2, "message", whole)),
    ]
    way = F.pmod(F.coalesce(F.col("turn").cast("long"), F.lit(0)) + F.col("n") + size, F.lit(len(ways)))
    chosen = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    events = told.select("conv_id", "turn", "role", "n", F.explode(chosen).alias("e"))
    # A message that is deleted again stands before its row's own message.
    return events.select("conv_id", F.col("e.step").cast("long").alias("seq"), "e.kind", "turn", (2 * F.col("n") - F.col("e.before")).alias("message"), "role", "e.text")
