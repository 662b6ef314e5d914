"""Chat formatting from an event log.

A conversation is kept as events: a message is opened with its role, deltas
are streamed onto it, an edit replaces its text, a regeneration throws away
what was streamed so far.  The log is partitioned by conversation (and
message, so that one huge conversation does not meet in one task), sorted by
sequence number and folded into final messages, which are then rendered.

Template: ``### <role>: <text></turn>`` and a line feed per message.  Inside
role and text a backslash, ``###`` and ``</turn>`` get a backslash in front
(a role's colon too), so the output can be read back whatever the texts say.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
HEAD, COLON, END = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
CONTROL_IN_ROLE = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(.)", re.S)
# one rendered message; an unescaped control string can only be the template's
TURN = re.compile(r"### ((?:[^\\:]|\\.)*?): ((?:[^\\]|\\.)*?)</turn>\n", re.S)

MESSAGE_FIELDS = "conv_id bigint, turn bigint, message bigint, role string, text string"


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted message and where its text starts and ends in it."""
    head = HEAD + escape(role, CONTROL_IN_ROLE) + COLON
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_back(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every message in formatted text; start and
    end bound the escaped text.  Anything that is not a message raises."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a message at character {at}")
        yield unescape(m.group(1)), unescape(m.group(2)), m.start(2), m.end(2)
        at = m.end()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events -> final messages, one message in memory at a time."""
    names = [f.split()[0] for f in MESSAGE_FIELDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    done: list[tuple] = []
    key, role, parts = None, "", []

    def close():
        if key is not None:
            done.append((*key, role, "".join(parts)))

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for conv_id, turn, message, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv_id, turn, message) != key:
                close()
                key, role, parts = (conv_id, turn, message), "", []
            if kind == OPEN:
                role = text or ""
            elif kind == DELTA:
                parts.append(text or "")
            elif kind == EDIT:
                parts = [text or ""]
            elif kind == REGENERATE:
                parts = []
            else:
                raise ValueError(f"unknown event {kind!r}")
        if len(done) >= 5_000:
            yield flush()
    close()
    if done:
        yield flush()


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, message, role, text) of an event log
    (conv_id, turn, message, seq, kind, text).

    ``message`` tells messages apart that share a turn number.  ``seq`` orders
    the events of a message; ties go by kind and text.  A null text is empty
    and so is the role of a message that was never opened; null ids are a
    conversation, turn or message of their own.  Other columns are ignored; an
    empty log gives no messages.
    """
    cols = ["conv_id", "turn", "message", "kind", "text"]
    return (events.select(*cols, "seq").repartition("conv_id", "message")
            .sortWithinPartitions("conv_id", "turn", "message", "seq", "kind", "text")
            .select(*cols).mapInArrow(_fold, MESSAGE_FIELDS))


def format_messages(messages: DataFrame) -> DataFrame:
    """Every message rendered: conv_id, turn, message, role, segment,
    text_start, text_end, loss_start, loss_end.  The formatted conversation is
    its segments joined in the order of turn, role, text and message; text_start
    and text_end bound the escaped text (characters of the segment), which is
    under the loss mask where the role is assistant (else null)."""
    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        out = [render(r or "", t or "") for r, t in zip(roles, texts)]
        under = [r == "assistant" for r in roles]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([s for s, _, _ in out], pa.string()),
             pa.array([a for _, a, _ in out], pa.int64()), pa.array([b for _, _, b in out], pa.int64()),
             pa.array([a if u else None for u, (_, a, _) in zip(under, out)], pa.int64()),
             pa.array([b if u else None for u, (_, _, b) in zip(under, out)], pa.int64())],
            names=["conv_id", "turn", "message", "role", "segment", "text_start", "text_end",
                   "loss_start", "loss_end"])
    ordered = messages.select("conv_id", "turn", "message", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, turn bigint, message bigint, role string, "
                                   "segment string, text_start bigint, text_end bigint, "
                                   "loss_start bigint, loss_end bigint")


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted segments: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Messages of one turn go by role, then by their own (unescaped) text, then
    by message.  A hash over a whole conversation is sequential, so its segments
    pass through one task in order, one at a time; nothing is gathered.
    """
    fields = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint")
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, started, key, n, loss, chars = [], False, None, 0, 0, 0
        turns_sha = loss_sha = None

        def close():
            if started:
                done.append((key, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars))

        for batch in batches:
            for conv_id, segment, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv_id != key:
                    close()
                    started, key, n, loss, chars = True, conv_id, 0, 0, 0
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                for role, text, a, b in read_back(segment):
                    n += 1
                    turns_sha.update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(segment[start:end])
                    loss += len(masked)
                    loss_sha.update(masked.encode())
                chars += len(segment)
            if len(done) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    # the escapes of a text would change its place, so it is sorted without them
    escaped = F.substring(F.col("segment"), F.col("text_start").cast("int") + 1,
                          (F.col("text_end") - F.col("text_start")).cast("int"))
    text = F.regexp_replace(escaped, r"(?s)\\(.)", "$1")
    ordered = (segments.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", F.coalesce("role", F.lit("")), text, "message"))
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, fields)
