"""Chat formatting from event logs.

A conversation is a log of events: ``message`` sets a message's text, ``delta``
adds to it, ``edit`` replaces it, ``regenerate`` clears it for another try.
Logs are dealt by conversation and sorted by message and sequence, so that a
task folds each message from its events as they stream by, keeping one message
at a time, and renders it as soon as it is complete.

The template is ``<s>``, then for each turn ``[ROLE]`` text ``[/ROLE]`` with
``</s>`` behind an assistant's.  A role of other characters than a-z, 0-9 and
_ stands behind the tag, ``[TAG:LENGTH]``, and is escaped like a text.  Inside texts each control string is escaped by
a backslash behind its first character, and a backslash there by another one,
which ``unescape`` undoes exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
#: What starts a control string: a bracket of the template or of common chat formats, and runs of backslashes behind it.
_OPEN = re.compile(r"([<\[])(\\*)(?=[/\w|])")
_ESCAPED = re.compile(r"([<\[])(\\+)(?=[/\w|])")


def escape(text: str) -> str:
    """No control string is left: each bracket that could start one gets one more backslash behind it."""
    return _OPEN.sub(lambda m: m[1] + m[2] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2][1:], text)


def fold(kinds: Iterator[tuple[str, str]] | list[tuple[str, str]]) -> str:
    """The final text of a message from its events (kind, text) in order."""
    parts: list[str] = []
    for kind, text in kinds:
        if kind == "delta":
            parts.append(text)
        elif kind == "regenerate":
            parts = [text] if text else []
        else:  # message, edit
            parts = [text]
    return "".join(parts)


def render(role: str, text: str) -> list[tuple[str, bool]]:
    """Pieces of the template for a turn: the characters, and whether the loss counts them."""
    tag = re.sub(r"[^A-Za-z0-9_]", "_", role).upper() or "_"
    name = escape(role)
    # a role that the tag does not tell is written out behind it, its length in the tag
    head = f"[{tag}]" if tag.lower() == role else f"[{tag}:{len(name)}]{name}"
    body = escape(text)
    # a bracket at the very end of a text would join the closing tag's characters
    tail = "\\" if re.search(r"[<\[]\\*\Z", body) else ""
    return [(head, False), (body, role == "assistant"), (f"{tail}[/{tag}]" + "</s>" * (role == "assistant"), False)]


def parse(pieces: list[tuple[str, bool]]) -> tuple[str, str]:
    """Role and text of a rendered turn, read back from its characters."""
    whole = "".join(x for x, _ in pieces)
    m = re.fullmatch(r"\[([A-Z0-9_]+)(?::(\d+))?\](.*)\[/\1\](?:</s>)?", whole, re.S)
    role, body = m[1].lower(), m[3]
    if m[2]:
        role, body = unescape(body[: int(m[2])]), body[int(m[2]) :]
    if re.search(r"[<\[]\\+\Z", body):
        body = body[:-1]
    return role, unescape(body)


class Digest:
    """What is read back from the formatted turns of one conversation, turn by turn."""

    def __init__(self, conv_id: int):
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 3, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, pieces: list[tuple[str, bool]]) -> None:
        role, text = parse(pieces)
        self.turns += 1
        self.chars += sum(len(x) for x, _ in pieces)
        self.said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for x, counts in pieces:
            if counts:
                plain = unescape(x)
                self.loss += len(plain)
                self.learned.update(plain.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def messages(rows: Iterator[dict]) -> Iterator[tuple[int, str, str]]:
    """(conv_id, role, text) of each message, folded from sorted events; one message is held at a time."""
    key, role, events = None, "", []
    for r in rows:
        now = (r["conv_id"], r["message"])
        if now != key and key is not None:
            yield key[0], role, fold(events)
            role, events = "", []
        key = now
        role = role or r["role"] or ""
        if r["kind"] in ("edit", "message", "regenerate"):
            events = []  # what came before no longer matters
        events.append((r["kind"] or "message", r["text"] or ""))
    if key is not None:
        yield key[0], role, fold(events)


def _dealt(events: DataFrame) -> DataFrame:
    """Conversations by task, in order.  One conversation is one task, whose sort spills; a digest needs its turns one behind the other."""
    return events.select("conv_id", "message", "seq", "kind", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, message, rendered, loss_start, loss_end) in the order of conversations, a row for each turn.

    Rendered turns of a conversation follow each other behind ``<s>``.  The
    loss is on the characters from loss_start to loss_end of the row, none
    where they are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv_id", "message", "rendered", "loss_start", "loss_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        out, last, n = [], object(), 0
        for conv_id, role, text in messages(_rows(batches)):
            n, last = (n + 1 if conv_id == last else 0), conv_id
            pieces = render(role, text)
            a = len(pieces[0][0])
            out.append((conv_id, n, "".join(x for x, _ in pieces), a, a + len(pieces[1][0]) * pieces[1][1]))
            if len(out) >= 512:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)

    return _dealt(events).mapInArrow(run, "conv_id long, message long, rendered string, loss_start long, loss_end long")


def digests(events: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the rendered turns.

    Null texts are empty.  Events with equal conversation, message and
    sequence go by kind, role and text.  A null conversation is one of its
    own.  An empty log gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out, digest = [], None
        for conv_id, role, text in messages(_rows(batches)):
            if digest is None or digest.conv_id != conv_id:
                if digest is not None:
                    out.append(digest.row())
                digest = Digest(conv_id)
            digest.add(render(role, text))
            if len(out) >= 1024:
                yield _batch(out, names, kinds)
                out = []
        if digest is not None:
            out.append(digest.row())
        if out:
            yield _batch(out, names, kinds)

    return _dealt(events).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame, delta_chars: int = 4096, drafts: int = 0) -> DataFrame:
    """The log of rows (conv_id, turn, role, text) as an application would have written it, which folds to their texts.

    A text is a message and the deltas that stream the rest of it.  One in
    ``drafts`` texts, by a hash, has a history before (none for 0): its first half was
    streamed, then an assistant regenerated it from nothing, or another role
    edited it into the text's beginning and streamed on.  Rows of one turn are
    messages of their own, in the order of role and text.  Null turns stand
    before all others, null roles and texts are empty.
    """
    base = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("message"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    repeated = base.groupBy("conv_id", "message").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        # places instead of turns, so that rows of one turn are told apart
        base = base.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("message"), "role", "text")).cast("long"))
    parts = F.greatest(F.ceil(F.length("text") / delta_chars), F.lit(1)).cast("int")
    drafted = F.pmod(F.xxhash64("conv_id", "message", "text"), F.lit(drafts)) == 0 if drafts else F.lit(False)
    base = base.withColumns({"parts": parts, "draft": F.when(drafted, F.ceil(parts / 2)).otherwise(0).cast("int")})
    # a regeneration is an event without text, an edit has the first part
    cleared = (F.col("role") == "assistant") & (F.col("draft") > 0)
    events = base.withColumn("cleared", cleared).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("draft") + F.col("parts") + F.col("cleared").cast("int") - 1)))
    turn = F.col("seq") == F.col("draft")
    kind = F.when(turn & F.col("cleared"), "regenerate").when(turn & (F.col("draft") > 0), "edit").when(F.col("seq") == 0, "message").otherwise("delta")
    part = F.when(F.col("seq") < F.col("draft"), F.col("seq")).otherwise(F.col("seq") - F.col("draft") - F.col("cleared").cast("int"))
    events = events.withColumns({"kind": kind, "part": part})
    text = F.when(F.col("kind") == "regenerate", "").otherwise(F.expr(f"substring(text, part * {delta_chars} + 1, {delta_chars})"))
    return events.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "kind", "role", text.alias("text"))
