"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens them in order:
text is escaped, and images, audio and documents become numbered placeholders,
with their references and expanded token counts recorded. A turn is written

    <s>[role]content</s>

Every control string starts with ``<`` or ``[``; inside texts these get a
backslash after them and a backslash is doubled, so no control string can
appear in a text, and :func:`parse` restores each text exactly. The loss mask
covers the content of assistant turns.

Defined cases: null text and null role are empty; turns with equal numbers go
by role, then text, null turns first; rows without a conv_id are one
conversation; repeated rows are turns like others; an empty table gives
an empty result; extra columns are ignored; a conversation of any length is
read as a stream, its rows sorted on disk, never held together.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

OPEN, CLOSE = "<s>", "</s>"
PARTS_SCHEMA = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class TextPart:
    text: str

    def accept(self, visitor):
        return visitor.text(self)


@dataclass(frozen=True)
class ImagePart:
    ref: str
    width: int
    height: int

    def accept(self, visitor):
        return visitor.image(self)


@dataclass(frozen=True)
class AudioPart:
    ref: str
    seconds: float

    def accept(self, visitor):
        return visitor.audio(self)


@dataclass(frozen=True)
class DocumentPart:
    ref: str
    pages: int

    def accept(self, visitor):
        return visitor.document(self)


@dataclass(frozen=True)
class Costs:
    """Tokens a placeholder expands to."""

    patch: int = 28
    audio_per_second: float = 25.0
    document_page: int = 256


_ESCAPED = re.compile(r"[\[<\\]")
_PLAIN = re.compile(r"\[\\|<\\|\\\\|\\\]")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: "]" if m[0] == "\\]" else m[0][0], text)


@dataclass
class Flattener:
    """Visitor: ordered content with placeholders, attachments beside it."""

    costs: Costs = field(default_factory=Costs)
    content: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.content.append(f"<{kind}:{len(self.attachments)}>")
        self.attachments.append((kind, ref, tokens))

    def text(self, part: TextPart) -> None:
        self.content.append(escape(part.text))

    def image(self, part: ImagePart) -> None:
        self._attach("image", part.ref, math.ceil(part.width / self.costs.patch) * math.ceil(part.height / self.costs.patch))

    def audio(self, part: AudioPart) -> None:
        self._attach("audio", part.ref, math.ceil(part.seconds * self.costs.audio_per_second))

    def document(self, part: DocumentPart) -> None:
        self._attach("document", part.ref, part.pages * self.costs.document_page)


def as_part(p: dict):
    """A row of PARTS_SCHEMA as a typed part; missing numbers count as 0."""
    kind = p.get("kind") or "text"
    if kind == "image":
        return ImagePart(p.get("ref") or "", p.get("width") or 0, p.get("height") or 0)
    if kind == "audio":
        return AudioPart(p.get("ref") or "", p.get("seconds") or 0.0)
    if kind == "document":
        return DocumentPart(p.get("ref") or "", p.get("pages") or 0)
    return TextPart(p.get("text") or "")


def format_turn(role: str, parts: list, flattener: Flattener) -> tuple[str, int, int]:
    """The turn's text, and where its content starts and ends in it."""
    flattener.content = []
    for p in parts:
        p.accept(flattener)
    head = f"{OPEN}[{escape(role).replace(']', chr(92) + ']')}]"
    body = "".join(flattener.content)
    return head + body + CLOSE, len(head), len(head) + len(body)


_TURN = re.compile(r"<s>\[((?:\[\\|<\\|\\\\|\\\]|[^\]\[<\\])*)\]((?:\[\\|<\\|\\\\|[^\[<\\]|<(?:image|audio|document):\d+>)*+)</s>", re.S)
_HOLDER = re.compile(r"<(?:image|audio|document):\d+>")


def parse(formatted: str) -> list[tuple[str, str, list[str]]]:
    """Role, text and placeholders of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(_HOLDER.sub("", m[2])), _HOLDER.findall(m[2])))
        at = m.end()
    return out


def format_turns(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row a turn: conv_id, turn, role, text, formatted, content_start,
    content_end, in_loss, attachments.

    With a column ``parts`` of PARTS_SCHEMA its parts are the content, else (and
    where it is null) the text is; a column of that name and another type is ignored. Attachments are numbered within the turn. No shuffle.
    """
    ship_package(conversations.sparkSession)
    parts = F.col("parts").cast(PARTS_SCHEMA) if dict(conversations.dtypes).get("parts", "").startswith("array<struct<kind:") else F.lit(None).cast(PARTS_SCHEMA)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, spans, attached = [], [], []
            for role, text, given in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                f = Flattener(costs)
                formatted, a, b = format_turn(role, [TextPart(text)] if given is None else [as_part(p) for p in given], f)
                made.append(formatted)
                spans.append((a, b))
                attached.append([{"kind": k, "ref": r, "tokens": n} for k, r, n in f.attachments])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array(made, pa.string()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), pa.array([r == "assistant" for r in batch.column(2).to_pylist()], pa.bool_()), pa.array(attached, pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))],
                ["conv_id", "turn", "role", "text", "formatted", "content_start", "content_end", "in_loss", "attachments"],
            )

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, formatted string, content_start long, content_end long, in_loss boolean, attachments array<struct<kind:string,ref:string,tokens:long>>")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a whole conversation takes its turns in order, so a
    conversation's turns meet in one task; they stream through it sorted and
    only running digests are held.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, done = None, False, []
        n = loss = chars = 0
        whole, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for conv, formatted, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not begun or conv != now:
                    if begun:
                        done.append((now, n, whole.hexdigest(), loss, masked.hexdigest(), chars))
                    now, begun, n, loss, chars = conv, True, 0, 0, 0
                    whole, masked = hashlib.sha256(), hashlib.sha256()
                for role, text, _ in parse(formatted):
                    n += 1
                    whole.update(f"{role}\n{text}\n".encode())
                chars += len(formatted)
                if role == "assistant":  # as the output says
                    text = unescape(_HOLDER.sub("", formatted[a:b]))
                    loss += len(text)
                    masked.update(text.encode())
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema)
                done = []
        if begun:
            done.append((now, n, whole.hexdigest(), loss, masked.hexdigest(), chars))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema)

    schema = pa.schema([("conv_id", pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    in_order = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_order.select("conv_id", "formatted", "content_start", "content_end").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, formatted text, attachments of each conversation, turns in order."""
    turns = format_turns(conversations, costs)
    item = F.struct("turn", "role", "text", "formatted", "attachments")
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t"))
    return rows.select("conv_id", F.array_join("t.formatted", "").alias("formatted"), F.flatten("t.attachments").alias("attachments"))
