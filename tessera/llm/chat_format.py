"""Chat formatting of typed content parts.

A turn is written as ``<turn:ROLE>`` newline CONTENT ``</turn>`` newline.  Content is a
list of parts (text, image, audio, document); a visitor flattens them into text with
ordered placeholders ``<image:0>``, ``<audio:1>`` ... and records each attachment's
reference and the tokens it expands to.  Inside texts and roles every backslash and every
``<`` or ``>`` is preceded by a backslash, so an unescaped ``<`` is always a mark of the
template and the escape is undone exactly.  The loss mask is a span per assistant turn.

One row per turn, so no row grows with the length of a conversation; a conversation's
text is the concatenation of its rows in turn order.  ``read_back`` parses that text as a
stream sorted by conversation: memory does not grow with a conversation, and only the
digest of one conversation is sequential.

Edge cases: a null text is empty; a null role is ''; null conv_id is a conversation of
its own; null turns come first; equal turns are ordered by role, then text, and repeated
rows are separate turns; unknown part types raise; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

TURN = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.|<[a-z]+:\d+>)*)</turn>\n", re.S)
MARK = re.compile(r"(?<!\\)<([a-z]+):(\d+)>")
_SPECIAL, _ESCAPED = re.compile(r"[\\<>]"), re.compile(r"\\(.)", re.S)


def escape(s: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


@dataclass(frozen=True)
class Expansion:
    """Tokens of an attachment: image patches, audio frames, tokens per document page."""
    patch: int = 14
    frames_per_second: int = 25
    page_tokens: int = 512


@dataclass
class Flatten:
    """Visitor over the parts of one turn: visits them in order, documents recursively."""
    expansion: Expansion
    out: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown part type {kind!r}")
        method(part)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append((n, kind, part.get("ref") or "", tokens))
        self.out.append(f"<{kind}:{n}>")

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        p = self.expansion.patch
        self.attach("image", part, math.ceil((part.get("width") or 0) / p) * math.ceil((part.get("height") or 0) / p))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.expansion.frames_per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.expansion.page_tokens)
        for child in part.get("parts") or []:
            self.visit(child)


def format_turn(role: str | None, parts: list[dict], expansion: Expansion = Expansion()) -> dict:
    v = Flatten(expansion)
    for p in parts:
        v.visit(p)
    head, content = f"<turn:{escape(role or '')}>\n", "".join(v.out)
    loss = role == "assistant"
    return {"formatted": f"{head}{content}</turn>\n", "loss_start": len(head) if loss else None,
            "loss_end": len(head) + len(content) if loss else None, "attachments": v.attachments,
            "attachment_tokens": sum(a[3] for a in v.attachments)}


FORMATTED = pa.schema([
    ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
    ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
                                        ("tokens", pa.int64())]))),
    ("attachment_tokens", pa.int64())])
FORMATTED_SQL = ("formatted string, loss_start long, loss_end long, attachments array<struct<n:int,kind:string,"
                 "ref:string,tokens:long>>, attachment_tokens long")


def format_chat(turns: DataFrame, parts: str | None = None, expansion: Expansion = Expansion()) -> DataFrame:
    """(conv_id, turn, role, text) plus the formatted turn.  ``parts`` names a column with
    a JSON list of typed parts; without it (or where it is null) the text is one part."""
    cols = ["conv_id", "turn", "role", "text"]
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields if f.name in cols}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in FORMATTED]
        for b in batches:
            rows = []
            texts, roles = b.column("text").to_pylist(), b.column("role").to_pylist()
            given = b.column(parts).to_pylist() if parts else [None] * len(texts)
            for role, text, p in zip(roles, texts, given, strict=True):
                content = [{"type": "text", "text": text}] if p is None else json.loads(p)
                rows.append(format_turn(role, content, expansion))
            got = [pa.array([[dict(zip(("n", "kind", "ref", "tokens"), a, strict=True)) for a in r[f.name]]
                             if f.name == "attachments" else r[f.name] for r in rows], f.type) for f in FORMATTED]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *got], names=[*cols, *names])

    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", " + FORMATTED_SQL
    return turns.select(*cols, *([parts] if parts else [])).mapInArrow(run, schema)


class Digest:
    """What is read back from the formatted rows of one conversation."""

    def __init__(self) -> None:
        self.turns, self.n = hashlib.sha256(), 0
        self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, 0

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        m = TURN.fullmatch(piece)
        if m is None:
            raise ValueError("a formatted turn does not parse")
        self.n += 1
        self.chars += len(piece)
        self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        if start is not None:
            said = unescape(piece[start:end])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars, from the formatted text and the loss mask alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, at, done = None, None, []
        for b in batches:
            for conv, *rest in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")),
                                   strict=True):
                if open_ is None or conv != at:
                    if open_ is not None:
                        done.append((at, *open_.row()))
                    open_, at = Digest(), conv
                open_.add(*rest)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)
                done = []
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (at, *open_.row()), strict=True))], schema)

    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([("conv_id", conv_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "formatted", "loss_start", "loss_end")
            .mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))
