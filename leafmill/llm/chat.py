"""Chat formatting with typed content parts.

A visitor walks the parts of each turn in order: text is escaped, images, audio and documents become placeholders
with an attachment record and the number of tokens that they expand to. Turns of a conversation come together in
order by a shuffle and a sort that spills; a conversation is written in parts of bounded size, so that one with a
third of all turns is streamed and never held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. ``TURN role TEXT text END`` is one turn.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: What texts must not contain as it is: the openings of control strings of this and of common templates. Between the
#: bracket and the rest an escaped text has one backslash more than the original, so both directions are exact.
_CONTROL = r"(<|\[)(\\*)(?=\||/?s>|/?SYS>>|/?INST\])"
_ESCAPE, _UNESCAPE = re.compile(_CONTROL), re.compile(r"(<|\[)\\(\\*)(?=\||/?s>|/?SYS>>|/?INST\])")
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

PART = "struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHMENT = pa.struct(
    [("turn", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment stands for in training."""

    tile: int = 512
    tokens_per_tile: int = 170
    tokens_per_image: int = 85
    tokens_per_second: float = 25.0
    tokens_per_page: int = 1_000

    def image(self, width: int | None, height: int | None) -> int:
        tiles = -(-(width or 0) // self.tile) * -(-(height or 0) // self.tile)
        return self.tokens_per_image + self.tokens_per_tile * tiles

    def audio(self, seconds: float | None) -> int:
        return int(-(-(seconds or 0.0) * self.tokens_per_second // 1))

    def document(self, pages: int | None) -> int:
        return self.tokens_per_page * (pages or 0)


@dataclass
class PartVisitor:
    """Flattens the parts of one turn; ``visit`` dispatches on the kind of the part, ``finish`` ends the turn.

    Texts that follow each other are escaped as one, so that no control string can arise where they meet.
    """

    expansion: Expansion
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)  # of texts, within the turn's body
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)  # kind, uri, place, tokens
    length: int = 0
    run: list[str] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['kind']}", None)
        if method is None:
            raise ValueError(f"unknown part kind {part['kind']!r}")
        method(part)

    def _put(self, piece: str) -> int:
        start = self.length
        self.pieces.append(piece)
        self.length += len(piece)
        return start

    def visit_text(self, part: dict) -> None:
        self.run.append(part.get("text") or "")

    def finish(self) -> None:
        start = self._put(escape("".join(self.run)))
        self.run.clear()
        if self.length > start:
            self.spans.append((start, self.length))

    def _attach(self, part: dict, tokens: int) -> None:
        self.finish()
        start = self._put(f"<|{part['kind']}|>")
        self.attachments.append((part["kind"], part.get("uri"), start, tokens))

    def visit_image(self, part: dict) -> None:
        self._attach(part, self.expansion.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, self.expansion.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self._attach(part, self.expansion.document(part.get("pages")))


def with_parts(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Plain texts as turns with one text part each (column ``parts``)."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"),
                                                        ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("kind"), F.col(text_col).alias("text"), *empty)
    return turns.withColumn("parts", F.array(part))


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    trained: tuple[str, ...] = ("assistant",),
    expansion: Expansion = Expansion(),
    part_chars: int = 1_000_000,
) -> DataFrame:
    """``conv_id, part, formatted, loss_spans, attachments, n_turns, expanded_tokens``: conversations in order.

    ``loss_spans`` are the places (code points within ``formatted``) of the texts of ``trained`` roles; attachments
    give turn, kind, uri, place and expanded tokens. Turns are ordered by turn, then role, then content; null turns
    come first, null roles and texts count as empty, repeated turns are repeated, and rows without a conversation id
    form one conversation. A conversation longer than ``part_chars`` gives several rows, cut between turns. The rows
    of a conversation follow each other in one partition. An empty table gives no rows.
    """
    src = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.col(parts_col).cast(f"array<{PART}>").alias("parts"),
    )
    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    id_type = src.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, length = None, 0, 0
        texts: list[str] = []
        spans: list[dict] = []
        attachments: list[dict] = []
        n_turns, tokens, opened = 0, 0, False
        types = [pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(_ATTACHMENT), pa.int64(), pa.int64()]
        names = ["conv_id", "part", "formatted", "loss_spans", "attachments", "n_turns", "expanded_tokens"]
        out: list[tuple] = []
        chars = 0

        def close() -> None:
            nonlocal texts, spans, attachments, n_turns, tokens, length
            out.append((conv, part, "".join(texts), spans, attachments, n_turns, tokens))
            texts, spans, attachments, n_turns, tokens, length = [], [], [], 0, 0, 0

        def emit(id_arrow: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_arrow, *types])], names)

        id_arrow = None
        for b in batches:
            id_arrow = b.schema.types[0]
            for row in b.to_pylist():
                if opened and row["conv_id"] != conv:
                    close()
                    part = 0
                elif opened and length >= part_chars:
                    close()
                    part += 1
                conv, opened = row["conv_id"], True
                visitor = PartVisitor(expansion)
                for p in row["parts"] or []:
                    visitor.visit(p)
                visitor.finish()
                head = TURN + escape(row["role"]) + TEXT
                body = length + len(head)
                if row["role"] in trained:
                    spans += [{"start": body + s, "end": body + e} for s, e in visitor.spans]
                attachments += [
                    {"turn": row["turn"], "kind": k, "uri": u, "at": body + at, "tokens": n}
                    for k, u, at, n in visitor.attachments
                ]
                texts += [head, *visitor.pieces, END]
                length = body + visitor.length + len(END)
                n_turns, tokens = n_turns + 1, tokens + sum(a[3] for a in visitor.attachments)
                chars += visitor.length
                if len(out) >= 1_000 or (out and chars > 4 * part_chars):
                    chars = 0
                    yield emit(id_arrow)
        if opened:
            close()
        if out:
            yield emit(id_arrow)

    schema = (
        f"conv_id {id_type}, part long, formatted string, loss_spans array<struct<start: long, end: long>>, "
        "attachments array<struct<turn: long, kind: string, uri: string, at: long, tokens: long>>, "
        "n_turns long, expanded_tokens long"
    )
    return ordered.mapInArrow(run, schema)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted part; placeholders of attachments stay in the text."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not in the template at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not in the template at {at}")
    return turns


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation, computed from the formatted output alone and streamed part by part.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Set ``in_order`` for rows that come
    straight from ``format_conversations``; a stored table is brought in order again.
    """
    src = formatted.select("conv_id", "part", "formatted", "loss_spans")
    if not in_order:
        src = src.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    id_type = src.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        state: list | None = None

        def emit(id_arrow: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_arrow, *types])], names)

        def close() -> None:
            conv, n, turns, loss_chars, loss, chars = state
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        id_arrow = None
        for b in batches:
            id_arrow = b.schema.types[0]
            for row in b.to_pylist():
                if state is None or row["part"] == 0:
                    if state is not None:
                        close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, content in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode())
                for span in row["loss_spans"]:
                    learned = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            yield emit(id_arrow)
        if state is not None:
            close()
            yield emit(id_arrow)

    return src.mapInArrow(
        run,
        f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
