"""Chat formatting with typed content parts.

A conversation's turns have parts: text, image, audio or document. A visitor flattens them into one string: text is escaped
and copied, every other part becomes a placeholder that counts up over the conversation, and its reference is recorded with
the number of tokens that it expands to. The template is

    <|turn|>ROLE\\nPARTS<|end|>\\n

with `<|image:0|>` and the like for parts other than text, `<|part|>` between two text parts, `<|empty|>` for an empty text part
beside others and `<|none|>` for no parts at all, so that the reader gives back the very parts. Inside roles and texts every
control string could only begin with `<|`, so escaping puts a backslash after the `<` of each `<|` and doubles the backslashes
that stand there already: `<` backslash{n} `|` becomes `<` backslash{2n+1} `|`. Unescaping halves them; both are exact
inverses for any text. As no escaped text has `<|` and all that may follow a text begins with `<|`, no sequence of texts can
spell a control string across a border either. A line break in a role is `<|break|>`.

The loss mask has the texts of assistant turns, and no placeholder.

Rows are sorted by conversation and turn in the shuffle, and folded as they stream by, so a conversation of any length
takes the memory of one batch.

Defined cases: null text is empty; a null role is the empty role; null parts are no parts; turns of a conversation are ordered
by turn (null first), then role, then text; a null conv_id is a conversation of its own; unknown part kinds are an error; a
formatted text that the visitor can't have made is an error to the reader; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TURN, END, BREAK = "<|turn|>", "<|end|>", "<|break|>"
BETWEEN, EMPTY, NONE = "<|part|>", "<|empty|>", "<|none|>"
CONTROL = re.compile(r"<(\\*)\|")
MARKS = re.compile(r"<\|(part|empty|none|(image|audio|document):(\d+))\|>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "<" + "\\" * (2 * len(m[1]) + 1) + "|", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: "<" + "\\" * (len(m[1]) // 2) + "|", text)


@dataclass(frozen=True)
class Part:
    """kind text has its text as value; the other kinds a reference, and the measures that their tokens follow from."""

    kind: str
    value: str | None
    width: int = 0
    height: int = 0
    seconds: float = 0.0
    pages: int = 0


@dataclass(frozen=True)
class Attachment:
    kind: str
    index: int
    reference: str
    tokens: int
    offset: int


@dataclass
class Flattener:
    """The visitor: one method per kind of part; placeholders and references in the order of the parts."""

    patch: int = 28
    audio_rate: int = 25
    page_tokens: int = 1500
    counts: dict[str, int] = field(default_factory=dict)
    attachments: list[Attachment] = field(default_factory=list)
    out: list[str] = field(default_factory=list)
    size: int = 0
    beside: bool = False
    after_text: bool = False

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part: Part) -> None:
        handler = getattr(self, f"visit_{part.kind}", None)
        if handler is None:
            raise ValueError(f"unknown kind of part: {part.kind!r}")
        handler(part)
        self.after_text = part.kind == "text" and bool(part.value)

    def attach(self, part: Part, tokens: int) -> None:
        index = self.counts.get(part.kind, 0)
        self.counts[part.kind] = index + 1
        self.attachments.append(Attachment(part.kind, index, part.value or "", tokens, self.size))
        self.put(f"<|{part.kind}:{index}|>")

    def visit_text(self, part: Part) -> None:
        if part.value:
            self.put((BETWEEN if self.after_text else "") + escape(part.value))
        elif self.beside:
            self.put(EMPTY)

    def visit_image(self, part: Part) -> None:
        self.attach(part, max(1, -(-part.width // self.patch)) * max(1, -(-part.height // self.patch)))

    def visit_audio(self, part: Part) -> None:
        self.attach(part, max(1, -(-int(part.seconds * 1000) * self.audio_rate // 1000)))

    def visit_document(self, part: Part) -> None:
        self.attach(part, max(1, part.pages) * self.page_tokens)

    def turn(self, role: str | None, parts: list[Part]) -> str:
        """The formatted turn."""
        self.out, self.beside, self.after_text = [], len(parts) > 1, False
        self.put(f"{TURN}{escape(role or '').replace(chr(10), BREAK)}\n{'' if parts else NONE}")
        for p in parts:
            self.visit(p)
        self.put(f"{END}\n")
        return "".join(self.out)


@dataclass(frozen=True)
class Turn:
    """A turn read back: its parts, and where its escaped texts stand."""

    role: str
    parts: list[Part]
    texts: list[tuple[int, int]]


def read_turns(text: str, attachments: list[Attachment] = ()) -> Iterator[Turn]:
    """The formatted turns; a placeholder's part has its reference if that is among the attachments, else null."""
    known = {(a.kind, a.index): a.reference for a in attachments}
    at = 0
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError("a turn must begin here")
        line = text.index("\n", at)
        end = text.index(END, line)
        parts: list[Part] = []
        spans: list[tuple[int, int]] = []
        here = line + 1

        def run(to: int) -> None:
            if to > here:
                parts.append(Part("text", unescape(text[here:to])))
                spans.append((here, to))

        for m in MARKS.finditer(text, here, end):
            run(m.start())
            here = m.end()
            if m[2]:
                parts.append(Part(m[2], known.get((m[2], int(m[3])))))
            elif m[1] == "empty":
                parts.append(Part("text", ""))
        run(end)
        if end == line + 1:
            parts.append(Part("text", ""))
        if any("<|" in text[a:b] for a, b in spans):
            raise ValueError("an unknown control string")
        yield Turn(unescape(text[at + len(TURN) : line].replace(BREAK, "\n")), parts, spans)
        at = end + len(END) + 1


class _Digest:
    """Folds the formatted turns of one conversation, reading each back from the output."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.loss, self.size, self.turns, self.mask = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        self.parts = 0
        self.flattener = Flattener()

    def add(self, role: str | None, parts: list[Part]) -> None:
        made = self.flattener.turn(role, parts)
        self.size += len(made)
        for turn in read_turns(made):
            self.n += 1
            self.parts += len(turn.parts)
            self.turns.update(f"{turn.role}\n{''.join(p.value for p in turn.parts if p.kind == 'text')}\n".encode())
            if turn.role == "assistant":  # the loss mask has these stretches of the output
                for a, b in turn.texts:
                    spoken = unescape(made[a:b])
                    self.loss += len(spoken)
                    self.mask.update(spoken.encode())

    def row(self) -> tuple:
        own = self.flattener.attachments
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.mask.hexdigest(), self.size, self.parts, len(own), sum(a.tokens for a in own)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_parts long, n_attachments long, expanded_tokens long"


def _rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [x.split() for x in DIGESTS.split(", ")]
    types = [kind, *(pa.int64() if t == "long" else pa.string() for _, t in columns)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=["conv_id", *(n for n, _ in columns)])


def _parts(rows: list[dict] | None) -> list[Part]:
    return [Part(**{k: v for k, v in p.items() if v is not None or k in ("kind", "value")}) for p in rows or []]


@common.lean
def _fold(batches: Iterator[pa.RecordBatch], typed: bool) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    kind = pa.int64()
    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, role, said in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(role, _parts(said) if typed else [Part("text", said)])
        yield _rows(done, kind)
    if now:
        yield _rows([now.row()], kind)


@common.lean
def _format(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    """One row per turn; state is carried over a conversation's turns."""
    now: tuple[object, Flattener] | None = None
    names = ["conv_id", "turn", "formatted", "loss", "attachments", "tokens"]
    item = pa.struct([("kind", pa.string()), ("index", pa.int32()), ("reference", pa.string()), ("tokens", pa.int64()), ("offset", pa.int64())])
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for conv, role, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if now is None or now[0] != conv:
                now = conv, Flattener(**options)
            f = now[1]
            known = len(f.attachments)
            out[0].append(f.turn(role, _parts(parts)))
            new = f.attachments[known:]
            out[1].append(role == "assistant")
            out[2].append([vars(a) for a in new])
            out[3].append(sum(a.tokens for a in new))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.list_(item)), pa.array(out[3], pa.int64())], names=names)


def _in_order(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), *more)


def format_parts(turns: DataFrame, **options) -> DataFrame:
    """Turns (conv_id, turn, role, parts array of struct) to one row each: conv_id, turn, formatted, loss, attachments, tokens.

    The concatenation of a conversation's rows by turn is its whole output; `offset` counts code points in that.
    """
    common.prepare(turns.sparkSession)
    rows = _in_order(turns.select("conv_id", "turn", "role", "parts"))
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    return rows.mapInArrow(
        partial(_format, options=options),
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss boolean, attachments array<struct<kind string, index int, reference string, tokens bigint, offset bigint>>, tokens long",
    )


PART = "struct<kind string, value string>"


@common.lean
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("value", pa.string())])
    for batch in batches:
        roles, parts = [], []
        for made, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            (turn,) = read_turns(made, [Attachment(**a) for a in own or []])
            roles.append(turn.role)
            parts.append([{"kind": p.kind, "value": p.value} for p in turn.parts])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(parts, pa.list_(item))], names=["conv_id", "turn", "role", "parts"])


def read_parts(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts from rows of format_parts."""
    common.prepare(formatted.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in formatted.schema}
    return formatted.select("conv_id", "turn", "formatted", "attachments").mapInArrow(_read, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, parts array<{PART}>")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from turns with text or with parts: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_parts, n_attachments, expanded_tokens (of all placeholders)."""
    common.prepare(turns.sparkSession)
    said = "parts" if "parts" in turns.columns else "text"
    order = F.to_json("parts") if said == "parts" else F.col("text")
    rows = _in_order(turns, order.asc_nulls_first()).select("conv_id", "role", said)
    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_fold, typed=said == "parts"), f"conv_id {kind}, {DIGESTS}")


ADDED = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(ADDED).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    more = more.select(*[F.col(f"x.{f.name}").cast(f.dataType).alias(f.name) for f in rows.schema])
    return digests(rows.unionByName(more))


OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(role) + 8 * len(regexp_extract_all(role, chr(10))) + length(text) + 17 + len(regexp_extract_all(role || chr(10) || text, '<\\\\*\\|'))
    + coalesce(list_sum(list_transform(regexp_extract_all(role || chr(10) || text, '<\\\\*\\|'), lambda x: length(x) - 2)), 0) AS f
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(f) AS BIGINT) AS formatted_chars, count(*) AS n_parts, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM s GROUP BY conv_id
"""
