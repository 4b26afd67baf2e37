r"""Operator 12 — chat formatting of messages made of typed content parts.

A message has a role and an array of parts (PART): text, image, audio or document.
``Visitor`` visits every part by its kind and flattens it: text becomes escaped text, any
other part an ordered placeholder ``<|kind:place|>`` with a reference to its attachment and
the number of tokens that a model puts in its place.  ``format_chat`` renders one row per
message; a conversation's text is its rows' texts in the order of their turns, so a
conversation of any length is never put together in memory.  The loss mask is run-length
coded: ``mask`` has one run per stretch of the rendered text, true for the text parts of the
roles that are trained on.  All of it is column expressions, without a shuffle.

Every control string starts with ``<|``.  Inside texts a backslash is doubled and a ``<``
before ``|`` or at a part's end is followed by a backslash, so no control string is left in
them, parts can follow each other directly, and reading a backslash as "the next character"
restores every text (``parsed``).

Cases: null roles and texts are empty; a null part or a part without kind is text; parts of
any other kind are placeholders ``other`` of 0 tokens; null or missing sizes count 0 tokens;
a message without parts has an empty body; rows of one turn go by role, then by rendered
text; null conversations are one conversation; repeated rows are repeated turns; an empty
table gives no rows; other columns of the table are not read; very long texts are one row
each, and a digest reads a conversation's rows one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|/turn|>\n"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PIECE = "struct<piece:string,kind:string,uri:string,tokens:bigint>"
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|/turn\|>\n", re.S)
_PLACE = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")


def escaped(text: Column) -> Column:
    """Without control strings; ``unescaped`` gives the text back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(?=\||\z)", r"<\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.?)", r"\1", text, flags=re.S) if "\\" in text else text


def _role(text: str) -> str:
    return re.sub(r"\\(.?)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


class Visitor:
    """Flattens one part into PIECE.  ``patch``: pixels of an image token's side; ``per_second``: audio
    tokens; ``per_page``: tokens of a document's page; ``text_tokens``: tokens of a text."""

    def __init__(self, patch: int = 14, per_second: int = 25, per_page: int = 1024, text_tokens: Callable[[Column], Column] = words):
        self.patch, self.per_second, self.per_page, self.text_tokens = patch, per_second, per_page, text_tokens

    def visit(self, part: Column, place: Column) -> Column:
        kind = F.coalesce(part["kind"], F.lit("text"))
        return (F.when(kind == "text", self.text(part, place)).when(kind == "image", self.image(part, place))
                .when(kind == "audio", self.audio(part, place)).when(kind == "document", self.document(part, place))
                .otherwise(self.other(part, place)))

    def text(self, part: Column, place: Column) -> Column:
        text = F.coalesce(part["text"], F.lit(""))
        return self._piece(escaped(text), "text", F.lit(None), self.text_tokens(text))

    def image(self, part: Column, place: Column) -> Column:
        return self._placed("image", part, place, F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch))

    def audio(self, part: Column, place: Column) -> Column:
        return self._placed("audio", part, place, F.ceil(part["seconds"] * self.per_second))

    def document(self, part: Column, place: Column) -> Column:
        return self._placed("document", part, place, part["pages"] * self.per_page)

    def other(self, part: Column, place: Column) -> Column:
        return self._placed("other", part, place, F.lit(0))

    def _placed(self, kind: str, part: Column, place: Column, tokens: Column) -> Column:
        return self._piece(F.concat(F.lit(f"<|{kind}:"), place.cast("string"), F.lit("|>")), kind, part["uri"], tokens)

    def _piece(self, piece: Column, kind: str, uri: Column, tokens: Column) -> Column:
        return F.struct(piece.alias("piece"), F.lit(kind).alias("kind"), uri.cast("string").alias("uri"),
                        F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("tokens")).cast(PIECE)


def text_part(text: Column) -> Column:
    """A message's parts where it has a text alone."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (
        ("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
                visitor: Visitor | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, formatted, mask, attachments, n_tokens): one row per message.  ``mask``: runs
    (chars, loss) of ``formatted``; ``attachments``: (place, kind, uri, tokens) in order."""
    visitor = visitor or Visitor()
    role = F.coalesce(F.col(role_col), F.lit(""))
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    seen = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
                           F.transform(parts, lambda p, i: visitor.visit(p, i + 1)).alias("pieces"))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    seen = seen.withColumns({"head": head, "loss": F.col("role").isin(*trained)})

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("bigint").alias("chars"), loss.alias("loss"))
    mask = F.concat(F.array(run(F.length("head"), F.lit(False))),
                    F.transform("pieces", lambda p: run(F.length(p["piece"]), F.col("loss") & (p["kind"] == "text"))),
                    F.array(run(F.lit(len(CLOSE)), F.lit(False))))
    placed = F.filter(F.transform("pieces", lambda p, i: F.struct((i + 1).alias("place"), p["kind"].alias("kind"), p["uri"].alias("uri"),
                                                                  p["tokens"].alias("tokens"))), lambda p: p["kind"] != "text")
    return seen.select("conv_id", "turn", "role",
                       F.concat("head", F.array_join(F.col("pieces.piece"), ""), F.lit(CLOSE)).alias("formatted"), mask.alias("mask"),
                       placed.alias("attachments"), F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"]).alias("n_tokens"))


def parsed(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """(role, parts) of every turn in a rendered text: ("text", its text) or (kind, place)."""
    turns = []
    for m in _TURN.finditer(formatted):
        parts, at = [], 0
        for p in _PLACE.finditer(m[2]):
            parts += [("text", unescaped(m[2][at:p.start()]))] * (p.start() > at) + [(p[1], int(p[2]))]
            at = p.end()
        parts += [("text", unescaped(m[2][at:]))] * (len(m[2]) > at)
        turns.append((_role(m[1]), parts))
    return turns


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, mask: list[dict]) -> None:
        for role, parts in parsed(formatted):
            self.turns.update(f"{role}\n{''.join(str(x) for _, x in parts)}\n".encode())
            self.n_turns += 1
        at = 0
        for r in mask:
            if r["loss"]:
                text = unescaped(formatted[at:at + r["chars"]])
                self.loss.update(text.encode())
                self.loss_chars += len(text)
            at += r["chars"]
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGESTS of every conversation, parsed from the rendered texts and their masks: a conversation's rows
    are read in order, one at a time (a chained digest), and only the digests' states are kept."""
    def run(batches: Iterator[pa.RecordBatch]):
        now, rows = None, []
        for batch in batches:
            for conv, text, mask in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if now is None or conv != now.conv:
                    rows += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(text.as_py(), mask.as_py())
            if rows:
                yield _rows(rows)
                rows = []
        if now:
            yield _rows([now.row()])
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("formatted")]
    return (formatted.select("conv_id", "turn", "role", "formatted", "mask").repartition("conv_id").sortWithinPartitions(*order)
            .select(F.col("conv_id").cast("long"), "formatted", "mask").mapInArrow(run, DIGESTS))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      [f.split()[0] for f in DIGESTS.split(", ")])
