"""Cutting documents into self-describing chunks along headings, paragraphs and sentences.

Packing is a fold over a document's pieces, so it runs per document inside a map over Arrow batches: no
shuffle, memory bounded by the longest document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^\s*(?:(?P<hashes>#{1,6})\s+(?P<title>.+?)|(?P<bars>={2,6})\s*(?P<wiki>.+?)\s*(?P=bars))\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Sizes:
    """Sizes in tokens of four characters each."""

    target: int = 400
    most: int = 512
    overlap: int = 60
    least: int = 24


def sections(body: str) -> Iterator[tuple[list[str], str]]:
    """(path of headings, text) of each run of lines between headings.  A heading of level 1 or 2 starts a
    new path, one of level L stands L - 2 deep."""
    path: list[str] = []
    lines: list[str] = []
    for line in body.split("\n"):
        m = _HEADING.match(line)
        if not m:
            lines.append(line)
            continue
        if any(x.strip() for x in lines):
            yield path, "\n".join(lines)
        level = len(m["hashes"] or m["bars"])
        path, lines = [*path[: max(0, level - 2)], (m["title"] or m["wiki"]).strip()], []
    if any(x.strip() for x in lines):
        yield path, "\n".join(lines)


def pieces(paragraph: str, most: int) -> Iterator[str]:
    """The paragraph whole if it fits, else whole sentences packed up to ``most``; a longer sentence is cut at blanks."""
    if len(paragraph) <= most:
        yield paragraph
        return
    packed: list[str] = []
    for sentence in _SENTENCE.split(paragraph):
        if packed and len(packed[-1]) + 1 + len(sentence) <= most:
            packed[-1] += " " + sentence
        else:
            packed.append(sentence)
    for p in packed:
        while len(p) > most:
            at = p.rfind(" ", 0, most)
            at = at if at > 0 else most
            yield p[:at].strip()
            p = p[at:].strip()
        if p:
            yield p


def tail(text: str, n: int) -> str:
    """The last n characters from the first sentence, else the first word, that begins in them; a text of
    no more than n characters whole."""
    if len(text) <= n:
        return text
    if n <= 0:
        return ""
    end = text[-n:]
    m = _SENTENCE.search(end)
    return end[m.end() if m else end.find(" ") + 1 :].strip()


def chunks_of(header: str, facts: str, body: str, sizes: Sizes = Sizes()) -> list[tuple[str, list[str]]]:
    """(text, heading path) of each chunk; at least one.  The facts go with the first chunk."""
    target, most, overlap, least = (4 * x for x in (sizes.target, sizes.most, sizes.overlap, sizes.least))
    out: list[tuple[str, list[str]]] = []

    def emit(text: str, path: list[str]) -> None:
        out.append(("\n".join([header, *([" > ".join(path)] if path else []), *([facts] if facts and not out else []), text]), path))

    for path, text in sections(body):
        buffer = ""
        for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
            for piece in pieces(paragraph, most):
                longer = f"{buffer}\n\n{piece}" if buffer else piece
                if buffer and len(longer) > target:
                    emit(buffer, path)
                    longer = f"{tail(buffer, overlap)}\n\n{piece}".strip()
                buffer = longer
        if buffer and len(buffer) < least and out and out[-1][1] == path and len(out[-1][0]) + len(buffer) <= most:
            out[-1] = (f"{out[-1][0]}\n\n{buffer}", path)
        elif buffer:
            emit(buffer, path)
    return out or [("\n".join(filter(None, [header, facts])), [])]


def chunk_documents(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(document_key, ordinal, heading_path, text) of docs with document_key, header, facts and body.

    Null headers, facts and bodies are empty.  Extra columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for key, header, facts, body in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for k, (text, path) in enumerate(chunks_of(header or "", facts or "", body or "", sizes)):
                    for col, value in zip(cols, (key, k, path, text), strict=True):
                        col.append(value)
            kinds = [b.column(0).type, pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["document_key", "ordinal", "heading_path", "text"])

    rows = docs.select("document_key", *[F.col(c).cast("string").alias(c) for c in ("header", "facts", "body")])
    kind = docs.schema["document_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"document_key {kind}, ordinal int, heading_path array<string>, text string")


def split_texts(df: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, pos, piece): each text in pieces of at most ``most`` characters; a null or blank text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, out = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for n, piece in enumerate(filter(str.strip, pieces(text or "", most))):
                    at.append(k)
                    pos.append(n)
                    out.append(piece)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(out, pa.string())], ["id", "pos", "piece"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, pos int, piece string").withColumnRenamed("id", id_col)
