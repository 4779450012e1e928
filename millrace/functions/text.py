"""Text functions of the retrieval engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9']+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_text(c: Column) -> Column:
    """Line ends to LF, runs of blanks to one space, lines stripped, three or more line ends to two, stripped."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t ]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def stable_key(source: Column, version: Column, source_id: Column) -> Column:
    return F.concat_ws(":", source, version, source_id)


def chunk_key(document: Column, ordinal: Column) -> Column:
    return F.concat_ws("#", document, ordinal.cast("string"))


def content_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]))


def searchable_text(title: Column, facts: Column, body: Column) -> Column:
    """Title, facts and body with blank lines between; what is null or empty is left out."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in (title, facts, body)])


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def display_location(title: Column, path: Column) -> Column:
    return F.concat_ws(" › ", title, path)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda x: x != "")


def excerpt(c: Column, limit: int) -> Column:
    """Blanks collapsed; cut at the last space before the limit, with an ellipsis."""
    flat = strip(F.regexp_replace(c, r"\s+", " "))
    head = F.substring(flat, 1, limit)
    last = F.instr(F.reverse(head), " ")
    cut = F.when(last > 0, F.substring(head, F.lit(1), F.length(head) - last)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for a query without tokens."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, text)) / F.size(q))


def bucket(term: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long"), F.lit(dim))


def bucket_sign(term: Column) -> Column:
    """1 if the sixteenth hexadecimal digit of the digest is 8 or more, else -1."""
    return F.when(F.substring(F.md5(term), 16, 1) >= "8", 1.0).otherwise(-1.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, cast to double; null if either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("'"), F.lit("")), "[ _]+", "-")


def strip_markup(c: Column) -> Column:
    """Scripts, styles and tags out, the five common entities decoded, blanks collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_wikitext(c: Column) -> Column:
    """References, tables, file links, nested templates (five passes), links, tags and quotes out."""
    c = F.regexp_replace(c, r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    c = F.regexp_replace(c, r"(?s)\{\|.*?\|\}", "")
    c = F.regexp_replace(c, r"(?i)\[\[(?:file|image):[^\]]*\]\]", "")
    for _ in range(5):
        c = F.regexp_replace(c, r"\{\{[^{}]*\}\}", "")
    c = F.regexp_replace(c, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    return strip(F.regexp_replace(c, "'{2,}", ""))
