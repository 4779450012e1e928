"""Secret scans by assignment-aware lexing.

Source and configuration text is lexed around its assignment signs into (name, literal) pairs; calls with a
quoted first argument and elements with a text are pairs as well.
Literals bound to plain names are kept as constants of the document, so that ``password = BASE + "x"``
or ``db.password: *pw`` leads back to the literal that holds the secret.  A pair's score is how
sensitive the target name is, times how much the literal, alone or joined with the others of the right
side, looks like a value rather than a placeholder.

Three fixed patterns (assign, access, hex) are always reported besides.  Documents are scanned whole,
one at a time inside a map over Arrow batches: no shuffle, memory bounded by the longest text.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, slices

KINDS = ("assign", "access", "hex", "literal")

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # whole runs of capitals and digits: those under 16 fail
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a target name is, by the words it is made of.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.9, "secretkey": 1.0,
    "authkey": 0.9, "bearer": 0.8, "pw": 0.7, "pass": 0.7, "auth": 0.6, "signature": 0.5, "salt": 0.5, "key": 0.4,
}
#: With "key" these words name a secret.
KEY_OF = {"api", "private", "access", "secret", "auth", "signing", "encryption", "master", "account", "client", "ssh", "deploy"}
PLACEHOLDER = re.compile(r"(?i)^(?:none|null|nil|true|false|undefined|changeme|change_me|example|sample|test|dummy|todo|password|secret|token|string|your.*|x+|\*+|\.+|-+|_+|0+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|os\.environ.*|env\[.*|getenv.*)$")
THRESHOLD = 0.6
SHORT = 256
HUGE = 10**12

_SIGN = re.compile(r"=>|:=|==|[!<>]=|[=:]")
_QUOTED = r"""[rbuf]?"((?:[^"\\\n]|\\.)*)"|[rbuf]?'((?:[^'\\\n]|\\.)*)'"""
_BARE = r"[A-Za-z0-9+/_.\-@!#%^*~]"
#: A block string, a quoted one, a name, or a bare literal: that ends before the next sign, "&", ";" or ",", so that no two
#: right sides share text, but for the signs that fill up base64.
_TERM = re.compile(rf"""[ \t]*+(?:[rbuf]?\"\"\"(.*?)\"\"\"|[rbuf]?\'\'\'(.*?)\'\'\'|{_QUOTED}|`([^`\n]*)`|([*&$]?[A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9_.+/=\-])|({_BARE}+(?:={{1,2}}(?![A-Za-z0-9+/_.=\-@!#%^*~"'`]))?))""", re.DOTALL)
_NAMED, _BARE_TERM = 6, 7
_CALL = re.compile(rf"\([ \t]*+(?:{_QUOTED})[ \t]*+[,)]")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:[ \t][^<>]*+)?>([^<>\n]++)</\1>")
#: A call whose name begins so asks for what its argument names.
ASKING = {"get", "read", "load", "fetch", "find", "lookup", "has", "is", "require", "need", "ask", "prompt", "input", "check"}
_PLUS = re.compile(r"[ \t]*+(?:\+|\.\.|\.(?= ))")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_IN_NAME = _LETTERS | frozenset("0123456789.-")


def name_score(name: str) -> float:
    words = [w.lower() for w in _SPLIT.findall(name)]
    score = max((NAME_WEIGHT.get(w, 0.0) for w in words), default=0.0)
    joined = "".join(words)
    for w in ("apikey", "privatekey", "accesskey", "secretkey", "authkey", "password", "passwd"):
        if w in joined:
            score = max(score, NAME_WEIGHT[w])
    if any(w in ("key", "keys") for w in words) and KEY_OF & set(words):
        score = max(score, 0.9)
    return score


_known_score = functools.lru_cache(4096)(name_score)


def _score_of(name: str) -> float:
    return _known_score(name) if len(name) <= 64 else name_score(name)


def mixed_score(length: int, counts: Counter) -> float:
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values())
    kinds = len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in counts})
    return min(1.0, 0.25 * kinds + 0.15 * entropy + 0.01 * length)


def literal_score(value: str) -> float:
    """0 to 1: long, mixed literals count more, digits alone half; placeholders and plain short words count nothing."""
    if len(value) < 6 or PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    return mixed_score(len(value), Counter(value)) * (0.5 if value.isdigit() else 1.0)


def name_before(text: str, at: int) -> str:
    """The name that ends before a sign at ``at``, with a quote, a bracket and blanks between; empty if there is none."""
    i = at - 1 if at and text[at - 1] == "\n" else at
    while i and text[i - 1] in " \t":
        i -= 1
    if i and text[i - 1] in "\"'`":
        i -= 1
    if i and text[i - 1] == "]":
        i -= 1
        if i and text[i - 1] in "\"'`":
            i -= 1
    start = i
    while start and text[start - 1] in _IN_NAME:
        start -= 1
    while start < i and text[start] not in _LETTERS:
        start += 1
    return text[start:i]


class Value:
    """What a right side leads back to: literals of its own and values of earlier names, never copied.

    ``joint`` are those joined to its value, which unknown names in a sum are not.  Of the joined text
    only what scoring asks for is kept: its length, its characters' counts and, while short, itself."""

    __slots__ = ("literals", "names", "length", "counts", "text", "weight", "whole")

    def __init__(self) -> None:
        self.literals: list[tuple[int, int, str, bool]] | tuple = ()
        self.names: list[Value] | tuple = ()
        self.length, self.counts, self.text = 0, None, ""  # a short text is counted when it is asked for
        self.weight = self.whole = 0.0  # the highest score of a name that leads here; the same for the joined text

    def take(self, start: int, end: int, literal: str, joint: bool) -> None:
        self.literals = self.literals or []
        self.literals.append((start, end, literal, joint))
        if joint:
            self._join(len(literal), literal, None)

    def lead(self, other: Value) -> None:
        self.names = self.names or []
        self.names.append(other)
        self._join(other.length, other.text, other.counts)

    def _join(self, length: int, text: str | None, counts: Counter | None) -> None:
        """Put a text at the end, or one of which only the length and counts are known."""
        if self.text is not None and text is not None and self.length + length <= SHORT:
            self.length, self.text = self.length + length, self.text + text
            return
        own = self.counts if self.text is None else Counter(self.text)
        self.counts, self.text = own + (Counter(text) if counts is None else counts), None
        self.length += length
        if self.length > HUGE:  # only repeated sums get here: from now on in proportion
            self.counts = Counter({c: n * 1e-6 for c, n in self.counts.items()})
            self.length = sum(self.counts.values())

    def score(self) -> float:
        """literal_score of the joined text; a long one is no placeholder and a blank anywhere in it counts."""
        if self.text is not None:
            return literal_score(self.text)
        return 0.0 if self.counts[" "] else mixed_score(self.length, self.counts)


def literal_pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of each assignment in text order, then of calls with a quoted first argument and of elements.

    A value is made before those that lead back to it."""
    constants: dict[str, Value] = {}
    for sign in _SIGN.finditer(text):
        if sign[0] in ("==", "!=", "<=", ">="):
            continue
        if not (name := name_before(text, sign.start())):
            continue
        value, pos, bare = Value(), sign.end(), []
        while t := _TERM.match(text, pos):
            group = t.lastindex
            if group == _NAMED:  # a name: lead back to its literals, or take a bare word of a configuration line
                known = constants.get(t[group].lstrip("*&$"))
                if known is not None:
                    value.lead(known)
                elif sign[0] in ("=", ":") and t[group][0] not in "*&$":
                    bare.append((t.start(group), t.end(group), t[group]))
            elif group:
                value.take(t.start(group), t.end(group), t[group], True)
            pos = t.end()
            if not (plus := _PLUS.match(text, pos)):
                break
            pos = plus.end()
        alone = len(bare) == 1 and not value.literals and not value.names
        for word in bare:
            value.take(*word, alone)
        if value.literals or value.names:
            constants[name] = value
            yield name, value
    for call in _CALL.finditer(text):
        name = name_before(text, call.start())
        if name and _SPLIT.findall(name)[:1] and _SPLIT.findall(name)[0].lower() not in ASKING:
            value = Value()
            value.take(call.start(call.lastindex), call.end(call.lastindex), call[call.lastindex], True)
            yield name, value
    for element in _ELEMENT.finditer(text):
        value = Value()
        value.take(element.start(2), element.end(2), element[2], True)
        yield element[1], value


def literal_spans(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of the literals that sensitive names lead back to.

    Scores go from the names to the literals, last value first, over every link once: the work grows
    with the text, however often values are joined to values."""
    values, plain = [], {}  # those that have a weight or lead on; those that are led to and do neither
    for name, value in literal_pairs(text):
        if weight := _score_of(name):
            value.weight = weight
            value.whole = weight * value.score()
        if weight or value.names:
            values.append(value)
            for earlier in value.names:
                if not (earlier.weight or earlier.names):
                    plain[id(earlier)] = earlier
    for value in (*reversed(values), *plain.values()):
        if not value.weight:
            continue
        for start, end, literal, joint in value.literals:
            score = max(value.weight * literal_score(literal), value.whole if joint else 0.0)
            if score >= THRESHOLD and end > start:
                yield start, end, score
        for earlier in value.names:
            earlier.weight, earlier.whole = max(earlier.weight, value.weight), max(earlier.whole, value.whole)


def scan(text: str | None) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of all spans of a whole text, by start and then kind; none of a null or empty one."""
    if not text:
        return []
    found: dict[tuple[int, int, int], float] = {}
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found[m.start(), 0, m.end()] = 1.0
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            found[m.start(), 1, m.end()] = 1.0
    for m in HEX.finditer(text):
        found[m.start(), 2, m.end()] = 0.8
    if any(c in text for c in "=:(<"):
        for start, end, score in literal_spans(text):
            found[start, 3, end] = max(score, found.get((start, 3, end), 0.0))
    return [(s, KINDS[k], e, v) for (s, k, e), v in sorted(found.items())]


def joined(spans: list[tuple[int, str, int, float]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def redacted(text: str | None, spans: list[tuple[int, str, int, float]]) -> str | None:
    """The text with every maximal run of covered code points replaced by ``[SECRET]``."""
    if not spans:
        return text
    out, last, end = [], 0, -1
    for start, _, stop, _ in spans:
        if start > end:
            if end >= 0:
                last = end
            out += [text[last:start], "[SECRET]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ``secrets`` array<struct<kind,start,end,score>>, ``redacted`` text.

    Offsets are code points, end exclusive.  A null text has no secrets and stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for b in (part for whole in batches for part in slices(whole, 1)):
            texts = b.column(1).to_pylist()
            found = [scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([[{"kind": k, "start": s, "end": e, "score": v} for s, k, e, v in f] for f in found], pa.list_(item)),
                    pa.array([redacted(t, f) for t, f in zip(texts, found, strict=True)], pa.string()),
                ],
                ["id", "secrets", "redacted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.transform(arrow_map, run, f"id {kind}, secrets array<struct<kind:string,start:long,end:long,score:double>>, redacted string")
    return out.withColumnRenamed("id", id_col)


def scan_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of a scan, made in the same map: id, n_assign, n_access, n_hex, n_literal, base_sha256, spans.

    A null or empty text has no spans: its counts are 0, spans is empty and base_sha256 that of nothing.
    Repeated rows get equal results each; extra columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            cols: list[list] = [[], [], [], [], [], []]
            for text in b.column(1).to_pylist():
                found = scan(text)
                counts = Counter(kind for _, kind, _, _ in found)
                base = joined([x for x in found if x[1] != "literal"])
                for col, value in zip(cols, (counts["assign"], counts["access"], counts["hex"], counts["literal"], hashlib.sha256(base.encode()).hexdigest(), joined(found)), strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.transform(arrow_map, run, f"id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all columns, with the spans of a scan replaced in the text and the length column, if docs
    has one, counted anew where the text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text_col))):
            at = b.schema.get_field_index(text_col)
            before = b.column(at).to_pylist()
            after = [redacted(t, scan(t)) for t in before]
            b = b.set_column(at, b.schema.field(at), pa.array(after, b.column(at).type))
            k = b.schema.get_field_index(length_col)
            if k >= 0:
                sizes = [n if t is u or t == u else len(u) for n, t, u in zip(b.column(k).to_pylist(), before, after, strict=True)]
                b = b.set_column(k, b.schema.field(k), pa.array(sizes, b.column(k).type))
            yield b

    return docs.transform(arrow_map, run, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express: how many matches each base pattern has."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE_ORACLE = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM documents
"""
