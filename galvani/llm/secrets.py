"""Secret scans: three fixed kinds of spans, and spans of high sliding-window Shannon entropy."""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

# The base kinds, in their order, and the least length of what counts.
ASSIGN = re.compile(rb"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

# The entropy scan: strings of so many of these characters, windows of WINDOW characters, and the bits a character
# from which a window stands out, by the class of the string.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "mixed": 3.6, "letters": 4.25}
# Allow-list: parts of a string that look random but are known not to be secrets. Those shorter than a window hide none.
ALLOWED = [
    re.compile(rb"[0-9+/_=-]{20,}"),  # numbers, dates, rules
    re.compile(rb"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![A-Za-z0-9])"),  # UUIDs
    re.compile(rb"sha(?:1|256|384|512)-[A-Za-z0-9+/=]{16,}"),  # integrity hashes of web pages
    # file paths, slugs, names with underscores: all of their words of letters only or of digits only
    re.compile(rb"(?<![A-Za-z0-9])(?:[A-Za-z]+|[0-9]+)(?:[-_/](?:[A-Za-z]+|[0-9]+))+(?![A-Za-z0-9])"),
    re.compile(rb"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),  # the key of public manuals
]
# A word of letters and digits that holds one of these is allowed, however short.
PLACEHOLDER = re.compile(rb"EXAMPLE|example|0123456789|abcdefghij|ABCDEFGHIJ")
WORD = re.compile(rb"[A-Za-z0-9]+")

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def _class(s: bytes) -> str | None:
    digits = any(48 <= c <= 57 for c in s)
    if digits and all(48 <= c <= 57 or 97 <= c <= 102 for c in s):
        return "hex"
    if digits:
        return "mixed"
    return "letters" if s != s.lower() and s != s.upper() else None


def unlisted(s: bytes) -> list[tuple[int, int]]:
    """The parts of a string that the allow-list leaves, of a window or more."""
    allowed = [m.span() for known in ALLOWED for m in known.finditer(s) if m.end() - m.start() >= WINDOW]
    if PLACEHOLDER.search(s):
        allowed += [m.span() for m in WORD.finditer(s) if PLACEHOLDER.search(m[0])]
    parts, at = [], 0
    for a, b in sorted(allowed):
        if a - at >= WINDOW:
            parts.append((at, a))
        at = max(at, b)
    return parts + [(at, len(s))] * (len(s) - at >= WINDOW)


def entropy_spans(s: bytes) -> list[tuple[int, int]]:
    """Unions of the windows whose Shannon entropy reaches the bits of their part's class; the parts are what the
    allow-list leaves of the string."""
    return [(at + a, at + b) for at, end in unlisted(s) for a, b in _entropy_spans(s[at:end])]


def _entropy_spans(s: bytes) -> list[tuple[int, int]]:
    """The entropy of a window is log2(W) - sum(n log2 n) / W over its counts n; a step changes two counts only."""
    kind = _class(s)
    if kind is None:
        return []
    term = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]
    counts, total, spans = [0] * 256, 0.0, []
    for end, c in enumerate(s):
        total += term[counts[c] + 1] - term[counts[c]]
        counts[c] += 1
        if end >= WINDOW:
            old = s[end - WINDOW]
            total += term[counts[old] - 1] - term[counts[old]]
            counts[old] -= 1
        start = end - WINDOW + 1
        if start >= 0 and log2(WINDOW) - total / WINDOW >= LEAST_BITS[kind] - 1e-9:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end + 1)
            else:
                spans.append((start, end + 1))
    return spans


def _assigned(raw: bytes, lower: bytes) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: the expression is tried only where one of its first words stands."""
    starts = []
    for word in ASSIGN_WORDS:
        at = lower.find(word)
        while at >= 0:
            starts.append(at)
            at = lower.find(word, at + 1)
    out, free = [], 0
    for at in sorted(starts):
        if at >= free and (m := ASSIGN.match(raw, at)):
            free = m.end()
            if len(m[2]) >= LEAST_ASSIGN:
                out.append(m.span())
    return out


def _outside(base: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """start..end if no base span overlaps it, else what they leave of it, if at least a window (so that its own windows
    stand out)."""
    out = []
    for a, b in base:
        if a < end and start < b:
            if a - start >= WINDOW:
                out.append((start, a))
            start = b
    return out + [(start, end)] * (end - start >= WINDOW)


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind, in code points."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans = [(at, 0, end) for at, end in _assigned(raw, raw.lower())]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    base = sorted((a, b) for a, _, b in spans)
    for m in CANDIDATE.finditer(raw):
        for a, b in entropy_spans(m[0]):  # what a base kind has found is not told again
            spans += [(x, 3, y) for x, y in _outside(base, a + m.start(), b + m.start())]
    spans.sort()
    if len(raw) != len(text) and spans:
        at = sorted({x for a, _, b in spans for x in (a, b)})
        points, last, n = {}, 0, 0
        for x in at:
            n += len(raw[last:x].decode("utf-8", "surrogatepass"))
            points[x], last = n, x
        spans = [(points[a], k, points[b]) for a, k, b in spans]
    return [(KINDS[k], a, b) for a, k, b in spans]


def _scan(batches):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its secret spans (kind, start, end in code points). One pass without a shuffle.

    A null or empty text has no spans; a null id is kept; repeated rows give repeated results; an empty table gives
    an empty result; other columns are ignored.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)


def _redact(batches):
    for batch in batches:
        text = []
        for t in batch.column("text"):
            t, at, parts = t.as_py(), 0, []
            for kind, a, b in scan_text(t):
                if b > at:
                    parts += [t[at : max(a, at)], f"[{kind}]" if a >= at else ""]
                    at = b
            text.append(t if t is None else "".join(parts) + t[at:])
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(text, pa.string()))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; in the text each secret span is replaced by its kind in brackets. A null text stays null."""
    out = docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs
    out = out.mapInArrow(_redact, out.schema)
    return out.withColumnRenamed("text", text_col) if text_col != "text" else out


def secret_digest(docs: DataFrame) -> DataFrame:
    """The op2 columns."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scan_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
