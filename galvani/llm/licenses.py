"""License scans: an Aho-Corasick automaton over notice phrases and identifier tags, and a
shunting-yard parser for and/or/with license expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices that the scan labels.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Prefix of an identifier in an expression -> label; the longest prefix that fits counts.
IDENTIFIERS = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl",
    "epl": "epl", "bsl": "bsl", "isc": "isc", "zlib": "zlib", "cc-by": "cc-by", "cc0": "cc0", "unlicense": "unlicense", "0bsd": "bsd",
}
#: Labels whose terms ask that derived work carry the same license.
COPYLEFT = {"gpl", "lgpl", "agpl", "gfdl", "mpl", "epl"}
BINDS = {"or": 1, "and": 2, "with": 3}

# Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space; bytes over 0x7F are parts of words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_SYMBOL = re.compile(r"[()]|[a-z0-9.+-]+")

SCHEMA = (
    "doc_id long, n_words long, matches array<struct<phrase:string,label:string,word:long,base:boolean>>, "
    "expressions array<struct<text:string,valid:boolean,permissive:boolean,labels:array<string>>>"
)


def to_postfix(symbols: list[str]) -> list[str] | None:
    """Shunting-yard: infix license expression to postfix; None where brackets or operands don't fit."""
    out, held, operand = [], [], True
    for s in symbols:
        if s == "(" and operand:
            held.append(s)
        elif s == ")" and not operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif s in BINDS and not operand:
            while held and BINDS.get(held[-1], 0) >= BINDS[s]:
                out.append(held.pop())
            held.append(s)
            operand = True
        elif s not in BINDS and s not in "()" and operand:
            out.append(s)
            operand = False
        else:
            return None
    if operand or "(" in held:
        return None
    return out + held[::-1]


def identifier_label(name: str) -> str:
    fits = [p for p in IDENTIFIERS if name.startswith(p)]
    return IDENTIFIERS[max(fits, key=len)] if fits else "other"


def evaluate(postfix: list[str]) -> tuple[bool, set[str]]:
    """Whether the terms can be met without copyleft (or: a choice; and: all; with: an exception lifts them), and all labels."""
    stack: list[tuple[bool, set[str]]] = []
    for s in postfix:
        if s not in BINDS:
            label = identifier_label(s)
            stack.append((label not in COPYLEFT, {label}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if s == "with":
            stack.append((True, left))
        else:
            stack.append(((a or b) if s == "or" else (a and b), left | right))
    return stack[0]


def parse_expression(text: str) -> dict:
    """The expression that a text begins with."""
    lower = text.lower()
    return _parse(lower, 0, len(lower))


def _parse(text: str, start: int, end: int) -> dict:
    """The expression in a stretch of lower-case text: symbols up to what can't belong to one."""
    # prose may follow on the same line: two operands in a row end the expression
    kept: list[str] = []
    for found in _SYMBOL.finditer(text, start, end):
        s = found[0]
        if kept and s not in BINDS and s != ")" and kept[-1] not in BINDS and kept[-1] != "(":
            break
        kept.append(s)
    postfix = to_postfix(kept)
    if not postfix:
        return {"text": " ".join(kept), "valid": False, "permissive": None, "labels": []}
    permissive, labels = evaluate(postfix)
    return {"text": " ".join(kept), "valid": True, "permissive": permissive, "labels": sorted(labels - {"other"})}


@lru_cache(1)
def _automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for found in (NOTICE_PHRASES, BASE_PHRASES):
        for phrase, label in found.items():
            phrases.add_word(f" {phrase} ", (phrase, label, found is BASE_PHRASES))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> tuple[int, list[dict], list[dict]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    if not words:
        return 0, [], []
    phrases, tags = _automata()
    flat = b" %s " % b" ".join(words)
    flat = flat.decode("utf-8", "surrogatepass")
    matches, at, word = [], 0, 0
    ends = sorted((end - len(p) - 1, p, label, base) for end, (p, label, base) in phrases.iter(flat))
    for start, phrase, label, base in ends:  # the word's number is the count of spaces before it
        word += flat.count(" ", at, start)
        at = start
        matches.append({"phrase": phrase, "label": label, "word": word, "base": base})
    expressions = []
    if b"icense" in raw or b"ICENSE" in raw:
        lower = raw.lower().decode("utf-8", "surrogatepass")
        places = [(end + 1, end + 1 - len(tag)) for end, tag in tags.iter(lower)]
        line = -1
        for k, (start, _) in enumerate(places):  # an expression ends with its line, or where the next tag begins
            if line < start:
                line = lower.find("\n", start)
                line = line if line >= 0 else len(lower)
            expressions.append(_parse(lower, start, min(line, places[k + 1][1]) if k + 1 < len(places) else line))
    return len(words), matches, expressions


def _scan(batches):
    kind = pa.struct([("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())])
    said = pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_()), ("labels", pa.list_(pa.string()))])
    for batch in batches:
        found = [scan_text(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(kind)), pa.array([f[2] for f in found], pa.list_(said))],
            ["doc_id", "n_words", "matches", "expressions"],
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its number of words, each phrase match with the number of its first word, and each
    tagged expression with its evaluation. One pass without a shuffle.

    A null or empty text has no words and no matches; a null id is kept; repeated rows give repeated results; an
    empty table gives an empty result; other columns are ignored. An expression that can't be parsed has
    valid = false and null for permissive.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)


def license_digest(docs: DataFrame) -> DataFrame:
    """The op1 columns. score = 1 - 0.5 ** evidence, where a phrase counts 1 and a valid expression 2."""
    base = F.filter("matches", lambda m: m["base"])
    label = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    tagged = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    scanned = scan_licenses(docs).withColumn("base", base)
    place = F.transform("base", lambda m: m["word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        label(F.col("base")).alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform("matches", lambda m: m["label"]), tagged))), ",").alias("labels"),
        (1 - F.pow(F.lit(0.5), F.size("matches") + 2 * F.size(F.filter("expressions", lambda e: e["valid"])))).alias("score"),
        F.to_json("expressions").alias("expressions"),
    )
