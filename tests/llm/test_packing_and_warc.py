"""Packing and WARC archives: exact round trips."""

import base64
import hashlib
import random
import struct
import zlib

from galvani.llm.common import Scratch
from galvani.llm.packing import best_fit_decreasing, encode, pack_documents
from galvani.llm.warc import read_archives, warc_round_trip, write_archives

TEXTS = [None, "", "Hello world", "é中文 🙂 mixed\n\n  spaces  ", "word " * 5000, "Hello world", "<|endoftext|> is a token", "a <|endoftext|> b<|endoftext|>"]


def test_ids_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice("abcéñ 中\n\t'12!ſK ") for _ in range(rng.randrange(60))) for _ in range(300)]
    for x in texts:
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids


def test_long_runs_of_blanks_are_encoded_like_any_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for blank in (" ", "\n", " \n"):
        for n in (99_999, 1_000_000):
            text = "a" + blank * n + "x <|endoftext|>"
            assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_best_fit_against_a_plain_search():
    rng = random.Random(4)
    for window in (7, 64, 100):
        lengths = [rng.randrange(1, window + 1) for _ in range(120)]
        place, n = best_fit_decreasing(lengths, window)
        free, want = [], 0
        for x in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= x]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - x)
            else:
                free.append(window - x)
        want = len(free)
        assert n == want
        used = {}
        for x, (at, offset) in zip(lengths, place, strict=True):
            used.setdefault(at, []).append((offset, x))
        for pieces in used.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(x for _, x in pieces[:k]) for k in range(len(pieces))] and sum(x for _, x in pieces) <= window


def test_pieces_make_up_their_documents(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    rows = pack_documents(docs).collect()
    for i, t in enumerate(TEXTS):
        ids = [*encode(t), 0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        at = 0
        for r in mine:
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r["length"]
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert pack_documents(docs.limit(0)).collect() == []


def test_lots_bound_what_is_held(spark):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    a, b = (pack_documents(docs, lot=lot).collect() for lot in (7, 1000))
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(a) == key(b)


PAGES = [(1, "u", "aaa"), (2, "u", "aaa"), (3, None, None), (4, "x\ny % é", "é" * 90_000), (5, "z", "é" * 90_000), (None, "q", "aaa"), (6, "a", ""), (7, "w", "WARC/1.1\r\n\r\n\r\nHTTP"), (None, "n", "lone"), (None, "m", "lone")]


def want(pages, least=0):
    out = []
    for page, url, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        revisit = len(body) >= least and bool(same) and page != max(same)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None, True))
    return sorted(out, key=repr)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, b"x", 1) for p in PAGES], "page_id long, url string, html string, data binary, sha1 int")
    assert sorted((tuple(r) for r in warc_round_trip(pages).collect()), key=repr) == want(PAGES)
    assert warc_round_trip(pages.limit(0)).collect() == []


def test_archives_hold_urls_and_small_chunks(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    chunks = write_archives(pages, Scratch(spark), least_bytes=10, chunk_chars=100)
    assert max(len(zlib.decompress(r["data"], wbits=31)) for r in chunks.filter("chunk_no > 0").collect()) <= 400
    rows = read_archives(chunks).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["intact"]) for r in rows), key=repr) == want(PAGES, 10)
    assert {r["page_id"]: r["url"] for r in rows if r["page_id"] == 4} == {4: "x\ny % é"}


def test_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "abcdef" * 100)], "page_id long, url string, html string")
    rows = [tuple(r) for r in write_archives(pages, Scratch(spark), chunk_chars=25).collect()]
    rows = [(r, no, bytes(zlib.compress(b"X" * 100, wbits=31)) if no == 3 else bytes(data), bytes(sha1)) for r, no, data, sha1 in rows]
    broken = spark.createDataFrame(rows, "record_id long, chunk_no int, data binary, payload_sha1 binary")
    assert [r["intact"] for r in read_archives(broken).collect()] == [False]


def test_records_are_dated_and_revisits_name_a_record(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = write_archives(pages, Scratch(spark)).orderBy("record_id", "chunk_no").collect()
    heads = [zlib.decompress(r["data"], wbits=31).decode().split("\r\n\r\n")[0].split("\r\n") for r in rows if r["chunk_no"] == 0]
    fields = [dict(line.split(": ", 1) for line in head[1:]) for head in heads]
    names = {f["WARC-Record-ID"]: f for f in fields}
    assert len(names) == len(PAGES) and all(len(f["WARC-Date"]) == 20 for f in fields)
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 4
    for f in revisits:
        first = names[f["WARC-Refers-To"]]
        assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]


def test_an_archive_in_any_order_or_in_part(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    chunks = write_archives(pages, Scratch(spark), chunk_chars=100)
    whole = {(r["page_id"], r["payload_digest"], r["intact"]) for r in read_archives(chunks.orderBy("payload_sha1", "data")).collect()}
    assert whole == {(p, d, True) for p, _, d, *_ in want(PAGES)}
    cut = read_archives(chunks.filter("chunk_no < 3")).collect()
    assert len(cut) == len(PAGES) and {r["page_id"] for r in cut if not r["intact"]} == {4, 5} - {r["page_id"] for r in cut if r["record_type"] == "revisit"}


def test_a_payload_with_very_many_copies(spark):
    rows = [(i, "u", "same") for i in range(50)] + [(i, "u", f"page {i % 60}") for i in range(50, 150)]
    found = sorted((tuple(r) for r in warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=repr)
    assert found == want(rows)
