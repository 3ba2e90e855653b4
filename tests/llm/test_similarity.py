"""Fingerprints, the n-gram join, substring dedup and decontamination against brute force."""

import hashlib
import random
import re

import pytest

from galvani.llm import decontaminate as D
from galvani.llm.fingerprints import BASE, K, MODULUS, PIECE, WINDOW, fingerprint_documents, near_copies
from galvani.llm.ngram_join import join_by_ngrams, one_of_each_group
from galvani.llm.substring_dedup import LEAST_PIECE, SPREAD, Lot, bands_for, repeated_passages

RNG = random.Random(8)


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def edited(text, n, rng=RNG):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "c") for r in rows], "doc_id long, text string, key string, n int, component_id string")


# --- fingerprints ---------------------------------------------------------------------------------------------------


def winnowed(text):
    tokens = re.findall(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}", text or "")
    h = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % MODULUS for t in tokens]

    def roll(part):
        a = 0
        for x in part:
            a = (a * BASE + x) % MODULUS
        return a

    grams = [roll(h[i : i + K]) for i in range(max(1, len(h) - K + 1))] if h else []
    out = []
    for i in range(max(1, len(grams) - WINDOW + 1)) if grams else []:
        part = grams[i : i + WINDOW]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if (grams[at], at) not in out:
            out.append((grams[at], at))
    return out


TEXTS = [None, "", "  \n", "one", "a b c", "same " * 40, prose(11), prose(12), prose(200), "x" * 500, "é🙂 " * 30, "MIXED case Text " * 9]


def test_fingerprints_against_brute_force(spark):
    found = {r["doc_id"]: [tuple(f) for f in r["fingerprints"]] for r in fingerprint_documents(table(spark, enumerate(TEXTS))).collect()}
    for i, t in enumerate(TEXTS):
        assert found[i] == winnowed(t), t


def test_neighbours_and_edited_texts(spark):
    ids = [5, 3, None, -7, 100, 42, 8, 9, 10, 11, 10**15, -(10**15)]
    rows = sorted(zip(ids, TEXTS, strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    found = {r["doc_id"]: r for r in near_copies(table(spark, rows)).collect()}
    assert len(found) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = ({h for h, _ in winnowed(x)} for x in (t, new, nxt))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = found[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["near_edited"], r["near_next"]) == (like(a, b), like(a, c))
    assert near_copies(table(spark, [])).collect() == [] and near_copies(table(spark, [(1, "a b c d e f")])).first()["near_next"] == 1.0


# --- n-gram join ----------------------------------------------------------------------------------------------------


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    label = {i: i for i, _ in rows}
    sets = [(i, sets_of(t)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s & t and 100 * len(s & t) >= 75 * len(s | t)]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets}


def corpus():
    rng = random.Random(5)
    base, passage, out = [prose(60, rng) for _ in range(6)], prose(30, rng), [None, "", " \t", "one", "ONE", "one two", "a b c d e"]
    for b in base:
        out += [edited(b, k % 7, rng) for k in range(25)] + [b, b.upper(), b + " tail"]
    out += [prose(20, rng) + " " + passage + " " + prose(20, rng) for _ in range(30)] + [passage] * 40
    rng.shuffle(out)
    return list(enumerate(out, 100))


def test_join_against_brute_force(spark):
    rows = corpus()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_by_ngrams(table(spark, rows)).collect()}
    assert found == components(rows)
    kept = {r["doc_id"] for r in one_of_each_group(table(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in found.items() if c == i}


def test_join_of_odd_tables(spark):
    assert join_by_ngrams(table(spark, [])).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (2, None), (2, None)]
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join_by_ngrams(table(spark, rows)).collect()), key=repr)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (2, 0, 2), (2, 0, 2)], key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in one_of_each_group(table(spark, rows)).collect()), key=repr)
    assert kept == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (2, None)], key=repr)


# --- substring dedup ------------------------------------------------------------------------------------------------


def test_repeated_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(6)
    passages = [prose(55, rng) for _ in range(4)]
    rows, want = [(None, passages[0]), (900, None), (901, ""), (902, "short text")], set()
    for i in range(60):
        text = prose(rng.randrange(20, 150), rng)
        if i % 3 == 0:
            w = text.split()
            at = rng.randrange(len(w))
            text = " ".join(w[:at]) + "\n" + passages[i % 4] + " " + " ".join(w[at:])
            want.add(i)
        rows.append((i, text))
    found = repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == want
    text = dict(rows)
    for r in found:
        assert re.sub(r"\s+", " ", text[r["doc_id"]][r["start"] : r["end"]]) in passages[r["doc_id"] % 4]
    first = {min(i for i in want if i % 4 == k) for k in range(4)}
    assert {r["doc_id"] for r in found if r["removed"]} == want - first
    assert repeated_passages(table(spark, [])).collect() == []


def test_found_spans_are_the_whole_passages(spark):
    rng = random.Random(17)
    rows, want = [(50, "a short notice"), (51, "A short\nnotice"), (52, "another")], {50: "a short notice", 51: "A short\nnotice"}
    for i, n in enumerate((51, 51, 60, 100, 200)):
        passage = prose(n, rng)
        for d in (2 * i, 2 * i + 1):
            rows.append((d, prose(70 + d, rng) + " " + passage + " " + prose(90 - d, rng)))
            want[d] = passage
    found = repeated_passages(table(spark, rows)).collect()
    assert sorted((r["doc_id"], dict(rows)[r["doc_id"]][r["start"] : r["end"]]) for r in found) == sorted(want.items())
    assert {r["doc_id"] for r in found if r["removed"]} == {1, 3, 5, 7, 9, 51}


def test_every_word_is_in_a_piece():
    rng = random.Random(18)
    texts = [prose(n, rng) for n in (1, 2, 5, 15, 16, 17, 31, 47, 48, 63, 500)] + [None, "", "same " * 90, "a b " * 60 + prose(40, rng), " \n "]
    lot = Lot(texts)
    a, b = lot.pieces()
    assert {w for x, y in zip(a.tolist(), b.tolist()) for w in range(x, y)} == set(range(len(lot.hashes)))
    assert (lot.text[a] == lot.text[b - 1]).all()
    places = lambda k: sorted(zip((a[lot.text[a] == k] - lot.first[k]).tolist(), lot.spans(a, b)[lot.text[a] == k].tolist()))
    for k, t in enumerate(texts):  # whatever else is in the lot
        own = Lot([t])
        x, y = own.pieces()
        assert places(k) == sorted(zip(x.tolist(), own.spans(x, y).tolist()))


def test_a_copy_of_so_many_words_holds_a_whole_piece():
    rng = random.Random(19)
    for _ in range(200):
        passage = prose(2 * SPREAD + LEAST_PIECE, rng)
        lot = Lot([prose(rng.randrange(90), rng) + " " + passage + " " + prose(rng.randrange(90), rng) for _ in "ab"])
        a, b = lot.pieces()
        content = lot.spans(a, b)
        assert set(content[lot.text[a] == 0]) & set(content[lot.text[a] == 1])


def test_near_copies_in_one_document_are_linked_however_texts_are_dealt_out(spark):
    rng = random.Random(16)
    a = prose(16, rng)
    b = a.split()
    b[-1] = "other"
    docs = table(spark, [(1, a), (1, " ".join(b)), (2, a)])  # rows of one id are one document
    one, many = ({(r["doc_id"], r["n_paragraphs"]) for r in repeated_passages(d).collect()} for d in (docs.coalesce(1), docs.repartition(3)))
    assert one == many == {(1, 2), (2, 1)}


def lines_of(text):
    return [w for w in (line.lower().split() for line in text.split("\n")) if len(w) >= 12]


def test_near_paragraphs_against_all_pairs(spark):
    """Each near copy by the exact similarity of all pairs of paragraphs is told, whatever the partitions."""
    rng = random.Random(21)
    bases = [prose(rng.randrange(40, 90), rng) for _ in range(12)]
    rows = []
    for i in range(90):
        lines = [prose(rng.randrange(15, 60), rng), edited(bases[rng.randrange(12)], rng.randrange(1, 5), rng), prose(rng.randrange(15, 60), rng)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    lines = [(i, shingles(w), len(w)) for i, t in rows for w in lines_of(t)]
    near = {i for k, (i, s, n) in enumerate(lines) for m, (j, t, _) in enumerate(lines) if i != j and n >= 32 and 100 * len(s & t) >= 75 * len(s | t)}
    docs = table(spark, rows)
    key = lambda r: tuple(r)
    one, many = (sorted((key(r) for r in repeated_passages(d).collect()), key=repr) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many
    assert len(near) > 20 and near <= {r[0] for r in one}


def test_passages_of_odd_tables(spark):
    long = prose(400, random.Random(22))
    rows = [(1, long), (1, long), (2, "word " * 5000), (3, "word " * 5000), (4, None), (5, ""), (None, long), (-1, "x"), (6, "x"), (7, long + " " + "z" * 100_000)]
    found = {(r["doc_id"], r["start"], r["end"], r["removed"]) for r in repeated_passages(table(spark, rows)).collect()}
    assert found == {(1, 0, len(long), False), (7, 0, len(long), True), (2, 0, 24_999, False), (3, 0, 24_999, True), (-1, 0, 1, False), (6, 0, 1, True)}


def test_bands_reach_the_recall():
    for rows in (1, 2, 3):
        b = bands_for(0.95, 75, rows)
        assert 1 - (1 - 0.75**rows) ** b >= 0.95 > 1 - (1 - 0.75**rows) ** (b - 1)


# --- decontamination ------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_against_brute_force():
    import numpy as np

    rng = random.Random(7)
    for _ in range(60):
        item, region = ([rng.randrange(4) for _ in range(rng.randrange(1, 8))] for _ in "ab")
        best = min(levenshtein(item, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
        edits, a, b = D.edit_distance_within(np.array(item), np.array(region))
        assert edits == best == levenshtein(item, region[a:b])


def test_copies_with_edits_are_found(spark):
    rng = random.Random(9)
    items = [(i, prose(rng.randrange(14, 60), rng)) for i in range(40)]
    rows, want = [(None, None), (-1, ""), (-2, prose(300, rng))], set()
    for k in range(300):
        item, text = items[k % 40]
        share = (0, 0.05, 0.1)[k % 3]
        copy = edited(text, int(share * len(text.split())), rng)
        rows.append((k, prose(rng.randrange(100), rng) + " " + copy.upper() + ", " + prose(rng.randrange(100), rng)))
        want.add((k, item))
    benchmark = spark.createDataFrame([*items, (99, None), (None, "")], "item_id long, text string")
    found = D.find_benchmark_copies(table(spark, rows), benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(pairs & want) >= 0.97 * len(want) and not pairs - want
    for r in found:
        words = re.findall(r"[a-z0-9]+", dict(rows)[r["doc_id"]].lower())
        assert levenshtein(dict(items)[r["item_id"]].split(), words[r["start_word"] : r["end_word"]]) == r["edits"] <= 0.2 * r["item_words"]
    clean = {r["doc_id"] for r in D.drop_benchmark_copies(table(spark, rows), benchmark).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in pairs}
    again = {(r["doc_id"], r["item_id"]) for r in D.find_benchmark_copies(table(spark, rows), benchmark, block_bytes=2000).collect()}
    assert len(again & want) >= 0.97 * len(want) and not again - want


@pytest.mark.parametrize("length", [1, 3, 5, 8, 12, 40, 200, 500])
@pytest.mark.parametrize("part", [(0, 1), (0, 0.4), (0.6, 1), (0.3, 0.7)], ids=["all over", "head", "tail", "middle"])
def test_recall_at_the_most_edits(length, part):
    """Copies with all the edits that are allowed, spread or in one part, of items short and long."""
    rng = random.Random(length)
    items = [(i, prose(length, rng)) for i in range(20)]
    texts = []
    for k in range(100):
        w = items[k % 20][1].split()
        for _ in range(int(D.EDITS * length)):
            at = rng.randrange(int(part[0] * len(w)), max(int(part[0] * len(w)) + 1, int(part[1] * len(w))))
            w[at : at + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
        texts.append(prose(rng.randrange(60), rng) + " " + " ".join(w) + " " + prose(rng.randrange(60), rng))
    found = {(t, i) for t, i, *_ in D.Index(items).matches(texts)}
    assert sum((k, k % 20) in found for k in range(100)) >= 90


@pytest.mark.parametrize("kind", ["delete", "replace", "insert", "mixed"])
@pytest.mark.parametrize("length", [1, 4, 5, 7, 8, 11, 12, 15, 19, 20, 27, 28, 39, 40, 41, 63, 64, 100, 200, 500])
def test_recall_of_each_kind_of_edit(length, kind):
    """400 copies with exactly the edits that are allowed, all of one kind or mixed, each of which changes something."""
    rng = random.Random(length)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(length))) for i in range(40)]
    texts = []
    for k in range(400):
        w = items[k % 40][1].split()
        for n in range(int(D.EDITS * length)):
            what = kind if kind != "mixed" else rng.choice(["delete", "replace", "insert"])
            at = rng.randrange(len(w))
            w[at : at + (what != "insert")] = [] if what == "delete" else [f"new{k}x{n}"]
        texts.append(prose(rng.randrange(60), rng) + " " + " ".join(w) + " " + prose(rng.randrange(60), rng))
    found = {(t, i) for t, i, *_ in D.Index(items).matches(texts)}
    assert sum((k, k % 40) in found for k in range(400)) >= 360


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d")]), ([(1, "a b c d")], [])])
def test_decontamination_of_empty_tables(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_benchmark_copies(table(spark, docs), benchmark).collect() == []
    assert D.drop_benchmark_copies(table(spark, docs), benchmark).count() == len(docs)


def test_decontamination_of_odd_tables(spark):
    """Repeated rows and null ids give a row each; columns named as those of the result don't matter."""
    item = prose(30, random.Random(3))
    rows = [(1, item), (1, item), (None, "see " + item), (2, prose(30, random.Random(4))), (3, None)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, item_id string, edits int")
    benchmark = spark.createDataFrame([(5, item, 1), (6, item, 2)], "item_id long, text string, doc_id int")
    found = [(r["doc_id"], r["item_id"], r["start_word"], r["end_word"], r["edits"]) for r in D.find_benchmark_copies(docs, benchmark).collect()]
    want = [(1, 5, 0, 30, 0), (1, 6, 0, 30, 0)] * 2 + [(None, 5, 1, 31, 0), (None, 6, 1, 31, 0)]
    assert sorted(found, key=str) == sorted(want, key=str)
    left = D.drop_benchmark_copies(docs, benchmark)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 3}


def test_a_copy_in_a_very_long_text_is_found(spark):
    rng = random.Random(6)
    item = prose(40, rng)
    text = prose(150_000, rng) + " " + item + " " + prose(150_000, rng)
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    found = D.find_benchmark_copies(table(spark, [(1, text)]), benchmark).collect()
    assert [(r["item_id"], r["start_word"], r["end_word"], r["edits"]) for r in found] == [(5, 150_000, 150_040, 0)]
