"""Language ID and the quality classifier by held-out accuracy; the pipeline stage by stage."""

import random
import time
import zlib

from pyspark.sql import functions as F

from galvani.llm.langid import identify_languages, keep_known_languages, language_digest, letter_codes
from galvani.llm.quality import quality_digest

ENDINGS = {"aa": ["tion", "the", "ing", "er"], "bb": ["ció", "os", "la", "ñe"], "cc": ["ung", "sch", "ö", "en"]}


def words(lang, n, rng):
    return " ".join("".join(rng.choice(ENDINGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_letters_beside_digits_are_read():
    letters = lambda text: "".join(map(chr, letter_codes(text)))
    one, two = "".join(map(chr, range(0x4E00, 0x4EC8))), "".join(map(chr, range(0x5E00, 0x5EC8)))
    assert letters(one + "2024" + two + " ok") == f" {one} {two} ok "
    assert letters("see a1b2-c3_d 24be64439e3e49cf in 2024.") == " see in " and letters("a1 b2") == " a b "
    assert letters("word" * 50 + "7" + "more" * 50) == " " + "word" * 50 + " " + "more" * 50 + " "
    start = time.process_time()
    assert len(letter_codes("ab" * 500_000 + "é" * 500_000)) == 1_500_002
    assert time.process_time() - start < 30


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, words(lang, rng.randrange(5, 60), rng), lang) for i, lang in enumerate(random.Random(2).choices(list(ENDINGS), k=300))]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "aa"), (None, words("cc", 9, rng), None), (1003, "кириллица совсем другой язык и другие буквы тоже", None)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows + odd], "doc_id long, text string, lang string, score int, rejected string")
    found = {r["doc_id"]: r for r in language_digest(docs).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] for i in (1000, 1001, 1002))
    test = [(i, lang) for i, _, lang in rows if held_out(i)]
    assert all(found[i]["held_out"] for i, _ in test) and sum(found[i]["lang_pred"] == lang for i, lang in test) >= 0.97 * len(test)
    assert found[1003]["rejected"] and found[1003]["lang_pred"] in ENDINGS and found[None]["lang_pred"] == "cc"
    kept = keep_known_languages(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {1000, 1001, 1002, 1003} and len(ids & {i for i, *_ in rows}) >= 0.97 * len(rows)
    # held-out labels change nothing
    other = docs.withColumn("lang", F.expr("CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 'zz' ELSE lang END"))
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_digest(other).collect()} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in found.values()}
    assert language_digest(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        good = i % 2
        text = words("aa", rng.randrange(8, 50), rng)
        rows.append((i, text if good else text.replace(" ", "!! ").upper() if i % 4 else text.replace(" ", " ### ")))
        labels.append((i, good, 0))
    odd = [(1000, None), (1001, ""), (None, "the tion")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "doc_id long, text string, quality string, score int")
    table = spark.createDataFrame([*labels, (3, 0, 0), (1000, None, 0), (1001, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality_digest(docs, table).collect()}
    assert found[1000]["score"] == found[1001]["score"] == 0.5 and found[1000]["predicted"] == 0 and len(found) == len(rows) + 3
    test = [(i, q) for i, q, _ in labels if held_out(i)]
    assert sum(found[i]["predicted"] == q for i, q in test) >= 0.95 * len(test)
    none = quality_digest(docs, table.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality_digest(docs.limit(0), table).collect() == []
