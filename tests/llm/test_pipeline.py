"""The pipeline's stages on a small table, each against what brute force keeps."""

import random

import corpus_pipeline
from galvani.llm.packing import encode


def text(n, rng):
    return " ".join("".join(rng.choice(["tion", "the", "ing", "er", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    items = [(i, text(30, rng)) for i in range(5)]
    rows = [(i, text(rng.randrange(20, 80), rng)) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, text(20, rng) + " " + items[i % 5][1] + " " + text(20, rng)) for i in range(10)]
    rows += [(300, None), (301, ""), (302, "12 34"), (303, text(20, rng) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + text(5, rng))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rejected int, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        counts.append({r["doc_id"]: r for r in kept.collect()})
    ids = [set(c) for c in counts]
    assert ids[0] == {i for i, _ in rows} - {300, 301, 302}
    assert ids[1] == ids[0] - set(range(100, 110))
    assert ids[2] == ids[1] - set(range(200, 210)) and ids[3] == ids[2]
    clean = counts[3][303]
    assert "24be" not in clean["text"] and clean["n_chars"] == len(clean["text"]) and counts[3][0]["text"] == rows[0][1]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in found}
    assert tokens == {i: len(encode(r["text"])) + 1 for i, r in counts[3].items()}
    assert sum(r["length"] for r in found) == sum(tokens.values())


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
