"""The pipeline keeps clean documents, drops copies and packs what is left."""

import random

import corpus_pipeline
from lodestar.llm.common import scratch


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 200))) for _ in range(80)]
    near = texts[3].split()
    near[10] = "changed"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(200, texts[2], "en", "s", 0), (201, " ".join(near), "en", "s", 0), (202, "12 34 " * 30, "en", "s", 0), (203, None, "en", "s", None), (204, "short one", None, None, 9)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    rows += [(300, shared + " " + " ".join(rng.choices(vocabulary, k=100)), "en", "s", 0), (301, " ".join(rng.choices(vocabulary, k=100)) + " " + shared, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = scratch(spark, "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder)
        assert left.columns == docs.columns, name
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert set(got) == {*range(80), 300, 301}
    assert all(got[i] == texts[i] for i in range(80)) and shared in got[300] and shared not in got[301] and len(got[301].split()) == 100
    pieces = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in pieces.collect()} == set(got)
    none = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
    assert none.count() == 0
