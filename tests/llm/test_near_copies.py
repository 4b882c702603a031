"""Near copies against brute force over all pairs."""

import collections
import os
import random
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestar.llm import near_copies, simhash

VOCABULARY = [f"w{i}" for i in range(4000)]


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def prose(rng, n):
    return rng.choices(VOCABULARY, k=n)


def edited(rng, words, kind, share):
    k = max(1, round(len(words) * share))
    if kind == "cut":
        return words[:-k]
    if kind == "appended":
        return words + prose(rng, k)
    if kind == "block":
        at = rng.randrange(len(words) - k)
        return words[:at] + words[at + k :]
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = rng.choice(VOCABULARY)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["", None, " ", "one", "One", "two words"]
    for kind, shares in (("cut", (0.05, 0.1, 0.15, 0.19)), ("appended", (0.1, 0.15, 0.24)), ("block", (0.1, 0.15)), ("replaced", (0.005, 0.02, 0.03, 0.04, 0.05))):
        for share in shares:
            for _ in range(12):
                words = prose(rng, rng.randint(60, 500))
                made += [" ".join(words), " ".join(edited(rng, words, kind, share))]
    return made


@pytest.fixture(scope="module")
def groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["key"]: r["root"] for r in near_copies.near_copies(docs).collect()}


def test_no_near_copy_is_missed(texts, groups):
    pairs = [(i, i + 1) for i in range(6, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    assert len(pairs) > 80
    assert [p for p in pairs if groups[p[0]] != groups[p[1]]] == []


def brute_groups(texts):
    union = simhash.Union(len(texts))
    sets = [shingles(t or "") for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            union.join(a, b)
    return {frozenset(i for i in range(len(texts)) if union.find(i) == r) for r in map(union.find, range(len(texts)))}


def as_groups(roots):
    return {frozenset(k for k, r in roots.items() if r == root) for root in roots.values()}


def test_groups_equal_brute_force(texts, groups):
    assert sum(jaccard(texts[i], texts[i + 1]) < 0.8 for i in range(6, len(texts), 2)) > 20
    assert as_groups(groups) == brute_groups(texts)


def test_large_shards_and_groups_give_the_same(spark):
    rng = random.Random(8)
    family, chain = prose(rng, 120), prose(rng, 200)
    made = [" ".join(edited(rng, family, "replaced", 0.005)) for _ in range(40)]
    made += [" ".join(chain[k : k + 120]) for k in range(0, 60, 4)]  # each like the next, the first unlike the last
    made += [" ".join(prose(rng, 50)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    want = brute_groups(made)
    assert len(want) == 22
    for how in ({}, {"shard_rows": 5, "group_rows": 6}):
        assert as_groups({r["key"]: r["root"] for r in near_copies.near_copies(docs, **how).collect()}) == want


def test_blocks_of_a_large_group_meet(spark):
    rng = random.Random(4)
    words = prose(rng, 100)
    texts = [" ".join(edited(rng, words, "replaced", 0.01 + 0.01 * (i % 4))) for i in range(60)]
    rows = [(g, i) for g in (1, 2) for i in range(60)]
    sets = near_copies.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5)
    roots = {i: i for i in range(60)}
    found = near_copies.components(near_copies.links(spark.createDataFrame(rows, "g long, node long"), sets, most=25))
    roots |= {r["node"]: r["root"] for r in found.collect()}
    want = brute_groups(texts)
    assert as_groups(roots) == want and 1 < len(want) < 60


def test_rows_that_share_an_id_but_not_the_text_stay(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(prose(rng, 80)) for _ in range(4))
    rows = [(7, a, 1), (7, b, 2), (7, b, 2), (8, a + " tail", 3), (None, c, 4), (None, c, 4), (None, d, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["n_chars"] for r in left) == [1, 2, 4, 5]


def test_groups_of_a_shared_id_stay_apart(spark):
    rng = random.Random(6)
    a, b = (" ".join(prose(rng, 80)) for _ in range(2))
    docs = spark.createDataFrame([(7, a), (7, b), (3, a), (9, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(3, 3), (7, 3), (7, 7), (9, 7)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are absent")
def test_recall_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    found = {r["node"]: r["root"] for r in near_copies.near_copies(docs).collect()}
    node = {r["doc_id"]: r["node"] for r in near_copies.own_texts(docs, "doc_id", "text").select(F.col("key").alias("doc_id"), "node").collect()}
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    holders = collections.defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(i)
    pairs = {p for h in holders.values() if 1 < len(h) < 400 for p in combinations(sorted(h), 2)}
    near = [(sets[a][0], sets[b][0]) for a, b in pairs if 9 * len(sets[a][1] & sets[b][1]) >= 4 * (len(sets[a][1]) + len(sets[b][1]))]
    linked = sum(found[node[a]] == found[node[b]] for a, b in near)
    assert len(near) > 20 and linked >= 0.99 * len(near), (linked, len(near))
