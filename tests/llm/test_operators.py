"""The dealt operators on small tables: odd rows, empty tables, clashing columns, and brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import bpe, exact_digest, language_id, packing, pretokens, quality_classifier, quality_rules, sharding, simhash, substring_dedup, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `chunk` int, fp string, `n_words` int"
SPLIT = re.compile(r"[\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are absent")
PASSAGE = " ".join(f"word{i}" for i in range(60))


def odd_texts() -> list[str | None]:
    rng = random.Random(7)
    made = [None, "", " ", "\n\t ", "a", "  a  b  ", "x" * 3000, "no letters 123 !!!", "é ü ß 日本語 текст", "tail \x1c end", "a<|endoftext|>  b", PASSAGE, "intro " + PASSAGE + " outro", PASSAGE + " " + PASSAGE, "same copy text here", "same copy text here", "long " * 4000]
    vocabulary = [f"w{i}" for i in range(40)]
    return made + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) + rng.choice(["", "\n", "."]) for _ in range(30)]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None, 1, "clash", 2) for i, t in enumerate(odd_texts())]
    return made + [(None, PASSAGE, None, None, None, None, None, None), (None, None, "en", "s1", 0, 0, "", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return [w for w in SPLIT.split(text or "") if w]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


# -- 1


def brute_windows(rows, width=13):
    first = {}
    key = lambda d: 2**63 if d is None else d
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, key(d)), key(d))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"batches": 4, "bits": 24, "chunk_bytes": 4000, "bucket_windows": 500}, {"batches": 2, "chunk_bytes": 1000, "bucket_windows": 100, "fan_out": 4, "units": 2}])
def test_substring_dedup(docs, rows, how):
    got = substring_dedup.digests(substring_dedup.remove_copied_windows(docs, **how)).collect()
    assert ordered(got) == ordered(brute_windows([r[:2] for r in rows]))


def test_substring_dedup_empty(none):
    assert substring_dedup.remove_copied_windows(none).count() == 0


def test_words_that_collide_in_polynomial_hashes_are_told_apart(spark):
    even = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    odd = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    head = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{head} {even}"), (2, f"{head} {odd}"), (3, f"{head} {even}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_copied_windows(df).collect()} == {1: 0, 2: 0, 3: 13}


def test_an_index_is_closed_and_opened_again(spark, tmp_path, rows):
    first = spark.createDataFrame([r[:2] for r in rows[:25]], "doc_id long, text string")
    second = spark.createDataFrame([r[:2] for r in rows[25:]], "doc_id long, text string")
    place = f"file://{tmp_path}/index"
    got = substring_dedup.remove_copied_windows(first, batches=2, index_path=place).collect()
    got += substring_dedup.remove_copied_windows(second, batches=2, index_path=place).collect()
    want = {(d, m) for d, _, m, _ in brute_windows([r[:2] for r in rows])}
    assert {(r["doc_id"], r["n_removed"]) for r in got} == want
    later = spark.createDataFrame([(0, PASSAGE)], "doc_id long, text string")  # ids of later calls count as later
    assert substring_dedup.remove_copied_windows(later, index_path=place).first()["n_removed"] == 60
    assert len(substring_dedup.FingerprintIndex.open(spark, place).runs) < 5


def test_levels_grow_by_a_bounded_factor():
    assert substring_dedup._levels(8, 256, 64) == [8]
    for buckets in (257, 20_000, 5_000_000):
        levels = substring_dedup._levels(buckets, 256, 64)
        assert levels[0] == 256 and buckets <= levels[-1] < buckets + levels[-2] and all(b % a == 0 and b // a <= 64 for a, b in zip(levels, levels[1:], strict=False))


def test_long_texts_are_cut_between_words(monkeypatch):
    text = b" ab  cd\n" * 50 + b"x" * 40 + b" y"
    whole = text.split()
    monkeypatch.setattr(substring_dedup, "_BLOCK", 16)
    assert [w for some in substring_dedup._word_lists(text) for w in some] == whole


def test_windows_of_equal_fingerprints_are_told_apart():
    h, c = np.array([5, 5, 5, 9], np.uint64), np.array([2, 1, 2, 1], np.uint16)
    order, new = substring_dedup._ordered(h, c)
    assert list(zip(h[order], c[order], strict=True)) == [(5, 1), (5, 2), (5, 2), (9, 1)] and new.tolist() == [True, True, False, True]
    held = substring_dedup._held(np.array([5, 5, 7], np.uint64), np.array([1, 3, 1], np.uint16), np.array([5, 5], np.uint64), np.array([1, 2], np.uint16))
    assert held.tolist() == [True, False, False]


def test_white_space_is_kept_where_asked(spark):
    df = spark.createDataFrame([(1, f"a  b\n{PASSAGE}"), (2, f"c\n\nd {PASSAGE}\n end")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in substring_dedup.remove_copied_windows(df, spaces=True).collect()}
    assert got[1] == f"a  b\n{PASSAGE}" and got[2] == "c\n\nd\n end"


# -- 2


def test_sharding(docs, rows, none):
    got = sharding.shard_digests(sharding.shard(docs, shards=5, bucket_bytes=2000)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert [r for r in sharding.shard(docs, shards=5, bucket_bytes=2000).drop("fp").collect()] != [] and sharding.shard(none).count() == 0


# -- 3, 4, 9


@pytest.fixture(scope="module")
def library_ids(rows):
    t = Tokenizer.from_file(JSON)
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]


def test_packing(docs, none, library_ids):
    packed = packing.pack(docs, JSON, capacity=64, end_id=0, group_rows=20).cache()
    by_doc = collections.defaultdict(list)
    for r in packed.collect():
        by_doc[r["doc_id"]].append((r["start"], list(struct.unpack(f"<{r['length']}I", r["ids"]))))
    for d in {k for k, _ in library_ids if k is not None}:
        want = next(ids for k, ids in library_ids if k == d)
        assert [x for _, ids in sorted(by_doc[d]) for x in ids] == want + [0]
    seqs = collections.defaultdict(list)
    for r in packed.collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.sequences(packed).count() == len(seqs)
    assert {(r["piece"], r["ids_crc32"]) for r in packed.collect()} == {(r["piece"], zlib.crc32(bytes(r["ids"]))) for r in packed.collect()}
    narrow = packing.piece_digests(packing.pack(docs, JSON, capacity=64, end_id=0, group_rows=20, ids=False))
    assert ordered(r[:5] for r in narrow.collect()) == ordered(r[:5] for r in packing.piece_digests(packed).collect())
    assert packing.pack(none, JSON).count() == 0


@needs_tables
def test_padding_is_little(spark):
    placed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), JSON, capacity=1024, ids=False)
    tokens, sequences = placed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert 1024 * sequences <= 1.01 * tokens


def test_columns_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "wrong", "one two three", 9)], "doc_id long, TEXT string, text string, DOC_ID long")
    assert token_counts.token_counts(df, JSON).first()["n_bytes"] == 13
    got = sharding.shard_digests(sharding.shard(df)).first()
    assert (got["doc_id"], got["size"]) == (1, 21)
    assert [(r["doc_id"], r["n_words"]) for r in substring_dedup.remove_copied_windows(df).collect()] == [(1, 3)]
    assert exact_digest.fingerprint_edits(df).first()["n_chars"] == 13


def test_ids_at_the_ends_of_the_range(spark):
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(low, PASSAGE), (high, PASSAGE), (2**62, "other words"), (None, PASSAGE)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_copied_windows(df).collect()} == {low: 0, high: 60, 2**62: 0, None: 60}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {low: low, high: low, 2**62: 2**62, None: low}
    assert {r["doc_id"] for r in exact_digest.fingerprint_edits(df).collect()} == {low, high, 2**62, None}


def test_a_shuffle_repeats_itself_and_mixes(spark, tmp_path):
    spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(3).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    one, two = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df, shards=4, bucket_bytes=20_000).collect()} for _ in range(2))
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df, shards=4, seed=18, bucket_bytes=20_000).collect()}
    assert one == two != other
    halves = collections.Counter((d < 1000, s) for d, (s, _) in one.items())
    assert all(200 < n < 300 for n in halves.values())  # 250 on average, deviation 14


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 99) for _ in range(500)), reverse=True)
    windows, offsets = packing.best_fit(lengths, 100)
    room: list[int] = []
    for n, w, o in zip(lengths, windows, offsets, strict=True):
        fits = [r for r in room if r >= n]
        if not fits:
            assert w == len(room) and o == 0
            room.append(100 - n)
        else:
            assert room[w] == min(fits) and o == 100 - room[w]
            room[w] -= n


@pytest.mark.parametrize("size", [(8192, 256), (200, 16)])
def test_token_counts(docs, none, library_ids, size):
    got = token_counts.token_counts(docs, JSON, limit=20, chunk_chars=size[0], overlap=size[1]).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["over_limit"]) for r in got) == ordered((d, len(ids), len(ids) > 20) for d, ids in library_ids)
    assert token_counts.token_counts(none, JSON).count() == 0


def test_overlaps_widen_where_no_boundary_is_proven():
    lib, library = token_counts.Library(JSON), Tokenizer.from_file(JSON)
    rng = random.Random(11)
    texts = ["x" * 3000, "ab " * 40 + "y" * 500 + " cd" * 200, "\n" * 700 + "a b " * 100, "".join(rng.choice(["word ", "é", "  ", "7", "\t", "longer-word "]) for _ in range(2000)), "日本語" * 400 + " end"]
    for chunk, overlap in ((64, 8), (200, 16), (1000, 100)):
        found = [token_counts.count_tokens(lib, t, chunk, overlap) for t in texts]
        assert [n for n, _ in found] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    plain, n_chunks = token_counts.count_tokens(lib, "word " * 1000, 500, 50)
    assert n_chunks == 10 and plain == len(library.encode("word " * 1000, add_special_tokens=False).ids)
    assert token_counts.count_tokens(lib, "ab " * 40 + "y" * 500 + " cd" * 200, 64, 8)[1] > 14  # the long word took wider overlaps


def test_bpe_by_a_pattern_without_stable_cuts():
    pattern = r"[a-z ]+|[^a-z ]"
    words = bpe.RankVocabulary(RANKS, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=words.ranks, special_tokens={})
    for text in ("one two  three 12", "", "  a  b\nc", "é and ü"):
        assert list(struct.unpack(f"<{len(words.encode(text)) // 4}I", words.encode(text))) == library.encode_ordinary(text)


def test_pieces_join_to_the_text():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["a", " ", "  ", "\n", "b ", "é", "\t"]) for _ in range(rng.randint(0, 30)))
        cut = pretokens.pieces(text)
        assert "".join(cut) == text and all(cut)
        assert all(p[0] == " " and not p[1].isspace() for p in cut[1:])


def test_pieces_that_begin_with_a_zero_byte():
    texts = ["x \0abc", "\0abc x", "abc \0 y", "\0", " \0", "a  \0b \0\0", "\0 \0abc abc"]
    cache = pretokens.PieceCache(lambda found: [p.encode() for p in found])
    assert cache.texts(texts) == [t.encode() for t in texts] == cache.texts(texts)
    assert [b"".join(cache.values_of(t)) for t in texts] == [t.encode() for t in texts]
    words = bpe.RankVocabulary(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in words.cache.texts(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe(docs, rows, none):
    words = bpe.RankVocabulary(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    got = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = [(r[0], struct.pack(f"<{len(ids)}I", *ids), (r[1] or "").encode()) for r in rows for ids in [library.encode_ordinary(r[1] or "")]]
    assert ordered((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == ordered(want)
    assert bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_very_long_pretokens():
    words = bpe.RankVocabulary(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    rng = random.Random(9)
    for text in ("a" * 5000, "".join(rng.choice("thearion") for _ in range(20000)), "\n" * 999):
        assert list(struct.unpack(f"<{len(words.encode(text)) // 4}I", words.encode(text))) == library.encode_ordinary(text)


# -- 5


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", folded).strip()


def test_exact_digest(spark, none):
    texts = ["Straße  ", "STRASSE", "ﬁne", "fine", "", None, "x", "X y", "x y", "abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how in ({}, {"range_bytes": 20}, {"salts": (), "range_bytes": 20}):  # without salts all texts share one bucket
        got = {r["doc_id"]: r for r in exact_digest.fingerprint_edits(df, **how).collect()}
        for i, t in enumerate(texts):
            t, n = t or "", texts[i - 1] or ""
            edit = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
            assert (r["near_edited"], r["near_next"]) == (float(canonical(t) == canonical(edit)), float(canonical(t) == canonical(n)))
        prints = {canonical(t or ""): got[i]["fingerprint"] for i, t in enumerate(texts)}
        assert all(got[i]["fingerprint"] == prints[canonical(t or "")] for i, t in enumerate(texts)) and len(set(prints.values())) == len(prints)
    assert exact_digest.fingerprint_edits(none).count() == 0


def test_equal_buckets_are_compared_by_bytes(spark):
    df = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "a"), ("e", "x"), ("e", "x")], "digest string, canon string")
    assert ordered(exact_digest.impure_buckets(df).collect()) == [("d", "a", 1), ("d", "b", 2)]


def test_odd_rows_of_exact_digest(docs, rows):
    got = exact_digest.fingerprint_edits(docs).collect()
    assert len(got) == len(rows) and {r["near_next"] for r in got} == {0.0, 1.0}
    known = sorted(((r[0], r[1] or "") for r in rows if r[0] is not None), reverse=True)
    following = {d: known[(i + 1) % len(known)][1] for i, (d, _) in enumerate(known)}
    for r in got:
        t = rows[r["doc_id"]][1] or "" if r["doc_id"] is not None else None
        if t is not None:
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + following[r["doc_id"]][: len(t) // 2]).encode()).hexdigest()
    groups = {r["doc_id"]: r["group_id"] for r in exact_digest.fingerprints(docs.where("doc_id IS NOT NULL")).collect()}
    assert groups[15] == groups[14] == 14


# -- 6


def test_language_id(spark, docs, rows, none):
    train = [(i, "the house and the garden are green", "en") for i in range(20)] + [(100 + i, "das haus und der garten sind grün", "de") for i in range(20)] + [(200 + i, "дом и сад зелёные", "ru") for i in range(20)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    texts = [(1, "the garden and the house " * 9 + "und der garten und das haus " * 5), (2, None), (3, "12 34"), (4, "сад"), (5, "")]
    got = {r["doc_id"]: r for r in language_id.label_documents(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "und", "und", "ru", "und"]
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert len(language_id.predict_with_folds(docs).collect()) == len(rows)
    assert language_id.predict_with_folds(none).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(50):
        scores = [(rng.normal(size=(rng.integers(0, 6), 3)) * 3).astype(np.float32) for _ in range(5)]
        for s, path in zip(scores, language_id.viterbi(scores, 2.0), strict=True):
            total = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert len(path) == len(s) and (not len(s) or abs(max(map(total, itertools.product(range(3), repeat=len(s)))) - total(path)) < 1e-4)


# -- 7


def brute_fingerprint(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("trees", [32768, 2])
def test_simhash(docs, rows, none, trees):
    got = simhash.near_duplicates(docs, tree_rows=trees).collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    assert ordered((r["doc_id"], r["fp"] % 2**64) for r in got) == ordered(prints)
    ids = list(prints)
    union = simhash.Union(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= 2:
                union.join(i, j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(ids):
        if d is not None:
            least[union.find(i)] = min(d, least.get(union.find(i), d))
    assert ordered((r["doc_id"], r["component_id"]) for r in got) == ordered((d, least.get(union.find(i))) for i, (d, _) in enumerate(ids))
    if trees == 2:
        assert simhash.near_duplicates(none).count() == 0


def test_bk_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 20, np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 20, np.uint64)) for _ in range(12)]]))
    forest = simhash.Forest(fps, np.zeros(len(fps), np.int64))
    found = {(int(q), int(n)) for a, b in forest.search(fps, forest.root, 3) for q, n in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert found == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} >= {(60, 0), (101, 100), (1, 0)}


# -- 8


def brute_statistics(text):
    w = words_of(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if counts[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_rules(docs, rows, none):
    got = quality_rules.judge(docs).collect()
    want = [(r[0], *brute_statistics(r[1])) for r in rows]
    assert ordered((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == ordered(want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.keep_sound(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    clean = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(40, 300))), "en", "s") for i in range(200)]
    bad = [(1000 + i, " ".join(w + rng.choice(["$$$", "%%%", "&&&"]) for w in rng.choices(vocabulary, k=80)), "en", "s") for i in range(10)]
    got = quality_rules.judge(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in got)


def brute_determinants(x, core=0.75):
    """Mean, Cholesky factor and scale of a group's rows by the same starts and steps."""
    ridge = np.diag(np.array(list(quality_rules.VECTOR.values())) ** 2)

    def quantile(v, p):
        return np.sort(v)[max(0, math.ceil(p * len(v)) - 1)]

    def shape(y):
        mean = y.mean(axis=0)
        low = np.linalg.cholesky(y.T @ y / len(y) - np.outer(mean, mean) + ridge)
        return 2 * np.log(np.diag(low)).sum(), mean, low

    def step(found):
        d2 = (np.linalg.solve(found[2], (x - found[1]).T) ** 2).sum(axis=0)
        return shape(x[d2 <= quantile(d2, core)])

    median = np.array([quantile(c, 0.5) for c in x.T])
    d2 = (((x - median) / np.sqrt(np.diag(ridge))) ** 2).sum(axis=1)
    starts = [shape(x[d2 <= quantile(d2, core)])]
    return starts, shape, step, quantile


@needs_tables
def test_the_verdict_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    got = quality_rules.judge(docs).collect()
    stats = quality_rules.vectors(quality_rules.statistics(docs)).withColumn("tenth", F.pmod(F.xxhash64(*quality_rules.VECTOR), F.lit(10))).toPandas()
    stats["failed"] = (stats.n_words < 20) | (100 * stats.n_repeat_words > 30 * stats.n_words)
    stats["pair"] = stats["lang"].fillna("") + "/" + stats["source"].fillna("")
    sound = stats[~stats.failed]
    many, langs = sound.groupby("pair").size(), sound.groupby(sound["lang"].fillna("")).size()
    key = [p if many[p] >= 60 else lang if langs[lang] >= 60 else "all" for p, lang in zip(sound["pair"], sound["lang"].fillna(""), strict=True)]
    kept, p = {}, len(quality_rules.VECTOR)
    sides = np.array([d != "x_length" for d in quality_rules.VECTOR])
    for g in set(key):
        own = sound[[k == g for k in key]]
        x = own[list(quality_rules.VECTOR)].to_numpy()
        starts, shape, step, quantile = brute_determinants(x)
        starts += [shape(x[own["tenth"] == k]) for k in (1, 2) if (own["tenth"] == k).any()]
        found = min((step(step(s)) for s in starts), key=lambda s: s[0])
        for _ in range(10):
            after = step(found)
            fallen, found = found[0] - after[0], after
        d2 = (np.linalg.solve(found[2], (x - found[1]).T) ** 2).sum(axis=0)
        scale = max(quantile(d2, 0.5) / (p * (1 - 2 / (9 * p)) ** 3), 1.0)
        off = x - found[1]
        off = np.where(sides & (off < 0), 0.0, off)
        far = (np.linalg.solve(found[2], off.T) ** 2).sum(axis=0)
        kept |= dict(zip(own["doc_id"], (far <= 36.0 * scale).tolist(), strict=True))
        assert fallen < 1e-3
    assert len(set(key)) > 1 and 0 < sum(not k for k in kept.values())
    assert {r["doc_id"]: r["kept"] for r in got} == {d: kept.get(d, False) for d in stats["doc_id"]}


# -- 10


def test_quality_classifier(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.score_with_folds(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality_classifier.score_with_folds(none, labels).count() == 0
    nothing = quality_classifier.score_with_folds(docs, labels.where("doc_id < 0")).collect()
    assert {r["score"] for r in nothing} == {0.5}


def test_votes_equal_brute_force():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma!!", "DELTA", "x$$"], 12)) for _ in range(80)]
    terms = quality_classifier.Terms()
    rows = [terms.of(t) for t in texts]
    labels = rng.integers(0, 2, 80)
    voters = quality_classifier.Voters(rows, labels, 8, 5, 8.0)
    cosine = np.round(voters.vectors @ voters.vectors.T, 6)
    got = voters.scores(rows)
    ties = 0
    for i in range(80):
        best = sorted(range(80), key=lambda j: (-cosine[i, j], j))[:5]
        ties += sum(cosine[i] == cosine[i, best[-1]]) > 1
        weight = np.maximum(cosine[i, best], 1e-3) ** 8.0 * voters.vote[best]
        assert abs(got[i] - (weight * labels[best]).sum() / weight.sum()) < 1e-3
    assert ties


def test_ties_go_by_place():
    rng = np.random.default_rng(3)
    cosine = np.round(rng.random((300, 40)), 1)
    want = [sorted(sorted(range(40), key=lambda j: (-row[j], j))[:7]) for row in cosine]
    assert quality_classifier.Voters._nearest(cosine, 7).tolist() == want


@needs_tables
def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality_classifier.score_with_folds(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in found) / len(found)
    assert len(found) > 50 and right >= 0.93, right


@needs_tables
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.predict_with_folds(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in found) / len(found)
    assert len(found) > 100 and right >= 0.95, right


def test_hot_rows_without_an_id_count_once_in_the_language_sample(spark):
    made = [(None, "aaa bbb", "en")] * 300 + [(i, f"ccc ddd{i}", "en") for i in range(50)]
    model = language_id.train(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    assert model.langs == ["en"]
    table = language_id.train(spark.createDataFrame(made[299:], "doc_id long, text string, lang string"))
    assert np.allclose(model.log, table.log)
