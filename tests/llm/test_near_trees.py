"""The fingerprints and trees that find the candidates of near copies."""

import random
from itertools import combinations

import numpy as np

from lodestar.llm import near_copies, simhash

VOCABULARY = [f"w{i}" for i in range(3000)]


def apart(a, b):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))


def brute(shard, prints, radius):
    union = simhash.Union(len(shard))
    for i, j in combinations(range(len(shard)), 2):
        if shard[i] == shard[j] and apart(prints[i], prints[j]) <= radius:
            union.join(i, j)
    return as_sets([union.find(i) for i in range(len(shard))])


def as_sets(names):
    return {frozenset(i for i, n in enumerate(names) if n == name) for name in names}


def flipped(rng, value, k):
    for bit in rng.sample(range(128), k):
        value ^= 1 << bit
    return value


def rows_of(values):
    return np.array([(v & (1 << 64) - 1, v >> 64) for v in values], np.uint64)


def test_trees_equal_brute_force():
    rng = random.Random(1)
    values, shard = [], []
    for s in range(12):
        for _ in range(rng.randint(1, 4)):
            now = rng.getrandbits(128)
            for _ in range(rng.randint(1, 12)):  # copies, families and chains
                values.append(now)
                shard.append(s)
                if rng.random() < 0.8:
                    now = flipped(rng, now, rng.randint(0, 30))
    mixed = list(range(len(values)))
    rng.shuffle(mixed)
    prints, shards = rows_of([values[i] for i in mixed]), np.array([shard[i] for i in mixed])
    for radius in (0, 12, 40, 48):
        assert as_sets(near_copies.families(shards, prints, radius).tolist()) == brute(shards, prints, radius)


def test_a_family_takes_few_searches(monkeypatch):
    rng = random.Random(2)
    first = rng.getrandbits(128)
    prints = rows_of([first] + [flipped(rng, first, rng.randint(1, 20)) for _ in range(3000)])
    compared, own = [], simhash._distance
    monkeypatch.setattr(simhash, "_distance", lambda a, b: compared.append(len(a)) or own(a, b))
    found = near_copies.families(np.zeros(len(prints), np.int64), prints, near_copies.RADIUS)
    assert len(set(found.tolist())) == 1 and sum(compared) < 60 * len(prints)


def test_fingerprint_is_the_majority_of_the_shingles():
    hashes = near_copies.shingle_hashes("one two three four five six seven eight nine", 5)
    got = near_copies.sketch(hashes)[1]
    want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    assert got[0] == want and got[1] not in (0, want)


def test_similar_texts_are_within_the_radius():
    rng = random.Random(3)
    far = []
    for _ in range(400):
        words = rng.choices(VOCABULARY, k=rng.randint(8, 300))
        other = words[: -max(1, (len(words) - 4) // 5)] if rng.random() < 0.5 else words + rng.choices(VOCABULARY, k=(len(words) - 4) // 4)
        a, b = (near_copies.shingle_hashes(" ".join(w), 5) for w in (words, other))
        if near_copies.similar(a, b):
            far.append(apart(near_copies.fingerprint(a), near_copies.fingerprint(b)))
    unlike = [apart(near_copies.fingerprint(near_copies.shingle_hashes(" ".join(rng.choices(VOCABULARY, k=60)), 5)), near_copies.fingerprint(near_copies.shingle_hashes(" ".join(rng.choices(VOCABULARY, k=60)), 5))) for _ in range(200)]
    assert len(far) > 300 and max(far) < near_copies.RADIUS and sum(d > near_copies.RADIUS for d in unlike) > 190


def test_candidates_come_from_the_trees(spark):
    rng = random.Random(4)
    base = rng.getrandbits(128)
    values = [base, flipped(rng, base, 48), flipped(rng, base, 110)]
    rows = [(i, [7], *(x - (1 << 64) if x >> 63 else x for x in map(int, v))) for i, v in enumerate(rows_of(values))]
    found = near_copies.candidates(spark.createDataFrame(rows, "node long, shards array<long>, s1 long, s2 long"))
    assert sorted(r["node"] for r in found.collect()) == [0, 1]
