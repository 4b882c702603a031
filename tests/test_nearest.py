"""The best chunks of many probes: equal to SQL to the last bit, without a join of all pairs."""

import random

import compare
import duckdb
import pytest

from lodestar.functions import nearest
from lodestar.operators import retrieval
from lodestar.plans import catalogue

SCHEMA = "chunk_id long, embedding array<float>"
SQL = """WITH v AS (SELECT chunk_id, embedding::DOUBLE[] AS e FROM vectors) SELECT q.chunk_id AS qid, v.chunk_id, list_cosine_similarity(v.e, q.e) AS score, row_number() OVER (PARTITION BY q.chunk_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.chunk_id) AS rank FROM v, v q WHERE q.chunk_id % 10 = 0 QUALIFY rank <= 4"""


def hits(vectors, top_k=4, every=10):
    probes = vectors.where(f"chunk_id % {every} = 0").selectExpr("chunk_id AS qid", "embedding AS probe")
    return retrieval.top_hits_of_each(vectors, probes, top_k)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    found = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    made = []
    for v in found:  # equal ones, and ones of the same direction, whose scores differ by rounding at most
        made += [[x * t for x in v] for t in (1, 1, 3, 7, -1, 0.1)]
    made += [found[0]] * 90  # a very common one
    rng.shuffle(made)
    return list(enumerate(made))


@pytest.mark.parametrize("sizes", [{}, {"PROBE_BLOCK": 7, "TASK_PAIRS": 300}])
def test_same_rows_and_scores_as_sql(spark, tmp_path, monkeypatch, rows, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(retrieval, name, size)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    vectors.write.parquet(str(tmp_path / "v"))
    got = sorted((r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in hits(vectors).collect())
    want = duckdb.sql(SQL.replace("FROM vectors", f"FROM '{tmp_path}/v/*.parquet'")).fetchall()
    assert got == sorted((q, rank, c, s) for q, c, s, rank in want) and len(got) == 180


def test_no_join_of_all_pairs(spark, rows):
    plan = hits(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_without_a_score(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, 0.0, 0.0]), (6, [2.0, 1.0]), (7, [nan, 1.0]), (10, [0.0, 0.0]), (20, None), (30, [1.0, 2.0, 2.0])]
    got = sorted((r["qid"], r["rank"], r["chunk_id"]) for r in hits(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 7), (0, 2, 0), (0, 3, 6), (30, 1, 30), (30, 2, 5)]  # Spark and SQL put what is no number first
    assert hits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_of_text(spark):
    vectors = spark.createDataFrame([(k, [1.0, 1.0]) for k in ("b", "ä", "a", "B")], "chunk_id string, embedding array<double>")
    found = retrieval.top_hits_of_each(vectors, spark.createDataFrame([("q", [2.0, 2.0])], "qid string, probe array<double>"), 3)
    assert [(r["rank"], r["chunk_id"]) for r in found.orderBy("rank").collect()] == [(1, "B"), (2, "a"), (3, "b")]


def test_blocks_and_batches_give_the_same(monkeypatch, rows):
    import pyarrow as pa

    keys, column = pa.array([k for k, _ in rows]), pa.array([v for _, v in rows], pa.list_(pa.float32()))
    found = []
    for sides in ((1 << 20, 512, 1024), (60, 5, 3)):
        for name, size in zip(("HELD_NUMBERS", "PROBE_SIDE", "ROW_SIDE"), sides, strict=True):
            monkeypatch.setattr(nearest, name, size)
        batches = [pa.record_batch([keys[a : a + 100], column[a : a + 100]], names=["k", "e"]) for a in range(0, len(rows), 100)]
        found.append([[x.to_pylist() for x in f] for f in nearest.nearest(iter(batches), keys[:20], column[:20], 4)])
    assert found[0] == found[1] and len(found[0][0][0]) == 80


@pytest.mark.parametrize("name", ["batch_knn", "recall_mrr"])
def test_queries_where_scores_differ_by_rounding(spark, tmp_path, name):
    rng = random.Random(2)
    found = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    made = [[x * t for x in v] for v in found for t in (1, 3, 5, 7, 11, 13, 1, 0.3, 0.7, 1.1)]
    rng.shuffle(made)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(made)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare.rows_of_spark(catalogue.QUERIES[name](spark, str(tmp_path))) == compare.rows_of_sql(con, catalogue.ORACLES[name])


def plain(keys, rows, probes, top_k):
    """key and score of the best of each probe, all pairs scored in turn."""
    import numpy as np

    squares, best = np.cumsum(rows * rows, axis=1)[:, -1], {}
    for i, q in enumerate(probes):
        with np.errstate(all="ignore"):
            score = np.clip(np.cumsum(rows * q, axis=1)[:, -1] / np.sqrt(squares * np.cumsum(q * q)[-1]), -1.0, 1.0)
        by = np.lexsort((keys, -np.where(np.isnan(score), np.inf, score)))[:top_k]
        best[i] = [(int(keys[j]), repr(float(score[j]))) for j in by]
    return best


def found_by_blocks(keys, rows, probes, top_k, size=3000):
    import pyarrow as pa

    column = pa.array(list(rows), pa.list_(pa.float64()))
    batches = [pa.record_batch([pa.array(keys[a : a + size]), column[a : a + size]], names=["k", "e"]) for a in range(0, len(keys), size)]
    got = {}
    for q, k, s in nearest.nearest(iter(batches), pa.array(range(len(probes))), pa.array(list(probes), pa.list_(pa.float64())), top_k):
        for i, key, score in zip(q.to_pylist(), k.to_pylist(), s.to_pylist(), strict=True):
            got.setdefault(i, []).append((key, repr(score)))
    return got


@pytest.mark.parametrize("near", [1e-3, 1e-6, 1e-9, 1e-16])
def test_scores_nearer_than_single_precision(near):
    import numpy as np

    rng = np.random.default_rng(3)
    one = rng.normal(size=16)
    rows = np.concatenate([one + near * rng.normal(size=(4000, 16)), rng.normal(size=(3000, 16)), one * rng.uniform(0.1, 9, (500, 1))])
    rng.shuffle(rows)
    keys, probes = rng.permutation(len(rows)), np.concatenate([rows[:30], [one, one * 1e-90, one * 1e90, np.full(16, np.nan), one * 1e-30]])
    rows[5], rows[6], rows[7, 3] = one * 1e-80, one * 1e85, np.inf
    assert found_by_blocks(keys, rows, probes, 7) == plain(keys, rows, probes, 7)


def test_floors_rise_while_a_batch_is_seen(monkeypatch):
    """Few pairs are scored again, and few wait for it at a time, also where no estimate can be made."""
    import numpy as np

    rng, scored, own = np.random.default_rng(4), [], nearest.Nearest._scores
    monkeypatch.setattr(nearest.Nearest, "_scores", lambda self, p, r, rows: scored.append(len(p)) or own(self, p, r, rows))
    rows, probes = rng.normal(size=(20_000, 8)), rng.normal(size=(4_000, 8))
    keys = np.arange(len(rows))
    got = found_by_blocks(keys, rows, probes, 5, size=len(rows))
    assert sum(scored) < 250_000 and {i: got[i] for i in range(20)} == plain(keys, rows, probes[:20], 5)
    scored.clear()
    assert found_by_blocks(keys, rows, probes[:100] * 1e-90, 5, size=len(rows)).keys() == set(range(100))
    assert max(scored) < 500_000
