import math

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import collision

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, _shard int"


def brute(rows, asked, k):
    good = {i: [float(x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in good:
            d = sorted((math.dist(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [i for _, i in d[:k]]
    return out


def search(spark, rows, asked, k=10, **how):
    table = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], SCHEMA)
    got = {}
    for r in collision.nearest(table, table.filter(F.col("vec_id").isin(asked)), k, **how).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append(r.vec_id)
    return got


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    asked = [i for i, _ in rows if i % 100 == 0]
    want = brute(rows, asked, 10)
    got = {}
    for r in collision.nearest(table, table.filter("vec_id % 100 = 0"), shard_rows=700, block_queries=2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set(w)) for q, w in want.items())
    assert hits >= 0.97 * sum(map(len, want.values()))


def test_windows_prune():
    """Few distances are computed, of clustered vectors and of vectors without clusters, and little is lost."""
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(60, 64))
    clustered = centres[rnd.integers(0, 60, 6000)] + 0.35 * rnd.normal(size=(6000, 64))
    loose = rnd.normal(size=(6000, 64))
    loose /= np.linalg.norm(loose, axis=1)[:, None]
    for table, share, recall in ((clustered, 0.05, 0.95), (loose, 0.4, 0.95)):
        shard = collision.Shard(np.arange(6000), table)
        hits = 0
        for q in range(0, 6000, 150):
            d = ((table - table[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len({i for _, i in shard.nearest(q, table[q], 10)} & set(np.argsort(d)[:10].tolist()))
        assert hits >= recall * 400, hits
        assert shard.verified <= share * 40 * 6000, shard.verified


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [-1e200, 1.0]), (3, [1.0, 2.0]), (4, [1.0, 2.5]), (5, [1e-200, 0.0])]
    found = collision.Shard(np.array([i for i, _ in rows]), np.array([v for _, v in rows])).nearest(3, np.array([1.0, 2.0]), 10)
    assert [i for _, i in found[:2]] == [4, 5] and len(found) == 4


def test_ties_copies_and_bad_vectors(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=8).astype("float32").tolist()) for i in range(100, 160)]
    rows += [(i, [1.0] * 8) for i in range(30)] + [(29, [1.0] * 8)]
    rows += [(201, None), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("nan")] * 8), (205, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (206, []), (207, [1.0, 2.0]), (208, [1.0, 2.5])]
    rows = [(i, v) for i, v in rows]
    asked = [0, 5, 29, 110, 201, 202, 203, 204, 207]
    assert search(spark, rows, asked) == brute(dict(rows).items(), asked, 10)
    assert search(spark, rows, asked, shard_rows=9, block_queries=2) == brute(dict(rows).items(), asked, 10)


def test_few_candidates_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5])]
    assert search(spark, rows, [1, 2]) == {1: [2], 2: [1]}
    assert search(spark, rows[:1], [1]) == {}
    assert search(spark, rows, []) == {}
    assert search(spark, [], []) == {}
