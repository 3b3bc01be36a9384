import hashlib
import math
import random

import numpy as np
import pytest

from paperloom.llm import centroids


def brute(rows, k, rounds, dim, scale, seed):
    """The definition with Python integers."""
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cents = [q for _, q in sorted(usable, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        found = {}
        for _, q in usable:
            found.setdefault(near(q)[1], []).append(q)
        for n, some in found.items():
            cents[n] = [sum(c) // len(some) for c in zip(*some)]
    best = [(i, *near(q)) for i, q in usable]
    total = sum(d for _, d, _ in best)
    per = {}
    for _, d, n in best:
        per[n] = per.get(n, 0) + d
    return sorted(((i, n, d, per[n], total, cents[n]) for i, d, n in best), key=repr)


def run(spark, rows, **how):
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, q string, cluster int")
    got = centroids.cluster(vectors, **how).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in got), key=repr)


@pytest.mark.parametrize("k, rounds", [(1, 0), (7, 3), (40, 5)])
def test_matches_the_definition(spark, k, rounds):
    rnd = np.random.default_rng(k)
    middles = rnd.standard_normal((6, 5)) * 3
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + rnd.standard_normal(5) / 4]) for i in range(150)]
    # Copies, repeated ids, a null id.
    rows += [(200, rows[3][1]), (3, rows[3][1]), (4, rows[9][1]), (None, rows[5][1]), (None, rows[5][1])]
    how = {"k": k, "rounds": rounds, "dim": 5, "scale": 16, "seed": 2}
    assert run(spark, rows, **how) == brute(rows, **how)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5)] + [(9, [3.0, 1.0])]
    how = {"k": 4, "rounds": 2, "dim": 2, "scale": 1, "seed": 2}
    got = run(spark, rows, **how)
    assert got == brute(rows, **how)
    assert len({r[1] for r in got}) == 2


def test_fewer_vectors_than_clusters_and_unusable_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    how = {"k": 40, "rounds": 5, "dim": 2, "scale": 256, "seed": 2}
    got = run(spark, rows, **how)
    assert got == brute(rows, **how)
    assert [r[0] for r in got] == [1, 8]
    assert run(spark, [], **how) == [] == run(spark, rows[1:7], **how)


def test_huge_components_are_held_to_the_bound(spark):
    rows = [(1, [3e38, -3e38]), (2, [1e30, -1e30]), (3, [0.0, 0.0])]
    got = {r[0]: r for r in run(spark, rows, k=1, rounds=0, dim=2)}
    assert {r[2] for r in got.values()} <= {0, 2 * centroids.BOUND**2, 8 * centroids.BOUND**2}


def test_runs_without_python(spark):
    rnd = random.Random(1)
    vectors = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(20)], "vec_id long, embedding array<float>")
    table = centroids.points(vectors, dim=4)
    plan = table.select("vec_id", centroids.nearest([[1, -2, 3, 4], [5, 6, 7, 8]]).alias("best"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # The centroids are one literal, not built for every row.
    assert "[[[1,-2,3,4],30],[[5,6,7,8],174]]" in plan
