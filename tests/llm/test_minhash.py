import random

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import minhash


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)])


def brute(rows, size=5):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            r = find(a)
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), i if not s else least.get(find(a))) for a, (i, s) in enumerate(sets)), key=repr)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, cls string, short binary")
    got = minhash.near_duplicates(docs, **how).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def edited(rnd, words, k):
    words = list(words)
    for _ in range(k):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("size", [4, 5])
def test_matches_all_pairs(spark, size):
    rnd = random.Random(5)
    rows = []
    for group in range(12):
        words = [f"g{group}w{rnd.randrange(400)}" for _ in range(rnd.choice([5, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 3, 25])):
            rows.append((len(rows), edited(rnd, words, rnd.choice([0, 0, 1, 2, 5, 9]))))
    # A chain: each is near the next, the ends are far apart.
    words = [f"c{i}" for i in range(100)]
    for step in range(30):
        rows.append((len(rows), " ".join(words)))
        words[3 * step % 100] = f"n{step}"
    rnd.shuffle(rows)
    assert run(spark, rows, shingle=size) == brute(rows, size)
    assert run(spark, rows, shingle=size, block=3) == brute(rows, size)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (None, "one two three four five"), (4, "ONE two three\nfour five"), (9, long), (8, long + " more"), (8, long + " more"), (5, "a b"), (6, "A B"), (7, "a b c"), (10, "É b"), (11, "é b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, "lonely words of no one")], shingle=4) == [(None, 2, None)]
    assert run(spark, []) == []


def test_components_of_long_chains(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    name = lambda k: b"%08d" % order[k]
    edges = [(name(k), name(k + 1)) for k in range(n - 1)] + [(b"zz", b"zy")]
    got = {bytes(r.node): bytes(r.root) for r in minhash.components(spark.createDataFrame(edges, "x binary, y binary")).collect()}
    assert got == {name(k): b"00000000" for k in range(n)} | {b"zz": b"zy", b"zy": b"zy"}


def test_keys_that_agree_in_low_bytes_only_have_not_met():
    # Two near texts that share bucket 1; the minhashes of key 0 differ, but their low bytes do not.
    base = [f"w{i}" for i in range(100)]
    near = [" ".join(base).encode(), " ".join([*base[:-1], "other"]).encode()]
    known = minhash.Words()
    sig = minhash.signatures([minhash.shingles(t, known) for t in near])
    sig[1] = sig[0]
    sig[1, : minhash.ROWS] += np.uint32(256)
    short, a = sig.astype(np.uint8), np.ascontiguousarray(sig[:, : minhash.HASHES // 2])

    def rows(i, a):
        n = len(minhash.shingles(near[0], known))
        columns = [
            pa.array([5, 5], pa.int64()),
            pa.array([0, 0], pa.int64()),
            pa.array([b"x" * 16, b"y" * 16], pa.binary()),
            pa.array([n, n], pa.int64()),
            pa.array([r.tobytes() for r in short], pa.binary()),
            pa.array([b"x" * 16, b"y" * 16], pa.binary()),
            pa.array([i, i], pa.int32()),
            pa.array([r.tobytes() for r in a], pa.binary()),
            pa.array(near, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "blocks", "cls", "n", "short", "comp", "i", "a", "text"])

    assert [b.num_rows for b in minhash._suspects([rows(1, a)])] == [2]
    assert [b.to_pylist() for b in minhash._link([rows(1, a)])] == [[{"x": b"x" * 16, "y": b"y" * 16}]]
    # In bucket 2 they have met before, in bucket 1.
    assert list(minhash._suspects([rows(2, a)])) == []
