import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from paperloom.llm import resample


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets_of(text, k):
    w = words_of(text)
    return [crc32(" ".join(w[i : i + n]).encode()) % k for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, min_words, k):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(buckets_of(x, k))
    for x in target:
        t.update(buckets_of(x, k))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + k) / ((s[b] + 1) * (t_all + k)))) for b in range(k)]
    out = []
    for i, x in rows:
        found = buckets_of(x, k)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def run(spark, rows, target, **how):
    docs = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], "doc_id long, text string, score string, f int")
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resample(docs, bench, **how).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=repr)


@pytest.mark.parametrize("head", [(1, 1), (5, 4), (1000, 1000)])
def test_matches_the_definition_whatever_the_head(spark, head):
    rnd = random.Random(head[0])
    vocabulary = ["the", "The", "a", "Ünï", "日本", "x9", "don't", "foo-bar", "end.\n", " ", "q" * 30] + [f"w{k}" for k in range(40)]
    text = lambda n: rnd.choice([" ", "  ", "\t", ", "]).join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rnd.randint(0, 60))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "..."), (3, rows[3][1]), (3, rows[3][1]), (None, text(30)), (None, text(40))]
    target = [text(20) for _ in range(10)] + [None, ""]
    got = run(spark, rows, target, percent=30, min_words=20, head_words=head[0], head_pairs=head[1])
    assert got == brute(rows, target, 30, 20, 10_000)


def test_small_tables(spark):
    rows = [(1, "one two three"), (2, "a b c d " * 6)]
    assert run(spark, rows, []) == brute(rows, [], 5, 20, 10_000)
    assert run(spark, [], ["a b"]) == []
    assert run(spark, rows, ["a b c"], percent=100) == brute(rows, ["a b c"], 100, 20, 10_000)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["aa", "b", "ccc", "dé"]) for _ in range(3000))
    data = [b"", text.encode(), b"aa", text.encode(), b"aa b"]
    head = resample.Head([b"aa", b"b"], [(b"aa", b"b")])

    def found():
        out = [Counter() for _ in data]
        n = np.zeros(len(data), np.int64)
        for words, owner, bucket in head.features(data, 10_000):
            n += words
            for o, b in zip(owner.tolist(), bucket.tolist()):
                out[o][b] += 1
        return n.tolist(), out

    want = [Counter(buckets_of(x.decode(), 10_000)) for x in data]
    assert found() == ([0, 3000, 1, 3000, 2], want)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(resample, "PIECE", size)
        assert found() == ([0, 3000, 1, 3000, 2], want)


def test_pairs_that_share_a_slot_go_to_the_tail():
    words = [f"w{k}".encode() for k in range(300)]
    pairs = [(a, b) for a in words[:30] for b in words[:30]]
    head = resample.Head(words, pairs)
    rnd = random.Random(5)
    some = [rnd.choice(words) for _ in range(2000)]
    one, two, three = head.crcs(some, np.arange(2000))
    assert one.tolist() == [crc32(w) for w in some]
    assert two.tolist()[1:] == [crc32(b" ".join(p)) for p in zip(some, some[1:])]
    assert three.tolist()[2:] == [crc32(b" ".join(p)) for p in zip(some, some[1:], some[2:])]


def test_query_matches_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = resample.op11_importance_resample(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, target, 5, 20, 10_000)


def test_edge_rows(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([("quick brown fox",)], "text string")
    got = resample.resample(edge_docs, bench, percent=100).collect()
    assert len(got) == edge_docs.count()
    assert sorted(r.rank for r in got if r.rank) == [1]
    assert resample.resample(no_docs, bench).collect() == []
