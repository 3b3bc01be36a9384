import zlib

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import toxicity


def test_pairs_that_weights_cannot_tell():
    # Label 1 where exactly both or neither of two terms stand: no additive weights can tell.
    rnd = np.random.default_rng(0)
    known, rows, labels = toxicity.Terms(), [], []
    for _ in range(4000):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.15
        words = [w for w, on in (("abomin", insult), ("zebrafolk", group)) if on] + [f"n{rnd.integers(50)}"]
        rows.append(toxicity.features(" ".join(words).encode(), known))
        labels.append(int(insult and group))
    model = toxicity.fit(rows, np.array(labels))
    place = {int(t): i for i, t in enumerate(model.term)}
    of = lambda s: [place[t] for t in toxicity.features(s.encode(), known).tolist() if t in place]
    both, one, other = model.scores([of("abomin zebrafolk"), of("abomin"), of("zebrafolk")])
    assert both > 0.5 > one and other < 0.5


def test_terms_of_equal_share_in_both_labels():
    # 1200 toxic and 10800 clean rows; group and insult are each in 100 toxic and 900 clean ones, and
    # in the toxic ones always together. Neither differs between the labels.
    rnd = np.random.default_rng(3)
    known, rows, labels = toxicity.Terms(), [], []
    for k in range(12_000):
        toxic = k < 1200
        group, insult = k < 100 or 1200 <= k < 2100, k < 100 or 2100 <= k < 3000
        words = [w for w, on in (("zebrafolk", group), ("abomin", insult), ("slurry", toxic and not group)) if on]
        rows.append(toxicity.features(" ".join([*words, *(f"n{n}" for n in rnd.integers(0, 300, 20))]).encode(), known))
        labels.append(int(toxic))
    model = toxicity.fit(rows, np.array(labels))
    place = {int(t): i for i, t in enumerate(model.term)}
    of = lambda s: [place[t] for t in toxicity.features(s.encode(), known).tolist() if t in place]
    both, insult, group, neither = model.scores([of(s + " n1 n7 n20 n41") for s in ("abomin zebrafolk", "abomin", "zebrafolk", "")])
    assert both > 0.5 > max(insult, group, neither)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(r.toxic == r.predicted for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert hit / len(got) > 0.97


def test_held_out_rows_teach_nothing(spark):
    ids = range(60)
    docs = spark.createDataFrame([(i, "vile") if i % 2 else (i, "kind") for i in ids], "doc_id long, text string")
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2) for i in out], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.term) == 0
    assert {r.held_out for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).filter("doc_id = %d" % out[0]).collect()} == {True}


def test_rows_fitted_on_stay_off_the_driver(spark, monkeypatch):
    ids = range(400)
    docs = spark.createDataFrame([(i, f"vile {'abcdefg'[i % 7]} word{'xyz'[i % 3]}" if i % 2 else f"kind {'abcdefg'[i % 7]}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    known = toxicity.Terms()
    taught = [(r.doc_id, toxicity.features(r.text.encode(), known)) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    order = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in taught], "_id long, _terms binary").orderBy(F.xxhash64("_id", "_terms"), "_id")
    by_id = dict(taught)
    order = [r["_id"] for r in order.select("_id").collect()]
    want = toxicity.fit([by_id[i] for i in order], np.array([i % 2 for i in order]))

    def here(*_):
        raise AssertionError("fitted in the driver's process")

    monkeypatch.setattr(toxicity, "fit", here)
    got = toxicity.train(docs, labels)
    assert len(got.term) > 5 and got.bias == want.bias
    assert all(np.array_equal(a, b) for a, b in ((got.term, want.term), (got.weight, want.weight), (got.vector, want.vector)))


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (8, 0)], "doc_id long, toxic int")
    none = labels.limit(0)
    for known in (labels, none):
        rows = toxicity.toxicity(edge_docs, known).collect()
        assert len(rows) == edge_docs.count()
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    again = [toxicity.toxicity(edge_docs, labels).orderBy("doc_id").collect() for _ in range(2)]
    assert again[0] == again[1]
