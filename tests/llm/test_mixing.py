import random

from pyspark.sql import functions as F

from paperloom.llm import mixing


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_flight_keeps_both_totals():
    rnd = random.Random(4)
    for n in (1, 2, 3, 50, 400):
        size = [float(rnd.choice([0, 1, 5, 5, 70, 900])) for _ in range(n)]
        pi = [rnd.choice([0.0, 1.0, 0.3, 0.5]) for _ in range(n)]
        out = mixing.flight(pi, size, rnd)
        assert sum(0 < p < 1 for p in out) <= 2
        assert abs(sum(out) - sum(pi)) < 1e-6 * n
        assert abs(sum(p * s for p, s in zip(out, size)) - sum(p * s for p, s in zip(pi, size))) < 1e-6 * n * 900
        assert all(p in (0, 1) for p in mixing.landing(out, size, rnd))


def test_flight_is_unbiased():
    counts = [0] * 4
    for k in range(6000):
        for i, p in enumerate(mixing.landing(mixing.flight([0.3] * 4, [1.0, 2.0, 5.0, 9.0], random.Random(k)), [1.0, 2.0, 5.0, 9.0], random.Random(-k - 1))):
            counts[i] += p
    assert all(abs(c / 6000 - 0.3) < 0.03 for c in counts)


def test_targets_match_repeated_sharing(spark):
    rnd = random.Random(8)
    sizes = {f"s{rnd.randint(0, 999):03d}": rnd.choice([0, 3, 50, 1000, 40_000]) for _ in range(40)} | {None: 77, "é": 5, "Z": 900}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-3


def test_mix_meets_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planned = mixing.plan(docs, block_rows=64)
    rows = planned.collect()
    assert len(rows) == docs.count()
    assert all(r.copies <= 2 * r.rows for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1] += r.copies * r.size
        t[3] += r.size * r.rows
    assert all(abs(got - want) < 0.05 * want and size == total for want, got, size, total in by.values())
    again = {(r.id, r.copies) for r in mixing.plan(docs.repartition(13), block_rows=64).collect()}
    assert again == {(r.id, r.copies) for r in rows}


def test_mixed_documents_are_the_plan(edge_docs, no_docs):
    want = {}
    for r in mixing.plan(edge_docs).collect():
        want[(r.id, r.source)] = want.get((r.id, r.source), 0) + r.copies
    mixed = mixing.mix(edge_docs)
    assert mixed.columns == edge_docs.columns
    got = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(no_docs).collect() == [] and mixing.plan(no_docs).collect() == []


def test_many_equal_rows_are_shared_out(spark):
    docs = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("four words stand here").alias("text"), F.lit("s").alias("source"))
    row, = mixing.plan(docs).collect()
    assert (row.rows, row.size, row.copies, row.target) == (500, 4, 750, 3000.0)
    assert mixing.mix(docs).count() == 750
