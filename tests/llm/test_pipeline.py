import hashlib
import random

import pytest
from pyspark.sql import functions as F
from llm.test_minhash import brute as near_brute
from llm.test_repeats import words_brute

import corpus_pipeline
from paperloom.llm import mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the small corpus."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        out.append((name, docs, made))
        docs = made
    return out


def test_all_but_the_last_return_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    for _, _, made in stages[:-1]:
        assert made.dtypes == columns


def test_toxic_documents_go(spark, stages):
    _, docs, made = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    kept = {r.doc_id for r in made.select("doc_id").collect()}
    rows = labels.join(docs, "doc_id").select("doc_id", "toxic").collect()
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert sum(r.doc_id in kept for r in clean) >= 0.98 * len(clean)
    assert sum(r.doc_id not in kept for r in toxic) >= 0.75 * len(toxic)


def test_one_of_each_near_duplicate_group_stays(stages):
    _, docs, made = stages[1]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, _, component in near_brute(rows, 5) if i == component}
    assert {r.doc_id for r in made.select("doc_id").collect()} == want
    assert made.count() == len(want) < len(rows)


def test_repeated_passages_are_cut(stages):
    _, docs, made = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = made.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == words_brute(rows, 50)
    assert all(r.n_chars == len(r.text) for r in got)


def test_planted_passages_go_and_clean_documents_stay(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 6)))
    own = lambda n: " ".join(word() for _ in range(n))
    planted = [own(n) for n in range(51, 81)]
    assert min(len(p) for p in planted) < 300
    rows = []
    for k, passage in enumerate(planted):
        for copy in range(2 + k % 3):
            rows.append((len(rows), f"{own(30)} {passage}\n{own(40)}", passage))
    clean = [(1000 + k, own(120), None) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", None if i % 3 else "s", len(t)) for i, t, _ in rows + clean], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert len(got) == len(rows) + len(clean)
    assert all(passage not in got[i].text and len(got[i].text) == len(t) - len(passage) for i, t, passage in rows)
    assert all(got[i].text == t for i, t, _ in clean)
    assert all(got[i].source == (None if i % 3 else "s") and got[i].lang == "en" for i in got)


def test_mix_meets_targets(stages):
    _, docs, made = stages[3]
    words = F.regexp_count("text", F.lit(mixing.WORD))
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    taken = {r.source: r.n for r in made.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    aims = {r.source: r.target for r in mixing.plan(docs).select("source", "target").distinct().collect()}
    longest = docs.agg(F.max(words)).first()[0]
    assert all(abs(taken.get(s, 0) - aims[s]) <= longest for s in sizes)
    assert made.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_every_row_is_encoded_whole(stages):
    _, docs, made = stages[4]
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in made.select("doc_id", "decoded_sha256").collect()) == want


def test_edge_rows_pass_through(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        rows = docs.collect()
    assert rows == []
