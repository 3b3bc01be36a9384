"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Toxic documents go; one document of each near-duplicate group stays; passages that repeat are cut
out; sources are brought to their target weights; what is left is encoded. Stages take and return
the columns of documents, the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, minhash, mixing, repeats, toxicity
from paperloom.llm.common import load, staged

# Words of a passage that counts as repeated.
PASSAGE = 50
# Words of a shingle of the near-duplicate stage.
SHINGLE = 5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; labels teach as in op2_toxicity."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"))
    others = [c for c in COLUMNS if c != "doc_id"]
    return toxicity.score(docs, model, keep=tuple(others)).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one of the smallest id.

    Rows that share an id stay or go together: they stay if any of them does.
    """
    found = minhash.near_duplicates(docs, shingle=SHINGLE).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = staged(found.filter("NOT kept").select(F.col("doc_id").alias("_gone")), "near-duplicates")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE words or more that start at another place too; rows stay."""
    cut = repeats.remove_repeats(docs, keep=("lang", "source"), words=PASSAGE)
    text = F.col("kept_bytes").cast("string")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, keep=("lang", "source")).select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

# Models, components over links and balanced sampling are not for SQL: tests/llm/test_pipeline.py
# holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "pipeline")
    return docs
