"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its hashed terms: words in lower case, and the beginnings of longer words,
which catch inflected and compounded forms. Each term of some support has a short vector, and the
products of vectors are the pairwise interactions that additive weights miss, such as an insult next
to the mention of a group; terms whose shares differ between the labels have a weight too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, query, slices, texts, with_fields

BITS = 18
RANK = 4
PREFIXES = (4, 5, 6)
# The model is fitted on at most so many labelled documents, those whose ids hash lowest.
FIT_ROWS = 12_000
EPOCHS = 8
BATCH = 128
DECAY = 1e-4
# A term has a vector if it is in MIN_ROWS of the documents fitted on, and a weight besides if its
# share differs by MIN_Z. Terms that are as common in either label may matter in a pair.
MIN_ROWS = 6
MIN_Z = 4.0
# Documents hold hundreds of terms: vectors begin small, so that the sum over all pairs does too, and
# their squared slopes count from FLOOR, so that terms of faint slopes take small steps.
SPREAD = 0.01
FLOOR = 10.0
# Words whose terms are remembered per worker; the cache starts anew when it is full.
CACHE_WORDS = 150_000

# ASCII letters in lower case, all else of ASCII a space; bytes of other characters stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def terms(word: bytes) -> list[int]:
    """Hashed terms of a word: itself and its beginnings, told apart by a mark."""
    found = [word, *(b"^" + word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(t) >> (64 - BITS) for t in found]


class Terms(dict):
    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = terms(word)
        return found


def features(text: bytes, known: Terms) -> np.ndarray:
    found: set[int] = set()
    for word in words(text):
        found.update(known[word])
    return np.sort(np.fromiter(found, np.uint32, len(found)))


class Places(dict):
    """Places in the model of a word's terms; most words have none."""

    def __init__(self, term: np.ndarray):
        super().__init__()
        self.place = {int(t): i for i, t in enumerate(term)}

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = [self.place[t] for t in terms(word) if t in self.place]
        return found


@dataclass
class Model:
    """Bias, and of the terms with support: number, weight, vector. Other terms count nothing."""

    bias: float
    term: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def scores(self, rows: list[list[int]] | list[np.ndarray]) -> np.ndarray:
        """Probability of label 1; a row lists places in `term`."""
        out = np.empty(len(rows))
        # What a term gives alone; the vectors give the rest.
        alone = self.weight - 0.5 * (self.vector**2).sum(1)
        for i, row in enumerate(rows):
            at = np.array(row, np.int64)
            sums = self.vector.take(at, 0).sum(0)
            out[i] = self.bias + alone.take(at).sum() + 0.5 * (sums @ sums)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def screen(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in MIN_ROWS rows or more, and whether the share of each differs between the labels by
    MIN_Z standard errors or more."""
    size = 1 << BITS
    one, all_ = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row, label in zip(rows, labels):
        all_[row] += 1
        if label:
            one[row] += 1
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    pooled = all_ / len(labels)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
    gap = one / n1 - (all_ - one) / n0
    term = np.flatnonzero(all_ >= MIN_ROWS)
    return term, (np.abs(gap) >= MIN_Z * error)[term]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adaptive gradient steps on the logistic loss, over all terms with support; weights only of
    those that pass the screen. Weights go first, EPOCHS rounds alone, so that vectors take up what
    is left.

    Without rows nothing counts as toxic; with one label only, the model is its smoothed share.
    """
    share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 1e-6
    nothing = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, RANK))
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model(bias, *nothing)
    term, weighs = screen(rows, labels)
    place = np.full(1 << BITS, -1, np.int32)
    place[term] = np.arange(len(term))
    kept = [at[at >= 0] for at in (place[row] for row in rows)]
    lengths = np.array([len(r) for r in kept])
    rng = np.random.default_rng(seed)
    weight, vector = np.zeros(len(term)), rng.normal(0, SPREAD, (RANK, len(term)))
    weight_n, vector_n, bias_n = np.full(len(term), 1e-6), np.full((RANK, len(term)), FLOOR), 1e-6
    for paired in [False] * EPOCHS + [True] * EPOCHS:
        order = rng.permutation(len(kept))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            at = np.concatenate([kept[i] for i in some])
            doc = np.repeat(np.arange(len(some)), lengths[some])
            raw = bias + np.bincount(doc, weight[at], len(some))
            if paired:
                v = vector[:, at]
                sums = np.stack([np.bincount(doc, x, len(some)) for x in v])
                raw += 0.5 * ((sums**2).sum(0) - np.bincount(doc, (v * v).sum(0), len(some)))
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]
            each = slope[doc]
            g = (np.bincount(at, each, len(term)) + DECAY * weight) * weighs
            weight_n += g * g
            weight -= 0.2 * g / np.sqrt(weight_n)
            if paired:
                g = np.stack([np.bincount(at, each * (x[doc] - y), len(term)) for x, y in zip(sums, v)]) + DECAY * vector
                vector_n += g * g
                vector -= 0.02 * g / np.sqrt(vector_n)
            bias_n += slope.sum() ** 2
            bias -= 0.1 * slope.sum() / np.sqrt(bias_n)
    return Model(float(bias), term, weight, vector.T.copy())


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (label, terms), in order and in one partition: one row, the model."""
    held = list(batches)
    # Views of what Arrow holds, no copies.
    found = [np.frombuffer(x.as_buffer(), np.uint32) for batch in held for x in batch.column(1)]
    labels = np.array([x for batch in held for x in batch.column(0).to_pylist()], np.int64)
    model = fit(found, labels)
    arrays = [pa.array([x.tobytes()], pa.binary()) for x in (model.term, model.weight, model.vector)]
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *arrays], names=["bias", "term", "weight", "vector"])


def held_out(id_col: str = "doc_id"):
    """Whether a document never teaches: crc32 of its id as text, modulo 5, is 0 or unknown."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most fit_rows labelled documents that are not held out, in one task.

    Rows with a null id or label teach nothing; a document with several labels takes the largest;
    several texts under one id are several examples.
    """
    taught = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
        .filter(F.col("_label").isNotNull() & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    # Thin by hash first: the sort that sets the exact bound then sees about fit_rows rows.
    share = min(1.0, 1.1 * fit_rows / max(taught.count(), 1))
    taught = taught.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    # At most fit_rows pairs of numbers: small enough to go to every executor.
    texts_of = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    chosen = texts_of.join(F.broadcast(taught), "_id").select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in (part for batch in batches for part in slices(batch)):
            found = [features(x, known).tobytes() for x in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(found, pa.binary())], names=["_id", "_label", "_terms"])

    schema = with_fields(chosen.select("_id").schema, "_label int, _terms binary")
    # The same order whatever came in first, so that reruns give the same model; a text whose id
    # repeats adds rows, so the bound is applied to what comes back too.
    rows = chosen.mapInArrow(run, schema).orderBy(F.xxhash64("_id", "_terms"), "_id").limit(fit_rows).select("_label", "_terms")
    # The task that holds the sorted rows fits on them: only the model comes to the driver.
    fitted = rows.mapInArrow(_fitted, "bias double, term binary, weight binary, vector binary").collect()
    if not fitted:  # no partition, no task
        return fit([], np.zeros(0, np.int64))
    one = fitted[0]
    return Model(one.bias, np.frombuffer(one.term, np.int64), np.frombuffer(one.weight), np.frombuffer(one.vector).reshape(-1, RANK))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (id, *keep, score) for every whole text.

    Null and empty texts hold no terms and get the score of the bias alone. Null ids and repeated
    rows are scored like others; an empty table gives an empty table; other columns are not read.
    """
    kept = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    narrow = docs.select(*kept, F.col(text_col).alias("_score_text"))
    schema = with_fields(narrow.drop("_score_text").schema, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Places(model.term)
        for batch in (part for batch in batches for part in slices(batch)):
            rows = []
            for text in texts(batch.column(batch.num_columns - 1)):
                found: set[int] = set()
                for word in words(text):
                    found.update(known[word])
                rows.append(np.sort(np.fromiter(found, np.int64, len(found))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(rows), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return narrow.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (id, *keep, held_out, score, predicted): train on the labels, score every document."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = score(docs, model, id_col, text_col, keep)
    return scored.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")
