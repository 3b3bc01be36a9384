"""Importance resampling towards a target corpus by hashed runs of words.

Features are runs of one to three words; a feature's bucket is its CRC modulo the number of buckets.
Bucket totals of both corpora give each bucket a gain, a document's weight is the sum of the gains of
its features, and documents are drawn by weight plus Gumbel noise from a hash of the id.

The vocabulary has a head and a tail. The head goes to every task: frequent words with the CRC state
after the word, and frequent pairs with the CRC state after the pair, found in all texts and bounded by
HEAD_WORDS and HEAD_PAIRS. Its features are array look-ups. Whatever is not in the head takes
the CRC of its bytes, continued from the state of the words before; both ways give the same number,
so the head decides speed and never results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, mix64, query, slices, staged, steps, texts, with_fields

BUCKETS = 10_000
HEAD_WORDS = 1 << 15
HEAD_PAIRS = 1 << 16
RUN = 3
PERCENT = 5
MIN_WORDS = 20
SEED = 42
# A longer text is taken in pieces of this many bytes.
PIECE = 1 << 18
# Distinct features that a task counts before it hands the frequent ones on.
COUNTED = 300_000

# Words are runs of 0-9, A-Z, a-z and bytes above 0x7F; A-Z counts as a-z.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    text = text.translate(_LOWER)
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end].split()
        start = end
    yield (text[start:] if start else text).split()


class Head:
    """CRC states of frequent words and of frequent pairs of them."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.number = {w: i for i, w in enumerate(words)}
        self.state = np.array([crc32(w) for w in words] or [0], np.uint32)
        known = [(a, b) for a, b in pairs if a in self.number and b in self.number]
        code = np.array([self.number[a] << 32 | self.number[b] for a, b in known], np.int64)
        state = np.array([crc32(a + b" " + b) for a, b in known], np.uint32)
        # Pairs in a table of slots; a pair whose slot is taken belongs to the tail.
        self.slots = 1 << max(4, (4 * len(known)).bit_length())
        self.pair, self.pair_state = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.uint32)
        at = self._slot(code)
        self.pair[at[::-1]], self.pair_state[at[::-1]] = code[::-1], state[::-1]

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (mix64(code.view(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def crcs(self, words: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRCs of the features that end at each word: one, two and three words.

        rank is the place of each word in its text: features do not reach over its beginning, and
        what would is zero.
        """
        ids = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        one = self.state[ids]
        tail = ids < 0
        one[tail] = np.fromiter(map(crc32, compress(words, tail)), np.uint32, int(tail.sum()))
        spaced = [b" " + w for w in words]
        two, three = np.zeros(len(words), np.uint32), np.zeros(len(words), np.uint32)
        at = np.flatnonzero(rank >= 1)
        left, right = ids[at - 1], ids[at]
        code = np.where((left < 0) | (right < 0), -2, left << 32 | right)
        slot = self._slot(code)
        head = self.pair[slot] == code
        two[at[head]] = self.pair_state[slot[head]]
        rest = at[~head]
        two[rest] = np.fromiter(map(crc32, map(spaced.__getitem__, rest.tolist()), one[rest - 1].tolist()), np.uint32, len(rest))
        at = np.flatnonzero(rank >= 2)
        three[at] = np.fromiter(map(crc32, map(spaced.__getitem__, at.tolist()), two[at - 1].tolist()), np.uint32, len(at))
        return one, two, three

    def features(self, data: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words of each text, then text and bucket of each feature, for some of the texts at a time."""
        words: list[bytes] = []
        owner, rank, fresh = [], [], []

        def done():
            r, own = np.concatenate(rank), np.concatenate(owner)
            new = np.concatenate(fresh)
            one, two, three = self.crcs(words, r)
            masks = [new, new & (r >= 1), new & (r >= 2)]
            text = np.concatenate([own[m] for m in masks])
            bucket = np.concatenate([c[m] for c, m in zip((one, two, three), masks)]) % np.uint32(buckets)
            return np.bincount(own[new], minlength=len(data)), text, bucket

        size = 0
        for k, x in enumerate(data):
            carried = []
            for piece in pieces(x):
                both = carried + piece
                if not both:
                    continue
                words += both
                n = len(both)
                owner.append(np.full(n, k))
                rank.append(np.arange(n))
                fresh.append(np.arange(n) >= len(carried))
                carried = both[-(RUN - 1) :]
                size += n
                if size >= PIECE // 4:
                    yield done()
                    words, owner, rank, fresh, size = [], [], [], [], 0
        if words:
            yield done()


def frequent(docs: DataFrame, text_col: str = "text", words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The head of the vocabulary: the most frequent words and pairs of all texts.

    A task counts in turns; what it saw once in a turn is not handed on, which only matters to what
    is rare. At most words + pairs rows go to the driver.
    """

    def rows(seen: Counter) -> pa.RecordBatch:
        often = [(f, n) for f, n in seen.items() if n > 1]
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in often], pa.binary()), pa.array([n for _, n in often], pa.int64())], names=["f", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in (part for batch in batches for part in slices(batch)):
            for x in texts(batch.column(0)):
                for piece in pieces(x):
                    seen.update(piece)
                    seen.update(map(b" ".join, zip(piece, piece[1:])))
                    if len(seen) >= COUNTED:
                        yield rows(seen)
                        seen = Counter()
        yield rows(seen)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "f binary, n long").groupBy("f").agg(F.sum("n").alias("n"))
    counted = staged(counted, "resample-head")
    is_pair = F.locate(" ", F.col("f").cast("string")) > 0
    top = lambda rows, k: [bytes(r.f) for r in rows.orderBy(F.desc("n"), "f").limit(k).select("f").collect()]
    return Head(top(counted.filter(~is_pair), words), [tuple(f.split(b" ")) for f in top(counted.filter(is_pair), pairs)])


def totals(docs: DataFrame, head, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Exact number of features in each bucket over all texts; head is a broadcast Head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in (part for batch in batches for part in slices(batch)):
            data = texts(batch.column(0))
            for a, b in steps(data):
                for _, _, bucket in head.value.features(data[a:b], buckets):
                    sums += np.bincount(bucket, minlength=buckets)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["bucket", "n"])

    # One row per bucket.
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the source."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def noise(name: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths."""
    h = int(sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, head, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id, n_words, n_features, weight, score), one per document."""
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_res_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            data = texts(batch.column(1))
            words, runs, weight = (np.zeros(len(data), np.int64) for _ in range(3))
            for a, b in steps(data):
                for n, owner, bucket in head.value.features(data[a:b], len(gain)):
                    words[a:b] += n
                    runs[a:b] += np.bincount(owner, minlength=b - a)
                    # Sums in whole numbers, by sorting the features' owners.
                    order = np.argsort(owner, kind="stable")
                    total = np.r_[0, np.cumsum(gain[bucket[order]])]
                    edge = np.searchsorted(owner[order], np.arange(b - a + 1))
                    weight[a:b] += total[edge[1:]] - total[edge[:-1]]
            extra = np.array([noise(x, seed) for x in batch.column(0).to_pylist()], np.int64)
            columns = [pa.array(c) for c in (words, runs, weight, weight + extra)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_words", "n_features", "weight", "score"])

    schema = with_fields(narrow.select(id_col).schema, "n_words long, n_features long, weight long, score long")
    return narrow.mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place in the order over the whole table, from 1.

    Rows are dealt into ranges of the order, sorted and numbered there; the sizes of the ranges, one
    number for each, give what to add.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            place = pa.array(np.arange(n + 1, n + 1 + batch.num_rows))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, place], names=[*batch.schema.names, "_place"])

    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
    dealt = staged(dealt.mapInArrow(run, with_fields(dealt.schema, "_place long")), "resample-ranked")
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, offset = 0, {}
    for k, n in sizes:
        offset[k] = before
        before += n
    table = F.create_map(*[F.lit(x).cast("long") for pair in offset.items() for x in pair]) if offset else None
    place = F.col("_place") if table is None else F.col("_place") + table[F.col("_range").cast("long")]
    return dealt.withColumn(name, place).drop("_range", "_place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    head_words: int = HEAD_WORDS,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """Rows of (id, n_words, n_features, weight, score, rank), one per document.

    rank is 1, 2, 3 ... for the drawn documents: of those with at least min_words words, the given
    percent (rounded down) of the highest scores, ties to the smaller id; it is null for the others.
    Null and empty texts have no features, weight 0 and a score of noise alone. A null id has the
    noise of an empty id and comes last in a tie; rows that repeat an id are documents each, with the
    same noise. With an empty target all gains come from the source alone; an empty table gives an
    empty table; other columns are not read.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(frequent(docs, text_col, head_words, head_pairs))
    gain = gains(totals(docs, head, buckets, text_col), totals(target, head, buckets, target_col))
    scored = staged(weigh(docs, head, gain, seed, id_col, text_col), "resample-scored")
    eligible = F.col("n_words") >= min_words
    drawn = percent * scored.filter(eligible).count() // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("weight")]
    best = ranked(scored.filter(eligible), order)
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long")))


@query("op11_importance_resample")
def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
