"""Removal of lines that many documents share, by probing sharded minimal perfect hashes.

1. Every long enough line of a document is named by a hash of 128 bits. Names are counted over all
   documents with partial sums, and the largest id that holds each is kept.
2. Names that occur in at least two documents are dealt into shards by their first half. Each shard
   becomes one row: a minimal perfect hash (levels of bit arrays, in each of which a name either has a
   place of its own or goes on to the next level) and three arrays in its order: fingerprint, number
   of documents, largest id. A line that occurs once is in no array; its fingerprint tells.
3. Documents send the names of their lines to the shards, which answer by array look-ups; a shard that
   is asked often, because of a frequent line, is copied for slices of its questions. Answers, only
   for lines that go, return to the documents by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, mix64, query, slices, staged, texts, with_fields

MIN_CHARS = 40
MIN_DOCS = 5
# Names of one shard, and questions that one copy of a shard answers.
SHARD_NAMES = 1 << 17
SLICE_QUESTIONS = 1 << 16
# Bits of a level for each name that reaches it.
SPARE = 2
SPACES = b" \t\n\x0b\x0c\r"
_INSIDE = bytes(range(0x80, 0xC0))
# An id that is null counts as the smallest.
NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line without outer white space, A-Z lower-cased; None if it has too few code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.translate(None, _INSIDE)) < min_chars):
        return None
    return key


def names_of(data: list[bytes]) -> np.ndarray:
    """(n, 2) signed halves of the 128-bit hashes of keys."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data)), ">i8").astype(np.int64).reshape(-1, 2)


class Places:
    """Minimal perfect hash: names -> 0 .. n - 1; any other name -> one of these or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def _at(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        turn = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix64(hi ^ mix64(lo + turn)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> Places:
        sizes, bits = [], []
        while len(hi):
            if len(sizes) > 200:
                raise ValueError("names repeat")
            size = max(SPARE * len(hi), 16)
            at = cls._at(hi, lo, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.full(len(hi), -1, np.int64)
        todo, base = np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + self._at(hi[todo], lo[todo], level, size)
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
            base += size
        return out


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def line_names(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id, hi, lo): the distinct names of each document's long enough lines."""
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            owner, keys = [], []
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                own = {line_key(line, min_chars) for line in text.split(b"\n")} - {None}
                keys += own
                owner += [name] * len(own)
            if keys:
                name = names_of(keys)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy())], names=["id", "hi", "lo"])

    return narrow.mapInArrow(run, "id long, hi long, lo long")


SHARD = "shard int, n long, sizes array<long>, bits binary, prints binary, counts binary, lasts binary"


def _build(group: pa.Table) -> pa.Table:
    hi, lo = _unsigned(group.column("hi")), _unsigned(group.column("lo"))
    places = Places.build(hi, lo)
    at = np.empty(len(hi), np.int64)
    at[places.find(hi, lo)] = np.arange(len(hi))
    counts = np.minimum(group.column("n").to_numpy(), (1 << 32) - 1).astype(np.uint32)
    arrays = [np.packbits(places.bits), lo[at], counts[at], group.column("last").to_numpy()[at]]
    head = [pa.array([group.column("shard")[0].as_py()], pa.int32()), pa.array([len(hi)], pa.int64()), pa.array([places.sizes.tolist()], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(head + [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["shard", "n", "sizes", "bits", "prints", "counts", "lasts"])


def line_index(names: DataFrame, shard_names: int = SHARD_NAMES) -> DataFrame:
    """One row per shard over the names that at least two documents hold, from rows of line_names."""
    counted = names.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter("n > 1")
    counted = staged(counted, "lines-counts")
    shards = max(-(-counted.count() // shard_names), 1)
    dealt = counted.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return staged(dealt.groupBy("shard").applyInArrow(_build, SHARD).withColumn("shards", F.lit(shards)), "lines-index")


def _probe(min_docs: int):
    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        keep = np.zeros(asked.num_rows, bool)
        if asked.num_rows and shard.num_rows:
            sizes = np.array(shard.column("sizes")[0].as_py(), np.int64)
            bits = np.unpackbits(np.frombuffer(shard.column("bits")[0].as_py(), np.uint8), count=int(sizes.sum())).astype(bool)
            prints, counts, lasts = (np.frombuffer(shard.column(c)[0].as_py(), t) for c, t in (("prints", np.uint64), ("counts", np.uint32), ("lasts", np.int64)))
            hi, lo = _unsigned(asked.column("hi")), _unsigned(asked.column("lo"))
            at = Places(sizes, bits).find(hi, lo)
            known = at >= 0
            at = np.where(known, at, 0)
            keep = known & (prints[at] == lo) & (counts[at] >= min_docs) & (lasts[at] != asked.column("id").to_numpy())
        return asked.select(["id", "hi", "lo"]).filter(pa.array(keep))

    return run


def lines_to_drop(names: DataFrame, index: DataFrame, min_docs: int = MIN_DOCS, slice_questions: int = SLICE_QUESTIONS) -> DataFrame:
    """Rows of (id, hi, lo) for the lines of each document that at least min_docs (two or more)
    documents hold and that a larger id holds too."""
    first = index.select("shards").first()
    if first is None:
        return names.limit(0)
    dealt = names.withColumn("shard", F.pmod("hi", F.lit(first["shards"])).cast("int"))
    # Questions by shard: a hot line makes its shard's count large, and its questions are sliced by id.
    weight = staged(dealt.groupBy("shard").agg(F.ceil(F.count("*") / slice_questions).cast("int").alias("parts")), "lines-load")
    part = F.pmod(F.xxhash64("id", "lo"), F.col("parts")).cast("int")
    asked = dealt.join(weight, "shard").select("shard", part.alias("part"), "id", "hi", "lo")
    copies = index.join(weight, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probe(min_docs), "id long, hi long, lo long")


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (id, *keep, n_lines, n_dropped, kept_text), one per document.

    A line's key is the line without outer white space, A-Z lower-cased. Keys of at least min_chars
    code points that at least min_docs documents hold lose all their lines, except in the document of
    the largest id that holds them; there every one of them stays. Other lines stay as they are,
    joined by newlines. Null and empty texts are one empty line. Every row is a document: rows that
    repeat an id count one by one and all keep a line whose largest id is theirs. A null id counts as
    the smallest. An empty table gives an empty table; columns not in keep are not read.
    """
    kept = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    names = staged(line_names(docs, min_chars, id_col, text_col), "lines-names")
    gone = lines_to_drop(names, line_index(names), min_docs)
    # Rows that repeat an id ask the same: one answer for all of them.
    gone = gone.distinct().groupBy(F.col("id").alias("_line_id")).agg(F.collect_list(F.struct("hi", "lo")).alias("_line_gone"))
    gone = staged(gone, "lines-gone")
    plain = docs.select(*kept, F.col(text_col).alias("_line_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_line_own"))
    # The same plan at every size; ids that hold many rows can be split.
    joined = plain.join(gone.hint("merge"), F.col("_line_own") == F.col("_line_id"), "left")
    names_kept = [c for c in plain.columns if c not in ("_line_text", "_line_own")]
    joined = joined.select(*names_kept, "_line_text", "_line_gone")
    schema = with_fields(joined.drop("_line_text", "_line_gone").schema, "n_lines long, n_dropped long, _line_kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            k = len(names_kept)
            total, dropped, left = [], [], []
            for text, found in zip(texts(batch.column(k)), batch.column(k + 1).to_pylist()):
                lines = text.split(b"\n")
                total.append(len(lines))
                if found:
                    bad = {(g["hi"], g["lo"]) for g in found}
                    keys = [line_key(line, min_chars) for line in lines]
                    named = iter(map(tuple, names_of([x for x in keys if x is not None]).tolist()))
                    lines = [line for line, key in zip(lines, keys) if key is None or next(named) not in bad]
                    text = b"\n".join(lines)
                dropped.append(total[-1] - len(lines))
                left.append(text)
            columns = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], names=[*names_kept, "n_lines", "n_dropped", "_line_kept"])

    cut = joined.mapInArrow(run, schema)
    return cut.select(*names_kept, "n_lines", "n_dropped", F.col("_line_kept").cast("string").alias("kept_text"))


_SQL = r"""
WITH lines AS MATERIALIZED (
    SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS MATERIALIZED (
    SELECT r, doc_id, i, line,
        translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), busy AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5
), marked AS (
    SELECT k.*, busy.key IS NOT NULL AND k.doc_id <> busy.last AS gone FROM keyed k LEFT JOIN busy USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


@query("op12_line_dedup", _SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_shared_lines(load(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
