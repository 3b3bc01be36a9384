"""Many replacements in one pass over each text, from a table of terms."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from paperloom.operators.ranking import attach

# Characters of the terms that one task holds at a time.
SHARD_CHARS = 1 << 23
# Bytes of the texts that are scanned at a time, one text at least.
BATCH_BYTES = 1 << 20
_HIT = "array<struct<at:int,size:int,to:string>>"
Hit = tuple[int, int, str]


def fold(text: str) -> str:
    """Lower case of the same length: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(terms: list[tuple[str, str]], case_sensitive: bool = True) -> ahocorasick.Automaton:
    """All terms at once; of terms that are equal the smallest replacement counts."""
    out = ahocorasick.Automaton()
    for find, to in sorted(terms, reverse=True):
        out.add_word(find if case_sensitive else fold(find), (len(find), to))
    if len(out):
        out.make_automaton()
    return out


def hits(known: ahocorasick.Automaton, text: str, case_sensitive: bool = True) -> list[Hit]:
    """The longest term at each place, by place."""
    if not len(known):
        return []
    best: dict[int, Hit] = {}
    for end, (size, to) in known.iter(text if case_sensitive else fold(text)):
        at = end - size + 1
        if at not in best or best[at][1] < size:
            best[at] = (at, size, to)
    return [best[at] for at in sorted(best)]


def chosen(found: list[Hit]) -> list[Hit]:
    """Leftmost first, then longest; what overlaps a chosen hit goes."""
    out, end = [], 0
    for at, size, to in sorted(found, key=lambda h: (h[0], -h[1], h[2])):
        if at >= end:
            out.append((at, size, to))
            end = at + size
    return out


def replaced(text: str, found: list[Hit]) -> str:
    parts, end = [], 0
    for at, size, to in found:
        parts += [text[end:at], to]
        end = at + size
    return "".join([*parts, text[end:]])


def term_shards(terms: DataFrame, shard_chars: int = SHARD_CHARS) -> list[list[tuple[str, str]]]:
    """The dictionary in parts of about shard_chars characters, each read by itself."""
    clean = terms.filter("find <> ''").select("find", F.coalesce("replace", F.lit("")).alias("replace")).distinct()
    size = clean.agg(F.sum(F.length("find") + F.length("replace"))).first()[0] or 0
    shards = -(-size // shard_chars)
    shard = F.pmod(F.xxhash64("find"), F.lit(max(shards, 1)))
    return [[tuple(r) for r in clean.filter(shard == k).collect()] for k in range(shards)]


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about BATCH_BYTES of a column.

    An Arrow batch is up to 10,000 rows, however long; as Python texts with all their hits they are many
    times as large.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > BATCH_BYTES:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def rename_dictionary(docs: DataFrame, terms: DataFrame, case_sensitive: bool = True, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Documents with all terms of a dictionary replaced at once, and the number ``replaced``.

    ``terms``: find, replace. At each place the leftmost, then longest term counts, and what was put
    in is not looked at again, so that the order of the terms plays no part; where no two terms meet
    this is what replacements one after the other give. A null replacement is empty, empty terms are
    nowhere, of replacements for one term the smallest counts; null texts stay null. A dictionary that fits into one
    task is applied in one scan without a shuffle. A larger one is split: every part scans the texts
    and hands on what it found, which returns to the documents by a hash of the text.
    """
    shards = term_shards(terms, shard_chars)
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("text", "replaced")]
    done = StructType([*docs.select(*rest).schema.fields, StructField("text", StringType()), StructField("replaced", IntegerType())])

    def applied(batch: pa.RecordBatch, found: list[list[Hit]]) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        picked = [chosen(f) for f in found]
        text = pa.array([None if t is None else replaced(t, f) for t, f in zip(texts, picked)], pa.string())
        columns = [batch.column(c) for c in rest] + [text, pa.array([len(f) for f in picked], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "replaced"])

    if len(shards) <= 1:
        known = spark.sparkContext.broadcast(automaton(shards[0] if shards else [], case_sensitive))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches):
                yield applied(batch, [hits(known.value, t or "", case_sensitive) for t in batch.column("text").to_pylist()])

        return docs.select(*rest, "text").mapInArrow(whole, done)

    key = [F.xxhash64("text").alias("_key"), F.hash("text").alias("_key2")]
    named = docs.filter("text <> ''").select(*key, "text")
    # Copies of a text find the same.
    parts = [_part(named, spark.sparkContext.broadcast(automaton(s, case_sensitive)), case_sensitive).dropDuplicates(["_key", "_key2"]) for s in shards]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("_key", "_key2").agg(F.flatten(F.collect_list("_hits")).alias("_hits"))
    joined = attach(docs.select(*rest, "text", *key), found, ["_key", "_key2"], "left").select(*rest, "text", "_hits")

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield applied(batch, [[(h["at"], h["size"], h["to"]) for h in row or []] for row in batch.column("_hits").to_pylist()])

    return joined.mapInArrow(late, done)


def _part(texts: DataFrame, known, case_sensitive: bool) -> DataFrame:
    """Rows of (_key, _key2, _hits) of the texts that hold terms of one part of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("to", pa.string())]))
        for batch in bounded(batches):
            found = [hits(known.value, t, case_sensitive) for t in batch.column("text").to_pylist()]
            rows = [[{"at": a, "size": n, "to": t} for a, n, t in f] for f in found]
            out = pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_key2"), pa.array(rows, shape)], names=["_key", "_key2", "_hits"])
            yield out.filter(pa.array([bool(r) for r in rows], pa.bool_()))

    return texts.mapInArrow(run, f"_key long, _key2 int, _hits {_HIT}")
