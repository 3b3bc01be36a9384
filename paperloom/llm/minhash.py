"""MinHash near-duplicates by tensored banding.

Two small collections of keys, A and B, are made of three minhashes each. A table of the banding is
a pair (A_i, B_j), so SIDE * SIDE tables of six minhashes cost only 2 * SIDE * 3 minhash functions.
Documents that meet in a table are candidates; candidates are confirmed on their full shingle sets.

Documents with equal sets form a class and are compared as one. Candidates are first taken as a star
and a chain in each bucket, which joins most of a group with few comparisons; then all classes that
still are in different components of a bucket, and that their minhashes do not tell apart, meet with
their texts and are compared where they meet: no link between components that the tables see is
lost, and no pairs are handed on but those links. A bucket is cut into blocks of bounded size, and
pairs of blocks are groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, mix64, query, slices, staged, steps, texts

SHINGLE = 5
# At similarity 0.8 a key of three minhashes agrees with probability 0.512; one side of SIDE keys has
# none in common in 1e-5 of all cases, either side in 2e-5.
SIDE = 16
ROWS = 3
HASHES = 2 * SIDE * ROWS
PERCENT = 80
# A pair of similarity 0.8 agrees in 77 of 96 one-byte minhashes on average; below LEAST_AGREE, five
# standard deviations under that, a pair is not compared on full sets.
LEAST_AGREE = 57
# Classes of a bucket that one task holds from each of two blocks.
BLOCK = 1024
CACHE_WORDS = 150_000

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, known: Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles: size words, or the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return mix64(((h * _PLACE[: len(h)]).sum(dtype=np.uint64) ^ np.uint64(len(h))).reshape(1))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, HASHES) minhashes of 32 bits; 0 for an empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), HASHES), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.cumsum(sizes[full]) - sizes[full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(((flat ^ _XOR[k]) * _MULTIPLY[k]) >> np.uint64(32), begin)
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows of (id, text_hash, n_shingles, cls, a, short): cls names the set (null if empty), a holds
    the minhashes of collection A, short one byte of each minhash."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in (part for batch in batches for part in slices(batch)):
            data = texts(batch.column(2))
            for x, y in steps(data):
                sets = [shingles(t, known, size) for t in data[x:y]]
                sig = signatures(sets)
                a, short = sig[:, : HASHES // 2], sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(x, y - x),
                        batch.column(1).slice(x, y - x),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in np.ascontiguousarray(a)], pa.binary()),
                        pa.array([r.tobytes() for r in short], pa.binary()),
                    ],
                    names=["id", "text_hash", "n_shingles", "cls", "a", "short"],
                )

    return narrow.mapInArrow(run, "id long, text_hash long, n_shingles long, cls binary, a binary, short binary")


def _agree(one: np.ndarray, other: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Whether rows (aligned) may be near-duplicates: sizes, a common B key, and agreeing minhashes."""
    same = one == other
    tensor = same[:, HASHES // 2 :].reshape(len(same), SIDE, ROWS).all(2).any(1)
    return tensor & (same.sum(1) >= LEAST_AGREE) & (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2))


def _pairs(cls: pa.Array, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Pairs of classes by row number, the smaller first."""
    names = np.array(cls.to_pylist(), object)
    rows = {(min(x, y), max(x, y)) for x, y in zip(names[left], names[right]) if x != y}
    rows = sorted(rows)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.binary())], names=["x", "y"])


def _short(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), HASHES)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, block): each with the first of its run and with the one before it."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = 0 if carry is None else carry.num_rows
        rows = batch if carry is None else pa.Table.from_batches([*carry.to_batches(), batch]).combine_chunks().to_batches()[0]
        key = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
        begins = np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]
        first = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
        n, short = rows.column(3).to_numpy(zero_copy_only=False), _short(rows.column(4))
        at = np.flatnonzero(~begins)
        at = at[at >= fresh]
        left, right = np.concatenate([at, at]), np.concatenate([first[at], at - 1])
        for a in range(0, len(left), 1 << 16):
            x, y = left[a : a + (1 << 16)], right[a : a + (1 << 16)]
            good = _agree(short[x], short[y], n[x], n[y])
            if good.any():
                yield _pairs(rows.column(2), x[good], y[good])
        last = rows.num_rows - 1
        carry = pa.Table.from_batches([rows]).take(sorted({int(first[last]), last}))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first two columns, one batch for each run of equal values."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            name = (int(key[0][a]), int(key[1][a]))
            if held and name != now:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _crossing(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of a bucket: each that is outside the largest component, with those of other
    components that it may be a near-duplicate of. A pair counts in the first bucket it shares only."""
    _, comp, sizes = np.unique(np.array(rows.column(5).to_pylist(), "S16"), return_inverse=True, return_counts=True)
    if len(sizes) < 2:
        return
    n, short = rows.column(3).to_numpy(zero_copy_only=False), _short(rows.column(4))
    # Whole minhashes, as in the names of the buckets: bytes that agree do not mean that a pair has met.
    keys = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint32).reshape(len(short), SIDE, ROWS)
    i = int(rows.column(6)[0].as_py())
    largest = int(sizes.argmax())
    for r in np.flatnonzero(comp != largest).tolist():
        other = np.flatnonzero((comp != comp[r]) & ((comp == largest) | (np.arange(len(comp)) > r)))
        good = other[_agree(short[other], short[r : r + 1], n[other], n[r : r + 1])]
        if i and len(good):
            good = good[~(keys[good, :i] == keys[r, :i]).all(2).any(1)]
        if len(good):
            yield r, good


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each (bucket, two blocks) that may be near-duplicates across components."""
    for rows in _groups(batches):
        marked = np.zeros(rows.num_rows, bool)
        for r, others in _crossing(rows):
            marked[r] = True
            marked[others] = True
        if marked.any():
            yield rows.select([0, 1, 2]).filter(pa.array(marked))


def _link(batches: Iterator[pa.RecordBatch], size: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """The same rows with their texts: a link for each two components that the full sets join."""
    known = Words()
    for rows in _groups(batches):
        codes = [shingles(t, known, size) for t in texts(rows.column(8))]
        sizes = np.array([len(c) for c in codes])
        begin = np.cumsum(sizes) - sizes
        vocabulary, flat = np.unique(np.concatenate(codes), return_inverse=True)
        seen = np.zeros(len(vocabulary), bool)
        name = np.unique(np.array(rows.column(5).to_pylist(), "S16"), return_inverse=True)[1]
        left, right = [], []
        for r, others in _crossing(rows):
            others = others[name[others] != name[r]]
            if not len(others):
                continue
            own = flat[begin[r] : begin[r] + sizes[r]]
            seen[own] = True
            common = np.add.reduceat(seen[flat], begin, dtype=np.int64)[others]
            seen[own] = False
            near = others[100 * common >= PERCENT * (sizes[r] + sizes[others] - common)]
            for other in near.tolist():
                # What is joined once need not be joined again.
                if name[other] != name[r]:
                    left.append(r)
                    right.append(other)
                    name[name == name[other]] = name[r]
        if left:
            yield _pairs(rows.column(2), np.array(left), np.array(right))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows of (node, root) for all nodes of the edges (x, y): root is the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes; every step is a grouping with
    partial minima and a join, and is written to the shared folder.
    """
    stars = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u != v").distinct()
    stars = staged(stars, name)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("lu")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = staged(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "lu")
        small = large.join(low, F.col("u") == F.col("lu")).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        small = staged(small.filter("u != v").distinct(), name)
        if _same(stars, small):
            break
        stars = small
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _same(a: DataFrame, b: DataFrame) -> bool:
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(-1)))
    signed = F.col("s") * F.xxhash64("u", "v").cast("decimal(38,0)")
    count, mark = both.agg(F.sum("s"), F.sum(signed)).first()
    return not count and not mark


def _confirm(pairs: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets are similar enough."""
    one, other = pool.select(F.col("cls").alias("x"), F.col("text").alias("tx")), pool.select(F.col("cls").alias("y"), F.col("text").alias("ty"))
    joined = pairs.join(one, "x").join(other, "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        last: dict[bytes, np.ndarray] = {}
        for batch in (part for batch in batches for part in slices(batch)):
            keep = []
            names = [batch.column(k).to_pylist() for k in (0, 1)]
            for i, (x, y, tx, ty) in enumerate(zip(*names, texts(batch.column(2)), texts(batch.column(3)))):
                for name, text in ((x, tx), (y, ty)):
                    if name not in last:
                        if len(last) >= 64:
                            last.clear()
                        last[name] = shingles(text, known, size)
                # Both may be gone only if the cache was emptied between the two.
                a = last[x] if x in last else shingles(tx, known, size)
                b = last[y]
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "x binary, y binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """Rows of (id, n_shingles, component_id, kept), one per document.

    Shingles are runs of `shingle` words. Documents are linked where 100 times the common shingles are at least PERCENT times all shingles
    of both. component_id is the smallest id reachable over links, kept whether it is the row's own.
    Texts without words (null, empty, white space) are linked with nothing and kept. Rows that
    repeat an id have the component of their own texts. A null id is reached like any other but
    never names a component while another id is in it; alone, its component is null and it is kept.
    An empty table gives an empty table; other columns are not read.
    """
    base = staged(sketch(docs, id_col, text_col, shingle), "minhash-base")
    grouped = base.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("short").alias("short"), F.min("text_hash").alias("text_hash"))
    classes = staged(grouped, "minhash-classes")
    size = 4 * ROWS
    bucket = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.xxhash64(i, F.substring("a", i * size + 1, F.lit(size)))))
    keys = classes.select("cls", bucket.alias("i", "bucket"))
    # Written, as are the facts joined below: between two plain shuffles a busy key can be split.
    busy = staged(keys.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "minhash-busy")
    # Most keys are alone; what is compared is joined to the few that are not.
    facts = classes.select("cls", "n", "short", "text_hash")
    rows = staged(keys.join(busy, "bucket").join(facts, "cls").select("bucket", "i", "cls", "n", "short", "members", "text_hash"), "minhash-rows")
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")

    starred = rows.select("bucket", own.cast("long").alias("block"), "cls", "n", "short")
    starred = starred.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "cls")
    first = staged(starred.mapInArrow(_star, "x binary, y binary").distinct(), "minhash-pairs")

    # One text of each class that shares a bucket, for both confirmations.
    needed = rows.select("cls", F.col("text_hash").alias("_text_hash")).distinct()
    whole = docs.select(F.col(text_col).alias("text"))
    found = whole.withColumn("text_hash", F.xxhash64("text")).join(needed, F.col("text_hash") == F.col("_text_hash"))
    pool = staged(found.groupBy("cls").agg(F.first("text").alias("text")), "minhash-texts")

    links = staged(_confirm(first, pool, shingle), "minhash-links")
    roots = components(links)

    placed = rows.join(roots, F.col("cls") == F.col("node"), "left").select("bucket", "i", "cls", "n", "short", "members", F.coalesce("root", "cls").alias("comp"))
    placed = staged(placed, "minhash-placed")
    torn = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket")
    minhashes = classes.select("cls", "a")
    left = placed.join(staged(torn, "minhash-torn"), "bucket").join(minhashes, "cls")
    # A class goes to every pair of blocks that holds its own: one task per pair.
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda c: F.least(own, c).cast("long") * (1 << 31) + F.greatest(own, c))
    key = ["bucket", "blocks"]
    across = left.select("bucket", F.explode(pair).alias("blocks"), "cls", "n", "short", "comp", "i", "a")
    suspects = across.repartition(*key).sortWithinPartitions(*key).mapInArrow(_suspects, "bucket long, blocks long, cls binary")
    suspects = staged(suspects, "minhash-suspects")
    # Texts only for the few that the signatures leave open; compared where they meet.
    facts = placed.select("cls", "n", "short", "comp", "bucket", "i")
    open_ = suspects.join(facts, ["bucket", "cls"]).join(minhashes, "cls").join(pool, "cls").select(*key, "cls", "n", "short", "comp", "i", "a", "text")
    more = open_.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda rows: _link(rows, shingle), "x binary, y binary").distinct()
    star = roots.filter("node != root").select(F.col("node").alias("x"), F.col("root").alias("y"))
    final = staged(components(star.unionByName(more)), "minhash-roots")

    named = base.select("id", "n_shingles", "cls").join(final, F.col("cls") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("root", "cls").alias("comp"))
    named = staged(named, "minhash-named")
    least = named.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least")).withColumnRenamed("comp", "_comp")
    out = named.join(staged(least, "minhash-least"), F.col("comp") == F.col("_comp"), "left")
    component = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), _kept(F.col("id"), component).alias("kept"))


def _kept(own: Column, component: Column) -> Column:
    return own.eqNullSafe(component)


_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
    FROM words
), shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS MATERIALIZED (SELECT g FROM shingles GROUP BY g HAVING count(*) > 1),
counts AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
    FROM (SELECT * FROM shingles SEMI JOIN shared USING (g)) a JOIN (SELECT * FROM shingles SEMI JOIN shared USING (g)) b USING (g)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT x, y FROM counts JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least ON doc_id = x
"""


@query("op8_minhash", _SQL)
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)
