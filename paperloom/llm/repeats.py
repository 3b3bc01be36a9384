"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every byte position starts a suffix; two suffixes of one group after a sort to depth `length` start
the same window of that many bytes. The sort goes by digits, most significant first, and a suffix
that is alone in its group leaves it, so that equal groups at full depth are exactly the repeated
windows. Suffixes travel together where they can:

1. Each window has an anchor, the place of the smallest hash of eight bytes among its first WIDTH
   positions. It depends on the window's bytes alone, so equal windows have it at the same distance,
   and a run of neighbouring starts shares one. The first digit is the part right of the anchor that
   every window of the run holds; runs that are alone with theirs leave.
2. The second digit is all that the windows of a run cover. Runs with an equal second digit are equal
   from the first window to the last: all of them are repeated.
3. Where a first digit has several second digits, runs are cut into sixteen starts; the third digit is
   what these share, and who is alone leaves.
4. The last digit is the window itself, one suffix each.

Windows are counted in bytes or in words; for words, a text is the sequence of their codes.
Digits are 64-bit hashes within the group of the digits before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, query, slices, staged, texts, with_fields

LENGTH = 400
# Bytes of the code of a word.
CODE = 4
CACHE_WORDS = 150_000
SPACES = b" \t\n\x0b\x0c\r"
# Groups that the copies of one text are dealt to.
SALTS = 8
WIDTH = 200
GRAM = 8
PART = 16
# Starts handled at a time; also the largest place that fits beside a hash of 40 bits.
CHUNK = 1 << 22
# A suffix run as one number: check of the text (16 bits), anchor (31), nearest and farthest start.
CHECK_BITS = 16


def _width(length: int) -> int:
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    return min(WIDTH, length // 2)


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and last start of every run of windows in a text's bytes."""
    width = _width(length)
    found = []
    starts = len(text) - length + 1
    for base in range(0, max(starts, 0), CHUNK):
        n = min(CHUNK, starts - base)
        x = text[base : base + n + width + GRAM - 2].astype(np.uint64)
        x = x[:-1] | (x[1:] << np.uint64(8))
        x = x[:-2] | (x[2:] << np.uint64(16))
        x = x[:-4] | (x[4:] << np.uint64(32))
        h = ((x * np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        low = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        # Sliding minimum: over 1, 2, 4 ... positions, then over all of them.
        seen = 1
        while 2 * seen <= width:
            low = np.minimum(low[:-seen], low[seen:])
            seen *= 2
        if seen < width:
            low = np.minimum(low[: len(low) - (width - seen)], low[width - seen :])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)[:n]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        found.append((base + at[first], base + first, base + np.r_[first[1:] - 1, n - 1]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def pack(check: int, place: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return (np.int64(check) << np.int64(47)) | (place << 16) | (near << 8) | far


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (packed >> 47) & 0xFFFF, (packed >> 16) & 0x7FFFFFFF, (packed >> 8) & 0xFF, packed & 0xFF


def _runs(length: int):
    """Text -> (k1, k2, run): first and second digit of each run of windows."""
    h = xxhash.xxh3_64_intdigest
    body = length - _width(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            names, checks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            k1, k2, owner, packed = [], [], [], []
            for name, check, text in zip(names, checks, texts(batch.column(2))):
                if len(text) < length:
                    continue
                at, first, last = anchors(np.frombuffer(text, np.uint8), length)
                k1 += [h(text[a : a + body]) for a in at.tolist()]
                k2 += [h(text[p : q + length], (a - q) << 8 | (a - p)) for a, p, q in zip(at.tolist(), first.tolist(), last.tolist())]
                owner.append(np.full(len(at), name))
                packed.append(pack(int(check), at, at - last, at - first))
            if k1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)] + [pa.array(np.concatenate(c)) for c in (owner, packed)], names=["k1", "k2", "owner", "run"]
                )

    return run


def _parts(length: int):
    """Text and its open runs -> (k3, part): third digit of up to PART starts."""
    h = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            k3, owner, packed = [], [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist())
            for name, check, text, runs in rows:
                checks, place, near, far = (c.tolist() for c in unpack(np.array([r["run"] for r in runs], np.int64)))
                for c, a, t1, t2, k1 in zip(checks, place, near, far, [r["k1"] for r in runs]):
                    if c != check:
                        continue
                    for j in range(t1 // PART, t2 // PART + 1):
                        low = a - PART * j
                        k3.append(h(text[max(low, 0) : low - (PART - 1) + length], (k1 & 0xFFFFFFFFFFFF) << 8 | j))
                        owner.append(name)
                        packed.append((c << 47) | (a << 16) | (max(t1, PART * j) << 8) | min(t2, PART * j + PART - 1))
            if k3:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(k3, np.uint64).view(np.int64)), pa.array(owner, pa.int64()), pa.array(packed, pa.int64())], names=["k3", "owner", "part"])

    return run


def _windows(length: int):
    """Text and its open parts -> (k4, start): the windows themselves, packed as runs of one start."""
    h = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 64)):
            k4, owner, packed = [], [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist())
            for name, check, text, parts in rows:
                checks, place, near, far = (c.tolist() for c in unpack(np.array([p["part"] for p in parts], np.int64)))
                for c, a, t1, t2, k3 in zip(checks, place, near, far, [p["k3"] for p in parts]):
                    if c == check:
                        for t in range(t1, t2 + 1):
                            k4.append(h(text[a - t : a - t + length], (k3 & 0xFFFFFFFFFFFF) << 8 | t))
                            packed.append((c << 47) | (a << 16) | (t << 8) | t)
                        owner += [name] * (t2 - t1 + 1)
            if k4:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(k4, np.uint64).view(np.int64)), pa.array(owner, pa.int64()), pa.array(packed, pa.int64())], names=["k4", "owner", "run"])

    return run


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once; counted per task first, so a frequent key is cheap.

    The keys are written: between two plain shuffles the rows of a frequent key can be split.
    """
    twice = staged(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), "repeats-keys")
    return rows.join(twice, key, "left_semi")


def repeated_runs(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of (owner, runs) from rows of (owner, check, text): starts of repeated windows by text."""
    runs = keyed.mapInArrow(_runs(length), "k1 long, k2 long, owner long, run long")
    runs = staged(_repeated(runs, "k1"), "repeats-runs")
    classes = staged(
        runs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("owner", "run")).alias("one")).select("k1", "k2", "n", "one.*"), "repeats-classes"
    )
    whole = runs.join(classes.filter("n > 1").select("k1", "k2"), ["k1", "k2"], "left_semi").select("owner", "run")

    several = staged(classes.groupBy("k1").agg(F.count("*").alias("m")).filter("m > 1").select("k1"), "repeats-keys")
    open_ = classes.join(several, "k1", "left_semi").groupBy("owner").agg(F.collect_list(F.struct("k1", "run")).alias("runs"))
    open_ = staged(open_, "repeats-open")
    # One row per text, whatever the number of its copies: they are dealt by where they are read, and
    # one of each group goes on.
    salted = keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    wanted = open_.select("owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    few = salted.join(wanted, ["owner", "_salt"], "left_semi").dropDuplicates(["owner", "_salt"])
    one = few.drop("_salt").dropDuplicates(["owner"])
    work = staged(one.join(open_, "owner").select("owner", "check", "text", "runs"), "repeats-texts")
    parts = staged(work.mapInArrow(_parts(length), "k3 long, owner long, part long"), "repeats-parts")
    going = _repeated(parts, "k3").groupBy("owner").agg(F.collect_list(F.struct("k3", "part")).alias("parts"))
    single = work.select("owner", "check", "text").join(going, "owner").mapInArrow(_windows(length), "k4 long, owner long, run long")
    single = _repeated(staged(single, "repeats-windows"), "k4").select("owner", "run")
    return whole.unionByName(single).distinct().groupBy("owner").agg(F.collect_list("run").alias("runs"))


def spans_of(check: int, runs: list[int], length: int = LENGTH) -> np.ndarray:
    """Maximal covered byte ranges (start, end), from the runs of a text."""
    checks, place, near, far = unpack(np.array(runs, np.int64))
    mine = checks == check
    start, end = (place - far)[mine], (place - near)[mine] + length
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    begins = np.r_[True, start[1:] > end[:-1]]
    return np.stack([start[begins], end[np.r_[np.flatnonzero(begins)[1:] - 1, len(end) - 1]]], 1)


class Codes(dict):
    """Word -> code of 32 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word) >> 32
        return code


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, check, text) with the codes of the words in place of the text."""
    known = Codes()
    for batch in (part for batch in batches for part in slices(batch)):
        words = [x.split() for x in texts(batch.column(2))]
        codes = [np.fromiter(map(known.__getitem__, w), np.uint32, len(w)).tobytes() for w in words]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.binary())], names=["owner", "check", "text"])


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    space = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(SPACES, np.uint8))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_spans(text: bytes, check: int, runs: list[int], words: int) -> np.ndarray:
    """Maximal covered byte ranges (start, end), from the runs of a text's codes."""
    checks, place, near, far = unpack(np.array(runs, np.int64))
    mine = checks == check
    # Windows that begin with a word, not inside a code.
    first, last = -(-(place - far)[mine] // CODE), (place - near)[mine] // CODE
    whole = first <= last
    if not whole.any():
        return np.zeros((0, 2), np.int64)
    first, last = first[whole], last[whole] + words
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order])
    begins = np.r_[True, start[1:] > end[:-1]]
    begin, stop = word_places(text)
    return np.stack([begin[start[begins]], stop[end[np.r_[np.flatnonzero(begins)[1:] - 1, len(end) - 1]] - 1]], 1)


def whole_characters(text: bytes, spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans drawn in to characters that they cover whole, for texts that must stay UTF-8."""
    out = []
    for a, b in spans.tolist():
        while a < b and 0x80 <= text[a] < 0xC0:
            a += 1
        while b > a and b < len(text) and 0x80 <= text[b] < 0xC0:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    characters: bool = False,
    words: int | None = None,
) -> DataFrame:
    """Rows of (id, *keep, n_bytes, n_removed, spans, kept_bytes), one per document.

    Every byte in a window of `length` bytes that starts at another place too, in this or another
    document, is removed; windows lie within one document and may overlap; repeats are judged on the
    texts as given. spans lists starts and ends of the maximal removed runs in turn, kept_bytes is
    what is left. With characters, a character goes only if all its bytes go.

    With words, a window is that many words instead, whatever white space is between them, and a run
    is removed from its first word to the end of its last. Words are compared by 32-bit codes: two
    windows count as equal if they differ in words whose codes agree, one in 2^32 a word.

    Null and empty texts have nothing to remove; texts shorter than a window are kept; rows that
    repeat a text lose it, as does every copy; null ids are rows like others; an empty table gives an
    empty table; columns of docs that are not in keep are not read.
    """
    kept = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    check = F.hash("_rep_text").bitwiseAND((1 << CHECK_BITS) - 1).cast("int")
    plain = docs.select(*kept, F.col(text_col).alias("_rep_text"))
    owner = F.xxhash64("_rep_text")
    keyed = plain.select(owner.alias("owner"), check.alias("check"), F.col("_rep_text").alias("text"))
    if words is not None:
        length = CODE * words
        # A window has a byte for each word at least.
        keyed = staged(keyed.filter(F.octet_length("text") >= words).mapInArrow(_coded, "owner long, check int, text binary"), "repeats-codes")
    keyed = keyed.filter(F.octet_length("text") >= length)
    runs = staged(repeated_runs(keyed, length), "repeats-found").select(F.col("owner").alias("_rep_owner"), F.col("runs").alias("_rep_runs"))
    joined = plain.withColumn("_rep_check", check).join(runs, owner == F.col("_rep_owner"), "left").drop("_rep_owner")
    names = [c for c in plain.columns if c != "_rep_text"]
    joined = joined.select(*names, "_rep_text", "_rep_check", "_rep_runs")
    schema = with_fields(plain.drop("_rep_text").schema, "n_bytes long, n_removed long, spans array<long>, kept_bytes binary")

    def spans_in(text: bytes, check_: int, found: list[int]) -> list:
        if words is not None:
            return word_spans(text, check_, found, words).tolist()
        cut = spans_of(check_, found, length)
        return whole_characters(text, cut) if characters else cut.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            k = len(names)
            sizes, removed, spans, left = [], [], [], []
            for text, check_, found in zip(texts(batch.column(k)), batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist()):
                cut = spans_in(text, check_, found) if found else []
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in cut))
                spans.append([x for pair in cut for x in pair])
                edges = [0, *spans[-1], len(text)]
                left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], names=[*names, "n_bytes", "n_removed", "spans", "kept_bytes"])

    return joined.mapInArrow(run, schema)


@query("op7_repeated_passages")
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
