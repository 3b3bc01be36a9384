"""Byte-level BPE: pre-tokens by transition-function scans, cached pair merging, exact decoding.

The pre-token pattern is read as a finite-state machine over code-point classes. One character is a
function from state to state; such functions compose associatively, so a text is cut into blocks,
each block is reduced to one function for all entry states at once, the block functions are scanned,
and a last pass marks where pre-tokens begin. No regular expression runs over the text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, query, slices, steps, texts, with_fields

RANKS = "byte_bpe_50k.tiktoken"
# Pieces whose ids are remembered per worker; the cache starts anew when it is full.
CACHE_PIECES = 150_000
LOCKSTEP = 48
NO_PAIR = 1 << 40
BLOCK = 256

# White_Space of Unicode, as \s matches it.
SPACES = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)
# Symbols: classes with what the next characters decide. SHORT and LONG are an apostrophe before a
# contraction of one letter (s t m d) or two (re ve ll); JOINS is a space before a non-space, LAST
# another white space before a non-space, INNER white space before white space or the end.
S_LETTER, S_NUMBER, S_OTHER, SHORT, LONG, JOINS, LAST, INNER, S_END = range(9)
# States: what the pre-token under way has seen. FRESH: the next character begins one.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PENDING, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables [symbol * STATES + state]: next state, and whether a pre-token begins here."""
    move = np.zeros((9, STATES), np.uint8)
    begins = np.ones((9, STATES), bool)
    for symbol, inside in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        move[symbol] = inside
        begins[symbol, [inside, PENDING]] = False
    move[S_LETTER, [TWO_LEFT, ONE_LEFT]] = ONE_LEFT, FRESH
    begins[S_LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        move[symbol] = left
        move[symbol, [IN_OTHERS, PENDING]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, PENDING]] = False
    move[JOINS], move[LAST], move[INNER], move[S_END] = PENDING, FRESH, IN_WHITE, FRESH
    begins[INNER, IN_WHITE] = False
    return move.ravel(), begins.ravel()


MOVE, BEGINS = _machine()


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000 + 1, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[list(SPACES)] = WHITE
    table[0x20] = SPACE
    table[0x110000] = END
    return table


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point; 0x110000 ends a text and is the last code."""
    kind = _classes()[codes]
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, JOINS, LAST, S_END], np.uint8)[kind]
    white = np.flatnonzero((kind == SPACE) | (kind == WHITE))
    after = kind[white + 1]
    out[white[(after == SPACE) | (after == WHITE) | (after == END)]] = INNER
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        first, second = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.isin(first * 256 + second % 256 + (second > 255) * 10**7, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        out[quote[one]] = SHORT
        out[quote[two]] = LONG
    return out


def pretoken_starts(codes: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point (true at text ends as well)."""
    n = len(codes)
    blocks = -(-n // BLOCK)
    symbols = np.full(blocks * BLOCK, S_END, np.int16)
    symbols[:n] = _symbols(codes)
    at = np.ascontiguousarray(symbols.reshape(blocks, BLOCK).T) * np.int16(STATES)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for row in at:
        whole = MOVE[row[:, None] + whole]
    # Scan of the block functions: after step d, whole[b] covers the 2d blocks up to b.
    d = 1
    while d < blocks:
        whole[d:] = np.take_along_axis(whole[d:], whole[:-d].copy(), axis=1)
        d *= 2
    state = np.full(blocks, FRESH, np.uint8)
    state[1:] = whole[:-1, FRESH]
    begins = np.empty((BLOCK, blocks), bool)
    for t, row in enumerate(at):
        index = row + state
        begins[t] = BEGINS[index]
        state = MOVE[index]
    return begins.T.reshape(-1)[:n]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the pair of lowest rank, leftmost first, until none is in the ranks: O(n log n)."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ends = list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        # Stale when either part has changed since the pair was seen.
        if not alive[i] or j >= n or ends[j] != end or ends[i] != j:
            continue
        alive[j] = False
        ends[i] = end
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            rank = ranks.get(piece[i : ends[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[after[i]]))
        if before[i] >= 0:
            rank = ranks.get(piece[before[i] : end])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class Pieces(dict):
    """Ids of a piece as packed unsigned 32-bit integers; new pieces of a step are merged together.

    Pieces up to LOCKSTEP bytes are the rows of one matrix of ids: each round joins the pair of
    lowest rank in every row at once. Longer ones go through merge().
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__({b"": b""})
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        pairs = {
            (ranks[t[:k]] << 32) + ranks[t[k:]]: rank
            for t, rank in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.joined[at], NO_PAIR)

    def add(self, pieces: list[bytes]) -> None:
        """Learn what of these is not known; the cache starts anew where it would overflow."""
        new = set(pieces) - self.keys()
        if new and len(self) + len(new) > CACHE_PIECES:
            self.clear()
            self[b""] = b""
            new = set(pieces) - self.keys()
        short = []
        for piece in new:
            rank = self.ranks.get(piece)
            if rank is not None:
                self[piece] = rank.to_bytes(4, "little")
            elif len(piece) <= LOCKSTEP:
                short.append(piece)
            else:
                self[piece] = np.array(merge(piece, self.ranks), "<u4").tobytes()
        short.sort(key=len)
        for a in range(0, len(short), 4096):
            self._lockstep(short[a : a + 4096])

    def _lockstep(self, pieces: list[bytes]) -> None:
        sizes = np.array([len(p) for p in pieces])
        wide = int(sizes.max())
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(len(pieces), wide)
        columns = np.arange(wide)
        ids = np.where(columns < sizes[:, None], self.single[raw], -1)
        ids = np.hstack([ids, np.full((len(pieces), 1), -1)])
        low = self.rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        left = ids.copy()
        live = rows
        while len(live):
            at = low.argmin(1)
            best = low[np.arange(len(live)), at]
            going = best < NO_PAIR
            if not going.all():
                left[live[~going]] = ids[~going]
                live, ids, low, at, best = live[going], ids[going], low[going], at[going], best[going]
                if not len(live):
                    break
            here = np.arange(len(live))
            shift = columns[None, :] > at[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            low[:, :-1] = np.where(shift[:, :-1], low[:, 1:], low[:, :-1])
            low[:, -1] = NO_PAIR
            ids[here, at] = best
            low[here, at] = self.rank(best, ids[here, at + 1])
            before = np.flatnonzero(at > 0)
            low[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], best[before])
        for piece, row, n in zip(pieces, left.astype("<u4"), (left >= 0).sum(1).tolist()):
            self[piece] = row[:n].tobytes()


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


@lru_cache(4)
def _pieces(path: str) -> Pieces:
    return Pieces(read_ranks(path))


@lru_cache(4)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, where each begins, and its length; by id."""
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], lengths.cumsum()[:-1]]), lengths


def _code_points(data: list[bytes]) -> np.ndarray:
    """Code points of texts, 0x110000 after each; bytes that are no UTF-8 stand for themselves."""
    ends = np.array([0x110000], "<u4").tobytes()
    return np.frombuffer(
        b"".join(x.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass") + ends for x in data), "<u4"
    )


def encode_texts(data: list[bytes], path: str) -> list[tuple[bytes, bytes]]:
    """For each text its ids and the byte offset of each token, both packed unsigned 32-bit."""
    pieces = _pieces(path)
    lengths = _vocabulary(path)[2]
    codes = _code_points(data)
    begins = pretoken_starts(codes)
    width = np.ones(len(codes), np.int64)
    width += codes >= 0x80
    width += codes >= 0x800
    width += codes >= 0x10000
    width[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    ends = codes == 0x110000
    width[ends] = 0
    offset = np.cumsum(width) - width
    blob = b"".join(data)
    marks = np.flatnonzero(begins | ends)
    cuts = offset[marks].tolist()
    slices = [blob[a:b] for a, b in zip(cuts, cuts[1:])]
    pieces.add(slices)
    packed = list(map(pieces.__getitem__, slices)) if slices else []
    last = np.flatnonzero(ends[marks]).tolist()
    out, start = [], 0
    for end in last:
        ids = b"".join(packed[start:end])
        size = lengths[np.frombuffer(ids, "<u4")]
        out.append((ids, (np.cumsum(size) - size).astype("<u4").tobytes()))
        start = end + 1
    return out


def decode_ids(ids: bytes, offsets: bytes, path: str) -> bytes:
    """Put each token's bytes at its offset."""
    blob, begin, lengths = _vocabulary(path)
    tokens = np.frombuffer(ids, "<u4")
    if not len(tokens):
        return b""
    size = lengths[tokens]
    place = np.frombuffer(offsets, "<u4").astype(np.int64)
    total = int(place[-1] + size[-1])
    within = np.arange(total) - np.repeat(place, size)
    return blob[np.repeat(begin[tokens], size) + within].tobytes()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (id, *keep, ids, offsets): a whole text as token ids, with each token's byte offset.

    ids and offsets are packed little-endian unsigned 32-bit integers. Null and empty texts give
    empty ids. Null ids, repeated rows and texts of any length are encoded like all others; an empty
    table gives an empty table. Columns of docs that are not in keep are not read. Bytes that are no
    UTF-8 count as single characters that are neither letter, number nor space.
    """
    path = path or public_tokenizers.path(RANKS)
    narrow = _narrow(docs, id_col, text_col, keep)
    schema = with_fields(narrow.drop("_bpe_text").schema, "ids binary, offsets binary")
    return narrow.mapInArrow(_encoder(path), schema)


def _narrow(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    kept = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    return docs.select(*kept, F.col(text_col).alias("_bpe_text"))


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            data = texts(batch.column(batch.num_columns - 1))
            for a, b in steps(data):
                done = encode_texts(data[a:b], path)
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                columns += [pa.array([x[k] for x in done], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "ids", "offsets"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add `decoded` (binary) to rows of encode(); null or empty ids decode to no bytes."""
    path = path or public_tokenizers.path(RANKS)
    return encoded.mapInArrow(_decoder(path), with_fields(encoded.schema, "decoded binary"))


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            ids, offsets = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "offsets"))
            done = pa.array([decode_ids(x or b"", y or b"", path) for x, y in zip(ids, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, done], names=[*batch.schema.names, "decoded"])

    return run


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """decode(encode(docs)) in one pass: the ids go to the decoder without leaving the worker."""
    path = path or public_tokenizers.path(RANKS)
    narrow = _narrow(docs, id_col, text_col, keep)
    schema = with_fields(narrow.drop("_bpe_text").schema, "ids binary, offsets binary, decoded binary")
    encoder, decoder = _encoder(path), _decoder(path)
    return narrow.mapInArrow(lambda batches: decoder(encoder(batches)), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode, and sum up both as digests."""
    return round_trip(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents", "doc_id", "text"))
