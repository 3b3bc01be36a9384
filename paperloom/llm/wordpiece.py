"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link (where matching goes on when no child fits)
and the number of pieces that are given off on that way, both worked out once. A word is then read
character by character: greedy longest-match pieces are counted without any of them being built.
All new words of a step walk the automaton together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.bpe import RANKS, read_ranks
from paperloom.llm.common import load, query, slices, steps, texts, with_fields

# Words whose counts are remembered per worker; the cache starts anew when it is full.
CACHE_WORDS = 250_000
# What stands before a word: pieces that begin with it are word-initial, all others continue.
INITIAL = b" "


class Automaton:
    """Trie of byte pieces with failure links; `edges` are sorted (node << 8) + byte."""

    def __init__(self, vocabulary: list[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                step = child[node].get(byte)
                if step is None:
                    step = child[node][byte] = len(child)
                    child.append({})
                    final.append(False)
                node = step
            final[node] = bool(piece)
        # Breadth first: a link leads to a node of smaller depth.
        fail, popped = [-1] * len(child), [0] * len(child)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, step in child[node].items():
                    below.append(step)
                    if final[step]:
                        fail[step], popped[step] = 0, 1
                        continue
                    link, count = fail[node], popped[node]
                    while link >= 0 and byte not in child[link]:
                        count += popped[link]
                        link = fail[link]
                    if link >= 0:
                        fail[step], popped[step] = child[link][byte], count
            level = below
        edges = sorted((node << 8 | byte, step) for node, steps_ in enumerate(child) for byte, step in steps_.items())
        self.edges = np.array([e for e, _ in edges] or [-1], np.int64)
        self.steps = np.array([s for _, s in edges] or [-1], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = (node << 8) | byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.steps[at], -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; 1 (an unknown token) where no pieces cover it, 0 for no word."""
        if not words:
            return np.zeros(0, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        blob = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        count = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)
        lost = np.zeros(len(words), bool)
        # Longest first, so that the words that still have a byte t are a prefix.
        order = np.argsort(-sizes, kind="stable")
        down = -sizes[order]
        for t in range(int(sizes.max())):
            live = order[: np.searchsorted(down, -t)]
            live = live[~lost[live]]
            byte = blob[begin[live] + t].astype(np.int64)
            while len(live):
                step = self._child(node[live], byte)
                fits = step >= 0
                node[live[fits]] = step[fits]
                live, byte = live[~fits], byte[~fits]
                live, byte = self._fall(live, byte, node, count, lost)
        live = np.flatnonzero((node > 0) & ~lost)
        while len(live):
            live, _ = self._fall(live, live, node, count, lost)
            live = live[node[live] > 0]
        count[lost] = 1
        return count

    def _fall(self, live, byte, node, count, lost):
        """Follow the failure links of these words, counting what is given off."""
        link = self.fail[node[live]]
        lost[live[link < 0]] = True
        good = link >= 0
        live = live[good]
        count[live] += self.popped[node[live]]
        node[live] = link[good]
        return live, byte[good]


class Counts(dict):
    """Piece counts of words, each walked once per worker."""

    def __init__(self, path: str):
        super().__init__()
        self.automaton = Automaton(list(read_ranks(path)))

    def add(self, words: set[bytes]) -> None:
        new = words - self.keys()
        if new and len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = words
        fresh = list(new)
        self.update(zip(fresh, self.automaton.counts([INITIAL + w for w in fresh]).tolist()))


@lru_cache(4)
def _counts(path: str) -> Counts:
    return Counts(path)


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id, n_words, n_tokens): words of the whole text, and their greedy longest-match pieces.

    Words are runs of anything but the six ASCII white-space characters; each is matched with one
    space before it, so vocabulary entries that begin with a space are word-initial pieces and all
    others continuation pieces. A word that no pieces cover is one unknown token. Null and empty
    texts count 0 and 0; null ids and repeated rows are rows like all others; an empty table gives an
    empty table; columns besides the two named are not read.
    """
    path = path or public_tokenizers.path(RANKS)
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("_count_text"))
    schema = with_fields(narrow.drop("_count_text").schema, "n_words long, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(path)
        for batch in (part for batch in batches for part in slices(batch)):
            data = texts(batch.column(1))
            n_words, n_tokens = [], []
            for a, b in steps(data):
                words = [x.split() for x in data[a:b]]
                known.add(set().union(*words))
                n_words += map(len, words)
                n_tokens += [sum(map(known.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"]
            )

    return narrow.mapInArrow(run, schema)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents", "doc_id", "text"))
