"""Quality rules with host-level verdicts.

Documents are measured one by one; the failures of the base rule are summed per host (the source of
a document), each host's failure rate is shrunk towards the corpus by a beta prior fitted to all
hosts, and hosts whose shrunk rate is too high take their documents with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, query, slices, staged, texts, with_fields

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A host falls when more than this share of its documents is expected to fail.
MAX_HOST_RATE = 0.5
# Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of size words found at least twice in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    # Windows numbered exactly: each pass ranks (rank so far, next word).
    rank = ids[:n]
    for k in range(1, size):
        _, rank = np.unique(rank * np.uint64(len(number)) + ids[k : n + k], return_inverse=True)
        rank = rank.astype(np.uint64)
    twice = np.bincount(rank.astype(np.int64))[rank.astype(np.int64)] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[size : n + size] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure_text(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    # Code points in words: bytes of words that begin a character.
    plain = text.translate(None, SPACES + bytes(range(0x80, 0xC0)))
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), len(plain), len(plain) - len(plain.translate(None, SYMBOLS)), repeats, repeated_words(words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (id, *keep, measures of the whole text, base_failed)."""
    kept = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    narrow = docs.select(*kept, F.col(text_col).alias("_rule_text"))
    schema = with_fields(narrow.drop("_rule_text").schema, ", ".join(f"{m} long" for m in MEASURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            rows = [measure_text(x) for x in texts(batch.column(batch.num_columns - 1))]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *MEASURES])

    return narrow.mapInArrow(run, schema).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def host_verdicts(measured: DataFrame, host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows of (host, host_docs, host_failed, host_rate, host_kept); one row per host, null a host of its own.

    The prior has the corpus' mean rate m; its weight comes from the moments of the hosts' rates:
    with spread v beyond what m alone explains, weight = m (1 - m) / v - 1, kept within PRIOR_WEIGHT.
    """
    hosts = measured.groupBy(host_col).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    n, k = F.col("host_docs"), F.col("host_failed")
    rate = k / n
    sums = hosts.agg(F.sum(n).alias("_n"), F.sum(k).alias("_k"), F.count("*").alias("_h"), F.sum(rate * rate * n).alias("_r2"))
    # One row; from here on numbers of the whole corpus.
    total = sums.first()
    mean, weight = 0.0, PRIOR_WEIGHT[1]
    if total["_n"]:
        mean = total["_k"] / total["_n"]
        # Between-host variance, weighted by size: what is seen less what binomial noise gives.
        spread = total["_r2"] / total["_n"] - mean * mean - mean * (1 - mean) * total["_h"] / total["_n"]
        if spread > 0:
            weight = min(max(mean * (1 - mean) / spread - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    shrunk = (k + mean * weight) / (n + weight)
    return hosts.select(host_col, "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_kept"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows of (id, host, measures, base_failed, host_rate, kept), one per document.

    kept is false for a document that fails the base rule and for all documents of a host whose
    shrunk failure rate is over max_rate. Null and empty texts have no words and fail. A null host is
    a host like others; null ids and repeated rows are documents like others; an empty table gives an
    empty table; columns besides the three named are not read.
    """
    measured = staged(measure(docs, id_col, text_col, (host_col,)), "rules")
    hosts = staged(host_verdicts(measured, host_col, max_rate), "rules-hosts").withColumnRenamed(host_col, "_host")
    joined = measured.join(hosts, F.col(host_col).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


# The documents of the query, measured in SQL: words by position, windows by five words in a row.
_SQL = """
WITH words AS (
    SELECT rowid AS r, doc_id, source, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
    FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), placed AS (
    SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM words
), windows AS (
    SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g
    FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)
), counted AS (
    SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM windows
), covered AS (
    SELECT r, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM counted
), repeats AS (
    SELECT r, count(*) FILTER (inside) AS n FROM covered GROUP BY r
), lines AS (
    SELECT r, sum(n - 1) AS n FROM (
        SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line
    ) GROUP BY r
), measured AS (
    SELECT doc_id, source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
        len(words) < 10 OR 100 * coalesce(repeats.n, 0) > 20 * len(words) AS base_failed
    FROM words LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), hosts AS (
    SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS k FROM measured GROUP BY source
), moments AS (
    SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS r2, count(*) / sum(n) AS h FROM hosts
), prior AS (
    SELECT m, CASE WHEN r2 - m * m - m * (1 - m) * h > 0
        THEN least(greatest(m * (1 - m) / (r2 - m * m - m * (1 - m) * h) - 1, 1.0), 1e6) ELSE 1e6 END AS w FROM moments
), verdicts AS (
    SELECT source, (k + m * w) / (n + w) <= 0.5 AS ok FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM measured JOIN verdicts ON measured.source IS NOT DISTINCT FROM verdicts.source
"""


@query("op9_host_rules", _SQL)
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = apply_rules(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return ruled.select("doc_id", *MEASURES, "base_failed", "kept")
