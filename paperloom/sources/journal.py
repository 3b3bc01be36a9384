"""Session journals: JSON lines {v, ts, type, data}, one file per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.arrays import let
from paperloom.functions.text import clip, is_blank, trim_ws

RECORD = "v INT, ts STRING, type STRING, data STRING"
PREVIEW_LENGTH = 60


def read_journal_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per journal file: session_id, mtime, content.

    A journal is append-only text of one session; reading it whole keeps its line order without
    a shuffle, and many files make many tasks.
    """
    return (
        spark.read.text(path, wholetext=True)
        .select(
            F.regexp_replace(
                F.regexp_extract(F.col("_metadata.file_name"), "([^/]+)$", 1), r"\.jsonl$", ""
            ).alias("session_id"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            F.col("value").alias("content"),
        )
    )


def record_of(line: Column) -> Column:
    """The record of a line; its type is null if the line is no JSON object."""
    return F.from_json(line, RECORD)


def record_columns(record: str) -> list[Column]:
    """Columns of a numbered record."""
    return [
        F.col(f"{record}.line_no"),
        F.col(f"{record}.r.v"),
        F.col(f"{record}.r.ts").try_cast("timestamp").alias("ts"),
        F.col(f"{record}.r.type"),
        F.col(f"{record}.r.data"),
    ]


def _records(content: Column) -> Column:
    """Parsed lines; a line that is no JSON object has a null type."""
    numbered = F.transform(
        F.split(content, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))
    )
    return F.transform(
        F.filter(numbered, lambda s: ~is_blank(s["line"])),
        lambda s: F.struct(s["line_no"].alias("line_no"), record_of(s["line"]).alias("r")),
    )


def _valid(files: DataFrame) -> DataFrame:
    """Files whose first line is a meta record."""
    return files.withColumn("_rs", let(_records(F.col("content")), lambda r: r)).filter(
        F.get(F.col("_rs"), F.lit(0))["r"]["type"] == "meta"
    )


def journal_records(files: DataFrame) -> DataFrame:
    """Records of every valid session; broken lines are dropped."""
    kept = F.filter(F.col("_rs"), lambda x: x["r"]["type"].isNotNull())
    return _valid(files).select("session_id", F.explode(kept).alias("x")).select(
        "session_id", *record_columns("x")
    )


def replay(records: DataFrame) -> DataFrame:
    """What is played back: user and assistant records. The rest is kept for audit only."""
    return records.filter(F.col("type").isin("user", "assistant"))


def content_text(data: Column) -> Column:
    """Text of a message: its string content, or the first text part of a list."""
    v = F.try_parse_json(data)
    parts = F.try_variant_get(v, "$.content", "array<variant>")
    texts = F.filter(
        F.transform(
            parts,
            lambda p: F.when(
                F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string")
            ),
        ),
        lambda t: t.isNotNull(),
    )
    return F.when(parts.isNull(), F.try_variant_get(v, "$.content", "string")).otherwise(
        F.get(texts, F.lit(0))
    )


def session_list(files: DataFrame) -> DataFrame:
    """Each valid session with its meta data and a preview of the first user message."""
    first_user = F.get(F.filter(F.col("_rs"), lambda x: x["r"]["type"] == "user"), F.lit(0))
    text = trim_ws(F.replace(content_text(first_user["r"]["data"]), F.lit("\n"), F.lit(" ")))
    return _valid(files).select(
        "session_id",
        "mtime",
        F.get(F.col("_rs"), F.lit(0))["r"]["data"].alias("meta"),
        F.nullif(clip(text, PREVIEW_LENGTH), F.lit("")).alias("preview"),
    )


def latest_session(files: DataFrame) -> DataFrame:
    return session_list(files).orderBy(F.desc("mtime"), F.desc("session_id")).limit(1)
