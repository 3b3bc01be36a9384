"""Operators over arriving data.

The computations are those of the batch operators; windows, watermarks and time-outs are a design
of this library. Every feed keeps state per session, tool or proposal only, never per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.compare import doc_diff
from paperloom.operators.pii import detect_pii, redact
from paperloom.operators.ranking import match
from paperloom.operators.unified import line_changes
from paperloom.operators.versions import previous_versions
from paperloom.sources.journal import journal_records

LATENESS = "10 minutes"


def journal_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Records of journal files as they arrive, each file read whole."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.text(path, wholetext=True).select(
        F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), "([^/]+)$", 1), r"\.jsonl$", "").alias("session_id"),
        F.col("value").alias("content"),
    )
    return journal_records(files)


def usage_stream(turns: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Tokens per session and time window. ``turns``: session_id, ts, input_tokens, output_tokens."""
    return (
        turns.withWatermark("ts", lateness)
        .groupBy("session_id", F.window("ts", width).alias("w"))
        .agg(
            F.sum("input_tokens").cast("bigint").alias("input_tokens"),
            F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        )
        .select("session_id", *_bounds(), "input_tokens", "output_tokens")
    )


def _bounds() -> list[Column]:
    return [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]


def thrash_stream(
    calls: DataFrame, threshold: int, width: str = "1 hour", lateness: str = LATENESS
) -> DataFrame:
    """Tools called ``threshold`` times or more by a session within a window.

    ``calls``: session_id, ts, tool (editing tools only).
    """
    return (
        calls.withWatermark("ts", lateness)
        .groupBy("session_id", F.window("ts", width).alias("w"), "tool")
        .agg(F.count("*").alias("calls"), F.min("ts").alias("first_seen"))
        .filter(F.col("calls") >= threshold)
        .select("session_id", *_bounds(), "tool", "calls", "first_seen")
    )


def pii_stream(docs: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Personal data in arriving documents, counted per type and window. ``docs``: doc_id, ts, text."""
    found = detect_pii(docs.withWatermark("ts", lateness), keep=["ts"])
    return (
        found.groupBy(F.window("ts", width).alias("w"), "type")
        .agg(F.count("*").alias("documents"), F.sum("count").cast("bigint").alias("matches"))
        .select(*_bounds(), "type", "documents", "matches")
    )


def redact_stream(docs: DataFrame) -> DataFrame:
    """Arriving documents with personal data masked; stateless."""
    return redact(docs)


def activity_stream(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions of activity: runs of events of a user without a pause of ``gap``.

    ``events``: session_id, ts, type.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy("session_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("events"), F.max_by("type", "ts").alias("last_type"))
        .select("session_id", *_bounds(), "events", "last_type")
    )


def approval_stream(events: DataFrame, timeout: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """What became of each proposal: approved, rejected, or no answer within ``timeout``.

    ``events``: proposal_id, ts, type (approval-required | approval), approved. The window of a
    proposal closes when nothing more came for ``timeout``; then its last answer counts.
    """
    answer = F.max_by(
        F.when(F.col("type") == "approval", F.col("approved")),
        F.when(F.col("type") == "approval", F.col("ts")),
    )
    return (
        events.withWatermark("ts", lateness)
        .groupBy("proposal_id", F.session_window("ts", timeout).alias("w"))
        .agg(F.count_if(F.col("type") == "approval-required").alias("asked"), answer.alias("answer"))
        .filter("asked > 0")
        .select(
            "proposal_id",
            F.col("w.start").alias("asked_at"),
            F.when(F.col("answer").isNull(), "expired")
            .when(F.col("answer"), "approved")
            .otherwise("rejected")
            .alias("outcome"),
        )
    )


def write_change_feed(batch: DataFrame, batch_id: int, store: str, feed: str, ordered: bool = True) -> None:
    """``foreachBatch`` body: new versions against the ones before them.

    ``batch``: filename, base_name, token, mtime, content. Each batch writes folders of its own and
    reads only earlier ones, so a repeated batch overwrites what it wrote before. Only the latest
    stored version of the files in the batch is read back. Without ``ordered`` moved lines count as
    unchanged, as in ``doc_diff``.
    """
    spark = batch.sparkSession
    columns = ["filename", "base_name", "token", "mtime", "content"]
    # Written first: everything after reads the written batch, not the source again.
    batch.select(*columns).write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
    everything = spark.read.parquet(store)
    heads = ["base_name", "mtime", "token", "filename", "batch_id"]
    new = everything.filter(F.col("batch_id") == batch_id).select(*heads)
    # Names only: the texts of earlier batches are not read here.
    latest = (
        everything.filter(F.col("batch_id") < batch_id)
        .join(new.select("base_name").distinct(), "base_name", "left_semi")
        .groupBy("base_name")
        .agg(F.max(F.struct("mtime", "token", "filename", "batch_id")).alias("l"))
        .select("base_name", "l.mtime", "l.token", "l.filename", "l.batch_id")
    )
    known = new.unionByName(latest)
    linked = (
        previous_versions(known.drop("batch_id"))
        .join(new.select("filename", "batch_id"), "filename")
        .join(
            known.select(F.col("filename").alias("previous"), F.col("batch_id").alias("previous_batch")),
            "previous",
        )
    )
    # Joined by batch folder as well, so only folders that hold a needed text are read.
    texts = everything.select("filename", "batch_id", "content")
    pairs = linked.join(
        texts.withColumnRenamed("content", "after"), ["filename", "batch_id"]
    ).join(
        texts.select(
            F.col("filename").alias("previous"),
            F.col("batch_id").alias("previous_batch"),
            F.col("content").alias("before"),
        ),
        ["previous", "previous_batch"],
    )
    units = lambda side: pairs.select(
        F.col("filename").alias("pair_id"), F.posexplode(F.split(side, "\n")).alias("no", "text")
    )
    found = line_changes(pairs.withColumnRenamed("filename", "pair_id")) if ordered else doc_diff(units("before"), units("after"))
    changes = found.filter("change <> 'unchanged'")
    changes.write.mode("overwrite").parquet(f"{feed}/batch_id={batch_id}")


def run_change_feed(versions: DataFrame, store: str, feed: str, checkpoint: str, ordered: bool = True) -> DataFrame:
    """Process the versions that have arrived and return the feed written so far."""
    query = (
        versions.writeStream.foreachBatch(lambda b, i: write_change_feed(b, i, store, feed, ordered))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return versions.sparkSession.read.parquet(feed).drop("batch_id")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Process what has arrived, write it to ``folder`` and return the written rows."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def with_open_windows(closed: DataFrame, whole: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """Rows a finished stream has given out, and those of windows the watermark has not passed.

    ``whole``: the feed over the same rows as a batch; ``keys``: what names a window in its rows. It
    is written to ``folder`` first: an anti-join must not move below the merging of session windows.
    """
    whole.write.parquet(folder)
    whole = whole.sparkSession.read.schema(whole.schema).parquet(folder)
    return closed.unionByName(match(whole, closed.select(*keys), keys, "left_anti"))
