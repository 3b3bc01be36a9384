"""Streams over whole tables, run to their end and read back.

A window comes out once the watermark (latest event less 10 minutes) has passed its end; the windows
still open at the end of the table are finished by a batch pass over the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans import derived as d
from paperloom.plans.compare import diff_sql
from paperloom.plans.pii import hits_sql
from paperloom.plans.registry import SQL, query
from paperloom.plans.sources import journals as journal_files
from paperloom.session import shared_folder
from paperloom.sources.journal import content_text
from paperloom.sources.tables import load
from paperloom.streaming import approvals, feeds, journals


def _stream(spark, sf_dir, table):
    schema = load(spark, sf_dir, table).schema
    # A pattern, since a stream takes a plain path for a folder; it fits a file and a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _run(spark, sf_dir, table, prepare, feed, keys, name):
    """All windows of a feed over a whole table, times without a zone."""
    folder = shared_folder(spark, name)
    closed = feeds.run_to_table(feed(prepare(_stream(spark, sf_dir, table))), folder)
    rows = feeds.with_open_windows(closed, feed(prepare(load(spark, sf_dir, table))), keys, f"{folder}/whole")
    times = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp"]
    return rows.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times}) if times else rows


def _ts():
    return F.col("ts").cast("timestamp").alias("ts")


@query(
    "stream_usage",
    f"""SELECT user_id AS session_id, date_trunc('hour', ts) AS window_start,
      date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, sum(event_id % 100)::bigint AS input_tokens,
      sum(event_id % 7)::bigint AS output_tokens
    FROM events GROUP BY ALL""",
)
def stream_usage(spark, sf_dir):
    def turns(events):
        return events.select(
            F.col("user_id").alias("session_id"),
            _ts(),
            F.expr("event_id % 100").alias("input_tokens"),
            F.expr("event_id % 7").alias("output_tokens"),
        )

    return _run(spark, sf_dir, "events", turns, feeds.usage_stream, ["session_id", "window_start"], "usage")


@query(
    "stream_thrash",
    f"""SELECT user_id AS session_id, date_trunc('day', ts) AS window_start,
      date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type AS tool, count(*) AS calls, min(ts) AS first_seen
    FROM events WHERE event_type IN ('click', 'purchase')
    GROUP BY ALL HAVING count(*) >= 2""",
)
def stream_thrash(spark, sf_dir):
    def calls(events):
        return events.filter("event_type in ('click', 'purchase')").select(
            F.col("user_id").alias("session_id"), _ts(), F.col("event_type").alias("tool")
        )

    keys = ["session_id", "window_start", "tool"]
    return _run(spark, sf_dir, "events", calls, lambda c: feeds.thrash_stream(c, 2, "1 day"), keys, "thrash")


@query(
    "stream_pii",
    f"""WITH {hits_sql(d.CONTACTS_SQL)},
    t AS (SELECT *, TIMESTAMP '2026-01-01' + to_minutes(doc_id::int) AS ts FROM findings),
    w AS (SELECT date_trunc('hour', ts) AS s, type, count(*) AS documents, sum(count)::bigint AS matches FROM t GROUP BY ALL)
    SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, type, documents, matches FROM w""",
)
def stream_pii(spark, sf_dir):
    def docs(table):
        return d.with_contacts(table.select("doc_id", "text")).withColumn(
            "ts", F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))")
        )

    return _run(spark, sf_dir, "documents", docs, feeds.pii_stream, ["window_start", "type"], "pii")


@query("stream_redacted", "SELECT * FROM (" + SQL["redact_contacts"] + ")")
def stream_redacted(spark, sf_dir):
    docs = d.with_contacts(_stream(spark, sf_dir, "documents").select("doc_id", "text"))
    return feeds.run_to_table(feeds.redact_stream(docs), shared_folder(spark, "redacted"))


_SESSIONS_SQL = """
    g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOURS THEN 1 ELSE 0 END AS st FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g),
    a AS (SELECT user_id AS session_id, n, min(ts) AS window_start, max(ts) + INTERVAL 12 HOURS AS window_end,
      count(*) AS events, arg_max(event_type, ts) AS last_type FROM s GROUP BY ALL)
"""


@query(
    "stream_activity",
    f"""WITH {_SESSIONS_SQL} SELECT session_id, window_start, window_end, events, last_type FROM a""",
)
def stream_activity(spark, sf_dir):
    def events(table):
        return table.select(F.col("user_id").alias("session_id"), _ts(), F.col("event_type").alias("type"))

    feed = lambda e: feeds.activity_stream(e, "12 hours")
    return _run(spark, sf_dir, "events", events, feed, ["session_id", "window_start"], "activity")


# A proposal per event; two in three are answered, some of them too late.
@query(
    "stream_approvals",
    """WITH p AS (SELECT event_id AS id, date_trunc('milliseconds', ts) AS ts, ts AS raw FROM events),
    o AS (SELECT id, raw AS asked_at, CASE WHEN id % 3 = 0 OR id % 50 > 30 THEN 'expired'
        WHEN id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS outcome FROM p)
    SELECT id AS proposal_id, asked_at, outcome FROM o""",
)
def stream_approvals(spark, sf_dir):
    asked = F.struct(F.col("ts"), F.lit("approval-required").alias("type"), F.lit(None).cast("boolean").alias("approved"))
    answered = F.struct(
        F.expr("ts + make_dt_interval(0, 0, cast(event_id % 50 as int))").alias("ts"),
        F.lit("approval").alias("type"),
        (F.col("event_id") % 2 == 0).alias("approved"),
    )

    def events(table):
        return table.withColumn("ts", _ts()).select(
            F.col("event_id").alias("proposal_id"),
            F.inline(F.when(F.col("event_id") % 3 == 0, F.array(asked)).otherwise(F.array(asked, answered))),
        )

    return _run(spark, sf_dir, "events", events, feeds.approval_stream, ["proposal_id", "asked_at"], "approvals")


# Of three events in a row the first asks, the others answer, each at its own time.
@query(
    "stream_pending_approvals",
    """WITH a AS (SELECT event_id // 3 AS id, ts FROM events WHERE event_id % 3 = 0),
    r AS (SELECT event_id // 3 AS id, ts, event_id % 2 = 0 AS ok FROM events WHERE event_id % 3 <> 0)
    SELECT a.id AS proposal_id, a.ts AS asked_at, CASE arg_min(r.ok, struct_pack(t := r.ts, k := r.ok)) WHEN true THEN 'approved'
        WHEN false THEN 'rejected' ELSE 'expired' END AS outcome
    FROM a LEFT JOIN r ON a.id = r.id AND r.ts >= a.ts AND r.ts <= a.ts + INTERVAL 12 HOURS GROUP BY a.id, a.ts""",
)
def stream_pending_approvals(spark, sf_dir):
    def events(table):
        asks = F.col("event_id") % 3 == 0
        return table.select(
            F.expr("event_id div 3").alias("proposal_id"),
            _ts(),
            F.when(asks, "approval-required").otherwise("approval").alias("type"),
            F.when(~asks, F.col("event_id") % 2 == 0).alias("approved"),
        )

    folder = shared_folder(spark, "pending")
    with approvals.timed_state(spark):
        closed = feeds.run_to_table(approvals.pending_approvals(events(_stream(spark, sf_dir, "events")), "12 hours"), folder)
    whole = approvals.approval_outcomes(events(load(spark, sf_dir, "events")), "12 hours")
    rows = feeds.with_open_windows(closed, whole, ["proposal_id", "asked_at"], f"{folder}/whole")
    return rows.withColumn("asked_at", F.col("asked_at").cast("timestamp_ntz"))


@query("stream_growing_journal", SQL["journal_records"])
def stream_growing_journal(spark, sf_dir):
    """Journals read twice while they grow: first up to their middle, then either whole or from there on."""
    written = journal_files(spark, sf_dir).select("session_id", F.concat("content", F.lit("\n")).alias("content"))
    middle = F.floor(F.length("content") / 2).cast("int")
    whole = F.expr("crc32(session_id) % 2 = 0")
    first = written.select("session_id", F.lit(0).alias("at"), F.left("content", middle).alias("chunk"))
    then = written.select(
        "session_id",
        F.when(whole, 0).otherwise(middle).alias("at"),
        F.when(whole, F.col("content")).otherwise(F.substr("content", middle + 1)).alias("chunk"),
    )
    folder = shared_folder(spark, "growing")
    with approvals.timed_state(spark):
        for pieces in (first, then):
            pieces.write.mode("append").parquet(f"{folder}/pieces")
            arrived = spark.readStream.schema(pieces.schema).parquet(f"{folder}/pieces")
            records = feeds.run_to_table(journals.growing_journal(arrived), f"{folder}/records")
    return records.select("session_id", "line_no", "v", "type", content_text(F.col("data")).alias("text"))


# Documents 2k and 2k + 1 are two versions of one file.
_FEED_UNITS = """
u AS (
  SELECT doc_id AS pair_id, 1 AS side, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE doc_id % 2 = 1
  UNION ALL SELECT doc_id + 1, 0, unnest(string_split(text, chr(10))),
    generate_subscripts(string_split(text, chr(10)), 1) - 1 FROM documents WHERE doc_id % 2 = 0
    AND doc_id + 1 IN (SELECT doc_id FROM documents))
"""


@query(
    "stream_change_feed", f"WITH {diff_sql(_FEED_UNITS)} SELECT * FROM diff WHERE change <> 'unchanged'"
)
def stream_change_feed(spark, sf_dir):
    versions = _stream(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("filename"),
        F.expr("doc_id div 2").alias("base_name"),
        F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))").alias("mtime"),
        F.col("doc_id").cast("string").alias("token"),
        F.col("text").alias("content"),
    )
    folder = shared_folder(spark, "changes")
    return feeds.run_change_feed(versions, f"{folder}/versions", f"{folder}/feed", f"{folder}/checkpoint", ordered=False)


@query(
    "stream_ordered_feed",
    """WITH l AS (SELECT doc_id * 2 + 1 AS pair_id, string_split(text, chr(10)) AS a FROM documents),
    m AS (SELECT pair_id, '1: ' || a[1] AS line, len(a) - 1 AS last FROM l WHERE len(a) > 1)
    SELECT pair_id, 'removed' AS change, 0 AS before_no, NULL::int AS after_no, line AS before_text, NULL AS after_text FROM m
    UNION ALL SELECT pair_id, 'added', NULL, last::int, NULL, line FROM m""",
)
def stream_ordered_feed(spark, sf_dir):
    """Two versions of every document: its numbered lines, and the same with the first one last."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    moved = F.concat(F.slice(numbered, 2, F.size(numbered)), F.slice(numbered, 1, 1))
    both = F.array(F.array_join(numbered, "\n"), F.array_join(moved, "\n"))
    versions = _stream(spark, sf_dir, "documents").select("doc_id", F.posexplode(both).alias("v", "content")).select(
        (F.col("doc_id") * 2 + F.col("v")).alias("filename"),
        F.col("doc_id").alias("base_name"),
        F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, v)").alias("mtime"),
        F.col("v").cast("string").alias("token"),
        "content",
    )
    folder = shared_folder(spark, "ordered")
    return feeds.run_change_feed(versions, f"{folder}/versions", f"{folder}/feed", f"{folder}/checkpoint")
