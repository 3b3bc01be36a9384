"""Versions, picks, time travel and conflicts, with the event log as the store of versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import versions as op
from paperloom.plans.registry import query
from paperloom.sources.tables import load

# Every event is a version of its user's document; two in fifty names cannot be parsed.
_FILES_SQL = """
files AS (
  SELECT event_id, ts AS mtime, CASE WHEN event_id % 50 = 1 THEN 'notes' WHEN event_id % 50 = 2 THEN '2024-01-01'
      ELSE strftime(ts, '%Y-%m-%dT%H-%M-%S-') || strftime(ts, '%f')[:3] || 'Z' END
    || '-doc_' || user_id || '.hwpx' AS filename, event_type AS summary,
    CASE WHEN event_id % 7 <> 0 THEN '/work/team' || (user_id % 5) || '/doc_' || user_id || '.hwpx' END AS source_path
  FROM events),
v AS (SELECT *, filename[:24] AS token, filename[26:] AS base_name, '/backups/' || filename AS full_path
  FROM files WHERE event_id % 50 NOT IN (1, 2))
"""


def _files(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("mtime"),
        F.expr(
            """case when event_id % 50 = 1 then 'notes' when event_id % 50 = 2 then '2024-01-01'
            else date_format(ts, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'") end || '-doc_' || user_id || '.hwpx'"""
        ).alias("filename"),
        F.col("event_type").alias("summary"),
        F.expr(
            "if(event_id % 7 <> 0, '/work/team' || user_id % 5 || '/doc_' || user_id || '.hwpx', null)"
        ).alias("source_path"),
    )


def versions(spark, sf_dir):
    files = _files(spark, sf_dir).select("event_id", "filename", "mtime")
    return op.parse_version_name(files).withColumn(
        "full_path", F.concat(F.lit("/backups/"), F.col("filename"))
    )


@query(
    "parse_version_name",
    f"""WITH {_FILES_SQL}
    SELECT filename, mtime, token, base_name, date_trunc('milliseconds', mtime) AS ts,
      strftime(mtime + INTERVAL 9 HOURS, '%Y. %m. %d. %H:%M:%S') AS shown FROM v""",
)
def parse_version_name(spark, sf_dir):
    return versions(spark, sf_dir).drop("event_id", "full_path")


@query(
    "list_versions",
    f"""WITH {_FILES_SQL},
    r AS (SELECT filename, mtime, (row_number() OVER (ORDER BY mtime DESC, token DESC))::int AS rank,
      count(*) OVER () AS total FROM v)
    SELECT *, false AS truncated FROM r""",
)
def list_versions(spark, sf_dir):
    return op.list_versions(versions(spark, sf_dir).select("filename", "mtime", "token")).drop("token")


@query(
    "versions_per_file",
    f"""WITH {_FILES_SQL},
    r AS (SELECT base_name, filename, (row_number() OVER (PARTITION BY base_name ORDER BY mtime DESC, token DESC))::int
      AS rank, count(*) OVER (PARTITION BY base_name) AS total FROM v)
    SELECT *, false AS truncated FROM r""",
)
def versions_per_file(spark, sf_dir):
    return op.versions_per_file(versions(spark, sf_dir)).select(
        "base_name", "filename", "rank", "total", "truncated"
    )


_REQUESTS_SQL = """
req AS (
  SELECT event_id AS request_id, CASE WHEN event_id % 9 = 0 THEN 'other.md' ELSE base_name END AS base_name,
    CASE event_id % 4 WHEN 0 THEN filename WHEN 1 THEN right(filename, 14 + length(base_name)) WHEN 2 THEN '  '
      ELSE 'zzz' || base_name END AS requested
  FROM v WHERE event_id % 3 = 0)
"""


@query(
    "pick_version",
    f"""WITH {_FILES_SQL}, {_REQUESTS_SQL},
    q AS (SELECT request_id, base_name, nullif(trim(requested), '') AS requested FROM req),
    e AS (SELECT request_id, v.filename FROM q JOIN v ON q.base_name = v.base_name AND q.requested = v.filename),
    s AS (SELECT request_id, count(*) AS n, arg_max(filename, (mtime, token)) AS filename
      FROM q JOIN v ON q.base_name = v.base_name AND suffix(v.full_path, q.requested) GROUP BY request_id),
    l AS (SELECT base_name, count(*) AS n, arg_max(filename, (mtime, token)) AS filename FROM v GROUP BY base_name)
    SELECT q.request_id, q.base_name, CASE WHEN e.filename IS NOT NULL THEN e.filename WHEN s.n IS NOT NULL THEN s.filename
        WHEN requested IS NULL THEN l.filename END AS filename,
      CASE WHEN e.filename IS NOT NULL THEN 'exact' WHEN s.n IS NOT NULL THEN 'suffix'
        WHEN requested IS NULL AND l.n IS NOT NULL THEN 'newest' ELSE 'not_found' END AS picked_by,
      e.filename IS NULL AND coalesce(s.n, 0) > 1 AS ambiguous,
      requested IS NULL AND coalesce(l.n, 0) > 1 AS auto_selected
    FROM q LEFT JOIN e USING (request_id) LEFT JOIN s USING (request_id) LEFT JOIN l ON q.base_name = l.base_name""",
)
def pick_version(spark, sf_dir):
    v = versions(spark, sf_dir)
    requests = v.filter("event_id % 3 = 0").select(
        F.col("event_id").alias("request_id"),
        F.expr("if(event_id % 9 = 0, 'other.md', base_name)").alias("base_name"),
        F.expr(
            """case event_id % 4 when 0 then filename when 1 then right(filename, 14 + length(base_name))
            when 2 then '  ' else 'zzz' || base_name end"""
        ).alias("requested"),
    )
    return op.pick_version(v, requests)


@query(
    "pick_as_of",
    f"""WITH {_FILES_SQL},
    r AS (SELECT o_orderkey AS request_id, 'doc_' || (o_custkey % 200) || '.hwpx' AS base_name,
        TIMESTAMP '2024-01-01' + to_minutes((o_orderkey * 37 % 43200)::int) AS as_of FROM orders)
    SELECT request_id, r.base_name, as_of, filename
    FROM r ASOF LEFT JOIN v ON r.base_name = v.base_name AND r.as_of >= v.mtime""",
)
def pick_as_of(spark, sf_dir):
    requests = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.expr("'doc_' || o_custkey % 200 || '.hwpx'").alias("base_name"),
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey * 37 % 43200 as int))"
        ).alias("as_of"),
    )
    return op.pick_as_of(versions(spark, sf_dir), requests)


@query(
    "timeline",
    f"""WITH {_FILES_SQL}
    SELECT filename, mtime, summary FROM v WHERE source_path LIKE '/work/team3/%'""",
)
def timeline(spark, sf_dir):
    sidecars = _files(spark, sf_dir).select("filename", "source_path", "summary")
    found = op.timeline(versions(spark, sf_dir), sidecars, "/work/team3")
    return found.select("filename", "mtime", "summary")


@query(
    "timelines",
    f"""WITH {_FILES_SQL},
    r AS (SELECT regexp_replace(source_path, '/[^/]+$', '') AS folder, filename, summary, mtime, token FROM v
      WHERE source_path IS NOT NULL),
    k AS (SELECT *, (row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, token DESC))::int AS rank,
      count(*) OVER (PARTITION BY folder) AS total FROM r)
    SELECT folder, filename, summary, rank, total, false AS truncated FROM k""",
)
def timelines(spark, sf_dir):
    sidecars = _files(spark, sf_dir).select("filename", "source_path", "summary")
    return op.timelines(versions(spark, sf_dir), sidecars).select(
        "folder", "filename", "summary", "rank", "total", "truncated"
    )


_NOW = "2024-02-05 12:00:00"


@query(
    "retention",
    f"""WITH {_FILES_SQL}
    SELECT filename, mtime < TIMESTAMP '{_NOW}' - INTERVAL 30 DAYS AS expired FROM v""",
)
def retention(spark, sf_dir):
    now = F.expr(f"timestamp_ntz'{_NOW}'")
    return op.retention(versions(spark, sf_dir), now).select("filename", "expired")


@query(
    "retention_counts",
    f"""WITH {_FILES_SQL}
    SELECT count(*) FILTER (mtime < TIMESTAMP '{_NOW}' - INTERVAL 30 DAYS) AS deleted,
      count(*) FILTER (mtime >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAYS) AS kept FROM v""",
)
def retention_counts(spark, sf_dir):
    now = F.expr(f"timestamp_ntz'{_NOW}'")
    return op.retention_counts(op.retention(versions(spark, sf_dir), now))


@query(
    "sidecar_deletions",
    f"""WITH {_FILES_SQL}
    SELECT filename, source_path FROM v WHERE source_path IS NOT NULL
      AND mtime < TIMESTAMP '{_NOW}' - INTERVAL 30 DAYS""",
)
def sidecar_deletions(spark, sf_dir):
    now = F.expr(f"timestamp_ntz'{_NOW}'")
    sidecars = _files(spark, sf_dir).filter("source_path IS NOT NULL").select("filename", "source_path")
    return op.sidecar_deletions(op.retention(versions(spark, sf_dir), now), sidecars)


# Times cut to whole minutes of few names, so that many versions want the same slots.
@query(
    "assign_version_ts",
    """WITH RECURSIVE n AS (SELECT user_id % 20 AS name, event_id AS seq, epoch_ms(ts) // 600000 * 4 AS ms FROM events
      WHERE event_id % 5 <> 0),
    taken AS (SELECT DISTINCT user_id % 20 AS name, epoch_ms(ts) // 600000 * 4 + event_id % 3 AS ms FROM events
      WHERE event_id % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ms, seq) AS rn FROM n),
    free AS (SELECT name, ms FROM (SELECT DISTINCT name, unnest(range(ms, ms + 600)) AS ms FROM n) f
      ANTI JOIN taken USING (name, ms)),
    w AS (SELECT name, seq, ms, rn, (SELECT min(f.ms) FROM free f WHERE f.name = r.name AND f.ms >= r.ms) AS x FROM r WHERE rn = 1
      UNION ALL
      SELECT r.name, r.seq, r.ms, r.rn,
        (SELECT min(f.ms) FROM free f WHERE f.name = r.name AND f.ms >= greatest(r.ms, w.x + 1))
      FROM w JOIN r ON r.name = w.name AND r.rn = w.rn + 1)
    SELECT name, seq, ms, x AS assigned_ms FROM w""",
)
def assign_version_ts(spark, sf_dir):
    slots = load(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("name"),
        F.col("event_id").alias("seq"),
        F.expr("unix_millis(cast(ts as timestamp)) div 600000 * 4").alias("ms"),
    )
    taken = slots.filter("seq % 5 = 0").select("name", (F.col("ms") + F.col("seq") % 3).alias("ms"))
    return op.assign_version_ts(slots.filter("seq % 5 <> 0"), taken, bucket_ms=100)


@query(
    "lost_updates",
    """WITH p AS (SELECT o_orderkey AS id, 'f' || (o_orderkey % 2000) AS sp,
        CASE WHEN o_orderkey % 11 <> 0 THEN 1000 + o_orderkey % 7 END AS sm,
        CASE WHEN o_orderkey % 3 = 0 THEN 't' || (o_orderkey % 900) ELSE 'f' || (o_orderkey % 2000) END AS tp,
        1000 + o_orderkey % 4 AS tm FROM orders),
    f AS (SELECT 'f' || c_custkey AS path, 1000 + c_custkey % 5 AS ms FROM customer
      UNION ALL SELECT 't' || c_custkey, 1000 + c_custkey % 3 FROM customer WHERE c_custkey % 2 = 0)
    SELECT id, CASE WHEN sm IS NOT NULL AND s.path IS NULL THEN 'source_missing'
      WHEN sm IS NOT NULL AND abs(s.ms - sm) > 1 THEN 'source_changed'
      WHEN tp <> sp AND t.path IS NULL THEN 'target_missing'
      WHEN tp <> sp AND abs(t.ms - tm) > 1 THEN 'target_changed' ELSE 'ok' END AS status
    FROM p LEFT JOIN f s ON sp = s.path LEFT JOIN f t ON tp = t.path""",
)
def lost_updates(spark, sf_dir):
    proposals = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("'f' || o_orderkey % 2000").alias("source_path"),
        F.expr("if(o_orderkey % 11 <> 0, 1000 + o_orderkey % 7, null)").alias("source_ms"),
        F.expr("if(o_orderkey % 3 = 0, 't' || o_orderkey % 900, 'f' || o_orderkey % 2000)").alias("target_path"),
        F.expr("1000 + o_orderkey % 4").alias("target_ms"),
    )
    files = load(spark, sf_dir, "customer").select(
        F.expr(
            """stack(2, 'f' || c_custkey, 1000 + c_custkey % 5, true,
              't' || c_custkey, 1000 + c_custkey % 3, c_custkey % 2 = 0) as (path, ms, there)"""
        )
    ).filter("there")
    return op.lost_updates(proposals, files)


_RESTORE_SQL = """
cur AS (SELECT 'd' || c_custkey AS path, c_name AS content FROM customer),
ver AS (SELECT o_orderkey AS filename, o_custkey, o_orderpriority AS content FROM orders),
pick AS (SELECT 'd' || o_custkey AS path, max(o_orderkey) AS filename FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey)
"""


def _restored(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    current = load(spark, sf_dir, "customer").select(
        F.expr("'d' || c_custkey").alias("path"), F.col("c_name").alias("content")
    )
    picks = orders.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("filename")).select(
        F.expr("'d' || o_custkey").alias("path"), "filename"
    )
    return op.restore(
        current, picks, orders.select(F.col("o_orderkey").alias("filename"), F.col("o_orderpriority").alias("content"))
    )


@query(
    "restore",
    f"""WITH {_RESTORE_SQL} SELECT cur.path, coalesce(ver.content, cur.content) AS content
    FROM cur LEFT JOIN pick USING (path) LEFT JOIN ver ON pick.filename = ver.filename""",
)
def restore(spark, sf_dir):
    return _restored(spark, sf_dir)[0]


@query(
    "restore_saved",
    f"WITH {_RESTORE_SQL} SELECT cur.path, cur.content FROM cur JOIN pick USING (path)",
)
def restore_saved(spark, sf_dir):
    return _restored(spark, sf_dir)[1]


@query(
    "restore_results",
    """WITH p AS (SELECT DISTINCT 'd' || (o_custkey + o_orderkey % 2 * 60) AS path, o_orderkey - o_orderkey % 5 AS filename FROM orders WHERE o_orderkey % 7 = 0),
    m AS (SELECT path, count(*) AS n FROM p GROUP BY path)
    SELECT path, filename, CASE WHEN n > 1 THEN 'chosen_twice' WHEN path NOT IN (SELECT 'd' || c_custkey FROM customer) THEN 'unknown_path'
      WHEN filename NOT IN (SELECT o_orderkey FROM orders) THEN 'unknown_version' ELSE 'ok' END AS status FROM p JOIN m USING (path)""",
)
def restore_results(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    picks = orders.filter("o_orderkey % 7 = 0").selectExpr("'d' || (o_custkey + o_orderkey % 2 * 60) AS path", "o_orderkey - o_orderkey % 5 AS filename")
    current = load(spark, sf_dir, "customer").selectExpr("'d' || c_custkey AS path", "c_name AS content")
    return op.restore_results(current, picks, orders.selectExpr("o_orderkey AS filename", "o_orderpriority AS content"))


@query(
    "previous_versions",
    f"""WITH {_FILES_SQL}
    SELECT filename, lag(filename) OVER (PARTITION BY base_name ORDER BY mtime, token) AS previous FROM v""",
)
def previous_versions(spark, sf_dir):
    return op.previous_versions(versions(spark, sf_dir)).select("filename", "previous")
