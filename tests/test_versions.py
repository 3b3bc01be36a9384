import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from paperloom.operators import versions as vs

FILES = "filename string, mtime timestamp_ntz"
T0 = dt.datetime(2026, 6, 16, 23, 18, 42)


def parsed(spark, *files):
    return vs.parse_version_name(spark.createDataFrame(list(files), FILES)).withColumn(
        "full_path", F.concat(F.lit("/b/"), F.col("filename"))
    )


A1, A2, B1 = (
    "2026-06-16T23-18-42-393Z-a.hwpx", "2026-06-17T01-00-00-000Z-a.hwpx", "2026-06-16T23-18-42-393Z-b-a.hwpx"
)


def test_names(spark):
    got = parsed(spark, (A1, T0), ("notes.txt", T0), (".x.meta.json", T0), ("2026-13-40T99-00-00-000Z-a.md", T0))
    assert rows(got, "base_name", "shown") == [
        ("a.hwpx", "2026. 06. 17. 08:18:42"), ("a.md", "2026-13-40T99-00-00-000Z")
    ]
    assert got.filter("base_name = 'a.hwpx'").collect()[0].ts == T0.replace(microsecond=393000)


def test_lists(spark):
    v = parsed(spark, (A1, T0), (A2, T0), (B1, T0 + dt.timedelta(hours=1)))
    assert [r.filename for r in vs.list_versions(v).orderBy("rank").collect()] == [B1, A2, A1]
    assert [r.filename for r in vs.list_versions(v, "/x/a.hwpx").orderBy("rank").collect()] == [A2, A1]
    r = vs.versions_per_file(v, 1).filter("base_name = 'a.hwpx'").collect()[0]
    assert (r.filename, r.total, r.truncated) == (A2, 2, True)


def test_picks(spark):
    v = parsed(spark, (A1, T0 + dt.timedelta(hours=1)), (A2, T0), (B1, T0))
    asked = spark.createDataFrame(
        [(1, "a.hwpx", A2), (2, "a.hwpx", "a.hwpx"), (3, "a.hwpx", None), (4, "a.hwpx", "zzz"), (5, "b-a.hwpx", " "),
         (6, "c.hwpx", None), (7, "a.hwpx", "/b/" + A1), (8, "a.hwpx", "00-000Z-a.hwpx")],
        "request_id int, base_name string, requested string",
    )
    got = {r.request_id: (r.filename, r.picked_by, r.ambiguous, r.auto_selected) for r in vs.pick_version(v, asked).collect()}
    assert got == {
        1: (A2, "exact", False, False), 2: (A1, "suffix", True, False), 3: (A1, "newest", False, True),
        4: (None, "not_found", False, False), 5: (B1, "newest", False, False), 6: (None, "not_found", False, False),
        7: (A1, "suffix", False, False), 8: (A2, "suffix", False, False),
    }


def test_timeline_and_retention(spark):
    v = parsed(spark, (A1, T0), (A2, T0 - dt.timedelta(days=30)), (B1, T0 - dt.timedelta(days=30, seconds=1)))
    side = spark.createDataFrame([(A1, "/w/a.hwpx", "s"), (B1, "/w/sub/b-a.hwpx", "t")], "filename string, source_path string, summary string")
    assert rows(vs.timeline(v, side, "/w"), "filename", "summary") == [(A1, "s")]
    marked = vs.retention(v, F.lit(T0).cast("timestamp_ntz"))
    assert rows(marked, "filename", "expired") == [(A1, False), (B1, True), (A2, False)]
    assert vs.retention_counts(marked).collect()[0] == (1, 2)
    assert rows(vs.sidecar_deletions(marked, side), "filename") == [(B1,)]


def test_slots_equal_next_free(spark):
    rng = random.Random(5)
    new = [(f"n{i % 3}", i, rng.randrange(60)) for i in range(90)]
    taken = {(f"n{i % 3}", rng.randrange(80)) for i in range(60)}
    used, want = set(taken), {}
    for name, seq, ms in sorted(new, key=lambda x: (x[2], x[1])):
        while (name, ms) in used:
            ms += 1
        used.add((name, ms))
        want[seq] = ms
    got = vs.assign_version_ts(
        spark.createDataFrame(new, "name string, seq long, ms long"),
        spark.createDataFrame(sorted(taken), "name string, ms long"),
        bucket_ms=7,
    )
    assert {r.seq: r.assigned_ms for r in got.collect()} == want


def test_lost_updates(spark):
    files = spark.createDataFrame([("a", 1000), ("b", 1001), ("c", 1002), ("t", 5)], "path string, ms long")
    asked = spark.createDataFrame(
        [(1, "a", 1000, "a", None), (2, "b", 1000, "b", None), (3, "c", 1000, "c", None), (4, "x", 1000, "x", None),
         (5, "a", 1000, "t", 9), (6, "a", 1000, "u", 9), (7, "x", None, "x", None), (8, None, None, "n", None)],
        "id int, source_path string, source_ms long, target_path string, target_ms long",
    )
    assert [s for _, s in rows(vs.lost_updates(asked, files), "id", "status")] == [
        "ok", "ok", "source_changed", "source_missing", "target_changed", "target_missing", "ok", "ok"
    ]


def test_restore_and_as_of(spark):
    current = spark.createDataFrame([("p", "now"), ("q", "stay")], "path string, content string")
    picks = spark.createDataFrame([("p", "f1"), ("q", "gone")], "path string, filename string")
    old = spark.createDataFrame([("f1", "old")], "filename string, content string")
    after, saved = vs.restore(current, picks, old)
    assert rows(after, "path", "content") == [("p", "old"), ("q", "stay")]
    assert rows(saved, "path", "content") == [("p", "now")]
    v = parsed(spark, (A1, T0), (A2, T0 + dt.timedelta(days=3)))
    asked = spark.createDataFrame(
        [(i, "a.hwpx", T0 + dt.timedelta(days=d)) for i, d in enumerate([-1, 0, 2, 3, 90])],
        "request_id int, base_name string, as_of timestamp_ntz",
    )
    assert [f for _, f in rows(vs.pick_as_of(v, asked), "request_id", "filename")] == [None, A1, A1, A2, A2]


def test_every_request_has_a_row(spark):
    v = spark.createDataFrame([("f", "b", "t", 1)], "filename string, base_name string, token string, m int")
    v = v.withColumn("mtime", F.timestamp_seconds("m"))
    r = spark.createDataFrame([(1, "b", 5), (2, None, 5), (3, "b", None), (4, "zz", 5)], "request_id long, base_name string, m int")
    got = vs.pick_as_of(v, r.select("request_id", "base_name", F.timestamp_seconds("m").alias("as_of")))
    assert rows(got, "request_id", "filename") == [(1, "f"), (2, None), (3, None), (4, None)]


def test_every_pick_has_a_status(spark):
    current = spark.createDataFrame([("p", "now"), ("q", "stay"), ("t", "both")], "path string, content string")
    picks = spark.createDataFrame([("p", "f1"), ("p", "f1"), ("q", "gone"), ("no", "f1"), ("t", "f1"), ("t", "f2"), (None, "f1")], "path string, filename string")
    old = spark.createDataFrame([("f1", None), ("f2", "old")], "filename string, content string")
    want = [("no", "f1", "unknown_path"), ("p", "f1", "ok"), ("q", "gone", "unknown_version"), ("t", "f1", "chosen_twice"), ("t", "f2", "chosen_twice"), (None, "f1", "unknown_path")]
    assert rows(vs.restore_results(current, picks, old), "path", "filename", "status") == want
    after, saved = vs.restore(current, picks, old)
    assert rows(after, "path", "content") == [("p", None), ("q", "stay"), ("t", "both")]
    assert rows(saved, "path", "content") == [("p", "now")]


def test_a_version_without_a_time_is_kept(spark):
    marked = spark.createDataFrame([(True,), (False,), (None,)], "expired boolean")
    assert tuple(vs.retention_counts(marked).first()) == (1, 2)
