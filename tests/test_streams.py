"""The same rows as one batch and as several micro-batches."""

import datetime as dt

import pandas as pd
from conftest import rows
from test_sources import journal_folder

from paperloom.operators.versions import parse_version_name
from paperloom.sources import journal
from paperloom.streaming import approvals, feeds, journals

T0 = dt.datetime(2026, 1, 1)


def arriving(spark, folder, parts, schema):
    """A stream that takes one written file at a time, in order."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/p={i}")
    return spark.readStream.schema(schema + ", p int").option("maxFilesPerTrigger", 1).parquet(folder).drop("p")


EVENTS = "session_id string, ts timestamp, input_tokens long, output_tokens long, tool string, type string"


def event_parts():
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows_ = [("s" + str(i % 2), at(i * 7), i, 1, "propose_edit", f"t{i}") for i in range(40)]
    return [rows_[:15], rows_[15:30], rows_[30:], [("z", at(2000), 0, 0, "x", "end")]]


def test_windows_equal_a_batch(spark, tmp_path):
    parts = event_parts()
    everything = spark.createDataFrame([r for p in parts for r in p], EVENTS)
    for name, fn in {
        "usage": feeds.usage_stream,
        "thrash": lambda d: feeds.thrash_stream(d, 3),
        "activity": lambda d: feeds.activity_stream(d, "30 minutes"),
    }.items():
        stream = fn(arriving(spark, str(tmp_path / f"in_{name}"), parts, EVENTS))
        got = feeds.run_to_table(stream, str(tmp_path / name))
        want = fn(everything).filter("session_id <> 'z'")
        assert rows(got, *got.columns) == rows(want, *want.columns) and want.count() > 0, name
        keys = ["session_id", "window_start"] + ["tool"] * (name == "thrash")
        all_ = feeds.with_open_windows(got, fn(everything), keys, str(tmp_path / f"whole_{name}"))
        assert rows(all_, *all_.columns) == rows(fn(everything), *all_.columns), name


def test_personal_data_stream(spark, tmp_path):
    schema = "doc_id long, ts timestamp, text string"
    parts = [
        [(1, T0, "010-1234-5678 a@b.com"), (2, T0, "nothing")],
        [(3, T0 + dt.timedelta(minutes=5), "a@b.com a@b.com")],
        [(4, T0 + dt.timedelta(days=1), "later@b.com")],
    ]
    got = feeds.run_to_table(feeds.pii_stream(arriving(spark, str(tmp_path / "in"), parts, schema)), str(tmp_path / "o"))
    assert rows(got, "type", "documents", "matches") == [("이메일", 2, 3), ("전화번호", 1, 1)]


def test_approvals(spark, tmp_path):
    schema = "proposal_id int, ts timestamp, type string, approved boolean"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [
        [(1, at(0), "approval-required", None), (2, at(1), "approval-required", None), (3, at(2), "approval-required", None)],
        [(1, at(10), "approval", True), (2, at(12), "approval", False)],
        [(3, at(90), "approval", True), (9, at(500), "approval-required", None)],
    ]
    got = feeds.run_to_table(feeds.approval_stream(arriving(spark, str(tmp_path / "in"), parts, schema)), str(tmp_path / "o"))
    assert rows(got, "proposal_id", "outcome") == [(1, "approved"), (2, "rejected"), (3, "expired")]


def test_journal_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = journal_folder(tmp_path / "in")
    got = feeds.run_to_table(feeds.journal_stream(spark, folder, files_per_batch=1), str(tmp_path / "o"))
    want = journal.journal_records(journal.read_journal_files(spark, folder))
    assert got.count() == 6
    assert rows(got, "session_id", "line_no", "type", "data") == rows(want, "session_id", "line_no", "type", "data")


def test_growing_journals_give_every_line_once(spark, tmp_path):
    """Pieces cut anywhere, repeated, overlapping and out of order; against the whole files as a batch."""
    record = lambda kind, n: f'{{"v":1,"ts":"2026-01-01T00:00:00Z","type":"{kind}","data":{{"n":"{n}é😀"}}}}\n'
    body = "".join(record(k, i) for i, k in enumerate(["meta", "user", "assistant", "approval", "user"]))
    texts = {
        "a": " \n" + body.replace("approval", "broken\\", 1),
        "b": body[body.index("\n") + 1 :],  # no meta record first
        "c": body + '{"v":1, "type"\n\n' + record("user", 9),
        None: body,
        "e": "",
    }
    piece = lambda s, lo, hi: (s, lo, texts[s][lo:hi])
    parts = [
        [piece("a", 0, 30), piece("b", 0, 10), piece("c", 50, 120), ("e", 0, None)],
        [piece("a", 0, 90), piece("a", 0, 30), piece(None, 0, 1), piece("c", 60, 70), piece("c", 200, 9999), ("e", None, "")],
        [piece("c", 0, 50), piece("b", 10, 9999), piece(None, 1, 9999), piece("a", 80, 9999)],
        [piece("c", 100, 220), piece("a", 0, 9999), piece(None, 0, 9999)],
    ]
    files = spark.createDataFrame(list(texts.items()), "session_id string, content string")
    want = rows(journal.journal_records(files), "session_id", "line_no", "type", "data")
    assert len(want) == 15 and not any(r[0] == "b" for r in want)
    for k, dealt in enumerate([parts, [[p for part in parts for p in part]]]):
        with approvals.timed_state(spark):
            pieces = arriving(spark, str(tmp_path / f"in{k}"), dealt, "session_id string, at long, chunk string")
            got = feeds.run_to_table(journals.growing_journal(pieces), str(tmp_path / f"o{k}"))
        assert rows(got, "session_id", "line_no", "type", "data") == want, k


def test_change_feed_over_batches(spark, tmp_path):
    schema = "filename string, mtime timestamp, content string"
    name = lambda h, f: f"2026-01-01T{h:02}-00-00-000Z-{f}.md"
    at = lambda h: T0 + dt.timedelta(hours=h)
    parts = [
        [(name(1, "a"), at(1), "x\ny"), (name(1, "b"), at(1), "k")],
        [(name(2, "a"), at(2), "x\nz"), (name(3, "a"), at(3), "x\nz\nw")],
        [(name(4, "a"), at(4), "x\nz\nw"), (name(4, "b"), at(4), "k2")],
    ]
    versions = parse_version_name(arriving(spark, str(tmp_path / "in"), parts, schema))
    got = feeds.run_change_feed(versions, *[str(tmp_path / p) for p in ("store", "feed", "check")])
    want = [
        (name(2, "a"), "modified", "y", "z"), (name(3, "a"), "added", None, "w"), (name(4, "b"), "modified", "k", "k2")
    ]
    assert rows(got, "pair_id", "change", "before_text", "after_text") == want
    # A repeated batch writes the same rows again.
    batch = spark.createDataFrame(parts[2], schema)
    feeds.write_change_feed(parse_version_name(batch), 2, str(tmp_path / "store"), str(tmp_path / "feed"))
    again = spark.read.parquet(str(tmp_path / "feed"))
    assert rows(again, "pair_id", "change", "before_text", "after_text") == want


def test_pending_approvals_do_not_depend_on_batches(spark, tmp_path):
    schema = "proposal_id int, ts timestamp, type string, approved boolean"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    ask, yes, no = ("approval-required", None), ("approval", True), ("approval", False)
    rows_ = [
        (1, at(0), *ask), (1, at(10), *yes), (1, at(20), *no),
        (2, at(5), *no), (2, at(1), *ask),
        (3, at(2), *ask), (3, at(33), *yes),
        (4, at(3), *ask), (4, at(33), *yes),
        (5, at(4), *ask), (5, at(9), *yes), (5, at(9), *no),
        (6, at(8), *yes), (6, at(9), *ask), (6, at(2), *ask),
        (7, at(9), *yes), (8, at(6), *ask), (8, at(7), "approval", None), (None, at(6), *ask), (None, at(7), *yes),
        (9, at(500), *ask), (9, at(501), *yes),
    ]
    want = [(1, "approved"), (2, "rejected"), (3, "expired"), (4, "approved"), (5, "rejected"), (6, "approved"), (8, "expired"), (None, "approved")]
    ended = approvals.approval_outcomes(spark.createDataFrame(rows_, schema))
    assert rows(ended.filter("proposal_id IS NULL OR proposal_id < 9"), "proposal_id", "outcome") == want
    timed = sorted(rows_, key=lambda r: r[1])
    # In one batch; in two; in many, each pair of neighbours swapped.
    swapped = [timed[i ^ 1] if i ^ 1 < len(timed) else timed[i] for i in range(len(timed))]
    for k, parts in enumerate([[rows_], [timed[:9], timed[9:]], [swapped[i : i + 4] for i in range(0, len(swapped), 4)]]):
        with approvals.timed_state(spark):
            stream = approvals.pending_approvals(arriving(spark, str(tmp_path / f"in{k}"), parts, schema))
            got = feeds.run_to_table(stream, str(tmp_path / f"o{k}"))
        assert rows(got, "proposal_id", "outcome") == want, k
        assert got.filter("proposal_id = 6").first().asked_at == at(2)


class CountedStore:
    """A state store in memory that counts what it is asked."""

    def __init__(self):
        self.calls, self.list, self.value, self.map, self.timers = 0, [], None, {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return getattr(self, f"_{name}")(*args)

        if name.startswith("_"):
            raise AttributeError(name)
        return call

    _getListState = lambda self, *_: View(self, "list")
    _getValueState = lambda self, *_: View(self, "value")
    _getMapState = lambda self, name, *_: View(self, "map", name)

    def _registerTimer(self, at):
        self.timers.add(at)

    def _deleteTimer(self, at):
        self.timers.remove(at)


class View:
    def __init__(self, store, kind, name=None):
        self.store, self.kind, self.name = store, kind, name

    def __getattribute__(self, name):
        if name in ("store", "kind", "name"):
            return object.__getattribute__(self, name)
        store, kind = self.store, self.kind
        store.calls += 1
        return {
            ("list", "appendValue"): lambda v: store.list.append(v),
            ("list", "get"): lambda: iter(store.list),
            ("list", "put"): lambda v: setattr(store, "list", list(v)),
            ("list", "clear"): lambda: setattr(store, "list", []),
            ("value", "get"): lambda: store.value,
            ("value", "update"): lambda v: setattr(store, "value", v),
            ("value", "clear"): lambda: setattr(store, "value", None),
            ("map", "getValue"): lambda k: store.map.get((self.name, k)),
            ("map", "updateValue"): lambda k, v: store.map.__setitem__((self.name, k), v),
            ("map", "removeKey"): lambda k: store.map.pop((self.name, k)),
        }[kind, name]


class Clock:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_proposals_share_the_calls_to_the_state():
    store, n = CountedStore(), 1000
    states = approvals.Deadlines(5_000_000)
    states.init(store)
    asks = pd.DataFrame({"name": [f"i{k}" for k in range(n)], "at": [k * 1000 for k in range(n)], "what": approvals.ASK})
    answers = pd.DataFrame({"name": [f"i{k}" for k in range(0, n, 2)], "at": 3_000_000, "what": [k // 2 % 2 for k in range(0, n, 2)]})
    for batch in (answers, asks):
        assert not list(states.handleInputRows((1,), iter([batch]), Clock(0)))
    at = []
    while store.timers:
        now = max(min(store.timers), 5_500)
        store.timers = {t for t in store.timers if t > now}
        at += list(states.handleExpiredTimer((1,), Clock(now), Clock(now)))
    found = pd.concat(at)
    assert len(found) == n and found["name"].is_unique and not store.list
    assert found["outcome"].value_counts().to_dict() == {"expired": 500, "approved": 250, "rejected": 250}
    # 25 calls for each proposal before.
    assert store.calls < 6 * n


def test_journals_take_two_calls_to_the_state_each():
    store, n = CountedStore(), 200
    growth = journals.Growth()
    growth.init(store)
    pieces = [(f"i{k}", at, chunk) for k in range(n) for at, chunk in ((0, "a\nb"), (3, "c\n"), (5, "d\ne\n"))]
    out = list(growth.handleInputRows((1,), iter([pd.DataFrame(pieces, columns=["name", "at", "chunk"])]), None))
    assert len(out) == 1 and sum(len(x) for x in out[0]["lines"]) == 4 * n
    assert store.calls <= 2 * n + 10
    early = pd.DataFrame([("i0", 14, "g\n"), ("i0", 9, "f\n"), ("i0", 11, "-\n-")], columns=["name", "at", "chunk"])
    lines = [x for t in growth.handleInputRows((1,), iter([early]), None) for row in t["lines"] for x in row]
    assert lines == ["f", "-", "-g"]
