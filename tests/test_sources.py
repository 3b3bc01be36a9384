import json

from conftest import rows
from pyspark.sql import functions as F

from paperloom.sources import encoding, files, journal, sheets


def test_encodings(spark):
    text = "안녕하세요, 문서입니다. abc\n"
    cases = [
        (text.encode(), text, "utf-8"), (b"\xef\xbb\xbf" + text.encode(), text, "utf-8"), (b"plain", "plain", "utf-8"),
        (b"\xff\xfe" + text.encode("utf-16-le"), text, "utf-16le"), (b"\xfe\xff" + text.encode("utf-16-be"), text, "utf-16be"),
        (text.encode("utf-16-le"), text, "utf-16le"), (text.encode("utf-16-be"), text, "utf-16be"),
        (b"\xbe\xc8\xb3\xe7", "안녕", "cp949"), ("똠방각하 펲시".encode("cp949"), "똠방각하 펲시", "cp949"),
        (b"\xff\xfe" + "a".encode("utf-16-le") + b"x", "a�", "utf-16le"), (b"", "", "utf-8"),
    ]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _, _) in enumerate(cases)], "id int, content binary")
    got = encoding.decode_text(df)
    assert rows(got, "id", "text", "encoding") == sorted([(i, t, e) for i, (_, t, e) in enumerate(cases)], key=repr)
    assert dict(rows(encoding.encoding_census(got), "encoding", "files"))["utf-8"] == 4


def test_inventory(spark):
    paths = ["b/x.png", "a.HWPX", "b/c.md", ".git/x.md", "node_modules/y.md", "d/.h.md", "1/2/3/4/ok.txt", "1/2/3/4/5/no.txt", "noext", ".txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in files.inventory(df).orderBy("rank", "path").collect()]
    folders = ["1/", "1/2/", "1/2/3/", "1/2/3/4/", "1/2/3/4/5/", "b/"]
    assert got == ["1/2/3/4/5/no.txt", "1/2/3/4/ok.txt", "a.HWPX", "b/c.md", *folders, "b/x.png", "noext"]
    near = [r.path for r in files.inventory(df, max_depth=4).orderBy("rank", "path").collect()]
    assert near == got[1:]
    assert files.inventory(df, cap=2).count() == 2


def test_triage(spark):
    ole, zipped = bytearray.fromhex("D0CF11E0A1B11AE1"), bytearray(b"PK\x03\x04")
    df = spark.createDataFrame(
        [("a.hwpx", 1, zipped), ("b.hwpx", 1, ole), ("c.hwp", 1, ole), ("d.docx", 1, bytearray(b"text")), ("e.xls", 1, ole),
         ("f.hwpx", 104857601, zipped), ("g.hwpx", 104857600, zipped), ("h.md", 1, bytearray(b"#"))],
        "path string, length long, head binary",
    )
    assert [r for _, r in rows(files.triage(df), "path", "reason")] == [
        "ok", "old_binary", "old_binary", "content_mismatch", "ok", "too_large", "ok", "ok"
    ]


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("hello")
    listing = files.read_listing(spark, str(tmp_path))
    assert rows(listing, "length") == [(5,)]
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan
    assert rows(files.read_listing(spark, str(tmp_path), 2), F.col("head").cast("string").alias("h")) == [("he",)]


def line(kind, data):
    return json.dumps({"v": 1, "ts": "2026-01-01T00:00:00.000Z", "type": kind, "data": data}, ensure_ascii=False)


def journal_folder(tmp_path):
    text = "첫째 줄\n" + "가" * 70
    good = [
        line("meta", {"id": "s1"}), "", line("user", {"role": "user", "content": text}), '{"v":1,"ts"',
        line("tool-result", {"callId": "c"}), line("assistant", {"role": "assistant", "content": [{"type": "text", "text": "답"}]}),
    ]
    parts = [line("meta", {"id": "s3"}), line("user", {"role": "user", "content": [{"type": "x"}, {"type": "text", "text": " hi "}]})]
    (tmp_path / "s1.jsonl").write_text("\n".join(good))
    (tmp_path / "s2.jsonl").write_text(line("user", {"role": "user", "content": "x"}))
    (tmp_path / "s3.jsonl").write_text("\n".join(parts))
    return str(tmp_path)


def test_journals(spark, tmp_path):
    found = journal.read_journal_files(spark, journal_folder(tmp_path))
    records = journal.journal_records(found)
    assert rows(records, "session_id", "line_no", "type") == [
        ("s1", 1, "meta"), ("s1", 3, "user"), ("s1", 5, "tool-result"), ("s1", 6, "assistant"), ("s3", 1, "meta"), ("s3", 2, "user")
    ]
    assert rows(journal.replay(records), "session_id", "type") == [("s1", "assistant"), ("s1", "user"), ("s3", "user")]
    listed = journal.session_list(found)
    assert rows(listed, "session_id", "preview") == [("s1", "첫째 줄 " + "가" * 55 + "…"), ("s3", "hi")]
    assert journal.latest_session(found).count() == 1


def test_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "S", [["a", "b"], ["c"]]), (1, "T", [])], "doc_id long, sheet string, rows array<array<string>>")
    long = sheets.sheets_to_rows(df)
    assert rows(long, "sheet", "row", "col", "text") == [("S", 0, 0, "a"), ("S", 0, 1, "b"), ("S", 1, 0, "c")]
    assert rows(sheets.sheet_shapes(df), "sheet", "rows", "cols") == [("S", 2, 2), ("T", 0, 0)]
    out = str(tmp_path / "out")
    sheets.write_partitioned(long, out, ["sheet"], files_per_value=3)
    assert rows(spark.read.parquet(out), "text") == [("a",), ("b",), ("c",)]


def test_files_reach_the_decoder_in_small_batches(spark):
    """Bad sequences of many files, none of them in an Arrow batch of 10,000 whole files."""
    files = spark.range(300).selectExpr("id AS doc_id", "cast(concat('x', id) AS binary) || unhex('FFC7D1') AS content")
    got = encoding.decode_text(files)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
    assert {r.text for r in got.collect()} == {(b"x%d\xff\xc7\xd1" % k).decode("cp949", "replace") for k in range(300)}


def test_large_parts_of_a_value_are_cut(spark, tmp_path):
    """One value with more rows than a task should sort comes in more files than were asked for."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    cells = spark.range(0, 200_000, 1, 8).selectExpr("id AS doc_id", "'en' AS sheet", "cast(hash(id) AS string) AS text")
    spark.conf.set(size, "100k")
    try:
        sheets.write_partitioned(cells, str(tmp_path / "o"), ["sheet"], files_per_value=2)
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "o/sheet=en").glob("*.parquet"))) > 4
    back = sheets.read_partitioned(spark, str(tmp_path / "o"), cells.schema)
    assert back.count() == 200_000 and not back.exceptAll(cells).head(1)
