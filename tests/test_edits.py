import datetime as dt
import unicodedata

from conftest import rows
from pyspark.sql import functions as F

from paperloom.operators import cells, edits


def test_find_replace(docs_of):
    docs = docs_of("Ab ab AB", "none", "A.b (x) A.b", "étion ÉTION")
    got = {r.doc_id: (r.text, r.replaced) for r in edits.find_replace(docs, "ab", "$1\\").collect()}
    assert got[1] == ("$1\\ $1\\ $1\\", 3) and got[2] == ("none", 0)
    got = {r.doc_id: (r.text, r.replaced) for r in edits.find_replace(docs, "A.b (x)", "y").collect()}
    assert got[3] == ("y A.b", 1) and got[1] == ("Ab ab AB", 0)
    got = {r.doc_id: r.text for r in edits.find_replace(docs, "étion", "e").collect()}
    assert got[4] == "e e"
    got = {r.doc_id: (r.text, r.replaced) for r in edits.find_replace(docs, "ab", "X", every=False).collect()}
    assert got[1] == ("X ab AB", 1) and got[2] == ("none", 0)
    got = {r.doc_id: r.text for r in edits.find_replace(docs, "ab", "X", True, False).collect()}
    assert got[1] == "Ab X AB"


def test_renames_apply_in_order(docs_of):
    got = edits.rename_terms(docs_of("문화기획팀과 문화기획팀"), [("문화기획팀", "문화사업팀"), ("사업팀", "팀")])
    assert rows(got, "text", "replaced") == [("문화팀과 문화팀", 4)]


def snippet(before, after, ctx=24):
    p = 0
    while p < min(len(before), len(after)) and before[p] == after[p]:
        p += 1
    s, room = 0, min(len(before), len(after)) - p
    while s < room and before[-1 - s] == after[-1 - s]:
        s += 1

    def cut(t):
        a, b = max(0, p - ctx), min(len(t), len(t) - s + ctx)
        return ("…" if a else "") + t[a:b] + ("…" if b < len(t) else "")

    return cut(before), cut(after)


def test_snippets(spark):
    pairs = [("x" * 40 + "OLD" + "y" * 40, "x" * 40 + "NEWER" + "y" * 40), ("aaa", "aa"), ("", "z"), ("😀ab", "😀cb")]
    before, after = "\n".join(["same"] + [b for b, _ in pairs]), "\n".join(["same"] + [a for _, a in pairs])
    df = spark.createDataFrame([(1, before, after)], "doc_id long, before string, after string")
    got = edits.change_snippets(df).orderBy("sample_no").collect()
    assert [(r.before, r.after) for r in got] == [snippet(*p) for p in pairs]
    many = spark.createDataFrame([(1, "\n".join("a" * 30), "\n".join("b" * 30))], "doc_id long, before string, after string")
    assert edits.change_snippets(many).count() == 30
    assert edits.change_snippets(many, 20).count() == 20
    longer = spark.createDataFrame([(1, "a", "a\nnew")], "doc_id long, before string, after string")
    assert [(r.line_no, r.before, r.after) for r in edits.change_snippets(longer).collect()] == [(2, "", "new")]


def test_one_matcher_for_hits_counts_and_replacements(docs_of):
    got = edits.find_replace(docs_of("İİ THE end", "ſea sea SEA", "the"), "the", "[N]", every=False).orderBy("doc_id").collect()
    assert [(r.text, r.replaced) for r in got] == [("İİ [N] end", 1), ("ſea sea SEA", 0), ("[N]", 1)]
    got = edits.find_replace(docs_of("ſea sea SEA", "$ea"), "sea", "a$1\\b").orderBy("doc_id").collect()
    assert [(r.text, r.replaced) for r in got] == [("ſea a$1\\b a$1\\b", 2), ("$ea", 0)]


def test_residual_and_overwrite(spark, docs_of):
    assert rows(edits.residual_matches(docs_of("aXa"), "A", "b"), "remaining") == [(2,)]
    assert rows(edits.residual_matches(docs_of("aXa"), "A", "ba"), "remaining") == [(0,)]
    pairs = spark.createDataFrame(
        [(1, "x" * 2000, "x" * 999), (2, "x" * 2000, "x" * 1000), (3, "x" * 1999, "x")], "doc_id long, before string, after string"
    )
    assert rows(edits.overwrite_risk(pairs), "doc_id", "at_risk") == [(1, True), (2, False), (3, False)]


def test_normalisers(docs_of):
    text = "2026년 1월 1일, 26.1.1 및 2026-01-01, 26.12.31; 버전 1.2.3.4 2026-13-01 12026-01-015"
    got = docs_of(text).select(edits.normalized_dates(F.col("text")).alias("t")).collect()[0].t
    assert got.startswith("2026. 01. 01., 2026. 01. 01. 및 2026. 01. 01., 2026. 12. 31.;")
    assert got.endswith("2026-13-01 12026-01-015")
    amounts = docs_of("1500000", "총액은 1730000원, 999원, 1,234원", "12", "2026년")
    got = rows(amounts.select("doc_id", edits.add_commas(F.col("text")).alias("t")), "doc_id", "t")
    assert got == [(1, "1,500,000"), (2, "총액은 1,730,000원, 999원, 1,234원"), (3, "12"), (4, "2026년")]


CELLS = "doc_id long, table_idx int, row int, col int, row_span int, col_span int, text string"
EDITS = (
    "doc_id long, edit_no int, table_idx int, row int, col int, label string, direction string,"
    " new_text string, expected_text string"
)
FORM = [
    (0, 0, 0, 1, 2, "신청서 양식"), (0, 1, 0, 1, 1, "성명"), (0, 1, 1, 1, 1, ""),
    (0, 2, 0, 1, 1, unicodedata.normalize("NFD", "주소")), (0, 2, 1, 1, 1, unicodedata.normalize("NFD", "서울")),
]


def test_cell_edits_are_atomic(spark):
    grid = spark.createDataFrame([(d, *c) for d in (1, 2, 3) for c in FORM], CELLS)
    asked = spark.createDataFrame(
        [
            (1, 1, None, None, None, "성명", "right", "홍길동", ""),
            (1, 2, 0, 2, 1, None, None, "부산", "서울"),
            (2, 1, 0, 1, 1, None, None, "홍길동", None),
            (2, 2, 0, 2, 1, None, None, "부산", "대구"),
            (3, 1, 0, 1, 1, "성명", None, "x", None),
            (3, 2, 0, 1, None, None, None, "x", None),
            (3, 3, 4, 0, 0, None, None, "x", None),
            (3, 4, 0, 9, 0, None, None, "x", None),
            (3, 5, None, None, None, "주소", None, "ok", None),
            (3, 6, None, None, None, "주소", "below", "x", None),
        ],
        EDITS,
    )
    status = {(r.doc_id, r.edit_no): r.status for r in cells.cell_edit_results(grid, asked).collect()}
    assert [status[3, i] for i in range(1, 7)] == [
        "both_modes", "incomplete", "table_missing", "cell_missing", "ok", "target_missing"
    ]
    assert status[1, 1] == status[1, 2] == status[2, 1] == "ok" and status[2, 2] == "text_differs"
    after = {(r.doc_id, r.row, r.col): r.text for r in cells.apply_cell_edits(grid, asked).collect()}
    assert after[1, 1, 1] == "홍길동" and after[1, 2, 1] == "부산"
    assert after[2, 1, 1] == "" and after[3, 2, 1] == FORM[4][5]
    assert len(after) == 15


def test_addresses(spark):
    df = spark.createDataFrame([("A1",), ("Z9",), ("AA10",), ("ZZ3",), ("AAA7",), ("XFD1",)], "a string")
    row, col = cells.cell_address(F.col("a"))
    got = df.select("a", col.alias("c"), row.alias("r")).withColumn("b", cells.cell_name(F.col("r"), F.col("c")))
    values = {x.a: (x.c, x.r, x.b) for x in got.collect()}
    assert values["AA10"][:2] == (26, 9) and values["XFD1"][:2] == (16383, 0)
    assert all(a == b for a, (_, _, b) in values.items())


def test_sheet_edits(spark):
    sheet = spark.createDataFrame(
        [
            (1, "S", 0, 0, "string", "t", None, None, 0, 0),
            (1, "S", 0, 1, "null", None, None, None, 0, 0),
            (1, "S", 1, 0, "formula", "3", None, "A1+B1", None, None),
            (1, "S", 2, 0, "date", None, dt.datetime(2026, 1, 2), None, None, None),
            (1, "S", 3, 0, "date", None, dt.datetime(2026, 1, 2, 15, 4, 5), None, None, None),
        ],
        "doc_id long, sheet string, row int, col int, kind string, value_text string, value_ts timestamp_ntz,"
        " formula string, master_row int, master_col int",
    )
    ups = spark.createDataFrame(
        [(1, 1, "S", "B1", "v"), (1, 2, "S", "A2", "9"), (1, 3, "S", "a3", "d"), (1, 4, "S", "A4", "d"), (1, 5, "S", "A1", "w"), (1, 6, "S", "C7", "n")],
        "doc_id long, update_no int, sheet string, cell string, value string",
    )
    got = {r.update_no: r for r in cells.sheet_edit_results(sheet, ups).collect()}
    assert (got[1].target, got[1].old_value, got[1].merged_warning) == ("S!B1 → A1", "t", True)
    assert (got[2].old_value, got[2].formula_warning) == ("=A1+B1 (결과: 3)", True)
    assert got[3].old_value == "2026. 01. 02." and got[4].old_value == "2026. 01. 02. 오후 03:04:05"
    assert got[5].old_value == "v" and got[6].old_value == "(빈 셀)"
    after = {(r.row, r.col): r.value_text for r in cells.apply_sheet_edits(sheet, ups).collect()}
    assert after[0, 0] == "w" and after[1, 0] == "9" and after[6, 2] == "n" and len(after) == 6
    bad = ups.union(spark.createDataFrame([(1, 7, "X", "A1", "v")], ups.schema))
    assert {r.value_text for r in cells.apply_sheet_edits(sheet, bad).collect()} == {"t", "3", None}


def test_fields(spark):
    fields = spark.createDataFrame([(1, 0, "성명", ""), (2, 0, "성명", "x")], "doc_id long, field_no int, label string, value string")
    values = spark.createDataFrame([(1, "성명", "홍"), (1, "주소", "서울"), (2, "주소", "서울")], "doc_id long, label string, value string")
    assert rows(cells.fill_fields(fields, values), "doc_id", "label", "old_value", "status") == [
        (1, "성명", "", "filled"), (1, "주소", "(없음)", "unmatched"), (2, "주소", "(없음)", "rejected")
    ]


def test_values_stand_in_the_slot_of_their_key(spark):
    objects = spark.createDataFrame(
        [(1, 0, "box", "checkBox", None, False, None), (1, 1, "name", "edit", "", None, None)],
        "doc_id long, idx int, name string, type string, value_text string, value_bool boolean, combo_items array<string>",
    )
    edits_ = spark.createDataFrame(
        [(1, 1, "box", "checked", "abc", None), (1, 2, "box", "checked", None, True), (1, 3, "name", "text", None, True), (1, 4, "name", "text", "x", None), (1, 5, "name", "text", None, None)],
        "doc_id long, edit_no int, name string, set_key string, set_text string, set_bool boolean",
    ).selectExpr("*", "cast(null AS int) AS idx", "cast(null AS string) AS expected_text", "cast(null AS boolean) AS expected_bool")
    got = rows(cells.form_edit_results(objects, edits_), "edit_no", "status")
    assert got == [(1, "type_mismatch"), (2, "ok"), (3, "type_mismatch"), (4, "ok"), (5, "nothing_set")]


def test_sides_that_grow_alike_are_not_sent_to_every_task(spark):
    fields = spark.createDataFrame([(1, 0, "a", "x")], "doc_id long, field_no int, label string, value string")
    values = spark.createDataFrame([(1, "a", "y"), (1, "b", "z")], "doc_id long, label string, value string")
    grid = "doc_id long, table_idx int, row int, col int, row_span int, col_span int, text string"
    table = spark.createDataFrame([(1, 0, 0, 0, 1, 1, "k"), (1, 0, 0, 1, 1, 1, "v")], grid)
    edit = "doc_id long, edit_no int, table_idx int, row int, col int, label string, direction string, new_text string, expected_text string"
    edits = spark.createDataFrame([(1, 1, None, None, None, "k", "right", "w", "v"), (1, 2, 0, 0, 5, None, None, "w", None)], edit)
    for df in (cells.fill_fields(fields, values), cells.cell_edit_results(table, edits)):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(cells.fill_fields(fields, values), "label", "status") == [("a", "filled"), ("b", "unmatched")]
    assert rows(cells.cell_edit_results(table, edits), "edit_no", "status") == [(1, "ok"), (2, "cell_missing")]


def test_form_edits_are_not_sent_to_every_task(spark):
    objects = spark.createDataFrame(
        [(1, 0, "a", "edit", "old", None, None), (1, 1, "a", "edit", "", None, None), (2, 0, "a", "edit", "x", None, None)],
        "doc_id long, idx int, name string, type string, value_text string, value_bool boolean, combo_items array<string>",
    )
    edits_ = spark.createDataFrame(
        [(1, 1, "a", None), (1, 2, "a", 0), (2, 1, "a", None), (2, 2, "b", None), (3, 1, "a", None)],
        "doc_id long, edit_no int, name string, idx int",
    ).selectExpr("*", "'text' AS set_key", "'new' AS set_text", "cast(null AS boolean) AS set_bool", "cast(null AS string) AS expected_text", "cast(null AS boolean) AS expected_bool")
    got = cells.form_edit_results(objects, edits_)
    assert rows(got, "doc_id", "edit_no", "old_value", "status") == [
        (1, 1, "old", "ambiguous"), (1, 2, "old", "ok"), (2, 1, "x", "ok"), (2, 2, None, "not_found"), (3, 1, None, "not_found")
    ]
    got.collect()
    # Neither the plan that was made nor the one that ran.
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
