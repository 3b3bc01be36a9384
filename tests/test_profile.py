from conftest import rows

from paperloom.operators import cells, profile

BLOCKS = "doc_id long, block_no int, type string, level int, text string, is_footnote boolean, table_idx int"
CELLS = "doc_id long, table_idx int, row int, col int, row_span int, col_span int, text string, is_header boolean"


def blocks(spark, *items):
    data = [(1, i, *x) for i, x in enumerate(items, 1)]
    return spark.createDataFrame([(*d[:5], d[5] if len(d) > 5 else False, None) for d in data], BLOCKS)


def grid(spark, *sizes):
    data = [(1, t, r, c, 1, 1, "", r == 0) for t, (n, m) in enumerate(sizes) for r in range(n) for c in range(m)]
    return spark.createDataFrame(data, CELLS)


def test_numbering_style(spark):
    style = lambda *texts: profile.numbering_style(
        blocks(spark, *[("paragraph", None, t) for t in texts])
    ).collect()[0].style
    assert style("□ 개요", " ○ 배경", "1. x") == profile.REPORT_STYLE
    assert style("1. 개요", "가. 배경", "① 항", "□ x") == profile.LEGAL_STYLE
    assert style("□ 개요", "1. x") == profile.NO_STYLE
    assert style("□ 개요") == profile.NO_STYLE
    assert style("□개요", "□개요") == profile.NO_STYLE


def test_fingerprint_and_template(spark):
    fp = profile.fingerprint(
        blocks(spark, ("heading", 1, "제목" * 40), ("paragraph", None, "x", True), ("table", None, ""), ("heading", 2, "둘"), ("image", None, "")),
        grid(spark, (2, 3)),
    )
    r = fp.collect()[0]
    assert [(h.type, h.n) for h in r.histogram] == [("heading", 2), ("paragraph", 1), ("table", 1), ("image", 1)]
    assert len(r.headings[0].text) == 80 and r.headings[1].level == 2
    assert (r.image_count, r.footnote_count, r.list_count) == (1, 1, 0)
    text = profile.format_template(fp).collect()[0].template
    assert "제목" * 25 in text and "제목" * 26 not in text
    assert "- 표(1): #1 2×3(머리행)" in text and "    H2 둘" in text and "- 각주: 1" in text


def test_drift(spark):
    base = [("heading", 1, "h"), ("table", None, ""), ("paragraph", None, "x", True)]
    before = profile.fingerprint(blocks(spark, *base), grid(spark, (2, 2)))
    drift = lambda items, sizes: rows(
        profile.fingerprint_drift(before, profile.fingerprint(blocks(spark, *items), grid(spark, *sizes))), "drift", "details"
    )
    assert drift(base, [(2, 2)]) == [(False, "")]
    assert drift(base + [("table", None, "")], [(2, 2), (1, 1)]) == [(False, "")]
    assert drift(base, [(3, 2)]) == [(True, "표 1 격자 2×2→3×2")]
    assert drift(base[:1] + base[2:], []) == [(True, "표 1→0")]
    assert drift(base[:2] + [("paragraph", None, "x", False)], [(2, 2)]) == [(True, "각주 1→0")]
    assert drift(base[:2] + [("image", None, "", True)], [(2, 2)]) == [(False, "")]


FORM = (
    '<hp:edit name="성명입력" x="1"><hp:y/><hp:text/></hp:edit><hp:comboBox selectedValue="" name="부서선택">'
    '<hp:listItem displayText="" value="총무팀"/><hp:listItem displayText="" value="기획&amp;팀"/></hp:comboBox>'
    '<hp:checkBtn caption="c" value="UNCHECKED" groupName="g" name="동의"></hp:checkBtn>'
    '<hp:radioBtn value="CHECKED" name="동의"></hp:radioBtn><hp:btn caption="확인&lt;" name="b"></hp:btn>'
)


def test_form_inventory_and_edits(spark):
    xml = spark.createDataFrame([(1, FORM)], "doc_id long, xml string")
    forms = profile.form_inventory(xml)
    assert [tuple(r) for r in forms.orderBy("idx").collect()] == [
        (1, 0, "성명입력", "edit", "", None, None),
        (1, 1, "부서선택", "comboBox", "", None, ["총무팀", "기획&팀"]),
        (1, 2, "동의", "checkBox", None, False, None),
        (1, 3, "동의", "radioButton", None, True, None),
        (1, 4, "b", "button", "확인<", None, None),
    ]
    schema = (
        "doc_id long, edit_no int, name string, idx int, set_key string, set_text string, set_bool boolean,"
        " expected_text string, expected_bool boolean"
    )
    asked = spark.createDataFrame(
        [
            (1, 1, "성명입력", None, "text", "홍", None, "", None),
            (1, 2, "부서선택", None, "selected", "없는팀", None, None, None),
            (1, 3, "동의", None, "checked", None, True, None, None),
            (1, 4, "동의", 2, "checked", None, True, None, False),
            (1, 5, "동의", 3, "caption", "x", None, None, None),
            (1, 6, "b", None, "caption", "x", None, "다름", None),
            (1, 7, "무", None, "text", "x", None, None, None),
        ],
        schema,
    )
    status = {r.edit_no: r.status for r in cells.form_edit_results(forms, asked).collect()}
    assert list(dict(sorted(status.items())).values()) == [
        "ok", "not_an_item", "ambiguous", "ok", "type_mismatch", "value_differs", "not_found"
    ]
    same = cells.apply_form_edits(forms, asked)
    assert rows(same, "idx", "value_text", "value_bool") == rows(forms, "idx", "value_text", "value_bool")
    good = cells.apply_form_edits(forms, asked.filter("edit_no in (1, 4)"))
    assert rows(good, "idx", "value_text", "value_bool")[:3] == [(0, "홍", None), (1, "", None), (2, None, True)]


def test_footnotes(spark):
    xml = "<hp:t>본문</hp:t><hp:footNote n='1'><hp:p><hp:t>각&amp;</hp:t><hp:t>주</hp:t></hp:p></hp:footNote><hp:footNote><hp:t> </hp:t></hp:footNote>"
    df = spark.createDataFrame([(1, xml)], "doc_id long, xml string")
    assert rows(profile.footnote_texts(df), "note_no", "text") == [(1, "각&주")]


def test_hygiene(spark):
    html = (
        "<html lang='ko'><head><meta http-equiv='refresh'><script>a<b></script></head><body class=x onload='y'>"
        "<!-- <iframe> --><a href=\"JavaScript:z\" id=i>l</a><a href='/rel'>r</a><img src='data:x' style='s'></body>"
    )
    pages = spark.createDataFrame([(1, html), (2, "<p>ok</p>")], "page_id long, html string")
    assert rows(profile.html_hygiene(pages), "kind", "name", "n") == [
        ("attribute", "body.onload", 1), ("attribute", "img.style", 1), ("attribute", "meta.http-equiv", 1),
        ("scheme", "a.javascript", 1), ("tag", "script", 1),
    ]
    assert rows(profile.hygiene_verdict(pages), "page_id", "clean") == [(1, False), (2, True)]


def test_lint_and_totals(spark, docs_of):
    docs = docs_of("2026년 1월 1일 1500000원 구법", "2026. 01. 01. 1,500,000원 새법", "새법 26.1.1")
    got = rows(profile.lint_flags(docs, [("구법", "새법")]), "doc_id", "rule", "pass")
    assert [p for _, _, p in got] == [False, False, False, True, True, True, True, False, True]
    cells_ = spark.createDataFrame(
        [(d, 0, r, c, t) for d in (1, 2) for r, row in enumerate([["항목", "금액"], ["제작", "1,500,000"], ["운영", "230000원"]]) for c, t in enumerate(row)],
        "doc_id long, table_idx int, row int, col int, text string",
    )
    texts = docs_of("총액은 1730000원입니다.", "총액: 없음 총액은 1,720,000원")
    assert rows(profile.numeric_consistency(cells_, texts), "doc_id", "column_sum", "consistent") == [
        (1, 1730000, True), (2, 1730000, False)
    ]


def test_lost_documents_and_unreadable_amounts_are_told(spark, docs_of):
    one = profile.fingerprint(blocks(spark, ("table", None, "")), grid(spark, (2, 2)))
    none = one.limit(0)
    assert [(r.drift, r.details.split("; ")[0]) for r in profile.fingerprint_drift(one, none).collect()] == [(True, "문서 없음")]
    assert [(r.drift, r.details) for r in profile.fingerprint_drift(none, one).collect()] == [(True, "이전 문서 없음")]
    cells_ = spark.createDataFrame(
        [(d, 0, r, 0, t) for d in (1, 2) for r, t in enumerate(["금액", "100", "1억" if d == 1 else "1"])],
        "doc_id long, table_idx int, row int, col int, text string",
    )
    got = profile.numeric_consistency(cells_, docs_of("총액은 100원", "없음"))
    assert rows(got, "doc_id", "consistent", "status") == [(1, False, "unreadable"), (2, False, "no_total")]
