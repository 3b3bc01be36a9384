from conftest import rows

from paperloom.operators import structure as st

REPORT = """# 제목

## 1. 개요
본문 **굵게** 그리고 *기울임*
- 항목 하나
* 항목 둘
| 항목 | 금액 |
|---|---|
| 제작비 | 1500000 |

| 다른 | 표 |
####### 일곱
#제목아님"""


def test_blocks(docs_of):
    got = [
        (r.type, r.level, r.text, r.table_idx, r.first_line, r.last_line)
        for r in st.blocks(docs_of(REPORT)).orderBy("block_no").collect()
    ]
    assert got == [
        ("heading", 1, "제목", None, 1, 1),
        ("heading", 2, "1. 개요", None, 3, 3),
        ("paragraph", None, "본문 **굵게** 그리고 *기울임*", None, 4, 4),
        ("list", None, "항목 하나", None, 5, 5),
        ("list", None, "항목 둘", None, 6, 6),
        ("table", None, "| 항목 | 금액 |\n|---|---|\n| 제작비 | 1500000 |", 0, 7, 9),
        ("table", None, "| 다른 | 표 |", 1, 11, 11),
        ("paragraph", None, "####### 일곱", None, 12, 12),
        ("paragraph", None, "#제목아님", None, 13, 13),
    ]


def test_cells_and_runs(docs_of):
    blocks = st.blocks(docs_of(REPORT))
    assert rows(st.table_cells(blocks), "table_idx", "row", "col", "text", "is_header") == [
        (0, 0, 0, "항목", True),
        (0, 0, 1, "금액", True),
        (0, 1, 0, "제작비", False),
        (0, 1, 1, "1500000", False),
        (1, 0, 0, "다른", True),
        (1, 0, 1, "표", True),
    ]
    assert rows(st.inline_runs(blocks), "style", "text") == [("bold", "굵게"), ("italic", "기울임")]


def test_outline(docs_of):
    got = [r.outline for r in st.outline(docs_of(REPORT, "no heading", None)).orderBy("doc_id").collect()]
    assert got == ["# 제목\n  ## 1. 개요", st.NO_HEADINGS, st.NO_HEADINGS]


def test_read_view_prefers_outline_and_cuts(docs_of):
    docs = docs_of(REPORT, "x" * 10)
    assert rows(st.read_view(docs, outline=True, search="금액"), "truncated") == [(False,), (False,)]
    assert rows(st.read_view(docs.filter("doc_id = 2"), cap=4), "body", "truncated") == [("xxxx", True)]
    assert rows(st.read_view(docs.filter("doc_id = 2"), search="없음"), "body") == [("'없음' 를 찾지 못했습니다.",)]
    body = rows(st.read_view(docs.filter("doc_id = 1"), search="제작비"), "body")[0][0]
    assert body.startswith("7: | 항목") and body.endswith("11: | 다른 | 표 |")


def test_read_view_is_whole_unless_a_limit_is_given(docs_of):
    docs = docs_of("x" * (st.READ_CAP + 1), "\n".join(["hit", *["-"] * 9] * 60))
    assert rows(st.read_view(docs.filter("doc_id = 1")), "body", "truncated") == [("x" * (st.READ_CAP + 1), False)]
    assert rows(st.read_view(docs.filter("doc_id = 1"), cap=st.READ_CAP), "truncated") == [(True,)]
    whole = rows(st.read_view(docs.filter("doc_id = 2"), search="hit"), "body")[0][0]
    assert whole.count(": hit") == 60
    some = rows(st.read_view(docs.filter("doc_id = 2"), search="hit", max_excerpts=50), "body")[0][0]
    assert some.count(": hit") == 50 and some.endswith("앞 50개까지만 표시했습니다)")


def test_lines_keep_empty_ones(docs_of):
    assert rows(st.lines(docs_of("a\n\nb\n")), "line_no", "text") == [(1, "a"), (2, ""), (3, "b"), (4, "")]


def test_page_blocks(spark):
    html = (
        "<html><head><style>p{}</style><script>var t='</p><p>no';</script></head><body><!-- <p>gone</p> -->"
        "<H2 class='x'>T &amp; U</H2><p>one<br>two <b>bold</b> &#44032;&#x41;<ul><li>item</ul><p> </p></body>"
    )
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert rows(st.page_blocks(pages), "block_no", "type", "level", "text") == [
        (1, "heading", 2, "T & U"),
        (2, "paragraph", None, "one two bold 가A"),
        (3, "list", None, "item"),
    ]


def test_page_spec():
    assert st.parse_page_spec("1-3, 5") == [(1, 3), (5, 5)]


def test_result_does_not_depend_on_partitions(docs_of):
    docs = docs_of(*[REPORT.replace("제목", f"제목{i}") for i in range(40)])
    one = rows(st.blocks(docs.coalesce(1)), "doc_id", "block_no", "text")
    assert one == rows(st.blocks(docs.repartition(8)), "doc_id", "block_no", "text")
