import re

import pytest
from conftest import rows

from paperloom.functions.pii import CARD, EMAIL, PHONE, RRN
from paperloom.operators import pii

NOTICE = """# 개인정보 처리 안내문

- 성명: 홍길동
- 주민등록번호: 900101-1234567
- 전화번호: 010-1234-5678
- 이메일: hong@example.com
- 결제카드번호: 1234-5678-9012-3456
"""


def found(docs):
    return {
        (r.doc_id, r.type): (r["count"], r.masked) for r in pii.detect_pii(docs).collect()
    }


def test_masks(docs_of):
    assert found(docs_of(NOTICE)) == {
        (1, RRN): (1, ["900101-1******"]),
        (1, CARD): (1, ["1234-****-****-3456"]),
        (1, PHONE): (1, ["010-****-5678"]),
        (1, EMAIL): (1, ["h***@example.com"]),
    }


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("02-123-4567", {PHONE}),
        ("12-900101-1234567", set()),
        ("900101-5234567", set()),
        ("900101-1234567-1", set()),
        ("메일hong@example.com", {EMAIL}),
        ("가a@b.com", {EMAIL}),
        ("user@mail.example.co.kr", {EMAIL}),
        ("1234-5678-9012-3456-7890", set()),
        ("1234567890123456", set()),
        ("+1 (202) 555-0143", set()),
        ("a@b", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_edges(docs_of, text, kinds):
    docs = docs_of(text)
    assert {k for _, k in found(docs)} == kinds
    if not kinds:
        assert rows(pii.redact(docs), "text") == [(text,)]


def test_counts_and_examples(docs_of):
    three = "010-1111-2222 010-1111-2222 010-3333-4444"
    six = " ".join(f"010-{i}000-000{i}" for i in range(1, 7))
    got = found(docs_of(three, six))
    assert got[1, PHONE] == (3, ["010-****-2222", "010-****-4444"])
    assert got[2, PHONE][0] == 6 and len(got[2, PHONE][1]) == 5


def test_long_text_without_domain_is_bounded(docs_of):
    assert found(docs_of("a@" + "a." * 20000)) == {}


def test_sequence_and_ranges_differ_on_overlap(docs_of):
    docs = docs_of("x 010-1234-5678@x.com y", NOTICE)
    by_range = {r.doc_id: r.text for r in pii.redact_by_ranges(docs).collect()}
    in_order = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert by_range[1] == "x 0***@x.com y"
    assert in_order[1] == "x 010-****-5***@x.com y"
    assert by_range[2] == in_order[2]


def test_ranges_point_at_what_they_replace(docs_of):
    text = "첫 줄 😀\n전화 010-1234-5678, a.b@c.de\n끝 900101-1234567"
    got = rows(pii.pii_ranges(docs_of(text)), "start", "end", "type")
    assert [text[s:e] for s, e, _ in sorted(got)] == ["010-1234-5678", "a.b@c.de", "900101-1234567"]


def test_nothing_raw_is_left_after_redaction(docs_of):
    audit = rows(pii.residual_pii(pii.redact(docs_of(NOTICE))), "raw_kinds", "has_mask", "pass")
    assert audit == [(0, True, True)]
    assert rows(pii.residual_pii(docs_of(NOTICE)), "raw_kinds", "pass") == [(3, False)]


def test_reports_hold_no_raw_value(spark, docs_of):
    merged = pii.merge_findings(
        pii.detect_pii(docs_of(NOTICE, NOTICE.replace("010-1234", "011-9999"))).selectExpr("*", "'s' AS source"),
        ["source"],
    )
    report = pii.redaction_report(merged, ["source"]).collect()[0]
    assert report.total == 8
    assert not re.search(r"1234567|9012|1234-5678\b(?!-)", report.report)
    assert "전화번호: 2건 → 010-****-5678, 011-****-5678" in report.report


def test_a_busy_group_is_whole(spark):
    """One source with most rows, one value repeated in all of them."""
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, 'hot', 's' || id) AS source",
        "'same@x.com u' || (id % 7) || '@y.com' AS text",
    )
    merged = pii.merge_findings(pii.detect_pii(docs, keep=["source"]), ["source"])
    hot = merged.filter("source = 'hot'").collect()[0]
    assert hot["count"] == 2000
    assert hot.masked == ["s***@x.com", "u***@y.com"]


def test_warning_is_appended(spark):
    proposals = spark.createDataFrame(
        [(1, "call 010-1234-5678", ["w"]), (2, "nothing", None)], "id int, diff string, warnings array<string>"
    )
    got = {r.id: r.warnings for r in pii.proposal_pii_warnings(proposals).collect()}
    assert got[1][0] == "w" and "전화번호 1건" in got[1][1]
    assert got[2] == []


def test_rows_without_a_source_are_reported(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "x"), (2, "c@d.co", None)], "doc_id long, text string, source string")
    merged = pii.merge_findings(pii.detect_pii(docs, keep=["source"]), ["source"])
    assert rows(merged, "source", "count") == [("x", 1), (None, 1)] or rows(merged, "source", "count") == [(None, 1), ("x", 1)]
    assert pii.redaction_report(merged, ["source"]).count() == 2
