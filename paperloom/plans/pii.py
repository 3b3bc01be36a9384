"""Personal data in whole documents, as they are and with contact blocks added."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import pii as op
from paperloom.plans import derived as d
from paperloom.plans.registry import query

_EMAIL = r"\b[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}\b"
_ASIS = "contacts AS (SELECT doc_id, source, text FROM documents)"


def hits_sql(base: str) -> str:
    """All matches of every type. A number matches when it is a whole run of digits and hyphens."""
    return f"""{base},
    runs AS (
      SELECT doc_id, source, unnest(regexp_extract_all(text, '[0-9-]+')) AS m,
        generate_subscripts(regexp_extract_all(text, '[0-9-]+'), 1) AS i
      FROM contacts),
    hits AS (
      SELECT doc_id, source, i, m, 0 AS k, '주민등록번호' AS type FROM runs
        WHERE regexp_full_match(m, '\\d{{6}}-[1-4]\\d{{6}}')
      UNION ALL SELECT doc_id, source, i, m, 1, '신용카드번호' FROM runs
        WHERE regexp_full_match(m, '\\d{{4}}-\\d{{4}}-\\d{{4}}-\\d{{4}}')
      UNION ALL SELECT doc_id, source, i, m, 2, '전화번호' FROM runs
        WHERE regexp_full_match(m, '0\\d{{1,2}}-\\d{{3,4}}-\\d{{4}}')
      UNION ALL SELECT doc_id, source, generate_subscripts(regexp_extract_all(text, '{_EMAIL}'), 1),
        unnest(regexp_extract_all(text, '{_EMAIL}')), 3, '이메일' FROM contacts),
    masked AS (
      SELECT *, CASE k WHEN 0 THEN m[1:8] || '******'
        WHEN 1 THEN m[1:4] || '-****-****-' || m[-4:]
        WHEN 2 THEN split_part(m, '-', 1) || '-' || repeat('*', length(split_part(m, '-', 2)))
          || '-' || split_part(m, '-', 3)
        ELSE m[1] || '***@' || split_part(m, '@', 2) END AS mk
      FROM hits),
    uniq AS (
      SELECT doc_id, source, k, type, m, any_value(mk) AS mk, min(i) AS i
      FROM masked GROUP BY doc_id, source, k, type, m),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM uniq),
    examples AS (
      SELECT doc_id, k, string_agg(mk, ', ' ORDER BY rn) AS masked
      FROM ranked WHERE rn <= 5 GROUP BY doc_id, k),
    findings AS (
      SELECT h.doc_id, h.source, h.k, h.type, count(*) AS count, any_value(e.masked) AS masked
      FROM hits h JOIN examples e ON h.doc_id = e.doc_id AND h.k = e.k
      GROUP BY h.doc_id, h.source, h.k, h.type)
    """


_DETECT = "SELECT doc_id, type, count, masked FROM findings"


def _shown(findings):
    return findings.select(
        "doc_id", "type", F.col("count").cast("bigint").alias("count"), F.array_join("masked", ", ").alias("masked")
    )


@query("detect_pii", f"WITH {hits_sql(_ASIS)} {_DETECT}")
def detect_pii(spark, sf_dir):
    return _shown(op.detect_pii(d.documents(spark, sf_dir)))


@query("detect_pii_contacts", f"WITH {hits_sql(d.CONTACTS_SQL)} {_DETECT}")
def detect_pii_contacts(spark, sf_dir):
    return _shown(op.detect_pii(d.contacts(spark, sf_dir)))


@query(
    "pii_summary",
    f"""WITH {hits_sql(d.CONTACTS_SQL)},
    s AS (SELECT doc_id, string_agg(type || ' ' || count || '건', ', ' ORDER BY k) AS s
      FROM findings GROUP BY doc_id)
    SELECT c.doc_id, coalesce(s, '') AS summary FROM contacts c LEFT JOIN s ON c.doc_id = s.doc_id""",
)
def pii_summary(spark, sf_dir):
    return op.summarize_pii(d.contacts(spark, sf_dir))


_MERGED = """,
    m1 AS (SELECT source, k, type, sum(count)::bigint AS count, min(doc_id) AS first_seen
      FROM findings GROUP BY source, k, type),
    m2 AS (SELECT source, k, mk, min(doc_id * 10 + rn) AS pos FROM ranked WHERE rn <= 5
      GROUP BY source, k, mk),
    m3 AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY pos) AS r FROM m2),
    m4 AS (SELECT source, k, string_agg(mk, ', ' ORDER BY r) AS masked,
        string_agg(CASE WHEN r <= 3 THEN mk END, ', ' ORDER BY r) AS masked3
      FROM m3 WHERE r <= 5 GROUP BY source, k),
    merged AS (SELECT m1.*, m4.masked, m4.masked3 FROM m1 JOIN m4 USING (source, k))
"""


@query(
    "pii_by_source",
    f"WITH {hits_sql(_ASIS)}{_MERGED} SELECT source, type, count, masked FROM merged",
)
def pii_by_source(spark, sf_dir):
    found = op.detect_pii(d.documents(spark, sf_dir, "source"), keep=["source"])
    return op.merge_findings(found, ["source"]).select(
        "source", "type", "count", F.array_join("masked", ", ").alias("masked")
    )


@query(
    "pii_by_source_contacts",
    f"WITH {hits_sql(d.CONTACTS_SQL)}{_MERGED} SELECT source, type, count, masked FROM merged",
)
def pii_by_source_contacts(spark, sf_dir):
    found = op.detect_pii(d.contacts(spark, sf_dir, "source"), keep=["source"])
    return op.merge_findings(found, ["source"]).select(
        "source", "type", "count", F.array_join("masked", ", ").alias("masked")
    )


@query(
    "redaction_report",
    f"""WITH {hits_sql(d.CONTACTS_SQL)}{_MERGED}
    SELECT source, sum(count)::bigint AS total,
      '개인정보 ' || sum(count) || '건 비식별 처리' || chr(10) || string_agg(
        '- ' || type || ': ' || count || '건 → ' || masked3, chr(10) ORDER BY first_seen, k) AS report
    FROM merged GROUP BY source""",
)
def redaction_report(spark, sf_dir):
    found = op.detect_pii(d.contacts(spark, sf_dir, "source"), keep=["source"])
    return op.redaction_report(op.merge_findings(found, ["source"]), ["source"])


def _twice(inner: str, pattern: str, replacement: str) -> str:
    """A neighbour character is consumed by each match, so a second pass finds the rest."""
    once = f"regexp_replace({inner}, '{pattern}', '{replacement}', 'g')"
    return f"regexp_replace({once}, '{pattern}', '{replacement}', 'g')"


def redact_sql(col: str) -> str:
    edge, end = "(^|[^0-9-])", "($|[^0-9-])"
    s = _twice(col, edge + r"(\d{6}-[1-4])\d{6}" + end, r"\1\2******\3")
    s = _twice(s, edge + r"(\d{4})-\d{4}-\d{4}-(\d{4})" + end, r"\1\2-****-****-\3\4")
    s = _twice(s, edge + r"(0\d{1,2})-\d{3}-(\d{4})" + end, r"\1\2-***-\3\4")
    s = _twice(s, edge + r"(0\d{1,2})-\d{4}-(\d{4})" + end, r"\1\2-****-\3\4")
    mail = (
        r"\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{0,63}@((?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24})\b"
    )
    return f"regexp_replace({s}, '{mail}', '\\1***@\\2', 'g')"


@query("redact", f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def redact(spark, sf_dir):
    return op.redact(d.documents(spark, sf_dir))


@query(
    "redact_contacts",
    f"WITH {d.CONTACTS_SQL} SELECT doc_id, {redact_sql('text')} AS text FROM contacts",
)
def redact_contacts(spark, sf_dir):
    return op.redact(d.contacts(spark, sf_dir))


_RANGES_SQL = f"""{d.CONTACTS_SQL},
    pieces AS (
      SELECT doc_id, 0 AS g, unnest(regexp_extract_all(text, '[0-9-]+')) AS m,
        generate_subscripts(regexp_extract_all(text, '[0-9-]+'), 1) AS i,
        string_split_regex(text, '[0-9-]+') AS parts FROM contacts
      UNION ALL
      SELECT doc_id, 1, unnest(regexp_extract_all(text, '{_EMAIL}')),
        generate_subscripts(regexp_extract_all(text, '{_EMAIL}'), 1),
        string_split_regex(text, '{_EMAIL}') FROM contacts),
    placed AS (
      SELECT doc_id, g, m, i, (sum(length(parts[i])) OVER w + sum(length(m)) OVER w)::int AS e
      FROM pieces WINDOW w AS (PARTITION BY doc_id, g ORDER BY i)),
    typed AS (
      SELECT doc_id, e - length(m) AS s, e, m, CASE WHEN g = 1 THEN 3
        WHEN regexp_full_match(m, '\\d{{6}}-[1-4]\\d{{6}}') THEN 0
        WHEN regexp_full_match(m, '\\d{{4}}-\\d{{4}}-\\d{{4}}-\\d{{4}}') THEN 1
        WHEN regexp_full_match(m, '0\\d{{1,2}}-\\d{{3,4}}-\\d{{4}}') THEN 2 END AS k
      FROM placed),
    ordered AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, k) AS rn
      FROM typed WHERE k IS NOT NULL),
    kept AS (
      WITH RECURSIVE walk AS (
        SELECT doc_id, rn, s, e, k, m, true AS keep, e AS last_end FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.doc_id, o.rn, o.s, o.e, o.k, o.m, o.s >= w.last_end,
          CASE WHEN o.s >= w.last_end THEN o.e ELSE w.last_end END
        FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
      SELECT * FROM walk WHERE keep),
    ranges AS (
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY rn))::int AS range_no,
        s AS start, e AS "end", CASE k WHEN 0 THEN '주민등록번호' WHEN 1 THEN '신용카드번호'
          WHEN 2 THEN '전화번호' ELSE '이메일' END AS type,
        CASE k WHEN 0 THEN m[1:8] || '******' WHEN 1 THEN m[1:4] || '-****-****-' || m[-4:]
          WHEN 2 THEN split_part(m, '-', 1) || '-' || repeat('*', length(split_part(m, '-', 2)))
            || '-' || split_part(m, '-', 3)
          ELSE m[1] || '***@' || split_part(m, '@', 2) END AS replacement
      FROM kept)
"""


@query("pii_ranges", f"WITH {_RANGES_SQL} SELECT * FROM ranges")
def pii_ranges(spark, sf_dir):
    return op.pii_ranges(d.contacts(spark, sf_dir))


@query(
    "redact_by_ranges",
    f"""WITH {_RANGES_SQL},
    j AS (
      SELECT r.doc_id, range_no, substr(text, coalesce(lag("end") OVER w, 0) + 1,
          start - coalesce(lag("end") OVER w, 0)) || replacement AS part,
        substr(text, "end" + 1) AS tail
      FROM ranges r JOIN contacts c ON r.doc_id = c.doc_id
      WINDOW w AS (PARTITION BY r.doc_id ORDER BY range_no)),
    g AS (SELECT doc_id, string_agg(part, '' ORDER BY range_no) || arg_max(tail, range_no) AS t
      FROM j GROUP BY doc_id)
    SELECT c.doc_id, coalesce(g.t, c.text) AS text FROM contacts c LEFT JOIN g ON c.doc_id = g.doc_id""",
)
def redact_by_ranges(spark, sf_dir):
    return op.redact_by_ranges(d.contacts(spark, sf_dir))


def _residual_sql(col: str) -> str:
    raw = " + ".join(
        f"regexp_matches({col}, '{p}')::int"
        for p in (
            r"\b\d{6}-[1-4]\d{6}\b",
            r"\b0\d{1,2}-\d{3,4}-\d{4}\b",
            r"\b\d{4}-\d{4}-\d{4}-\d{4}\b",
        )
    )
    return f"doc_id, {raw} AS raw_kinds, regexp_matches({col}, '\\*{{3,}}') AS has_mask"


@query(
    "residual_pii",
    f"""WITH {d.CONTACTS_SQL},
    r AS (SELECT doc_id, {redact_sql('text')} AS text FROM contacts),
    a AS (SELECT {_residual_sql('text')} FROM r)
    SELECT *, raw_kinds = 0 AND has_mask AS pass FROM a""",
)
def residual_pii(spark, sf_dir):
    return op.residual_pii(op.redact(d.contacts(spark, sf_dir)))


@query(
    "residual_pii_census",
    f"""WITH {d.CONTACTS_SQL},
    a AS (SELECT {_residual_sql('text')} FROM contacts)
    SELECT raw_kinds = 0 AND has_mask AS pass, count(*) AS n FROM a GROUP BY 1""",
)
def residual_pii_census(spark, sf_dir):
    audit = op.residual_pii(d.contacts(spark, sf_dir))
    return audit.groupBy("pass").agg(F.count("*").alias("n"))


@query(
    "proposal_pii_warnings",
    f"""WITH {hits_sql(d.CONTACTS_SQL)},
    s AS (SELECT doc_id, string_agg(type || ' ' || count || '건', ', ' ORDER BY k) AS s
      FROM findings GROUP BY doc_id)
    SELECT c.doc_id, 'unsaved' || coalesce(' | 개인정보 포함: 이번 변경 영역에 ' || s
      || '이(가) 있습니다. 외부 공유 시 주의하세요.', '') AS warnings
    FROM contacts c LEFT JOIN s ON c.doc_id = s.doc_id""",
)
def proposal_pii_warnings(spark, sf_dir):
    proposals = d.contacts(spark, sf_dir).select(
        "doc_id", F.col("text").alias("diff"), F.array(F.lit("unsaved")).alias("warnings")
    )
    return op.proposal_pii_warnings(proposals).select(
        "doc_id", F.array_join("warnings", " | ").alias("warnings")
    )
