"""Structure profiles, forms, hygiene and lint rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.text import WS
from paperloom.operators import cells as co
from paperloom.operators import profile as op
from paperloom.operators import structure
from paperloom.plans import derived as d
from paperloom.plans.compare import section_xml
from paperloom.plans.registry import query
from paperloom.plans.structure import MD_BLOCKS_SQL, MD_CELLS_SQL
from paperloom.sources.tables import load, load_wide

_REPORT = f"^{WS}*[□■○●◦▪▫·ㆍ\\-–]{WS}"
_LEGAL = f"^{WS}*(?:[0-9]+\\.|[가-힣]\\.|[0-9]+\\)|[①-⑮]|[ⅰ-ⅹ]\\.?){WS}"
_STYLE_SQL = f"""
    marks AS (SELECT doc_id, count(*) FILTER (regexp_matches(text, '{_REPORT}')) AS report_marks,
        count(*) FILTER (NOT regexp_matches(text, '{_REPORT}') AND regexp_matches(text, '{_LEGAL}')) AS legal_marks
      FROM blocks GROUP BY doc_id),
    styles AS (SELECT *, CASE WHEN report_marks > legal_marks AND report_marks >= 2 THEN '{op.REPORT_STYLE}'
        WHEN legal_marks > report_marks AND legal_marks >= 2 THEN '{op.LEGAL_STYLE}' ELSE '{op.NO_STYLE}' END AS style
      FROM marks)
"""


@query("numbering_style", f"WITH {MD_BLOCKS_SQL}, {_STYLE_SQL} SELECT * FROM styles")
def numbering_style(spark, sf_dir):
    return op.numbering_style(structure.blocks(d.markdown(spark, sf_dir)))


_FP_SQL = f"""{MD_CELLS_SQL}, {_STYLE_SQL},
    types AS (SELECT doc_id, type, count(*) AS n, min(block_no) AS f FROM blocks GROUP BY ALL),
    hist AS (SELECT doc_id, string_agg(type || ' ' || n, ', ' ORDER BY f) AS histogram,
        (coalesce(sum(n) FILTER (type = 'list'), 0))::bigint AS list_count FROM types GROUP BY doc_id),
    heads AS (SELECT doc_id, string_agg('H' || level || ' ' || text, chr(10) ORDER BY block_no) AS headings,
        string_agg('  ' || repeat('  ', level - 1) || 'H' || level || ' ' || substr(text, 1, 50), chr(10)
          ORDER BY block_no) AS shown, count(*) AS hn
      FROM blocks WHERE type = 'heading' GROUP BY doc_id),
    shapes AS (SELECT doc_id, table_idx, max(row + row_span) AS rows, max(col + col_span) AS cols,
        bool_or(is_header) AS h FROM md_cells GROUP BY ALL),
    tabs AS (SELECT doc_id, string_agg(rows || '×' || cols || CASE WHEN h THEN '+' ELSE '' END, ', ' ORDER BY table_idx)
        AS tables, count(*) AS tn FROM shapes GROUP BY doc_id),
    tnum AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY table_idx) AS i FROM shapes),
    tshown AS (SELECT doc_id, string_agg('#' || i || ' ' || rows || '×' || cols || CASE WHEN h THEN '(머리행)' ELSE '' END,
        ', ' ORDER BY i) AS tshown FROM tnum GROUP BY doc_id),
    fp AS (SELECT hist.doc_id, histogram, coalesce(headings, '') AS headings, coalesce(tables, '') AS tables, list_count,
        style AS numbering_style, shown, hn, tshown, tn
      FROM hist JOIN styles USING (doc_id) LEFT JOIN heads USING (doc_id) LEFT JOIN tabs USING (doc_id)
      LEFT JOIN tshown USING (doc_id))
"""


def _fingerprints(spark, sf_dir, keep=None):
    blocks = structure.blocks(d.markdown(spark, sf_dir))
    if keep is not None:
        blocks = blocks.filter(keep)
    return op.fingerprint(blocks, structure.table_cells(blocks))


@query(
    "fingerprint",
    f"WITH {_FP_SQL} SELECT doc_id, histogram, headings, tables, list_count, numbering_style FROM fp",
)
def fingerprint(spark, sf_dir):
    one = lambda x: F.concat(x["type"], F.lit(" "), x["n"].cast("string"))
    head = lambda x: F.concat(F.lit("H"), x["level"].cast("string"), F.lit(" "), x["text"])
    shape = lambda x: F.concat(
        x["rows"].cast("string"), F.lit("×"), x["cols"].cast("string"), F.when(x["has_header"], "+").otherwise("")
    )
    return _fingerprints(spark, sf_dir).select(
        "doc_id",
        F.array_join(F.transform("histogram", one), ", ").alias("histogram"),
        F.array_join(F.transform("headings", head), "\n").alias("headings"),
        F.array_join(F.transform("tables", shape), ", ").alias("tables"),
        "list_count",
        "numbering_style",
    )


@query(
    "format_template",
    f"""WITH {_FP_SQL} SELECT doc_id, concat_ws(chr(10), '- 블록 구성: ' || histogram,
      '- 항목부호 체계(추정): ' || numbering_style, '- 제목 계층(' || hn || '):' || chr(10) || shown,
      '- 표(' || tn || '): ' || tshown) AS template FROM fp""",
)
def format_template(spark, sf_dir):
    return op.format_template(_fingerprints(spark, sf_dir)).drop("json")


@query(
    "corpus_templates",
    f"""WITH {_FP_SQL}
    SELECT count(*) AS documents, min(doc_id) AS first_doc
    FROM fp GROUP BY histogram, headings, tables, numbering_style""",
)
def corpus_templates(spark, sf_dir):
    return op.corpus_templates(_fingerprints(spark, sf_dir)).drop("template_hash")


@query(
    "fingerprint_drift",
    f"""WITH {MD_CELLS_SQL},
    ab AS (SELECT * FROM blocks WHERE (doc_id + block_no) % 13 <> 0),
    ac AS (SELECT c.* FROM md_cells c JOIN ab ON c.doc_id = ab.doc_id AND c.table_idx = ab.table_idx),
    n AS (SELECT doc_id, count(*) FILTER (type = 'table') AS bt, count(*) FILTER (type = 'heading') AS bh,
        count(*) FILTER (type = 'table' AND (doc_id + block_no) % 13 <> 0) AS ta,
        count(*) FILTER (type = 'heading' AND (doc_id + block_no) % 13 <> 0) AS ah,
        count(*) FILTER ((doc_id + block_no) % 13 <> 0) AS alive FROM blocks GROUP BY doc_id),
    s AS (SELECT doc_id, CASE WHEN alive = 0 THEN '문서 없음' END AS g, CASE WHEN ta < bt THEN '표 ' || bt || '→' || ta END AS t,
        CASE WHEN ah < bh THEN '제목 ' || bh || '→' || ah END AS h FROM n)
    SELECT doc_id, coalesce(g, t, h) IS NOT NULL AS drift, concat_ws('; ', g, t, h) AS details FROM s""",
)
def fingerprint_drift(spark, sf_dir):
    return op.fingerprint_drift(
        _fingerprints(spark, sf_dir), _fingerprints(spark, sf_dir, "(doc_id + block_no) % 13 <> 0")
    )


@query(
    "grid_drift",
    f"""WITH {d.CELLS_SQL},
    n AS (SELECT doc_id, count(DISTINCT table_idx) AS tn FROM cells GROUP BY doc_id)
    SELECT doc_id, doc_id % 3 = 0 AS drift, CASE WHEN doc_id % 3 = 0 THEN '표 1 격자 4×4→5×4'
      || CASE WHEN tn = 2 THEN '; 표 2 격자 4×4→5×4' ELSE '' END ELSE '' END AS details FROM n""",
)
def grid_drift(spark, sf_dir):
    cells = d.order_cells(spark, sf_dir).withColumn("is_header", F.lit(False))
    blocks = cells.select("doc_id", "table_idx").distinct().select(
        "doc_id",
        (F.col("table_idx") + 1).alias("block_no"),
        F.lit("table").alias("type"),
        F.lit(None).cast("int").alias("level"),
        F.lit("").alias("text"),
        F.lit(False).alias("is_footnote"),
    )
    grown = cells.withColumn("row", F.expr("if(doc_id % 3 = 0, row + 1, row)"))
    return op.fingerprint_drift(op.fingerprint(blocks, cells), op.fingerprint(blocks, grown))


# Three controls per customer as section XML.
_FORM_SQL = """
fo AS (
  SELECT c_custkey AS doc_id, 0 AS idx, '성명<입력>' AS name, 'edit' AS type,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || ' & co' END AS value_text,
    NULL::boolean AS value_bool, '' AS combo_items FROM customer
  UNION ALL SELECT c_custkey, 1, '부서', 'comboBox', c_mktsegment, NULL, 'BUILDING,HOUSEHOLD,' || c_nationkey FROM customer
  UNION ALL SELECT c_custkey, 2, '동의', 'checkBox', NULL, c_custkey % 2 = 0, '' FROM customer
  UNION ALL SELECT c_custkey, 3, CASE WHEN c_custkey % 5 = 0 THEN '동의' ELSE '확인' END, 'button', '눌러', NULL, '' FROM customer)
"""


def _form_xml(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.expr(
            """'<hs:sec><hp:p><hp:edit groupName="" name="성명&lt;입력&gt;"><hp:x/>'
            || if(c_custkey % 3 = 0, '<hp:text/>', '<hp:text>' || c_name || ' &amp; co</hp:text>') || '</hp:edit>'
            || '<hp:comboBox selectedValue="' || c_mktsegment || '" name="부서">'
            || '<hp:listItem displayText="x" value="BUILDING"/><hp:listItem displayText="" value="HOUSEHOLD"/>'
            || '<hp:listItem displayText="" value="' || c_nationkey || '"/></hp:comboBox>'
            || '<hp:checkBtn caption="c" value="' || if(c_custkey % 2 = 0, 'CHECKED', 'UNCHECKED')
            || '" name="동의"></hp:checkBtn><hp:btn caption="눌러" name="'
            || if(c_custkey % 5 = 0, '동의', '확인') || '"></hp:btn></hp:p></hs:sec>'"""
        ).alias("xml"),
    )


@query("form_inventory", f"WITH {_FORM_SQL} SELECT * FROM fo")
def form_inventory(spark, sf_dir):
    return op.form_inventory(_form_xml(spark, sf_dir)).withColumn(
        "combo_items", F.coalesce(F.array_join("combo_items", ","), F.lit(""))
    )


@query(
    "form_type_census",
    f"WITH {_FORM_SQL} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM fo GROUP BY type",
)
def form_type_census(spark, sf_dir):
    return op.form_inventory(_form_xml(spark, sf_dir)).groupBy("type").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")
    )


_FORM_EDITS_SQL = f"""{_FORM_SQL},
    fe AS (
      SELECT c_custkey AS doc_id, 1 AS edit_no, '성명<입력>' AS name, NULL::int AS idx, 'text' AS set_key,
        '홍길동' AS set_text, NULL::boolean AS set_bool, CASE WHEN c_custkey % 4 = 0 THEN '' END AS expected_text FROM customer
      UNION ALL SELECT c_custkey, 2, '부서', NULL, CASE WHEN c_custkey % 7 = 0 THEN 'caption' ELSE 'selected' END,
        'BUILDING', NULL, NULL FROM customer WHERE c_custkey % 2 = 1
      UNION ALL SELECT c_custkey, 3, '동의', CASE WHEN c_custkey % 10 = 0 THEN 2 END, 'checked', NULL, true, NULL
        FROM customer WHERE c_custkey % 3 <> 1
      UNION ALL SELECT c_custkey, 4, '부서', NULL, 'selected', 'MACHINERY', NULL, NULL FROM customer WHERE c_custkey % 11 = 0
      UNION ALL SELECT c_custkey, 5, '없음', NULL, 'text', 'x', NULL, NULL FROM customer WHERE c_custkey % 13 = 0),
    fm AS (SELECT e.doc_id, e.edit_no, count(*) AS n, any_value(o.idx) AS o_idx, any_value(type) AS type,
        any_value(value_text) AS vt, any_value(value_bool) AS vb, any_value(combo_items) AS ci
      FROM fe e JOIN fo o ON e.doc_id = o.doc_id AND e.name = o.name AND (e.idx IS NULL OR e.idx = o.idx) GROUP BY ALL),
    fr AS (SELECT e.doc_id, e.edit_no, e.name, set_text, set_bool, n,
        CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous'
          WHEN set_key <> CASE type WHEN 'edit' THEN 'text' WHEN 'comboBox' THEN 'selected' WHEN 'button' THEN 'caption'
            ELSE 'checked' END THEN 'type_mismatch'
          WHEN expected_text <> vt THEN 'value_differs'
          WHEN type = 'comboBox' AND NOT list_contains(string_split(ci, ','), set_text) THEN 'not_an_item'
          ELSE 'ok' END AS status,
        o_idx AS idx, vt, vb
      FROM fe e LEFT JOIN fm ON e.doc_id = fm.doc_id AND e.edit_no = fm.edit_no)
"""


def _form_edits(spark, sf_dir):
    t, b = "cast(null as string)", "cast(null as boolean)"
    return (
        load(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("doc_id"),
            F.expr(
                f"""stack(5,
              1, '성명<입력>', null, 'text', '홍길동', {b}, if(doc_id % 4 = 0, '', {t}), true,
              2, '부서', null, if(doc_id % 7 = 0, 'caption', 'selected'), 'BUILDING', {b}, {t}, doc_id % 2 = 1,
              3, '동의', if(doc_id % 10 = 0, 2, null), 'checked', {t}, true, {t}, doc_id % 3 <> 1,
              4, '부서', null, 'selected', 'MACHINERY', {b}, {t}, doc_id % 11 = 0,
              5, '없음', null, 'text', 'x', {b}, {t}, doc_id % 13 = 0)
              as (edit_no, name, idx, set_key, set_text, set_bool, expected_text, asked)""".replace("doc_id", "c_custkey")
            ),
        )
        .filter("asked")
        .drop("asked")
        .withColumn("expected_bool", F.lit(None).cast("boolean"))
    )


@query(
    "form_edit_results",
    f"""WITH {_FORM_EDITS_SQL} SELECT doc_id, edit_no, name, status,
      CASE WHEN status = 'ambiguous' THEN NULL ELSE idx END AS idx,
      CASE WHEN status = 'ambiguous' THEN NULL ELSE coalesce(vt, vb::varchar) END AS old_value,
      coalesce(set_text, set_bool::varchar) AS new_value FROM fr""",
)
def form_edit_results(spark, sf_dir):
    clear = F.col("status") != "ambiguous"
    out = co.form_edit_results(op.form_inventory(_form_xml(spark, sf_dir)), _form_edits(spark, sf_dir))
    return out.drop("set_text", "set_bool").withColumns(
        {"idx": F.when(clear, F.col("idx")), "old_value": F.when(clear, F.col("old_value"))}
    )


@query(
    "apply_form_edits",
    f"""WITH {_FORM_EDITS_SQL},
    clean AS (SELECT doc_id FROM fr GROUP BY doc_id HAVING bool_and(status = 'ok')),
    last AS (SELECT doc_id, idx, arg_max(struct_pack(t := set_text, b := set_bool), edit_no) AS s
      FROM fr SEMI JOIN clean USING (doc_id) GROUP BY ALL)
    SELECT fo.doc_id, fo.idx, name, type, coalesce(s.t, value_text) AS value_text, coalesce(s.b, value_bool) AS value_bool
    FROM fo LEFT JOIN last ON fo.doc_id = last.doc_id AND fo.idx = last.idx""",
)
def apply_form_edits(spark, sf_dir):
    return co.apply_form_edits(
        op.form_inventory(_form_xml(spark, sf_dir)), _form_edits(spark, sf_dir)
    ).drop("combo_items")


@query(
    "footnote_texts",
    f"""WITH {d.LINES_SQL},
    n AS (SELECT doc_id, line_no, text || '가&' AS text FROM l WHERE line_no % 3 = 0)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::int AS note_no, trim(text) AS text FROM n""",
)
def footnote_texts(spark, sf_dir):
    noted = section_xml(spark, sf_dir).withColumn(
        "xml",
        F.array_join(
            F.transform(
                F.split("xml", "(?=<hp:p )"),
                lambda p, i: F.when(
                    (i % 3 == 0) & (i > 0), F.concat(F.lit("<hp:footNote no=\"1\">"), p, F.lit("</hp:footNote>"))
                ).otherwise(p),
            ),
            "",
        ),
    )
    return op.footnote_texts(noted)


@query("text_facts", "SELECT doc_id, contains(text, 'tion') AS contains_text FROM documents")
def text_facts(spark, sf_dir):
    return op.text_facts(d.documents(spark, sf_dir), "tion")


_ATTR = """([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+))?"""
_HTML = (
    "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),"
    "'(<script\\b[^>]*>).*?</script\\s*>', '\\1', 'gis'), '(<style\\b[^>]*>).*?</style\\s*>', '\\1', 'gis')"
)
_TAG_LIST = ", ".join(f"'{t}'" for t in op.ALLOWED_TAGS)
_ATTR_LIST = " OR ".join(
    f"(tag = '{t}' AND name IN ({', '.join(repr(n) for n in ns)}))" if t != "*"
    else f"name IN ({', '.join(repr(n) for n in ns)})"
    for t, ns in op.ALLOWED_ATTRIBUTES.items()
)
_HYGIENE_SQL = f"""
    raw AS (SELECT page_id, unnest(regexp_extract_all({_HTML}, '<[a-zA-Z][a-zA-Z0-9]*(?:\\s[^>]*)?>')) AS r FROM pages),
    tags AS (SELECT page_id, lower(regexp_extract(r, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
        regexp_extract(r, '<[a-zA-Z][a-zA-Z0-9]*((?:\\s[^>]*)?)>', 1) AS rest FROM raw),
    ar AS (SELECT page_id, tag, unnest(regexp_extract_all(rest, '{_ATTR}')) AS a FROM tags
      WHERE tag IN ({_TAG_LIST}) AND rest <> ''),
    attrs AS (SELECT page_id, tag, lower(regexp_extract(a, '{_ATTR}', 1)) AS name,
        trim(regexp_extract(a, '{_ATTR}', 2), '"''') AS value FROM ar),
    links AS (SELECT *, lower(regexp_extract(value, '^\\s*([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme FROM attrs
      WHERE name IN ('href', 'src') AND ({_ATTR_LIST})),
    bad AS (
      SELECT page_id, 'tag' AS kind, tag AS name FROM tags WHERE tag NOT IN ({_TAG_LIST})
      UNION ALL SELECT page_id, 'attribute', tag || '.' || name FROM attrs WHERE NOT ({_ATTR_LIST})
      UNION ALL SELECT page_id, 'scheme', tag || '.' || scheme FROM links WHERE scheme <> ''
        AND NOT (tag = 'a' AND scheme IN ('http', 'https', 'mailto'))
        AND NOT (tag = 'img' AND scheme IN ('http', 'https', 'data')))
"""


def _pages(spark, sf_dir):
    # Links and attributes outside the lists are rare in the pages; some get a few more.
    extra = """case page_id % 4 when 0 then '<a href="javascript:x()" onclick="y">z</a>'
      when 1 then '<img src="ftp://h/i.png" style="w:1" alt=''q''>' when 2 then '<iframe src=a></iframe>' else '' end"""
    return load_wide(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id", F.concat("html", F.expr(extra)).alias("html")
    )


_PAGES_SQL = """pages AS (SELECT page_id, html || case page_id % 4
      when 0 then '<a href="javascript:x()" onclick="y">z</a>'
      when 1 then '<img src="ftp://h/i.png" style="w:1" alt=''q''>' when 2 then '<iframe src=a></iframe>' else '' end
      AS html FROM main.pages)"""


@query(
    "html_hygiene",
    f"WITH {_PAGES_SQL}, {_HYGIENE_SQL} SELECT page_id, kind, name, count(*) AS n FROM bad GROUP BY ALL",
)
def html_hygiene(spark, sf_dir):
    return op.html_hygiene(_pages(spark, sf_dir))


@query(
    "hygiene_verdict",
    f"""WITH {_HYGIENE_SQL},
    c AS (SELECT page_id, count(*) FILTER (kind = 'tag') AS bad_tags, count(*) FILTER (kind = 'attribute') AS
      bad_attributes, count(*) FILTER (kind = 'scheme') AS bad_schemes FROM bad GROUP BY page_id)
    SELECT page_id, coalesce(bad_tags, 0) AS bad_tags, coalesce(bad_attributes, 0) AS bad_attributes,
      coalesce(bad_schemes, 0) AS bad_schemes, bad_tags IS NULL AS clean FROM pages LEFT JOIN c USING (page_id)""",
)
def hygiene_verdict(spark, sf_dir):
    return op.hygiene_verdict(load_wide(spark, sf_dir, "pages", "page_id", "html"))


_LINT = "text || case doc_id % 4 when 0 then ' 2026. 01. 01.' when 1 then ' 2026-01-01' when 2 then ' 1500000원' else '' end"


@query(
    "lint_flags",
    f"""WITH t AS (SELECT doc_id, {_LINT} AS text FROM documents)
    SELECT doc_id, 'dates' AS rule, NOT regexp_matches(text, '[0-9]{{4}}년\\s*[0-9]+월\\s*[0-9]+일')
      AND NOT regexp_matches(text, '\\b[0-9]{{2}}\\.[0-9]{{1,2}}\\.[0-9]{{1,2}}\\b')
      AND NOT regexp_matches(text, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b')
      AND regexp_matches(text, '[0-9]{{4}}\\.\\s*[0-9]{{2}}\\.\\s*[0-9]{{2}}\\.') AS pass FROM t
    UNION ALL SELECT doc_id, 'commas', NOT regexp_matches(text, '(^|[^0-9,.])[0-9]{{4,}}원') FROM t
    UNION ALL SELECT doc_id, 'rename The', NOT contains(text, 'The') AND contains(text, 'the') FROM t""",
)
def lint_flags(spark, sf_dir):
    docs = d.documents(spark, sf_dir).select("doc_id", F.expr(_LINT).alias("text"))
    return op.lint_flags(docs, [("The", "the")])


@query(
    "numeric_consistency",
    """WITH o AS (SELECT o_orderkey // 4 AS doc_id, floor(o_totalprice)::bigint AS v, o_orderkey % 29 = 7 AS bad FROM orders),
    s AS (SELECT doc_id, sum(v) FILTER (NOT bad) AS read, sum(v) + CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END AS said,
      count(*) FILTER (bad) AS bad FROM o GROUP BY doc_id),
    t AS (SELECT doc_id, read, CASE WHEN doc_id % 11 <> 4 THEN said END AS said,
      CASE WHEN bad > 0 THEN 'unreadable' WHEN doc_id % 11 = 4 THEN 'no_total'
        WHEN doc_id % 5 = 0 THEN 'differs' ELSE 'consistent' END AS status FROM s)
    SELECT doc_id, 0 AS table_idx, read::bigint AS column_sum, said::bigint AS stated_total,
      status = 'consistent' AS consistent, status FROM t""",
)
def numeric_consistency(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 4").alias("doc_id"),
        F.expr("cast(o_orderkey % 4 + 1 as int)").alias("row"),
        F.expr("cast(floor(o_totalprice) as bigint)").alias("v"),
        F.expr("o_orderkey % 29 = 7").alias("bad"),
    )
    totals = orders.groupBy("doc_id").agg(F.sum("v").alias("t"))
    body = orders.select(
        "doc_id", F.lit(0).alias("table_idx"), "row",
        F.expr("stack(2, 0, '항목', 1, if(bad, '1억', format_number(v, 0) || if(v % 2 = 0, '원', ''))) as (col, text)"),
    )
    head = totals.select(
        "doc_id", F.lit(0).alias("table_idx"), F.lit(0).alias("row"),
        F.expr("stack(2, 0, '항목', 1, '금액') as (col, text)"),
    )
    docs = totals.select(
        "doc_id",
        F.expr("if(doc_id % 11 = 4, '합계: 없음', '합계: 총액은 ' || (t + if(doc_id % 5 = 0, 10, 0)) || '원입니다.')").alias("text"),
    )
    return op.numeric_consistency(body.unionByName(head), docs)
