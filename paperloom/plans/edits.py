"""Text, cell, sheet and form edits over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import cells as co
from paperloom.operators import dictionary
from paperloom.operators import edits as op
from paperloom.plans import derived as d
from paperloom.plans.registry import query
from paperloom.plans.search import LABEL_REQUESTS_SQL, label_requests
from paperloom.sources.tables import load, load_wide

_FIND, _NEW = "ation", "[$1\\]"
_ALL_SQL = f"regexp_replace(text, '{_FIND}', '[$1\\\\]', 'gi')"


def _count_sql(col: str, find: str) -> str:
    return f"((length({col}) - length(replace({col}, '{find}', ''))) // {len(find)})::int"


@query(
    "find_replace_all",
    f"SELECT doc_id, {_ALL_SQL} AS text, {_count_sql('lower(text)', _FIND)} AS replaced FROM documents",
)
def find_replace_all(spark, sf_dir):
    return op.find_replace(d.documents(spark, sf_dir), _FIND, _NEW)


@query(
    "find_replace_first",
    f"""SELECT doc_id, regexp_replace(text, '{_FIND}', '[$1\\\\]', 'i') AS text,
      contains(lower(text), '{_FIND}')::int AS replaced FROM documents""",
)
def find_replace_first(spark, sf_dir):
    return op.find_replace(d.documents(spark, sf_dir), _FIND, _NEW, every=False)


@query(
    "find_replace_cased",
    f"SELECT doc_id, replace(text, 'The', 'A') AS text, {_count_sql('text', 'The')} AS replaced FROM documents",
)
def find_replace_cased(spark, sf_dir):
    return op.find_replace(d.documents(spark, sf_dir), "The", "A", case_sensitive=True)


@query(
    "rename_terms",
    f"""WITH a AS (SELECT doc_id, {_count_sql('text', 'tion')} AS n, replace(text, 'tion', 'sion') AS text
      FROM documents),
    b AS (SELECT doc_id, n + {_count_sql('text', 'sions')} AS n, replace(text, 'sions', 's') AS text FROM a)
    SELECT doc_id, n + {_count_sql('text', 'ent')} AS replaced, replace(text, 'ent', '') AS text FROM b""",
)
def rename_terms(spark, sf_dir):
    return op.rename_terms(
        d.documents(spark, sf_dir), [("tion", "sion"), ("sions", "s"), ("ent", "")]
    )


# Words of five characters or more and pairs of words of the benchmark, put into brackets. The SQL runs
# its one long pattern once, over all texts in a row.
@query(
    "rename_dictionary",
    """WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark),
    terms AS (SELECT find FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS find FROM w
      UNION SELECT unnest(w) FROM w) WHERE length(find) >= 5),
    p AS (SELECT string_agg(regexp_escape(find), '|' ORDER BY length(find) DESC, find) AS pattern FROM terms),
    whole AS (SELECT list(doc_id ORDER BY doc_id) AS ids, string_agg(text, chr(1) ORDER BY doc_id) AS text FROM documents),
    done AS (SELECT unnest(ids) AS doc_id, unnest(string_split(regexp_replace(text, pattern, '⟨\\0⟩', 'g'), chr(1))) AS text FROM whole, p)
    SELECT doc_id, text, (length(text) - length(replace(text, '⟨', '')))::int AS replaced FROM done""",
)
def rename_dictionary(spark, sf_dir):
    words = load(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    find = words.select(F.explode(F.concat("w", pairs)).alias("find")).filter("length(find) >= 5").distinct()
    terms = find.withColumn("replace", F.concat(F.lit("⟨"), "find", F.lit("⟩")))
    return dictionary.rename_dictionary(d.documents(spark, sf_dir).select("doc_id", "text"), terms)


def _edited_pairs(spark, sf_dir):
    docs = d.documents(spark, sf_dir)
    after = op.replaced(F.col("text"), _FIND, "XYZ", False, True)
    return docs.select("doc_id", F.col("text").alias("before"), after.alias("after"))


@query(
    "change_snippets",
    f"""WITH {d.LINES_SQL},
    p AS (SELECT doc_id, line_no, text AS b, regexp_replace(text, '{_FIND}', 'XYZ', 'gi') AS a FROM l),
    c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::int AS sample_no
      FROM p WHERE a <> b),
    x AS (SELECT *,
        len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[:i] = b[:i])) AS pre
      FROM c),
    y AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) - pre + 1),
        lambda i: right(a, i::int) = right(b, i::int))) AS suf FROM x)
    SELECT doc_id, sample_no, line_no,
      (CASE WHEN pre > 24 THEN '…' ELSE '' END)
        || substr(b, greatest(0, pre - 24) + 1, least(length(b), length(b) - suf + 24) - greatest(0, pre - 24))
        || (CASE WHEN suf > 24 THEN '…' ELSE '' END) AS before,
      (CASE WHEN pre > 24 THEN '…' ELSE '' END)
        || substr(a, greatest(0, pre - 24) + 1, least(length(a), length(a) - suf + 24) - greatest(0, pre - 24))
        || (CASE WHEN suf > 24 THEN '…' ELSE '' END) AS after
    FROM y""",
)
def change_snippets(spark, sf_dir):
    return op.change_snippets(_edited_pairs(spark, sf_dir))


@query(
    "residual_matches",
    f"""WITH r AS (SELECT doc_id, replace(text, '{_FIND}', '') AS text FROM documents)
    SELECT doc_id, {_count_sql('lower(text)', _FIND)} AS remaining FROM r""",
)
def residual_matches(spark, sf_dir):
    done = op.find_replace(d.documents(spark, sf_dir), _FIND, "", case_sensitive=True)
    return op.residual_matches(done, _FIND, "")


@query(
    "overwrite_risk",
    """SELECT doc_id, length(text)::int AS original_length, length(substr(text, 1, 1500))::int AS new_length,
      length(text) >= 2000 AND length(substr(text, 1, 1500)) < length(text) * 0.5 AS at_risk
    FROM documents""",
)
def overwrite_risk(spark, sf_dir):
    return op.overwrite_risk(
        d.documents(spark, sf_dir).select(
            "doc_id", F.col("text").alias("before"), F.substring("text", 1, 1500).alias("after")
        )
    )


@query(
    "normalize_dates",
    """SELECT o_orderkey AS doc_id, '기준일 ' || strftime(o_orderdate, '%Y. %m. %d.') || ' / '
      || CASE WHEN o_orderkey % 3 = 0 THEN '2026-13-45' ELSE strftime(o_orderdate, '%Y. %m. %d.') END AS text
    FROM orders""",
)
def normalize_dates(spark, sf_dir):
    raw = load_wide(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        F.col("o_orderkey").alias("doc_id"),
        F.expr(
            """'기준일 ' || case when o_orderkey % 2 = 0 or year(o_orderdate) < 2000
                 then date_format(o_orderdate, "yyyy년 M월 d일") else date_format(o_orderdate, "yy.M.d") end
               || ' / ' || case when o_orderkey % 3 = 0 then '2026-13-45'
                 else date_format(o_orderdate, "yyyy-MM-dd") end"""
        ).alias("text"),
    )
    return raw.select("doc_id", op.normalized_dates(F.col("text")).alias("text"))


@query(
    "add_commas",
    """SELECT o_orderkey AS doc_id, format('{:,}', floor(o_totalprice)::bigint) AS cell,
      '총액 ' || CASE WHEN floor(o_totalprice)::bigint < 1000 THEN (floor(o_totalprice)::bigint)::varchar
        ELSE format('{:,}', floor(o_totalprice)::bigint) END || '원 (' || o_orderkey || '번)' AS text
    FROM orders""",
)
def add_commas(spark, sf_dir):
    raw = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.expr("cast(cast(floor(o_totalprice) as bigint) as string)").alias("cell"),
    ).withColumn("text", F.expr("'총액 ' || cell || '원 (' || doc_id || '번)'"))
    return raw.select(
        "doc_id", op.add_commas(F.col("cell")).alias("cell"), op.add_commas(F.col("text")).alias("text")
    )


_CELL_EDITS_SQL = f"""{d.CELLS_SQL}, {LABEL_REQUESTS_SQL},
    edits AS (
      SELECT DISTINCT doc_id, 1 AS edit_no, CASE WHEN doc_id % 6 = 5 THEN 9 ELSE 0 END AS table_idx,
        1 AS row, 3 AS col, NULL::varchar AS label, NULL::varchar AS direction, 'edited' AS new_text,
        CASE WHEN doc_id % 4 = 1 THEN '5-LOW' END AS expected_text FROM cells
      UNION ALL
      SELECT doc_id, 2, table_idx, CASE WHEN doc_id % 9 = 0 THEN 1 END, NULL, label, direction,
        'by label', NULL FROM requests WHERE doc_id % 3 = 0
      UNION ALL
      SELECT DISTINCT doc_id, 3, 1, 2, CASE WHEN doc_id % 10 = 7 THEN NULL ELSE 9 END, NULL, NULL,
        'nowhere', NULL FROM cells WHERE doc_id % 10 IN (7, 8)),
    lab AS (SELECT e.doc_id, e.edit_no, count(*) AS n, any_value(c.table_idx) AS t,
        any_value(CASE WHEN e.direction = 'right' THEN c.row ELSE c.row + row_span END) AS tr,
        any_value(CASE WHEN e.direction = 'right' THEN c.col + col_span ELSE c.col END) AS tc
      FROM edits e JOIN cells c ON e.doc_id = c.doc_id AND trim(e.label) = c.text
        AND (e.table_idx IS NULL OR e.table_idx = c.table_idx)
      WHERE e.label IS NOT NULL AND e.row IS NULL GROUP BY ALL),
    lab2 AS (SELECT lab.*, c.doc_id IS NOT NULL AS there FROM lab LEFT JOIN cells c
      ON lab.doc_id = c.doc_id AND t = c.table_idx AND tr = c.row AND tc = c.col),
    placed AS (
      SELECT e.doc_id, e.edit_no, new_text, expected_text,
        CASE WHEN label IS NULL THEN CASE WHEN e.col IS NOT NULL THEN e.table_idx END WHEN n = 1 THEN t END AS table_idx,
        CASE WHEN label IS NULL THEN CASE WHEN e.col IS NOT NULL THEN e.row END WHEN n = 1 THEN tr END AS row,
        CASE WHEN label IS NULL THEN e.col WHEN n = 1 THEN tc END AS col,
        CASE WHEN label IS NOT NULL AND e.row IS NOT NULL THEN 'both_modes'
          WHEN label IS NOT NULL THEN CASE WHEN n IS NULL THEN 'label_missing'
            WHEN n > 1 THEN 'label_ambiguous' WHEN NOT there THEN 'target_missing' END
          WHEN e.table_idx IS NULL OR e.row IS NULL OR e.col IS NULL THEN 'incomplete' END AS problem,
        label IS NOT NULL AND e.row IS NOT NULL AS is_both
      FROM edits e LEFT JOIN lab2 ON e.doc_id = lab2.doc_id AND e.edit_no = lab2.edit_no),
    placed2 AS (SELECT * REPLACE (CASE WHEN is_both THEN NULL ELSE table_idx END AS table_idx,
        CASE WHEN is_both THEN NULL ELSE row END AS row) FROM placed),
    results AS (
      SELECT p.doc_id, edit_no, p.table_idx, p.row, p.col, c.text AS old_text, new_text,
        CASE WHEN problem IS NOT NULL THEN problem WHEN tb.doc_id IS NULL THEN 'table_missing'
          WHEN c.doc_id IS NULL THEN 'cell_missing' WHEN expected_text <> c.text THEN 'text_differs'
          ELSE 'ok' END AS status
      FROM placed2 p LEFT JOIN cells c ON p.doc_id = c.doc_id AND p.table_idx = c.table_idx
        AND p.row = c.row AND p.col = c.col
      LEFT JOIN (SELECT DISTINCT doc_id, table_idx FROM cells) tb
        ON p.doc_id = tb.doc_id AND p.table_idx = tb.table_idx)
"""


def _cell_edits(cells):
    ids = cells.select("doc_id").distinct()
    text = lambda v=None: F.lit(v).cast("string")
    number = lambda v=None: F.lit(v).cast("int")
    one = ids.select(
        "doc_id",
        F.lit(1).alias("edit_no"),
        F.expr("if(doc_id % 6 = 5, 9, 0)").alias("table_idx"),
        F.lit(1).alias("row"),
        F.lit(3).alias("col"),
        text().alias("label"),
        text().alias("direction"),
        text("edited").alias("new_text"),
        F.expr("if(doc_id % 4 = 1, '5-LOW', null)").alias("expected_text"),
    )
    two = label_requests(cells).filter("doc_id % 3 = 0").select(
        "doc_id",
        F.lit(2).alias("edit_no"),
        F.when(F.col("doc_id") % 9 == 0, number()).otherwise(F.col("table_idx")).alias("table_idx"),
        F.when(F.col("doc_id") % 9 == 0, number(1)).alias("row"),
        number().alias("col"),
        "label",
        "direction",
        text("by label").alias("new_text"),
        text().alias("expected_text"),
    )
    three = ids.filter("doc_id % 10 in (7, 8)").select(
        "doc_id",
        F.lit(3).alias("edit_no"),
        F.lit(1).alias("table_idx"),
        F.lit(2).alias("row"),
        F.when(F.col("doc_id") % 10 != 7, number(9)).alias("col"),
        text().alias("label"),
        text().alias("direction"),
        text("nowhere").alias("new_text"),
        text().alias("expected_text"),
    )
    return one.unionByName(two).unionByName(three)


@query(
    "cell_edit_results",
    f"WITH {_CELL_EDITS_SQL} SELECT doc_id, edit_no, table_idx, row, col, old_text, new_text, status FROM results",
)
def cell_edit_results(spark, sf_dir):
    cells = d.order_cells(spark, sf_dir)
    return co.cell_edit_results(cells, _cell_edits(cells))


@query(
    "apply_cell_edits",
    f"""WITH {_CELL_EDITS_SQL},
    clean AS (SELECT doc_id FROM results GROUP BY doc_id HAVING bool_and(status = 'ok')),
    last AS (SELECT doc_id, table_idx, row, col, arg_max(new_text, edit_no) AS new_text
      FROM results SEMI JOIN clean USING (doc_id) GROUP BY ALL)
    SELECT c.doc_id, c.table_idx, c.row, c.col, row_span, col_span, coalesce(new_text, text) AS text
    FROM cells c LEFT JOIN last l ON c.doc_id = l.doc_id AND c.table_idx = l.table_idx
      AND c.row = l.row AND c.col = l.col""",
)
def apply_cell_edits(spark, sf_dir):
    cells = d.order_cells(spark, sf_dir)
    return co.apply_cell_edits(cells, _cell_edits(cells))


@query(
    "validate_edits",
    """WITH c AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS label,
        CASE WHEN c_custkey % 3 = 0 THEN 1 END AS row, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS col
      FROM customer)
    SELECT doc_id, CASE WHEN label IS NOT NULL AND (row IS NOT NULL OR col IS NOT NULL) THEN 'both_modes'
      WHEN label IS NOT NULL THEN 'label' WHEN row IS NOT NULL AND col IS NOT NULL THEN 'coordinate'
      ELSE 'incomplete' END AS mode FROM c""",
)
def validate_edits(spark, sf_dir):
    requests = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.expr("if(c_custkey % 2 = 0, c_name, null)").alias("label"),
        F.lit(0).alias("table_idx"),
        F.expr("if(c_custkey % 3 = 0, 1, null)").alias("row"),
        F.expr("if(c_custkey % 5 <> 0, 1, null)").alias("col"),
    )
    return co.validate_edits(requests).select("doc_id", "mode")


_SHEET_SQL = """
sc AS (
  SELECT c_custkey // 10 AS doc_id, 'S' || (c_custkey % 2) AS sheet, (c_custkey % 10)::int AS row,
    col, c_custkey AS k,
    CASE col WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0
      THEN 'formula' ELSE 'number' END ELSE 'date' END AS kind,
    CASE col WHEN 0 THEN c_custkey::varchar WHEN 1 THEN c_name
      WHEN 2 THEN c_acctbal::decimal(15,2)::varchar END AS value_text
  FROM customer, (SELECT unnest([0, 1, 2, 3])::int AS col)),
su AS (
  SELECT DISTINCT doc_id, 1 AS update_no, CASE WHEN doc_id % 13 = 5 THEN 'S9' ELSE 'S0' END AS sheet,
    'C' || (doc_id % 5 * 2 + 1) AS cell, 'v1' AS value, (doc_id % 5 * 2)::int AS row, 2 AS col FROM sc
  UNION ALL SELECT DISTINCT doc_id, 2, 'S0', 'B1', 'v2', 0, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END FROM sc
  UNION ALL SELECT DISTINCT doc_id, 3, 'S1', 'd' || (doc_id % 3 * 2 + 2), 'v3', (doc_id % 3 * 2 + 1)::int, 3 FROM sc
  UNION ALL SELECT DISTINCT doc_id, 4, 'S0', 'A1', 'v4', 0, 0 FROM sc
  UNION ALL SELECT DISTINCT doc_id, 5, 'S0', 'AB12', 'v5', 11, 27 FROM sc
  UNION ALL SELECT DISTINCT doc_id, 6, 'S0', '1A', 'v6', NULL::int, NULL::int FROM sc WHERE doc_id % 11 = 3),
sr AS (
  SELECT u.doc_id, u.update_no, u.sheet, u.row, u.col, u.cell, u.value, s.kind,
    lag(u.value) OVER (PARTITION BY u.doc_id, u.sheet, u.row, u.col ORDER BY u.update_no) AS written,
    CASE WHEN s.kind IS NULL THEN '(빈 셀)'
      WHEN s.kind = 'formula' THEN '=A1*2 (결과: ' || s.value_text || ')'
      WHEN s.kind = 'date' THEN strftime(TIMESTAMP '2024-01-01' + to_days(k::int), '%Y. %m. %d.')
        || CASE WHEN k % 24 = 0 THEN '' ELSE CASE WHEN k % 24 < 12 THEN ' 오전 ' ELSE ' 오후 ' END
          || strftime(TIMESTAMP '2024-01-01' + to_hours((k % 24)::int), '%I:%M:%S') END
      ELSE s.value_text END AS old
  FROM su u LEFT JOIN sc s ON u.doc_id = s.doc_id AND u.sheet = s.sheet AND u.row = s.row AND u.col = s.col)
"""


def _sheet_cells(spark, sf_dir):
    text = "cast(null as string)"
    return load(spark, sf_dir, "customer").select(
        F.expr("c_custkey div 10").alias("doc_id"),
        F.expr("'S' || c_custkey % 2").alias("sheet"),
        F.expr("cast(c_custkey % 10 as int)").alias("row"),
        F.col("c_custkey").alias("k"),
        F.expr(
            f"""stack(4, 0, 'number', cast(c_custkey as string), 1, 'string', c_name,
              2, if(c_custkey % 3 = 0, 'formula', 'number'), cast(cast(c_acctbal as decimal(15,2)) as string),
              3, 'date', {text}) as (col, kind, value_text)"""
        ),
    ).select(
        "doc_id",
        "sheet",
        "row",
        "col",
        "kind",
        "value_text",
        F.expr(
            """if(col = 3, timestamp'2024-01-01' + make_dt_interval(cast(k as int), cast(k % 24 as int)), null)"""
        ).alias("value_ts"),
        F.expr("if(kind = 'formula', 'A1*2', null)").alias("formula"),
        F.expr("if(doc_id % 2 = 0 and row = 0 and col < 2, 0, null)").alias("master_row"),
        F.expr("if(doc_id % 2 = 0 and row = 0 and col < 2, 0, null)").alias("master_col"),
    )


def _sheet_updates(cells):
    return cells.select("doc_id").distinct().select(
        "doc_id",
        F.expr(
            """stack(6, 1, if(doc_id % 13 = 5, 'S9', 'S0'), 'C' || (doc_id % 5 * 2 + 1), 'v1',
              2, 'S0', 'B1', 'v2', 3, 'S1', 'd' || (doc_id % 3 * 2 + 2), 'v3',
              4, 'S0', 'A1', 'v4', 5, 'S0', 'AB12', 'v5', 6, 'S0', '1A', 'v6') as (update_no, sheet, cell, value)"""
        ),
    ).filter("update_no < 6 or doc_id % 11 = 3")


@query(
    "sheet_edit_results",
    f"""WITH {_SHEET_SQL}
    SELECT doc_id, update_no, sheet, row, col, sheet || '!' || cell
        || CASE WHEN cell = 'B1' AND doc_id % 2 = 0 THEN ' → A1' ELSE '' END AS target,
      coalesce(written, old) AS old_value, value AS new_value,
      CASE WHEN sheet = 'S9' THEN 'sheet_missing' WHEN row IS NULL THEN 'address_invalid' ELSE 'ok' END AS status,
      cell = 'B1' AND doc_id % 2 = 0 AS merged_warning,
      written IS NULL AND coalesce(kind, '') = 'formula' AS formula_warning
    FROM sr""",
)
def sheet_edit_results(spark, sf_dir):
    cells = _sheet_cells(spark, sf_dir)
    return co.sheet_edit_results(cells, _sheet_updates(cells))


@query(
    "apply_sheet_edits",
    f"""WITH {_SHEET_SQL},
    last AS (SELECT doc_id, sheet, row, col, arg_max(value, update_no) AS v FROM sr
      WHERE doc_id % 13 <> 5 AND doc_id % 11 <> 3 GROUP BY ALL)
    SELECT coalesce(s.doc_id, l.doc_id) AS doc_id, coalesce(s.sheet, l.sheet) AS sheet,
      coalesce(s.row, l.row) AS row, coalesce(s.col, l.col) AS col,
      CASE WHEN v IS NOT NULL THEN 'string' ELSE kind END AS kind, coalesce(v, value_text) AS value_text,
      CASE WHEN v IS NULL AND kind = 'formula' THEN 'A1*2' END AS formula
    FROM sc s FULL JOIN last l ON s.doc_id = l.doc_id AND s.sheet = l.sheet AND s.row = l.row AND s.col = l.col""",
)
def apply_sheet_edits(spark, sf_dir):
    cells = _sheet_cells(spark, sf_dir)
    return co.apply_sheet_edits(cells, _sheet_updates(cells)).drop("value_ts", "master_row", "master_col")


@query(
    "fill_fields",
    """WITH f AS (SELECT c_custkey AS doc_id, '성명' AS label, c_name AS v FROM customer
      UNION ALL SELECT c_custkey, '국가', c_nationkey::varchar FROM customer),
    q AS (SELECT c_custkey AS doc_id, '성명' AS label, '홍길동' AS new_value FROM customer WHERE c_custkey % 4 <> 0
      UNION ALL SELECT c_custkey, '주소', '서울' FROM customer
      UNION ALL SELECT c_custkey, '국가', c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
    SELECT q.doc_id, q.label, coalesce(f.v, '(없음)') AS old_value, new_value,
      CASE WHEN NOT bool_or(f.v IS NOT NULL) OVER (PARTITION BY q.doc_id) THEN 'rejected'
        WHEN f.v IS NOT NULL THEN 'filled' ELSE 'unmatched' END AS status
    FROM q LEFT JOIN f ON q.doc_id = f.doc_id AND q.label = f.label""",
)
def fill_fields(spark, sf_dir):
    people = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc_id")
    fields = people.select(
        "doc_id",
        F.expr(
            "stack(3, 0, '성명', 'stale', 1, '성명', c_name, 2, '국가', cast(c_nationkey as string)) as (field_no, label, value)"
        ),
    )
    values = people.select(
        "doc_id",
        F.expr(
            "stack(3, '성명', '홍길동', '주소', '서울', '국가', c_mktsegment) as (label, value)"
        ),
    ).filter("(label <> '성명' or doc_id % 4 <> 0) and (label <> '국가' or doc_id % 3 = 0)")
    return co.fill_fields(fields, values)
