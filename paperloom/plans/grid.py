"""Table operations over the cells of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import grid as op
from paperloom.plans import derived as d
from paperloom.plans.registry import query
from paperloom.plans.structure import MD_CELLS_SQL
from paperloom.operators import structure

_OUT = "doc_id, table_idx, row, col, row_span, col_span, text"


def _refused(conflict: str, found: str = "true") -> str:
    return f"""refused AS (SELECT doc_id, table_idx FROM cells GROUP BY ALL
      HAVING NOT bool_or({found}) OR bool_or({conflict})),
    kept AS (SELECT {_OUT} FROM cells SEMI JOIN refused USING (doc_id, table_idx)),
    free AS (SELECT {_OUT} FROM cells ANTI JOIN refused USING (doc_id, table_idx))"""


@query(
    "insert_row",
    f"""WITH {d.CELLS_SQL},
    {_refused("row_span > 1 AND row < 3 AND 3 <= row + row_span - 1", "row = 2")}
    SELECT * FROM kept UNION ALL
    SELECT doc_id, table_idx, CASE WHEN row >= 3 THEN row + 1 ELSE row END, col, row_span, col_span, text FROM free
    UNION ALL SELECT doc_id, table_idx, 3, col, 1, 1, '' FROM free WHERE row = 2""",
)
def insert_row(spark, sf_dir):
    return op.insert_row(d.order_cells(spark, sf_dir), 2, below=True)


@query(
    "delete_row",
    f"""WITH {d.CELLS_SQL},
    {_refused("(row = 2 AND row_span > 1) OR (row_span > 1 AND row < 2 AND 2 <= row + row_span - 1)", "row = 2")}
    SELECT * FROM kept UNION ALL
    SELECT doc_id, table_idx, CASE WHEN row > 2 THEN row - 1 ELSE row END, col, row_span, col_span, text
    FROM free WHERE row <> 2""",
)
def delete_row(spark, sf_dir):
    return op.delete_row(d.order_cells(spark, sf_dir), 2)


@query(
    "insert_column",
    f"""WITH {d.CELLS_SQL},
    {_refused("col_span > 1 AND col < 1 AND 1 <= col + col_span - 1")}
    SELECT * FROM kept UNION ALL
    SELECT doc_id, table_idx, row, CASE WHEN col >= 1 THEN col + 1 ELSE col END, row_span, col_span, text FROM free
    UNION ALL SELECT DISTINCT doc_id, table_idx, row, 1, 1, 1, '' FROM free""",
)
def insert_column(spark, sf_dir):
    return op.insert_column(d.order_cells(spark, sf_dir), 0, right=True)


@query(
    "delete_column",
    f"""WITH {d.CELLS_SQL},
    {_refused("(col = 1 AND col_span > 1) OR (col_span > 1 AND col < 1 AND 1 <= col + col_span - 1)")}
    SELECT * FROM kept UNION ALL
    SELECT doc_id, table_idx, row, CASE WHEN col > 1 THEN col - 1 ELSE col END, row_span, col_span, text
    FROM free WHERE col <> 1""",
)
def delete_column(spark, sf_dir):
    return op.delete_column(d.order_cells(spark, sf_dir), 1)


@query(
    "merge_cells",
    f"""WITH {d.CELLS_SQL},
    {_refused('''(row_span > 1 OR col_span > 1) AND row <= 2 AND row + row_span - 1 >= 1
        AND col <= 2 AND col + col_span - 1 >= 1''', "row = 1 AND col = 1")}
    SELECT * FROM kept UNION ALL
    SELECT doc_id, table_idx, row, col, CASE WHEN row = 1 AND col = 1 THEN 2 ELSE row_span END,
      CASE WHEN row = 1 AND col = 1 THEN 2 ELSE col_span END, text
    FROM free WHERE NOT (row BETWEEN 1 AND 2 AND col BETWEEN 1 AND 2) OR (row = 1 AND col = 1)""",
)
def merge_cells(spark, sf_dir):
    return op.merge_cells(d.order_cells(spark, sf_dir), 1, 1, 2, 2)


def _op_list(*ops):
    """Array of op structs; every op is a dict of the fields it uses."""
    types = dict(
        op_no="int", op="string", row="int", col="int", position="string",
        start_row="int", start_col="int", end_row="int", end_col="int",
    )
    return F.array(
        *[
            F.struct(
                *[
                    F.expr(str(no) if f == "op_no" else str(o.get(f, "null"))).cast(t).alias(f)
                    for f, t in types.items()
                ]
            )
            for no, o in enumerate(ops, 1)
        ]
    )


# Three different lists: by doc_id % 3, on table 0 only (and on a table that is not there).
def _ops(spark, sf_dir):
    tables = d.order_cells(spark, sf_dir).select("doc_id").distinct()
    first = _op_list(
        dict(op="'insertRow'", row=1, position="'below'"),
        dict(op="'deleteRow'", row=4),
        dict(op="'deleteColumn'", col=3),
    )
    second = _op_list(
        dict(op="'mergeCells'", start_row=0, start_col=1, end_row=1, end_col=2),
        dict(op="'insertColumn'", col=3, position="'right'"),
        dict(op="'insertRow'", row=2, position="'above'"),
    )
    third = _op_list(
        dict(op="'insertColumn'", col=1, position="'left'"),
        dict(op="'deleteRow'", row="if(doc_id % 4 = 0, 8, 3)"),
    )
    kind = F.col("doc_id") % 3
    return tables.select(
        "doc_id",
        F.expr("if(doc_id % 50 = 49, 7, 0)").alias("table_idx"),
        F.inline(F.when(kind == 0, first).when(kind == 1, second).otherwise(third)),
    )


# The same lists written out: what each leads to on a 4 x 4 table with the known merges.
_OPS_SQL = f"""{d.CELLS_SQL},
    t AS (SELECT DISTINCT doc_id, table_idx FROM cells),
    u AS (SELECT doc_id, table_idx, table_idx = 0 AND doc_id % 50 <> 49 AS has_ops FROM t),
    verdict AS (SELECT *, CASE WHEN NOT has_ops THEN NULL
        -- rows: insert below 1 (merge at rows 2-3 moves down), delete row 4 cuts the moved merge
        WHEN doc_id % 3 = 0 AND doc_id % 7 = 0 THEN 2
        -- the merge 0,1..1,2 meets a wide first cell, or has no corner there
        WHEN doc_id % 3 = 1 AND doc_id % 5 = 0 THEN 1
        -- insert above row 2 is fine beside a merge of rows 0-1; merged rows 2-3 start at 2
        WHEN doc_id % 3 = 2 AND doc_id % 5 = 0 THEN 1
        WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN 2
        WHEN doc_id % 3 = 2 AND doc_id % 7 = 0 THEN 2
        END AS failed_op FROM u)
"""


@query(
    "table_op_failures",
    f"""WITH {_OPS_SQL}
    SELECT doc_id, table_idx, failed_op, CASE WHEN doc_id % 3 = 2 AND failed_op = 2 AND doc_id % 4 = 0
      THEN 'target_missing' WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'target_missing' END
      ELSE 'span_conflict' END AS reason
    FROM verdict WHERE failed_op IS NOT NULL
    UNION ALL SELECT DISTINCT doc_id, 7, CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END, 'target_missing'
    FROM t WHERE doc_id % 50 = 49""",
)
def table_op_failures(spark, sf_dir):
    return op.table_op_failures(d.order_cells(spark, sf_dir), _ops(spark, sf_dir))


_APPLIED_SQL = f"""{_OPS_SQL},
    cv AS (SELECT c.*, has_ops AND failed_op IS NULL AS go, doc_id % 3 AS kind
      FROM cells c JOIN verdict USING (doc_id, table_idx)),
    applied AS (
      SELECT {_OUT} FROM cv WHERE NOT go
      -- insert below 1: rows 2, 3 -> 3, 4; new row 2; delete row 4; drop column 3
      UNION ALL SELECT doc_id, table_idx, CASE WHEN row >= 2 THEN row + 1 ELSE row END, col, row_span, col_span, text
        FROM cv WHERE go AND kind = 0 AND row < 3 AND col <> 3
      UNION ALL SELECT doc_id, table_idx, 2, col, 1, 1, '' FROM cv WHERE go AND kind = 0 AND row = 1 AND col <> 3
      -- merge rows 0-1 x cols 1-2, new column 4, new blank row 2 before old rows 2, 3
      UNION ALL SELECT doc_id, table_idx, CASE WHEN row >= 2 THEN row + 1 ELSE row END, col,
          CASE WHEN row = 0 AND col = 1 THEN 2 ELSE row_span END,
          CASE WHEN row = 0 AND col = 1 THEN 2 ELSE col_span END, text
        FROM cv WHERE go AND kind = 1 AND NOT (row <= 1 AND col IN (1, 2) AND NOT (row = 0 AND col = 1))
      UNION ALL SELECT DISTINCT doc_id, table_idx, CASE WHEN row >= 2 THEN row + 1 ELSE row END, 4, 1, 1, ''
        FROM cv WHERE go AND kind = 1
      UNION ALL SELECT doc_id, table_idx, 2, col, 1, 1, '' FROM cv WHERE go AND kind = 1 AND row = 2
      UNION ALL SELECT DISTINCT doc_id, table_idx, 2, 4, 1, 1, '' FROM cv WHERE go AND kind = 1
      -- new column 1, row 3 dropped
      UNION ALL SELECT doc_id, table_idx, row, CASE WHEN col >= 1 THEN col + 1 ELSE col END, row_span, col_span, text
        FROM cv WHERE go AND kind = 2 AND row <> 3
      UNION ALL SELECT DISTINCT doc_id, table_idx, row, 1, 1, 1, '' FROM cv WHERE go AND kind = 2 AND row <> 3)
"""


@query("apply_table_ops", f"WITH {_APPLIED_SQL} SELECT * FROM applied")
def apply_table_ops(spark, sf_dir):
    return op.apply_table_ops(d.order_cells(spark, sf_dir), _ops(spark, sf_dir))


@query(
    "verify_dims",
    f"""WITH {_APPLIED_SQL},
    e AS (SELECT DISTINCT doc_id, table_idx, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 2 THEN 3 END AS expected_rows,
        CASE doc_id % 3 WHEN 0 THEN 3 WHEN 2 THEN 5 END AS expected_cols FROM verdict WHERE has_ops),
    a AS (SELECT doc_id, table_idx, max(row + row_span) AS actual_rows, max(col + col_span) AS actual_cols
      FROM applied GROUP BY ALL)
    SELECT e.doc_id, e.table_idx, expected_rows, expected_cols, actual_rows, actual_cols, CASE WHEN expected_rows IS NULL THEN 'not_checked'
      WHEN expected_rows = actual_rows AND expected_cols = actual_cols THEN 'ok' ELSE 'differs' END AS status
    FROM e JOIN a USING (doc_id, table_idx)
    UNION ALL SELECT DISTINCT doc_id, 7, NULL::int, NULL::int, NULL::int, NULL::int, 'table_missing'
    FROM cells WHERE doc_id % 50 = 49""",
)
def verify_dims(spark, sf_dir):
    cells, ops = d.order_cells(spark, sf_dir), _ops(spark, sf_dir)
    return op.verify_dims(cells, op.apply_table_ops(cells, ops), ops)


@query(
    "table_shapes",
    f"""WITH {MD_CELLS_SQL}
    SELECT doc_id, table_idx, max(row + row_span) AS rows, max(col + col_span) AS cols,
      count(*) AS cells, bool_or(is_header) AS has_header FROM md_cells GROUP BY ALL""",
)
def table_shapes(spark, sf_dir):
    cells = structure.table_cells(structure.blocks(d.markdown(spark, sf_dir)))
    return op.table_shapes(cells)


@query(
    "table_row_census",
    f"""WITH {d.CELLS_SQL},
    s AS (SELECT doc_id, table_idx, max(row + row_span) AS rows, max(col + col_span) AS cols
      FROM cells GROUP BY ALL)
    SELECT rows, cols, count(*) AS tables FROM s GROUP BY ALL""",
)
def table_row_census(spark, sf_dir):
    shapes = op.table_shapes(d.order_cells(spark, sf_dir))
    return shapes.groupBy("rows", "cols").agg(F.count("*").alias("tables"))
