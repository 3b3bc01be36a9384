"""Row and column operations on table cells.

Cells: doc_id, table_idx, row, col, row_span, col_span, text. An operation that would cut
through a merged cell is refused for that table, which then stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.arrays import let
from paperloom.operators.ranking import attach

TABLE = ["doc_id", "table_idx"]
ROW = ["doc_id", "table_idx", "row"]
CELL_FIELDS = ["row", "col", "row_span", "col_span", "text"]

MISSING, CONFLICT = "target_missing", "span_conflict"


def _crosses(start: Column, span: Column, at: Column) -> Column:
    """A span that begins before ``at`` and reaches it."""
    return (span > 1) & (start < at) & (at <= start + span - 1)


def _overlaps(cell, r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return (
        (cell["col"] <= c1)
        & (cell["col"] + cell["col_span"] - 1 >= c0)
        & (cell["row"] <= r1)
        & (cell["row"] + cell["row_span"] - 1 >= r0)
    )


def refusals(cells: DataFrame, conflict: Column, found: Column | None = None) -> DataFrame:
    """Tables an operation must not touch, with the reason."""
    present = F.lit(True) if found is None else found
    reason = F.when(~F.some(present), MISSING).when(F.some(conflict), CONFLICT)
    return cells.groupBy(*TABLE).agg(reason.alias("refused")).filter("refused IS NOT NULL")


def _with_refusals(cells: DataFrame, refused: DataFrame) -> DataFrame:
    return attach(cells, refused, TABLE, "left")


def _emit(checked: DataFrame, variants: Column) -> DataFrame:
    """One output row per element; refused tables pass through."""
    same = F.array(F.struct(*CELL_FIELDS))
    out = F.when(F.col("refused").isNotNull(), same).otherwise(variants)
    return checked.select(*TABLE, F.inline(out)).select(*TABLE, *CELL_FIELDS)


def _cell(row: Column, col: Column, row_span=None, col_span=None, text=None) -> Column:
    return F.struct(
        row.alias("row"),
        col.alias("col"),
        (F.col("row_span") if row_span is None else row_span).alias("row_span"),
        (F.col("col_span") if col_span is None else col_span).alias("col_span"),
        (F.col("text") if text is None else text).alias("text"),
    )


def _blank(row: Column, col: Column) -> Column:
    return _cell(row, col, F.lit(1), F.lit(1), F.lit(""))


def insert_row(cells: DataFrame, row: int, below: bool = True) -> DataFrame:
    """A blank copy of ``row`` below or above it."""
    at = row + 1 if below else row
    refused = refusals(
        cells, _crosses(F.col("row"), F.col("row_span"), F.lit(at)), F.col("row") == row
    )
    moved = _cell(F.when(F.col("row") >= at, F.col("row") + 1).otherwise(F.col("row")), F.col("col"))
    variants = F.when(
        F.col("row") == row, F.array(moved, _blank(F.lit(at), F.col("col")))
    ).otherwise(F.array(moved))
    return _emit(_with_refusals(cells, refused), variants)


def delete_row(cells: DataFrame, row: int) -> DataFrame:
    here = F.col("row") == row
    conflict = (here & (F.col("row_span") > 1)) | _crosses(
        F.col("row"), F.col("row_span"), F.lit(row)
    )
    moved = _cell(F.when(F.col("row") > row, F.col("row") - 1).otherwise(F.col("row")), F.col("col"))
    variants = F.when(~here, F.array(moved))
    return _emit(_with_refusals(cells, refusals(cells, conflict, here)), variants)


def insert_column(cells: DataFrame, col: int, right: bool = True) -> DataFrame:
    """One blank cell per row to the right or left of ``col``."""
    at = col + 1 if right else col
    refused = refusals(cells, _crosses(F.col("col"), F.col("col_span"), F.lit(at)))
    # A table row is bounded by the width of its table.
    first = F.col("col") == F.min("col").over(Window.partitionBy(*ROW))
    checked = _with_refusals(cells.withColumn("_first", first), refused)
    moved = _cell(F.col("row"), F.when(F.col("col") >= at, F.col("col") + 1).otherwise(F.col("col")))
    variants = F.when(
        F.col("_first"), F.array(moved, _blank(F.col("row"), F.lit(at)))
    ).otherwise(F.array(moved))
    return _emit(checked, variants)


def delete_column(cells: DataFrame, col: int) -> DataFrame:
    here = F.col("col") == col
    conflict = (here & (F.col("col_span") > 1)) | _crosses(
        F.col("col"), F.col("col_span"), F.lit(col)
    )
    moved = _cell(F.col("row"), F.when(F.col("col") > col, F.col("col") - 1).otherwise(F.col("col")))
    variants = F.when(~here, F.array(moved))
    return _emit(_with_refusals(cells, refusals(cells, conflict)), variants)


def merge_cells(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The range becomes one cell with the text of its top-left; covered texts are dropped."""
    if (r0, c0) == (r1, c1):
        raise ValueError("a merge needs two cells or more")
    if r0 > r1 or c0 > c1:
        raise ValueError("a merge range must not end before it starts")
    top_left = (F.col("row") == r0) & (F.col("col") == c0)
    inside = F.col("row").between(r0, r1) & F.col("col").between(c0, c1)
    spanned = (F.col("row_span") > 1) | (F.col("col_span") > 1)
    box = {k: F.col(k) for k in CELL_FIELDS}
    conflict = spanned & _overlaps(box, *[F.lit(x) for x in (r0, c0, r1, c1)])
    merged = _cell(F.col("row"), F.col("col"), F.lit(r1 - r0 + 1), F.lit(c1 - c0 + 1))
    variants = F.when(top_left, F.array(merged)).when(
        ~inside, F.array(_cell(F.col("row"), F.col("col")))
    )
    return _emit(_with_refusals(cells, refusals(cells, conflict, top_left)), variants)


# --- op lists per table -------------------------------------------------------------------

_ROW_TYPE = "array<struct<row:int,cells:array<struct<col:int,row_span:int,col_span:int,text:string>>>>"


def _struct_cell(col: Column, row_span: Column, col_span: Column, text: Column) -> Column:
    return F.struct(
        col.alias("col"), row_span.alias("row_span"), col_span.alias("col_span"), text.alias("text")
    )


def _step(rows: Column, o: Column) -> Column:
    """Rows (arrays of cells) of one original row after operation ``o``."""
    at_row = F.when(o["position"] == "below", o["row"] + 1).otherwise(o["row"])
    at_col = F.when(o["position"] == "right", o["col"] + 1).otherwise(o["col"])
    row_of = lambda r, cells: F.struct(r.cast("int").alias("row"), cells.alias("cells"))
    blank = lambda c: _struct_cell(c, F.lit(1), F.lit(1), F.lit(""))

    def insert_rows(r: Column) -> Column:
        moved = row_of(F.when(r["row"] >= at_row, r["row"] + 1).otherwise(r["row"]), r["cells"])
        copy = row_of(at_row, F.transform(r["cells"], lambda c: blank(c["col"])))
        return F.when((r["row"] == o["row"]) & (F.size(r["cells"]) > 0), F.array(moved, copy)).otherwise(
            F.array(moved)
        )

    def insert_cols(r: Column) -> Column:
        moved = F.transform(
            r["cells"],
            lambda c: _struct_cell(
                F.when(c["col"] >= at_col, c["col"] + 1).otherwise(c["col"]),
                c["row_span"],
                c["col_span"],
                c["text"],
            ),
        )
        return row_of(
            r["row"], F.when(F.size(moved) > 0, F.array_append(moved, blank(at_col))).otherwise(moved)
        )

    def delete_cols(r: Column) -> Column:
        kept = F.filter(r["cells"], lambda c: c["col"] != o["col"])
        return row_of(
            r["row"],
            F.transform(
                kept,
                lambda c: _struct_cell(
                    F.when(c["col"] > o["col"], c["col"] - 1).otherwise(c["col"]),
                    c["row_span"],
                    c["col_span"],
                    c["text"],
                ),
            ),
        )

    def merge(r: Column) -> Column:
        in_rows = r["row"].between(o["start_row"], o["end_row"])

        def keep(c: Column) -> Column:
            corner = (r["row"] == o["start_row"]) & (c["col"] == o["start_col"])
            return ~in_rows | ~c["col"].between(o["start_col"], o["end_col"]) | corner

        def span(c: Column) -> Column:
            corner = (r["row"] == o["start_row"]) & (c["col"] == o["start_col"])
            return _struct_cell(
                c["col"],
                F.when(corner, o["end_row"] - o["start_row"] + 1).otherwise(c["row_span"]),
                F.when(corner, o["end_col"] - o["start_col"] + 1).otherwise(c["col_span"]),
                c["text"],
            )

        return row_of(r["row"], F.transform(F.filter(r["cells"], keep), span))

    kind = o["op"]
    return (
        F.when(kind == "insertRow", F.flatten(F.transform(rows, insert_rows)))
        .when(
            kind == "deleteRow",
            F.transform(
                F.filter(rows, lambda r: r["row"] != o["row"]),
                lambda r: row_of(
                    F.when(r["row"] > o["row"], r["row"] - 1).otherwise(r["row"]), r["cells"]
                ),
            ),
        )
        .when(kind == "insertColumn", F.transform(rows, insert_cols))
        .when(kind == "deleteColumn", F.transform(rows, delete_cols))
        .when(kind == "mergeCells", F.transform(rows, merge))
        .otherwise(rows)
    ).cast(_ROW_TYPE)


def _refuses(rows: Column, o: Column) -> Column:
    """A merged cell among ``rows`` that operation ``o`` would cut through, or a bad range."""
    at_row = F.when(o["position"] == "below", o["row"] + 1).otherwise(o["row"])
    at_col = F.when(o["position"] == "right", o["col"] + 1).otherwise(o["col"])

    def hit(r: Column, c: Column) -> Column:
        cell = {"row": r["row"], "col": c["col"], "row_span": c["row_span"], "col_span": c["col_span"]}
        kind = o["op"]
        by_row = lambda at: _crosses(r["row"], c["row_span"], at)
        by_col = lambda at: _crosses(c["col"], c["col_span"], at)
        return (
            F.when(kind == "insertRow", by_row(at_row))
            .when(
                kind == "deleteRow",
                ((r["row"] == o["row"]) & (c["row_span"] > 1)) | by_row(o["row"]),
            )
            .when(kind == "insertColumn", by_col(at_col))
            .when(
                kind == "deleteColumn",
                ((c["col"] == o["col"]) & (c["col_span"] > 1)) | by_col(o["col"]),
            )
            .when(
                kind == "mergeCells",
                ((c["row_span"] > 1) | (c["col_span"] > 1))
                & _overlaps(cell, o["start_row"], o["start_col"], o["end_row"], o["end_col"]),
            )
            .otherwise(False)
        )

    single = (o["start_row"] == o["end_row"]) & (o["start_col"] == o["end_col"])
    reversed_ = (o["start_row"] > o["end_row"]) | (o["start_col"] > o["end_col"])
    bad_range = (o["op"] == "mergeCells") & (single | reversed_)
    return F.coalesce(
        bad_range | F.exists(rows, lambda r: F.exists(r["cells"], lambda c: hit(r, c))), F.lit(False)
    )


def _finds(rows: Column, o: Column) -> Column:
    """Is the row or corner that ``o`` needs among ``rows``?"""
    row_there = F.exists(rows, lambda r: (r["row"] == o["row"]) & (F.size(r["cells"]) > 0))
    corner_there = F.exists(
        rows,
        lambda r: (r["row"] == o["start_row"])
        & F.exists(r["cells"], lambda c: c["col"] == o["start_col"]),
    )
    return F.coalesce(
        F.when(o["op"].isin("insertRow", "deleteRow"), row_there)
        .when(o["op"] == "mergeCells", corner_there)
        .otherwise(False),
        F.lit(False),
    )


def _fold(cells: DataFrame, ops: DataFrame) -> DataFrame:
    """Every table row of the tables with operations, taken through the whole list.

    What an operation does to a cell depends only on the cell's own row, so one fold per table
    row replaces a join per operation. Whether the operation was allowed depends on the whole
    table: the fold reports what it saw (``found``, ``bad``) and ``_failures`` sums it up.
    """
    lists = ops.groupBy(*TABLE).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "op_no", "op", "row", "col", "position",
                    "start_row", "start_col", "end_row", "end_col",
                )
            )
        ).alias("ops")
    )
    # A table row is bounded by the width of its table.
    rows = (
        cells.join(ops.select(*TABLE).distinct(), TABLE, "left_semi")
        .groupBy(*ROW)
        .agg(F.array_sort(F.collect_list(F.struct("col", "row_span", "col_span", "text"))).alias("cells"))
    )
    joined = attach(rows, lists, TABLE)
    start = F.struct(
        F.array(F.struct(F.col("row").cast("int").alias("row"), F.col("cells"))).cast(_ROW_TYPE).alias("rows"),
        F.array().cast("array<int>").alias("found"),
        F.array().cast("array<int>").alias("bad"),
    )
    no_op = F.array().cast("array<int>")
    seen = lambda flag, no: F.when(flag, F.array(no.cast("int"))).otherwise(no_op)
    folded = F.aggregate(
        "ops",
        start,
        lambda acc, o: F.struct(
            _step(acc["rows"], o).alias("rows"),
            F.concat(acc["found"], seen(_finds(acc["rows"], o), o["op_no"])).alias("found"),
            F.concat(acc["bad"], seen(_refuses(acc["rows"], o), o["op_no"])).alias("bad"),
        ),
    )
    return joined.select(*ROW, "cells", let(folded, lambda x: x).alias("f"))


def _failures(folded: DataFrame, ops: DataFrame) -> DataFrame:
    """First refused operation of each refused table."""
    seen = F.concat(
        F.transform("f.bad", lambda n: F.struct(n.alias("op_no"), F.lit(True).alias("bad"))),
        F.transform("f.found", lambda n: F.struct(n.alias("op_no"), F.lit(False).alias("bad"))),
    )
    reports = (
        folded.select(*TABLE, F.inline(seen))
        .groupBy(*TABLE, "op_no")
        .agg(F.some("bad").alias("bad"), F.some(~F.col("bad")).alias("found"))
    )
    # An operation on a table that does not exist has no target either.
    needs_target = F.col("op").isin("insertRow", "deleteRow", "mergeCells")
    judged = ops.select(*TABLE, F.col("op_no").cast("int").alias("op_no"), needs_target.alias("needs")).join(
        reports, [*TABLE, "op_no"], "left"
    )
    reason = F.when(F.col("needs") & ~F.coalesce("found", F.lit(False)), MISSING).when(F.col("bad"), CONFLICT)
    first = (
        judged.withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .groupBy(*TABLE)
        .agg(F.min(F.struct("op_no", "reason")).alias("m"))
    )
    return first.select(*TABLE, F.col("m.op_no").alias("failed_op"), F.col("m.reason").alias("reason"))


def table_op_failures(cells: DataFrame, ops: DataFrame) -> DataFrame:
    """First refused operation of each refused table."""
    return _failures(_fold(cells, ops), ops)


def apply_table_ops(cells: DataFrame, ops: DataFrame) -> DataFrame:
    """Cells after each table's operations, applied in order; one refusal keeps the table as it was.

    ``ops``: doc_id, table_idx, op_no, op (insertRow | deleteRow | insertColumn | deleteColumn |
    mergeCells), row, col, position (above | below | left | right), start_row, start_col, end_row,
    end_col. Cells of tables without operations pass by.
    """
    folded = _fold(cells, ops)
    checked = attach(folded, _failures(folded, ops), TABLE, "left")
    before = F.array(F.struct(F.col("row").cast("int").alias("row"), F.col("cells"))).cast(_ROW_TYPE)
    rows = F.when(F.col("failed_op").isNull(), F.col("f.rows")).otherwise(before)
    changed = (
        checked.select(*TABLE, F.inline(rows))
        .select(*TABLE, "row", F.inline("cells"))
        .select(*TABLE, *CELL_FIELDS)
    )
    untouched = cells.join(ops.select(*TABLE).distinct(), TABLE, "left_anti")
    return untouched.select(*TABLE, *CELL_FIELDS).unionByName(changed)


def expected_delta(ops: DataFrame) -> DataFrame:
    """Net rows and columns a list adds; null when it merges cells."""
    merges = F.some(F.col("op") == "mergeCells")
    net = lambda plus, minus: F.sum(
        F.when(F.col("op") == plus, 1).when(F.col("op") == minus, -1).otherwise(0)
    )
    return ops.groupBy(*TABLE).agg(
        F.when(~merges, net("insertRow", "deleteRow")).alias("row_delta"),
        F.when(~merges, net("insertColumn", "deleteColumn")).alias("col_delta"),
    )


def table_shapes(cells: DataFrame) -> DataFrame:
    """Rows, columns and cell count per table."""
    header = F.some("is_header") if "is_header" in cells.columns else F.lit(None).cast("boolean")
    return cells.groupBy(*TABLE).agg(
        F.max(F.col("row") + F.col("row_span")).alias("rows"),
        F.max(F.col("col") + F.col("col_span")).alias("cols"),
        F.count("*").alias("cells"),
        header.alias("has_header"),
    )


def verify_dims(before: DataFrame, after: DataFrame, ops: DataFrame) -> DataFrame:
    """Do the tables have the size their operations should have given them?"""
    b = table_shapes(before).select(*TABLE, F.col("rows").alias("b_rows"), F.col("cols").alias("b_cols"))
    a = table_shapes(after).select(*TABLE, F.col("rows").alias("actual_rows"), F.col("cols").alias("actual_cols"))
    expected_rows, expected_cols = F.col("b_rows") + F.col("row_delta"), F.col("b_cols") + F.col("col_delta")
    return (
        expected_delta(ops)
        .join(b, TABLE, "left")
        .join(a, TABLE, "left")
        .select(
            *TABLE,
            expected_rows.cast("int").alias("expected_rows"),
            expected_cols.cast("int").alias("expected_cols"),
            "actual_rows",
            "actual_cols",
            F.when(F.col("b_rows").isNull(), "table_missing")
            .when(F.col("row_delta").isNull(), "not_checked")
            .when(
                (expected_rows == F.col("actual_rows")) & (expected_cols == F.col("actual_cols")), "ok"
            )
            .otherwise("differs")
            .alias("status"),
        )
    )
