"""Table operations against a sequential rewrite of the rules on one table at a time."""

import random

from conftest import rows

from paperloom.operators import grid

SCHEMA = "doc_id long, table_idx int, row int, col int, row_span int, col_span int, text string"
OPS = (
    "doc_id long, table_idx int, op_no int, op string, row int, col int, position string,"
    " start_row int, start_col int, end_row int, end_col int"
)


def table(n, m):
    return {(r, c): (1, 1, f"{r}.{c}") for r in range(n) for c in range(m)}


def crosses(start, span, at):
    return span > 1 and start < at <= start + span - 1


def one_op(cells, op):
    """Cells after ``op``, or None when it is refused."""
    kind, row, col = op["op"], op.get("row"), op.get("col")
    if kind in ("insertRow", "deleteRow") and not any(r == row for r, _ in cells):
        return None
    if kind == "insertRow":
        at = row + (op["position"] == "below")
        if any(crosses(r, v[0], at) for (r, _), v in cells.items()):
            return None
        out = {(r + (r >= at), c): v for (r, c), v in cells.items()}
        return out | {(at, c): (1, 1, "") for r, c in cells if r == row}
    if kind == "deleteRow":
        if any((r == row and v[0] > 1) or crosses(r, v[0], row) for (r, _), v in cells.items()):
            return None
        return {(r - (r > row), c): v for (r, c), v in cells.items() if r != row}
    if kind == "insertColumn":
        at = col + (op["position"] == "right")
        if any(crosses(c, v[1], at) for (_, c), v in cells.items()):
            return None
        out = {(r, c + (c >= at)): v for (r, c), v in cells.items()}
        return out | {(r, at): (1, 1, "") for r, _ in cells}
    if kind == "deleteColumn":
        if any((c == col and v[1] > 1) or crosses(c, v[1], col) for (_, c), v in cells.items()):
            return None
        return {(r, c - (c > col)): v for (r, c), v in cells.items() if c != col}
    r0, c0, r1, c1 = (op[k] for k in ("start_row", "start_col", "end_row", "end_col"))
    if (r0, c0) == (r1, c1) or r0 > r1 or c0 > c1 or (r0, c0) not in cells:
        return None
    for (r, c), (rs, cs, _) in cells.items():
        if (rs > 1 or cs > 1) and c <= c1 and c + cs - 1 >= c0 and r <= r1 and r + rs - 1 >= r0:
            return None
    out = {(r, c): v for (r, c), v in cells.items() if not (r0 <= r <= r1 and c0 <= c <= c1)}
    out[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1, cells[r0, c0][2])
    return out


def random_op(rng):
    kind = rng.choice(["insertRow", "deleteRow", "insertColumn", "deleteColumn", "mergeCells"])
    n = lambda: rng.randrange(4)
    if kind == "mergeCells":
        r, c = n(), n()
        return dict(op=kind, start_row=r, start_col=c, end_row=r + rng.randrange(2), end_col=c + rng.randrange(3))
    if kind.endswith("Row"):
        return dict(op=kind, row=n(), position=rng.choice(["above", "below"]))
    return dict(op=kind, col=n(), position=rng.choice(["left", "right"]))


def frame(spark, tables):
    data = [(d, 0, r, c, *v) for d, t in tables.items() for (r, c), v in t.items()]
    return spark.createDataFrame(data, SCHEMA)


def test_random_op_lists(spark):
    rng = random.Random(7)
    tables, lists, want, failed = {}, [], {}, {}
    for d in range(200):
        start = table(4, 4)
        for op in (random_op(rng) for _ in range(2)):
            if op["op"] == "mergeCells":
                start = one_op(start, op) or start
        tables[d], state = start, start
        for no, op in enumerate((random_op(rng) for _ in range(rng.randrange(0, 4))), 1):
            lists.append((d, 0, no, *(op.get(k) for k in ("op", "row", "col", "position", "start_row", "start_col", "end_row", "end_col"))))
            if state is not None:
                state = one_op(state, op)
                if state is None:
                    failed[d] = no
        want[d] = start if state is None else state
    cells, ops = frame(spark, tables), spark.createDataFrame(lists, OPS)
    assert len(failed) > 30 and len(set(range(200)) - set(failed)) > 30
    assert {r.doc_id: r.failed_op for r in grid.table_op_failures(cells, ops).collect()} == failed
    got = {}
    for r in grid.apply_table_ops(cells, ops).collect():
        got.setdefault(r.doc_id, {})[r.row, r.col] = (r.row_span, r.col_span, r.text)
    assert got == {d: t for d, t in want.items() if t}


def test_single_ops_equal_the_rules(spark):
    merged = one_op(table(4, 4), dict(op="mergeCells", start_row=1, start_col=1, end_row=2, end_col=2))
    tables = {0: table(4, 4), 1: merged, 2: table(2, 2)}
    calls = [
        (lambda c: grid.insert_row(c, 1, True), dict(op="insertRow", row=1, position="below")),
        (lambda c: grid.insert_row(c, 3, False), dict(op="insertRow", row=3, position="above")),
        (lambda c: grid.delete_row(c, 0), dict(op="deleteRow", row=0)),
        (lambda c: grid.delete_row(c, 2), dict(op="deleteRow", row=2)),
        (lambda c: grid.insert_column(c, 1, True), dict(op="insertColumn", col=1, position="right")),
        (lambda c: grid.insert_column(c, 0, False), dict(op="insertColumn", col=0, position="left")),
        (lambda c: grid.delete_column(c, 1), dict(op="deleteColumn", col=1)),
        (lambda c: grid.delete_column(c, 3), dict(op="deleteColumn", col=3)),
        (lambda c: grid.merge_cells(c, 0, 0, 1, 0), dict(op="mergeCells", start_row=0, start_col=0, end_row=1, end_col=0)),
        (lambda c: grid.merge_cells(c, 2, 2, 3, 3), dict(op="mergeCells", start_row=2, start_col=2, end_row=3, end_col=3)),
    ]
    cells = frame(spark, tables)
    for run, op in calls:
        got = {}
        for r in run(cells).collect():
            got.setdefault(r.doc_id, {})[r.row, r.col] = (r.row_span, r.col_span, r.text)
        assert got == {d: one_op(t, op) or t for d, t in tables.items()}, op


def test_delete_undoes_insert(spark):
    cells = frame(spark, {0: table(3, 2)})
    back = grid.delete_row(grid.insert_row(cells, 1, True), 2)
    assert rows(back, *SCHEMA.replace(",", "").split()[::2]) == rows(cells, *SCHEMA.replace(",", "").split()[::2])


def test_bad_merge_ranges(spark):
    import pytest

    cells = frame(spark, {0: table(3, 2)})
    for bad in [(0, 0, 0, 0), (1, 0, 0, 1)]:
        with pytest.raises(ValueError):
            grid.merge_cells(cells, *bad)


def test_dims_and_shapes(spark):
    cells = frame(spark, {0: table(3, 2), 1: table(2, 2)})
    ops = spark.createDataFrame(
        [(0, 0, 1, "insertRow", 0, None, "below", None, None, None, None),
         (0, 0, 2, "insertColumn", None, 0, "right", None, None, None, None),
         (1, 0, 1, "mergeCells", None, None, None, 0, 0, 0, 1)],
        OPS,
    )
    after = grid.apply_table_ops(cells, ops)
    assert rows(grid.verify_dims(cells, after, ops), "doc_id", "actual_rows", "actual_cols", "status") == [
        (0, 4, 3, "ok"), (1, 2, 2, "not_checked")
    ]
    assert rows(grid.verify_dims(cells, cells, ops), "doc_id", "status") == [(0, "differs"), (1, "not_checked")]


def test_one_large_table_is_whole(spark):
    """A table that holds nearly all cells."""
    cells = spark.range(40000).selectExpr(
        "if(id < 39900, 0, id) AS doc_id", "0 AS table_idx", "cast(if(id < 39900, id div 4, 0) as int) AS row",
        "cast(if(id < 39900, id % 4, 0) as int) AS col", "1 AS row_span", "1 AS col_span", "cast(id as string) AS text",
    )
    assert grid.insert_row(cells, 0, True).count() == 40000 + 4 + 100
    assert grid.delete_row(cells, 0).count() == 40000 - 4 - 100
