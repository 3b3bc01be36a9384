"""Edits of table cells, sheet cells, form fields and form controls.

All of them check first and change after: a document with one failed edit stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import nfc
from paperloom.operators.ranking import attach, running
from paperloom.operators.search import label_targets

CELL = ["doc_id", "table_idx", "row", "col"]


def validate_edits(edits: DataFrame) -> DataFrame:
    """Adds ``mode``: ``label``, ``coordinate``, ``both_modes`` or ``incomplete``."""
    has_label = F.col("label").isNotNull()
    any_coordinate = F.col("row").isNotNull() | F.col("col").isNotNull()
    complete = F.col("table_idx").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    return edits.withColumn(
        "mode",
        F.when(has_label & any_coordinate, "both_modes")
        .when(has_label, "label")
        .when(complete, "coordinate")
        .otherwise("incomplete"),
    )


def cell_edit_results(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Each edit with its target, the text it would replace and a status.

    ``edits``: doc_id, edit_no, table_idx, row, col, label, direction, new_text, expected_text.
    """
    checked = validate_edits(edits)
    by_label = checked.filter("mode = 'label'").withColumn("request_no", F.col("edit_no"))
    pointed = label_targets(cells, by_label).select(
        "doc_id",
        F.col("request_no").alias("edit_no"),
        "matches",
        *[F.when(F.col("matches") == 1, F.col(c)).alias(f"_{c}") for c in ("table_idx", "row", "col")],
    )
    is_label = F.col("mode") == "label"
    place = lambda c: F.when(is_label, F.col(f"_{c}")).when(
        F.col("mode") == "coordinate", F.col(c)
    )
    # Edits grow with the cells. Sent to every task, they would leave the shuffled cells to be read
    # by as many tasks as wrote them, whatever their size.
    placed = checked.join(pointed.hint("merge"), ["doc_id", "edit_no"], "left").select(
        "doc_id",
        "edit_no",
        *[place(c).alias(c) for c in ("table_idx", "row", "col")],
        "new_text",
        "expected_text",
        is_label.alias("by_label"),
        F.when(F.col("mode").isin("both_modes", "incomplete"), F.col("mode"))
        .when(is_label & (F.col("matches") == 0), "label_missing")
        .when(is_label & (F.col("matches") > 1), "label_ambiguous")
        .alias("problem"),
    )
    current = cells.select(*CELL, F.col("text").alias("old_text"))
    tables = cells.select("doc_id", "table_idx").distinct().withColumn("has_table", F.lit(True))
    joined = placed.join(current.hint("merge"), CELL, "left").join(tables.hint("merge"), ["doc_id", "table_idx"], "left")
    # Equal texts need no normal form; it is taken only of those that differ.
    unequal = F.col("expected_text") != F.col("old_text")
    pair = joined.withColumns(
        {
            "_want": nfc(F.when(unequal, F.col("expected_text"))),
            "_have": nfc(F.when(unequal, F.col("old_text"))),
        }
    )
    differs = F.coalesce(F.col("_want") != F.col("_have"), F.lit(False))
    return (
        pair.select(
            "doc_id",
            "edit_no",
            "table_idx",
            "row",
            "col",
            "old_text",
            "new_text",
            F.coalesce(
                F.col("problem"),
                F.when(F.col("by_label") & F.col("old_text").isNull(), "target_missing"),
                F.when(F.col("has_table").isNull(), "table_missing"),
                F.when(F.col("old_text").isNull(), "cell_missing"),
                F.when(differs, "text_differs"),
                F.lit("ok"),
            ).alias("status"),
        )
    )


def apply_cell_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells after the edits of every document whose edits are all ``ok``."""
    results = cell_edit_results(cells, edits)
    clean = results.groupBy("doc_id").agg(F.every(F.col("status") == "ok").alias("clean"))
    accepted = attach(results, clean.filter("clean"), ["doc_id"])
    # A struct, so that a null new text is an edit too: it empties the cell.
    last = accepted.groupBy(*CELL).agg(F.max_by(F.struct("new_text"), "edit_no").alias("_edit"))
    emptied = F.coalesce("_edit.new_text", F.lit(""))
    return cells.join(last, CELL, "left").select(
        *[c for c in cells.columns if c != "text"],
        F.when(F.col("_edit").isNotNull(), emptied).otherwise(F.col("text")).alias("text"),
    )


def cell_address(address: Column) -> tuple[Column, Column]:
    """0-based (row, col) of an A1 address."""
    letters = F.regexp_extract(F.upper(address), "^([A-Z]+)[0-9]+$", 1)
    row = F.regexp_extract(address, "([0-9]+)$", 1).try_cast("int") - 1
    col = F.aggregate(
        F.transform(F.split(letters, ""), lambda ch: F.ascii(ch) - 64),
        F.lit(0),
        lambda acc, n: acc * 26 + n,
    ) - 1
    return row, F.when(letters != "", col)


def cell_name(row: Column, col: Column) -> Column:
    """A1 address of a 0-based (row, col), for columns A to ZZZ."""
    n = col + 1
    one = lambda v: F.char(v + 64)
    name = (
        F.when(n <= 26, one(n))
        .when(n <= 702, F.concat(one(F.floor((n - 1) / 26)), one((n - 1) % 26 + 1)))
        .otherwise(
            F.concat(
                one(F.floor((n - 703) / 676) + 1),
                one(F.floor((n - 703) % 676 / 26) + 1),
                one((n - 1) % 26 + 1),
            )
        )
    )
    return F.concat(name, (row + 1).cast("string"))


def shown_value(kind: Column, text: Column, formula: Column, ts: Column) -> Column:
    """What an old sheet value looks like in a change table. Dates are read as UTC."""
    date = F.date_format(ts, "yyyy. MM. dd.")
    half = F.when(F.hour(ts) < 12, "오전").otherwise("오후")
    has_time = F.date_format(ts, "HHmmss") != "000000"
    return (
        F.when(kind.isNull() | (kind == "null"), "(빈 셀)")
        .when(
            kind == "formula",
            F.concat(
                F.lit("="),
                formula,
                F.when(text.isNull(), "").otherwise(F.concat(F.lit(" (결과: "), text, F.lit(")"))),
            ),
        )
        .when(
            kind == "date",
            F.when(
                has_time, F.concat_ws(" ", date, half, F.date_format(ts, "hh:mm:ss"))
            ).otherwise(date),
        )
        .otherwise(text)
    )


def sheet_edit_results(sheet_cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Change table of sheet updates, one row each. A slave of a merged range edits its master.

    ``sheet_cells``: doc_id, sheet, row, col, kind, value_text, value_ts, formula, master_row,
    master_col; ``updates``: doc_id, update_no, sheet, cell, value. Within a document the updates
    apply in order, so a later one sees the value an earlier one wrote.
    """
    row, col = cell_address(F.col("cell"))
    asked = updates.withColumns({"row": row, "col": col})
    sheets = sheet_cells.select("doc_id", "sheet").distinct().withColumn("has_sheet", F.lit(True))
    masters = sheet_cells.filter("master_row IS NOT NULL").select(
        "doc_id", "sheet", "row", "col", "master_row", "master_col"
    )
    slave = F.col("master_row").isNotNull() & (
        (F.col("master_row") != F.col("row")) | (F.col("master_col") != F.col("col"))
    )
    target = (
        asked.join(sheets, ["doc_id", "sheet"], "left")
        .join(masters, ["doc_id", "sheet", "row", "col"], "left")
        .select(
            "doc_id",
            "update_no",
            "sheet",
            "cell",
            "value",
            "has_sheet",
            slave.alias("is_slave"),
            F.when(slave, F.col("master_row")).otherwise(F.col("row")).alias("row"),
            F.when(slave, F.col("master_col")).otherwise(F.col("col")).alias("col"),
        )
    )
    current = sheet_cells.select(
        "doc_id", "sheet", "row", "col", "kind", "value_text", "value_ts", "formula"
    )
    # What an earlier update of the same cell wrote.
    chained = running(
        target,
        ["doc_id", "sheet", "row", "col"],
        ["update_no"],
        {"_block": F.floor(F.col("update_no") / 1024)},
        maxes={"_last": F.struct("update_no", "value")},
        inclusive=False,
    ).withColumn("written", F.col("_last.value"))
    joined = chained.join(current, ["doc_id", "sheet", "row", "col"], "left")
    address = F.concat(F.col("sheet"), F.lit("!"), F.col("cell"))
    master = cell_name(F.col("row"), F.col("col"))
    overwrites_formula = F.col("written").isNull() & (F.col("kind") == "formula")
    return joined.select(
        "doc_id",
        "update_no",
        "sheet",
        "row",
        "col",
        F.when(F.col("is_slave"), F.concat(address, F.lit(" → "), master))
        .otherwise(address)
        .alias("target"),
        F.coalesce(
            "written",
            shown_value(F.col("kind"), F.col("value_text"), F.col("formula"), F.col("value_ts")),
        ).alias("old_value"),
        F.col("value").alias("new_value"),
        F.when(F.col("has_sheet").isNull(), "sheet_missing")
        .when(F.col("row").isNull() | F.col("col").isNull(), "address_invalid")
        .otherwise("ok")
        .alias("status"),
        F.coalesce(F.col("is_slave"), F.lit(False)).alias("merged_warning"),
        F.coalesce(overwrites_formula, F.lit(False)).alias("formula_warning"),
    )


def apply_sheet_edits(sheet_cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Sheet cells after the updates of every document whose updates are all ``ok``."""
    results = sheet_edit_results(sheet_cells, updates)
    clean = results.groupBy("doc_id").agg(F.every(F.col("status") == "ok").alias("clean"))
    key = ["doc_id", "sheet", "row", "col"]
    last = (
        attach(results, clean.filter("clean"), ["doc_id"])
        .groupBy(*key)
        .agg(F.max_by(F.struct("new_value"), "update_no").alias("_edit"))
    )
    # A null new value empties the cell.
    changed, new = F.col("_edit").isNotNull(), F.col("_edit.new_value")
    return sheet_cells.join(last, key, "full").select(
        *key,
        F.when(changed & new.isNull(), "null").when(changed, "string").otherwise(F.col("kind")).alias("kind"),
        F.when(changed, new).otherwise(F.col("value_text")).alias("value_text"),
        F.when(~changed, F.col("value_ts")).alias("value_ts"),
        F.when(~changed, F.col("formula")).alias("formula"),
        "master_row",
        "master_col",
    )


NO_VALUE = "(없음)"  # fixed value


def fill_fields(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Change table of a form fill; a document where no label fits is ``rejected``.

    ``fields``: doc_id, field_no, label, value (the last of equal labels counts);
    ``values``: doc_id, label, value.
    """
    known = fields.groupBy("doc_id", "label").agg(F.max_by("value", "field_no").alias("old_value"))
    joined = values.withColumnRenamed("value", "new_value").join(
        # Both sides grow alike, so neither is sent to every task, however small it looks.
        known.withColumn("matched", F.lit(True)).hint("merge"), ["doc_id", "label"], "left"
    )
    diff = joined.select(
        "doc_id",
        "label",
        F.coalesce("old_value", F.lit(NO_VALUE)).alias("old_value"),
        "new_value",
        F.coalesce("matched", F.lit(False)).alias("matched"),
    )
    any_match = diff.groupBy("doc_id").agg(F.some("matched").alias("any_matched"))
    return attach(diff, any_match.hint("merge"), ["doc_id"]).select(
        "doc_id",
        "label",
        "old_value",
        "new_value",
        F.when(~F.col("any_matched"), "rejected")
        .when(F.col("matched"), "filled")
        .otherwise("unmatched")
        .alias("status"),
    )


# What may be set on each control type.
SETTABLE = {
    "button": "caption",
    "checkBox": "checked",
    "radioButton": "checked",
    "comboBox": "selected",
    "edit": "text",
}


def form_edit_results(form_objects: DataFrame, edits: DataFrame) -> DataFrame:
    """Each control edit with the old value and a status.

    ``form_objects``: doc_id, idx, name, type, value_text, value_bool, combo_items;
    ``edits``: doc_id, edit_no, name, idx (null unless names repeat), set_key, set_text, set_bool,
    expected_text, expected_bool.
    """
    objects = form_objects.select(
        "doc_id", "name", F.col("idx").alias("o_idx"), "type", "value_text", "value_bool", "combo_items"
    )
    # Edits grow with the controls, so neither side may be held whole by the driver and every task.
    found = (
        edits.join(objects.hint("merge"), ["doc_id", "name"])
        .filter(F.col("idx").isNull() | (F.col("idx") == F.col("o_idx")))
        .groupBy("doc_id", "edit_no")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("o_idx", "type", "value_text", "value_bool", "combo_items")).alias("o"),
        )
    )
    allowed = F.create_map(*[F.lit(x) for kv in SETTABLE.items() for x in kv])
    is_flag = F.col("o.type").isin("checkBox", "radioButton")
    old = F.when(is_flag, F.col("o.value_bool").cast("string")).otherwise(F.col("o.value_text"))
    expected = F.coalesce(F.col("expected_text"), F.col("expected_bool").cast("string"))
    # The value stands in the slot of its key: a flag for a check, a text for all others.
    has_text, has_flag = F.col("set_text").isNotNull(), F.col("set_bool").isNotNull()
    wrong_slot = F.when(F.col("set_key") == "checked", has_text).otherwise(has_flag)
    return (
        edits.join(found.hint("merge"), ["doc_id", "edit_no"], "left")
        .select(
            "doc_id",
            "edit_no",
            "name",
            F.col("o.o_idx").alias("idx"),
            old.alias("old_value"),
            F.coalesce("set_text", F.col("set_bool").cast("string")).alias("new_value"),
            "set_text",
            "set_bool",
            F.when(F.col("n").isNull(), "not_found")
            .when(F.col("n") > 1, "ambiguous")
            .when(F.col("set_key").isNull(), "nothing_set")
            .when(has_text & has_flag, "too_much_set")
            .when(~has_text & ~has_flag, "nothing_set")
            .when(~F.coalesce(F.col("set_key") == allowed[F.col("o.type")], F.lit(False)), "type_mismatch")
            .when(wrong_slot, "type_mismatch")
            .when(expected.isNotNull() & (expected != old), "value_differs")
            .when(
                (F.col("o.type") == "comboBox")
                & ~F.coalesce(F.array_contains(F.col("o.combo_items"), F.col("set_text")), F.lit(False)),
                "not_an_item",
            )
            .otherwise("ok")
            .alias("status"),
        )
    )


def apply_form_edits(form_objects: DataFrame, edits: DataFrame) -> DataFrame:
    """Controls after the edits of every document whose edits are all ``ok``."""
    results = form_edit_results(form_objects, edits)
    clean = results.groupBy("doc_id").agg(F.every(F.col("status") == "ok").alias("clean"))
    last = (
        attach(results, clean.filter("clean"), ["doc_id"])
        .groupBy("doc_id", "idx")
        .agg(F.max_by(F.struct("set_text", "set_bool"), "edit_no").alias("s"))
    )
    return form_objects.join(last, ["doc_id", "idx"], "left").select(
        *[c for c in form_objects.columns if c not in ("value_text", "value_bool")],
        F.coalesce("s.set_text", "value_text").alias("value_text"),
        F.coalesce("s.set_bool", "value_bool").alias("value_bool"),
    )
