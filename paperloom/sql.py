"""The operators from SQL: functions over texts, and views over tables of documents.

``install`` adds functions, which Spark replaces by their expressions, so they are as lazy and as
fast as the DataFrame forms (it takes none inside ``explode``: name the array first). ``publish`` and ``publish_pairs`` name the results of operators over a
table; the views are plans, and filters and column choices reach through them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.functions import pii as p
from paperloom.functions.text import WS
from paperloom.operators import pii, structure
from paperloom.operators.unified import line_changes, unified_diff

VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "lines": structure.lines,
    "blocks": structure.blocks,
    "cells": lambda docs: structure.table_cells(structure.blocks(docs)),
    "runs": lambda docs: structure.inline_runs(structure.blocks(docs)),
    "outline": structure.outline,
    "pii": pii.detect_pii,
    "pii_ranges": pii.pii_ranges,
    "redacted": pii.redact,
}
PAIR_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {"changes": line_changes, "hunks": unified_diff}


def _by_kind(value: Callable[[str], str], otherwise: str) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {value(k)}" for k in p.PATTERNS) + f" ELSE {otherwise} END"


def _mask(kind: str) -> str:
    return {
        p.RRN: "concat(substring(hit, 1, 8), '******')",
        p.CARD: "concat(substring(hit, 1, 4), '-****-****-', right(hit, 4))",
        p.PHONE: "concat_ws('-', split_part(hit, '-', 1), repeat('*', length(split_part(hit, '-', 2))), split_part(hit, '-', 3))",
        p.EMAIL: "concat(substring(hit, 1, 1), '***@', split_part(hit, '@', 2))",
    }[kind]


def functions() -> dict[str, str]:
    """Signature and expression of each function."""
    kinds = ", ".join(f"'{k}'" for k in p.PATTERNS)
    found = _by_kind(lambda k: f"regexp_extract_all(body, r'{p.PATTERNS[k]}', 0)", "CAST(array() AS ARRAY<STRING>)")
    return {
        "doc_lines(body STRING) RETURNS ARRAY<STRING>": r"split(body, '\n')",
        "heading_level(line STRING) RETURNS INT": f"nullif(length(regexp_extract(line, r'{structure.HEADING_WHOLE}', 1)), 0)",
        "squeeze_spaces(body STRING) RETURNS STRING": f"regexp_replace(body, r'{WS}+', ' ')",
        "pii_kinds() RETURNS ARRAY<STRING>": f"array({kinds})",
        "pii_matches(kind STRING, body STRING) RETURNS ARRAY<STRING>": found,
        "pii_mask(kind STRING, hit STRING) RETURNS STRING": _by_kind(_mask, "hit"),
    }


def install(spark: SparkSession) -> None:
    """Adds the functions to the session; a second call replaces them by themselves."""
    for signature, body in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def publish(docs: DataFrame, name: str) -> list[str]:
    """Views ``name`` and ``name_lines``, ``name_blocks`` ... over ``docs`` (doc_id, text).

    Returns the names of the views. They replace views of the same names; nothing is computed here.
    """
    return _views(docs, name, VIEWS)


def publish_pairs(pairs: DataFrame, name: str) -> list[str]:
    """Views ``name``, ``name_changes`` and ``name_hunks`` over two texts a row (pair_id, before, after)."""
    return _views(pairs, name, PAIR_VIEWS)


def _views(df: DataFrame, name: str, makers: dict[str, Callable[[DataFrame], DataFrame]]) -> list[str]:
    made = {name: df} | {f"{name}_{part}": make(df) for part, make in makers.items()}
    for view, rows in made.items():
        rows.createOrReplaceTempView(view)
    return list(made)
