"""Text edits of whole documents: replacements, their checks, and normalisers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.arrays import let, positions, replace_matches
from paperloom.functions.text import (
    B,
    WS,
    change_snippet,
    contains_text,
    first_place,
    count_literal,
    literal_pattern,
    literal_replacement,
)

OVERWRITE_MIN_LENGTH = 2000
OVERWRITE_RATIO = 0.5


def replaced(text: Column, find: str, replace: str, case_sensitive: bool, every: bool) -> Column:
    if not find:
        return text
    if every:
        if case_sensitive:
            return F.replace(text, F.lit(find), F.lit(replace))
        return F.regexp_replace(text, literal_pattern(find, False), literal_replacement(replace))
    at = F.instr(text, find) if case_sensitive else first_place(text, literal_pattern(find, False))
    return let(
        at,
        lambda at: F.when(at == 0, text).otherwise(
            F.overlay(text, F.lit(replace), at, F.lit(len(find)))
        ),
    )


def find_replace(
    docs: DataFrame, find: str, replace: str, case_sensitive: bool = False, every: bool = True
) -> DataFrame:
    """Literal replacement of all or only the first occurrence, with the number replaced."""
    n = count_literal(F.col("text"), find, case_sensitive)
    hit = contains_text(F.col("text"), find, case_sensitive)
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        F.when(hit, replaced(F.col("text"), find, replace, case_sensitive, every))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(hit, n if every else F.lit(1)).otherwise(0).alias("replaced"),
    )


def rename_terms(
    docs: DataFrame, pairs: Sequence[tuple[str, str]], case_sensitive: bool = True
) -> DataFrame:
    """Replacements applied in order, each on the text the one before left."""
    out = docs.withColumn("replaced", F.lit(0))
    for find, replace in pairs:
        n = count_literal(F.col("text"), find, case_sensitive)
        out = out.withColumns(
            {
                "replaced": F.col("replaced") + n,
                "text": replaced(F.col("text"), find, replace, case_sensitive, True),
            }
        )
    return out


def change_snippets(pairs: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Changed lines cut to the change and its surroundings; all, or the first of each document.

    ``pairs``: doc_id, before, after. Lines are compared by number; a line that only one side has
    stands against an empty one.
    """

    def build(b: Column, a: Column) -> Column:
        line = lambda x, i: F.coalesce(F.get(x, i), F.lit(""))
        longer = F.when(F.size(b) >= F.size(a), b).otherwise(a)
        changed = F.filter(positions(longer), lambda i: ~F.get(b, i).eqNullSafe(F.get(a, i)))
        return F.transform(
            changed if max_samples is None else F.slice(changed, 1, max_samples),
            lambda i: F.struct((i + 1).alias("line_no"), change_snippet(line(b, i), line(a, i)).alias("s")),
        )

    rows = let(F.split("before", "\n"), lambda b: let(F.split("after", "\n"), lambda a: build(b, a)))
    return (
        pairs.filter("before <> after")
        .select("doc_id", F.posexplode(rows).alias("k", "x"))
        .select("doc_id", (F.col("k") + 1).alias("sample_no"), "x.line_no", "x.s.before", "x.s.after")
    )


def residual_matches(
    docs: DataFrame, find: str, replace: str, case_sensitive: bool = False
) -> DataFrame:
    """Occurrences left after a replacement; none are looked for when the new text holds the old."""
    norm = (lambda s: s) if case_sensitive else str.lower
    left = F.lit(0) if norm(find) in norm(replace) else count_literal(F.col("text"), find, case_sensitive)
    return docs.select("doc_id", left.alias("remaining"))


def overwrite_risk(pairs: DataFrame) -> DataFrame:
    """A long text replaced by less than half of it: probably cut off, not edited."""
    before, after = F.length("before"), F.length("after")
    return pairs.select(
        "doc_id",
        before.alias("original_length"),
        after.alias("new_length"),
        ((before >= OVERWRITE_MIN_LENGTH) & (after < before * OVERWRITE_RATIO)).alias("at_risk"),
    )


# Date notations that are brought into the form "YYYY. MM. DD.".
OLD_DATES = (
    f"[0-9]{{4}}년{WS}*[0-9]+월{WS}*[0-9]+일",
    B + r"[0-9]{2}\.[0-9]{1,2}\.[0-9]{1,2}" + B,
    B + r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + B,
)
NEW_DATE = f"[0-9]{{4}}\\.{WS}*[0-9]{{2}}\\.{WS}*[0-9]{{2}}\\."
# Months and days as they are written, with what pads them to two digits.
_MONTHS = {"(0[1-9]|1[0-2])": "", "([1-9])": "0"}
_DAYS = {"(0[1-9]|[12][0-9]|3[01])": "", "([1-9])": "0"}


def normalized_dates(text: Column) -> Column:
    """Dates in the old notations rewritten; an impossible month or day stays."""
    for month, pad_m in _MONTHS.items():
        for day, pad_d in _DAYS.items():
            new = f"$1. {pad_m}$2. {pad_d}$3."
            text = F.regexp_replace(text, f"([0-9]{{4}})년{WS}*{month}월{WS}*{day}일", new)
            text = F.regexp_replace(text, f"{B}([0-9]{{2}})\\.{month}\\.{day}{B}", "20" + new)
            if not pad_m and not pad_d:
                text = F.regexp_replace(text, f"{B}([0-9]{{4}})-{month}-{day}{B}", new)
    return text


def with_commas(digits: Column) -> Column:
    return F.regexp_replace(digits, r"([0-9])(?=(?:[0-9]{3})+\z)", "$1,")


AMOUNT = r"(?<![0-9,.])[0-9]{4,}(?=원)"


def add_commas(text: Column) -> Column:
    """Thousands commas in a cell that is a number, or in amounts of won inside a text."""
    return F.when(text.rlike(r"\A[0-9]{4,}\z"), with_commas(text)).otherwise(
        replace_matches(text, AMOUNT, with_commas)
    )
