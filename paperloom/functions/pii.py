"""Patterns and masks of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import B

RRN, CARD, PHONE, EMAIL = "주민등록번호", "신용카드번호", "전화번호", "이메일"
# Types in the order they are applied, with their patterns. A number that is
# part of a longer run of digits and hyphens does not match; repeats are bounded.
PATTERNS = {
    RRN: r"(?<![\d-])\d{6}-[1-4]\d{6}(?![\d-])",
    CARD: r"(?<![\d-])\d{4}-\d{4}-\d{4}-\d{4}(?![\d-])",
    PHONE: r"(?<![\d-])0\d{1,2}-\d{3,4}-\d{4}(?![\d-])",
    EMAIL: B + r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}" + B,
}
# Looser patterns of the check after redaction (no email).
RAW_PATTERNS = (
    B + r"\d{6}-[1-4]\d{6}" + B,
    B + r"0\d{1,2}-\d{3,4}-\d{4}" + B,
    B + r"\d{4}-\d{4}-\d{4}-\d{4}" + B,
)
MASK_EVIDENCE = "***"
MAX_EXAMPLES = 5


def matches(text: Column, kind: str) -> Column:
    """All matches; the cheap check keeps most texts away from the full pattern."""
    sign = F.contains(text, F.lit("@")) if kind == EMAIL else text.rlike(r"\d-\d")
    return F.when(sign, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def mask(kind: str, m: Column) -> Column:
    if kind == RRN:
        return F.concat(F.substring(m, 1, 8), F.lit("******"))
    if kind == CARD:
        return F.concat(F.substring(m, 1, 4), F.lit("-****-****-"), F.right(m, F.lit(4)))
    if kind == PHONE:
        middle = F.split_part(m, F.lit("-"), F.lit(2))
        return F.concat_ws(
            "-",
            F.split_part(m, F.lit("-"), F.lit(1)),
            F.repeat(F.lit("*"), F.length(middle)),
            F.split_part(m, F.lit("-"), F.lit(3)),
        )
    return F.concat(F.substring(m, 1, 1), F.lit("***@"), F.split_part(m, F.lit("@"), F.lit(2)))
