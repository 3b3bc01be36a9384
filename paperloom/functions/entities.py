"""Character entities of XML and HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.arrays import replace_matches


def _code_point(code: Column) -> Column:
    hex8 = F.lpad(F.hex(code), 8, "0")
    ok = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(hex8), "UTF-32"))


def decode_entities(c: Column) -> Column:
    """Named entities, then hexadecimal and decimal ones, ``&amp;`` last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    hexa = lambda m: F.coalesce(
        _code_point(F.conv(F.regexp_extract(m, "x([0-9a-fA-F]+)", 1), 16, 10).try_cast("bigint")), m
    )
    deci = lambda m: F.coalesce(
        _code_point(F.regexp_extract(m, "([0-9]+)", 1).try_cast("bigint")), m
    )
    c = replace_matches(replace_matches(c, "&#x[0-9a-fA-F]+;", hexa), "&#[0-9]+;", deci)
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def escape_xml(c: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        c = F.replace(c, F.lit(char), F.lit(f"&{name};"))
    return c
