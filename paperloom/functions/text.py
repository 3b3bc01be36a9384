"""Text helpers. Lengths and offsets count code points."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.arrays import let

# White space as ECMAScript defines it (Java's \s is ASCII only).
SPACE_STRING = (
    "\t\n\v\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CHARS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{SPACE_CHARS}]"
NOT_WS = f"[^{SPACE_CHARS}]"
# ASCII word boundary (Java's \b also counts Hangul and accented letters as word characters).
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_STRING))


def trim_end_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_STRING))


def is_blank(c: Column) -> Column:
    return ~c.rlike(NOT_WS)


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def clip(c: Column, limit: int, mark: str = "…") -> Column:
    """First ``limit`` characters, with ``mark`` when something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


@lru_cache(1)
def _same_lower() -> dict[str, str]:
    """Characters by the single character that is their lower case, itself included."""
    found: dict[str, str] = {}
    for code in range(sys.maxunicode + 1):
        low = chr(code).lower()
        if len(low) == 1 and low != chr(code):
            found[low] = found.get(low, low) + chr(code)
    return found


def literal_pattern(find: str, case_sensitive: bool) -> str:
    """Regular expression that matches ``find`` literally.

    Without case, a character stands for all that have the same lower case and for nothing else;
    hits, counts and replacements all go by this pattern, in the text as it is.
    """
    if case_sensitive:
        return re.sub(r"([^\w\s])", r"\\\1", find)
    same = _same_lower()
    return "".join(f"[{same[c]}]" if c in same else re.sub(r"([^\w\s])", r"\\\1", c) for c in find.lower())


def literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def contains_text(c: Column, query: str, case_sensitive: bool = False) -> Column:
    if case_sensitive:
        return F.contains(c, F.lit(query))
    return c.rlike(literal_pattern(query, False))


def count_literal(c: Column, find: str, case_sensitive: bool) -> Column:
    """Number of non-overlapping occurrences of ``find``."""
    if not case_sensitive:
        return F.regexp_count(c, F.lit(literal_pattern(find, False))).cast("int") if find else F.lit(0)
    removed = F.length(c) - F.length(F.replace(c, F.lit(find), F.lit("")))
    return (removed / len(find)).cast("int")


def first_place(c: Column, pattern: str) -> Column:
    """1-based place of the first match, 0 without one."""
    return F.when(c.rlike(pattern), F.length(F.get(F.split(c, pattern, 2), F.lit(0))) + 1).otherwise(0)


def slice_text(c: Column, start: Column, length: Column) -> Column:
    """Substring from the 0-based ``start``."""
    return c.substr((start + 1).cast("int"), length.cast("int"))


def window_text(c: Column, query: str, case_sensitive: bool, width: int = 60) -> Column:
    """About ``width`` characters around the first match, ``…`` on each side that was cut."""
    at = F.instr(c, query) if case_sensitive else first_place(c, literal_pattern(query, False))
    half = (width - len(query)) // 2
    q = len(query)

    def cut(idx: Column) -> Column:
        start = F.greatest(F.lit(0), idx - half)
        end = F.least(F.length(c), idx + q + half)
        return F.concat(
            F.when(start > 0, "…").otherwise(""),
            slice_text(c, start, F.greatest(end - start, F.lit(0))),
            F.when(end < F.length(c), "…").otherwise(""),
        )

    return let(
        at - 1,
        lambda idx: F.when(idx < 0, F.substring(c, 1, width)).otherwise(cut(idx)),
    )


def common_prefix_len(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by doubling steps instead of a character array."""
    shorter = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return let(
        shorter,
        lambda n: F.aggregate(
            F.filter(steps, lambda s: s <= n),
            F.lit(0),
            lambda acc, s: F.when(
                (acc + s <= n) & (a.substr(acc + 1, s) == b.substr(acc + 1, s)), acc + s
            ).otherwise(acc),
        ),
    )


def change_snippet(before: Column, after: Column, context: int = 24) -> Column:
    """Struct(before, after) cut to the changed middle plus ``context`` characters."""

    def cut(s: Column, p: Column, tail: Column) -> Column:
        start = F.greatest(F.lit(0), p - context)
        end = F.least(F.length(s), F.length(s) - tail + context)
        return F.concat(
            F.when(start > 0, "…").otherwise(""),
            slice_text(s, start, F.greatest(end - start, F.lit(0))),
            F.when(end < F.length(s), "…").otherwise(""),
        )

    def with_prefix(p: Column) -> Column:
        room = F.least(F.length(before), F.length(after)) - p
        tail = F.least(common_prefix_len(F.reverse(before), F.reverse(after)), room)
        return let(
            tail,
            lambda t: F.struct(cut(before, p, t).alias("before"), cut(after, p, t).alias("after")),
        )

    return let(common_prefix_len(before, after), with_prefix)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


# Latin, kana, CJK ideographs and Hangul syllables: texts of these only are in NFC already.
_NFC_SAFE_ONLY = r"\A[\x00-\u02FF\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]*\z"


def nfc(c: Column) -> Column:
    """NFC form. Spark has no built-in for it; only texts that may need it go through Arrow."""
    return F.coalesce(_nfc(F.when(~c.rlike(_NFC_SAFE_ONLY), c)), c)


def with_nfc(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with the NFC form of ``c`` as ``name``; rows that are safe skip the Python stage."""
    staged = df.withColumn(name, c)
    safe = F.coalesce(F.col(name).rlike(_NFC_SAFE_ONLY), F.lit(True))
    return staged.filter(safe).unionByName(
        staged.filter(~safe).withColumn(name, _nfc(F.col(name)))
    )
