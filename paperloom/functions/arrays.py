"""Array idioms.

A document is one row, so anything local to a document is computed inside its row:
no shuffle, and no group that could grow hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    Without the binding Catalyst may inline the expression into a lambda, where it
    would be evaluated once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(arr: Column) -> Column:
    """0-based positions of ``arr``; empty for an empty array."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def flag_at(arr: Column, i: Column) -> Column:
    """Boolean element at ``i``; false outside the array."""
    return F.coalesce(F.get(arr, i), F.lit(False))


def replace_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``fn(match)``."""

    def joined(t: Column, hits: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(t, pattern, -1),
                lambda piece, i: F.concat(piece, F.coalesce(fn(F.get(hits, i)), F.lit(""))),
            ),
            "",
        )

    # Bound, since calls nest: a text that is an expression would be evaluated at each use.
    return let(
        text,
        lambda t: F.when(
            t.rlike(pattern),
            let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda hits: joined(t, hits)),
        ).otherwise(t),
    )
