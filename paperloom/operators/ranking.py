"""First-n-per-group, first occurrences, running offsets and sequence gaps.

None of these puts a whole group into one task: top-n is pruned per input partition
before the shuffle, and running totals are computed per bounded bucket with the bucket
totals carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.arrays import let, positions
from paperloom.functions.text import WS


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group with their ``rank``.

    A lone ``row_number() <= n`` is limited on the map side too, so a hot group
    sends at most ``n`` rows per input partition.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal, with one copy of the keys."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in on])


def cap(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int | None = None,
    buckets: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows ranked in their group, plus its true ``total`` and a ``truncated`` flag.

    With ``n`` only the first ``n`` rows of a group, found as in ``top_n``. Without, a group is one
    task unless ``buckets``, as in ``running``, spread it.
    """
    if n is None and buckets:
        ranked = running(df, by, order, buckets, {"rank": F.lit(1)})
        totals = df.groupBy(*by).agg(F.count("*").alias("total"))
        return attach(ranked, totals, by).withColumns({"rank": F.col("rank").cast("int"), "truncated": F.lit(False)})
    if n is None:
        w = Window.partitionBy(*by)
        return df.withColumns(
            {
                "rank": F.row_number().over(w.orderBy(*order)),
                "total": F.count("*").over(w),
                "truncated": F.lit(False),
            }
        )
    totals = df.groupBy(*by).agg(F.count("*").alias("total"))
    return (
        top_n(df, by, order, n)
        .transform(match, totals, list(by))
        .withColumn("truncated", F.col("total") > n)
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    buckets: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums and maxima per ``by`` in ``order``.

    ``buckets`` name expressions from coarse to fine that do not decrease with ``order``. Rows are
    reduced per (group, buckets), the reduced rows run first, and every bucket then runs on its own
    with what was carried into it. A group that holds a large share of the table is thus spread
    over its buckets instead of being one task.
    """
    sums, maxes, buckets = sums or {}, maxes or {}, buckets or {}
    end = Window.currentRow if inclusive else -1
    staged = df.withColumns({f"_v_{n}": v for n, v in {**sums, **maxes}.items()} | buckets)
    keys = [*by, *buckets]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = {n: F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) for n in sums}
    local |= {n: F.max(f"_v_{n}").over(w) for n in maxes}
    if not buckets:
        return staged.withColumns(local).select(*df.columns, *sums, *maxes)
    reduced = staged.groupBy(*keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_s_{n}") for n in maxes],
    )
    carried = running(
        reduced,
        by,
        list(buckets),
        {b: F.col(b) for b in list(buckets)[:-1]},
        {f"_c_{n}": F.col(f"_s_{n}") for n in sums},
        {f"_c_{n}": F.col(f"_s_{n}") for n in maxes},
        inclusive=False,
    ).drop(*[f"_s_{n}" for n in (*sums, *maxes)])
    out = match(staged, carried, keys)
    total = {n: local[n] + F.col(f"_c_{n}") for n in sums}
    total |= {n: F.greatest(local[n], F.col(f"_c_{n}")) for n in maxes}
    return out.withColumns(total).select(*df.columns, *sums, *maxes)


def attach(
    rows: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 4
) -> DataFrame:
    """Join one narrow fact per key onto many rows.

    The rows of a key are salted and the facts repeated per salt. The salt splits a key with a
    large share of the rows, and since it makes both sides shuffle for the join itself (the facts
    usually come from an aggregate on the same key), adaptive skew handling can split it further.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return match(rows.withColumn("_salt", salt), spread, [*on, "_salt"], how).drop("_salt")


def first_occurrences(docs: DataFrame, term: str) -> DataFrame:
    """Hits of ``term`` with the lines they stand on; the first of a document is flagged."""
    hits = F.filter(
        F.transform(
            F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))
        ),
        lambda s: F.contains(s["line"], F.lit(term)),
    )
    return docs.select("doc_id", F.posexplode(hits).alias("k", "h")).select(
        "doc_id", "h.line_no", "h.line", (F.col("k") == 0).alias("is_first")
    )


def section_offsets(section_tables: DataFrame) -> DataFrame:
    """Index of the first table of each section in the document-wide numbering.

    Input: ``doc_id, section, tables``.
    """
    before = (
        Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    )
    return section_tables.withColumn(
        "global_offset", F.coalesce(F.sum("tables").over(before), F.lit(0)).cast("bigint")
    )


NUMBERED = f"^([0-9]+)\\.{WS}"


def _numbered_items(text: Column) -> Column:
    return F.filter(
        F.transform(
            F.split(text, "\n"),
            lambda x, i: F.struct(
                (i + 1).alias("line_no"),
                F.regexp_extract(x, NUMBERED, 1).try_cast("bigint").alias("n"),
            ),
        ),
        lambda s: s["n"].isNotNull(),
    )


def sequence_gaps(docs: DataFrame) -> DataFrame:
    """Places where a numbered list does not go on by one, with the number it should have.

    Numbered lines that follow one another without another line between form a list.
    """

    def build(items: Column) -> Column:
        def gap(x: Column, k: Column) -> Column:
            prev = F.get(items, k - 1)
            return F.struct(
                x["line_no"].alias("line_no"),
                prev["n"].alias("previous"),
                x["n"].alias("found"),
                (prev["n"] + 1).alias("expected"),
                ((prev["line_no"] + 1 == x["line_no"]) & (prev["n"] + 1 != x["n"])).alias("is_gap"),
            )

        return F.filter(F.transform(items, gap), lambda g: g["is_gap"])

    return docs.select("doc_id", F.inline(let(_numbered_items(F.col("text")), build))).drop("is_gap")


def renumber(docs: DataFrame) -> DataFrame:
    """New numbers of numbered lines, so that every list counts up by one from its start."""

    def build(items: Column) -> Column:
        def is_start(k: Column) -> Column:
            prev = F.get(items, k - 1)["line_no"]
            return prev.isNull() | (prev + 1 != F.get(items, k)["line_no"])

        def one_list(starts: Column, s: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(items))
            first = F.get(items, s)["n"]
            return F.transform(
                F.slice(items, s + 1, end - s),
                lambda x, k: F.struct(
                    x["line_no"].alias("line_no"),
                    x["n"].alias("number"),
                    (first + k).alias("new_number"),
                ),
            )

        return let(
            F.filter(positions(items), is_start),
            lambda starts: F.flatten(F.transform(starts, lambda s, j: one_list(starts, s, j))),
        )

    return docs.select("doc_id", F.inline(let(_numbered_items(F.col("text")), build)))
