"""Detection, masking, redaction and audit of personal data.

Raw values never leave these operators, only masked forms do (redacted texts aside).
Everything per document happens in its row; only reports over many documents shuffle,
and those send counts and at most a few examples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import pii as p
from paperloom.functions.arrays import let, replace_matches
from paperloom.functions.text import slice_text
from paperloom.operators.ranking import match, top_n


def _may_hold(line: Column) -> Column:
    """Every pattern needs one of these characters, and none reaches over a line end."""
    return F.contains(line, F.lit("@")) | F.contains(line, F.lit("-"))


def _findings(text: Column) -> Column:
    """Array<struct(type_no, type, count, masked)> of the types that occur."""
    return let(
        F.array_join(F.filter(F.split(text, "\n"), _may_hold), "\n"), lambda t: _all_findings(t)
    )


def _all_findings(text: Column) -> Column:

    def one(no: int, kind: str) -> Column:
        return let(
            p.matches(text, kind),
            lambda m: F.struct(
                F.lit(no).alias("type_no"),
                F.lit(kind).alias("type"),
                F.size(m).alias("count"),
                F.transform(
                    F.slice(F.array_distinct(m), 1, p.MAX_EXAMPLES), lambda x: p.mask(kind, x)
                ).alias("masked"),
            ),
        )

    found = F.array(*[one(no, kind) for no, kind in enumerate(p.PATTERNS)])
    return F.filter(found, lambda f: f["count"] > 0)


def detect_pii(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per document and type: number of matches and the first 5 distinct ones, masked."""
    return docs.select("doc_id", *keep, F.inline(_findings(F.col("text"))))


def summary_text(text: Column) -> Column:
    """``type n건, type n건`` or the empty string."""
    return F.array_join(
        F.transform(
            _findings(text),
            lambda f: F.concat(f["type"], F.lit(" "), f["count"].cast("string"), F.lit("건")),
        ),
        ", ",
    )


def summarize_pii(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", summary_text(F.coalesce("text", F.lit(""))).alias("summary"))


def redacted(text: Column) -> Column:
    """Pattern by pattern, each on the text the one before left."""

    def one(line: Column) -> Column:
        for kind in p.PATTERNS:
            line = replace_matches(line, p.PATTERNS[kind], lambda m, k=kind: p.mask(k, m))
        return line

    return F.array_join(
        F.transform(F.split(text, "\n"), lambda x: F.when(_may_hold(x), one(x)).otherwise(x)), "\n"
    )


def redact(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", redacted(F.col("text")))


def _type_ranges(text: Column, no: int, kind: str) -> Column:
    """Offsets of one pattern: lengths of the pieces between matches, added up."""
    pattern = p.PATTERNS[kind]

    def build(hits: Column, pieces: Column) -> Column:
        steps = F.zip_with(
            hits,
            pieces,
            lambda h, piece: F.struct(h.alias("h"), F.length(piece).alias("gap")),
        )
        start = F.struct(
            F.array().cast("array<struct<start:int,end:int,type_no:int,type:string,replacement:string>>").alias("out"),
            F.lit(0).alias("at"),
        )
        folded = F.aggregate(
            F.filter(steps, lambda s: s["h"].isNotNull()),
            start,
            lambda acc, s: F.struct(
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + s["gap"]).alias("start"),
                        (acc["at"] + s["gap"] + F.length(s["h"])).alias("end"),
                        F.lit(no).alias("type_no"),
                        F.lit(kind).alias("type"),
                        p.mask(kind, s["h"]).alias("replacement"),
                    ),
                ).alias("out"),
                (acc["at"] + s["gap"] + F.length(s["h"])).alias("at"),
            ),
        )
        return folded["out"]

    return let(
        p.matches(text, kind), lambda hits: let(F.split(text, pattern, -1), lambda ps: build(hits, ps))
    )


def _line_ranges(text: Column, offset: Column) -> Column:
    """Non-overlapping ranges of one line, shifted by where the line begins."""
    every = F.flatten(F.array(*[_type_ranges(text, no, k) for no, k in enumerate(p.PATTERNS)]))
    keyed = F.array_sort(
        F.transform(
            every,
            lambda r: F.struct(
                r["start"].alias("start"),
                (-r["end"]).alias("neg_end"),
                r["type_no"].alias("type_no"),
                r["type"].alias("type"),
                r["replacement"].alias("replacement"),
            ),
        )
    )
    first = F.struct(
        F.array().cast("array<struct<start:int,end:int,type:string,replacement:string>>").alias("out"),
        F.lit(-1).alias("last_end"),
    )
    return F.aggregate(
        keyed,
        first,
        lambda acc, r: F.when(
            r["start"] >= acc["last_end"],
            F.struct(
                F.array_append(
                    acc["out"],
                    F.struct(
                        (r["start"] + offset).alias("start"),
                        (offset - r["neg_end"]).alias("end"),
                        r["type"].alias("type"),
                        r["replacement"].alias("replacement"),
                    ),
                ).alias("out"),
                (-r["neg_end"]).alias("last_end"),
            ),
        ).otherwise(acc),
    )["out"]


def ranges(text: Column) -> Column:
    """Non-overlapping ``[start, end)`` ranges: earlier first, longer first at the same start.

    No match reaches over a line end, so only the lines that may hold one are searched.
    """
    start = F.struct(
        F.array().cast("array<struct<offset:int,line:string>>").alias("out"), F.lit(0).alias("at")
    )
    lines = F.aggregate(
        F.split(text, "\n"),
        start,
        lambda acc, x: F.struct(
            F.when(
                _may_hold(x),
                F.array_append(acc["out"], F.struct(acc["at"].alias("offset"), x.alias("line"))),
            )
            .otherwise(acc["out"])
            .alias("out"),
            (acc["at"] + F.length(x) + 1).alias("at"),
        ),
    )["out"]
    return F.flatten(F.transform(lines, lambda x: _line_ranges(x["line"], x["offset"])))


def pii_ranges(docs: DataFrame) -> DataFrame:
    """One row per range to mask, in order."""
    return (
        docs.select("doc_id", F.posexplode(ranges(F.col("text"))).alias("i", "r"))
        .select("doc_id", (F.col("i") + 1).alias("range_no"), "r.start", "r.end", "r.type", "r.replacement")
    )


def redact_by_ranges(docs: DataFrame) -> DataFrame:
    """Text with every kept range replaced in one pass."""

    def build(rs: Column) -> Column:
        text = F.col("text")
        parts = F.transform(
            rs,
            lambda r, i: let(
                F.coalesce(F.get(rs, i - 1)["end"], F.lit(0)),
                lambda prev: F.concat(slice_text(text, prev, r["start"] - prev), r["replacement"]),
            ),
        )
        last = F.get(rs, F.size(rs) - 1)["end"]
        return F.when(F.size(rs) == 0, text).otherwise(
            F.concat(F.array_join(parts, ""), slice_text(text, last, F.length(text) - last))
        )

    return docs.withColumn("text", let(ranges(F.col("text")), build))


def merge_findings(findings: DataFrame, by: Sequence[str], order: str = "doc_id") -> DataFrame:
    """Counts summed and the first 5 distinct masked examples over many documents.

    ``findings``: output of ``detect_pii``. Examples are reduced to one row per distinct
    value before ranking, so neither a busy group nor a repeated value gathers in one task.
    """
    # One row per distinct example; the count of a finding is carried by its first example.
    examples = (
        findings.select(*by, "type", "type_no", order, "count", F.posexplode("masked").alias("i", "example"))
        .groupBy(*by, "type", "type_no", "example")
        .agg(
            F.sum(F.when(F.col("i") == 0, F.col("count"))).alias("n"),
            F.min(F.struct(F.col(order).alias("first"), "i")).alias("seen"),
        )
    )
    counts = examples.groupBy(*by, "type", "type_no").agg(
        F.sum("n").cast("bigint").alias("count"), F.min("seen").alias("seen")
    )
    kept = (
        top_n(examples, [*by, "type"], [F.col("seen")], p.MAX_EXAMPLES)
        .groupBy(*by, "type")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("e"), F.sum("n").alias("shown"))
    )
    # Both sides keep the same columns of ``examples``, so its shuffle is made once and reused and
    # the texts are searched once: "shown" is never above "count", and "seen" is never null.
    joined = match(counts, kept, [*by, "type"]).filter("shown <= count AND seen IS NOT NULL")
    return joined.select(
        *by,
        "type",
        "count",
        F.transform("e", lambda x: x["example"]).alias("masked"),
        F.col("seen.first").alias("first_seen"),
        "type_no",
    )


def redaction_report(merged: DataFrame, by: Sequence[str]) -> DataFrame:
    """One text per group: the total, then each type with its count and up to 3 examples."""
    line = F.concat(
        F.lit("- "),
        F.col("type"),
        F.lit(": "),
        F.col("count").cast("string"),
        F.lit("건 → "),
        F.array_join(F.slice("masked", 1, 3), ", "),
    )
    # At most one row per type and group, so the list holds four lines or fewer.
    lines = F.array_sort(F.collect_list(F.struct("first_seen", "type_no", line.alias("line"))))
    return (
        merged.groupBy(*by)
        .agg(F.sum("count").alias("total"), lines.alias("l"))
        .select(
            *by,
            F.col("total").cast("bigint").alias("total"),
            F.array_join(
                F.concat(
                    F.array(F.concat(F.lit("개인정보 "), F.col("total").cast("string"), F.lit("건 비식별 처리"))),
                    F.transform("l", lambda x: x["line"]),
                ),
                "\n",
            ).alias("report"),
        )
    )


def residual_pii(docs: DataFrame) -> DataFrame:
    """Does a redacted text still hold raw numbers, and does it show any mask?"""
    numbers = F.array_join(
        F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("-"))), "\n"
    )
    raw_kinds = let(
        numbers,
        lambda t: sum((t.rlike(pattern).cast("int") for pattern in p.RAW_PATTERNS), F.lit(0)),
    )
    return docs.select(
        "doc_id",
        raw_kinds.alias("raw_kinds"),
        F.contains("text", F.lit(p.MASK_EVIDENCE)).alias("has_mask"),
    ).withColumn("pass", (F.col("raw_kinds") == 0) & F.col("has_mask"))


def proposal_pii_warnings(proposals: DataFrame) -> DataFrame:
    """Appends a warning to proposals whose diff holds personal data."""
    found = summary_text(F.coalesce("diff", F.lit("")))
    warning = lambda s: F.concat(
        F.lit("개인정보 포함: 이번 변경 영역에 "), s, F.lit("이(가) 있습니다. 외부 공유 시 주의하세요.")
    )
    old = F.coalesce("warnings", F.array().cast("array<string>"))
    return proposals.withColumn(
        "warnings",
        let(found, lambda s: F.when(s == "", old).otherwise(F.array_append(old, warning(s)))),
    )
