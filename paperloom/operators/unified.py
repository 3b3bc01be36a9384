"""Line changes and unified diffs of text pairs, and texts patched by them.

Lines are aligned by patience: lines that occur once on both sides are anchors, as many as stay in
order; the gaps between them are aligned in the same way, and where a gap has no such line, by its
rarest common one. A pair is one row and its alignment concerns its two texts only, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.operators.ranking import match

CONTEXT = 3
_HUNK = "hunk_no int, before_start int, before_lines int, after_start int, after_lines int, body string"


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by their first number, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect.bisect_left(tails, b)
        before.append(at[i - 1] if i else -1)
        tails[i : i + 1], at[i : i + 1] = [b], [k]
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def _anchors(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Matched places inside a gap that does not begin or end with equal lines."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    once = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    unique = [(i, once[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in once]
    if unique:
        return _in_order(unique)
    common = [x for x in in_a if x in in_b]
    if not common:
        return []
    rarest = min(common, key=lambda x: (in_a[x] * in_b[x], x))
    return [(a.index(rarest, a0, a1), b.index(rarest, b0, b1))]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of lines that stay, in order on both sides."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        found = _anchors(a, b, a0, a1, b0, b1) if a0 < a1 and b0 < b1 else []
        for i, j in found:
            out.append((i, j))
            gaps.append((a0, i, b0, j))
            a0, b0 = i + 1, j + 1
        if found:
            gaps.append((a0, a1, b0, b1))
    return sorted(out)


def hunks(a: list[str], b: list[str], context: int = CONTEXT) -> list[tuple[int, int, int, int, str]]:
    """(before_start, before_lines, after_start, after_lines, body) of each hunk.

    Starts are line numbers from 1; a side without lines names the line before it, as is usual.
    """
    edits = []
    i = j = 0
    for p, q in [*aligned(a, b), (len(a), len(b))]:
        if (i, j) != (p, q):
            edits.append((i, p, j, q))
        i, j = p + 1, q + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for e in edits:
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for group in groups:
        a0, b0 = max(group[0][0] - context, 0), group[0][2] - min(context, group[0][0])
        a1 = min(group[-1][1] + context, len(a))
        b1 = group[-1][3] + a1 - group[-1][1]
        body, at = [], a0
        for p, q, r, s in group:
            body += [" " + x for x in a[at:p]] + ["-" + x for x in a[p:q]] + ["+" + x for x in b[r:s]]
            at = q
        body += [" " + x for x in a[at:a1]]
        out.append((a0 + (a1 > a0), a1 - a0, b0 + (b1 > b0), b1 - b0, "\n".join(body)))
    return out


def unified_diff(pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Rows of (pair_id, hunk_no, before_start, before_lines, after_start, after_lines, body).

    ``pairs``: pair_id, before, after. body holds the lines of a hunk with a space, - or + before
    each. Equal texts have no hunk; a null text counts as empty, and an empty text is one empty line.
    """
    schema = StructType([*pairs.select("pair_id").schema.fields, *StructType.fromDDL(_HUNK).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (before, after) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if before != after:
                    found = hunks((before or "").split("\n"), (after or "").split("\n"), context)
                    rows += [(n, *h) for n, h in enumerate(found, 1)]
                    at += [k] * len(found)
            types = [pa.int32()] * 5 + [pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.fieldNames())

    return pairs.select("pair_id", "before", "after").mapInArrow(run, schema)


_CHANGE = "change string, before_no int, after_no int, before_text string, after_text string"


def changes(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None, str | None, str | None]]:
    """Every line of both sides once; what is left over in a gap is paired in order as modified."""
    out = []
    i = j = 0
    for p, q in [*aligned(a, b), (len(a), len(b))]:
        for k in range(max(p - i, q - j)):
            old, new = (i + k if i + k < p else None), (j + k if j + k < q else None)
            kind = "added" if old is None else "removed" if new is None else "modified"
            out.append((kind, old, new, None if old is None else a[old], None if new is None else b[new]))
        if p < len(a):
            out.append(("unchanged", p, q, a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def line_changes(pairs: DataFrame) -> DataFrame:
    """Rows of (pair_id, change, before_no, after_no, before_text, after_text), as of ``doc_diff``, for
    the lines of ``pairs`` (pair_id, before, after); numbers start at 0 and moved lines are removed and
    added. A null text counts as empty."""
    schema = StructType([*pairs.select("pair_id").schema.fields, *StructType.fromDDL(_CHANGE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (before, after) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                rows = changes((before or "").split("\n"), (after or "").split("\n"))
                types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows))), *columns], names=schema.fieldNames())

    return pairs.select("pair_id", "before", "after").mapInArrow(run, schema)


def patch_texts(texts: DataFrame, diff: DataFrame) -> DataFrame:
    """Rows of (pair_id, text, applied): texts (pair_id, text) with their hunks applied.

    applied is false, and the text unchanged, where a hunk's old lines are not what stands there.
    Texts without hunks stay; a null text counts as empty where there are hunks.
    """
    hunk = F.struct("hunk_no", "before_start", "before_lines", "body")
    asked = diff.groupBy("pair_id").agg(F.array_sort(F.collect_list(hunk)).alias("_hunks"))
    joined = match(texts.select("pair_id", "text"), asked, ["pair_id"], "left").select("pair_id", "text", "_hunks")
    schema = StructType([*texts.select("pair_id").schema.fields, *StructType.fromDDL("text string, applied boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [patched(t, h) if h else t for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            whole = [m is not None or not h for m, h in zip(made, batch.column(2).to_pylist())]
            texts_ = [m if ok else t for m, ok, t in zip(made, whole, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string()), pa.array(whole, pa.bool_())], names=["pair_id", "text", "applied"])

    return joined.mapInArrow(run, schema)


def patched(text: str | None, found: list[dict]) -> str | None:
    """The text after the hunks, in their order; None if one does not fit."""
    lines, out, at = (text or "").split("\n"), [], 0
    for h in found:
        body = h["body"].split("\n")
        old = [x[1:] for x in body if x[:1] != "+"]
        start = h["before_start"] - (h["before_lines"] > 0)
        if start < at or lines[start : start + len(old)] != old:
            return None
        out += lines[at:start] + [x[1:] for x in body if x[:1] != "-"]
        at = start + len(old)
    return "\n".join(out + lines[at:])
