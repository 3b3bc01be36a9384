"""Text -> lines -> blocks -> cells, outlines and read views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.arrays import flag_at, let, positions
from paperloom.functions.entities import decode_entities
from paperloom.functions.text import SPACE_CHARS, WS, contains_text, is_blank, trim_end_ws, trim_ws

HEADING = f"^(#{{1,6}}){WS}+(.+)"
HEADING_WHOLE = f"{HEADING}\\z"
BULLET = f"^[-*+]{WS}+"
TABLE_RULE = f"^\\|[{SPACE_CHARS}:|-]+\\|"
NO_HEADINGS = "(헤딩이 없습니다)"  # fixed value
# The limits of a reader that shows part of a text; nothing is cut unless they are asked for.
READ_CAP = 80_000
MAX_EXCERPTS = 50


def text_lines(c: Column) -> Column:
    return F.split(c, "\n")


def lines(docs: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return docs.select(
        "doc_id", F.posexplode(text_lines(F.col("text"))).alias("i", "text")
    ).select("doc_id", (F.col("i") + 1).alias("line_no"), "text")


def _line_kind(line: Column) -> Column:
    return (
        F.when(is_blank(line), "blank")
        .when(line.rlike(HEADING_WHOLE), "heading")
        .when(line.rlike(BULLET), "list")
        .when(F.startswith(trim_ws(line), F.lit("|")), "table")
        .otherwise("paragraph")
    )


def _block_structs(text_lines_: Column) -> Column:
    """Array of blocks of one document. Only a run of table lines spans several lines."""

    def from_kinds(ln: Column, kinds: Column) -> Column:
        def is_start(i: Column) -> Column:
            kind = F.get(kinds, i)
            inside_table = (kind == "table") & (F.coalesce(F.get(kinds, i - 1), F.lit("")) == "table")
            return (kind != "blank") & ~inside_table

        def from_starts(starts: Column, table_starts: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                kind, line = F.get(kinds, s), F.get(ln, s)
                nxt = F.coalesce(F.get(starts, k + 1), F.size(ln))
                body = F.filter(F.slice(ln, s + 1, nxt - s), lambda x: ~is_blank(x))
                return F.struct(
                    (k + 1).alias("block_no"),
                    kind.alias("type"),
                    F.when(
                        kind == "heading", F.length(F.regexp_extract(line, HEADING_WHOLE, 1))
                    ).alias("level"),
                    F.when(kind == "heading", F.regexp_extract(line, HEADING_WHOLE, 2))
                    .when(kind == "list", F.regexp_replace(line, BULLET, ""))
                    .when(kind == "table", F.array_join(body, "\n"))
                    .otherwise(line)
                    .alias("text"),
                    F.when(kind == "table", (F.array_position(table_starts, s) - 1).cast("int")).alias(
                        "table_idx"
                    ),
                    F.lit(False).alias("is_footnote"),
                    (s + 1).alias("first_line"),
                    (s + F.size(body)).alias("last_line"),
                    F.lit(None).cast("int").alias("parent_block_no"),
                )

            return F.transform(starts, one)

        return let(
            F.filter(positions(kinds), is_start),
            lambda starts: let(
                F.filter(starts, lambda s: F.get(kinds, s) == "table"),
                lambda tables: from_starts(starts, tables),
            ),
        )

    return let(
        text_lines_, lambda ln: let(F.transform(ln, _line_kind), lambda kinds: from_kinds(ln, kinds))
    )


def blocks(docs: DataFrame) -> DataFrame:
    """Headings, list items, tables (runs of ``|`` lines) and paragraphs, in document order."""
    return docs.select("doc_id", F.inline(_block_structs(text_lines(F.col("text")))))


def table_cells(block_rows: DataFrame) -> DataFrame:
    """Grid of every table block; the rule line is dropped, the first line is the header."""
    body = F.transform(
        text_lines(F.col("text")),
        lambda line, i: F.struct((i == 0).alias("is_header"), line.alias("line")),
    )
    rows = (
        block_rows.filter(F.col("type") == "table")
        .select(
            "doc_id",
            "table_idx",
            F.posexplode(F.filter(body, lambda r: ~r["line"].rlike(TABLE_RULE))).alias("row", "r"),
        )
        .select("doc_id", "table_idx", "row", "r.is_header", F.split("r.line", r"\|").alias("parts"))
    )
    inner = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))
    return rows.select(
        "doc_id", "table_idx", "row", "is_header", F.posexplode(inner).alias("col", "raw")
    ).select(
        "doc_id",
        "table_idx",
        "row",
        "col",
        F.lit(1).alias("row_span"),
        F.lit(1).alias("col_span"),
        trim_ws(F.col("raw")).alias("text"),
        "is_header",
    )


INLINE_RUN = r"\*\*(.+?)\*\*|\*(.+?)\*"


def inline_runs(block_rows: DataFrame) -> DataFrame:
    """Bold and italic runs of each block."""
    hits = F.regexp_extract_all("text", F.lit(INLINE_RUN), F.lit(0))
    bold = F.startswith(F.col("hit"), F.lit("**"))
    return (
        block_rows.filter(F.contains(F.col("text"), F.lit("*")))
        .select("doc_id", "block_no", F.posexplode(hits).alias("run_no", "hit"))
        .select(
            "doc_id",
            "block_no",
            (F.col("run_no") + 1).alias("run_no"),
            F.when(bold, "bold").otherwise("italic").alias("style"),
            F.when(bold, F.expr("substring(hit, 3, length(hit) - 4)"))
            .otherwise(F.expr("substring(hit, 2, length(hit) - 2)"))
            .alias("text"),
        )
    )


def outline_text(text: Column) -> Column:
    heads = F.filter(text_lines(text), lambda x: x.rlike(HEADING))
    shown = F.transform(
        heads,
        lambda x: F.concat(
            F.repeat(F.lit("  "), F.length(F.regexp_extract(x, HEADING, 1)) - 1), trim_end_ws(x)
        ),
    )
    return let(
        shown, lambda h: F.when(F.size(h) == 0, F.lit(NO_HEADINGS)).otherwise(F.array_join(h, "\n"))
    )


def outline(docs: DataFrame) -> DataFrame:
    """Heading outline per document, two spaces per level."""
    return docs.select("doc_id", outline_text(F.coalesce("text", F.lit(""))).alias("outline"))


def excerpt_blocks(text: Column, query: str, context: int = 2) -> Column:
    """Array<struct(start_line, end_line, excerpt)> of lines around matches.

    Blocks that overlap or touch are one block, so a block is a maximal run of lines
    that lie within ``context`` of a match.
    """

    def from_match(ln: Column, hit: Column) -> Column:
        def near(_: Column, i: Column) -> Column:
            out = flag_at(hit, i)
            for d in range(1, context + 1):
                out = out | flag_at(hit, i - d) | flag_at(hit, i + d)
            return out

        def from_cover(cover: Column) -> Column:
            idx = positions(cover)
            starts = F.filter(idx, lambda i: flag_at(cover, i) & ~flag_at(cover, i - 1))
            ends = F.filter(idx, lambda i: flag_at(cover, i) & ~flag_at(cover, i + 1))
            return F.transform(
                F.arrays_zip(starts.alias("s"), ends.alias("e")),
                lambda b: F.struct(
                    (b["s"] + 1).alias("start_line"),
                    (b["e"] + 1).alias("end_line"),
                    F.array_join(
                        F.transform(
                            F.slice(ln, b["s"] + 1, b["e"] - b["s"] + 1),
                            lambda x, k: F.concat((b["s"] + k + 1).cast("string"), F.lit(": "), x),
                        ),
                        "\n",
                    ).alias("excerpt"),
                ),
            )

        return let(F.transform(hit, near), from_cover)

    return let(
        text_lines(text),
        lambda ln: let(
            F.transform(ln, lambda x: contains_text(x, query)), lambda hit: from_match(ln, hit)
        ),
    )


def _search_body(text: Column, query: str, most: int | None) -> Column:
    shown = lambda b: F.array_join(F.transform(b, lambda x: x["excerpt"]), "\n…\n")

    def body(b: Column) -> Column:
        found = F.when(F.size(b) == 0, F.lit(f"'{query}' 를 찾지 못했습니다."))
        if most is not None:
            notice = f"\n\n(매치 블록이 너무 많아 앞 {most}개까지만 표시했습니다)"
            found = found.when(F.size(b) > most, F.concat(shown(F.slice(b, 1, most)), F.lit(notice)))
        return found.otherwise(shown(b))

    return let(excerpt_blocks(text, query), body)


def read_view(
    docs: DataFrame,
    outline: bool = False,
    search: str | None = None,
    cap: int | None = None,
    max_excerpts: int | None = None,
) -> DataFrame:
    """What a reader is shown: outline before search before the whole text.

    Only ``cap`` (characters) and ``max_excerpts`` (of a search) cut it; ``READ_CAP`` and
    ``MAX_EXCERPTS`` are those of a reader.
    """
    text = F.coalesce("text", F.lit(""))
    if outline:
        body = outline_text(text)
    elif search and search.strip():
        body = _search_body(text, search, max_excerpts)
    else:
        body = text
    if cap is None:
        return docs.select("doc_id", body.alias("body"), F.lit(False).alias("truncated"))
    return docs.select("doc_id", body.alias("full")).select(
        "doc_id",
        F.substring("full", 1, cap).alias("body"),
        (F.length("full") > cap).alias("truncated"),
    )


# Tags that open a text block, and tags that only end one.
TEXT_TAGS = "h[1-6]|p|li"
BREAK_TAGS = (
    "ul|ol|dl|dt|dd|div|article|section|nav|header|footer|main|aside|table|tr|td|th|blockquote"
    "|pre|body|html|head|title|figure|figcaption"
)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of raw HTML, in page order."""
    html = F.col("html")
    for dead in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, dead, "")
    opened = F.regexp_replace(html, f"(?i)<({TEXT_TAGS})(?:\\s[^>]*)?>", "\x01$1\x02")
    marked = F.regexp_replace(
        opened, f"(?i)</?(?:{TEXT_TAGS}|{BREAK_TAGS})(?:\\s[^>]*)?>", "\x01"
    )
    segments = F.filter(
        F.split(marked, "\x01"), lambda s: s.rlike(f"(?i)\\A(?:{TEXT_TAGS})\x02")
    )

    def clean(s: Column) -> Column:
        body = F.regexp_replace(F.substring_index(s, "\x02", -1), r"(?i)<br(?:\s[^>]*)?>", " ")
        body = decode_entities(F.regexp_replace(body, "<[^>]*>", ""))
        return F.struct(
            F.lower(F.substring_index(s, "\x02", 1)).alias("tag"),
            trim_ws(F.regexp_replace(body, f"{WS}+", " ")).alias("text"),
        )

    kept = F.filter(F.transform(segments, clean), lambda b: b["text"] != "")
    return pages.select("page_id", F.posexplode(kept).alias("i", "b")).select(
        "page_id",
        (F.col("i") + 1).alias("block_no"),
        "b.tag",
        F.when(F.col("b.tag").rlike("^h[1-6]"), "heading")
        .when(F.col("b.tag") == "li", "list")
        .otherwise("paragraph")
        .alias("type"),
        F.regexp_extract("b.tag", "^h([1-6])", 1).try_cast("int").alias("level"),
        "b.text",
    )


def parse_page_spec(spec: str) -> list[tuple[int, int]]:
    """``"1-3,5"`` -> ``[(1, 3), (5, 5)]``."""
    ranges = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        ranges.append((int(low), int(high or low)))
    return ranges


def select_pages(df: DataFrame, spec: str, page: str = "page") -> DataFrame:
    """Rows whose page number lies in ``spec``; a plain predicate, so it reaches the scan."""
    keep = F.lit(False)
    for low, high in parse_page_spec(spec):
        keep = keep | F.col(page).between(low, high)
    return df.filter(keep)
