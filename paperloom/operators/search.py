"""Excerpts, hit lists, term tables, anchors and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.arrays import let
from paperloom.functions.text import contains_text, nfc, trim_ws, window_text, with_nfc
from paperloom.operators.ranking import attach, cap, match, running
from paperloom.operators.structure import excerpt_blocks

CELL_HIT, BODY_HIT = "표", "본문"  # fixed values
PIECE_CHARS = 4096
_TABLE = ["doc_id", "section", "table_idx"]


def search_excerpts(
    docs: DataFrame, query: str, context: int = 2, max_blocks: int | None = None
) -> DataFrame:
    """Numbered lines around case-insensitive matches; all, or the first ``max_blocks`` per document."""
    matched = docs.filter(contains_text(F.col("text"), query))
    found = matched.select(
        "doc_id", let(excerpt_blocks(F.col("text"), query, context), lambda b: b).alias("b")
    )
    return found.select(
        "doc_id",
        F.size("b").alias("total_blocks"),
        F.lit(False).alias("truncated") if max_blocks is None else (F.size("b") > max_blocks).alias("truncated"),
        F.posexplode("b" if max_blocks is None else F.slice("b", 1, max_blocks)).alias("i", "x"),
    ).select(
        "doc_id",
        (F.col("i") + 1).alias("block_no"),
        "x.start_line",
        "x.end_line",
        "x.excerpt",
        "total_blocks",
        "truncated",
    )


def find_hits(
    cells: DataFrame, paragraphs: DataFrame, query: str, case_sensitive: bool = False
) -> DataFrame:
    """Cells with their coordinates, then body paragraphs with a window around the match.

    ``cells``: doc_id, table_idx, row, col, text; ``paragraphs``: doc_id, section, para_no, text.
    """
    text = F.col("text")
    none = F.lit(None).cast("int")
    in_cells = cells.filter(contains_text(text, query, case_sensitive)).select(
        "doc_id",
        F.lit(CELL_HIT).alias("kind"),
        "table_idx",
        "row",
        "col",
        none.alias("section"),
        none.alias("para_no"),
        text,
    )
    in_body = paragraphs.filter(contains_text(text, query, case_sensitive)).select(
        "doc_id",
        F.lit(BODY_HIT).alias("kind"),
        none.alias("table_idx"),
        none.alias("row"),
        none.alias("col"),
        "section",
        "para_no",
        window_text(text, query, case_sensitive).alias("text"),
    )
    return in_cells.unionByName(in_body)


def top_hits(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Hits ranked per document, cells before body, with the true total; all, or the first ``k``."""
    order = [
        F.when(F.col("kind") == CELL_HIT, 0).otherwise(1),
        F.col("table_idx"),
        F.col("row"),
        F.col("col"),
        F.col("section"),
        F.col("para_no"),
    ]
    return cap(hits, ["doc_id"], order, k)


_SPACES = "[ \t\r\n]+"
# Characters before and after a boundary of two words that make a key; sizes of pieces of one word.
_BOUNDARIES = ((1, 3), (3, 1), (1, 1))
_PIECES = (1, 2, 4, 8)


def find_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term_id) where the document contains the whole term, ignoring case.

    ``terms``: term_id, term, of any length and number; outer spaces do not count, blank terms are
    nowhere. A term has keys of which every document that holds it has one at least: the longest of its
    inner words (all but the first and last are whole words of the document) with a character on
    either side; the boundary of its two words; pieces of its only word. They meet in an equi-join, and
    a word counts if it and its neighbours are as in the term. What is found is verified on the text.
    Words of documents go to the terms, so that with few terms they are never shuffled; the steps are
    the same for any number of terms.
    """
    clean = terms.select("term_id", F.lower(F.trim("term")).alias("term")).filter("term != ''")
    words = F.split(F.regexp_replace("term", f"^{_SPACES}|{_SPACES}\\z", ""), _SPACES)
    split = clean.select("term_id", words.alias("_words")).filter("_words[0] != ''")
    low = docs.select("doc_id", F.lower("text").alias("_text"))
    found = _by_words(low, split).unionByName(_by_pieces(low, split)).distinct()
    # All that a document may hold is tested in one go over its text.
    asked = match(found, clean, ["term_id"]).groupBy("doc_id").agg(F.collect_list(F.struct("term_id", "term")).alias("_asked"))
    held = let(F.lower("text"), lambda text: F.filter("_asked", lambda t: F.contains(text, t["term"])))
    return match(docs.select("doc_id", "text"), asked, ["doc_id"]).select("doc_id", F.explode(held).alias("t")).select("doc_id", "t.term_id")


def _placed(low: DataFrame) -> DataFrame:
    """Words of documents with their neighbours, empty at the ends; other columns stay."""
    words = F.coalesce(F.split("_text", _SPACES), F.array().cast("array<string>"))
    placed = low.withColumn("_words", words).drop("_text")
    others = [c for c in placed.columns if c != "_words"]
    # Not the column itself: Spark would split every text once more to leave out empty arrays.
    placed = placed.select(*others, "_words", F.posexplode(F.coalesce("_words", F.array().cast("array<string>"))).alias("_at", "_word"))
    before, after = (F.coalesce(F.get("_words", F.col("_at") + k), F.lit("")) for k in (-1, 1))
    return placed.select(*others, before.alias("_before"), "_word", after.alias("_after"))


def _boundary_key(first: Column, second: Column, i: int, j: int) -> Column:
    return F.xxhash64(F.right(first, F.lit(i)), F.left(second, F.lit(j)))


def _word_key(before: Column, word: Column, after: Column) -> Column:
    return F.xxhash64(F.right(before, F.lit(1)), word, F.left(after, F.lit(1)))


def _by_words(low: DataFrame, split: DataFrame) -> DataFrame:
    """Candidates (doc_id, term_id) of terms of two or more words."""
    terms = split.withColumn("_n", F.size("_words")).filter("_n > 1")
    first, second = F.get("_words", F.lit(0)), F.get("_words", F.lit(1))
    shape = F.when(F.length(second) >= 3, "1_3").when(F.length(first) >= 3, "3_1").otherwise("1_1")
    inner = F.transform(F.sequence(F.lit(1), F.greatest("_n", F.lit(3)) - 2), lambda i: F.struct(F.length(F.get("_words", i)).alias("n"), (-i).alias("at")))
    terms = terms.withColumns({"_shape": F.when(F.col("_n") == 2, shape), "_at": -F.array_max(inner)["at"]})
    before, word, after = (F.get("_words", F.col("_at") + k) for k in (-1, 0, 1))
    key = F.when(F.col("_n") > 2, _word_key(before, word, after))
    for i, j in _BOUNDARIES:
        key = key.when(F.col("_shape") == f"{i}_{j}", _boundary_key(first, second, i, j))
    # Inner words are whole, the first and last may be parts of words.
    around = F.concat_ws(" ", F.when(F.col("_at") > 1, ""), before, word, after, F.when(F.col("_at") < F.col("_n") - 2, ""))
    part = F.when(F.col("_n") > 2, around).otherwise(F.array_join("_words", " "))
    keyed = terms.select("term_id", key.alias("_key"), part.alias("_part"))

    placed = _placed(low)
    keys = [_word_key(F.col("_before"), F.col("_word"), F.col("_after"))]
    keys += [_boundary_key(F.col("_before"), F.col("_word"), i, j) for i, j in _BOUNDARIES]
    placed = placed.select("doc_id", "_before", "_word", "_after", F.explode(F.array(*keys)).alias("_key"))
    near = F.concat(F.lit(" "), "_before", F.lit(" "), "_word", F.lit(" "), "_after", F.lit(" "))
    return placed.join(keyed, "_key").filter(F.contains(near, F.col("_part"))).select("doc_id", "term_id")


def _by_pieces(low: DataFrame, split: DataFrame) -> DataFrame:
    """Candidates (doc_id, term_id) of terms of one word: they lie inside one word of a document.

    That word is cut into pieces end to end. A term of 2n - 1 characters holds one of n whole, which
    begins at one of its first n.
    """
    terms = split.filter(F.size("_words") == 1).select("term_id", F.get("_words", F.lit(0)).alias("_term"))
    size = F.lit(_PIECES[0])
    for n in _PIECES[1:]:
        size = F.when(F.length("_term") >= 2 * n - 1, n).otherwise(size)
    terms = terms.withColumn("_size", size)
    keyed = terms.select("*", F.explode(F.sequence(F.lit(1), "_size")).alias("_from"))
    keyed = keyed.select("term_id", "_term", F.xxhash64(F.col("_term").substr(F.col("_from"), F.col("_size"))).alias("_key"))

    # As many rows as there are sizes, whatever the number of terms: others are not cut.
    used = terms.groupBy("_size").agg(F.min(F.length("_term")).alias("_least"))
    sized = low.withColumn("_size", F.explode(F.array(*map(F.lit, _PIECES))))
    words = _placed(sized.join(F.broadcast(used), "_size")).filter(F.length("_word") >= F.col("_least"))
    pieces = F.regexp_extract_all("_word", F.concat(F.lit("(?s).{"), "_size", F.lit("}")), F.lit(0))
    placed = words.select("doc_id", "_word", F.explode(pieces).alias("_piece")).withColumn("_key", F.xxhash64("_piece"))
    return placed.join(keyed, "_key").filter(F.contains("_word", F.col("_term"))).select("doc_id", "term_id")


def table_pieces(cells: DataFrame, size: int = PIECE_CHARS) -> DataFrame:
    """The cell texts of each table one after the other, in reading order, cut into pieces.

    ``cells`` carries ``reach``, the most characters that anyone looks for in its document. A piece
    begins every ``size`` characters (or ``reach``, if that is more) and runs ``reach - 1`` characters into
    the next, so whatever is looked for lies whole in one of them, also across cells. No table is one
    row or one task, however large; a table of empty cells has one empty piece.
    """
    length = F.length(F.coalesce("text", F.lit("")))
    placed = running(
        cells, _TABLE, ["row", "col", "text"], {"_rows": F.floor(F.col("row") / 1024)}, sums={"_end": length}
    )
    start = F.col("_end") - length
    width = F.greatest(F.lit(size), F.col("reach"))
    first = F.greatest(F.lit(0), F.floor((start - F.col("reach") + 1) / width))
    last = F.floor(F.greatest(F.col("_end") - 1, start) / width)
    dealt = placed.withColumns({"_start": start, "_width": width}).withColumn("piece", F.explode(F.sequence(first, last)))
    low = F.col("piece") * F.col("_width")
    begin = F.greatest("_start", low)
    end = F.least(F.col("_end"), low + F.col("_width") + F.col("reach") - 1)
    part = F.substr("text", (begin - F.col("_start") + 1).cast("int"), (end - begin).cast("int"))
    # Empty cells make a piece, but nothing is gathered of them.
    held = F.collect_list(F.when(end > begin, F.struct(begin.alias("at"), part.alias("part"))))
    return dealt.groupBy(*_TABLE, "piece").agg(
        F.array_join(F.transform(F.array_sort(held), lambda x: x["part"]), "").alias("piece_text")
    )


def resolve_anchor(cells: DataFrame, anchors: DataFrame, size: int = PIECE_CHARS) -> DataFrame:
    """The one table whose text contains the anchor: ``found``, ``ambiguous`` or ``not_found``.

    Sections are searched in order; the first one with any match decides. An anchor without text is
    in every table; a null one is in none. ``cells``: doc_id, section, table_idx, row, col, text;
    ``anchors``: doc_id, anchor.
    """
    wanted = anchors.select("doc_id", "anchor").distinct()
    reach = wanted.groupBy("doc_id").agg(
        F.greatest(F.lit(1), F.max(F.length(trim_ws(F.col("anchor"))))).cast("bigint").alias("reach")
    )
    pieces = table_pieces(attach(cells.select(*_TABLE, "row", "col", "text"), reach, ["doc_id"]), size)
    hits = (
        attach(pieces, wanted, ["doc_id"])
        .filter(F.contains("piece_text", trim_ws(F.col("anchor"))))
        .select("doc_id", "anchor", "section", "table_idx")
        .distinct()
        .groupBy("doc_id", "anchor", "section")
        .agg(F.count("*").alias("matches"), F.min("table_idx").alias("table_idx"))
        .groupBy("doc_id", "anchor")
        .agg(F.min(F.struct("section", "matches", "table_idx")).alias("m"))
    )
    found = F.col("m.matches") == 1
    return match(anchors, hits, ["doc_id", "anchor"], "left").select(
        "doc_id",
        "anchor",
        F.when(F.col("m").isNull(), "not_found")
        .when(found, "found")
        .otherwise("ambiguous")
        .alias("status"),
        F.when(found, F.col("m.section")).alias("section"),
        F.when(found, F.col("m.table_idx")).alias("table_idx"),
        F.coalesce("m.matches", F.lit(0)).cast("bigint").alias("matches"),
    )


def label_targets(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Where each request's label points, with the number of cells that bear the label.

    ``requests``: doc_id, request_no, label, direction (right | below), table_idx (null = any).
    """
    labels = with_nfc(
        cells.select(
            "doc_id", F.col("table_idx").alias("t"), "row", "col", "row_span", "col_span", "text"
        ),
        "key",
        trim_ws(F.col("text")),
    ).drop("text")
    requests = requests.select("doc_id", "request_no", "label", "direction", "table_idx")
    asked = requests.withColumn("key", nfc(trim_ws(F.col("label"))))
    matches = (
        # Requests grow with the cells: neither side is sent to every task.
        asked.join(labels.hint("merge"), ["doc_id", "key"])
        .filter(F.col("table_idx").isNull() | (F.col("table_idx") == F.col("t")))
        .groupBy("doc_id", "request_no")
        .agg(
            F.count("*").alias("matches"),
            F.min(F.struct("t", "row", "col", "row_span", "col_span")).alias("m"),
        )
    )
    right = F.coalesce("direction", F.lit("right")) == "right"
    return requests.join(matches.hint("merge"), ["doc_id", "request_no"], "left").select(
        "doc_id",
        "request_no",
        "label",
        F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"),
        F.col("m.t").alias("table_idx"),
        F.when(right, F.col("m.row")).otherwise(F.col("m.row") + F.col("m.row_span")).alias("row"),
        F.when(right, F.col("m.col") + F.col("m.col_span")).otherwise(F.col("m.col")).alias("col"),
    )


def resolve_labels(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Cell to the right of or below the one cell whose text is the label.

    Status: ``found``, ``label_missing``, ``label_ambiguous``, ``target_missing``.
    """
    targets = label_targets(cells, requests)
    exists = cells.select("doc_id", "table_idx", "row", "col", F.lit(True).alias("exists"))
    found = (F.col("matches") == 1) & F.col("exists").isNotNull()
    return targets.join(exists, ["doc_id", "table_idx", "row", "col"], "left").select(
        "doc_id",
        "request_no",
        "label",
        F.when(F.col("matches") == 0, "label_missing")
        .when(F.col("matches") > 1, "label_ambiguous")
        .when(F.col("exists").isNull(), "target_missing")
        .otherwise("found")
        .alias("status"),
        *[F.when(found, F.col(c)).alias(c) for c in ("table_idx", "row", "col")],
        "matches",
    )
