"""Structure profiles, form inventories, HTML hygiene and lint rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.entities import decode_entities
from paperloom.functions.text import WS, contains_text, is_blank, trim_ws
from paperloom.operators.compare import RUN_TEXT, type_label
from paperloom.operators.edits import NEW_DATE, OLD_DATES

# Item markers of reports and of legal texts, and the names of the styles.
REPORT_MARKER = f"^{WS}*[□■○●◦▪▫·ㆍ\\-–]{WS}"
LEGAL_MARKER = f"^{WS}*(?:[0-9]+\\.|[가-힣]\\.|[0-9]+\\)|[①-⑮]|[ⅰ-ⅹ]\\.?){WS}"
REPORT_STYLE, LEGAL_STYLE, NO_STYLE = "보고서(□ ○ -)", "법정(1. 가. 1) …)", "혼합/없음"
# Characters of a heading that a readable template shows; fingerprints hold whole headings.
HEADING_SHOWN = 50


def _style(report: Column, legal: Column) -> Column:
    return (
        F.when((report > legal) & (report >= 2), REPORT_STYLE)
        .when((legal > report) & (legal >= 2), LEGAL_STYLE)
        .otherwise(NO_STYLE)
    )


def numbering_style(block_rows: DataFrame) -> DataFrame:
    """Which item markers a document uses; a line that fits both counts as a report marker."""
    text = F.coalesce("text", F.lit(""))
    report = text.rlike(REPORT_MARKER)
    return (
        block_rows.groupBy("doc_id")
        .agg(
            F.count_if(report).alias("report_marks"),
            F.count_if(~report & text.rlike(LEGAL_MARKER)).alias("legal_marks"),
        )
        .withColumn("style", _style(F.col("report_marks"), F.col("legal_marks")))
    )


def fingerprint(block_rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Skeleton of each document: block types, headings, table shapes, counts, marker style.

    Lists are gathered per document and hold at most its headings and tables.
    """
    text = F.coalesce("text", F.lit(""))
    report = text.rlike(REPORT_MARKER)
    heading = F.struct(
        "block_no",
        F.coalesce("level", F.lit(1)).alias("level"),
        text.alias("text"),
    )
    per_type = block_rows.groupBy("doc_id", "type").agg(
        F.count("*").alias("n"),
        F.min("block_no").alias("first"),
        F.count_if(F.col("is_footnote")).alias("footnotes"),
        F.count_if(report).alias("report"),
        F.count_if(~report & text.rlike(LEGAL_MARKER)).alias("legal"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "heading", heading))).alias("headings"),
    )
    count_of = lambda kind: F.coalesce(
        F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0)
    )
    docs = per_type.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "type", "n"))).alias("h"),
        F.max(F.when(F.col("type") == "heading", F.col("headings"))).alias("hs"),
        count_of("list").alias("list_count"),
        count_of("image").alias("image_count"),
        F.sum("footnotes").alias("footnote_count"),
        _style(F.sum("report"), F.sum("legal")).alias("numbering_style"),
    )
    shape = F.struct("table_idx", "rows", "cols", "has_header")
    tables = (
        cells.groupBy("doc_id", "table_idx")
        .agg(
            F.max(F.col("row") + F.col("row_span")).alias("rows"),
            F.max(F.col("col") + F.col("col_span")).alias("cols"),
            F.some("is_header").alias("has_header"),
        )
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(shape)).alias("ts"))
    )
    no_shapes = F.array().cast("array<struct<rows:int,cols:int,has_header:boolean>>")
    no_heads = F.array().cast("array<struct<level:int,text:string>>")
    return docs.join(tables, "doc_id", "left").select(
        "doc_id",
        F.transform("h", lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("histogram"),
        F.coalesce(
            F.transform("hs", lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"))), no_heads
        ).alias("headings"),
        F.coalesce(
            F.transform(
                "ts",
                lambda x: F.struct(
                    x["rows"].alias("rows"), x["cols"].alias("cols"), x["has_header"].alias("has_header")
                ),
            ),
            no_shapes,
        ).alias("tables"),
        "list_count",
        "image_count",
        "footnote_count",
        "numbering_style",
    )


# Losing one of these is a drift; paragraphs and list items may come and go.
STRUCTURAL_TYPES = ("table", "heading", "image", "separator")


def fingerprint_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Losses of structure between two fingerprints of a document; a document on one side only is one."""
    b = before.select("doc_id", F.struct(*[c for c in before.columns if c != "doc_id"]).alias("b"))
    a = after.select("doc_id", F.struct(*[c for c in after.columns if c != "doc_id"]).alias("a"))

    def number(side: str, kind: str) -> Column:
        hit = F.filter(F.col(f"{side}.histogram"), lambda x: x["type"] == kind)
        return F.coalesce(F.get(hit, F.lit(0))["n"], F.lit(0))

    arrow = lambda label, x, y: F.concat(
        label, F.lit(" "), x.cast("string"), F.lit("→"), y.cast("string")
    )
    lost = F.array_compact(
        F.array(
            *[
                F.when(
                    number("a", k) < number("b", k),
                    arrow(type_label(F.lit(k)), number("b", k), number("a", k)),
                )
                for k in STRUCTURAL_TYPES
            ]
        )
    )
    bt, at = F.col("b.tables"), F.col("a.tables")
    size = lambda t: F.concat(t["rows"].cast("string"), F.lit("×"), t["cols"].cast("string"))
    same_count = F.size(bt) == F.size(at)
    grids = F.filter(
        F.transform(
            bt,
            lambda t, i: F.when(
                (t["rows"] != F.get(at, i)["rows"]) | (t["cols"] != F.get(at, i)["cols"]),
                F.concat(
                    F.lit("표 "), (i + 1).cast("string"), F.lit(" 격자 "), size(t), F.lit("→"), size(F.get(at, i))
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    notes = F.when(
        F.col("a.footnote_count") < F.col("b.footnote_count"),
        F.array(arrow(F.lit("각주"), F.col("b.footnote_count"), F.col("a.footnote_count"))),
    ).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    gone = F.when(F.col("a").isNull(), F.array(F.lit("문서 없음"))).when(
        F.col("b").isNull(), F.array(F.lit("이전 문서 없음"))
    )
    grids = F.when(same_count, grids).otherwise(none)
    details = F.concat(F.coalesce(gone, none), lost, F.coalesce(grids, none), notes)
    return b.join(a, "doc_id", "full").select(
        "doc_id", (F.size(details) > 0).alias("drift"), F.array_join(details, "; ").alias("details")
    )


def _template_text() -> Column:
    heads = F.concat(
        F.lit("- 제목 계층("),
        F.size("headings").cast("string"),
        F.lit("):\n"),
        F.array_join(
            F.transform(
                "headings",
                lambda h: F.concat(
                    F.lit("  "),
                    F.repeat(F.lit("  "), F.greatest(F.lit(0), h["level"] - 1)),
                    F.lit("H"),
                    h["level"].cast("string"),
                    F.lit(" "),
                    F.substring(h["text"], 1, HEADING_SHOWN),
                ),
            ),
            "\n",
        ),
    )
    tables = F.concat(
        F.lit("- 표("),
        F.size("tables").cast("string"),
        F.lit("): "),
        F.array_join(
            F.transform(
                "tables",
                lambda t, i: F.concat(
                    F.lit("#"),
                    (i + 1).cast("string"),
                    F.lit(" "),
                    t["rows"].cast("string"),
                    F.lit("×"),
                    t["cols"].cast("string"),
                    F.when(t["has_header"], "(머리행)").otherwise(""),
                ),
            ),
            ", ",
        ),
    )
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("- 블록 구성: "),
            F.array_join(
                F.transform("histogram", lambda x: F.concat(x["type"], F.lit(" "), x["n"].cast("string"))), ", "
            ),
        ),
        F.concat(F.lit("- 항목부호 체계(추정): "), F.col("numbering_style")),
        F.when(F.size("headings") > 0, heads),
        F.when(F.size("tables") > 0, tables),
        F.when(F.col("image_count") > 0, F.concat(F.lit("- 이미지: "), F.col("image_count").cast("string"))),
        F.when(F.col("footnote_count") > 0, F.concat(F.lit("- 각주: "), F.col("footnote_count").cast("string"))),
    )


def format_template(fingerprints: DataFrame) -> DataFrame:
    """Readable skeleton and its JSON."""
    fields = [c for c in fingerprints.columns if c != "doc_id"]
    return fingerprints.select(
        "doc_id",
        _template_text().alias("template"),
        F.to_json(F.struct(*fields)).alias("json"),
    )


def corpus_templates(fingerprints: DataFrame) -> DataFrame:
    """Documents that share a skeleton: how many, and the first of them."""
    fields = [c for c in fingerprints.columns if c != "doc_id"]
    return (
        fingerprints.select("doc_id", F.sha2(F.to_json(F.struct(*fields)), 256).alias("template_hash"))
        .groupBy("template_hash")
        .agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    )


# Control elements of a form and their types.
CONTROLS = {
    "btn": "button",
    "checkBtn": "checkBox",
    "radioBtn": "radioButton",
    "comboBox": "comboBox",
    "edit": "edit",
}
_CONTROL = r"(?s)<hp:(btn|checkBtn|radioBtn|comboBox|edit)\b[^>]*>.*?</hp:\1>"


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, f'\\b{name}="([^"]*)"', 1)
    for entity, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        raw = F.replace(raw, F.lit(f"&{entity};"), F.lit(char))
    return raw


def form_inventory(xml_docs: DataFrame) -> DataFrame:
    """Controls of section XML in source order with type, value and choices.

    ``xml_docs``: doc_id, xml (the sections of a document joined in order).
    """

    def control(x: Column) -> Column:
        open_tag = F.regexp_extract(x, r"\A<[^>]*>", 0)
        kind = F.create_map(*[F.lit(v) for kv in CONTROLS.items() for v in kv])[
            F.regexp_extract(open_tag, r"\A<hp:(\w+)", 1)
        ]
        body = F.regexp_extract(x, r"(?s)<hp:text>(.*?)</hp:text>", 1)
        for entity, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            body = F.replace(body, F.lit(f"&{entity};"), F.lit(char))
        text = (
            F.when(kind == "button", _attribute(open_tag, "caption"))
            .when(kind == "comboBox", _attribute(open_tag, "selectedValue"))
            .when(kind == "edit", F.when(x.rlike(r"<hp:text\s*/>"), "").otherwise(body))
        )
        items = F.transform(
            F.regexp_extract_all(x, F.lit(r"<hp:listItem\b[^>]*"), F.lit(0)),
            lambda i: _attribute(i, "value"),
        )
        return F.struct(
            _attribute(open_tag, "name").alias("name"),
            kind.alias("type"),
            text.alias("value_text"),
            F.when(
                kind.isin("checkBox", "radioButton"), _attribute(open_tag, "value") == "CHECKED"
            ).alias("value_bool"),
            F.when(kind == "comboBox", items).alias("combo_items"),
        )

    found = F.regexp_extract_all("xml", F.lit(_CONTROL), F.lit(0))
    return xml_docs.select(
        "doc_id", F.posexplode(F.transform(found, control)).alias("idx", "c")
    ).select("doc_id", "idx", "c.*")


def footnote_texts(xml_docs: DataFrame) -> DataFrame:
    """Text of each footnote, runs joined; empty ones are left out."""
    notes = F.regexp_extract_all(
        "xml", F.lit(r"(?s)<\w+:footNote[\s>].*?</\w+:footNote>"), F.lit(0)
    )
    joined = F.transform(
        notes,
        lambda n: trim_ws(
            F.array_join(
                F.transform(
                    F.regexp_extract_all(n, F.lit(RUN_TEXT), F.lit(1)),
                    lambda t: decode_entities(F.regexp_replace(t, "<[^>]+>", "")),
                ),
                "",
            )
        ),
    )
    return xml_docs.select(
        "doc_id", F.posexplode(F.filter(joined, lambda t: t != "")).alias("i", "text")
    ).select("doc_id", (F.col("i") + 1).alias("note_no"), "text")


def text_facts(docs: DataFrame, needle: str) -> DataFrame:
    return docs.select("doc_id", contains_text(F.col("text"), needle, True).alias("contains_text"))


# Tags, attributes and link schemes that an exported page may keep.
ALLOWED_TAGS = (
    "html",
    "head",
    "body",
    "meta",
    "title",
    "h1",
    "h2",
    "h3",
    "h4",
    "h5",
    "h6",
    "p",
    "br",
    "hr",
    "strong",
    "b",
    "em",
    "i",
    "u",
    "s",
    "del",
    "ins",
    "mark",
    "small",
    "sub",
    "sup",
    "blockquote",
    "pre",
    "code",
    "ul",
    "ol",
    "li",
    "dl",
    "dt",
    "dd",
    "table",
    "thead",
    "tbody",
    "tfoot",
    "tr",
    "th",
    "td",
    "colgroup",
    "col",
    "caption",
    "a",
    "img",
    "div",
    "span",
    "section",
    "article",
    "header",
    "footer",
    "main",
    "nav",
    "aside",
    "figure",
    "figcaption",
)
ALLOWED_ATTRIBUTES = {
    "meta": ["charset"],
    "html": ["lang"],
    "a": ["href", "title", "target", "rel"],
    "img": ["src", "alt", "title", "width", "height"],
    "th": ["scope", "colspan", "rowspan"],
    "td": ["colspan", "rowspan"],
    "col": ["span"],
    "*": ["class", "id"],
}
ALLOWED_SCHEMES = {"img": ["http", "https", "data"], "a": ["http", "https", "mailto"]}
OPEN_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)((?:\s[^>]*)?)>"
ATTRIBUTE = r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def page_tags(pages: DataFrame) -> DataFrame:
    """Opening tags of each page; comments and the bodies of scripts and styles are not read."""
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        html = F.regexp_replace(html, f"(?is)(<{tag}\\b[^>]*>).*?</{tag}\\s*>", "$1")
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all(html, F.lit(OPEN_TAG), F.lit(0))).alias("tag_no", "raw")
    ).select(
        "page_id",
        "tag_no",
        F.lower(F.regexp_extract("raw", OPEN_TAG, 1)).alias("tag"),
        F.regexp_extract("raw", OPEN_TAG, 2).alias("rest"),
    )


def html_hygiene(pages: DataFrame) -> DataFrame:
    """What a page holds outside the allow-lists: (page_id, kind, name, n)."""
    tags = page_tags(pages)
    allowed = F.col("tag").isin(*ALLOWED_TAGS)
    bad_tags = tags.filter(~allowed).select("page_id", F.lit("tag").alias("kind"), F.col("tag").alias("name"))
    attrs = (
        tags.filter(allowed & (F.col("rest") != ""))
        .select(
            "page_id", "tag", F.explode(F.regexp_extract_all("rest", F.lit(ATTRIBUTE), F.lit(0))).alias("raw")
        )
        .select(
            "page_id",
            "tag",
            F.lower(F.regexp_extract("raw", ATTRIBUTE, 1)).alias("name"),
            F.regexp_replace(F.regexp_extract("raw", ATTRIBUTE, 2), "^[\"']|[\"']$", "").alias("value"),
        )
    )
    listed = F.col("name").isin(ALLOWED_ATTRIBUTES["*"])
    for tag, names in ALLOWED_ATTRIBUTES.items():
        listed = listed | ((F.col("tag") == tag) & F.col("name").isin(names))
    bad_attrs = attrs.filter(~listed).select(
        "page_id", F.lit("attribute").alias("kind"), F.concat_ws(".", "tag", "name").alias("name")
    )
    scheme = F.lower(F.regexp_extract("value", r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    fits = F.lit(False)
    for tag, schemes in ALLOWED_SCHEMES.items():
        fits = fits | ((F.col("tag") == tag) & scheme.isin(schemes))
    bad_links = (
        attrs.filter(F.col("name").isin("href", "src") & listed)
        .filter((scheme != "") & ~fits)
        .select("page_id", F.lit("scheme").alias("kind"), F.concat(F.col("tag"), F.lit("."), scheme).alias("name"))
    )
    found = bad_tags.unionByName(bad_attrs).unionByName(bad_links)
    return found.groupBy("page_id", "kind", "name").agg(F.count("*").alias("n"))


def hygiene_verdict(pages: DataFrame) -> DataFrame:
    """Clean or not, with the number of findings per kind."""
    counts = html_hygiene(pages).groupBy("page_id").agg(
        *[
            F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"bad_{k}s")
            for k in ("tag", "attribute", "scheme")
        ]
    )
    kinds = ["bad_tags", "bad_attributes", "bad_schemes"]
    return (
        pages.select("page_id")
        .join(counts, "page_id", "left")
        .select("page_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
        .withColumn("clean", (F.col("bad_tags") + F.col("bad_attributes") + F.col("bad_schemes")) == 0)
    )


BARE_AMOUNT = r"(?<![0-9,.])[0-9]{4,}원"


def lint_flags(docs: DataFrame, renames: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rule table per document: uniform dates, commas in amounts, old names gone.

    A rename passes when the old name is gone and the new one is there. One scan for all rules.
    """
    text = F.coalesce("text", F.lit(""))
    old_kinds = F.lit(0)
    for pattern in OLD_DATES:
        old_kinds = old_kinds + text.rlike(pattern).cast("int")
    rules = [
        ("dates", (old_kinds == 0) & text.rlike(NEW_DATE)),
        ("commas", ~text.rlike(BARE_AMOUNT)),
        *[
            (f"rename {old}", ~contains_text(text, old, True) & contains_text(text, new, True))
            for old, new in renames
        ],
    ]
    flags = F.array(*[F.struct(F.lit(n).alias("rule"), ok.alias("pass")) for n, ok in rules])
    return docs.select("doc_id", F.inline(flags))


TOTAL = f"총액[은는]?{WS}*([0-9][0-9,]*)"


def numeric_consistency(cells: DataFrame, docs: DataFrame, amount_header: str = "금액") -> DataFrame:
    """Sum of a table's amount column beside the total that the text states.

    ``status``: ``unreadable`` (a cell with text is no amount and not in the sum), ``no_total``,
    ``consistent`` or ``differs``.
    """
    headers = cells.filter((F.col("row") == 0) & (F.col("text") == amount_header)).select(
        "doc_id", "table_idx", "col"
    )
    amount = F.regexp_replace("text", "[,원]", "").try_cast("decimal(38,0)")
    sums = (
        cells.filter("row > 0")
        .join(headers, ["doc_id", "table_idx", "col"])
        .groupBy("doc_id", "table_idx")
        .agg(
            F.sum(amount).alias("column_sum"),
            F.count_if(amount.isNull() & ~is_blank(F.col("text"))).alias("unreadable"),
        )
    )
    stated = F.replace(F.regexp_extract("text", TOTAL, 1), F.lit(","), F.lit("")).try_cast("decimal(38,0)")
    totals = docs.filter(F.col("text").rlike(TOTAL)).select("doc_id", stated.alias("stated_total"))
    equal = F.coalesce(F.col("column_sum") == F.col("stated_total"), F.lit(False))
    status = (
        F.when(F.col("unreadable") > 0, "unreadable")
        .when(F.col("stated_total").isNull(), "no_total")
        .when(equal, "consistent")
        .otherwise("differs")
    )
    return sums.join(totals, "doc_id", "left").select(
        "doc_id",
        "table_idx",
        F.col("column_sum").cast("bigint").alias("column_sum"),
        F.col("stated_total").cast("bigint").alias("stated_total"),
        (status == "consistent").alias("consistent"),
        status.alias("status"),
    )
