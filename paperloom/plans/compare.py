"""Comparisons: edited documents, copies, tables, parse results, images, model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.entities import escape_xml
from paperloom.functions.text import WS
from paperloom.operators import compare as op
from paperloom.operators import unified
from paperloom.operators import edits, structure
from paperloom.plans import derived as d
from paperloom.plans.registry import query
from paperloom.plans.structure import MD_BLOCKS_SQL
from paperloom.sources.tables import load, load_wide


def diff_sql(units: str) -> str:
    """``units`` defines u(pair_id, side, no, text)."""
    return f"""{units},
    o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, text ORDER BY no) AS occ FROM u),
    m AS (SELECT coalesce(b.pair_id, a.pair_id) AS pair_id, b.no AS bn, a.no AS an,
        coalesce(b.text, a.text) AS text
      FROM (SELECT * FROM o WHERE side = 0) b FULL JOIN (SELECT * FROM o WHERE side = 1) a
        ON b.pair_id = a.pair_id AND b.text = a.text AND b.occ = a.occ),
    g AS (SELECT *, bn IS NOT NULL AND an IS NOT NULL AS anchor,
        sum((bn IS NOT NULL AND an IS NOT NULL)::int) OVER (PARTITION BY pair_id ORDER BY bn NULLS FIRST
          ROWS UNBOUNDED PRECEDING) AS gb,
        sum((bn IS NOT NULL AND an IS NOT NULL)::int) OVER (PARTITION BY pair_id ORDER BY an NULLS FIRST
          ROWS UNBOUNDED PRECEDING) AS ga FROM m),
    rem AS (SELECT pair_id, bn, text, gb AS gap, row_number() OVER (PARTITION BY pair_id, gb ORDER BY bn) AS k
      FROM g WHERE an IS NULL),
    ad AS (SELECT pair_id, an, text, ga AS gap, row_number() OVER (PARTITION BY pair_id, ga ORDER BY an) AS k
      FROM g WHERE bn IS NULL),
    diff AS (
      SELECT pair_id, 'unchanged' AS change, bn AS before_no, an AS after_no, text AS before_text,
        text AS after_text FROM g WHERE anchor
      UNION ALL
      SELECT coalesce(r.pair_id, a.pair_id), CASE WHEN bn IS NULL THEN 'added' WHEN an IS NULL THEN 'removed'
        ELSE 'modified' END, bn, an, r.text, a.text
      FROM rem r FULL JOIN ad a ON r.pair_id = a.pair_id AND r.gap = a.gap AND r.k = a.k)
    """


_EDITED_UNITS = f"""{d.LINES_SQL},
    u AS (
      SELECT doc_id AS pair_id, 0 AS side, line_no * 2 AS no, text FROM l
      UNION ALL SELECT doc_id, 1, line_no * 2,
        CASE WHEN (line_no + doc_id) % 7 = 0 THEN text || ' (edited)' ELSE text END
        FROM l WHERE (line_no + doc_id) % 9 <> 0
      UNION ALL SELECT doc_id, 1, line_no * 2 + 1, 'NEW ' || line_no FROM l WHERE (line_no + doc_id) % 11 = 0)
"""


def _edited(spark, sf_dir):
    lines = structure.lines(d.documents(spark, sf_dir)).select(
        F.col("doc_id").alias("pair_id"), "line_no", (F.col("line_no") * 2).alias("no"), "text"
    )
    k = F.col("line_no") + F.col("pair_id")
    changed = F.when(k % 7 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
    added = F.concat(F.lit("NEW "), F.col("line_no").cast("string"))
    after = lines.select(
        "pair_id",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("no"), changed.alias("text"), (k % 9 != 0).alias("keep")),
                    F.struct((F.col("no") + 1).alias("no"), added.alias("text"), (k % 11 == 0).alias("keep")),
                ),
                lambda x: x["keep"],
            )
        ).alias("x"),
    ).select("pair_id", "x.no", "x.text")
    return op.doc_diff(lines, after)


@query(
    "doc_diff", f"WITH {diff_sql(_EDITED_UNITS)} SELECT * FROM diff"
)
def doc_diff(spark, sf_dir):
    return _edited(spark, sf_dir)


_STATS = """SELECT pair_id, count(*) FILTER (change = 'added') AS added,
    count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified,
    count(*) FILTER (change = 'unchanged') AS unchanged FROM diff GROUP BY pair_id"""


@query("diff_stats", f"WITH {diff_sql(_EDITED_UNITS)} {_STATS}")
def diff_stats(spark, sf_dir):
    return op.diff_stats(_edited(spark, sf_dir))


# Where most lines of a document come from, counted over all its lines.
_COPY_PAIRS = """
    held AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      WHERE trim(line) <> ''),
    origins AS (SELECT line, min(doc_id) AS origin FROM held GROUP BY line),
    counted AS (SELECT doc_id, origin, count(*) AS shared FROM held JOIN origins USING (line) WHERE origin <> doc_id GROUP BY ALL),
    sizes AS (SELECT doc_id, count(*) AS lines FROM held GROUP BY doc_id),
    pairs AS (SELECT doc_id AS pair_id, origin AS before_id, doc_id AS after_id, shared, lines
      FROM counted JOIN sizes USING (doc_id) WHERE 2 * shared >= lines
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, origin) = 1)
"""


@query("copy_pairs", f"WITH {_COPY_PAIRS} SELECT * FROM pairs")
def copy_pairs(spark, sf_dir):
    return op.line_pairs(d.documents(spark, sf_dir)).drop("slice", "slices")


_COPY_UNITS = f"""{_COPY_PAIRS},
    u AS (SELECT pair_id, 0 AS side, unnest(string_split(text, chr(10))) AS text,
        generate_subscripts(string_split(text, chr(10)), 1) AS no
        FROM pairs JOIN documents ON doc_id = before_id
      UNION ALL SELECT pair_id, 1, unnest(string_split(text, chr(10))),
        generate_subscripts(string_split(text, chr(10)), 1) FROM pairs JOIN documents ON doc_id = after_id)
"""


@query("compare_copies", f"WITH {diff_sql(_COPY_UNITS)} {_STATS}")
def compare_copies(spark, sf_dir):
    docs = d.documents(spark, sf_dir)
    pairs = op.line_pairs(docs, hot=10)
    texts = op.pair_texts(pairs, docs)
    units = lambda side: texts.select(
        "pair_id", F.posexplode(F.split(side, "\n")).alias("no", "text")
    )
    return op.diff_stats(op.doc_diff(units("before"), units("after")))


@query(
    "diff_report",
    f"""WITH {diff_sql(_EDITED_UNITS)},
    s AS ({_STATS}),
    t AS (SELECT pair_id, string_agg(CASE change WHEN 'added' THEN '**[추가]** ' || after_text
        WHEN 'removed' THEN '**[삭제]** ' || before_text
        ELSE '**[수정]**' || chr(10) || '- 이전: ' || before_text || chr(10) || '- 이후: '
          || after_text END, chr(10) || chr(10)
        ORDER BY coalesce(before_no, after_no), after_no NULLS FIRST) AS body
      FROM diff WHERE change <> 'unchanged' GROUP BY pair_id),
    f AS (SELECT pair_id, '| 추가 | ' || added || ' |' || chr(10) || '| 삭제 | ' || removed || ' |' || chr(10)
        || '| 수정 | ' || modified || ' |' || chr(10) || '| 변경 없음 | ' || unchanged || ' |' || chr(10) || chr(10)
        || coalesce(body, '두 문서가 동일합니다. 변경된 블록이 없습니다.') AS r
      FROM s LEFT JOIN t USING (pair_id))
    SELECT pair_id, r AS report, false AS truncated FROM f""",
)
def diff_report(spark, sf_dir):
    return op.diff_report(_edited(spark, sf_dir))


_MOVED = "CASE WHEN line_no = 1 THEN 1000000 ELSE line_no END"


@query(
    "ordered_diff",
    f"""WITH {d.LINES_SQL},
    n AS (SELECT doc_id AS pair_id, line_no, line_no || ': ' || text AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM l)
    SELECT pair_id, 'unchanged' AS change, line_no::bigint AS before_no,
        (CASE WHEN n = 1 THEN 1000000 ELSE line_no END)::bigint AS after_no, t AS before_text, t AS after_text
      FROM n WHERE line_no > 1 OR n = 1
    UNION ALL SELECT pair_id, 'removed', 1, NULL, t, NULL FROM n WHERE line_no = 1 AND n > 1
    UNION ALL SELECT pair_id, 'added', NULL, 1000000, NULL, t FROM n WHERE line_no = 1 AND n > 1""",
)
def ordered_diff(spark, sf_dir):
    """The first line of every document moved to its end: removed there, added here."""
    lines = structure.lines(d.documents(spark, sf_dir)).select(
        F.col("doc_id").alias("pair_id"),
        F.col("line_no").cast("bigint").alias("no"),
        F.concat(F.col("line_no").cast("string"), F.lit(": "), F.col("text")).alias("text"),
    )
    moved = lines.withColumn("no", F.when(F.col("no") == 1, F.lit(1000000).cast("bigint")).otherwise(F.col("no")))
    return op.doc_diff(lines, moved, ordered=True)


@query(
    "line_diff",
    f"""WITH {diff_sql(_EDITED_UNITS)},
    e AS (SELECT pair_id, '-' AS sign, before_no AS b, NULL AS a, before_text AS text FROM diff
        WHERE change IN ('removed', 'modified')
      UNION ALL SELECT pair_id, CASE change WHEN 'unchanged' THEN ' ' ELSE '+' END, before_no, after_no, after_text
        FROM diff WHERE change <> 'removed'),
    kept AS (SELECT pair_id, before_no AS b, after_no AS a FROM diff WHERE change = 'unchanged'),
    w AS (SELECT pair_id, b, max(a) OVER (PARTITION BY pair_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS ma FROM kept),
    p AS (SELECT e.*, CASE WHEN sign = '-' THEN coalesce(w.ma, -1) ELSE e.a END AS af
      FROM e ASOF LEFT JOIN w ON e.pair_id = w.pair_id AND e.b > w.b),
    n AS (SELECT *, (row_number() OVER w)::int AS seq, max((sign <> ' ')::int)
        OVER (PARTITION BY pair_id ORDER BY af, (sign = '-')::int, b ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near
      FROM p WINDOW w AS (PARTITION BY pair_id ORDER BY af, (sign = '-')::int, b)),
    s AS (SELECT *, (seq - coalesce(lag(seq) OVER (PARTITION BY pair_id ORDER BY seq), -1) > 1)::int AS st
      FROM n WHERE near = 1)
    SELECT pair_id, (sum(st) OVER (PARTITION BY pair_id ORDER BY seq))::int AS hunk_no, seq, sign, text FROM s""",
)
def line_diff(spark, sf_dir):
    return op.line_diff(_edited(spark, sf_dir))


@query(
    "unified_diff",
    """WITH l AS (SELECT doc_id AS pair_id, string_split(text, chr(10)) AS a, (len(string_split(text, chr(10))) + 1) // 2 AS k FROM documents),
    w AS (SELECT *, greatest(k - 3, 1) AS f, least(k + 3, len(a)) AS t FROM l)
    SELECT pair_id, 1 AS hunk_no, f::int AS before_start, (t - f + 1)::int AS before_lines, f::int AS after_start, (t - f + 1)::int AS after_lines,
      array_to_string(list_transform(a[f:k-1], lambda x: ' ' || x) || ['-' || a[k], '+edited ' || pair_id || ': ' || a[k]]
        || list_transform(a[k+1:t], lambda x: ' ' || x), chr(10)) AS body FROM w""",
)
def unified_diff(spark, sf_dir):
    """The middle line of every document edited."""
    lines = F.split("text", "\n")
    middle = F.floor((F.size(lines) + 1) / 2).cast("int")
    edited = F.transform(
        lines, lambda x, i: F.when(i + 1 == middle, F.concat(F.lit("edited "), F.col("doc_id").cast("string"), F.lit(": "), x)).otherwise(x)
    )
    pairs = d.documents(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("before"), F.array_join(edited, "\n").alias("after"))
    return unified.unified_diff(pairs)


@query(
    "patch_texts",
    """SELECT doc_id AS pair_id, array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) AS text, true AS applied FROM documents""",
)
def patch_texts(spark, sf_dir):
    """Every document patched to its lines in reverse order, by the diff of the two."""
    docs = d.documents(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), "text")
    pairs = docs.select("pair_id", F.col("text").alias("before"), F.array_join(F.reverse(F.split("text", "\n")), "\n").alias("after"))
    return unified.patch_texts(docs, unified.unified_diff(pairs))


@query(
    "cell_diffs",
    f"""WITH {d.CELLS_SQL},
    b AS (SELECT doc_id AS pair_id, table_idx, row, col, text FROM cells),
    a AS (SELECT pair_id, table_idx, row, col, CASE WHEN (pair_id + row + col) % 5 = 0 THEN text || '!' ELSE text END
        AS text FROM b WHERE (pair_id + row) % 6 <> 0
      UNION ALL SELECT DISTINCT pair_id, table_idx, 9, 0, 'extra' FROM b WHERE pair_id % 4 = 0),
    c AS (SELECT coalesce(b.pair_id, a.pair_id) AS pair_id, coalesce(b.table_idx, a.table_idx) AS table_idx,
        coalesce(b.row, a.row) AS row, coalesce(b.col, a.col) AS col,
        CASE WHEN b.pair_id IS NULL THEN 'added' WHEN a.pair_id IS NULL THEN 'removed' ELSE 'modified' END AS change,
        b.text AS before_text, a.text AS after_text
      FROM b FULL JOIN a ON b.pair_id = a.pair_id AND b.table_idx = a.table_idx AND b.row = a.row AND b.col = a.col
      WHERE b.pair_id IS NULL OR a.pair_id IS NULL OR b.text <> a.text),
    r AS (SELECT *, (row_number() OVER (PARTITION BY pair_id, table_idx ORDER BY row, col))::int AS rank,
      count(*) OVER (PARTITION BY pair_id, table_idx) AS total FROM c)
    SELECT *, false AS truncated FROM r""",
)
def cell_diffs(spark, sf_dir):
    before = d.order_cells(spark, sf_dir).select(
        F.col("doc_id").alias("pair_id"), "table_idx", "row", "col", "text"
    )
    edited = before.filter("(pair_id + row) % 6 <> 0").withColumn(
        "text", F.expr("if((pair_id + row + col) % 5 = 0, text || '!', text)")
    )
    extra = before.filter("pair_id % 4 = 0").select(
        "pair_id", "table_idx", F.lit(9).alias("row"), F.lit(0).alias("col"), F.lit("extra").alias("text")
    ).distinct()
    return op.cell_diffs(before, edited.unionByName(extra))


@query(
    "structure_loss",
    f"""WITH {MD_BLOCKS_SQL},
    b AS (SELECT doc_id, type, count(*) AS n, min(block_no) AS f FROM blocks GROUP BY ALL),
    a AS (SELECT doc_id, type, count(*) AS n FROM blocks WHERE (doc_id + block_no) % 13 <> 0 GROUP BY ALL),
    p AS (SELECT b.doc_id, f, CASE b.type WHEN 'paragraph' THEN '단락' WHEN 'table' THEN '표' WHEN 'heading' THEN '제목'
        ELSE '목록' END || ' ' || b.n || '→' || coalesce(a.n, 0) AS p, coalesce(a.n, 0) < b.n AS fell
      FROM b LEFT JOIN a ON b.doc_id = a.doc_id AND b.type = a.type)
    SELECT doc_id, bool_or(fell) AS lost, coalesce(string_agg(p, ', ' ORDER BY f) FILTER (fell), '') AS detail
    FROM p GROUP BY doc_id""",
)
def structure_loss(spark, sf_dir):
    before = structure.blocks(d.markdown(spark, sf_dir))
    return op.structure_loss(before, before.filter("(doc_id + block_no) % 13 <> 0"))


_SQ = lambda c: f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"
_TR = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query(
    "restore_lines",
    f"""WITH {d.LINES_SQL},
    raw AS (SELECT doc_id, line_no AS para_no, {_SQ("text || CASE WHEN (line_no + doc_id) % 4 = 0 THEN ' 금액은 원입니다.' ELSE '' END")}
      AS raw_text, (line_no + doc_id) % 4 = 0 AS long FROM l),
    wrong AS (SELECT doc_id, para_no, {_TR("replace(raw_text, '원입니다.', '')")} AS c, raw_text AS fixed FROM raw WHERE long),
    parsed AS (SELECT doc_id, line_no, CASE WHEN (line_no + doc_id) % 4 = 0
        THEN CASE WHEN (line_no + doc_id) % 8 = 0 THEN '- ' ELSE '' END || {_TR("text || ' 금액은'")} ELSE text END AS text FROM l),
    pd AS (SELECT *, regexp_extract(text, '{op.DECORATION}', 1) AS prefix,
        {_SQ(f"regexp_replace(text, '{op.DECORATION}', '')")} AS c FROM parsed),
    free AS (SELECT doc_id, line_no, c, row_number() OVER (PARTITION BY doc_id, c ORDER BY line_no) AS n
      FROM pd ANTI JOIN (SELECT DISTINCT doc_id, raw_text AS c FROM raw) k USING (doc_id, c) WHERE c <> ''),
    want AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY para_no) AS n FROM wrong),
    hit AS (SELECT f.doc_id, f.line_no, fixed FROM free f JOIN want w ON f.doc_id = w.doc_id AND f.c = w.c AND f.n = w.n)
    SELECT pd.doc_id, pd.line_no, CASE WHEN fixed IS NULL THEN text ELSE prefix || fixed END AS text,
      fixed IS NOT NULL AS restored
    FROM pd LEFT JOIN hit ON pd.doc_id = hit.doc_id AND pd.line_no = hit.line_no""",
)
def restore_lines(spark, sf_dir):
    lines = structure.lines(d.documents(spark, sf_dir))
    long = (F.col("line_no") + F.col("doc_id")) % 4 == 0
    listed = (F.col("line_no") + F.col("doc_id")) % 8 == 0
    raw = lines.select(
        "doc_id",
        F.col("line_no").alias("para_no"),
        F.concat("text", F.when(long, F.lit(" 금액은 원입니다.")).otherwise("")).alias("text"),
    )
    cut = F.concat(F.when(listed, "- ").otherwise(""), op.trim_ws(F.concat("text", F.lit(" 금액은"))))
    parsed = lines.withColumn("text", F.when(long, cut).otherwise(F.col("text")))
    return op.restore_lines(parsed, raw)


@query(
    "restore_spaces",
    f"""WITH {d.LINES_SQL},
    raw AS (SELECT doc_id, line_no AS para_no, {_TR("text")} AS target,
      regexp_replace(text, '{WS}+', '', 'g') AS key FROM l),
    parsed AS (SELECT doc_id, line_no, CASE WHEN (line_no + doc_id) % 3 = 0
        THEN '- ' || replace(text, ' ', '') ELSE text END AS text FROM l),
    pd AS (SELECT *, regexp_extract(text, '{op.DECORATION}', 1) AS prefix,
        {_TR(f"regexp_replace(text, '{op.DECORATION}', '')")} AS c FROM parsed),
    pk AS (SELECT *, regexp_replace(c, '{WS}+', '', 'g') AS key FROM pd),
    free AS (SELECT doc_id, line_no, key, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS n
      FROM pk ANTI JOIN (SELECT DISTINCT doc_id, target AS c FROM raw) k USING (doc_id, c) WHERE key <> ''),
    want AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY para_no) AS n FROM raw
      WHERE key <> '' AND key <> target),
    hit AS (SELECT f.doc_id, f.line_no, target FROM free f JOIN want w ON f.doc_id = w.doc_id AND f.key = w.key AND f.n = w.n)
    SELECT pk.doc_id, pk.line_no, CASE WHEN target IS NULL THEN text ELSE prefix || target END AS text,
      target IS NOT NULL AS restored
    FROM pk LEFT JOIN hit ON pk.doc_id = hit.doc_id AND pk.line_no = hit.line_no""",
)
def restore_spaces(spark, sf_dir):
    lines = structure.lines(d.documents(spark, sf_dir))
    raw = lines.withColumnRenamed("line_no", "para_no")
    parsed = lines.withColumn(
        "text", F.expr("if((line_no + doc_id) % 3 = 0, '- ' || replace(text, ' ', ''), text)")
    )
    return op.restore_spaces(parsed, raw)


def section_xml(spark, sf_dir):
    """Each document as section XML: a paragraph of two runs per line, entities escaped."""
    para = lambda x: F.concat(
        F.lit("<hp:p id=\"1\"><hp:run><hp:t>"),
        escape_xml(F.substring(x, 1, 10)),
        F.lit("</hp:t></hp:run><hp:run><hp:t charPr=\"2\"><hp:tab/>"),
        escape_xml(x.substr(F.lit(11), F.length(x))),
        F.lit("&#44032;&amp;</hp:t></hp:run></hp:p>"),
    )
    return d.documents(spark, sf_dir).select(
        "doc_id",
        F.lit(0).alias("section"),
        F.concat(
            F.lit("<hs:sec>"), F.array_join(F.transform(F.split("text", "\n"), para), ""), F.lit("</hs:sec>")
        ).alias("xml"),
    )


@query(
    "paragraph_texts",
    f"""WITH {d.LINES_SQL} SELECT doc_id, 0 AS section, line_no AS para_no, text || '가&' AS text FROM l""",
)
def paragraph_texts(spark, sf_dir):
    return op.paragraph_texts(section_xml(spark, sf_dir))


@query(
    "resolve_images",
    """WITH r AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
        generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS ref_no FROM pages),
    i AS (SELECT DISTINCT doc_id, href[2:] || CASE WHEN ref_no % 3 = 0 THEN ' 1.png' ELSE '.png' END AS filename
      FROM r WHERE ref_no % 4 <> 0),
    s AS (SELECT *, CASE ref_no % 5 WHEN 0 THEN 'https:/' || href WHEN 1 THEN href[2:] || '.png'
      WHEN 2 THEN 'img' || href || '.png' ELSE href[2:] || '%201.png' END AS src FROM r),
    m AS (SELECT s.*, CASE WHEN src[:6] = 'https:' THEN NULL ELSE coalesce(i1.filename, i2.filename, i3.filename) END AS filename
      FROM s LEFT JOIN i i1 ON s.doc_id = i1.doc_id AND i1.filename = src
      LEFT JOIN i i2 ON s.doc_id = i2.doc_id AND i2.filename = replace(src, '%20', ' ')
      LEFT JOIN i i3 ON s.doc_id = i3.doc_id AND i3.filename = string_split(src, '/')[-1])
    SELECT doc_id, ref_no, src, CASE WHEN src[:6] = 'https:' THEN 'absolute' WHEN filename IS NULL THEN 'unresolved'
      ELSE 'resolved' END AS status, filename FROM m""",
)
def resolve_images(spark, sf_dir):
    hrefs = load_wide(spark, sf_dir, "pages", "page_id", "html").select(
        F.col("page_id").alias("doc_id"),
        F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("i", "href"),
    ).withColumn("ref_no", F.col("i") + 1)
    images = hrefs.filter("ref_no % 4 <> 0").select(
        "doc_id", F.expr("substring(href, 2) || if(ref_no % 3 = 0, ' 1.png', '.png')").alias("filename")
    )
    refs = hrefs.select(
        "doc_id",
        "ref_no",
        F.expr(
            """case ref_no % 5 when 0 then 'https:/' || href when 1 then substring(href, 2) || '.png'
            when 2 then 'img' || href || '.png' else substring(href, 2) || '%201.png' end"""
        ).alias("src"),
    )
    return op.resolve_images(refs, images)


@query(
    "golden_diff",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'new_baseline' WHEN doc_id % 10 = 4 THEN 'missing'
      WHEN contains(lower(text), 'ation') THEN 'changed' ELSE 'same' END AS status FROM documents""",
)
def golden_diff(spark, sf_dir):
    docs = d.documents(spark, sf_dir)
    current = docs.filter("doc_id % 10 <> 4").select(
        "doc_id", edits.replaced(F.col("text"), "ation", "X", False, True).alias("text")
    )
    return op.golden_diff(current, docs.filter("doc_id % 10 <> 3"))


@query(
    "prompt_compare",
    """WITH r AS (SELECT turn AS prompt, CASE conv_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model,
        length(text) % 10 <> 0 AS ok, length(text) AS it, length(text) // 2 AS ot, length(text) * 3 AS ms
      FROM conversations WHERE role = 'user')
    SELECT prompt, count(*) FILTER (model = 'a' AND ok) AS a_ok, count(*) FILTER (model = 'a' AND NOT ok) AS a_failed,
      (sum(it) FILTER (model = 'a' AND ok))::bigint AS a_input_tokens,
      (sum(ot) FILTER (model = 'a' AND ok))::bigint AS a_output_tokens, (sum(ms) FILTER (model = 'a'))::bigint AS a_ms,
      count(*) FILTER (model = 'b' AND ok) AS b_ok, count(*) FILTER (model = 'b' AND NOT ok) AS b_failed,
      (sum(it) FILTER (model = 'b' AND ok))::bigint AS b_input_tokens,
      (sum(ot) FILTER (model = 'b' AND ok))::bigint AS b_output_tokens, (sum(ms) FILTER (model = 'b'))::bigint AS b_ms
    FROM r GROUP BY prompt""",
)
def prompt_compare(spark, sf_dir):
    results = load(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.col("turn").alias("prompt"),
        F.expr("if(conv_id % 2 = 0, 'a', 'b')").alias("model"),
        (F.length("text") % 10 != 0).alias("ok"),
        F.length("text").alias("input_tokens"),
        F.expr("length(text) div 2").alias("output_tokens"),
        (F.length("text") * 3).alias("ms"),
    )
    return op.prompt_compare(results, ["a", "b"])
