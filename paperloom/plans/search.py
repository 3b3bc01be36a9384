"""Search, hit lists, anchors, labels and ranking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import ranking
from paperloom.operators import search as op
from paperloom.operators import structure
from paperloom.plans import derived as d
from paperloom.plans.registry import query
from paperloom.plans.structure import MD_BLOCKS_SQL, MD_CELLS_SQL
from paperloom.sources.tables import load

_QUERY = "Estin"


@query(
    "search_excerpts",
    f"""WITH {d.LINES_SQL},
    n AS (SELECT doc_id, max(line_no) AS n FROM l GROUP BY doc_id),
    m AS (SELECT l.doc_id, greatest(1, line_no - 2) AS s, least(n, line_no + 2) AS e
      FROM l JOIN n USING (doc_id) WHERE contains(lower(text), '{_QUERY.lower()}')),
    g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS st FROM m),
    h AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY s, e) AS b FROM g),
    k AS (SELECT doc_id, b::int AS block_no, min(s)::int AS start_line, max(e)::int AS end_line
      FROM h GROUP BY doc_id, b),
    t AS (SELECT doc_id, count(*)::int AS total_blocks FROM k GROUP BY doc_id)
    SELECT k.*, string_agg(line_no || ': ' || text, chr(10) ORDER BY line_no) AS excerpt,
      total_blocks, false AS truncated
    FROM k JOIN t USING (doc_id) JOIN l ON l.doc_id = k.doc_id AND line_no BETWEEN start_line AND end_line
    GROUP BY ALL""",
)
def search_excerpts(spark, sf_dir):
    return op.search_excerpts(d.documents(spark, sf_dir), _QUERY)


_WORD = "ation"
_HITS_SQL = f"""{MD_CELLS_SQL},
    hits AS (
      SELECT doc_id, '표' AS kind, table_idx, row, col, NULL::int AS section, NULL::int AS para_no,
        text
      FROM md_cells WHERE contains(lower(text), '{_WORD}')
      UNION ALL
      SELECT doc_id, '본문', NULL, NULL, NULL, 0, block_no,
        (CASE WHEN s > 0 THEN '…' ELSE '' END) || substr(text, s + 1, e - s)
          || (CASE WHEN e < length(text) THEN '…' ELSE '' END)
      FROM (SELECT *, greatest(0, i - {(60 - len(_WORD)) // 2}) AS s,
              least(length(text), i + {len(_WORD) + (60 - len(_WORD)) // 2}) AS e
            FROM (SELECT *, instr(lower(text), '{_WORD}') - 1 AS i FROM blocks
                  WHERE type <> 'table' AND contains(lower(text), '{_WORD}'))))
"""


def _hits(spark, sf_dir):
    blocks = structure.blocks(d.markdown(spark, sf_dir))
    body = blocks.filter("type <> 'table'").select(
        "doc_id", F.lit(0).alias("section"), F.col("block_no").alias("para_no"), "text"
    )
    return op.find_hits(structure.table_cells(blocks), body, _WORD)


@query("find_hits", f"WITH {_HITS_SQL} SELECT * FROM hits")
def find_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(
    "top_hits",
    f"""WITH {_HITS_SQL},
    r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id
        ORDER BY kind = '본문', table_idx, row, col, section, para_no))::int AS rank,
        count(*) OVER (PARTITION BY doc_id) AS total FROM hits)
    SELECT *, false AS truncated FROM r""",
)
def top_hits(spark, sf_dir):
    return op.top_hits(_hits(spark, sf_dir))


@query(
    "find_terms",
    """SELECT doc_id, item_id AS term_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(trim(benchmark.text)))
    WHERE trim(benchmark.text) <> ''""",
)
def find_terms(spark, sf_dir):
    """Whole benchmark texts in whole documents."""
    terms = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    return op.find_terms(d.documents(spark, sf_dir), terms)


# Phrases of the benchmark between stops and line ends, from single words to long ones.
_PHRASES_SQL = """phrases AS (SELECT DISTINCT lower(trim(p)) AS term FROM (
      SELECT unnest(string_split_regex(text, '[.,\n]')) AS p FROM benchmark) WHERE length(trim(p)) >= 8)"""


@query(
    "find_terms_indexed",
    f"""WITH {_PHRASES_SQL}
    SELECT doc_id, term AS term_id FROM documents JOIN phrases ON contains(lower(text), term)""",
)
def find_terms_indexed(spark, sf_dir):
    """All phrases of the benchmark; a phrase is its own id."""
    phrases = load(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[.,\n]")).alias("term"))
    phrases = phrases.select(F.lower(F.trim("term")).alias("term_id")).filter(F.length("term_id") >= 8).distinct()
    return op.find_terms(d.documents(spark, sf_dir), phrases.withColumn("term", F.col("term_id")))


_SECTIONS = "SELECT doc_id, table_idx AS section, table_idx, row, col, text FROM cells"


@query(
    "resolve_anchor",
    f"""WITH {d.CELLS_SQL},
    sc AS ({_SECTIONS}),
    tt AS (SELECT doc_id, section, table_idx, string_agg(text, '' ORDER BY row, col) AS t
      FROM sc GROUP BY ALL),
    a AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 8 + 5)::varchar
      WHEN doc_id % 3 = 1 THEN 'URGENT' ELSE '3-' END AS anchor FROM cells),
    h AS (SELECT a.doc_id, anchor, section, count(*) AS n, min(table_idx) AS ti
      FROM a JOIN tt ON a.doc_id = tt.doc_id AND contains(t, anchor) GROUP BY ALL),
    f AS (SELECT doc_id, anchor, min(section) AS section FROM h GROUP BY ALL)
    SELECT a.doc_id, a.anchor, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found'
        ELSE 'ambiguous' END AS status,
      CASE WHEN n = 1 THEN h.section END AS section, CASE WHEN n = 1 THEN ti END AS table_idx,
      coalesce(n, 0) AS matches
    FROM a LEFT JOIN f ON a.doc_id = f.doc_id
    LEFT JOIN h ON h.doc_id = f.doc_id AND h.section = f.section""",
)
def resolve_anchor(spark, sf_dir):
    cells = d.order_cells(spark, sf_dir).withColumn("section", F.col("table_idx"))
    anchors = cells.select("doc_id").distinct().withColumn(
        "anchor",
        F.expr(
            """case doc_id % 3 when 0 then cast(doc_id * 8 + 5 as string)
            when 1 then 'URGENT' else '3-' end"""
        ),
    )
    return op.resolve_anchor(cells, anchors)


@query(
    "resolve_anchor_one_section",
    f"""WITH {d.CELLS_SQL},
    tt AS (SELECT doc_id, table_idx, string_agg(text, '' ORDER BY row, col) AS t
      FROM cells GROUP BY ALL),
    a AS (SELECT DISTINCT doc_id, 'URGENT' AS anchor FROM cells),
    h AS (SELECT doc_id, count(*) AS n, min(table_idx) AS ti FROM tt WHERE contains(t, 'URGENT')
      GROUP BY ALL)
    SELECT doc_id, anchor, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found'
        ELSE 'ambiguous' END AS status,
      CASE WHEN n = 1 THEN 0 END AS section, CASE WHEN n = 1 THEN ti END AS table_idx,
      coalesce(n, 0) AS matches
    FROM a LEFT JOIN h USING (doc_id)""",
)
def resolve_anchor_one_section(spark, sf_dir):
    cells = d.order_cells(spark, sf_dir).withColumn("section", F.lit(0))
    anchors = cells.select("doc_id", F.lit("URGENT").alias("anchor")).distinct()
    return op.resolve_anchor(cells, anchors)


LABEL_REQUESTS_SQL = """
requests AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'right' ELSE 'below' END AS direction,
    CASE doc_id % 4 WHEN 0 THEN (doc_id * 8 + 2)::varchar WHEN 1 THEN ' 1-URGENT '
      WHEN 2 THEN (doc_id * 8)::varchar ELSE 'F' END AS label,
    CASE WHEN doc_id % 8 = 3 THEN 1 END AS table_idx
  FROM cells)
"""


def label_requests(cells):
    return cells.select("doc_id").distinct().select(
        "doc_id",
        F.lit(1).alias("request_no"),
        F.expr("if(doc_id % 2 = 0, 'right', 'below')").alias("direction"),
        F.expr(
            """case doc_id % 4 when 0 then cast(doc_id * 8 + 2 as string) when 1 then ' 1-URGENT '
            when 2 then cast(doc_id * 8 as string) else 'F' end"""
        ).alias("label"),
        F.expr("if(doc_id % 8 = 3, 1, null)").alias("table_idx"),
    )


@query(
    "resolve_labels",
    f"""WITH {d.CELLS_SQL}, {LABEL_REQUESTS_SQL},
    m AS (SELECT r.doc_id, count(*) AS n, any_value(c.table_idx) AS t, any_value(c.row) AS r0,
        any_value(c.col) AS c0, any_value(row_span) AS rs, any_value(col_span) AS cs
      FROM requests r JOIN cells c ON r.doc_id = c.doc_id AND trim(r.label) = c.text
        AND (r.table_idx IS NULL OR r.table_idx = c.table_idx) GROUP BY r.doc_id),
    g AS (SELECT r.doc_id, r.label, coalesce(n, 0) AS matches, t,
        CASE WHEN direction = 'right' THEN r0 ELSE r0 + rs END AS tr,
        CASE WHEN direction = 'right' THEN c0 + cs ELSE c0 END AS tc
      FROM requests r LEFT JOIN m USING (doc_id))
    SELECT g.doc_id, 1 AS request_no, label, CASE WHEN matches = 0 THEN 'label_missing'
        WHEN matches > 1 THEN 'label_ambiguous' WHEN c.doc_id IS NULL THEN 'target_missing'
        ELSE 'found' END AS status,
      CASE WHEN matches = 1 AND c.doc_id IS NOT NULL THEN t END AS table_idx,
      CASE WHEN matches = 1 AND c.doc_id IS NOT NULL THEN tr END AS row,
      CASE WHEN matches = 1 AND c.doc_id IS NOT NULL THEN tc END AS col, matches
    FROM g LEFT JOIN cells c ON g.matches = 1 AND g.doc_id = c.doc_id AND t = c.table_idx
      AND tr = c.row AND tc = c.col""",
)
def resolve_labels(spark, sf_dir):
    cells = d.order_cells(spark, sf_dir)
    return op.resolve_labels(cells, label_requests(cells))


@query(
    "cap_per_source",
    """SELECT source, doc_id, rank, total, false AS truncated FROM (
      SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::int
        AS rank, count(*) OVER (PARTITION BY source) AS total FROM documents)""",
)
def cap_per_source(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    spread = {"_size": F.coalesce(-F.col("n_chars"), F.lit((1 << 63) - 1)), "_ids": F.floor(F.col("doc_id") / 100_000)}
    return ranking.cap(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], buckets=spread).drop("n_chars")


@query(
    "first_occurrence",
    f"""WITH {d.LINES_SQL}
    SELECT doc_id, line_no, text AS line,
      row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS is_first
    FROM l WHERE contains(text, '{_WORD}')""",
)
def first_occurrence(spark, sf_dir):
    return ranking.first_occurrences(d.documents(spark, sf_dir), _WORD)


@query(
    "section_offsets",
    f"""WITH {MD_BLOCKS_SQL},
    s AS (SELECT doc_id, (first_line - 1) // 10 AS section, count(*) AS tables
      FROM blocks WHERE type = 'table' GROUP BY ALL)
    SELECT *, coalesce(sum(tables) OVER (PARTITION BY doc_id ORDER BY section
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS global_offset FROM s""",
)
def section_offsets(spark, sf_dir):
    tables = structure.blocks(d.markdown(spark, sf_dir)).filter("type = 'table'")
    per_section = tables.groupBy("doc_id", F.expr("(first_line - 1) div 10").alias("section")).agg(
        F.count("*").alias("tables")
    )
    return ranking.section_offsets(per_section)


_LIST_SQL = f"""{d.LINES_SQL},
    items AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 AND doc_id % 2 = 0 THEN line_no + 1
        ELSE line_no END::bigint AS n
      FROM l WHERE line_no % 5 <> 0),
    w AS (SELECT *, lag(n) OVER w AS pn, lag(line_no) OVER w AS pl FROM items
      WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
"""


def _numbered(spark, sf_dir):
    number = lambda i: F.when(
        ((i + 1) % 3 == 0) & (F.col("doc_id") % 2 == 0), i + 2
    ).otherwise(i + 1)
    text = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when((i + 1) % 5 == 0, F.concat(F.lit("x "), x)).otherwise(
            F.concat(number(i).cast("string"), F.lit(". "), x)
        ),
    )
    return d.documents(spark, sf_dir).select("doc_id", F.array_join(text, "\n").alias("text"))


@query(
    "sequence_gaps",
    f"""WITH {_LIST_SQL} SELECT doc_id, line_no, pn AS previous, n AS found, pn + 1 AS expected
    FROM w WHERE pl + 1 = line_no AND pn + 1 <> n""",
)
def sequence_gaps(spark, sf_dir):
    return ranking.sequence_gaps(_numbered(spark, sf_dir))


@query(
    "renumber",
    f"""WITH {_LIST_SQL},
    r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM w)
    SELECT doc_id, line_no, n AS number,
      first_value(n) OVER (PARTITION BY doc_id, run ORDER BY line_no) + line_no
        - first_value(line_no) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS new_number
    FROM r""",
)
def renumber(spark, sf_dir):
    return ranking.renumber(_numbered(spark, sf_dir))
