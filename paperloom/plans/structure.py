"""Lines, blocks, cells, outlines and views of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.text import WS
from paperloom.operators import structure as op
from paperloom.plans import derived as d
from paperloom.plans.registry import query
from paperloom.sources.tables import load_wide

_BLOCKS_SQL = (
    d.MD_LINES_SQL
    + f""",
kinds AS (
  SELECT *, CASE WHEN regexp_replace(text, '{WS}+', '', 'g') = '' THEN 'blank'
    WHEN regexp_matches(text, '^#{{1,6}}{WS}+.+$') THEN 'heading'
    WHEN regexp_matches(text, '^[-*+]{WS}+') THEN 'list'
    WHEN regexp_matches(text, '^{WS}*\\|') THEN 'table' ELSE 'paragraph' END AS type
  FROM ml),
marked AS (
  SELECT *, CASE WHEN type = 'blank' OR (type = 'table' AND
      lag(type) OVER (PARTITION BY doc_id ORDER BY line_no) = 'table') THEN 0 ELSE 1 END AS st
  FROM kinds),
numbered AS (
  SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no)::int AS block_no FROM marked),
b0 AS (
  SELECT doc_id, block_no, any_value(type) AS type, min(line_no) AS first_line,
    max(line_no) AS last_line, string_agg(text, chr(10) ORDER BY line_no) AS raw
  FROM numbered WHERE type <> 'blank' GROUP BY doc_id, block_no),
blocks AS (
  SELECT doc_id, block_no, type, first_line, last_line,
    CASE WHEN type = 'heading' THEN length(regexp_extract(raw, '^(#+)', 1)) END AS level,
    CASE WHEN type = 'heading' THEN regexp_extract(raw, '^#{{1,6}}{WS}+(.+)$', 1)
      WHEN type = 'list' THEN regexp_replace(raw, '^[-*+]{WS}+', '') ELSE raw END AS text,
    CASE WHEN type = 'table' THEN (row_number() OVER
      (PARTITION BY doc_id, type ORDER BY block_no) - 1)::int END AS table_idx
  FROM b0)
"""
)
_TABLE_CELLS_SQL = (
    _BLOCKS_SQL
    + f""",
trows AS (
  SELECT doc_id, table_idx, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM blocks WHERE type = 'table'),
krows AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY i) - 1)::int AS row
  FROM trows WHERE NOT regexp_matches(line, '^\\|[\\s:|-]+\\|')),
kcells AS (
  SELECT doc_id, table_idx, row, i = 1 AS is_header, string_split(line, '|') AS parts FROM krows),
mcells AS (
  SELECT doc_id, table_idx, row, is_header,
    unnest(parts[2:-2]) AS raw, generate_subscripts(parts[2:-2], 1) - 1 AS col
  FROM kcells WHERE len(parts) > 2),
md_cells AS (
  SELECT doc_id, table_idx, row, col::int AS col, 1 AS row_span, 1 AS col_span,
    regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS text, is_header
  FROM mcells)
"""
)
MD_BLOCKS_SQL, MD_CELLS_SQL = _BLOCKS_SQL, _TABLE_CELLS_SQL


@query(
    "document_lines", f"WITH {d.LINES_SQL} SELECT doc_id, line_no, text FROM l"
)
def document_lines(spark, sf_dir):
    return op.lines(d.documents(spark, sf_dir))


@query(
    "blocks",
    f"""WITH {_BLOCKS_SQL}
    SELECT doc_id, block_no, type, level, text, table_idx, first_line, last_line FROM blocks""",
)
def blocks(spark, sf_dir):
    return op.blocks(d.markdown(spark, sf_dir)).drop("is_footnote", "parent_block_no")


@query(
    "table_cells", f"WITH {_TABLE_CELLS_SQL} SELECT * FROM md_cells"
)
def table_cells(spark, sf_dir):
    return op.table_cells(op.blocks(d.markdown(spark, sf_dir)))


@query(
    "inline_runs",
    f"""WITH {_BLOCKS_SQL},
    hits AS (
      SELECT doc_id, block_no,
        unnest(regexp_extract_all(text, '\\*\\*.+?\\*\\*|\\*.+?\\*')) AS hit,
        generate_subscripts(regexp_extract_all(text, '\\*\\*.+?\\*\\*|\\*.+?\\*'), 1) AS run_no
      FROM blocks)
    SELECT doc_id, block_no, run_no,
      CASE WHEN starts_with(hit, '**') THEN 'bold' ELSE 'italic' END AS style,
      CASE WHEN starts_with(hit, '**') THEN hit[3:-3] ELSE hit[2:-2] END AS text
    FROM hits""",
)
def inline_runs(spark, sf_dir):
    return op.inline_runs(op.blocks(d.markdown(spark, sf_dir)))


@query(
    "inline_run_census",
    f"""WITH {_BLOCKS_SQL},
    hits AS (SELECT unnest(regexp_extract_all(text, '\\*\\*.+?\\*\\*|\\*.+?\\*')) AS hit FROM blocks)
    SELECT CASE WHEN starts_with(hit, '**') THEN 'bold' ELSE 'italic' END AS style, count(*) AS n
    FROM hits GROUP BY 1""",
)
def inline_run_census(spark, sf_dir):
    runs = op.inline_runs(op.blocks(d.markdown(spark, sf_dir)))
    return runs.groupBy("style").agg(F.count("*").alias("n"))


@query(
    "outline",
    f"""WITH {d.MD_LINES_SQL},
    h AS (
      SELECT doc_id, string_agg(repeat('  ', length(regexp_extract(text, '^(#+)', 1)) - 1)
        || regexp_replace(text, '{WS}+$', ''), chr(10) ORDER BY line_no) AS o
      FROM ml WHERE regexp_matches(text, '^#{{1,6}}{WS}+.+') GROUP BY doc_id)
    SELECT doc_id, coalesce(o, '{op.NO_HEADINGS}') AS outline
    FROM documents LEFT JOIN h USING (doc_id)""",
)
def outline(spark, sf_dir):
    return op.outline(d.markdown(spark, sf_dir))


@query(
    "read_view",
    """SELECT doc_id, substr(text, 1, 2000) AS body, length(text) > 2000 AS truncated
    FROM documents""",
)
def read_view(spark, sf_dir):
    return op.read_view(d.documents(spark, sf_dir), cap=2000)


@query(
    "read_view_whole",
    "SELECT doc_id, coalesce(text, '') AS body, false AS truncated FROM documents",
)
def read_view_whole(spark, sf_dir):
    return op.read_view(d.documents(spark, sf_dir))


@query(
    "read_view_outline",
    f"""WITH {d.MD_LINES_SQL},
    h AS (
      SELECT doc_id, string_agg(repeat('  ', length(regexp_extract(text, '^(#+)', 1)) - 1)
        || regexp_replace(text, '{WS}+$', ''), chr(10) ORDER BY line_no) AS o
      FROM ml WHERE regexp_matches(text, '^#{{1,6}}{WS}+.+') GROUP BY doc_id)
    SELECT doc_id, coalesce(o, '{op.NO_HEADINGS}') AS body, false AS truncated
    FROM documents LEFT JOIN h USING (doc_id)""",
)
def read_view_outline(spark, sf_dir):
    return op.read_view(d.markdown(spark, sf_dir), outline=True)


_SOUGHT = "ation"


@query(
    "read_view_search",
    f"""WITH {d.LINES_SQL},
    hits AS (SELECT doc_id, line_no AS hit FROM l WHERE contains(lower(text), '{_SOUGHT}')),
    near AS (
      SELECT doc_id, line_no, text FROM l WHERE EXISTS (
        SELECT 1 FROM hits WHERE hits.doc_id = l.doc_id AND hit BETWEEN line_no - 2 AND line_no + 2)),
    runs AS (
      SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM near),
    excerpts AS (
      SELECT doc_id, run, string_agg(line_no || ': ' || text, chr(10) ORDER BY line_no) AS excerpt
      FROM runs GROUP BY doc_id, run),
    found AS (
      SELECT doc_id, string_agg(excerpt, chr(10) || '…' || chr(10) ORDER BY run) AS body
      FROM excerpts GROUP BY doc_id)
    SELECT doc_id, coalesce(body, '''{_SOUGHT}'' 를 찾지 못했습니다.') AS body, false AS truncated
    FROM documents LEFT JOIN found USING (doc_id)""",
)
def read_view_search(spark, sf_dir):
    return op.read_view(d.documents(spark, sf_dir), search=_SOUGHT)


_MARK = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,"
    "'<script\\b.*?</script\\s*>', '', 'gis'), '<style\\b.*?</style\\s*>', '', 'gis'),"
    "'<!--.*?-->', '', 'gs'),"
    f"'<({op.TEXT_TAGS})(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'gi'),"
    f"'</?(?:{op.TEXT_TAGS}|{op.BREAK_TAGS})(?:\\s[^>]*)?>', chr(1), 'gi')"
)
PAGE_BLOCKS_SQL = f"""
segs AS (
  SELECT page_id, unnest(string_split({_MARK}, chr(1))) AS s,
    generate_subscripts(string_split({_MARK}, chr(1)), 1) AS i
  FROM pages),
cleaned AS (
  SELECT page_id, i, lower(split_part(s, chr(2), 1)) AS tag,
    regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(split_part(s, chr(2), 2), '<br(?:\\s[^>]*)?>', ' ', 'gi'),
        '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'),
      '{WS}+', ' ', 'g'), '^ +| +$', '', 'g') AS text
  FROM segs WHERE regexp_matches(s, '^(?:{op.TEXT_TAGS})' || chr(2), 'i')),
page_blocks AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i))::int AS block_no, tag,
    CASE WHEN tag[1] = 'h' THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS type,
    CASE WHEN tag[1] = 'h' THEN tag[2]::int END AS level, text
  FROM cleaned WHERE text <> '')
"""


@query("page_blocks", f"WITH {PAGE_BLOCKS_SQL} SELECT * FROM page_blocks")
def page_blocks(spark, sf_dir):
    return op.page_blocks(load_wide(spark, sf_dir, "pages", "page_id", "html"))


@query(
    "select_pages",
    f"""WITH {d.LINES_SQL}
    SELECT doc_id, line_no, ((line_no - 1) // 5 + 1)::int AS page, text FROM l
    WHERE (line_no - 1) // 5 + 1 IN (1, 3, 4)""",
)
def select_pages(spark, sf_dir):
    paged = op.lines(d.documents(spark, sf_dir)).withColumn(
        "page", F.expr("cast((line_no - 1) div 5 + 1 as int)")
    )
    return op.select_pages(paged, "1,3-4")
