"""Listings, encodings, journals and sheets derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans import derived as d
from paperloom.plans.registry import query
from paperloom.session import shared_folder
from paperloom.sources import encoding, files, journal, sheets
from paperloom.sources.tables import load_wide

_EXTS = ".hwp .HWPX .docx .xlsx .xls .pdf .md .txt .png _none .hwpml".split()
_PATH = (
    "case doc_id % 7 when 0 then 'a/b/' when 1 then '.cache/x/' when 2 then 'p/node_modules/y/' "
    "when 3 then 'deep/1/2/3/4/' || case when doc_id % 2 = 0 then '5/' else '' end when 4 then 'a/' "
    "when 5 then 'src/' || source || '/' else '' end || case when doc_id % 13 = 0 then '.' else '' end "
    "|| 'doc_' || doc_id || case doc_id % 11 "
    + " ".join(f"when {i} then '{e}'" for i, e in enumerate(_EXTS))
    + " end"
)
_FILES_SQL = f"""
files AS (
  SELECT doc_id, {_PATH} AS path, strlen(text) * CASE WHEN doc_id % 5 = 0 THEN 1000000 ELSE 1 END AS length,
    CASE WHEN doc_id % 4 = 0 THEN 'ole2' WHEN doc_id % 4 IN (1, 2) THEN 'zip' ELSE 'other' END AS ct
  FROM documents),
named AS (SELECT *, string_split(path, '/') AS parts,
    lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1)) AS ext FROM files)
"""


def _listing(spark, sf_dir):
    return load_wide(spark, sf_dir, "documents", "doc_id", "text", "source").select(
        F.expr(_PATH).alias("path"),
        F.expr("octet_length(text) * if(doc_id % 5 = 0, 1000000L, 1L)").alias("length"),
        F.expr(
            """case when doc_id % 4 = 0 then unhex('D0CF11E0A1B11AE1') when doc_id % 4 in (1, 2) then unhex('504B0304')
            else cast(left(text, 8) as binary) end"""
        ).alias("head"),
    )


@query(
    "inventory",
    f"""WITH {_FILES_SQL},
    ok AS (SELECT * FROM named WHERE len(list_filter(parts, lambda p: p[1] = '.' OR p IN
      ('node_modules', '.git', '.DS_Store', '__pycache__', 'dist', 'build', '.next'))) = 0),
    items AS (
      SELECT path, len(parts) - 1 AS depth, false AS is_dir FROM ok
      UNION SELECT array_to_string(parts[:n], '/') || '/', n - 1, true
        FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM ok)),
    e AS (SELECT path, is_dir, NOT is_dir AND regexp_matches(lower(path),
        '\\.(hwp|hwpx|hwpml|docx|doc|xlsx|xls|pdf|pptx|ppt|md|txt)$') AS is_doc FROM items)
    SELECT *, CASE WHEN is_doc THEN 0 WHEN is_dir THEN 1 ELSE 2 END AS rank FROM e""",
)
def inventory(spark, sf_dir):
    return files.inventory(_listing(spark, sf_dir).select("path"))


_CLASSIFIED = f"""{_FILES_SQL},
    c AS (SELECT path, ext, CASE WHEN ext IN ('.xlsx', '.xls') THEN 'sheet' WHEN ext IN ('.md', '.txt') THEN 'other'
        ELSE 'doc' END AS kind, ext IN ('.hwpx', '.docx', '.xlsx', '.md', '.txt', '.hwp') AS writable,
      CASE WHEN ext IN ('.hwp', '.xls') THEN path || 'x' ELSE path END AS output_path,
      CASE ext WHEN '.hwp' THEN '.hwp → .hwpx' WHEN '.xls' THEN '.xls → .xlsx' END AS conversion
    FROM named WHERE ext IN ('.hwp', '.hwpx', '.hwpml', '.docx', '.xlsx', '.xls', '.pdf', '.md', '.txt'))
"""


@query("classify_files", f"WITH {_CLASSIFIED} SELECT * FROM c")
def classify_files(spark, sf_dir):
    return files.classify_files(_listing(spark, sf_dir).select("path"))


@query(
    "file_census", f"WITH {_CLASSIFIED} SELECT kind, writable, count(*) AS files FROM c GROUP BY ALL"
)
def file_census(spark, sf_dir):
    kinds = files.classify_files(_listing(spark, sf_dir).select("path"))
    return kinds.groupBy("kind", "writable").agg(F.count("*").alias("files"))


_TRIAGE = f"""{_FILES_SQL},
    t AS (SELECT path, ct AS content_type, CASE WHEN length > 104857600 THEN 'too_large'
      WHEN ext = '.hwp' OR (ct = 'ole2' AND ext NOT IN ('.hwp', '.doc', '.xls', '.ppt')) THEN 'old_binary'
      WHEN ext IN ('.hwpx', '.docx', '.xlsx') AND ct <> 'zip' THEN 'content_mismatch' ELSE 'ok' END AS reason
    FROM named)
"""


@query("triage", f"WITH {_TRIAGE} SELECT * FROM t")
def triage(spark, sf_dir):
    return files.triage(_listing(spark, sf_dir))


@query("triage_census", f"WITH {_TRIAGE} SELECT reason, count(*) AS files FROM t GROUP BY reason")
def triage_census(spark, sf_dir):
    return files.triage(_listing(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("files"))


_ENCODED_SQL = """
enc AS (SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' WHEN 4 THEN 'utf-16le'
    WHEN 5 THEN 'cp949' ELSE 'utf-8' END AS encoding,
  md5(CASE doc_id % 6 WHEN 4 THEN '가é' || text WHEN 5 THEN '안녕' || regexp_replace(text, '[^ -~\\n]', '', 'g')
    ELSE text END) AS digest
  FROM documents)
"""


def _decoded(spark, sf_dir):
    raw = d.documents(spark, sf_dir).select(
        "doc_id",
        F.expr(
            """case doc_id % 6 when 0 then encode(text, 'UTF-8')
            when 1 then unhex('EFBBBF') || encode(text, 'UTF-8')
            when 2 then unhex('FFFE') || encode(text, 'UTF-16LE')
            when 3 then unhex('FEFF') || encode(text, 'UTF-16BE')
            when 4 then encode('가é' || text, 'UTF-16LE')
            else unhex('BEC8B3E7') || encode(regexp_replace(text, '[^ -~\\n]', ''), 'UTF-8') end"""
        ).alias("content"),
    )
    return encoding.decode_text(raw)


@query("decode_text", f"WITH {_ENCODED_SQL} SELECT * FROM enc")
def decode_text(spark, sf_dir):
    return _decoded(spark, sf_dir).select("doc_id", "encoding", F.md5("text").alias("digest"))


@query(
    "encoding_census", f"WITH {_ENCODED_SQL} SELECT encoding, count(*) AS files FROM enc GROUP BY encoding"
)
def encoding_census(spark, sf_dir):
    return encoding.encoding_census(_decoded(spark, sf_dir))


# Every message of a conversation is the journal of a session of its own.
_JOURNAL_SQL = """
j AS (
  SELECT 's' || conv_id || '_' || turn AS session_id, conv_id, turn, role, text,
    TIMESTAMP '2026-01-01' + to_minutes((conv_id * 10 + turn)::int) AS mtime, conv_id % 10 = 7 AS headless
  FROM conversations WHERE role IN ('user', 'assistant'))
"""


def journals(spark, sf_dir):
    base = load_wide(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    line = lambda kind, data: F.to_json(
        F.struct(F.lit(1).alias("v"), F.lit("2026-01-01T00:00:00.000Z").alias("ts"), kind.alias("type"), data.alias("data"))
    )
    plain = line(F.col("role"), F.struct("role", F.col("text").alias("content")))
    parts = line(
        F.col("role"),
        F.struct(
            "role",
            F.array(
                F.struct(F.lit("tool-call").alias("type"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("text").alias("type"), F.col("text")),
            ).alias("content"),
        ),
    )
    meta = line(F.lit("meta"), F.struct(F.col("conv_id").alias("id"), F.lit("/work").alias("cwd")))
    audit = line(F.lit("approval"), F.struct(F.lit(True).alias("approved")))
    return base.select(
        F.expr("'s' || conv_id || '_' || turn").alias("session_id"),
        F.expr(
            "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int))"
        ).alias("mtime"),
        F.concat_ws(
            "\n",
            F.when(F.col("conv_id") % 10 != 7, meta),
            F.lit("  "),
            F.when(F.col("turn") % 4 == 2, parts).otherwise(plain),
            F.lit('{"v":1,"ts":"2026-01-01T00:0'),
            audit,
        ).alias("content"),
    )


@query(
    "journal_records",
    f"""WITH {_JOURNAL_SQL}, ok AS (SELECT * FROM j WHERE NOT headless)
    SELECT session_id, 1 AS line_no, 1 AS v, 'meta' AS type, NULL::varchar AS text FROM ok
    UNION ALL SELECT session_id, 3, 1, role, text FROM ok
    UNION ALL SELECT session_id, 5, 1, 'approval', NULL FROM ok""",
)
def journal_records(spark, sf_dir):
    records = journal.journal_records(journals(spark, sf_dir))
    return records.select(
        "session_id", "line_no", "v", "type", journal.content_text(F.col("data")).alias("text")
    )


@query(
    "replay",
    f"""WITH {_JOURNAL_SQL} SELECT session_id, 3 AS line_no, role AS type, text FROM j WHERE NOT headless""",
)
def replay(spark, sf_dir):
    played = journal.replay(journal.journal_records(journals(spark, sf_dir)))
    return played.select("session_id", "line_no", "type", journal.content_text(F.col("data")).alias("text"))


_PREVIEW = "trim(replace(text, chr(10), ' '))"
_LIST_SQL = f"""{_JOURNAL_SQL},
    s AS (SELECT session_id, mtime, CASE WHEN role = 'user' THEN CASE WHEN length({_PREVIEW}) > 60
      THEN substr({_PREVIEW}, 1, 60) || '…' ELSE {_PREVIEW} END END AS preview FROM j WHERE NOT headless)
"""


@query("session_list", f"WITH {_LIST_SQL} SELECT * FROM s")
def session_list(spark, sf_dir):
    return journal.session_list(journals(spark, sf_dir)).drop("meta")


@query("latest_session", f"WITH {_LIST_SQL} SELECT * FROM s ORDER BY mtime DESC, session_id DESC LIMIT 1")
def latest_session(spark, sf_dir):
    return journal.latest_session(journals(spark, sf_dir)).drop("meta")


def _sheets(spark, sf_dir):
    rows = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    return d.documents(spark, sf_dir, "lang").select(
        "doc_id", F.col("lang").alias("sheet"), rows.alias("rows")
    )


@query(
    "sheets_to_rows",
    """WITH r AS (SELECT doc_id, lang AS sheet, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents)
    SELECT doc_id, sheet, row, unnest(string_split(line, ' ')) AS text,
      generate_subscripts(string_split(line, ' '), 1) - 1 AS col FROM r""",
)
def sheets_to_rows(spark, sf_dir):
    return sheets.sheets_to_rows(_sheets(spark, sf_dir))


@query(
    "sheet_shapes",
    """SELECT doc_id, lang AS sheet, len(string_split(text, chr(10))) AS rows,
      len(string_split(string_split(text, chr(10))[1], ' ')) AS cols FROM documents""",
)
def sheet_shapes(spark, sf_dir):
    return sheets.sheet_shapes(_sheets(spark, sf_dir))


@query(
    "sheet_sink",
    """WITH r AS (SELECT doc_id, lang AS sheet, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents WHERE lang IN ('de', 'en'))
    SELECT doc_id, sheet, row, CASE WHEN sheet = 'en' THEN 'line ' || row ELSE unnest(string_split(line, ' ')) END AS text,
      generate_subscripts(string_split(line, ' '), 1) - 1 AS col FROM r""",
)
def sheet_sink(spark, sf_dir):
    """Sheets written by name, one of them replaced, two of them read back."""
    cells = sheets.sheets_to_rows(_sheets(spark, sf_dir))
    path = shared_folder(spark, "sheets")
    sheets.write_partitioned(cells, path, ["sheet"], files_per_value=8)
    mended = cells.filter("sheet = 'en'").withColumn("text", F.concat(F.lit("line "), F.col("row").cast("string")))
    sheets.write_partitioned(mended, path, ["sheet"], files_per_value=8, keep_others=True)
    return sheets.read_partitioned(spark, path, cells.schema).filter("sheet IN ('de', 'en')")
