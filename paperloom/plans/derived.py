"""Inputs that the dataset tables do not hold as such, derived from them row by row.

Each has a Spark form and, under the same name, the SQL of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import load, load_wide

LINES_SQL = """
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents)
"""


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return load_wide(spark, sf_dir, "documents", "doc_id", "text", *more)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with headings, list items, tables, markers and runs added line by line."""

    def mark(x, i):
        k = (i + 1 + F.col("doc_id")) % 10
        n = (i + 1).cast("string")
        return (
            F.when(F.trim(x) == "", x)
            .when(k == 0, F.concat(F.lit("## "), x))
            .when(k == 1, F.concat(F.lit("- "), x))
            .when(k == 2, F.concat(F.lit("| item | "), x, F.lit(" |")))
            .when(k == 3, F.lit("|---|---|"))
            .when(
                k == 4,
                F.concat(
                    F.lit("| "),
                    F.substring(x, 1, 20),
                    F.lit(" | "),
                    F.length(x).cast("string"),
                    F.lit(" |"),
                ),
            )
            .when(k == 5, F.concat(F.lit("□ "), x))
            .when(k == 6, F.concat(n, F.lit(". "), x))
            .when(
                k == 7,
                F.concat(
                    F.lit("**"),
                    F.substring(x, 1, 10),
                    F.lit("** and *"),
                    F.substring(x, 3, 5),
                    F.lit("* "),
                    x,
                ),
            )
            .otherwise(x)
        )

    text = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


MD_LINES_SQL = (
    LINES_SQL
    + """,
ml AS (
  SELECT doc_id, line_no,
    CASE WHEN trim(text, ' ') = '' THEN text ELSE
    CASE (line_no + doc_id) % 10
      WHEN 0 THEN '## ' || text
      WHEN 1 THEN '- ' || text
      WHEN 2 THEN '| item | ' || text || ' |'
      WHEN 3 THEN '|---|---|'
      WHEN 4 THEN '| ' || substr(text, 1, 20) || ' | ' || length(text) || ' |'
      WHEN 5 THEN '□ ' || text
      WHEN 6 THEN line_no || '. ' || text
      WHEN 7 THEN '**' || substr(text, 1, 10) || '** and *' || substr(text, 3, 5) || '* ' || text
      ELSE text END END AS text
  FROM l)
"""
)


def contacts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Every document with an added block of contact data built from its number."""
    return with_contacts(documents(spark, sf_dir, *more))


def with_contacts(docs: DataFrame) -> DataFrame:
    return docs.withColumn(
        "text",
        F.expr(
            """text || '\n등록 ' || if(doc_id % 7 = 0, '12-', '')
            || lpad(cast(doc_id % 1000000 as string), 6, '0') || '-'
            || cast(1 + doc_id % 5 as string) || lpad(cast(doc_id * 7919 % 1000000 as string), 6, '0')
            || ' 전화 ' || case doc_id % 3 when 0 then '010-' when 1 then '02-' else '031-' end
            || lpad(cast(doc_id % 10000 as string), if(doc_id % 3 = 1, 3, 4), '7') || '-'
            || lpad(cast(doc_id * 31 % 10000 as string), 4, '0')
            || '\n카드 ' || lpad(cast(doc_id % 10000 as string), 4, '4')
            || '-1234-5678-' || lpad(cast(doc_id * 17 % 10000 as string), 4, '0')
            || if(doc_id % 11 = 0, '-9999', '')
            || ' 메일user' || cast(doc_id % 50 as string) || '@mail.example.co.kr'
            || if(doc_id % 4 = 0, '\n010-1234-5678@x.com, 010-1234-5678, 010-1234-5678', '')"""
        ),
    )


CONTACTS_SQL = """
contacts AS (
  SELECT doc_id, source, text || chr(10) || '등록 ' || if(doc_id % 7 = 0, '12-', '')
    || right(lpad((doc_id % 1000000)::varchar, 6, '0'), 6) || '-'
    || (1 + doc_id % 5)::varchar || lpad((doc_id * 7919 % 1000000)::varchar, 6, '0')
    || ' 전화 ' || case doc_id % 3 when 0 then '010-' when 1 then '02-' else '031-' end
    || lpad((doc_id % 10000)::varchar, if(doc_id % 3 = 1, 3, 4), '7') || '-'
    || lpad((doc_id * 31 % 10000)::varchar, 4, '0')
    || chr(10) || '카드 ' || lpad((doc_id % 10000)::varchar, 4, '4')
    || '-1234-5678-' || lpad((doc_id * 17 % 10000)::varchar, 4, '0')
    || if(doc_id % 11 = 0, '-9999', '')
    || ' 메일user' || (doc_id % 50)::varchar || '@mail.example.co.kr'
    || if(doc_id % 4 = 0, chr(10) || '010-1234-5678@x.com, 010-1234-5678, 010-1234-5678', '') AS text
  FROM documents)
"""


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as 4-column table cells: two 4-row tables per document, some cells merged."""
    grid = load(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 8").alias("doc_id"),
        F.expr("cast(o_orderkey div 4 % 2 as int)").alias("table_idx"),
        F.expr("cast(o_orderkey % 4 as int)").alias("row"),
        F.expr(
            """stack(4, 0, cast(o_orderkey as string), 1, o_orderstatus,
            2, cast(cast(o_totalprice as decimal(15,2)) as string), 3, o_orderpriority)
            as (col, text)"""
        ),
    )
    wide = (F.col("doc_id") % 5 == 0) & (F.col("row") == 0)
    tall = (F.col("doc_id") % 7 == 0) & (F.col("col") == 1)
    return grid.filter(
        ~(wide & (F.col("col") == 1)) & ~(tall & (F.col("row") == 3))
    ).select(
        "doc_id",
        "table_idx",
        "row",
        "col",
        F.when(tall & (F.col("row") == 2), 2).otherwise(1).alias("row_span"),
        F.when(wide & (F.col("col") == 0), 2).otherwise(1).alias("col_span"),
        "text",
    )


CELLS_SQL = """
grid AS (
  SELECT o_orderkey // 8 AS doc_id, (o_orderkey // 4 % 2)::int AS table_idx,
         (o_orderkey % 4)::int AS row, col,
         CASE col WHEN 0 THEN o_orderkey::varchar WHEN 1 THEN o_orderstatus
           WHEN 2 THEN o_totalprice::decimal(15,2)::varchar ELSE o_orderpriority END AS text
  FROM orders, (SELECT unnest([0, 1, 2, 3])::int AS col)),
cells AS (
  SELECT doc_id, table_idx, row, col,
    CASE WHEN doc_id % 7 = 0 AND col = 1 AND row = 2 THEN 2 ELSE 1 END AS row_span,
    CASE WHEN doc_id % 5 = 0 AND col = 0 AND row = 0 THEN 2 ELSE 1 END AS col_span,
    text
  FROM grid
  WHERE NOT (doc_id % 5 = 0 AND row = 0 AND col = 1)
    AND NOT (doc_id % 7 = 0 AND row = 3 AND col = 1))
"""
