"""Operators called from SQL over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import sql
from paperloom.plans import derived as d
from paperloom.plans.pii import hits_sql
from paperloom.plans.registry import SQL, query


@query(
    "sql_block_census",
    f"SELECT type, level, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM ({SQL['blocks']}) GROUP BY ALL",
)
def sql_block_census(spark, sf_dir):
    sql.publish(d.markdown(spark, sf_dir), "marked")
    return spark.sql(
        "SELECT type, level, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM marked_blocks GROUP BY type, level"
    )


@query(
    "sql_pii_masks",
    f"WITH {hits_sql(d.CONTACTS_SQL)} SELECT doc_id, type, mk AS masked, count(*) AS times FROM masked GROUP BY ALL",
)
def sql_pii_masks(spark, sf_dir):
    sql.install(spark)
    sql.publish(d.contacts(spark, sf_dir), "contacted")
    return spark.sql(
        """WITH asked AS (SELECT doc_id, text, pii_kinds() AS kinds FROM contacted),
        found AS (SELECT doc_id, type, pii_matches(type, text) AS hits FROM asked LATERAL VIEW explode(kinds) k AS type),
        shown AS (SELECT doc_id, type, pii_mask(type, hit) AS masked FROM found LATERAL VIEW explode(hits) h AS hit)
        SELECT doc_id, type, masked, count(*) AS times FROM shown GROUP BY doc_id, type, masked"""
    )


@query(
    "sql_pii_beside_lines",
    f"""WITH {hits_sql(d.CONTACTS_SQL)},
    n AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM contacts)
    SELECT f.doc_id, f.type, f.count, n.lines FROM findings f JOIN n ON f.doc_id = n.doc_id""",
)
def sql_pii_beside_lines(spark, sf_dir):
    sql.install(spark)
    sql.publish(d.contacts(spark, sf_dir), "contacted")
    return spark.sql(
        """SELECT f.doc_id, f.type, CAST(f.count AS BIGINT) AS count, n.lines FROM contacted_pii f
        JOIN (SELECT doc_id, size(doc_lines(text)) AS lines FROM contacted) n ON f.doc_id = n.doc_id"""
    )


@query(
    "sql_changes",
    f"SELECT change, count(*) AS lines, count(DISTINCT pair_id) AS pairs FROM ({SQL['stream_ordered_feed']}) GROUP BY change",
)
def sql_changes(spark, sf_dir):
    """Every document with its lines numbered, beside itself with the first line last."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    moved = F.concat(F.slice(numbered, 2, F.size(numbered)), F.slice(numbered, 1, 1))
    pairs = d.documents(spark, sf_dir).select(
        F.col("doc_id").alias("pair_id"),
        F.array_join(numbered, "\n").alias("before"),
        F.array_join(moved, "\n").alias("after"),
    )
    sql.publish_pairs(pairs, "turned")
    return spark.sql(
        """SELECT change, count(*) AS lines, count(DISTINCT pair_id) AS pairs FROM turned_changes
        WHERE change <> 'unchanged' GROUP BY change"""
    )
