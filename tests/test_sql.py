"""Functions and views from SQL give what the DataFrame forms give."""

from conftest import rows
from pyspark.sql import functions as F

from paperloom import sql
from paperloom.functions import pii as p
from paperloom.operators import structure
from paperloom.operators.unified import line_changes
from paperloom.sources import sheets

TEXT = "# 제목\n010-1234-5678 and kim@example.com\n| a | b |\n|---|---|\n| 900101-1234567 | 1234-5678-9012-3456 |\n\n  x \t y"


def test_views_equal_the_operators(spark, docs_of):
    docs = docs_of(TEXT, "", "plain")
    names = sql.publish(docs, "v")
    assert names == ["v"] + [f"v_{part}" for part in sql.VIEWS]
    for part, make in sql.VIEWS.items():
        want = make(docs)
        assert rows(spark.sql(f"SELECT * FROM v_{part}"), *want.columns) == rows(want, *want.columns), part
    assert spark.table("v_cells").count() == 4
    pairs = spark.createDataFrame([(1, "a\nb", "b\na"), (2, "a", "a")], "pair_id long, before string, after string")
    sql.publish_pairs(pairs, "w")
    want = line_changes(pairs)
    assert rows(spark.table("w_changes"), *want.columns) == rows(want, *want.columns)
    assert spark.sql("SELECT count(DISTINCT pair_id) FROM w_hunks").first()[0] == 1


def test_views_prune_what_is_not_asked_for(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, TEXT, "wide")], "doc_id long, text string, source string").write.parquet(path)
    sql.publish(spark.read.parquet(path), "r")
    plan = spark.sql("SELECT line_no FROM r_lines WHERE doc_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1)" in plan and "source" not in plan and "Python" not in plan


def test_functions_equal_the_columns(spark, docs_of):
    docs = docs_of(TEXT, "", None)
    sql.install(spark)
    sql.install(spark)
    sql.publish(docs, "f")
    for kind in p.PATTERNS:
        want = docs.select("doc_id", F.transform(p.matches(F.col("text"), kind), lambda m: p.mask(kind, m)).alias("m"))
        got = spark.sql(f"SELECT doc_id, pii_matches('{kind}', text) AS hits FROM f").select(
            "doc_id", F.explode_outer("hits").alias("hit")
        )
        got.createOrReplaceTempView("hits")
        masked = spark.sql(f"SELECT doc_id, pii_mask('{kind}', hit) AS m FROM hits WHERE hit IS NOT NULL")
        assert rows(masked, "doc_id", "m") == rows(want.select("doc_id", F.explode("m").alias("m")), "doc_id", "m"), kind
        assert masked.count() == 1, kind
    got = spark.sql("SELECT doc_id, doc_lines(text) AS ls, squeeze_spaces(text) AS s FROM f")
    assert rows(got, "doc_id", "ls") == rows(docs.withColumn("ls", structure.text_lines(F.col("text"))), "doc_id", "ls")
    assert got.filter("doc_id = 1").first().s.endswith(" x y")
    levels = spark.sql("SELECT heading_level('## a') AS a, heading_level('##a') AS b, heading_level('a') AS c").first()
    assert tuple(levels) == (2, None, None)
    assert spark.sql("SELECT pii_matches('no kind', 'x') AS a, pii_mask('no kind', 'x') AS b").first().b == "x"


def test_one_folder_is_replaced_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "sheets")
    cells = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, None, "c"), (4, "007", "d")], "id int, sheet string, text string")
    sheets.write_partitioned(cells, path, ["sheet"], files_per_value=2)
    changed = cells.filter("sheet = 'A'").withColumn("text", F.lit("z"))
    sheets.write_partitioned(changed, path, ["sheet"], keep_others=True)
    back = sheets.read_partitioned(spark, path, cells.schema)
    assert back.schema.names == ["id", "sheet", "text"]
    assert rows(back, *back.columns) == rows(cells.filter("id > 1").union(changed), *back.columns)
    sheets.write_partitioned(cells.filter("false"), path, ["sheet"], keep_others=True)
    assert back.count() == 4
    plan = back.filter("sheet = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sheet" in plan
    sheets.write_partitioned(changed, path, ["sheet"])
    assert sheets.read_partitioned(spark, path, cells.schema).count() == 1
