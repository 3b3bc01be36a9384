"""What the plans must not hold, and what they must."""

import re

import pytest

from pyspark.sql import functions as F

from paperloom.operators import ranking
from paperloom.plans import QUERIES
from paperloom.sources.tables import load

SF_DIR = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan(spark, name):
    return plan_of(QUERIES[name](spark, SF_DIR))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_first_n_is_cut_before_the_shuffle(spark):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, "pii_by_source"))
    docs = load(spark, SF_DIR, "documents").select("source", "doc_id")
    assert re.search(r"WindowGroupLimit .*Partial", plan_of(ranking.cap(docs, ["source"], [F.col("doc_id")], 3)))


@pytest.mark.parametrize(
    "name", ["blocks", "table_cells", "outline", "read_view", "search_excerpts", "find_replace_all", "change_snippets",
             "redact", "pii_ranges", "residual_pii", "sequence_gaps", "paragraph_texts", "page_blocks", "session_list"]
)
def test_work_inside_a_document_needs_no_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<conv_id:bigint,text:string>" in plan(spark, "estimate_tokens")
    assert re.search(r"PushedFilters: \[.*EqualTo\(role,user\)", plan(spark, "prompt_compare"))


def test_texts_are_searched_once(spark):
    df = QUERIES["pii_by_source"](spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_load_keeps_the_table(spark):
    assert load(spark, SF_DIR, "documents").count() == 200
