"""Plans: filters and columns reach the scan, no cross joins, no single-partition exchange of rows."""

import re

import pytest

from quire import plans

SF = "/root/testdata/sf0.001"


def explain(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - {"fallback_chain"}))
def test_plan(spark, name):
    text = explain(spark, plans.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Exchange\n(?:.*\n){0,4}Arguments: SinglePartition", text) or "Aggregate" in text


@pytest.mark.parametrize(("name", "columns"), [("first_wins", "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity"), ("ws_collapse", "doc_id,text"), ("progress", "doc_id,text,source"), ("pub_date", "o_orderkey")])
def test_only_needed_columns_are_read(spark, name, columns):
    text = explain(spark, plans.QUERIES[name](spark, SF))
    read = {c.split(":")[0] for c in re.search(r"ReadSchema: struct<([^>]*)>", text)[1].split(",")}
    assert read == set(columns.split(","))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in explain(spark, plans.QUERIES["page_mark_asof"](spark, SF))
