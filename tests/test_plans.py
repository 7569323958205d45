"""Plan shape checks: no nested-loop or cartesian joins, no row-at-a-time Python UDFs,
and filters / column pruning reaching the parquet scans."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

CHECKED = ["build_hierarchy", "blocks", "rollup_updated_at", "card_content", "questions", "exam_totals",
           "search_documents", "violations", "push_gate", "lookup_path", "apply_file_edits", "changed_paths",
           "xml_resolve_stubs", "export_tree", "markdown_to_html", "job_verify"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_nested_loops_or_row_udfs(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan


def test_scan_prunes_columns(spark):
    from pyspark.sql import functions as F
    from lectern.sources.catalogue import table
    df = table(spark, SF_SMALL, "documents").filter(F.col("doc_id") % 10 == 2).select("doc_id")
    plan = plan_of(df)
    assert "ReadSchema: struct<doc_id:bigint>" in plan
