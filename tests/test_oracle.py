"""Registered queries against their DuckDB oracle SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import digest, duck

# a cross-section of areas; the full set runs with tests/oracle_check.py
NAMES = ["sibling_index", "build_hierarchy", "rollup_updated_at", "problem_records", "question_choices",
         "escape_code", "search_documents", "exam_totals", "violations", "push_gate", "apply_file_edits",
         "xml_resolve_stubs", "changed_paths", "html_to_markdown", "text_markup", "export_book"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "id" in df.columns


def test_every_query_has_oracle():
    """Every catalogue query has SQL; the training-data queries that have none are tested by brute force."""
    from lectern.plans.queries import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
