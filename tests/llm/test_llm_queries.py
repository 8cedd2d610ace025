"""Queries of the subpackage: against SQL where there is one, else that they run over whole tables."""

from __future__ import annotations

import pytest

from gridloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, against_sql):
    against_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    rows = df.count()
    assert rows == df.distinct().count()


@pytest.mark.parametrize("name", ["p1_found", "p1_pieces", "p3_found", "p3_repaired", "p4_unified", "p6_found", "p6_repaired", "p7_found", "p7_clean", "p9_found", "p9_documents", "p9_passages"])
def test_texts_enter_python_once(name, spark, data):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    # p4_unified reads two tables
    assert plan.count("ArrowEvalPython [") == (2 if name == "p4_unified" else 1)
