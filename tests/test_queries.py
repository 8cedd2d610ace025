"""Every registered query of the core against its SQL, on whole tables."""

from __future__ import annotations

import pytest

from gridloom.plans import catalog, training

QUERIES = {**catalog.QUERIES, **training.QUERIES}
SQL = {**catalog.SQL, **training.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, against_sql):
    against_sql(QUERIES[name], SQL[name])


def test_every_other_query_is_tested_here():
    assert set(QUERIES) - set(SQL) == {"p2_found", "p2_converted"}


def test_units_of_whole_tables(spark, data):
    catalog_rows = {r.unit_code: r for r in spark.read.parquet(f"{data}/unit_catalog.parquet").collect()}
    converted = QUERIES["p2_converted"](spark, data).collect()
    found = {(r.global_id, r.unit_code) for r in QUERIES["p2_found"](spark, data).collect()}
    assert len(converted) == len({r.global_id for r in converted}) > 0 and found
    recorded = [r for r in converted if r.origin in ("text", "column", "name", "row")]
    assert found == {(r.global_id, r.unit_code) for r in recorded if r.common_unit is not None and r.unit_code != r.common_unit}
    for r in converted:
        if r.origin == "counted":
            assert r.unit_code is None and r.common_value is None
        elif r.origin == "review":
            assert r.common_unit is None and r.common_value is None and not (r.confidence or 0) >= 0.9
        elif r.value is not None and r.value == r.value:
            assert r.common_value == r.value * catalog_rows[r.unit_code].to_common and r.common_unit == catalog_rows[r.unit_code].common_unit
    # number cells are those of tag Float, and texts of a number and a unit
    floats = {r.global_id for r in spark.read.parquet(f"{data}/cells.parquet").where("tag = 'Float' AND global_id IS NOT NULL").collect()}
    assert floats <= {r.global_id for r in converted}


def test_entry_has_the_flagship(spark, data):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.queries()["table_diff"](spark, data).count() > 0
