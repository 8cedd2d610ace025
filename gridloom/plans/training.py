"""Queries over the general training-data operators (problems 2 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.snapshots import snapshot_deltas
from gridloom.operators.units import convert_units, recorded_units
from gridloom.sources.tables import load


def _unit_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [load(spark, folder, t) for t in ("cells", "extracted_tables", "unit_catalog")]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    # a predicted unit is no recorded one: the classifier would change no row here, it serves p2_converted
    recorded = recorded_units(*_unit_tables(spark, folder)).where("common_unit IS NOT NULL AND unit_code <> common_unit")
    return recorded.select("global_id", "unit_code").distinct()


def p2_converted(spark: SparkSession, folder: str) -> DataFrame:
    converted = convert_units(*_unit_tables(spark, folder))
    return converted.select("global_id", "unit_code", "origin", F.round("confidence", 4).alias("confidence"), "value", "common_unit", "common_value")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    deltas = snapshot_deltas(load(spark, folder, "summary_snapshots"), load(spark, folder, "numeric_index"))
    return deltas.select("snapshot_no", "record_kind", "record_key", "delta_type").distinct()


P5_FOUND_SQL = """
WITH delivered AS (
  SELECT snapshot_no, project_code, lag(snapshot_no) OVER (PARTITION BY project_code ORDER BY snapshot_no) AS prev_no
  FROM (SELECT DISTINCT snapshot_no, project_code FROM summary_snapshots)
), sec AS (
  SELECT DISTINCT snapshot_no, project_code, 'section' AS record_kind, id || '_' || sid AS record_key, 0.0::DOUBLE AS v
  FROM (SELECT snapshot_no, project_code, id, unnest(section_ids) AS sid
        FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, project_code, id ORDER BY seq DESC) AS rn FROM summary_snapshots) WHERE rn = 1)
), cel AS (
  SELECT snapshot_no, project_code, 'cell' AS record_kind,
         section_id || '_' || table_id || '_' || row_idx || '_' || col_idx AS record_key, numeric_value AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, project_code, section_id, table_id, row_idx, col_idx ORDER BY seq DESC) AS rn
        FROM numeric_index WHERE numeric_value IS NOT NULL) WHERE rn = 1
), e AS (SELECT * FROM sec UNION ALL SELECT * FROM cel),
n AS (SELECT e.*, d.prev_no FROM e JOIN delivered d USING (snapshot_no, project_code) WHERE d.prev_no IS NOT NULL),
o AS (SELECT d.snapshot_no, e.project_code, e.record_kind, e.record_key, e.v
      FROM delivered d JOIN e ON e.project_code = d.project_code AND e.snapshot_no = d.prev_no)
SELECT snapshot_no, record_kind, record_key, 'Added' AS delta_type FROM n ANTI JOIN o USING (snapshot_no, project_code, record_kind, record_key)
UNION
SELECT snapshot_no, record_kind, record_key, 'Removed' FROM o ANTI JOIN n USING (snapshot_no, project_code, record_kind, record_key)
UNION
SELECT n.snapshot_no, record_kind, record_key, 'ValueMismatch' FROM n JOIN o USING (snapshot_no, project_code, record_kind, record_key)
WHERE NOT isnan(n.v) AND NOT isnan(o.v) AND abs(n.v - o.v) >= 1.0 AND NOT isnan(abs(n.v - o.v))
"""

QUERIES = {"p2_found": p2_found, "p2_converted": p2_converted, "p5_found": p5_found}
SQL = {"p5_found": P5_FOUND_SQL}
