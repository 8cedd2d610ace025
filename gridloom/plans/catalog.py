"""Queries over the reference operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.hashing import hex_padded, row_hash, two_decimals
from gridloom.functions.normalize import accent_pairs, extension, file_name, global_id, normalize_header, normalize_null, normalize_number, normalize_unit, progress_percent, unknown_share
from gridloom.functions.numbers import sanitize_number
from gridloom.functions.text import fold_pairs, ignorable_class
from gridloom.operators import diff, export, headers as header_ops, index, layout, rules, truth, validate
from gridloom.operators.snapshots import section_entries
from gridloom.plans import fixtures as fx
from gridloom.session import scratch_path
from gridloom.sources import ingestion
from gridloom.sources.documents import ERRORS, error_messages, process_documents, scan_errors
from gridloom.sources.tables import load
from gridloom.streaming import sections as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}
_UNICODE_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- indexes and diffs


@_query("numeric_index", f"WITH {fx.SQL_VERSIONS} SELECT * FROM a")
def numeric_index(spark: SparkSession, folder: str) -> DataFrame:
    return fx.version_a(fx.lines(spark, folder))


_SQL_TABLE_DIFF = """
SELECT section_id, table_id, row_idx, col_idx,
       CASE WHEN oa IS NULL THEN 'Added' WHEN ob IS NULL THEN 'Removed' ELSE 'Modified' END AS kind,
       old_value, new_value, CASE WHEN oa = 1 AND ob = 1 THEN abs(old_value - new_value) END AS delta
FROM (SELECT section_id, table_id, row_idx, col_idx, max(numeric_value) AS old_value, 1 AS oa FROM a GROUP BY ALL)
FULL JOIN (SELECT section_id, table_id, row_idx, col_idx, max(numeric_value) AS new_value, 1 AS ob FROM b GROUP BY ALL)
USING (section_id, table_id, row_idx, col_idx)
WHERE oa IS NULL OR ob IS NULL OR (abs(old_value - new_value) >= 1.0 AND NOT isnan(abs(old_value - new_value)))
"""


@_query("table_diff", f"WITH {fx.SQL_VERSIONS} {_SQL_TABLE_DIFF}")
def table_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.lines(spark, folder)
    return diff.table_diff(fx.version_a(rows), fx.version_b(rows))


_SNAPSHOT_KEY = ["project_code", "section_id", "table_id", "row_idx", "col_idx"]


_SQL_PAIRS = """
pairs AS (SELECT * FROM (SELECT project_code, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project_code ORDER BY snapshot_no) AS previous_no
          FROM (SELECT DISTINCT project_code, snapshot_no FROM summary_snapshots WHERE project_code IS NOT NULL AND snapshot_no IS NOT NULL))
          WHERE previous_no IS NOT NULL)"""


def _nan_apart(deltas: DataFrame) -> DataFrame:
    """NaN as a flag, so that values can be compared."""
    for c in ("old_value", "new_value"):
        is_nan = F.coalesce(F.isnan(c) & F.col(c).isNotNull(), F.lit(False))
        deltas = deltas.withColumns({f"{c}_is_nan": is_nan, c: F.when(~is_nan, F.col(c))})
    return deltas


@_query(
    "snapshot_table_diff",
    f"""
WITH {_SQL_PAIRS},
d AS (SELECT snapshot_no, project_code, section_id, table_id, row_idx, col_idx, max({{'seq': coalesce(seq, -9223372036854775808), 'v': numeric_value}}).v AS v
      FROM numeric_index WHERE numeric_value IS NOT NULL GROUP BY ALL),
a AS (SELECT p.snapshot_no, project_code, section_id, table_id, row_idx, col_idx, v AS old_value, 1 AS oa
      FROM d JOIN pairs p USING (project_code) WHERE d.snapshot_no = p.previous_no),
b AS (SELECT p.snapshot_no, project_code, section_id, table_id, row_idx, col_idx, v AS new_value, 1 AS ob
      FROM d JOIN pairs p USING (project_code) WHERE d.snapshot_no = p.snapshot_no)
SELECT snapshot_no, project_code, section_id, table_id, row_idx, col_idx,
       CASE WHEN oa IS NULL THEN 'Added' WHEN ob IS NULL THEN 'Removed' ELSE 'Modified' END AS kind,
       coalesce(isnan(old_value), false) AS old_value_is_nan, coalesce(isnan(new_value), false) AS new_value_is_nan,
       CASE WHEN NOT isnan(old_value) THEN old_value END AS old_value, CASE WHEN NOT isnan(new_value) THEN new_value END AS new_value, CASE WHEN oa = 1 AND ob = 1 THEN abs(old_value - new_value) END AS delta
FROM a FULL JOIN b USING (snapshot_no, project_code, section_id, table_id, row_idx, col_idx)
WHERE oa IS NULL OR ob IS NULL OR (abs(old_value - new_value) >= 1.0 AND NOT isnan(abs(old_value - new_value)))
""",
)
def snapshot_table_diff(spark: SparkSession, folder: str) -> DataFrame:
    entries = load(spark, folder, "numeric_index").where("numeric_value IS NOT NULL")
    return _nan_apart(diff.table_diff(*diff.snapshot_pairs(entries, load(spark, folder, "summary_snapshots")), ["snapshot_no", *_SNAPSHOT_KEY], "seq"))


_SECTION_KEY = ["snapshot_no", "project_code", "id", "section_id"]
_SQL_SECTION_DELTAS = f"""
{_SQL_PAIRS},
held AS (SELECT snapshot_no, project_code, id, max({{'seq': coalesce(seq, -9223372036854775808), 'ids': coalesce(section_ids, [])}}).ids AS ids
         FROM summary_snapshots WHERE id IS NOT NULL AND project_code IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT * FROM (SELECT snapshot_no, project_code, id, unnest(ids) AS section_id FROM held) WHERE section_id IS NOT NULL),
so AS (SELECT p.snapshot_no, project_code, id, section_id FROM s JOIN pairs p USING (project_code) WHERE s.snapshot_no = p.previous_no),
sn AS (SELECT p.snapshot_no, project_code, id, section_id FROM s JOIN pairs p USING (project_code) WHERE s.snapshot_no = p.snapshot_no),
sd AS ((SELECT *, 'Removed' AS kind FROM (SELECT * FROM so EXCEPT SELECT * FROM sn)) UNION ALL (SELECT *, 'Added' FROM (SELECT * FROM sn EXCEPT SELECT * FROM so)))"""


def _section_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    snapshots = load(spark, folder, "summary_snapshots")
    return diff.snapshot_pairs(section_entries(snapshots).select(*_SECTION_KEY), snapshots)


@_query("section_diff", f"WITH {_SQL_SECTION_DELTAS} SELECT * FROM sd")
def section_diff(spark: SparkSession, folder: str) -> DataFrame:
    return diff.section_diff(*_section_pairs(spark, folder), _SECTION_KEY)


_SQL_HEADINGS = """
h AS (SELECT DISTINCT section_id, node_pos, level FROM (
        SELECT section_id, generate_subscripts(nodes, 1)::INT - 1 AS node_pos, unnest(nodes).kind AS kind, unnest(nodes).level AS level FROM sections)
      WHERE kind = 'Heading'),
h2 AS (SELECT section_id, node_pos, level + CASE WHEN node_pos % 3 = 0 THEN 1 ELSE 0 END AS level FROM h WHERE abs(section_id % 5) <> 4
       UNION ALL SELECT section_id, 1000 + node_pos, level FROM h WHERE abs(section_id % 7) = 3)"""
_SQL_HEADING_DIFF = """
SELECT section_id, node_pos, CASE WHEN ia IS NULL THEN 'Added' WHEN ib IS NULL THEN 'Removed' ELSE 'Modified' END AS kind, old_level, new_level,
       CASE WHEN ia = 1 AND ib = 1 THEN 'Heading level changed: H' || old_level || ' → H' || new_level END AS description
FROM (SELECT section_id, node_pos, max(level) AS old_level, 1 AS ia FROM h GROUP BY ALL)
FULL JOIN (SELECT section_id, node_pos, max(level) AS new_level, 1 AS ib FROM h2 GROUP BY ALL) USING (section_id, node_pos)
WHERE ia IS NULL OR ib IS NULL OR old_level IS DISTINCT FROM new_level
"""


def _headings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    old = index.heading_entries(load(spark, folder, "sections")).select("section_id", "node_pos", "level").distinct()
    raised = old.where(F.abs(F.col("section_id") % 5) != 4).withColumn("level", F.col("level") + F.when(F.col("node_pos") % 3 == 0, 1).otherwise(0))
    return old, raised.unionByName(old.where(F.abs(F.col("section_id") % 7) == 3).withColumn("node_pos", F.col("node_pos") + 1000))


@_query("heading_diff", f"WITH {_SQL_HEADINGS} {_SQL_HEADING_DIFF}")
def heading_diff(spark: SparkSession, folder: str) -> DataFrame:
    return diff.heading_diff(*_headings(spark, folder), ["section_id", "node_pos"])


@_query("heading_entries", "SELECT section_id, node_pos, n.node_id AS node_id, n.level AS level, n.text AS text FROM (SELECT section_id, generate_subscripts(nodes, 1)::INT - 1 AS node_pos, unnest(nodes) AS n FROM sections) WHERE n.kind = 'Heading'")
def heading_entries(spark: SparkSession, folder: str) -> DataFrame:
    return index.heading_entries(load(spark, folder, "sections"))


def _report(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.lines(spark, folder)
    old, new = (h.select(F.col("section_id").bitwiseXOR(F.col("node_pos").cast("long")).alias("heading_id"), "level") for h in _headings(spark, folder))
    return diff.diff_documents(_section_pairs(spark, folder), (old, new), (fx.version_a(rows), fx.version_b(rows)), section_key=_SECTION_KEY)


_SQL_REPORT = f"""
WITH {fx.SQL_VERSIONS}, {_SQL_HEADINGS}, {_SQL_SECTION_DELTAS.lstrip()},
p2 AS (SELECT 2 AS pass, CASE WHEN ia IS NULL THEN 'Added' WHEN ib IS NULL THEN 'Removed' ELSE 'Modified' END AS kind, heading_id, old_level, new_level
       FROM (SELECT xor(section_id, node_pos::BIGINT) AS heading_id, max(level) AS old_level, 1 AS ia FROM h GROUP BY 1)
       FULL JOIN (SELECT xor(section_id, node_pos::BIGINT) AS heading_id, max(level) AS new_level, 1 AS ib FROM h2 GROUP BY 1) USING (heading_id)
       WHERE ia IS NULL OR ib IS NULL OR old_level IS DISTINCT FROM new_level),
p3 AS ({_SQL_TABLE_DIFF}),
r AS (SELECT snapshot_no, project_code, id, 1 AS pass, kind, section_id, NULL::BIGINT AS table_id, NULL::INT AS row_idx, NULL::INT AS col_idx, NULL::BIGINT AS heading_id, NULL::DOUBLE AS old_value, NULL::DOUBLE AS new_value, NULL::DOUBLE AS delta, NULL::INT AS old_level, NULL::INT AS new_level FROM sd
      UNION ALL SELECT NULL, NULL, NULL, pass, kind, NULL, NULL, NULL, NULL, heading_id, NULL, NULL, NULL, old_level, new_level FROM p2
      UNION ALL SELECT NULL, NULL, NULL, 3, kind, section_id, table_id, row_idx, col_idx, NULL, old_value, new_value, delta, NULL, NULL FROM p3)
"""


@_query("diff_report", _SQL_REPORT + "SELECT * FROM r")
def diff_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder)


@_query(
    "diff_summary",
    _SQL_REPORT
    + """SELECT count(*) AS total_deltas, count(*) FILTER (kind = 'Added') AS added, count(*) FILTER (kind = 'Removed') AS removed,
       count(*) FILTER (kind = 'Modified' AND pass = 3) AS value_mismatches, count(*) FILTER (kind = 'Modified' AND pass = 2) AS structural_changes, count(*) = 0 AS is_identical FROM r""",
)
def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return diff.diff_summary(_report(spark, folder))


_SQL_ROW_HASH = """
m AS (SELECT section_id, table_id, row_idx, ((section_id::UHUGEINT * 5871781006564002453::UHUGEINT) % 18446744073709551616::UHUGEINT + table_id::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM cells_),
rot AS (SELECT *, ((x * 32::UHUGEINT) % 18446744073709551616::UHUGEINT) + (x // 576460752303423488::UHUGEINT) AS y FROM m)"""


@_query("row_hashes", f"WITH {fx.SQL_LINES}, cells_ AS (SELECT section_id, table_id, row_idx FROM lines), {_SQL_ROW_HASH} SELECT table_id, row_idx, lpad(lower(printf('%x', ((y * 5871781006564002453::UHUGEINT) % 18446744073709551616::UHUGEINT + row_idx::UHUGEINT) % 18446744073709551616::UHUGEINT)), 16, '0') AS row_hash FROM rot".replace("lpad(lower(printf('%x', ", "lpad(lower(hex((").replace(")), 16, '0')", ")::UBIGINT)), 16, '0')"))
def row_hashes(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.lines(spark, folder)
    return rows.select("table_id", "row_idx", hex_padded(row_hash("section_id", "table_id", F.col("row_idx").cast("long"))).alias("row_hash"))


_SQL_HEX = "lower(hex(({})::UBIGINT))"
_SQL_UNSIGNED = "({}::HUGEINT + CASE WHEN {} < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END)::UHUGEINT"
_SQL_U_SECTION, _SQL_U_TABLE, _SQL_U_HEADING = (_SQL_UNSIGNED.format(c, c) for c in ("section_id", "table_id", "heading_id"))


@_query(
    "report_rows",
    _SQL_REPORT
    + f""", x AS (SELECT *, CASE WHEN pass = 3 THEN (({_SQL_U_SECTION} * 5871781006564002453::UHUGEINT) % 18446744073709551616::UHUGEINT + {_SQL_U_TABLE}) % 18446744073709551616::UHUGEINT END AS m FROM r),
y AS (SELECT *, ((((m * 32::UHUGEINT) % 18446744073709551616::UHUGEINT + m // 576460752303423488::UHUGEINT) * 5871781006564002453::UHUGEINT) % 18446744073709551616::UHUGEINT + row_idx::UHUGEINT) % 18446744073709551616::UHUGEINT AS h FROM x),
z AS (SELECT *, CASE WHEN kind = 'Added' THEN ' [NEW]' ELSE '' END AS mark,
      CASE pass WHEN 3 THEN xor(h::UBIGINT, col_idx::UBIGINT) WHEN 2 THEN {_SQL_U_HEADING}::UBIGINT ELSE {_SQL_U_SECTION}::UBIGINT END AS node FROM y)
SELECT snapshot_no, project_code, lpad({_SQL_HEX.format("node")}, 16, '0') AS node_id,
       CASE pass WHEN 1 THEN 'Section ' || {_SQL_HEX.format(_SQL_U_SECTION)} || mark WHEN 2 THEN 'Heading ' || {_SQL_HEX.format(_SQL_U_HEADING)} || mark
       ELSE 'Section ' || {_SQL_U_SECTION}::VARCHAR || ' > Table ' || {_SQL_U_TABLE}::VARCHAR || ' > Row-Hash ' || {_SQL_HEX.format("h")} || ', Col ' || col_idx || mark END AS location,
       kind,
       CASE WHEN kind = 'Modified' AND pass = 3 THEN printf('%.2f', old_value) WHEN kind = 'Modified' AND pass = 2 THEN 'Heading level changed: H' || old_level || ' → H' || new_level END AS old_value,
       CASE WHEN kind = 'Modified' AND pass = 3 THEN printf('%.2f', new_value) END AS new_value
FROM z""",
)
def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    return diff.report_rows(_report(spark, folder), "snapshot_no", "project_code")


@_query("formatted_values", f"WITH {fx.SQL_VERSIONS}, p3 AS ({_SQL_TABLE_DIFF}) SELECT table_id, row_idx, col_idx, printf('%.2f', old_value) AS old_text, printf('%.2f', new_value) AS new_text FROM p3 WHERE kind = 'Modified'")
def formatted_values(spark: SparkSession, folder: str) -> DataFrame:
    return table_diff(spark, folder).where("kind = 'Modified'").select("table_id", "row_idx", "col_idx", two_decimals("old_value").alias("old_text"), two_decimals("new_value").alias("new_text"))


@_query(
    "content_row_diff",
    """
WITH base AS (SELECT DISTINCT table_id, row_pos, cells FROM physical_rows),
v2 AS (SELECT table_id, row_pos, [{'raw_text': c.raw_text, 'numeric_value': CASE WHEN row_pos % 4 = 1 THEN c.numeric_value + 5 ELSE c.numeric_value END} FOR c IN cells] AS cells FROM base WHERE row_pos % 6 <> 5),
k AS (SELECT 1 AS side, * FROM base UNION ALL SELECT 2, * FROM v2),
an AS (SELECT side, table_id, row_pos, cells,
       array_to_string([regexp_replace(lower(coalesce(c.raw_text, '')), '"""
    + _UNICODE_SPACE
    + """+', ' ', 'g') FOR c IN cells IF c.numeric_value IS NULL], chr(31)) AS anchor FROM k),
cp AS (SELECT *, row_number() OVER (PARTITION BY side, table_id, anchor ORDER BY row_pos) AS copy FROM an),
fl AS (SELECT side, table_id, anchor, copy, generate_subscripts(cells, 1)::INT - 1 AS col_idx, unnest(cells).numeric_value AS v FROM cp),
o AS (SELECT table_id, anchor, copy, col_idx, v AS old_value, 1 AS oa FROM fl WHERE side = 1 AND v IS NOT NULL),
n AS (SELECT table_id, anchor, copy, col_idx, v AS new_value, 1 AS ob FROM fl WHERE side = 2 AND v IS NOT NULL)
SELECT table_id, copy, col_idx, CASE WHEN oa IS NULL THEN 'Added' WHEN ob IS NULL THEN 'Removed' ELSE 'Modified' END AS kind, old_value, new_value
FROM o FULL JOIN n USING (table_id, anchor, copy, col_idx)
WHERE oa IS NULL OR ob IS NULL OR abs(old_value - new_value) >= 1.0
""",
)
def content_row_diff(spark: SparkSession, folder: str) -> DataFrame:
    base = load(spark, folder, "physical_rows").select("table_id", "row_pos", "cells").distinct()
    moved = F.transform("cells", lambda c: F.struct(c["raw_text"].alias("raw_text"), (c["numeric_value"] + F.when(F.col("row_pos") % 4 == 1, 5.0).otherwise(0.0)).alias("numeric_value")))
    second = base.where(F.col("row_pos") % 6 != 5).withColumn("cells", moved)
    return diff.content_diff(base, second, ["table_id"]).select("table_id", F.col("copy").cast("long").alias("copy"), "col_idx", "kind", "old_value", "new_value")


@_query(
    "row_numeric_index",
    "SELECT table_id, row_pos AS row_idx, col_idx, v AS numeric_value FROM (SELECT table_id, row_pos, generate_subscripts(cells, 1)::INT - 1 AS col_idx, unnest(cells).numeric_value AS v FROM (SELECT DISTINCT table_id, row_pos, cells FROM physical_rows)) WHERE v IS NOT NULL",
)
def row_numeric_index(spark: SparkSession, folder: str) -> DataFrame:
    return index.numeric_index_of_rows(load(spark, folder, "physical_rows").select("table_id", "row_pos", "cells").distinct(), ["table_id"])


# ---------------------------------------------------------------- scalar functions

_SQL_RAW_NUMBERS = f"""
WITH {fx.SQL_LINES}, p AS (SELECT l_orderkey, row_idx, l_linenumber % 4 AS form, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lines),
d AS (SELECT *, c // 100 AS w, lpad((c % 100)::VARCHAR, 2, '0') AS f FROM p),
g AS (SELECT *, CASE WHEN w >= 1000 THEN (w // 1000)::VARCHAR || '#' || lpad((w % 1000)::VARCHAR, 3, '0') ELSE w::VARCHAR END AS s FROM d),
t AS (SELECT l_orderkey, row_idx, CASE form WHEN 0 THEN replace(s, '#', '.') || ',' || f WHEN 1 THEN replace(s, '#', ',') || '.' || f
      WHEN 2 THEN replace(s, '#', ' ') || ',' || f ELSE '(' || translate(replace(s, '#', '.'), '105', 'lOS') || ',' || f || ')' END AS raw FROM g)
"""


def raw_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Prices written in four noisy forms, from whole cents."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = fx.lines(spark, folder).select("l_orderkey", "row_idx", (F.col("l_linenumber") % 4).alias("form"), cents.alias("c"))
    whole = F.floor(F.col("c") / 100)
    grouped = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("#"), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    cut = F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    form = lambda sep, dec: F.concat(F.translate(grouped, "#", sep), F.lit(dec), cut)
    noisy = F.concat(F.lit("("), F.translate(F.translate(grouped, "#", "."), "105", "lOS"), F.lit(","), cut, F.lit(")"))
    return lines.select("l_orderkey", "row_idx", F.when(F.col("form") == 0, form(".", ",")).when(F.col("form") == 1, form(",", ".")).when(F.col("form") == 2, form(" ", ",")).otherwise(noisy).alias("raw"))


@_query(
    "sanitize_number",
    _SQL_RAW_NUMBERS
    + r"""
, u AS (SELECT *, raw LIKE '(%' AND raw LIKE '%)' OR raw LIKE '-%' AS neg, regexp_replace(translate(regexp_replace(raw, '^[()\[\]-]+|[()\[\]-]+$', '', 'g'), 'lIOoS', '11005'), '[^0-9.,\s]', '', 'g') AS x FROM t),
v AS (SELECT *, CASE WHEN contains(x, ',') AND contains(x, '.') THEN
        CASE WHEN instr(reverse(x), ',') < instr(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END
      WHEN contains(x, ',') THEN CASE WHEN len(string_split(x, ',')) = 2 AND strlen(string_split(x, ',')[-1]) <= 2 THEN replace(x, ',', '.') ELSE replace(x, ',', '') END
      WHEN contains(x, '.') THEN CASE WHEN len(string_split(x, '.')) = 2 AND strlen(string_split(x, '.')[-1]) <= 2 THEN x ELSE replace(x, '.', '') END
      ELSE x END AS y FROM u)
SELECT l_orderkey, row_idx, raw, CASE WHEN neg THEN -TRY_CAST(replace(y, ' ', '') AS DOUBLE) ELSE TRY_CAST(replace(y, ' ', '') AS DOUBLE) END + 0.0 AS value FROM v
""",
)
def sanitize(spark: SparkSession, folder: str) -> DataFrame:
    return raw_numbers(spark, folder).select("l_orderkey", "row_idx", "raw", (sanitize_number(F.col("raw")) + 0.0).alias("value"))


_SOURCE, _TARGET = accent_pairs()


@_query(
    "normalize_header",
    f"""SELECT DISTINCT name, regexp_replace(translate(lower(regexp_replace(name, '^{_UNICODE_SPACE}+|{_UNICODE_SPACE}+$', '', 'g')), '{_SOURCE}', '{_TARGET}'), '{_UNICODE_SPACE}+', '_', 'g') AS header
FROM (SELECT unnest(columns).name AS name FROM extracted_tables) WHERE name IS NOT NULL""",
)
def headers(spark: SparkSession, folder: str) -> DataFrame:
    names = load(spark, folder, "extracted_tables").select(F.explode("columns").alias("c")).select(F.col("c.name").alias("name")).where("name IS NOT NULL").distinct()
    return names.withColumn("header", normalize_header(F.col("name")))


@_query("normalize_number", f"WITH {fx.SQL_LINES} SELECT table_id, row_idx, round(l_discount * l_tax * 1000) / 1000 AS value FROM lines")
def numbers(spark: SparkSession, folder: str) -> DataFrame:
    return fx.lines(spark, folder).select("table_id", "row_idx", normalize_number(F.col("l_discount") * F.col("l_tax")).alias("value"))


@_query(
    "normalize_unit_null",
    f"""WITH t AS (SELECT DISTINCT s AS raw, regexp_replace(s, '^{_UNICODE_SPACE}+|{_UNICODE_SPACE}+$', '', 'g') AS x FROM cells WHERE s IS NOT NULL)
SELECT raw, CASE lower(x) WHEN 'm2' THEN 'm²' WHEN 'mét vuông' THEN 'm²' WHEN 'm3' THEN 'm³' WHEN 'mét khối' THEN 'm³' WHEN 'cái' THEN 'cái' WHEN 'bộ' THEN 'bộ' WHEN 'kg' THEN 'kg' WHEN 'tan' THEN 'tấn' WHEN 'tấn' THEN 'tấn' END AS unit,
       CASE WHEN x IN ('', '-') THEN 'Null' WHEN x = '0' THEN 'Float' ELSE 'Text' END AS tag, CASE WHEN x = '0' THEN 0.0::DOUBLE END AS f, CASE WHEN x NOT IN ('', '-', '0') THEN x END AS s FROM t""",
)
def units_and_nulls(spark: SparkSession, folder: str) -> DataFrame:
    raw = load(spark, folder, "cells").where("s IS NOT NULL").select(F.col("s").alias("raw")).distinct()
    return raw.select("raw", normalize_unit(F.col("raw")).alias("unit"), normalize_null(F.col("raw")).alias("v")).select("raw", "unit", "v.*")


@_query(
    "scalar_functions",
    r"""SELECT DISTINCT source_path, regexp_extract(source_path, '([^/\\]*)$', 1) AS file_name, lower(regexp_extract(regexp_extract(source_path, '([^/\\]*)$', 1), '[^.]\.([^.]*)$', 1)) AS extension,
round(100.0 * total_pages / (total_pages + 3)) AS progress, id || '_' || total_pages || '_0' AS cell_id
FROM document_summary WHERE source_path IS NOT NULL AND total_pages IS NOT NULL""",
)
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "document_summary").where("source_path IS NOT NULL AND total_pages IS NOT NULL")
    path = F.col("source_path")
    return docs.select("source_path", file_name(path).alias("file_name"), extension(path).alias("extension"), progress_percent(F.col("total_pages"), F.col("total_pages") + 3).alias("progress"), global_id(F.col("id"), F.col("total_pages"), F.lit(0)).alias("cell_id")).distinct()


@_query("unknown_characters", "SELECT DISTINCT global_id, (length(source_text) - length(replace(source_text, '�', ''))) / length(source_text) AS share FROM cells WHERE length(source_text) > 0 AND (length(source_text) - length(replace(source_text, '�', ''))) / length(source_text) > 0.01")
def unknown_characters(spark: SparkSession, folder: str) -> DataFrame:
    cells = load(spark, folder, "cells").select("global_id", unknown_share(F.col("source_text")).alias("share"))
    return cells.where("share > 0.01").distinct()


# ---------------------------------------------------------------- headers

_SQL_NAMES = "n AS (SELECT DISTINCT table_id, generate_subscripts(columns, 1)::INT - 1 AS col_pos, unnest(columns).name AS name FROM (SELECT DISTINCT table_id, columns FROM extracted_tables))"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    tables = load(spark, folder, "extracted_tables").select("table_id", "columns").distinct()
    return tables.select("table_id", F.posexplode("columns").alias("col_pos", "c")).select("table_id", "col_pos", F.col("c.name").alias("name"))


@_query(
    "sniff_header",
    f"""WITH r AS (SELECT DISTINCT table_id, row_pos, cells FROM physical_rows WHERE row_pos < 20),
s AS (SELECT table_id, row_pos, len([1 FOR c IN cells IF c.numeric_value IS NOT NULL]) AS numbers, len([1 FOR c IN cells IF coalesce(regexp_replace(c.raw_text, '{_UNICODE_SPACE}+', '', 'g'), '') <> '']) AS filled, len(cells) AS k FROM r),
q AS (SELECT *, CASE WHEN numbers > 0.7 * k THEN 0 ELSE filled - numbers END AS score FROM s)
SELECT table_id, row_pos AS header_row, score FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, row_pos) AS rn FROM q) WHERE rn = 1""",
)
def sniff_header(spark: SparkSession, folder: str) -> DataFrame:
    found = header_ops.sniff_header(load(spark, folder, "physical_rows").select("table_id", "row_pos", "cells").distinct())
    return found.withColumn("score", F.col("score").cast("long"))


_WANTED = ["khoi_luong", "don_vi", "hang_muc", "thanh_tien", "ghi_chu", "ngay_lap"]
_SQL_HEADER = f"""regexp_replace(translate(lower(regexp_replace(name, '^{_UNICODE_SPACE}+|{_UNICODE_SPACE}+$', '', 'g')), '{_SOURCE}', '{_TARGET}'), '{_UNICODE_SPACE}+', '_', 'g')"""


_FOLD_FROM, _FOLD_TO = (x.replace("'", "''") for x in fold_pairs())
_SQL_FOLDED = f"trim(regexp_replace(lower(translate(regexp_replace(name, '[\\x{{300}}-\\x{{36F}}{ignorable_class()}]', '', 'g'), '{_FOLD_FROM}', '{_FOLD_TO}')), '\\s+', ' ', 'g'))"


@_query(
    "fuzzy_headers",
    f"""WITH {_SQL_NAMES}, h AS (SELECT DISTINCT name, replace({_SQL_FOLDED}, ' ', '_') AS header FROM n WHERE name IS NOT NULL),
p AS (SELECT name, w AS "match", jaro_winkler_similarity(header, w) AS similarity FROM h, unnest({_WANTED!r}) t(w))
SELECT name, "match", round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(similarity, 9) DESC, "match" DESC) AS rn FROM p WHERE similarity >= 0.85) WHERE rn = 1""",
)
def fuzzy_headers(spark: SparkSession, folder: str) -> DataFrame:
    return header_ops.matched_headers(_names(spark, folder), _WANTED).withColumn("similarity", F.round("similarity", 9))


@_query(
    "merged_headers",
    f"""WITH {_SQL_NAMES}, e AS (SELECT table_id, col_pos, CASE WHEN col_pos % 3 = 0 THEN name ELSE '' END AS name FROM n),
m AS (SELECT *, CASE WHEN regexp_replace(name, '{_UNICODE_SPACE}+', '', 'g') <> '' THEN name END AS own FROM e),
b AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS base, count(own) OVER w AS part FROM m WINDOW w AS (PARTITION BY table_id ORDER BY col_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY table_id, part ORDER BY col_pos) - 1 AS i FROM b)
SELECT table_id, col_pos, CASE WHEN base IS NULL THEN '' WHEN i = 0 THEN base WHEN i = 1 THEN base || '_sub' ELSE base || '_sub_' || i END AS filled FROM k""",
)
def merged_headers(spark: SparkSession, folder: str) -> DataFrame:
    return header_ops.fill_merged(_names(spark, folder).withColumn("name", F.when(F.col("col_pos") % 3 == 0, F.col("name")).otherwise("")))


def _sql_canonical(header: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains({header}, '{p}')" if len(p) > 2 else f"{header} = '{p}'" for p in parts)} THEN '{name}'" for name, parts in header_ops.ALIASES.items()) + " END"


@_query("canonical_columns", f"WITH {_SQL_NAMES}, h AS (SELECT DISTINCT name, {_SQL_HEADER} AS header FROM n) SELECT name, {_sql_canonical('header')} AS canonical FROM h")
def canonical_columns(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder).select("name").distinct()
    return names.withColumn("canonical", header_ops.canonical_column(normalize_header(F.col("name"))))


@_query(
    "without_footers",
    f"""SELECT DISTINCT table_id, row_pos, len(cells) AS n FROM physical_rows
WHERE len([1 FOR c IN cells IF coalesce(regexp_matches(lower(c.raw_text), '{"|".join(p.lower() for p in header_ops.FOOTERS)}'), false)]) = 0""",
)
def without_footers(spark: SparkSession, folder: str) -> DataFrame:
    return header_ops.without_footers(load(spark, folder, "physical_rows").where("cells IS NOT NULL")).select("table_id", "row_pos", F.size("cells").cast("long").alias("n")).distinct()


# ---------------------------------------------------------------- truth tables

_SQL_TRUTH = """
t AS (SELECT table_id, any_value(project_code) AS project_code, any_value(columns) AS columns FROM extracted_tables GROUP BY table_id),
n AS (SELECT table_id, project_code, generate_subscripts(columns, 1)::INT - 1 AS col_pos, unnest(columns).name AS metric FROM t),
c AS (SELECT DISTINCT table_id, row_pos, col_pos, tag, f FROM cells WHERE tag = 'Float' AND f IS NOT NULL),
li AS (SELECT project_code, metric, c.table_id, row_pos, col_pos, f AS contribution FROM c JOIN n USING (table_id, col_pos) WHERE metric IN ('total_cost', 'total_paid', 'budget', 'actual'))
"""


def _truth_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tables = load(spark, folder, "extracted_tables").groupBy("table_id").agg(F.any_value("project_code").alias("project_code"), F.any_value("columns").alias("columns"))
    cells = load(spark, folder, "cells").select("table_id", "row_pos", "col_pos", "tag", "f").distinct()
    return cells, tables


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    cells, tables = _truth_inputs(spark, folder)
    return truth.contributions(cells, tables, []).join(tables.select("table_id", "project_code"), "table_id")


@_query("lineage", f"WITH {_SQL_TRUTH} SELECT * FROM li")
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    return _lineage(spark, folder)


@_query(
    "project_truth",
    f"""WITH {_SQL_TRUTH}, s AS (SELECT project_code, {", ".join(f"coalesce(sum(contribution) FILTER (metric = '{m}'), 0.0) AS {m}" for m in truth.METRICS)} FROM li GROUP BY project_code),
d AS (SELECT *, total_cost - total_paid AS remaining, actual - budget AS deviation, CASE WHEN budget <> 0 THEN (actual - budget) / budget * 100 ELSE 0.0 END AS percentage FROM s)
SELECT project_code, {", ".join(f"round({c}, 4) AS {c}" for c in (*truth.METRICS, "remaining", "deviation", "percentage"))},
       CASE WHEN percentage < 5 THEN 'SAFE' WHEN percentage < 15 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM d""",
)
def project_truth(spark: SparkSession, folder: str) -> DataFrame:
    rolled = truth.rollup(_lineage(spark, folder), ["project_code"])
    return rolled.select("project_code", *(F.round(c, 4).alias(c) for c in (*truth.METRICS, "remaining", "deviation", "percentage")), "status")


@_query("table_counts", "SELECT t.project_code, count(DISTINCT r.table_id) AS table_count, count(*) AS row_count FROM (SELECT DISTINCT table_id, row_pos FROM cells) r JOIN (SELECT table_id, any_value(project_code) AS project_code FROM extracted_tables GROUP BY 1) t USING (table_id) GROUP BY 1")
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    cells, tables = _truth_inputs(spark, folder)
    rows = cells.select("table_id", "row_pos").distinct().join(tables.select("table_id", "project_code"), "table_id")
    return truth.table_counts(rows, ["project_code"])


@_query(
    "validate_contract",
    """
WITH t AS (SELECT table_id, any_value(row_count) AS row_count, any_value(col_count) AS col_count, any_value(columns) AS columns FROM extracted_tables GROUP BY 1),
hd AS (SELECT table_id, -1 AS row_pos, -1 AS col_pos,
  CASE WHEN row_count > 10000 THEN 0 WHEN col_count > 100 THEN 1 WHEN row_count < 2 THEN 2 WHEN len(columns) <> col_count THEN 3 END AS chk,
  CASE WHEN row_count > 10000 OR col_count > 100 OR row_count < 2 THEN 'SizeViolation' ELSE 'ContractViolation' END AS rejection FROM t),
c AS (SELECT DISTINCT table_id, row_pos, col_pos, col_idx, tag, confidence, encoding_status FROM cells),
b AS (SELECT c.*, t.col_count, CASE WHEN tag <> 'Null' AND confidence < 0.7::FLOAT THEN 'LowConfidence' WHEN encoding_status = 'Invalid' THEN 'EncodingCorruption'
      WHEN encoding_status = 'Suspicious' AND coalesce(t.columns[col_idx + 1].is_critical, false) THEN 'EncodingCorruption' END AS bad FROM c JOIN t USING (table_id)),
r AS (SELECT table_id, row_pos, count(*) AS n, max(col_count) AS col_count, min({'p': col_pos, 'b': bad}) FILTER (bad IS NOT NULL) AS worst FROM b GROUP BY 1, 2),
f AS (SELECT table_id, chk, row_pos, col_pos, rejection FROM hd WHERE chk IS NOT NULL
      UNION ALL SELECT table_id, 4, row_pos, CASE WHEN n <> col_count THEN -1 ELSE worst.p END, CASE WHEN n <> col_count THEN 'ContractViolation' ELSE worst.b END FROM r WHERE n <> col_count OR worst IS NOT NULL)
SELECT table_id, rejection, row_pos, col_pos FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY chk, row_pos, col_pos, rejection) AS rn FROM f) WHERE rn = 1
""",
)
def validate_contract(spark: SparkSession, folder: str) -> DataFrame:
    tables = load(spark, folder, "extracted_tables").groupBy("table_id").agg(*(F.any_value(c).alias(c) for c in ("row_count", "col_count", "columns")))
    cells = load(spark, folder, "cells").select("table_id", "row_pos", "col_pos", "col_idx", "tag", "confidence", "encoding_status").distinct()
    return validate.validate_contract(tables, cells)


_SQL_FACTS = "f AS (SELECT l_orderkey, sum(l_quantity) AS total_cost, sum(l_quantity * (l_linenumber % 2)) AS total_paid, sum(l_quantity * (1 - l_linenumber % 2)) + CASE WHEN l_orderkey % 10 = 0 THEN 1.0 WHEN l_orderkey % 10 = 1 THEN 2.0 ELSE 0.0 END AS remaining FROM lineitem GROUP BY l_orderkey)"


@_query("verdict_r01", f"WITH {_SQL_FACTS} SELECT l_orderkey, 'MathError' AS violation, 3 AS severity, remaining AS found, total_cost - total_paid AS expected FROM f WHERE abs(remaining - (total_cost - total_paid)) > 1.0")
def verdict_r01(spark: SparkSession, folder: str) -> DataFrame:
    return validate.verdict_remaining(_facts(spark, folder), "l_orderkey")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    odd = F.col("l_linenumber") % 2
    facts = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total_cost"), F.sum(F.col("l_quantity") * odd).alias("total_paid"), F.sum(F.col("l_quantity") * (1 - odd)).alias("rest"))
    extra = F.when(F.col("l_orderkey") % 10 == 0, 1.0).when(F.col("l_orderkey") % 10 == 1, 2.0).otherwise(0.0)
    return facts.withColumn("remaining", F.col("rest") + extra)


@_query(
    "verdict_r05",
    f"""WITH {fx.SQL_VERSIONS} SELECT a.table_id, a.row_idx AS row_pos, a.col_idx AS col_pos, a.numeric_value AS "primary", b.numeric_value AS secondary, 'Mismatch' AS violation, 3 AS severity,
'Row ' || a.row_idx || ', Col ' || a.col_idx AS technical_ref FROM a JOIN b USING (section_id, table_id, row_idx, col_idx) WHERE abs(a.numeric_value - b.numeric_value) > 1.0""",
)
def verdict_r05(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.lines(spark, folder)
    shaped = lambda df: df.select("section_id", "table_id", F.col("row_idx").alias("row_pos"), F.col("col_idx").alias("col_pos"), F.lit("Float").alias("tag"), F.col("numeric_value").alias("f"))
    return validate.verdict_cross_source(shaped(fx.version_a(rows)), shaped(fx.version_b(rows)), ["section_id", "table_id"]).drop("section_id")


_SQL_NUMBER = "regexp_replace(({})::VARCHAR, '\\.0$', '')"


@_query(
    "verify",
    f"""WITH {fx.SQL_VERSIONS}, {_SQL_FACTS},
pa AS (SELECT *, dense_rank() OVER (PARTITION BY section_id, table_id ORDER BY row_idx) - 1 AS row_pos FROM a),
pb AS (SELECT *, dense_rank() OVER (PARTITION BY section_id, table_id ORDER BY row_idx) - 1 AS row_pos FROM b),
c AS (SELECT section_id, table_id, row_pos, col_idx, pa.row_idx AS row_idx, pa.numeric_value AS x, pb.numeric_value AS y FROM pa JOIN pb USING (section_id, table_id, row_pos, col_idx))
SELECT 'R01' AS rule, l_orderkey::VARCHAR AS subject, 'MathError' AS violation, 3 AS severity,
       'Calculated remaining ' || {_SQL_NUMBER.format("total_cost - total_paid")} || ', reported ' || {_SQL_NUMBER.format("remaining")} || ', off by ' || {_SQL_NUMBER.format("abs(remaining - (total_cost - total_paid))")} AS message,
       'ProjectTruth::Financials' AS technical_ref, NULL AS evidence_id
FROM f WHERE abs(remaining - (total_cost - total_paid)) > 1.0
UNION ALL
SELECT 'R05', section_id || '/' || table_id, 'Mismatch', 3,
       'Source A ' || {_SQL_NUMBER.format("x")} || ', source B ' || {_SQL_NUMBER.format("y")} || ', off by ' || {_SQL_NUMBER.format("abs(x - y)")},
       'Row ' || row_pos || ', Col ' || col_idx, table_id || '_' || row_idx || '_' || col_idx
FROM c WHERE abs(x - y) > 1.0""",
)
def verify(spark: SparkSession, folder: str) -> DataFrame:
    """The second source lacks some first rows, so rows stand at other positions than their labels say."""
    rows = fx.lines(spark, folder)
    position = F.dense_rank().over(Window.partitionBy("section_id", "table_id").orderBy("row_idx")) - 1

    def placed(df: DataFrame) -> DataFrame:
        label = F.concat_ws("_", "table_id", "row_idx", "col_idx")
        return df.select("section_id", "table_id", position.alias("row_pos"), F.col("col_idx").alias("col_pos"), F.lit("Float").alias("tag"), F.col("numeric_value").alias("f"), label.alias("global_id"))

    return validate.verify(_facts(spark, folder), "l_orderkey", placed(fx.version_a(rows)), placed(fx.version_b(rows)), ["section_id", "table_id"])


_SQL_CELL_VERDICTS = """
c AS (SELECT DISTINCT table_id, row_pos, col_pos, global_id, encoding_status, tag, f FROM cells),
v AS (SELECT table_id, row_pos, col_pos, global_id, 'LineageMissing' AS violation, 3 AS severity FROM c WHERE global_id IS NULL OR global_id = ''
  UNION ALL SELECT table_id, row_pos, col_pos, global_id, 'EncodingFlag', 2 FROM c WHERE encoding_status IN ('Suspicious', 'Invalid')
  UNION ALL SELECT table_id, row_pos, col_pos, global_id, 'NegativeValue', 3 FROM c WHERE tag = 'Float' AND f < 0)"""


def _cell_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return validate.verdict_cells(load(spark, folder, "cells").select("table_id", "row_pos", "col_pos", "global_id", "encoding_status", "tag", "f").distinct())


@_query("verdict_cells", f"WITH {_SQL_CELL_VERDICTS} SELECT * FROM v")
def verdict_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _cell_verdicts(spark, folder)


@_query("verdict_totals", f"WITH {_SQL_CELL_VERDICTS} SELECT table_id, count(*) AS violations, max(severity) AS gravest, max(severity) >= 3 AS invalid FROM v GROUP BY 1")
def verdict_totals(spark: SparkSession, folder: str) -> DataFrame:
    return validate.verdict_totals(_cell_verdicts(spark, folder))


# ---------------------------------------------------------------- rules


def _rule_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One table per order: quantity in column 0, line number in column 1, flag in column 2."""
    rows = fx.lines(spark, folder)
    value = lambda tag, i=None, f=None, s=None: F.struct(F.lit(tag).alias("tag"), (F.lit(None) if i is None else i).cast("bigint").alias("i"), (F.lit(None) if f is None else f).cast("double").alias("f"), (F.lit(None) if s is None else s).cast("string").alias("s"), F.lit(None).cast("date").alias("d"))
    cells = F.array(value("Float", f=F.col("l_quantity")), value("Int", i=F.col("l_linenumber")), value("Text", s=F.col("l_returnflag")))
    placed = rows.select(F.col("table_id").cast("string").alias("table_id"), F.col("row_idx").alias("row_pos"), "row_idx", F.posexplode(cells).alias("col_pos", "v"))
    return placed.select("table_id", "row_pos", "row_idx", "col_pos", F.col("col_pos").alias("col_idx"), "v.*")


def _sum_targets(spark: SparkSession, folder: str) -> DataFrame:
    """A table of one cell per order with its quantity sum, one too many for every tenth order."""
    sums = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return sums.select(F.concat(F.lit("sum_"), "l_orderkey").alias("table_id"), F.lit(0).alias("row_pos"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_pos"), F.lit(0).alias("col_idx"), F.lit("Float").alias("tag"), F.lit(None).cast("bigint").alias("i"), (F.col("q") + F.when(F.col("l_orderkey") % 10 == 0, 1.0).otherwise(0.0)).alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("date").alias("d"))


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders").select("o_orderkey")
    sums = orders.select(F.col("o_orderkey").cast("int").alias("rule_ord"), F.lit("SumMatch").alias("rule_type"), F.col("o_orderkey").cast("string").alias("src_table"), F.lit(0).alias("src_row"), F.lit(0).alias("src_col"), F.concat(F.lit("sum_"), "o_orderkey").alias("tgt_table"), F.lit(0).alias("tgt_row"), F.lit(0).alias("tgt_col"))
    same = orders.select((-F.col("o_orderkey")).cast("int").alias("rule_ord"), F.lit("ExactMatch").alias("rule_type"), F.col("o_orderkey").cast("string").alias("src_table"), F.lit(0).alias("src_row"), F.lit(2).alias("src_col"), F.col("o_orderkey").cast("string").alias("tgt_table"), F.lit(1).alias("tgt_row"), F.lit(2).alias("tgt_col"))
    return sums.unionByName(same)


_SQL_SUM_MATCH = """
sm AS (SELECT o_orderkey::INT AS rule_ord, CASE WHEN q IS NULL THEN 'MissingTable' WHEN o_orderkey % 10 = 0 THEN 'ConsistencyViolation' END AS rejection, coalesce(q, 0.0) AS source_sum,
       CASE WHEN q IS NOT NULL THEN q + CASE WHEN o_orderkey % 10 = 0 THEN 1.0 ELSE 0.0 END END AS target_value
       FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_SQL_EXACT = """
em AS (SELECT (-o_orderkey)::INT AS rule_ord, CASE WHEN f0 IS NULL THEN 'MissingTable' WHEN f1 IS NULL THEN 'MissingReference' WHEN f0 <> f1 THEN 'ConsistencyViolation' END AS rejection
       FROM orders LEFT JOIN (SELECT table_id, max(l_returnflag) FILTER (row_idx = 0) AS f0, max(l_returnflag) FILTER (row_idx = 1) AS f1 FROM lines GROUP BY 1) ON table_id = o_orderkey)"""


@_query("rule_sum_match", f"WITH {_SQL_SUM_MATCH} SELECT * FROM sm WHERE rejection IS NOT NULL")
def rule_sum_match(spark: SparkSession, folder: str) -> DataFrame:
    return rules.sum_match(_rules(spark, folder), _rule_cells(spark, folder).unionByName(_sum_targets(spark, folder)))


@_query("rule_exact_match", f"WITH {fx.SQL_LINES}, {_SQL_EXACT} SELECT * FROM em WHERE rejection IS NOT NULL")
def rule_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    return rules.exact_match(_rules(spark, folder), _rule_cells(spark, folder))


@_query(
    "rule_edge_cases",
    """WITH o AS (SELECT o_orderkey AS k, q, n FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT (k * 10)::BIGINT AS rule_ord, CASE WHEN n IS NULL THEN 'MissingTable' WHEN n > 1 THEN 'TypeMismatch' ELSE 'ConsistencyViolation' END AS rejection FROM o
UNION ALL SELECT k * 10 + 1, CASE WHEN n IS NULL THEN 'MissingTable' ELSE 'TypeMismatch' END FROM o
UNION ALL SELECT k * 10 + 2, CASE WHEN n IS NULL THEN 'MissingTable' WHEN n <= 7 THEN 'MissingReference' ELSE 'ConsistencyViolation' END FROM o
UNION ALL SELECT k * 10 + 3, CASE WHEN n IS NULL THEN 'MissingTable' ELSE 'MissingReference' END FROM o
UNION ALL SELECT k * 10 + 4, 'MissingTable' FROM o""",
)
def rule_edge_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Sum rules over a column of texts, into a text, into a missing row, a missing column and from a missing table."""
    key, own = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    target = F.concat(F.lit("sum_"), own)
    cases = [(own, 2, target, 0, 0), (own, 0, own, 0, 2), (own, 0, own, 7, 0), (own, 0, own, 0, 9), (F.lit("none"), 0, target, 0, 0)]
    each = F.array(*(F.struct((key * 10 + n).alias("rule_ord"), F.lit("SumMatch").alias("rule_type"), a.alias("src_table"), F.lit(0).alias("src_row"), F.lit(c).alias("src_col"), b.alias("tgt_table"), F.lit(r).alias("tgt_row"), F.lit(d).alias("tgt_col")) for n, (a, c, b, r, d) in enumerate(cases)))
    wanted = load(spark, folder, "orders").select(F.explode(each).alias("r")).select("r.*")
    return rules.sum_match(wanted, _rule_cells(spark, folder).unionByName(_sum_targets(spark, folder))).select("rule_ord", "rejection")


def _relations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = load(spark, folder, "orders")
    relations = orders.select(F.col("o_orderkey").cast("int").alias("rel_ord"), F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("o"), "o_orderkey").alias("to_id"), F.lit("PARENT_OF").alias("kind"))
    tables = load(spark, folder, "customer").where("c_custkey % 9 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("table_id")).unionByName(orders.where("o_orderkey % 8 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("table_id")))
    return relations, tables


_SQL_RELATIONS = """
ri AS (SELECT o_orderkey::INT AS rel_ord, CASE WHEN c_custkey IS NULL OR c_custkey % 9 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 8 = 0 THEN 'o' || o_orderkey END AS missing_id
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


@_query("relation_integrity", f"WITH {_SQL_RELATIONS} SELECT * FROM ri WHERE missing_id IS NOT NULL")
def relation_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return rules.relation_integrity(*_relations(spark, folder))


@_query(
    "validate_project",
    f"""WITH {fx.SQL_LINES}, {_SQL_SUM_MATCH}, {_SQL_EXACT}, {_SQL_RELATIONS}, f AS (
SELECT 0 AS part, rule_ord AS ord, rejection FROM em WHERE rejection IS NOT NULL UNION ALL SELECT 0, rule_ord, rejection FROM sm WHERE rejection IS NOT NULL
UNION ALL SELECT 1, rel_ord, 'MissingTable' FROM ri WHERE missing_id IS NOT NULL)
SELECT part, ord, rejection, row_number() OVER (ORDER BY part, ord) = 1 AS is_first FROM f""",
)
def validate_project(spark: SparkSession, folder: str) -> DataFrame:
    cells = _rule_cells(spark, folder).unionByName(_sum_targets(spark, folder))
    return rules.validate_project(_rules(spark, folder), *(_relations(spark, folder)[0], cells, _relations(spark, folder)[1]))


# ---------------------------------------------------------------- layout

_SQL_ELEMENTS = f"""{fx.SQL_LINES}, el AS (
  SELECT l_orderkey AS page_id, row_idx, k AS col, 100 * k AS x0, 100 * k + 40 + l_linenumber AS x1, 20 * row_idx + l_partkey % 5 AS y0 FROM lines, (VALUES (0), (1), (2), (3)) v(k))"""


@_query(
    "column_boundaries",
    f"""WITH {_SQL_ELEMENTS}, m AS (SELECT page_id, x0, max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS gap_start FROM el)
SELECT DISTINCT page_id, (gap_start + x0) / 2.0 AS boundary FROM m WHERE x0 - gap_start > 5""",
)
def column_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return layout.column_boundaries(fx.text_elements(fx.lines(spark, folder)))


@_query("density_histogram", f"WITH {_SQL_ELEMENTS} SELECT page_id, x, count(*) AS ink FROM (SELECT page_id, unnest(generate_series(x0::BIGINT, x1::BIGINT)) AS x FROM el) GROUP BY 1, 2")
def density_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return layout.density_histogram(fx.text_elements(fx.lines(spark, folder)))


@_query("row_snap", f"WITH {_SQL_ELEMENTS} SELECT page_id, row_idx AS row_no, col AS place, row_idx * 4 + col AS seq FROM el")
def row_snap(spark: SparkSession, folder: str) -> DataFrame:
    return layout.snap_rows(fx.text_elements(fx.lines(spark, folder))).select("page_id", "row_no", "place", "seq")


_TRIM = f"'^{_UNICODE_SPACE}+|{_UNICODE_SPACE}+$', '', 'g'"


@_query(
    "row_cohesion",
    f"""
WITH b AS (SELECT DISTINCT table_id, row_pos, row_type, [CASE WHEN (row_pos % 3) = 0 THEN c ELSE {{'raw_text': c.raw_text, 'numeric_value': NULL}} END FOR c IN cells] AS cells FROM physical_rows),
h AS (SELECT *, len([1 FOR c IN cells IF c.numeric_value IS NOT NULL]) > 0 AS has_n, row_number() OVER (PARTITION BY table_id ORDER BY row_pos) = 1 AS is1 FROM b),
s AS (SELECT *, sum(CASE WHEN has_n OR is1 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_pos) AS part FROM h),
t AS (SELECT *, row_number() OVER (PARTITION BY table_id, part ORDER BY row_pos) = 1
        OR coalesce(sum(CASE WHEN row_type = 'Data' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, part ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS starts FROM s),
g AS (SELECT *, (sum(starts::INT) OVER (PARTITION BY table_id ORDER BY row_pos) - 1)::BIGINT AS row_no FROM t),
p AS (SELECT table_id, row_no, min(row_pos) AS row_pos, arg_min(row_type, row_pos) AS row_type, arg_min(cells, row_pos) AS cells, count(*) AS members FROM g GROUP BY 1, 2),
c AS (SELECT table_id, row_no, row_pos AS rp, generate_subscripts(cells, 1) AS k, unnest(cells) AS cell FROM g),
j AS (SELECT c.table_id, c.row_no, k,
        string_agg(CASE WHEN regexp_replace(cell.raw_text, {_TRIM}) <> '' THEN regexp_replace(cell.raw_text, {_TRIM}) END, ' ' ORDER BY rp) AS joined,
        count(*) FILTER (rp > p.row_pos AND regexp_replace(cell.raw_text, {_TRIM}) <> '') AS more, arg_min(cell.raw_text, rp) AS own
      FROM c JOIN p USING (table_id, row_no) WHERE k <= len(p.cells) GROUP BY 1, 2, 3)
SELECT table_id, row_no, row_pos, row_type, string_agg(CASE WHEN more > 0 THEN joined ELSE coalesce(own, '') END, chr(31) ORDER BY k) AS texts
FROM j JOIN p USING (table_id, row_no) GROUP BY 1, 2, 3, 4
""",
)
def row_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "physical_rows").select("table_id", "row_pos", "row_type", "cells")
    # two rows of three lose their numbers, so that all kinds of sequences occur
    blank = F.transform("cells", lambda c: F.struct(c["raw_text"].alias("raw_text"), F.when(F.col("row_pos") % 3 == 0, c["numeric_value"]).alias("numeric_value")))
    merged = layout.merge_broken_rows(rows.withColumn("cells", blank).distinct())
    return merged.where(F.size("cells") > 0).select("table_id", F.col("row_no").cast("long").alias("row_no"), "row_pos", "row_type", F.array_join(F.transform("cells", lambda c: F.coalesce(c["raw_text"], F.lit(""))), "\u001f").alias("texts"))


# ---------------------------------------------------------------- export, sources, streaming

_SQL_NODE_MD = f"""CASE WHEN n.kind = 'Heading' THEN repeat('#', coalesce(n.level, 1)) || ' ' || coalesce(n.text, '') || chr(10) || chr(10)
 WHEN n.kind = 'Paragraph' AND regexp_replace(coalesce(n.text, ''), {_TRIM}) <> '' THEN regexp_replace(n.text, {_TRIM}) || chr(10) || chr(10)
 WHEN n.kind = 'Table' AND regexp_replace(coalesce(n.text, ''), {_TRIM}) <> '' THEN n.text || chr(10) || chr(10) ELSE '' END"""


@_query(
    "export_markdown",
    f"""WITH s AS (SELECT summary_id, section_id, arg_max(section_pos, loaded_at) AS section_pos, arg_max(coalesce(title, chr(0)), loaded_at) AS title, arg_max(level, loaded_at) AS level, arg_max(nodes, loaded_at) AS nodes FROM sections GROUP BY 1, 2),
m AS (SELECT summary_id, section_id, section_pos, repeat('#', coalesce(level, 1)) || ' ' || replace(title, chr(0), '') || chr(10) || chr(10) || array_to_string([{_SQL_NODE_MD} FOR n IN nodes], '') AS md FROM s)
SELECT summary_id, md5(string_agg(md, '' ORDER BY section_pos, section_id)) AS md5 FROM m GROUP BY 1""",
)
def export_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return export.document_markdown(load(spark, folder, "sections")).select("summary_id", F.md5("markdown").alias("md5"))


@_query(
    "table_markdown",
    """WITH r AS (SELECT DISTINCT table_id, row_pos, CASE WHEN row_pos = 0 THEN 'Header' ELSE row_type END AS row_type, cells FROM physical_rows),
m AS (SELECT table_id, row_pos, '|' || array_to_string([' ' || coalesce(c.raw_text, '') || ' |' FOR c IN cells], '') || chr(10) || CASE WHEN row_type = 'Header' THEN '|' || repeat('---|', len(cells)) || chr(10) ELSE '' END AS md FROM r WHERE len(cells) > 0)
SELECT table_id, md5(string_agg(md, '' ORDER BY row_pos)) AS md5 FROM m GROUP BY 1""",
)
def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "physical_rows").select("table_id", "row_pos", F.when(F.col("row_pos") == 0, "Header").otherwise(F.col("row_type")).alias("row_type"), "cells").distinct()
    return export.table_markdown(rows).select("table_id", F.md5("markdown").alias("md5"))


_SQL_NODES = """
s AS (SELECT DISTINCT summary_id, section_pos, section_id, nodes FROM sections),
nd AS (SELECT summary_id, section_pos * 1000000 + generate_subscripts(nodes, 1) AS pos, unnest(nodes).kind AS kind, unnest(nodes).level AS level, unnest(nodes).text AS text FROM s WHERE section_pos IS NOT NULL),
q AS (SELECT *, coalesce(kind = 'Heading', false) AS is_end FROM nd)"""


@_query(
    "built_lines",
    f"""WITH {_SQL_NODES}
SELECT summary_id, pos, kind, CASE WHEN sum(is_end::INT) OVER (PARTITION BY summary_id ORDER BY pos DESC) > 0 THEN sum(is_end::INT) OVER (PARTITION BY summary_id ORDER BY pos) - is_end::INT + 1 ELSE 0 END AS section_no,
 sum(CASE WHEN kind = 'Table' THEN 1 ELSE 0 END) OVER (PARTITION BY summary_id ORDER BY pos) AS table_no,
 CASE kind WHEN 'Heading' THEN repeat('#', coalesce(level, 1)) || ' ' || coalesce(text, '') || chr(10) || chr(10) WHEN 'Paragraph' THEN coalesce(text, '') || chr(10) || chr(10) WHEN 'Table' THEN coalesce(text, '') || chr(10) ELSE '' END AS markdown FROM q""",
)
def built_lines(spark: SparkSession, folder: str) -> DataFrame:
    once = load(spark, folder, "sections").where("section_pos IS NOT NULL").select("summary_id", "section_pos", "section_id", "nodes").distinct()
    nodes = once.select("summary_id", "section_pos", F.posexplode("nodes").alias("k", "n")).select("summary_id", (F.col("section_pos").cast("long") * 1_000_000 + F.col("k") + 1).alias("pos"), "n.kind", "n.level", "n.text", F.coalesce(F.col("n.kind") == "Heading", F.lit(False)).alias("is_end"))
    return export.built_lines(nodes)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "document_summary")
    return docs.select(F.col("source_path").alias("path"), F.octet_length("markdown").cast("long").alias("length"), F.col("markdown").cast("binary").alias("content")).distinct()


@_query(
    "document_scan",
    r"""WITH f AS (SELECT DISTINCT source_path AS path, strlen(markdown) AS length, markdown FROM document_summary)
SELECT path, length, CASE WHEN path IS NULL OR length IS NULL THEN 'IoError' WHEN lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '[^.]\.([^.]*)$', 1)) NOT IN ('pdf', 'docx') THEN 'UnsupportedFormat' WHEN length > 524288000 THEN 'FileTooLarge' END AS error_code FROM f""",
)
def document_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_errors(_files(spark, folder)).select("path", "length", "error_code")


@_query(
    "document_summary",
    rf"""WITH f AS (SELECT DISTINCT source_path AS path, markdown FROM document_summary),
e AS (SELECT path, regexp_extract(path, '([^/\\]*)$', 1) AS name, markdown, CASE WHEN path IS NULL OR markdown IS NULL THEN 'IoError' WHEN lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '[^.]\.([^.]*)$', 1)) NOT IN ('pdf', 'docx') THEN 'UnsupportedFormat' END AS error_code FROM f)
SELECT path AS source_path, CASE WHEN error_code IS NULL THEN 1 END AS total_pages, CASE WHEN error_code IS NULL THEN false END AS has_ocr,
CASE WHEN error_code IS NULL THEN md5('# ' || name || chr(10) || chr(10) || CASE WHEN regexp_replace(markdown, {_TRIM}) <> '' THEN regexp_replace(markdown, {_TRIM}) || chr(10) || chr(10) ELSE '' END) END AS md5, error_code FROM e""",
)
def document_summary(spark: SparkSession, folder: str) -> DataFrame:
    return process_documents(_files(spark, folder)).select("source_path", "total_pages", "has_ocr", F.md5("markdown").alias("md5"), "error_code")


@_query(
    "document_ids",
    r"""WITH f AS (SELECT DISTINCT source_path AS path, strlen(markdown) AS length, markdown FROM document_summary WHERE source_path IS NOT NULL AND markdown IS NOT NULL),
g AS (SELECT *, regexp_extract(path, '([^/\\]*)$', 1) AS name FROM f WHERE lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '[^.]\.([^.]*)$', 1)) IN ('pdf', 'docx'))
SELECT path, length, count(*) OVER (PARTITION BY path, length) AS same_id, count(*) OVER (PARTITION BY name, markdown) AS same_section FROM g""",
)
def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids have no fixed values: how many documents share each, by path and size, and each section, by name and text."""
    ids = process_documents(_files(spark, folder)).where("error_code IS NULL").select(F.col("source_path").alias("path"), F.col("id"), F.col("section_id"), F.col("markdown"))
    files = _files(spark, folder).where("path IS NOT NULL AND content IS NOT NULL").select("path", "length", F.md5("content").alias("content"))
    named = files.join(ids.select("path", "id", "section_id").distinct(), "path")
    each = named.groupBy("id").agg(F.countDistinct("path", "length", "content").alias("same_id"))
    sections = named.groupBy("section_id").agg(F.countDistinct("path", "length", "content").alias("same_section"))
    return named.join(each, "id").join(sections, "section_id").select("path", "length", "same_id", "same_section")


@_query("section_ids", "SELECT section_id FROM sections")
def section_ids(spark: SparkSession, folder: str) -> DataFrame:
    return index.section_ids(load(spark, folder, "sections"))


@_query(
    "decoded_bytes",
    rf"""WITH f AS (SELECT DISTINCT source_path AS path, regexp_extract(source_path, '([^/\\]*)$', 1) AS name, markdown AS m FROM document_summary WHERE source_path IS NOT NULL AND markdown IS NOT NULL)
SELECT path, '# ' || name || chr(10) || chr(10) || CASE WHEN strlen(m) % 2 = 0 THEN '# ' || name || chr(10) || chr(10) || '[binary content]' || chr(10) || chr(10)
  WHEN regexp_replace(m, {_TRIM}) <> '' THEN regexp_replace(m, {_TRIM}) || chr(10) || chr(10) ELSE '' END AS markdown
FROM f WHERE lower(regexp_extract(name, '[^.]\.([^.]*)$', 1)) IN ('pdf', 'docx')""",
)
def decoded_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Every second content ends with a byte that is no UTF-8."""
    files = _files(spark, folder).where("path IS NOT NULL AND content IS NOT NULL")
    spoiled = files.withColumn("content", F.when(F.col("length") % 2 == 0, F.concat("content", F.unhex(F.lit("FF")))).otherwise(F.col("content")))
    return process_documents(spoiled).where("error_code IS NULL").select(F.col("source_path").alias("path"), "markdown")


@_query(
    "error_messages",
    "SELECT DISTINCT id, error_code, CASE error_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ERRORS.items()) + " END AS message FROM document_summary",
)
def messages(spark: SparkSession, folder: str) -> DataFrame:
    return error_messages(load(spark, folder, "document_summary").select("id", "error_code").distinct())


@_query("delta_json", f"SELECT snapshot_no, project_code, json_object('nodeId', node_id, 'kind', kind, 'location', location, 'oldValue', old_value, 'newValue', new_value)::VARCHAR AS json FROM ({SQL['report_rows']})")
def delta_json(spark: SparkSession, folder: str) -> DataFrame:
    return export.delta_json(report_rows(spark, folder), "snapshot_no", "project_code")


@_query("report_json", f"SELECT json_object('isIdentical', is_identical, 'totalDeltas', total_deltas)::VARCHAR AS json FROM ({SQL['diff_summary']})")
def report_json(spark: SparkSession, folder: str) -> DataFrame:
    return export.report_json(diff_summary(spark, folder))


@_query(
    "built_table_rows",
    """WITH r AS (SELECT DISTINCT table_id, row_pos, row_type, CASE WHEN row_pos % 5 = 3 THEN [] ELSE cells END AS cells FROM physical_rows)
SELECT table_id, md5(string_agg('|' || array_to_string([' ' || coalesce(c.raw_text, '') || ' |' FOR c IN cells], '') || chr(10) || CASE WHEN row_type = 'Header' THEN '|' || repeat('---|', len(cells)) || chr(10) ELSE '' END, '' ORDER BY row_pos, row_type, cells)) AS md5
FROM r GROUP BY 1""",
)
def built_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """As a streaming writer prints them: every fifth row is empty and stays."""
    rows = load(spark, folder, "physical_rows").select("table_id", "row_pos", "row_type", F.when(F.col("row_pos") % 5 != 3, F.col("cells")).otherwise(F.slice("cells", 1, 0)).alias("cells")).distinct()
    return export.table_markdown(rows, keep_empty=True).select("table_id", F.md5("markdown").alias("md5"))


_SQL_SIGNED = """
d AS (SELECT DISTINCT id, total_pages, coalesce(total_pages, 0) % 8 AS odd FROM document_summary WHERE id IS NOT NULL)"""


@_query(
    "ingestion_records",
    f"""WITH {_SQL_SIGNED}
SELECT id, CASE odd WHEN 0 THEN [] WHEN 1 THEN ['checksum missing'] WHEN 2 THEN ['document_type'] WHEN 3 THEN ['schema_version', 'engine'] WHEN 4 THEN ['checksum']
  WHEN 5 THEN ['engine_version', 'timestamp'] WHEN 6 THEN ['pages'] ELSE ['record'] END AS rejections FROM d""",
)
def ingestion_records(spark: SparkSession, folder: str) -> DataFrame:
    """A record of each document, with another fault for each remainder of its pages by eight."""
    docs = load(spark, folder, "document_summary").where("id IS NOT NULL").select("id", "total_pages").distinct()
    odd = F.coalesce("total_pages", F.lit(0)) % 8
    pick = lambda k, wrong, right: F.when(odd == k, F.lit(wrong)).otherwise(F.lit(right))
    sums = F.when(odd != 1, F.concat(F.when(odd == 4, "md5:").otherwise("sha256:"), F.sha2("id", 256)))
    page = F.struct(pick(6, 0, 1).alias("page"), F.lit("table").alias("content_type"), F.lit(0.5).alias("confidence"))
    meta = F.struct(pick(3, "other", "calamine").alias("engine"), pick(5, "one", "0.32.0").alias("engine_version"), pick(5, "late", "2026-01-10T10:46:54Z").alias("timestamp"))
    record = F.struct(F.lit("x").alias("source"), pick(2, "LETTER", "BOQ_RAW").alias("document_type"), pick(3, "0.0", "0.1").alias("schema_version"), sums.alias("checksum"), F.concat(F.lit("ed25519:"), F.repeat(F.lit("ab"), 64)).alias("origin_signature"), F.array(page).alias("pages"), meta.alias("extraction_meta"))
    written = docs.withColumn("json", F.when(odd == 7, F.lit("[1, 2")).otherwise(F.to_json(record)))
    return ingestion.validate_records(written, schema_version="0.1").select("id", "rejections")


@_query(
    "skipped_pages",
    """WITH n AS (SELECT DISTINCT summary_id, section_pos, generate_subscripts(nodes, 1) AS pos, unnest(nodes) AS n FROM sections WHERE summary_id IS NOT NULL),
p AS (SELECT summary_id, n.page_index AS page, n.page_index % 7 = 3 AS failed, string_agg(n.text, chr(10) ORDER BY section_pos, pos, n.text) AS text FROM n WHERE n.page_index IS NOT NULL GROUP BY ALL),
m AS (SELECT *, CASE WHEN failed THEN '[OCR_FAILED_PAGE_' || page + 1 || ']' ELSE text END AS t FROM p)
SELECT summary_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page), '')) AS md5, count(*) AS pages, count(*) FILTER (failed) AS skipped FROM m GROUP BY 1""",
)
def skipped_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of sections by page; every seventh page counts as unread."""
    nodes = load(spark, folder, "sections").where("summary_id IS NOT NULL").select("summary_id", "section_pos", F.posexplode("nodes").alias("pos", "n")).distinct().where("n.page_index IS NOT NULL")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("n.text").isNotNull(), F.struct("section_pos", "pos", F.col("n.text").alias("text"))))), lambda x: x["text"])
    pages = nodes.groupBy("summary_id", F.col("n.page_index").alias("page")).agg(F.when(F.count("n.text") > 0, F.array_join(texts, "\n")).alias("text")).withColumn("failed", F.col("page") % 7 == 3)
    return ingestion.skipped_pages(pages).select("summary_id", F.md5("markdown").alias("md5"), "pages", "skipped")


@_query("summary_json", "SELECT DISTINCT id, json_object('id', id, 'sourcePath', source_path, 'totalPages', total_pages, 'hasOcr', has_ocr, 'markdown', coalesce(markdown, ''))::VARCHAR AS json FROM document_summary")
def summary_json(spark: SparkSession, folder: str) -> DataFrame:
    return export.summary_json(load(spark, folder, "document_summary")).distinct()


@_query(
    "registry_lookup",
    """WITH h AS (SELECT id, arg_max(struct_pack(source_path, error_code), processed_at) AS s FROM document_summary WHERE id IS NOT NULL GROUP BY 1),
w AS (SELECT DISTINCT id FROM summary_snapshots UNION SELECT 'unknown')
SELECT w.id, h.s.source_path AS source_path, CASE WHEN h.id IS NULL THEN 'IoError' ELSE h.s.error_code END AS error_code FROM w LEFT JOIN h USING (id)""",
)
def registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    from gridloom.sources.documents import Registry

    docs = load(spark, folder, "document_summary").where("id IS NOT NULL")
    latest = docs.groupBy("id").agg(F.max_by(F.struct("source_path", "error_code"), "processed_at").alias("s")).select("id", "s.*")
    registry = Registry(spark)
    registry.put(latest)
    wanted = load(spark, folder, "summary_snapshots").select("id").unionByName(spark.createDataFrame([("unknown",)], "id string"))
    return registry.get(wanted).select("id", "source_path", "error_code")


@_query("streaming_sections", "SELECT summary_id, section_id, len(nodes) AS n_nodes, coalesce(list_sum([coalesce(length(n.text), 0) FOR n IN nodes]), 0)::BIGINT AS n_chars FROM sections")
def streaming_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The sections table as a stream of files, worked off in micro-batches."""
    out, check = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-check")
    schema = load(spark, folder, "sections").schema
    stream = streaming.read_table_stream(spark, f"{folder}/sections.parquet", schema)
    streaming.run_available(streaming.section_figures(stream), streaming.append_once(out), check)
    return spark.read.parquet(out).select("summary_id", "section_id", F.col("n_nodes").cast("long").alias("n_nodes"), F.col("n_chars").cast("long").alias("n_chars"))
