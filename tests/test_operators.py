from __future__ import annotations

import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.operators import diff, export, index, layout, rules, truth, validate

NAN = float("nan")


def cells(spark, rows):
    return spark.createDataFrame(rows, schema.NUMERIC_INDEX)


# ---------------------------------------------------------------- diffs

BASE = [(1, 1, 0, 0, 100.0), (1, 1, 0, 1, 200.0)]


@pytest.mark.parametrize(
    ("a", "b", "kinds"),
    [
        (BASE, BASE, []),
        ([(1, 1, 0, 2, 1500.0)], [(1, 1, 0, 2, 1501.0)], ["Modified"]),
        ([(1, 1, r, 0, v) for r, v in enumerate((100.0, 200.0, 300.0))], [(1, 1, r, 0, v) for r, v in enumerate((100.0, 200.0, 300.0))] + [(1, 1, 99, 0, 999.0)], ["Added"]),
        ([(1, 1, 0, 0, 10000.0)], [(1, 1, 0, 0, 12000.0)], ["Modified"]),
        ([(1, 1, 0, 0, 1000.0)], [(1, 1, 0, 0, 1000.5)], []),
        ([(1, 1, r, 0, v) for r, v in enumerate((100.0, 200.0, 300.0))], [(1, 1, r, 0, v) for r, v in enumerate((100.0, 999.0, 200.0, 300.0))], ["Added", "Modified", "Modified"]),
        ([(1, 1, 0, 0, NAN)], [(1, 1, 0, 0, 5.0)], []),
        ([(1, 1, 0, 0, math.inf)], [(1, 1, 0, 0, math.inf)], []),
        ([(1, 1, 0, 0, 5.0)], [], ["Removed"]),
        ([], [], []),
    ],
)
def test_table_diff(spark, a, b, kinds):
    found = diff.table_diff(cells(spark, a), cells(spark, b)).collect()
    assert sorted(r.kind for r in found) == kinds
    mirrored = diff.table_diff(cells(spark, b), cells(spark, a)).collect()
    swap = {"Added": "Removed", "Removed": "Added", "Modified": "Modified"}
    assert sorted(swap[r.kind] for r in mirrored) == kinds


def test_table_diff_last_wins(spark):
    a = spark.createDataFrame([(1, 1, 0, 0, 1.0, 1), (1, 1, 0, 0, 9.0, 2)], schema.NUMERIC_INDEX + ", seq BIGINT")
    b = spark.createDataFrame([(1, 1, 0, 0, 9.0, 1)], schema.NUMERIC_INDEX + ", seq BIGINT")
    assert diff.table_diff(a, b, seq="seq").count() == 0


def test_section_and_heading_diff(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "section_id bigint")
    assert sorted((r.section_id, r.kind) for r in diff.section_diff(ids(1, 2, 2), ids(2, 3)).collect()) == [(1, "Removed"), (3, "Added")]
    heads = lambda *x: spark.createDataFrame(list(x), schema.HEADINGS)
    found = diff.heading_diff(heads((10, 2)), heads((10, 3))).collect()
    assert [(r.kind, r.description) for r in found] == [("Modified", "Heading level changed: H2 → H3")]
    assert diff.heading_diff(heads((1, 1), (2, 2)), heads((2, 2), (1, 1))).count() == 0


def test_snapshot_pairs_take_the_previous_delivered_snapshot(spark):
    delivered = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (1, "B"), (3, "B"), (3, "B"), (2, "C"), (2, None)], "snapshot_no int, project_code string")
    rows = [(1, "A", 10.0), (2, "A", 20.0), (3, "A", 20.5), (1, "B", 1.0), (3, "B", 5.0), (2, "C", 7.0)]
    entries = spark.createDataFrame(rows, "snapshot_no int, project_code string, numeric_value double")
    found = diff.table_diff(*diff.snapshot_pairs(entries, delivered), ["snapshot_no", "project_code"])
    assert sorted((r.snapshot_no, r.project_code, r.kind, r.old_value, r.new_value) for r in found.collect()) == [(2, "A", "Modified", 10.0, 20.0), (3, "B", "Modified", 1.0, 5.0)]


def test_snapshot_queries_cover_all_pairs(spark, data):
    from collections import Counter

    from gridloom.operators.snapshots import snapshot_deltas
    from gridloom.plans.catalog import QUERIES
    from gridloom.sources.tables import load

    wanted = Counter((r.snapshot_no, r.project_code, r.record_kind, r.delta_type) for r in snapshot_deltas(load(spark, data, "summary_snapshots"), load(spark, data, "numeric_index")).collect())
    found = Counter((r.snapshot_no, r.project_code, "cell", r.kind.replace("Modified", "ValueMismatch")) for r in QUERIES["snapshot_table_diff"](spark, data).collect())
    found += Counter((r.snapshot_no, r.project_code, "section", r.kind) for r in QUERIES["section_diff"](spark, data).collect())
    assert found == wanted and len({k[0] for k in wanted}) > 1
    reported = Counter(r.snapshot_no for r in QUERIES["report_rows"](spark, data).where("snapshot_no IS NOT NULL").collect())
    assert reported == Counter(r.snapshot_no for r in QUERIES["section_diff"](spark, data).collect())


def test_content_diff_does_not_cascade(spark):
    def rows(*names):
        return spark.createDataFrame([("t", i, "Data", [(n, None), ("", float(v))]) for i, (n, v) in enumerate(names)], schema.PHYSICAL_ROWS)

    old, new = rows(("a", 1), ("b", 2), ("c", 3)), rows(("a", 1), ("new", 9), ("b", 2), ("c", 8))
    assert sorted((r.kind, r.new_value) for r in diff.content_diff(old, new, ["table_id"]).collect()) == [("Added", 9.0), ("Modified", 8.0)]


def test_report_rows(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "section_id bigint")
    heads = lambda *x: spark.createDataFrame(list(x), schema.HEADINGS)
    deltas = diff.diff_documents((ids(255), ids(-1)), (heads((16, 1)), heads((16, 2))), (cells(spark, [(1, 1, 0, 0, 1.005)]), cells(spark, [(1, 1, 0, 0, 3.0)])))
    got = {(r.location, r.kind, r.old_value, r.new_value) for r in diff.report_rows(deltas).collect()}
    assert got == {
        ("Section ff", "Removed", None, None),
        ("Section ffffffffffffffff [NEW]", "Added", None, None),
        ("Heading 10", "Modified", "Heading level changed: H1 → H2", None),
        ("Section 1 > Table 1 > Row-Hash 3cdda0d32c151392, Col 0", "Modified", "1.00", "3.00"),
    }
    summary = diff.diff_summary(deltas).first()
    assert (summary.total_deltas, summary.value_mismatches, summary.structural_changes, summary.is_identical) == (4, 1, 1, False)
    assert diff.canonical_order(deltas).first().kind == "Removed"


def test_indexes(spark):
    rows = spark.createDataFrame([("t", 0, "Header", []), ("t", 1, "Data", [("a", None), ("1", 1.0), ("n", NAN)])], schema.PHYSICAL_ROWS)
    got = [(r.row_idx, r.col_idx) for r in index.numeric_index_of_rows(rows, ["table_id"]).orderBy("col_idx").collect()]
    assert got == [(1, 1), (1, 2)]


# ---------------------------------------------------------------- layout


def leader_rows(elements, tolerance):
    out, leader, n = {}, None, -1
    for seq, cy in sorted(elements, key=lambda e: (e[1], e[0])):
        if leader is None or not abs(cy - leader) <= tolerance:
            leader, n = cy, n + 1
        out[seq] = n
    return out


def test_snap_rows_against_a_plain_loop(spark):
    rng = random.Random(1)
    pages = {p: [(s, rng.choice([0, 4, 5, 8, 10, 15.5, 20, 21]) + rng.random()) for s in range(rng.randint(0, 12))] for p in range(60)}
    pages[99] = [(0, 0.0), (1, 4.0), (2, 8.0)]
    rows = [(p, s, "x", float(rng.randint(0, 50)), cy, 60.0, cy) for p, e in pages.items() for s, cy in e]
    df = spark.createDataFrame(rows, schema.TEXT_ELEMENTS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = layout.snap_rows(df, 5.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for p, e in pages.items():
        assert {r.seq: r.row_no for r in got if r.page_id == p} == leader_rows(e, 5.0)
    for r, t in itertools.combinations([r for r in got if r.page_id == 3], 2):
        if r.row_no == t.row_no and r.place < t.place:
            assert r.x0 <= t.x0
    assert layout.snap_rows(df.limit(0)).count() == 0


def test_column_boundary(spark):
    e = spark.createDataFrame([(1, i, "x", a, 0.0, b, 1.0) for i, (a, b) in enumerate([(10.0, 20.0), (10.0, 20.0), (50.0, 60.0)])], schema.TEXT_ELEMENTS)
    assert [r.boundary for r in layout.column_boundaries(e, F.lit(100.0)).collect()] == [35.5]
    assert layout.density_histogram(e).where("x = 15").first().ink == 2


def test_column_boundaries_against_histogram(spark):
    rng = random.Random(2)
    pages = {p: [(rng.uniform(-5, 90), rng.uniform(0, 110)) for _ in range(rng.randint(1, 6))] for p in range(120)}
    rows = [(p, i, "x", a, 0.0, b, 1.0) for p, e in pages.items() for i, (a, b) in enumerate(e)]
    got = {}
    for r in layout.column_boundaries(spark.createDataFrame(rows, schema.TEXT_ELEMENTS), F.lit(100.0)).collect():
        got.setdefault(r.page_id, set()).add(r.boundary)
    for p, e in pages.items():
        ink = [0] * 101
        for a, b in e:
            for x in range(max(0, math.floor(max(a, 0))), math.floor(min(b, 100.0)) + 1):
                ink[x] += 1
        want, start, seen = set(), None, False
        for x, n in enumerate(ink):
            if n:
                if seen and start is not None and x - start > 5:
                    want.add((start + x) / 2)
                seen, start = True, None
            elif start is None:
                start = x
        assert got.get(p, set()) == want


def fold_rows(rows):
    """The sequential fold that the window form must equal."""
    out = []
    for row_type, texts, numbers in rows:
        if out and not any(n is not None for n in numbers) and out[-1][0] == "Data":
            for k, t in enumerate(texts[: len(out[-1][1])]):
                if t.strip():
                    out[-1][1][k] = (out[-1][1][k].strip() + " " + t.strip()).strip()
        else:
            out.append([row_type, list(texts), numbers])
    return [(r, t) for r, t, _ in out]


def test_row_cohesion(spark):
    example = [("Data", ["1", "Công tác đất", "100"], [1.0, None, 100.0]), ("Data", ["", "- Đào móng", ""], [None] * 3), ("Data", ["", "- Đắp đất", ""], [None] * 3)]
    tables = {"example": example}
    for n, combo in enumerate(itertools.product([("Data", 1.0), ("Data", None), ("Total", 1.0), ("Total", None), ("Header", None)], repeat=4)):
        tables[f"t{n}"] = [(kind, [f"{i}", ""], [number, None]) for i, (kind, number) in enumerate(combo)]
    rows = [(t, i, kind, list(zip(texts, numbers))) for t, e in tables.items() for i, (kind, texts, numbers) in enumerate(e)]
    got = {}
    for r in layout.merge_broken_rows(spark.createDataFrame(rows, schema.PHYSICAL_ROWS)).orderBy("table_id", "row_no").collect():
        got.setdefault(r.table_id, []).append((r.row_type, [c.raw_text for c in r.cells]))
    assert got["example"] == [("Data", ["1", "Công tác đất - Đào móng - Đắp đất", "100"])]
    for t, e in tables.items():
        assert got[t] == fold_rows(e), e


# ---------------------------------------------------------------- truth and contracts

COLUMNS = [("total_cost", "Float64", None, True, False), ("total_paid", "Float64", None, True, True)]


def truth_inputs(spark, values, columns=COLUMNS, confidence=0.9, status="Clean"):
    tables = spark.createDataFrame([("t", "f.pdf", 1, len(values), len(columns), columns)], schema.TABLE_TRUTH)
    rows = [("t", i, i, j, j, "Float" if isinstance(v, float) else "Int" if isinstance(v, int) else "Null", v if isinstance(v, int) else None, v if isinstance(v, float) else None, None, None, confidence, "", status, None, f"t_{i}_{j}") for i, row in enumerate(values) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, schema.CELLS), tables


def test_rollup(spark):
    c, t = truth_inputs(spark, [[100.0, 40.0], [7, None]])
    lineage = truth.contributions(c, t, [])
    row = truth.rollup(lineage, []).first()
    assert (row.total_cost, row.remaining, row.percentage, row.status) == (100.0, 60.0, 0.0, "SAFE")
    assert set(truth.lineage_map(lineage, ["table_id"]).first().lineage) == {"total_cost", "total_paid"}
    assert truth.table_counts(c, []).first().row_count == 2


def test_status_bounds(spark):
    p = spark.createDataFrame([(x,) for x in (4.9, 5.0, 14.9, 15.0, -50.0, NAN)], "p double").select(truth.deviation_status(F.col("p")).alias("s"))
    assert [r.s for r in p.collect()] == ["SAFE", "WARNING", "WARNING", "CRITICAL", "SAFE", "CRITICAL"]


@pytest.mark.parametrize(
    ("values", "columns", "confidence", "status", "want"),
    [
        ([[1.0, 2.0], [1.0, 2.0]], COLUMNS, 0.9, "Clean", None),
        ([[1.0, 2.0], [1.0, 2.0]], COLUMNS, 0.7, "Clean", None),
        ([[1.0, 2.0], [1.0, 2.0]], COLUMNS, 0.6, "Clean", ("LowConfidence", 0, 0)),
        ([[1.0, 2.0]], COLUMNS, 0.9, "Clean", ("SizeViolation", -1, -1)),
        ([[1.0, 2.0], [1.0]], COLUMNS, 0.9, "Clean", ("ContractViolation", 1, -1)),
        ([[1.0, 2.0], [1.0, 2.0]], COLUMNS, 0.9, "Suspicious", ("EncodingCorruption", 0, 1)),
        ([[1.0, 2.0], [1.0, 2.0]], COLUMNS, 0.9, "Invalid", ("EncodingCorruption", 0, 0)),
    ],
)
def test_contract(spark, values, columns, confidence, status, want):
    c, t = truth_inputs(spark, values, columns, confidence, status)
    got = validate.validate_contract(t, c).collect()
    assert [(r.rejection, r.row_pos, r.col_pos) for r in got] == ([] if want is None else [want])


def test_contract_counts_columns(spark):
    c, t = truth_inputs(spark, [[1.0]] * 3, COLUMNS[:1])
    assert validate.validate_contract(t.withColumn("col_count", F.lit(5)), c).first().rejection == "ContractViolation"


def test_verdicts(spark):
    facts = spark.createDataFrame([("a", 100.0, 40.0, 60.0), ("b", 100.0, 40.0, 61.0), ("c", 100.0, 40.0, 62.0), ("d", NAN, 1.0, 1.0)], "k string, total_cost double, total_paid double, remaining double")
    assert [r.k for r in validate.verdict_remaining(facts, "k").collect()] == ["c"]
    side = lambda *x: spark.createDataFrame([(0, j, "Float", v) for j, v in enumerate(x)], "row_pos int, col_pos int, tag string, f double")
    assert [r.technical_ref for r in validate.verdict_cross_source(side(1.0, 2.0, 3.0), side(2.0, 5.0), []).collect()] == ["Row 0, Col 1"]


# ---------------------------------------------------------------- rules


def rule_cells(spark, rows):
    full = [(t, r, r, k, k, tag, v if tag == "Int" else None, v if tag == "Float" else None, v if tag == "Text" else None, v if tag == "Date" else None, 0.9, "", "Clean", None, f"{t}_{r}_{k}") for t, r, k, tag, v in rows]
    return spark.createDataFrame(full, schema.CELLS)


def rule(kind, src=("a", 0, 0), tgt=("b", 0, 0)):
    return (1, kind, *src, *tgt)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (("Text", "A"), ("Text", "A"), None),
        (("Text", "A"), ("Text", "B"), "ConsistencyViolation"),
        (("Int", 1), ("Float", 1.0), "ConsistencyViolation"),
        (("Null", None), ("Null", None), None),
        (("Float", NAN), ("Float", NAN), "ConsistencyViolation"),
        (("Date", datetime.date(2024, 1, 1)), ("Date", datetime.date(2024, 1, 1)), None),
    ],
)
def test_exact_match(spark, a, b, want):
    c = rule_cells(spark, [("a", 0, 0, *a), ("b", 0, 0, *b)])
    got = rules.exact_match(spark.createDataFrame([rule("ExactMatch")], schema.RULES), c).collect()
    assert [r.rejection for r in got] == ([want] if want else [])


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ([("Float", 40.0), ("Float", 60.0)], ("Float", 100.0), None),
        ([("Float", 40.0), ("Int", 60)], ("Int", 100), None),
        ([("Float", 40.0), ("Float", 59.0)], ("Float", 100.0), "ConsistencyViolation"),
        ([("Text", "head"), ("Float", 100.0)], ("Float", 100.0), None),
        ([("Float", 100.0), ("Text", "x")], ("Float", 100.0), "TypeMismatch"),
        ([("Float", 100.0), ("Null", None)], ("Text", "100"), "TypeMismatch"),
        ([("Float", 0.1), ("Float", 0.2)], ("Float", 0.3), "ConsistencyViolation"),
    ],
)
def test_sum_match(spark, source, target, want):
    c = rule_cells(spark, [("a", i, 0, *v) for i, v in enumerate(source)] + [("b", 0, 0, *target)])
    got = rules.sum_match(spark.createDataFrame([rule("SumMatch")], schema.RULES), c).collect()
    assert [r.rejection for r in got] == ([want] if want else [])


def test_missing_references(spark):
    c = rule_cells(spark, [("a", 0, 0, "Float", 1.0), ("b", 0, 0, "Float", 1.0)])
    ask = lambda kind, **k: [r.rejection for r in getattr(rules, kind)(spark.createDataFrame([rule("ExactMatch" if kind == "exact_match" else "SumMatch", **k)], schema.RULES), c).collect()]
    assert ask("exact_match", src=("x", 0, 0)) == ["MissingTable"]
    assert ask("exact_match", src=("a", 5, 0)) == ["MissingReference"]
    assert ask("sum_match", tgt=("b", 0, 9)) == ["MissingReference"]
    assert ask("sum_match", src=("x", 0, 0)) == ["MissingTable"]
    relations = spark.createDataFrame([(0, "a", "b", "REFERENCE", None), (1, "a", "z", "PARENT_OF", None), (2, "y", "z", "PARENT_OF", None)], schema.RELATIONS)
    tables = spark.createDataFrame([("a",), ("b",)], "table_id string")
    assert sorted((r.rel_ord, r.missing_id) for r in rules.relation_integrity(relations, tables).collect()) == [(1, "z"), (2, "y")]
    findings = rules.validate_project(spark.createDataFrame([rule("ExactMatch", src=("x", 0, 0))], schema.RULES), relations, c, tables)
    assert [(r.part, r.ord) for r in findings.where("is_first").collect()] == [(0, 1)]
    assert rules.add_tables(tables.withColumn("v", F.lit(1)), tables.withColumn("v", F.lit(2))).where("v = 2").count() == 2


# ---------------------------------------------------------------- export


def test_markdown(spark):
    rows = spark.createDataFrame([("t", 0, "Header", [("A", None), ("B", None)]), ("t", 1, "Data", [("x", None), ("1", 1.0)]), ("t", 2, "Data", [])], schema.PHYSICAL_ROWS)
    assert export.table_markdown(rows).first().markdown == "| A | B |\n|---|---|\n| x | 1 |\n"
    nodes = [("Heading", 2, "Title"), ("Paragraph", None, "  text \n"), ("Paragraph", None, "  "), ("Fragment", None, None), ("Paragraph", None, None)]
    df = spark.createDataFrame([("S", 1, nodes)], "title string, level int, nodes array<struct<kind string, level int, text string>>")
    assert df.select(export.section_markdown(F.col("title"), F.col("level"), F.col("nodes")).alias("m")).first().m == "# S\n\n## Title\n\ntext\n\n"


def test_builder_counters(spark):
    nodes = [("d", 1, "Paragraph", None, " a ", False), ("d", 2, "Table", None, "", False), ("d", 3, "Heading", 1, "One", True), ("d", 4, "Table", None, "| x |", False), ("d", 5, "Paragraph", None, "", False)]
    df = spark.createDataFrame(nodes, "summary_id string, pos long, kind string, level int, text string, is_end boolean")
    got = [(r.section_no, r.table_no, r.markdown) for r in export.built_lines(df).orderBy("pos").collect()]
    assert got == [(1, 0, " a \n\n"), (1, 1, "\n"), (1, 1, "# One\n\n"), (0, 2, "| x |\n"), (0, 2, "\n\n")]
