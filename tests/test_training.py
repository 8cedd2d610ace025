"""Snapshots and units: defined results for odd input, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.ml.boosting import GradientBoosting
from gridloom.operators import snapshots
from gridloom.operators.snapshots import snapshot_deltas
from gridloom.operators.units import convert_units

NAN = float("nan")
SUMMARY = "snapshot_no int, project_code string, id string, section_ids array<bigint>, seq bigint, loaded_at timestamp"
INDEX = "snapshot_no int, project_code string, section_id bigint, table_id bigint, row_idx int, col_idx int, numeric_value double, seq bigint, loaded_at timestamp"


def brute_force(summary, index):
    delivered = {}
    for n, p, *_ in summary:
        if n is not None and p is not None:
            delivered.setdefault(p, set()).add(n)
    entries = {}
    best = {}
    for n, p, i, ids, seq, _ in summary:
        if None not in (n, p, i) and seq >= best.get((n, p, i), (-1,))[0]:
            best[n, p, i] = (seq, ids)
    for (n, p, i), (_, ids) in best.items():
        for s in set(ids or []) - {None}:
            entries.setdefault((p, n), {})["section", f"{i}_{s}"] = 0.0
    held = {}
    for n, p, *key, v, seq, _ in index:
        if None not in (n, p, *key, v) and n in delivered.get(p, ()):
            k = (p, n, tuple(key))
            if k not in held or seq > held[k][0]:
                held[k] = (seq, v)
    for (p, n, key), (_, v) in held.items():
        entries.setdefault((p, n), {})["cell", "_".join(map(str, key))] = v
    out = set()
    for p, ns in delivered.items():
        for old, new in zip(sorted(ns), sorted(ns)[1:]):
            a, b = entries.get((p, old), {}), entries.get((p, new), {})
            out |= {(new, *k, "Added") for k in b.keys() - a.keys()} | {(new, *k, "Removed") for k in a.keys() - b.keys()}
            out |= {(new, *k, "ValueMismatch") for k in a.keys() & b.keys() if abs(a[k] - b[k]) >= 1.0}
    return out


def deltas(spark, summary, index):
    df = snapshot_deltas(spark.createDataFrame(summary, SUMMARY), spark.createDataFrame(index, INDEX))
    rows = df.collect()
    assert len(rows) == len(set(rows))
    return {(r.snapshot_no, r.record_kind, r.record_key, r.delta_type) for r in rows}


def test_snapshots_against_brute_force(spark):
    rng = random.Random(4)
    summary, index = [], []
    for n in (1, 2, 3):
        for p in ("A", "B", "C"):
            if (p, n) == ("B", 2):
                continue  # B skips a snapshot
            for i in range(3):
                summary.append((n, p, f"{p}{i}", [rng.randint(1, 5) for _ in range(rng.randint(0, 4))], n * 100 + i, None))
            for _ in range(12):
                index.append((n, p, rng.randint(1, 2), rng.randint(1, 2), rng.randint(0, 2), 0, rng.choice([1.0, 1.5, 2.0, NAN, 9.0, None]), len(index), None))
    summary += [(2, "A", "A0", [1, 2], 5, None), summary[0], (None, "A", "x", [1], 1, None), (1, None, "x", [1], 1, None), (2, "A", None, [3], 9, None), (3, "C", "C9", None, 1, None)]
    index += [index[0], (2, "B", 1, 1, 0, 0, 5.0, 1, None), (3, "A", None, 1, 0, 0, 5.0, 1, None), (3, "A", 1, 1, 0, None, 5.0, 1, None)]
    assert deltas(spark, summary, index) == brute_force(summary, index)


def test_snapshots_empty(spark):
    assert deltas(spark, [], []) == set()
    assert deltas(spark, [(1, "A", "a", [1], 1, None)], []) == set()


def test_snapshots_lie_in_sorted_buckets(spark, data, monkeypatch):
    plans, files = [], []

    class Watched(snapshots.SnapshotIndex):
        def load(self, *args):
            super().load(*args)
            held = self.spark.table(self.table).select("snapshot_no", F.input_file_name().alias("file")).distinct().collect()
            buckets = [(r.snapshot_no, r.file.rsplit("_", 1)[1]) for r in held]
            files.append((len(buckets), len(set(buckets))))

        def probe(self, *args):
            df = super().probe(*args)
            plans.append((len(args[1]), df._jdf.queryExecution().executedPlan().toString()))
            return df

    monkeypatch.setattr(snapshots, "SnapshotIndex", Watched)
    tables = [spark.read.parquet(f"{data}/../sf0.01/{t}.parquet") for t in ("summary_snapshots", "numeric_index")]
    assert snapshot_deltas(*tables, buckets=3).count() > 1000
    assert files and all(a == b for a, b in files)  # one file a bucket and snapshot
    assert plans and not any("Exchange" in p for _, p in plans)
    # a side of one snapshot is sorted as it lies
    assert all(p.count("Sort [") <= (1 if n > 1 else 0) for n, p in plans)


CELLS = "global_id string, table_id string, row_pos int, col_pos int, tag string, f double, s string, source_text string"
TABLES = "table_id string, project_code string, tool_version string, columns array<struct<name:string,dtype:string,unit:string,nullable:boolean,is_critical:boolean>>"
CATALOG = [("m2", "area", "m2", 1.0), ("100m2", "area", "m2", 100.0), ("kg", "mass", "kg", 1.0), ("t", "mass", "kg", 1000.0), ("vnd", "money", "vnd", 1.0), ("m_vnd", "money", "vnd", 1e6)]


def units(spark, cells, tables):
    catalog = spark.createDataFrame(CATALOG, "unit_code string, measure string, common_unit string, to_common double")
    df = convert_units(spark.createDataFrame(cells, CELLS).withColumns({"unit": F.lit(1), "value": F.lit("x")}), spark.createDataFrame(tables, TABLES), catalog)
    return {r.global_id: r for r in df.collect()}


def test_order_of_units(spark):
    column = lambda name, unit=None: (name, "Float64", unit, True, False)
    tables = [("t", "P", "1", [column("Đơn vị"), column("Khối lượng"), column("Thành tiền (triệu đồng)"), column("Khối lượng", "100m2"), column(None)])] * 2 + [("e", None, None, None)]
    cells = [
        ("u", "t", 0, 0, "Text", None, "tấn", "tấn"),
        ("row", "t", 0, 1, "Float", 2.0, None, "2,0"),
        ("row", "t", 0, 1, "Float", 2.0, None, "2,0"),
        ("name", "t", 0, 2, "Float", 3.0, None, "3"),
        ("column", "t", 0, 3, "Float", 1.5, None, "1.5"),
        ("text", "t", 0, 3, "Float", 1.5, None, "1,5 kg"),
        ("u1", "t", 1, 0, "Text", None, "cái", "cái"),
        ("counted", "t", 1, 1, "Float", 7.0, None, "7"),
        ("typed", "t", 1, 4, "Text", None, "-1.250,5 m²", None),
        ("nan", "t", 1, 3, "Float", NAN, None, ""),
        ("none", "t", 1, 3, "Float", None, None, None),
        ("word", "t", 1, 4, "Text", None, "phụ lục 5", "phụ lục 5"),
        ("lost", "x", None, None, "Float", 1.0, None, "1"),
        (None, "t", 1, 1, "Float", 7.0, None, "7 kg"),
        ("int", "t", 1, 1, "Int", None, None, "7 kg"),
    ]
    got = units(spark, cells, tables)
    assert {k: (r.unit_code, r.origin) for k, r in got.items() if k != "lost"} == {
        "row": ("t", "row"), "name": ("m_vnd", "name"), "column": ("100m2", "column"), "text": ("kg", "text"), "counted": (None, "counted"), "typed": ("m2", "text"), "nan": ("100m2", "column"), "none": ("100m2", "column"),
    }
    assert got["row"].common_value == 2000.0 and got["column"].common_value == 150.0 and got["typed"].common_value == -1250.5
    assert got["none"].common_value is None and got["lost"].origin in ("review", "predicted")


def test_recorded_units_need_no_classifier(spark, data, monkeypatch):
    from gridloom.operators import units as operator
    from gridloom.plans.training import QUERIES

    fitted = []
    fit = operator.fit_units
    monkeypatch.setattr(operator, "fit_units", lambda sample: fitted.append(len(sample)) or fit(sample))
    found = QUERIES["p2_found"](spark, data)
    assert found.count() > 0 and not fitted and "Python" not in found._jdf.queryExecution().executedPlan().toString()
    # where it does change rows, it still runs
    assert QUERIES["p2_converted"](spark, data).where("origin IN ('predicted', 'review') AND unit_code IS NOT NULL").count() > 0 and fitted


def test_units_of_empty_tables(spark):
    assert units(spark, [], []) == {}


def test_missing_units_are_predicted(spark):
    rng = random.Random(1)
    tables, cells = [], []
    for k in range(60):
        kind = k % 2
        known = k % 5 != 0
        name, unit = (("Tổng A", "kg") if kind else ("Tổng B", "t"))
        tables.append((f"t{k}", f"P{kind}", "1", [(name, "Float64", unit if known else None, True, False)]))
        for r in range(10):
            v = rng.uniform(1000, 9000) if kind else rng.uniform(1, 9)
            cells.append((f"g{k}_{r}", f"t{k}", r, 0, "Float", v, None, f"{v:.2f}"))
    got = units(spark, cells, tables)
    missing = [r for r in got.values() if int(r.table_id[1:]) % 5 == 0]
    right = sum(r.unit_code == ("kg" if int(r.table_id[1:]) % 2 else "t") for r in missing)
    assert right / len(missing) > 0.95 and sum(r.origin == "predicted" for r in missing) > 0.8 * len(missing)


def _masked(spark, likely, seed=2):
    """Tables of three kinds of columns; those of every fourth table lack their units. Gives the accepted and all predictions with the truth."""
    rng = random.Random(seed)
    kinds = {"Diện tích": ("m2", "100m2"), "Trọng lượng": ("kg", "t"), "Giá trị": ("vnd", "m_vnd")}
    scale = {"m2": 900, "100m2": 9, "kg": 5000, "t": 5, "vnd": 5e7, "m_vnd": 50}
    tables, cells, truth = [], [], {}
    for k in range(200):
        columns = []
        for j, (name, pair) in enumerate(kinds.items()):
            unit = pair[rng.random() < 0.4]
            columns.append((name, "Float64", None if k % 4 == 0 else {"m_vnd": "triệu đồng"}.get(unit, unit), True, False))
            for r in range(5):
                v = rng.lognormvariate(0, 0.6) * (scale[unit] if likely else 10)
                cells.append((f"g{k}_{j}_{r}", f"t{k}", r, j, "Float", v, None, f"{v:.2f}"))
                truth[f"g{k}_{j}_{r}"] = unit
        tables.append((f"t{k}", f"P{k % 3}", "1", columns))
    got = [r for r in units(spark, cells, tables).values() if r.origin in ("predicted", "review")]
    assert len(got) == 50 * 15
    return [(r.origin, r.unit_code == truth[r.global_id], r.confidence) for r in got]


def test_confident_units_of_masked_tables_are_right(spark):
    got = _masked(spark, True)
    sure = [right for origin, right, _ in got if origin == "predicted"]
    assert len(sure) > 0.8 * len(got) and np.mean(sure) > 0.95


def test_units_that_nothing_tells_go_to_review(spark):
    got = _masked(spark, False)
    assert all(origin == "review" for origin, _, _ in got)
    assert abs(np.mean([c for _, _, c in got]) - np.mean([right for _, right, _ in got])) < 0.15


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_on_held_out_rows(classes):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    x[::7, 3] = np.nan
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (0 if classes == 2 else (x[:, 2] > 1).astype(int))
    model = GradientBoosting(trees=40).fit(x[:2000], y[:2000], classes).calibrate(x[2000:2500], y[2000:2500])
    p = model.probability(x[2500:])
    assert (p.argmax(1) == y[2500:]).mean() > 0.9 and np.allclose(p.sum(1), 1)
    assert GradientBoosting().fit(np.zeros((0, 3)), np.zeros(0), 2).probability(np.ones((2, 3))).shape == (2, 2)
