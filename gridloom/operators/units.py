"""Quantities recorded in different units (problem 2).

Each number cell gets the unit that is recorded for it: written after the number, in the column's
unit, in the column's name, or, for quantities, in the unit column of its row.  For cells without
any, a calibrated ensemble of boosted trees predicts the unit from the magnitude, the column's kind,
the source and the units of the other columns; confident predictions are converted, the others are
routed for review.

The ensemble (:class:`UnitModel`) weighs each unit of the catalog as a candidate for a cell, by what
other tables say about it.  It is fitted on at most ``SAMPLE_ROWS`` labelled cells, at most
``SAMPLE_OF_COLUMN`` of a column, and calibrated on cells of tables that took no part in the fit.
Nothing that names a cell's own unit is a feature.

Defined results for odd input:

* a null or NaN number has a unit but no common value; an unreadable number text is no number cell;
* counted things (``cái``, ``bộ`` and the like) have no unit and are not predicted (``counted``);
* repeated rows of a cell or table count once; of several unit columns the first holds;
* with fewer than two recorded units or no labelled cells nothing is predicted, all goes to review;
* without a table that took no part in the fit every prediction goes to review.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numbers import sanitize_number
from gridloom.functions.text import fold
from gridloom.functions.unit_names import QUANTITY, UNIT_COLUMNS, name_without_unit, unit_in_name, unit_of, written_number_and_unit
from gridloom.ml.boosting import GradientBoosting
from gridloom.session import bounded_rows, write_through

#: Labelled cells on which the classifier is fitted and calibrated, and cells of one column among them.
SAMPLE_ROWS, SAMPLE_OF_COLUMN = 12_000, 4
#: Calibrated probability from which a prediction is converted without review.
CONFIDENT = 0.9
FEATURES = ["magnitude", "base", "decimals", "negative", "source", "others", "row_unit"]


def table_columns(extracted_tables: DataFrame) -> DataFrame:
    """One row per column of a table: its folded name, recorded unit and kind."""
    named = extracted_tables.where("table_id IS NOT NULL").select("table_id", "project_code", F.posexplode("columns").alias("col_pos", "c"))
    folded = fold(F.col("c.name"))
    parsed = named.select(
        "table_id",
        "col_pos",
        "project_code",
        F.coalesce(unit_of(fold(F.col("c.unit"))), F.lit(None)).alias("column_unit"),
        unit_in_name(folded).alias("name_unit"),
        name_without_unit(folded).alias("base"),
    )
    once = parsed.groupBy("table_id", "col_pos").agg(F.max(F.struct(*parsed.columns[2:])).alias("c")).select("table_id", "col_pos", "c.*")
    # the units of the other columns of the table; a table's columns are one row of it
    own = F.coalesce("column_unit", "name_unit")
    units = once.where(own.isNotNull()).groupBy("table_id").agg(F.collect_list(F.struct("col_pos", own.alias("unit"))).alias("units"))
    others = F.array_distinct(F.transform(F.filter("units", lambda u: u["col_pos"] != F.col("col_pos")), lambda u: u["unit"]))
    return once.join(units, "table_id", "left").withColumns({"others": F.array_sort(others), "is_unit": F.col("base").isin(*UNIT_COLUMNS), "is_quantity": F.col("base").rlike(QUANTITY)}).drop("units")


def number_cells(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Number cells with their recorded unit and where it stands."""
    able = cells.where("global_id IS NOT NULL AND tag IN ('Float', 'Text')").select("global_id", "table_id", "row_pos", "col_pos", "tag", "f", "s", "source_text")
    text_number, text_unit = written_number_and_unit(F.col("s"))
    _, source_unit = written_number_and_unit(F.col("source_text"))
    is_text = F.col("tag") == "Text"
    # texts are read where they lie; only what they say is moved to the tables' columns
    thin = able.select(
        "global_id",
        "table_id",
        "row_pos",
        "col_pos",
        F.when(is_text, text_number).alias("number"),
        F.when(is_text, text_unit).alias("text_unit"),
        source_unit.alias("source_unit"),
        F.when(is_text, F.col("s")).alias("s"),
        "f",
        is_text.alias("is_text"),
        F.length(F.regexp_extract("source_text", r"[.,](\d{1,2})\D*$", 1)).cast("double").alias("decimals"),
    )
    placed = thin.join(columns, ["table_id", "col_pos"], "left")
    units = placed.where("is_unit AND is_text").groupBy("table_id", "row_pos").agg(F.min_by("s", F.struct("col_pos", "s")).alias("row_unit_text"))
    numbers = placed.where("NOT is_text OR (text_unit IS NOT NULL AND number IS NOT NULL)").withColumns(
        {
            "value": F.when(F.col("is_text"), sanitize_number(F.col("number"))).otherwise(F.col("f")),
            "written_unit": F.coalesce("source_unit", "text_unit"),
            "needs_row": F.coalesce(F.col("is_quantity"), F.lit(False)) & F.coalesce("source_unit", "text_unit", "column_unit", "name_unit").isNull(),
        }
    ).drop("s", "f", "number")
    with_row = numbers.join(units, ["table_id", "row_pos"], "left")
    row_unit = F.when(F.col("needs_row"), unit_of(fold(F.col("row_unit_text"))))
    return with_row.withColumns({"row_unit": row_unit, "recorded": F.coalesce("written_unit", "column_unit", "name_unit", row_unit)}).withColumn(
        "recorded_in",
        F.when(F.col("written_unit").isNotNull(), "text").when(F.col("column_unit").isNotNull(), "column").when(F.col("name_unit").isNotNull(), "name").when(F.col("row_unit").isNotNull(), "row"),
    )


def _features() -> list[Column]:
    return [
        F.when(F.abs("value") > 0, F.log10(F.abs("value"))).alias("magnitude"),
        F.col("base"),
        F.col("decimals"),
        F.coalesce((F.col("value") < 0).cast("double"), F.lit(0.0)).alias("negative"),
        F.col("project_code").alias("source"),
        F.col("others"),
        # of a quantity the row's unit is its own
        F.when(~F.coalesce("is_quantity", F.lit(False)), unit_of(fold(F.col("row_unit_text")))).alias("row_unit"),
    ]


class _UnitCounts:
    """What tables say about units: how often with which kind of column, source and other unit, and how large."""

    def __init__(self, sample: pd.DataFrame, codes: list[str]):
        self.k = len(codes)
        number = {c: k for k, c in enumerate(codes)}
        y = sample.recorded.map(number).to_numpy()
        # each column of a table counts once, however many of its cells are in the sample
        column = sample.assign(y=y).drop_duplicates(["table_id", "base", "y"])
        self.all = np.bincount(column.y, minlength=self.k) + 0.5
        self.all /= self.all.sum()
        self.by_base = self._table(zip(column.base, column.y, strict=True))
        self.by_source = self._table(zip(zip(column.base, column.source, strict=True), column.y, strict=True))
        self.by_other = self._table((o, k) for others, k in zip(column.others, column.y, strict=True) if others is not None for o in others)
        size = sample.magnitude.to_numpy(float)
        self.size: dict = {}
        for key, at in [*sample.groupby(y).indices.items(), *sample.groupby([sample.base, y]).indices.items()]:
            v = size[at][~np.isnan(size[at])]
            if len(v) >= (5 if isinstance(key, tuple) else 1):
                self.size[key] = (v.mean(), max(0.3, v.std()))

    def _table(self, pairs) -> dict:
        out: dict = {}
        for key, k in pairs:
            out.setdefault(key, np.zeros(self.k))[k] += 1
        return out

    def features(self, rows: pd.DataFrame, codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of each cell and candidate, and which candidates are able: units that the kind of column has."""
        none = np.zeros(self.k)
        others = [tuple(o) if o is not None else () for o in rows.others]
        kinds: dict = {}
        which = np.array([kinds.setdefault(key, len(kinds)) for key in zip(rows.base, rows.source, others, strict=True)], int)
        likely, of_source, beside, mean, spread = (np.zeros((len(kinds), self.k)) for _ in range(5))
        n_base, n_source = np.zeros((2, len(kinds)))
        able = np.ones((len(kinds), self.k), bool)
        for n, (base, source, known) in enumerate(kinds):
            count, own = self.by_base.get(base, none), self.by_source.get((base, source), none)
            n_base[n], n_source[n] = count.sum(), own.sum()
            able[n] = (count > 0) | (n_base[n] == 0)
            likely[n] = (count + 2 * self.all) / (n_base[n] + 2)
            of_source[n] = (own + likely[n]) / (n_source[n] + 1)
            shares = [(c + self.all) / (c.sum() + 1) for c in (self.by_other.get(o) for o in known) if c is not None]
            beside[n] = np.mean(shares, axis=0) if shares else self.all
            mean[n], spread[n] = np.array([self.size.get((base, j)) or self.size.get(j) or (0.0, 3.0) for j in range(self.k)]).T
        far = (rows.magnitude.to_numpy(float)[:, None] - mean[which]) / spread[which]
        fit = np.nan_to_num(-0.5 * far**2 - np.log(spread[which])) + np.log(likely[which])
        fit -= np.logaddexp.reduce(fit, axis=1, keepdims=True)
        named = np.array([np.nan if u is None else float(u == c) for u in rows.row_unit for c in codes]).reshape(len(rows), self.k)
        wide = lambda v: np.repeat(np.asarray(v, float)[:, None], self.k, axis=1)
        top = np.log(likely).max(1, keepdims=True) if len(kinds) else likely
        table = [np.log(likely)[which], np.log(of_source)[which], np.log(beside)[which], np.abs(far), fit, (np.log(likely) - top)[which], wide(np.log1p(n_base)[which]), wide(np.log1p(n_source)[which]), wide(rows.decimals), wide(rows.negative), named]
        return np.stack(table, axis=2), able[which]


class UnitModel:
    """Boosted trees that weigh each candidate unit of a cell, with a calibrated confidence."""

    def __init__(self, codes: list[str]):
        self.codes, self.counts, self.trees = codes, None, None
        self.bounds, self.right = np.zeros(0), np.zeros(0)

    def fit(self, sample: pd.DataFrame) -> UnitModel:
        number = {c: k for k, c in enumerate(self.codes)}
        # the other columns of a table may lack their units as well
        sample = pd.concat([sample, sample.assign(others=[[] for _ in range(len(sample))])], ignore_index=True)
        y = sample.recorded.map(number).to_numpy()
        fold = pd.util.hash_array(sample.table_id.to_numpy(object)) % 4
        held = fold == 3
        x, right = [], []
        for f in range(3):  # what is counted in the other tables says nothing of a cell's own one
            own, others = fold == f, ~held & (fold != f)
            if own.any() and others.any():
                table, able = _UnitCounts(sample[others], self.codes).features(sample[own], self.codes)
                x.append(table[able])
                right.append((y[own][:, None] == np.arange(len(self.codes))[None, :])[able])
        if not x:
            return self
        self.trees = GradientBoosting(trees=40, depth=4, rate=0.2).fit(np.concatenate(x), np.concatenate(right).astype(int))
        self.counts = _UnitCounts(sample[~held], self.codes)
        if held.any():
            self._calibrate(sample[held], y[held])
        return self

    def _probability(self, rows: pd.DataFrame) -> np.ndarray:
        table, able = self.counts.features(rows, self.codes)
        score = np.full(able.shape, -np.inf)
        score[able] = self.trees.decision(table[able])[:, 0]
        e = np.exp(score - score.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _calibrate(self, rows: pd.DataFrame, y: np.ndarray) -> None:
        """Share of right answers by probability, never falling; the cells of a column weigh one together."""
        p = self._probability(rows)
        best, top = p.argmax(1), p.max(1)
        column = pd.Series(list(zip(rows.table_id, rows.base, strict=True)))
        weight = 1 / column.map(column.value_counts()).to_numpy()
        blocks: list[list[float]] = []  # right, weight, upper bound
        for k in np.argsort(top, kind="stable"):
            blocks.append([weight[k] * (best[k] == y[k]), weight[k], top[k]])
            while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
                right, n, bound = blocks.pop()
                blocks[-1] = [blocks[-1][0] + right, blocks[-1][1] + n, bound]
        right, n, self.bounds = np.array(blocks).T
        # few columns prove little: one wrong answer is added to each step
        self.right = np.maximum.accumulate(right / (n + 1))

    def predict(self, rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        """The likeliest unit of each cell and the confidence in it; 0 without held-out cells."""
        p = self._probability(rows)
        at = np.searchsorted(self.bounds, p.max(1), "left")
        confidence = self.right[np.minimum(at, len(self.right) - 1)] if len(self.right) else np.zeros(len(rows))
        return [self.codes[k] for k in p.argmax(1)], confidence


def fit_units(sample: pd.DataFrame) -> UnitModel:
    """Fit on labelled cells (table_id, FEATURES and recorded); a quarter of the tables calibrates."""
    model = UnitModel(sorted(sample.recorded.unique()) if len(sample) else [])
    return model.fit(sample) if len(model.codes) >= 2 else model


PREDICTION = T.StructType([T.StructField("unit", T.StringType()), T.StructField("confidence", T.DoubleType())])


def _predict_column(shared):
    @F.pandas_udf(PREDICTION)
    def predict(features: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        if model.trees is None or not len(features):
            return pd.DataFrame({"unit": pd.Series([None] * len(features), dtype=object), "confidence": np.full(len(features), np.nan)})
        unit, confidence = model.predict(features)
        return pd.DataFrame({"unit": pd.Series(unit, dtype=object), "confidence": confidence})

    # else the optimizer copies it into filters on what it gives
    return predict.asNondeterministic()


def _with_catalog(units: DataFrame, unit_catalog: DataFrame) -> DataFrame:
    """The rows with what the catalog says about their unit_code."""
    catalog = unit_catalog.where("unit_code IS NOT NULL").groupBy("unit_code").agg(F.max(F.struct("common_unit", "to_common", "measure")).alias("c")).select("unit_code", "c.*")
    return units.join(catalog, "unit_code", "left")


def recorded_units(cells: DataFrame, extracted_tables: DataFrame, unit_catalog: DataFrame) -> DataFrame:
    """global_id, unit_code and its catalog entry of the number cells whose unit is recorded.

    What is recorded does not depend on the classifier, so none is fitted here.  Repeated rows of a
    cell come out as often.
    """
    numbers = number_cells(cells, table_columns(extracted_tables)).where("recorded IS NOT NULL")
    return _with_catalog(numbers.select("global_id", F.col("recorded").alias("unit_code")), unit_catalog)


def convert_units(cells: DataFrame, extracted_tables: DataFrame, unit_catalog: DataFrame, sample_rows: int = SAMPLE_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """Number cells with unit_code, origin, confidence, value, common_unit and common_value.

    ``origin`` is text, column, name or row for recorded units, predicted for confident predictions,
    review for uncertain ones (no conversion) and counted for things that have no unit.
    """
    # used twice, for the sample and for the prediction
    numbers = write_through(number_cells(cells, table_columns(extracted_tables)), "number-cells")
    # columns that name their unit: a unit written with the number or in the row tells of another kind of table
    labelled = numbers.where("recorded_in IN ('column', 'name') AND table_id IS NOT NULL").select("global_id", "table_id", "col_pos", "recorded", *_features())
    # an even sample of cells, and of each column in it a few
    order = [F.xxhash64(F.lit(11), "global_id"), F.col("global_id")]
    even = bounded_rows(labelled.orderBy(*order).limit(SAMPLE_OF_COLUMN * sample_rows), "unit-cells")
    few = even.withColumn("place", F.row_number().over(Window.partitionBy("table_id", "col_pos").orderBy(*order))).where(F.col("place") <= SAMPLE_OF_COLUMN)
    sample = few.orderBy(*order).limit(sample_rows).drop("global_id", "place", "col_pos").toPandas()
    shared = numbers.sparkSession.sparkContext.broadcast(fit_units(sample))
    counted = F.col("needs_row") & F.col("row_unit_text").isNotNull() & F.col("recorded").isNull()
    missing = F.col("recorded").isNull() & ~F.coalesce(counted, F.lit(False))
    # only cells without a unit enter Python
    asked = numbers.where(missing).withColumn("features", F.struct(*_features())).withColumn("guess", _predict_column(shared)(F.col("features"))).drop("features")
    both = asked.unionByName(numbers.where(~missing).withColumn("guess", F.lit(None).cast(PREDICTION)))
    sure = missing & (F.col("guess.confidence") >= confident)
    done = both.select(
        "global_id",
        "table_id",
        "row_pos",
        "col_pos",
        "value",
        F.when(F.col("recorded").isNotNull(), F.col("recorded")).when(missing, F.col("guess.unit")).alias("unit_code"),
        F.when(F.col("recorded").isNotNull(), F.col("recorded_in")).when(sure, "predicted").when(missing, "review").otherwise("counted").alias("origin"),
        F.when(F.col("recorded").isNotNull(), 1.0).otherwise(F.col("guess.confidence")).alias("confidence"),
    ).distinct()
    known = _with_catalog(done, unit_catalog)
    able = F.col("origin") != "review"
    return known.withColumns({"common_unit": F.when(able, F.col("common_unit")), "common_value": F.when(able, F.col("value") * F.col("to_common"))}).drop("to_common")
