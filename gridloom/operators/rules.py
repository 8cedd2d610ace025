"""Consistency rules between tables and relations of a project's graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_tables(*tables: DataFrame) -> DataFrame:
    """Tables in the order they were added: of one id the last holds."""
    union = None
    for n, df in enumerate(tables):
        step = df.withColumn("added", F.lit(n))
        union = step if union is None else union.unionByName(step)
    others = [c for c in union.columns if c != "table_id"]
    return union.groupBy("table_id").agg(F.max_by(F.struct(*others), "added").alias("t")).select("table_id", *(F.col(f"t.{c}") for c in others if c != "added"))


def _value(side: str) -> Column:
    return F.struct(*(F.col(f"{side}.{c}") for c in ("tag", "i", "f", "s", "d")))


def _same(a: Column, b: Column) -> Column:
    """Equality of tagged values: the tags count, null equals null, NaN equals nothing."""
    return (a["tag"] == b["tag"]) & F.when(a["tag"] == "Null", True).when(a["tag"] == "Int", a["i"].eqNullSafe(b["i"])).when(a["tag"] == "Float", F.coalesce((a["f"] == b["f"]) & ~F.isnan(a["f"]), F.lit(False))).when(a["tag"] == "Text", a["s"].eqNullSafe(b["s"])).otherwise(a["d"].eqNullSafe(b["d"]))


def _looked_up(rules: DataFrame, cells: DataFrame, *sides: str) -> DataFrame:
    """rule_ord and, of each side, the cell that it points to or which part of the way is missing.

    Of repeated labels the first row and cell hold.  Only cells of the rows pointed to are moved on.
    """
    points = rules.select("rule_ord", F.explode(F.array(*(F.struct(F.lit(side).alias("side"), *(F.col(f"{side}_{c}").alias(c) for c in ("table", "row", "col"))) for side in sides))).alias("p")).select("rule_ord", "p.*")
    wanted = points.join(cells.select(F.col("table_id").alias("table"), F.col("row_idx").alias("row"), "row_pos", "col_pos", "col_idx", F.struct("tag", "i", "f", "s", "d").alias("value")), ["table", "row"], "left")
    # the first row of that label, and the first cell of that label in any such row
    hit = F.min(F.when(F.col("col_idx") == F.col("col"), F.struct("row_pos", "col_pos", "value")))
    found = wanted.groupBy("rule_ord", "side", "table").agg(F.min("row_pos").alias("first_row"), hit.alias("hit"))
    tables = cells.select(F.col("table_id").alias("table")).distinct().withColumn("has_table", F.lit(True))
    value = F.when(F.col("hit.row_pos") == F.col("first_row"), F.col("hit.value"))
    miss = F.when(F.col("has_table").isNull(), "MissingTable").when(value.isNull(), "MissingReference")
    each = found.join(tables, "table", "left").select("rule_ord", "side", value.alias("value"), miss.alias("miss"))
    return each.groupBy("rule_ord").agg(*(F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True).alias(name) for side in sides for c, name in (("value", side), ("miss", f"{side}_miss"))))


def exact_match(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """rule_ord, rejection of the ExactMatch rules that fail."""
    own = rules.where("rule_type = 'ExactMatch'")
    both = _looked_up(own, cells, "src", "tgt")
    rejection = F.coalesce("src_miss", "tgt_miss", F.when(~F.coalesce(_same(F.col("src"), F.col("tgt")), F.lit(False)), "ConsistencyViolation"))
    return both.select("rule_ord", rejection.alias("rejection")).where("rejection IS NOT NULL")


def sum_match(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """rule_ord, rejection, source_sum, target_value of the SumMatch rules that fail.

    The column ``src_col`` of the source table is summed in row order as doubles and must equal the
    target exactly.  Null is skipped, text and dates in row 0 as well, elsewhere they do not fit.
    """
    own = rules.where("rule_type = 'SumMatch'")
    target = _looked_up(own, cells, "tgt")
    number = F.when(F.col("tgt.tag") == "Int", F.col("tgt.i").cast("double")).when(F.col("tgt.tag") == "Float", F.col("tgt.f"))
    tables = cells.select(F.col("table_id").alias("src_table")).distinct().withColumn("has_table", F.lit(True))
    column = own.select("rule_ord", F.col("src_table").alias("table_id"), F.col("src_col").alias("col_idx")).join(cells.select("table_id", "col_idx", "row_pos", "col_pos", F.struct("tag", "i", "f", "row_idx").alias("c")), ["table_id", "col_idx"])
    source = column.groupBy("rule_ord", "row_pos").agg(F.min_by("c", "col_pos").alias("c"))
    value = F.when(F.col("c.tag") == "Int", F.col("c.i").cast("double")).when(F.col("c.tag") == "Float", F.col("c.f"))
    wrong = F.col("c.tag").isin("Text", "Date") & (F.col("c.row_idx") != 0)
    # exact equality of doubles depends on the order of the additions: a fold in row order
    ordered = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("row_pos", value.alias("v")))))
    sums = source.groupBy("rule_ord").agg(F.aggregate(ordered, F.lit(0.0), lambda a, e: a + e["v"]).alias("source_sum"), F.bool_or(wrong).alias("unfit"))
    all_ = own.select("rule_ord", "src_table").join(tables, "src_table", "left").join(target, "rule_ord").join(sums, "rule_ord", "left")
    total = F.coalesce("source_sum", F.lit(0.0))
    equal = F.coalesce((total == number) & ~F.isnan(total), F.lit(False))
    rejection = (
        F.when(F.col("has_table").isNull(), "MissingTable")
        .when(F.col("tgt_miss").isNotNull(), F.col("tgt_miss"))
        .when(number.isNull(), "TypeMismatch")
        .when(F.coalesce("unfit", F.lit(False)), "TypeMismatch")
        .when(~equal, "ConsistencyViolation")
    )
    return all_.select("rule_ord", rejection.alias("rejection"), total.alias("source_sum"), number.alias("target_value")).where("rejection IS NOT NULL")


def relation_integrity(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """rel_ord, missing_id: the end of each relation that no table has, the from end first."""
    ids = tables.select("table_id").distinct()
    known = relations.join(ids.select(F.col("table_id").alias("from_id"), F.lit(True).alias("has_from")), "from_id", "left").join(ids.select(F.col("table_id").alias("to_id"), F.lit(True).alias("has_to")), "to_id", "left")
    missing = F.when(F.col("has_from").isNull(), F.col("from_id")).when(F.col("has_to").isNull(), F.col("to_id"))
    return known.where("has_from IS NULL OR has_to IS NULL").select("rel_ord", missing.alias("missing_id"))


def validate_project(rules: DataFrame, relations: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """All findings in order, with ``is_first`` on the one a fail-fast check would report."""
    exact = exact_match(rules, cells).select(F.lit(0).alias("part"), F.col("rule_ord").alias("ord"), "rejection")
    sums = sum_match(rules, cells).select(F.lit(0).alias("part"), F.col("rule_ord").alias("ord"), "rejection")
    broken = relation_integrity(relations, tables).select(F.lit(1).alias("part"), F.col("rel_ord").alias("ord"), F.lit("MissingTable").alias("rejection"))
    findings = exact.unionByName(sums).unionByName(broken)
    first = findings.agg(F.min(F.struct("part", "ord")).alias("f")).select(F.col("f.part").alias("part"), F.col("f.ord").alias("ord"), F.lit(True).alias("is_first"))
    return findings.join(first, ["part", "ord"], "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
