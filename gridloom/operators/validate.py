"""Structural contracts of tables and checks of their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLUMNS, MIN_ROWS = 10_000, 100, 2
LEAST_CONFIDENCE = 0.7
MATH_TOLERANCE = 1.0
VERDICT = ["violation", "severity", "message", "technical_ref", "evidence_id"]


def validate_contract(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, rejection, row_pos, col_pos of the first failed check of each table that fails.

    Order of checks: declared size, number of columns, then row by row the number of cells and cell
    by cell confidence and encoding.  All findings are computed at once; the least ordinal is first.
    """
    header = (
        F.when(F.col("row_count") > MAX_ROWS, F.struct(F.lit(0).alias("check"), F.lit("SizeViolation").alias("rejection")))
        .when(F.col("col_count") > MAX_COLUMNS, F.struct(F.lit(1).alias("check"), F.lit("SizeViolation").alias("rejection")))
        .when(F.col("row_count") < MIN_ROWS, F.struct(F.lit(2).alias("check"), F.lit("SizeViolation").alias("rejection")))
        .when(F.size("columns") != F.col("col_count"), F.struct(F.lit(3).alias("check"), F.lit("ContractViolation").alias("rejection")))
    )
    heads = tables.select("table_id", header.alias("found"), "col_count", "columns")
    of_header = heads.where("found IS NOT NULL").select("table_id", F.lit(-1).alias("row_pos"), F.lit(-1).alias("col_pos"), F.col("found.check").alias("check"), F.col("found.rejection").alias("rejection"))
    # one pass over the cells: their number by row, and the first bad cell of each row
    critical = heads.select("table_id", "col_count", F.transform("columns", lambda c: c["is_critical"]).alias("critical"))
    thin = cells.select("table_id", "row_pos", "col_pos", "col_idx", "tag", "confidence", "encoding_status")
    bad = (
        F.when((F.col("tag") != "Null") & (F.col("confidence") < F.lit(LEAST_CONFIDENCE).cast("float")), "LowConfidence")
        .when(F.col("encoding_status") == "Invalid", "EncodingCorruption")
        .when((F.col("encoding_status") == "Suspicious") & F.coalesce(F.get("critical", F.col("col_idx")), F.lit(False)), "EncodingCorruption")
    )
    checked = thin.join(critical, "table_id").withColumn("bad", bad)
    rows = checked.groupBy("table_id", "row_pos").agg(F.count(F.lit(1)).alias("n"), F.max("col_count").alias("col_count"), F.min(F.when(F.col("bad").isNotNull(), F.struct("col_pos", "bad"))).alias("worst"))
    of_rows = rows.where("n <> col_count OR worst IS NOT NULL").select(
        "table_id",
        "row_pos",
        F.when(F.col("n") != F.col("col_count"), -1).otherwise(F.col("worst.col_pos")).alias("col_pos"),
        F.lit(4).alias("check"),
        F.when(F.col("n") != F.col("col_count"), "ContractViolation").otherwise(F.col("worst.bad")).alias("rejection"),
    )
    found = of_header.unionByName(of_rows)
    return found.groupBy("table_id").agg(F.min(F.struct("check", "row_pos", "col_pos", "rejection")).alias("first")).select("table_id", "first.rejection", "first.row_pos", "first.col_pos")


def verdict_remaining(facts: DataFrame, key: str, tolerance: float = MATH_TOLERANCE) -> DataFrame:
    """Where remaining is off from cost - paid by more than the tolerance (NaN is never off)."""
    expected = F.col("total_cost") - F.col("total_paid")
    gap = F.abs(F.col("remaining") - expected)
    return facts.where((gap > tolerance) & ~F.isnan(gap)).select(F.col(key), F.lit("MathError").alias("violation"), F.lit(3).alias("severity"), F.col("remaining").alias("found"), expected.alias("expected"))


def verdict_cross_source(primary: DataFrame, secondary: DataFrame, keys: list[str], tolerance: float = MATH_TOLERANCE) -> DataFrame:
    """Float cells at the same place of two sources that differ by more than the tolerance.

    Both sides have the keys, row_pos, col_pos, tag and f; what one side lacks is not compared.
    """
    place = [*keys, "row_pos", "col_pos"]
    a = primary.where("tag = 'Float'").select(*place, F.col("f").alias("primary"), *(["global_id"] if "global_id" in primary.columns else []))
    b = secondary.where("tag = 'Float'").select(*place, F.col("f").alias("secondary"))
    gap = F.abs(F.col("primary") - F.col("secondary"))
    found = a.join(b, place).where((gap > tolerance) & ~F.isnan(gap))
    ref = F.concat(F.lit("Row "), "row_pos", F.lit(", Col "), "col_pos")
    return found.withColumns({"violation": F.lit("Mismatch"), "severity": F.lit(3), "technical_ref": ref})


def number_text(value: Column) -> Column:
    """A double in its shortest digits, without exponent and without a fraction of zero."""
    digits = value.cast("string")
    plain = digits.try_cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.coalesce(plain, digits), r"\.0+$|(?<=\.\d{0,18}[1-9])0+$", "")


def verify(facts: DataFrame, key: str, primary: DataFrame, secondary: DataFrame, keys: list[str], tolerance: float = MATH_TOLERANCE) -> DataFrame:
    """All verdicts in one table: the sums of each project, then the pairs of sources cell by cell.

    rule, subject (the key, or the keys of a pair joined by ``/``) and the columns of ``VERDICT``;
    ``primary`` has the global_id that is the evidence of a mismatch.
    """
    sums = verdict_remaining(facts, key, tolerance)
    said = F.concat(F.lit("Calculated remaining "), number_text(F.col("expected")), F.lit(", reported "), number_text(F.col("found")), F.lit(", off by "), number_text(F.abs(F.col("found") - F.col("expected"))))
    math = sums.select(F.lit("R01").alias("rule"), F.col(key).cast("string").alias("subject"), "violation", "severity", said.alias("message"), F.lit("ProjectTruth::Financials").alias("technical_ref"), F.lit(None).cast("string").alias("evidence_id"))
    pairs = verdict_cross_source(primary, secondary, keys, tolerance)
    differ = F.concat(F.lit("Source A "), number_text(F.col("primary")), F.lit(", source B "), number_text(F.col("secondary")), F.lit(", off by "), number_text(F.abs(F.col("primary") - F.col("secondary"))))
    cross = pairs.select(F.lit("R05").alias("rule"), F.concat_ws("/", *keys).alias("subject"), "violation", "severity", differ.alias("message"), "technical_ref", F.col("global_id").alias("evidence_id"))
    return math.unionByName(cross)


def verdict_cells(cells: DataFrame) -> DataFrame:
    """Simple checks of single cells: no lineage (severity 3), encoding flags (2), negative amounts (3)."""
    checks = F.filter(
        F.array(
            F.when(F.col("global_id").isNull() | (F.col("global_id") == ""), "LineageMissing"),
            F.when(F.col("encoding_status").isin("Suspicious", "Invalid"), "EncodingFlag"),
            F.when((F.col("tag") == "Float") & (F.col("f") < 0), "NegativeValue"),
        ),
        lambda x: x.isNotNull(),
    )
    severity = F.when(F.col("violation") == "EncodingFlag", 2).otherwise(3)
    return cells.select("table_id", "row_pos", "col_pos", "global_id", F.explode(checks).alias("violation")).withColumn("severity", severity)


def verdict_totals(verdicts: DataFrame, key: str = "table_id") -> DataFrame:
    """Per table: number of violations, the gravest, and whether it is invalid."""
    return verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("violations"), F.max("severity").alias("gravest")).withColumn("invalid", F.col("gravest") >= 3)
