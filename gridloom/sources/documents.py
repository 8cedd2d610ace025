"""Documents from files: validation, decoding, one section each, and the summaries' registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.hashing import hex_padded, stable_id
from gridloom.functions.normalize import extension, file_name, mapped

EXTENSIONS = ("pdf", "docx")
MAX_BYTES = 500 * 1024 * 1024
#: Error codes of a scan and what they tell the user.
ERRORS = {"IoError": "The file cannot be read.", "UnsupportedFormat": "The file format is not supported.", "FileTooLarge": "The file is larger than 500 MiB.", "EnginePanic": "Processing ended unexpectedly."}


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, content of files; content is read only where it is used."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content")


def scan_errors(files: DataFrame) -> DataFrame:
    """``error_code`` by the first check that fails: missing file, format, unreadable size, size."""
    code = (
        F.when(F.col("path").isNull() | F.col("length").isNull() & F.col("content").isNull(), "IoError")
        .when(~extension(F.col("path")).isin(*EXTENSIONS), "UnsupportedFormat")
        .when(F.col("length").isNull(), "IoError")
        .when(F.col("length") > MAX_BYTES, "FileTooLarge")
    )
    return files.withColumn("error_code", code)


def process_documents(files: DataFrame) -> DataFrame:
    """Document summaries of files (path, length, content): errors are data, not failures.

    A document becomes one level-1 section titled by its file name with one paragraph; bytes that
    are no UTF-8 give a placeholder.
    """
    scanned = scan_errors(files)
    name = file_name(F.col("path"))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.concat(F.lit("# "), name, F.lit("\n\n[binary content]")))
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    body = F.when(plain != "", F.concat(plain, F.lit("\n\n"))).otherwise("")
    ok = F.col("error_code").isNull()
    return scanned.select(
        hex_padded(F.xxhash64("path", "length")).alias("id"),
        F.col("path").alias("source_path"),
        F.when(ok, 1).alias("total_pages"),
        F.when(ok, False).alias("has_ocr"),
        F.when(ok, F.concat(F.lit("# "), name, F.lit("\n\n"), body)).alias("markdown"),
        F.when(ok, stable_id(name, text)).alias("section_id"),
        "error_code",
    )


def missing_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted paths, with null length and content where no file is: the scan then says IoError."""
    return paths.select("path").distinct().join(files, "path", "left")


def error_messages(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("message", mapped(F.col("error_code"), ERRORS))


class Registry:
    """Document summaries of a session by id: of one id the last put holds."""

    def __init__(self, spark: SparkSession, name: str = "document_registry"):
        self.spark, self.name, self.parts = spark, name, []

    def put(self, summaries: DataFrame) -> None:
        self.parts.append(summaries.withColumn("put_no", F.lit(len(self.parts))))
        union = self.parts[0]
        for part in self.parts[1:]:
            union = union.unionByName(part, allowMissingColumns=True)
        others = [c for c in union.columns if c not in ("id", "put_no")]
        held = union.groupBy("id").agg(F.max_by(F.struct(*others), "put_no").alias("s")).select("id", "s.*")
        held.createOrReplaceTempView(self.name)

    def get(self, ids: DataFrame) -> DataFrame:
        """Summaries of the ids; an unknown id has the error code IoError."""
        known = self.spark.table(self.name).withColumn("is_known", F.lit(True))
        found = ids.select("id").distinct().join(known, "id", "left")
        return found.withColumn("error_code", F.when(F.col("is_known").isNull(), "IoError").otherwise(F.col("error_code"))).drop("is_known")
