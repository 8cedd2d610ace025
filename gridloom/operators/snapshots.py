"""Changes between consecutive full snapshots (problem 5).

A feed delivers a whole table again and again.  :class:`SnapshotIndex` writes the entries of all
snapshots in one pass, each row once into the bucket of its key, with the hash of its value: one
sorted file for each bucket and snapshot.  Then, snapshot by snapshot, the new rows are probed
against the key-to-hash index of each project's last snapshot, bucket by bucket without moving or
sorting anything; old values are fetched for keys whose hash changed only, and the snapshot just
probed becomes the index, by reference.

Defined results for odd input:

* a record with a null in its key, and an entry with a null value, is no entry;
* repeated and superseded rows: per key the row of the highest ``seq`` holds, ties by value;
* NaN is an entry but never part of a mismatch;
* a project that skips a snapshot keeps its index and is compared when it delivers again;
* the first delivery of a project has no deltas; empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import remove_path, scratch_path, shuffle_partitions

KEY = ["project_code", "id", "section_id", "table_id", "row_idx", "col_idx"]
_NO_SEQ = -(2**63)
#: Lets a bucket of one file pass for sorted.
_SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
DELTA_SCHEMA = T.StructType(
    [
        T.StructField("snapshot_no", T.IntegerType()),
        T.StructField("project_code", T.StringType()),
        T.StructField("record_kind", T.StringType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("delta_type", T.StringType()),
        T.StructField("old_value", T.DoubleType()),
        T.StructField("new_value", T.DoubleType()),
    ]
)


def section_entries(summary_snapshots: DataFrame) -> DataFrame:
    """One row per (snapshot, project, id, section) of the row of each id that holds."""
    held = (
        summary_snapshots.where("id IS NOT NULL AND project_code IS NOT NULL AND snapshot_no IS NOT NULL")
        .groupBy("snapshot_no", "project_code", "id")
        .agg(F.max_by("section_ids", F.struct(F.coalesce("seq", F.lit(_NO_SEQ)), F.col("section_ids"))).alias("section_ids"))
    )
    return held.select("snapshot_no", "project_code", "id", F.explode(F.array_distinct("section_ids")).alias("section_id")).where("section_id IS NOT NULL").select(
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        "project_code",
        "id",
        F.col("section_id").cast("long").alias("section_id"),
        F.lit(0).cast("long").alias("table_id"),
        F.lit(0).alias("row_idx"),
        F.lit(0).alias("col_idx"),
        F.lit(_NO_SEQ).alias("seq"),
        F.lit(0.0).alias("value"),
    )


def cell_entries(numeric_index: DataFrame) -> DataFrame:
    """Cells with a whole key and a value, repeated and superseded ones included."""
    types = {"snapshot_no": "int", "project_code": "string", "id": "string", "section_id": "long", "table_id": "long", "row_idx": "int", "col_idx": "int"}
    whole = numeric_index.where(" AND ".join(f"{c} IS NOT NULL" for c in [*types, "numeric_value"] if c != "id"))
    return whole.select(*((F.lit("") if c == "id" else F.col(c).cast(t)).alias(c) for c, t in types.items()), F.coalesce("seq", F.lit(_NO_SEQ)).alias("seq"), F.col("numeric_value").cast("double").alias("value"))


class SnapshotIndex:
    """The entries of all snapshots in buckets, and the deltas of one against the index before it.

    ``buckets`` is the number of shuffle partitions of the session by default.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, epsilon: float = 1.0):
        self.spark, self.epsilon = spark, epsilon
        self.buckets = buckets or shuffle_partitions(spark)
        self.table, self.path = f"gridloom_index_{uuid.uuid4().hex}", scratch_path(spark, "snapshot-index")

    def load(self, entries: DataFrame, delivered: DataFrame) -> None:
        """Write all entries: each moves once, into its bucket.

        ``delivered`` (snapshot_no, project_code, previous_no, next_no) has the deliveries of each
        project with the one before and the one after.
        """
        rows = entries.join(delivered, ["snapshot_no", "project_code"]).repartition(self.buckets, *KEY)
        # the rows of a key are together already; the value breaks ties of seq
        held = rows.groupBy("snapshot_no", "previous_no", "next_no", *KEY).agg(F.max(F.struct("seq", "value")).alias("held"))
        store = held.select(*KEY, "previous_no", "next_no", F.col("held.value").alias("value"), F.xxhash64("held.value").alias("value_hash"), "snapshot_no")
        store.write.partitionBy("snapshot_no").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.path).format("parquet").saveAsTable(self.table)

    def probe(self, snapshot_no: int, before: list[int]) -> DataFrame:
        """Keys of a snapshot that are new, gone or of another hash; ``before`` are the snapshots that the index is of."""
        store = self.spark.table(self.table)
        new = store.where((F.col("snapshot_no") == snapshot_no) & F.col("previous_no").isNotNull()).select(*KEY, F.col("value_hash").alias("new_hash"), F.col("value").alias("new_value"))
        old = self._index(snapshot_no, before).select(*KEY, F.col("value_hash").alias("old_hash"))
        return old.join(new, KEY, "full_outer").where("old_hash IS NULL OR new_hash IS NULL OR old_hash <> new_hash")

    def _index(self, snapshot_no: int, before: list[int]) -> DataFrame:
        return self.spark.table(self.table).where(F.col("snapshot_no").isin(*before) & (F.col("next_no") == snapshot_no))

    def advance(self, snapshot_no: int, before: list[int], out: str) -> None:
        """Append the deltas of one snapshot to ``out``."""
        path = scratch_path(self.spark, "snapshot-hits")
        with _setting(self.spark, _SORTED_BUCKETS, "true"):
            self.probe(snapshot_no, before).write.parquet(path)
        hits = self.spark.read.parquet(path)
        none = F.lit(None).cast("double")
        one_sided = hits.where("old_hash IS NULL OR new_hash IS NULL").withColumns({"delta_type": F.when(F.col("old_hash").isNull(), "Added").otherwise("Removed"), "old_value": none})
        values = self._index(snapshot_no, before).select(*KEY, F.col("value").alias("old_value"))
        gap = F.abs(F.col("new_value") - F.col("old_value"))
        changed = hits.where("old_hash <> new_hash").join(values, KEY).where((gap >= self.epsilon) & ~F.isnan(gap)).withColumn("delta_type", F.lit("ValueMismatch"))
        is_section = F.col("id") != ""
        deltas = one_sided.unionByName(changed).select(
            F.lit(snapshot_no).alias("snapshot_no"),
            "project_code",
            F.when(is_section, "section").otherwise("cell").alias("record_kind"),
            F.when(is_section, F.concat_ws("_", "id", "section_id")).otherwise(F.concat_ws("_", "section_id", "table_id", "row_idx", "col_idx")).alias("record_key"),
            "delta_type",
            F.when(is_section, None).otherwise(F.col("old_value")).alias("old_value"),
            F.when(is_section, None).otherwise(F.col("new_value")).alias("new_value"),
        )
        deltas.write.mode("append").parquet(out)
        remove_path(self.spark, path)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove_path(self.spark, self.path)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def snapshot_deltas(summary_snapshots: DataFrame, numeric_index: DataFrame, epsilon: float = 1.0, buckets: int | None = None) -> DataFrame:
    """Added, Removed and ValueMismatch deltas between each project's consecutive snapshots.

    A project has delivered a snapshot if ``summary_snapshots`` holds a row for it.  The loop runs
    over snapshot numbers (a handful of integers), each step over all rows of that snapshot.
    """
    spark = summary_snapshots.sparkSession
    once = summary_snapshots.where("project_code IS NOT NULL AND snapshot_no IS NOT NULL").select(F.col("snapshot_no").cast("int").alias("snapshot_no"), "project_code").distinct()
    order = Window.partitionBy("project_code").orderBy("snapshot_no")
    path = scratch_path(spark, "snapshot-projects")
    once.withColumns({"previous_no": F.lag("snapshot_no").over(order), "next_no": F.lead("snapshot_no").over(order)}).write.parquet(path)
    delivered = spark.read.schema("snapshot_no int, project_code string, previous_no int, next_no int").parquet(path)
    steps: dict[int, list[int]] = {}
    for n, m in delivered.where("previous_no IS NOT NULL").select("snapshot_no", "previous_no").distinct().collect():  # pairs of snapshot numbers
        steps.setdefault(n, []).append(m)
    out = scratch_path(spark, "snapshot-deltas")
    spark.createDataFrame([], DELTA_SCHEMA).write.parquet(out)
    if steps:
        index = SnapshotIndex(spark, buckets, epsilon)
        index.load(section_entries(summary_snapshots).unionByName(cell_entries(numeric_index)), delivered)
        for n in sorted(steps):
            index.advance(n, sorted(steps[n]), out)
        index.close()
    remove_path(spark, path)
    return spark.read.schema(DELTA_SCHEMA).parquet(out)
