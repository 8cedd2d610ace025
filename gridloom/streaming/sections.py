"""Sections of documents as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

OPEN_SECTION = T.StructType([T.StructField("title", T.StringType()), T.StructField("nodes", T.IntegerType()), T.StructField("chars", T.LongType()), T.StructField("section_no", T.IntegerType())])
CLOSED_SECTION = T.StructType([T.StructField("doc_key", T.StringType()), T.StructField("section_no", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("nodes", T.IntegerType()), T.StructField("chars", T.LongType())])


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet table (a folder or one file) as a stream; ``files_per_trigger`` holds back a backlog."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(stream: DataFrame, sink, checkpoint: str) -> None:
    """Run ``sink(batch, batch_id)`` over everything that is there, then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_once(path: str):
    """A sink that writes each batch to its own folder: a batch that is run again replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def section_figures(sections: DataFrame) -> DataFrame:
    """section_id, nodes, chars of sections; no state, so it runs in batches and streams alike."""
    texts = F.transform("nodes", lambda n: F.coalesce(F.length(n["text"]), F.lit(0)))
    return sections.select("summary_id", "section_id", F.size("nodes").alias("n_nodes"), F.aggregate(texts, F.lit(0), lambda a, x: a + x).alias("n_chars"))


def _close(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    title, nodes, chars, number = state.get if state.exists else (None, 0, 0, 0)
    closed = []
    rows = pd.concat(list(batches)).sort_values("pos", kind="stable") if not state.hasTimedOut else pd.DataFrame()
    for r in rows.itertuples():
        nodes, chars = nodes + 1, chars + len(r.text or "")
        if r.is_end:  # the end names the section whose nodes came before it
            number += 1
            closed.append((key[0], number, r.text, nodes, chars))
            nodes, chars = 0, 0
    if state.hasTimedOut:
        if nodes:
            closed.append((key[0], 0, "End of Document", nodes, chars))
        state.remove()
    else:
        state.update((title, nodes, chars, number))
        state.setTimeoutDuration(300_000)
    yield pd.DataFrame(closed, columns=["doc_key", "section_no", "title", "nodes", "chars"])


def closed_sections(nodes: DataFrame) -> DataFrame:
    """Sections of a stream of nodes (doc_key, pos, text, is_end), each emitted when its end arrives.

    The state of a document is its open section's counts; documents silent for five minutes give
    what is left as a last section and are forgotten.
    """
    return nodes.groupBy("doc_key").applyInPandasWithState(_close, CLOSED_SECTION, OPEN_SECTION, "append", "ProcessingTimeTimeout")


class Progress(StreamingQueryListener):
    """Rows, batches and phase of running queries, for progress displays; ``percent`` of a known total."""

    def __init__(self, total: int | None = None) -> None:
        self.total, self.rows, self.batches, self.phase = total, 0, 0, "waiting"

    @property
    def percent(self) -> float | None:
        return None if not self.total else min(100.0, round(100.0 * self.rows / self.total))

    def onQueryStarted(self, event) -> None:
        self.phase = "running"

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryTerminated(self, event) -> None:
        self.phase = "failed" if event.exception else "done"
