from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators.export import write_markdown
from gridloom.sources import documents as dc
from gridloom.sources import ingestion
from gridloom.streaming import sections as st


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_text("  Xin chào \n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.docx").write_bytes(b"\xff\x80\x00")
    (tmp_path / "d.pdf").write_text(" \n")
    files = dc.read_files(spark, str(tmp_path))
    wanted = files.select("path").unionByName(spark.createDataFrame([("/none.pdf",)], "path string"))
    got = {r.source_path.rsplit("/", 1)[1]: r for r in dc.process_documents(dc.missing_files(wanted, files)).collect()}
    assert got["a.PDF"].markdown == "# a.PDF\n\nXin chào\n\n" and got["a.PDF"].total_pages == 1 and got["a.PDF"].error_code is None
    assert got["b.txt"].error_code == "UnsupportedFormat" and got["b.txt"].markdown is None
    assert "binary content" in got["c.docx"].markdown and got["d.pdf"].markdown == "# d.pdf\n\n"
    assert got["none.pdf"].error_code == "IoError"
    assert len(got["a.PDF"].id) == 16


def test_size_limit(spark):
    rows = [("/a.pdf", dc.MAX_BYTES, b""), ("/b.pdf", dc.MAX_BYTES + 1, b""), ("/c.xls", dc.MAX_BYTES + 1, b""), (None, None, None)]
    df = dc.error_messages(dc.scan_errors(spark.createDataFrame(rows, "path string, length long, content binary")))
    assert [r.error_code for r in df.collect()] == [None, "FileTooLarge", "UnsupportedFormat", "IoError"]
    assert df.where("error_code = 'IoError'").first().message == dc.ERRORS["IoError"]


def test_registry(spark):
    registry = dc.Registry(spark, "test_registry")
    registry.put(spark.createDataFrame([("1", "old", None), ("2", "two", None)], "id string, markdown string, error_code string"))
    registry.put(spark.createDataFrame([("1", "new", None)], "id string, markdown string, error_code string"))
    got = {r.id: (r.markdown, r.error_code) for r in registry.get(spark.createDataFrame([("1",), ("3",)], "id string")).collect()}
    assert got == {"1": ("new", None), "3": (None, "IoError")}


def test_write_markdown(spark, tmp_path):
    write_markdown(spark.createDataFrame([("# A\n\ntext",)], "markdown string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value.startswith("# A")


def test_stream_of_files(spark, tmp_path):
    schema = "summary_id string, section_id long, nodes array<struct<kind string, text string>>"
    for k in range(3):
        spark.createDataFrame([("d", k, [("Paragraph", "ab"), ("Fragment", None)])], schema).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    progress = st.Progress()
    spark.streams.addListener(progress)
    st.run_available(st.section_figures(stream), st.append_once(str(tmp_path / "out")), str(tmp_path / "check"))
    spark.streams.removeListener(progress)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.section_id, r.n_nodes, r.n_chars) for r in got) == [(0, 2, 2), (1, 2, 2), (2, 2, 2)]


def test_closed_sections(spark, tmp_path):
    schema = "doc_key string, pos long, text string, is_end boolean"
    source = tmp_path / "nodes"
    rows = [("d", 1, "abc", False), ("d", 2, "One", True), ("d", 3, "x", False), ("e", 1, "Only", True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    stream = st.closed_sections(spark.readStream.schema(schema).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    # with a processing-time timeout a query always has another batch to run, so it never says it is done
    for _ in range(60):
        time.sleep(0.5)
        if spark.table("closed").count() == 2:
            break
    query.stop()
    got = sorted((r.doc_key, r.section_no, r.title, r.nodes, r.chars) for r in spark.table("closed").collect())
    assert got == [("d", 1, "One", 2, 6), ("e", 1, "Only", 1, 4)]


def test_close_by_timeout():
    class State:
        exists, get, hasTimedOut, removed = True, (None, 2, 7, 3), True, False

        def remove(self):
            self.removed = True

    state = State()
    out = pd.concat(list(st._close(("d",), iter([]), state)))
    assert out.values.tolist() == [["d", 0, "End of Document", 2, 7]] and state.removed


def test_figures_of_null_nodes(spark):
    df = spark.createDataFrame([("d", 1, None)], "summary_id string, section_id long, nodes array<struct<kind string, text string>>")
    assert st.section_figures(df).select(F.coalesce("n_chars", F.lit(-1)).alias("n")).first().n == -1


def test_ingestion_records(spark):
    import json

    good = {"source": "a", "document_type": "BOQ_RAW", "schema_version": "1", "checksum": "sha256:" + "0" * 64, "origin_signature": "ed25519:" + "a" * 128, "extraction_meta": {"engine": "calamine", "engine_version": "1.2", "timestamp": "2026-01-10T10:46:54Z"}}
    rows = {
        "good": good,
        "more": {**good, "extra": [1], "pages": [{"page": 1, "content_type": "text"}], "validation_warnings": [{"code": "LOW_CONFIDENCE", "message": "m"}]},
        "source": {**good, "source": "b"},
        "pages": {**good, "pages": [{"page": 1, "content_type": "text", "confidence": 1.5}]},
        "validation_warnings": {**good, "validation_warnings": [{"code": "OTHER", "message": "m"}]},
        "extraction_meta missing": {k: v for k, v in good.items() if k != "extraction_meta"},
        "origin_signature": {**good, "origin_signature": "ed25519:zz"},
    }
    texts = [(k, json.dumps(v)) for k, v in rows.items()] + [("null", None), ("empty", ""), ("list", "[]"), ("cut", '{"source": "a"')]
    df = spark.createDataFrame(texts, "name string, json string").withColumns({"rejections": F.lit("mine"), "record": F.lit(1)})
    got = {r.name: r.rejections for r in ingestion.validate_records(df, source="a", schema_version="1").collect()}
    assert got["good"] == got["more"] == []
    assert all(got[k] == [k] for k in rows if k not in ("good", "more"))
    assert all(got[k] == ["record"] for k in ("null", "empty", "list", "cut"))
    assert ingestion.validate_records(df.limit(0)).count() == 0


def test_skipped_pages(spark):
    pages = spark.createDataFrame([("a", 1, "two", False), ("a", 0, "one", False), ("a", 2, "lost", True), ("b", 0, None, False), ("c", 0, None, True)], "summary_id string, page int, text string, failed boolean")
    got = {r.summary_id: (r.markdown, r.pages, r.skipped) for r in ingestion.skipped_pages(pages).collect()}
    assert got == {"a": ("one\n\ntwo\n\n[OCR_FAILED_PAGE_3]", 3, 1), "b": ("", 1, 0), "c": ("[OCR_FAILED_PAGE_1]", 1, 1)}


def test_progress_of_a_known_total():
    from types import SimpleNamespace

    progress = st.Progress(total=200)
    assert (progress.percent, progress.phase) == (0.0, "waiting")
    progress.onQueryStarted(None)
    progress.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=50)))
    assert (progress.percent, progress.phase, progress.batches) == (25.0, "running", 1)
    progress.onQueryTerminated(SimpleNamespace(exception=None))
    assert progress.phase == "done" and st.Progress().percent is None
