from __future__ import annotations

import zipfile
from pathlib import Path
from types import SimpleNamespace

import pytest

from gridloom import session


def test_folder_and_tables(spark):
    folder = session.shared_folder(spark)
    assert session.shared_folder(spark) == folder and session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    df = session.write_through(spark.range(5), "five")
    assert df.count() == 5 and "gridloom" in df.inputFiles()[0]
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    session.remove_path(spark, path)
    assert not Path(path.removeprefix("file://")).exists()


def test_package_is_shipped_once(spark, monkeypatch):
    sent = []
    monkeypatch.delenv("PYTHONPATH", raising=False)
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    session.ship_package(spark)
    session.ship_package(spark)
    assert len(sent) == 1 and "gridloom/session.py" in zipfile.ZipFile(sent[0]).namelist()
    monkeypatch.setenv("PYTHONPATH", str(Path(session.__file__).resolve().parents[1]))
    monkeypatch.setattr(session, "_SHIPPED", set())
    session.ship_package(spark)
    assert len(sent) == 1


def test_cluster_must_name_its_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf), conf=conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)


def test_scratch_is_removed(spark):
    df = session.write_through(spark.range(3), "three")
    folder = Path(session.scratch_folder(spark).removeprefix("file://"))
    assert df.count() == 3 and any(folder.iterdir())
    session.remove_scratch(spark)
    assert not folder.exists()
