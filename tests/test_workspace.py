"""Scratch tables go when they are no longer needed, and never to a folder of one machine."""

import os

import pytest

from tessella import workspace


def test_released_deletes_what_was_opened_within(spark):
    outer = workspace.Workspace(spark, "outer")
    outer.save(spark.range(3), "a")
    with workspace.released():
        inner = workspace.Workspace(spark, "inner")
        inner.save(spark.range(3), "b")
        assert os.path.isdir(inner.root)
    assert os.path.isdir(outer.root) and not os.path.exists(inner.root)


def test_everything_goes_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(workspace, "_OPEN", {})
    work = workspace.Workspace(spark, "late")
    work.save(spark.range(3), "a")
    workspace._forget_all()
    assert not os.path.exists(work.root) and not workspace._OPEN


def test_local_warehouse_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}

    with pytest.raises(ValueError):
        workspace.shared_root(Session())
    Session.conf = {"spark.sql.warehouse.dir": "hdfs://name/warehouse"}
    assert workspace.shared_root(Session()) == "hdfs://name/warehouse/_scratch"
