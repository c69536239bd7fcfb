"""The folder for tables on the way: what is deleted, and where it lies if no folder is named."""

import os

import pytest

from quillstream.llm import common


class Conf(dict):
    """A session's settings that refuse to be changed, as Spark's do for spark.checkpoint.dir."""

    set = None


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    names = lambda: [x.split("-")[0] for x in os.listdir(tmp_path)]
    out = common.settle(spark, lambda: common.materialise(spark.range(5), "passing").filter("id > 1"), "kept")
    assert out.count() == 3 and names() == ["kept"]
    with pytest.raises(ZeroDivisionError):
        common.settle(spark, lambda: common.materialise(spark.range(5), "passing").limit(1 // 0), "failed")
    assert names() == ["kept"]


def test_folder_is_the_sessions_or_local():
    assert common.shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    here = common.shared_dir(Session(spark_master="local[2]"))
    assert here.startswith("file://") and here == common.shared_dir(Session(spark_master="local[2]"))
    with pytest.raises(RuntimeError):
        common.shared_dir(Session(spark_master="yarn"))
