from types import SimpleNamespace

import pytest

from tickloom.llm import common


def session(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_folder():
    assert common.shared_folder(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    own = common.shared_folder(session(None, "local[4]"))
    assert own.startswith("file:///") and common.shared_folder(session(None, "local[4]")) == own
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_folder(session(None, master))


def test_staged_tables_go(spark):
    staged = common.stage(spark.range(3), "three")
    assert staged.count() == 3
    common.unstage(staged)
    with pytest.raises(Exception):
        staged.count()


def test_unused_names(spark):
    assert common.unused(spark.createDataFrame([(1, 2)], "A int, _a int"), "a", "b") == ["__a", "b"]
