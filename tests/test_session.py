import os

import pytest

from tierstone import session


def test_scratch_drops_what_it_made(spark, frame):
    df = frame("a int", 1, 2)
    outside = session.settle(df, "kept")
    with session.scratch(spark):
        inside = session.settle(df, "gone")
        path = inside.inputFiles()[0].removeprefix("file://")
        assert inside.count() == 2 and os.path.exists(path)
    assert not os.path.exists(path)
    assert outside.count() == 2


def test_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.named or default

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        def __init__(self, named, master):
            self.conf, self.sparkContext = Conf(named), Context(master)

    assert session.shared_folder(Session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        session.shared_folder(Session(None, "yarn"))
    own = session.shared_folder(Session(None, "local[2]"))
    assert own == session.shared_folder(Session(None, "local[2]")) and os.path.isdir(own)
