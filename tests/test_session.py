import pytest

from curvekit import session


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, named, master):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = FakeContext(master)


def test_the_named_folder_is_used():
    assert session.scratch_root(FakeSession("hdfs:///shared/", "yarn")) == "hdfs:///shared"


def test_a_temporary_folder_only_on_a_local_master():
    local = FakeSession(None, "local[2]")
    assert session.scratch_root(local) == session.scratch_root(local)
    with pytest.raises(ValueError):
        session.scratch_root(FakeSession(None, "yarn"))


def test_materialize_keeps_schema_and_rows(spark, rows):
    df = spark.createDataFrame([(1, [0.5], {"k": 1.0})], "a int, b array<double>, c map<string,double>")
    written = session.materialize(df, "test")
    assert written.schema == df.schema
    assert written.first() == df.first()
    assert session.materialize(df.where("false"), "test").count() == 0
