from types import SimpleNamespace

import pytest

from pagecorpus import session


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake(master, named=None, folder=None):
    return SimpleNamespace(conf={"spark.checkpoint.dir": named} if named else {}, sparkContext=Context(master, folder))


def test_the_named_folder_wins():
    assert session.shared_dir(fake("yarn", "s3a://shared/")) == "s3a://shared"
    assert session.shared_dir(fake("yarn", folder="hdfs:/c")) == "hdfs:/c"


def test_only_local_masters_get_a_folder_of_their_own():
    assert "spark-" in session.shared_dir(fake("local[2]"))
    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://host:7077"))


def test_freeze_and_size_checked_broadcast(spark):
    frozen = session.freeze(spark.range(10))
    assert sorted(r.id for r in frozen.collect()) == list(range(10))
    hinted = session.broadcast_if_small(frozen, 10)._jdf.queryExecution().logical().toString()
    plain = session.broadcast_if_small(frozen, 9)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


def test_spread_deals_out_only_small_scans(spark):
    assert session.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 8
    assert session.spread(spark.range(0, 100, 1, 20)).rdd.getNumPartitions() == 20
