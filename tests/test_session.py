import pytest

from voxdesk import session


class FakeContext:
    def __init__(self, master, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


class FakeSession:
    def __init__(self, master, setting=None):
        self.sparkContext = FakeContext(master)
        self.setting = setting

    @property
    def conf(self):
        return self

    def get(self, key, default=None):
        return self.setting if key == session.CHECKPOINT_CONF else default


def test_the_cluster_setting_is_used():
    spark = FakeSession("yarn", "hdfs://shared/folder/")
    path = session.shared_dir(spark, "scores")
    assert path.startswith("hdfs://shared/folder/scores-")
    assert path != session.shared_dir(spark, "scores")
    assert spark.sparkContext.checkpoint == "hdfs://shared/folder/"


def test_a_cluster_without_the_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(FakeSession("yarn"))


def test_a_local_session_gets_its_own_folder():
    spark = FakeSession("local[2]")
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.checkpoint
    assert session.shared_dir(spark, "x").startswith(spark.sparkContext.checkpoint)
