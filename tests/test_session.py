"""Session helpers: shared checkpoint folder."""

import pytest

from larder.session import shared_dir


def test_shared_dir_reads_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "lag") == root.rstrip("/") + "/lag"


def test_shared_dir_is_never_made_up():
    class Ctx:
        master = "spark://cluster:7077"

    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeSession:
        conf = FakeConf()
        sparkContext = Ctx()

    with pytest.raises(RuntimeError):
        shared_dir(FakeSession())
