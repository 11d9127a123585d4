from __future__ import annotations

import pytest

from playlens import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    """The parts of a session that name the working folder."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_the_named_folder_is_used():
    assert session.work_dir(Fake("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y/app"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(Fake("spark://host:7077"))


def test_a_local_session_may_use_its_own():
    assert session.work_dir(Fake("local[2]")) == session.work_dir(Fake("local[2]"))


def test_paths_are_new():
    fake = Fake("yarn", **{"spark.checkpoint.dir": "s3://b/c"})
    assert session.new_path(fake, "t") != session.new_path(fake, "t")
