"""Checkpoint folder resolution: read from the session, private folder only for local runs."""
import pytest

from transitio.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Context:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class _Session:
    def __init__(self, master, conf_value=None, current=None):
        self.sparkContext = _Context(master, current)
        self.conf = _Conf(conf_value)


def test_uses_context_folder_first():
    s = _Session("spark://cluster:7077", "/shared/a", "hdfs:///shared/b")
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/b"


def test_conf_only_folder_is_handed_to_the_context():
    s = _Session("spark://cluster:7077", "/shared/ckpt")
    assert ensure_checkpoint_dir(s) == "/shared/ckpt" and s.sparkContext.current == "/shared/ckpt"


def test_unset_on_cluster_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn"))


def test_unset_locally_gets_private_folder():
    s = _Session("local[4]")
    path = ensure_checkpoint_dir(s)
    assert path and s.sparkContext.current == path
