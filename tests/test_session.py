from types import SimpleNamespace

import pytest

from sieveline.session import shared_folder


def session(folder, master):
    conf = SimpleNamespace(get=lambda name, default=None: folder if name == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_is_the_one_the_cluster_names():
    path = shared_folder(session("hdfs://nn/shared", "yarn"), "index")
    assert path.startswith("hdfs://nn/shared/index-")
    assert path != shared_folder(session("hdfs://nn/shared", "yarn"), "index")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(None, "yarn"), "index")
    assert "/sieveline-" in shared_folder(session(None, "local[4]"), "index")
