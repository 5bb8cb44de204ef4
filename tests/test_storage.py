"""Where intermediate tables lie."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from plumbline import storage


def session(master: str, root: str | None = None):
    conf = SimpleNamespace(get=lambda key, default=None: root)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(session(master))
    assert storage.shared_folder(session(master, "hdfs://x/shared")).startswith("hdfs://x/shared/plumbline-")
    storage._made.clear()


def test_a_local_master_has_its_own_folder():
    a, b = (storage.shared_folder(session("local[4]")) for _ in range(2))
    assert a != b and a.startswith("file:///")
    storage._made.clear()


def test_clean_removes_what_was_stored(spark):
    storage._made.clear()
    folder = storage.shared_folder(spark)
    df = storage.stored(spark.range(5), folder, "five")
    assert df.count() == 5
    storage.clean(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    assert storage._made == []
