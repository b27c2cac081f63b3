import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from sitecount.llm import common


def session(master, conf=None, checkpoint=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint, setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf or default), sparkContext=context)


def test_a_cluster_has_to_name_the_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "s3://shared/folder/")) == "s3://shared/folder"
    assert os.path.isdir(common.shared_dir(session("local[4]")))


def test_written_tables_are_read_back_and_dropped(spark):
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    with common.scratch() as made:
        table = common.written(df, "numbers", slim=True)
        other = common.written(df.limit(0), "none")
    assert made[0] is table and made[1] is other and table.dtypes == df.dtypes and other.count() == 0
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
    path = table._table.removeprefix("file:")
    assert os.path.isdir(path)
    common.drop(table, other, df)
    assert not os.path.exists(path)


def test_hashes_and_windows_of_equal_runs_are_equal():
    hashes, powers = common.WordHash(limit=2), common.Powers()
    h = hashes.of([b"a", b"b", b"c", b"a", b"b", b"c", b"d"])
    assert len(hashes) <= 2
    got = common.windows(common.prefix(h, powers), 3, powers)
    assert got[0] == got[3] and len(set(got.tolist())) == 4 and len(common.windows(common.prefix(h, powers), 8, powers)) == 0
