"""The shared folder."""

from types import SimpleNamespace

import pytest

from mailweave.session import files_stamp, shared_folder


def _session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert shared_folder(_session("yarn", spark_checkpoint_dir="hdfs://a/b")) == "hdfs://a/b"
    assert shared_folder(_session("yarn", spark_sql_warehouse_dir="hdfs://w")) == "hdfs://w/scratch"
    assert shared_folder(_session("local[2]", spark_sql_warehouse_dir="/w")) == "/w/scratch"
    for own in ("/w", "file:/w", "file:///w"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(_session("yarn", spark_sql_warehouse_dir=own))


def test_stamps_change_with_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = files_stamp(spark, path)
    assert first == files_stamp(spark, path)
    spark.range(5).write.mode("append").parquet(path)
    assert files_stamp(spark, path) != first
