import os

import pytest
from pyspark.sql import functions as F

from tesserae.session import Scratch, release_all


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)


class Session:
    def __init__(self, **values):
        self.conf = Conf(**values)


@pytest.mark.parametrize("master", ["yarn", "k8s://x", "spark://h:7077", "local-cluster[3,2,1024]", ""])
def test_a_cluster_without_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="checkpoint.dir"):
        Scratch(Session(spark_master=master), "x")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_machine_takes_a_temporary_folder(master):
    assert "tesserae-x-" in Scratch(Session(spark_master=master), "x").root
    assert Scratch(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://f/"), "x").root.startswith("hdfs://f/tesserae-x-")


def test_release_empties_the_folder(spark):
    work = Scratch(spark, "mine")
    rows, n = work.put_counted(spark.range(10).withColumn("x", F.col("id") * 2), "t", F.col("x") > 4)
    assert n == 7 and rows.count() == 10 and os.path.isdir(work.path("t"))
    work.drop("t")
    assert not os.path.exists(work.path("t"))
    work.put(spark.range(3), "u")
    release_all(spark)
    assert not os.path.exists(work.root)
