"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults this engine is tested with; on a cluster pass its own settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tesserae")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - a stopped session leaves the folder to its owner
        pass


#: Scratch folders not yet released.
_open: list[Scratch] = []


class Scratch:
    """Tables written to the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and all runs on one machine (a local
    master, as in tests) a temporary folder is made; on a cluster an unset folder is an error, for executors do not see
    each other's disks. Written tables cut the lineage: a lost executor costs a re-read, never a recomputation of an
    iterative plan. ``drop`` removes a table that no later plan reads, ``release`` the whole folder; what is left goes
    when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(\[[^]]*\])?", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            base = tempfile.mkdtemp(prefix="tesserae-")
        self.root = f"{base.rstrip('/')}/tesserae-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, self.root)
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def put_counted(self, df: DataFrame, name: str, where: Column | None = None) -> tuple[DataFrame, int]:
        """Write, read back, and give the number of rows, or of those that meet ``where``, all in one job."""
        from pyspark.sql import Observation

        seen = Observation()
        back = self.put(df.observe(seen, (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n")), name)
        return back, int(seen.get["n"])

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))

    def release(self) -> None:
        _delete(self.spark, self.root)


def release_all(spark: SparkSession) -> None:
    """Remove every scratch folder of this process, once the results that read them have been written."""
    while _open:
        _open.pop().release()
