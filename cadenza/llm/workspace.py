"""Tables in the shared folder: written once, read by later jobs, safe against lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in single-process local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="cadenza-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


class Workspace:
    """A folder of Parquet tables for one run of one operator.

    ``save`` cuts lineage: what it returns reads files, so a lost executor costs no recomputation.
    Tables that no later step needs go with ``drop``; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def save(self, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        df.write.option("compression", compression).parquet(self.path(label))
        return self.load(label, df)

    def load(self, label: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(label))

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *labels: str) -> None:
        for label in labels:
            self._delete(self.path(label))

    def settle(self) -> None:
        """Has Spark delete the shuffle files of finished jobs, which stay until the driver's JVM collects their plans."""
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session has ended; its own cleaner removes the folder
            pass
