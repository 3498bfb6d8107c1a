"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Stagings whose tables a result may still read; they go when the process ends.
_open: list[Staging] = []


@atexit.register
def _clear_all() -> None:
    for staging in list(_open):
        if staging.spark.sparkContext._jsc is not None:
            staging.clear()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a temporary one serves, but only for a local master: other executors would not see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))


class Staging:
    """Parquet tables of one job. A written table is computed once, however often it is read, and cuts lineage: a lost executor costs its running tasks alone.

    A lazy result reads them after the job has returned it, so tables under the shared folder are deleted when the process ends, if not before.
    """

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        if root is None:
            _open.append(self)
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes all tables; only when no DataFrame reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in _open:
            _open.remove(self)
