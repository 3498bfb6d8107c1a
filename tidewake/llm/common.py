"""Shared helpers of the training-data operators: tables in the shared folder, words and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of other characters.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE}]+"
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a temporary one serves, but only for a local master: other executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder as Parquet.

    A written table cuts lineage: a lost executor costs its running tasks, not the stages before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.tidewake_path = path  # type: ignore[attr-defined]
        return out

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.remove(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of save() that no returned DataFrame reads any more."""
        self._delete(df.tidewake_path)

    def finish(self, df: DataFrame) -> DataFrame:
        """df as a table of its own; all other tables go."""
        old = list(self.paths)
        out = self.save(df, "result")
        for path in old:
            self._delete(path)
        return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_rest(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Spark's own lower() does just that where every character is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def text_groups(ids: list, texts: list, limit: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Rows in groups of about limit characters, so that a numpy pass over a group has bounded memory."""
    a: list = []
    b: list = []
    size = 0
    for i, t in zip(ids, texts):
        if a and size + len(t or "") > limit:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(t or "")
        size += len(t or "")
    if a:
        yield a, b
