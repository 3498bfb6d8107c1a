"""Operator 6: line deduplication against levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Workspace, ascii_lower, partitions

_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


class HashRuns:
    """Sorted runs of line hashes, bucketed by hash, in levels.

    Every run is a table bucketed by the hash, so a batch is shuffled once and then merge-anti-joined with each run
    where it lies. A level of `fanout` runs is compacted into one run of the next level. Runs hold disjoint hashes,
    so compaction is a union that is sorted again. Runs lie in a folder of their own under `root`, and the session's catalog
    knows them only until close(); the warehouse holds none of them.
    """

    def __init__(self, spark: SparkSession, fanout: int, buckets: int, root: str):
        self.spark, self.fanout, self.buckets, self.root = spark, fanout, buckets, root
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        keys.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def seen(self, keys: DataFrame) -> DataFrame:
        """keys with a column `old`: in one of the runs."""
        old = F.lit(False)
        for i, run in enumerate(self.tables()):
            keys = keys.join(run.select("h1", "h2", F.lit(True).alias(f"_in{i}")), ["h1", "h2"], "left")
            old = old | F.col(f"_in{i}").isNotNull()
        return keys.withColumn("old", old).drop(*[f"_in{i}" for i in range(len(self.tables()))])

    def add(self, keys: DataFrame) -> None:
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(keys))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for t in old[1:]:
                merged = merged.unionByName(self.spark.table(t))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            self.levels[level] = []
            for t in old:
                self._drop(t)
            level += 1

    def close(self) -> None:
        for level in self.levels:
            for t in level:
                self._drop(t)
        self.levels = []


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops each line whose key stands in a document of smaller id; returns all input columns, the text without those lines, n_lines and n_dropped.

    Documents are taken in batches by id. A batch's line keys are reduced to (hash, first holder, last holder) before
    any join, anti-joined with the runs of earlier batches, and its new keys become a run. What drops is a key that a
    run has, or a new key in another document than its first holder. Keys shorter than min_chars never drop.
    Only hashes and positions move for that; the texts are shuffled once, to meet the positions that they lose.

    Null or empty text: one empty line. Repeated rows of one id count as one document and all keep their lines. A null
    id stands for one last document. Extra columns are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "lines")
    own = docs.withColumn("_tw_id", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn("_tw_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_tw_row", F.xxhash64("_tw_text"))
    lines = own.select("_tw_id", "_tw_row", F.posexplode(F.split("_tw_text", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    # two hashes of different seeds: 128 bits
    lines = space.save(lines.select(F.col("_tw_id").alias("d"), F.col("_tw_row").alias("r"), "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "hashes")
    cuts = [c for c in (lines.agg(F.percentile_approx("d", [i / batches for i in range(1, batches)], 10000).alias("q")).first()["q"] or [])] if batches > 1 else []
    cuts = sorted(set(cuts))
    runs = HashRuns(spark, fanout, partitions(spark), f"{space.root}/runs")
    drops = []
    try:
        for i in range(len(cuts) + 1):
            batch = lines
            if i > 0:
                batch = batch.where(F.col("d") > cuts[i - 1])
            if i < len(cuts):
                batch = batch.where(F.col("d") <= cuts[i])
            keys = batch.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
            keys = space.save(runs.seen(keys), f"keys-{i}")
            losing = keys.where(F.col("old") | (F.col("first") < F.col("last"))).select("h1", "h2", F.when(~F.col("old"), F.col("first")).alias("keeper"))
            hit = batch.join(losing, ["h1", "h2"]).where(F.col("keeper").isNull() | (F.col("d") != F.col("keeper")))
            drops.append(space.save(hit.select("d", "r", "pos"), f"drops-{i}"))
            if i < len(cuts):
                runs.add(keys.where(~F.col("old")).select("h1", "h2"))
            space.drop(keys)
    finally:
        runs.close()
    space.drop(lines)
    lost = drops[0]
    for d in drops[1:]:
        lost = lost.unionByName(d)
    lost = lost.groupBy(F.col("d").alias("_tw_d"), F.col("r").alias("_tw_r")).agg(F.collect_set("pos").alias("_tw_lost"))
    joined = own.join(lost.hint("shuffle_hash"), (F.col("_tw_id") == F.col("_tw_d")) & (F.col("_tw_row") == F.col("_tw_r")), "left")
    parts = F.split("_tw_text", "\n")
    # what stays lies between the lost positions: linear, however many lines a document has
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_tw_sorted"), i - 1) + 1)
    end = lambda i: F.when(i == F.size("_tw_sorted"), F.size("_tw_parts")).otherwise(F.get(F.col("_tw_sorted"), i))
    stretches = F.transform(
        F.sequence(F.lit(0), F.size("_tw_sorted")),
        lambda i: F.struct((end(i) - begin(i)).alias("n"), F.array_join(F.slice(F.col("_tw_parts"), begin(i) + 1, end(i) - begin(i)), "\n").alias("s")),
    )
    kept = F.array_join(F.transform(F.filter(stretches, lambda x: x["n"] > 0), lambda x: x["s"]), "\n")
    shaped = joined.withColumn("_tw_parts", parts).withColumn("_tw_sorted", F.array_sort("_tw_lost"))
    out = shaped.withColumn("_tw_kept", F.when(F.col("_tw_lost").isNull(), F.col("_tw_text")).otherwise(kept))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.col("_tw_kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.size("_tw_parts").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("_tw_lost")), F.lit(0)).cast("long").alias("n_dropped"),
    )
