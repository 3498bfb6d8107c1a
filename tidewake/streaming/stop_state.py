"""Stops of a stream by keyed state: a batch reads its own fixes and the state of its vessels, not the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.annotate import ORDER
from ..operators.chunks import PREV, annotate_chunks, mark_stops_chunks, stops_of_marks
from ..operators.ingest import POSITION_COLUMNS
from ..operators.rules import PairRule
from ..operators.thresholds import Thresholds
from ..sources.staging import Staging

#: State of a vessel before the fixes of its tail.
CARRIED = ["prev", "seg", "n", "known", "leaves", "signal"]


class StopState:
    """Stops that grow with a stream of accepted fixes.

    A vessel's state is its tail (the fixes of the stop that it is in, or its last fix alone), what the scan of its track
    has come to before the tail, and its unfinished stop. A batch is scanned behind the tails of its vessels alone. What
    it finishes is written once and never again; the tail, the carried state and the unfinished stop are replaced.

    States lie in buckets by vessel, a version for each batch that touches the bucket, so a batch reads and writes
    only the buckets of its vessels. A vessel whose batch holds a fix before its last one is scanned anew from the log, and
    its finished stops of earlier batches no longer count. A batch that runs again after a failure starts from
    the versions before it and overwrites its own files.
    """

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64, th: Thresholds = Thresholds(), rules: list[PairRule] | None = None):
        self.spark, self.root, self.buckets, self.th, self.rules = spark, root.rstrip("/"), buckets, th, rules

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, list[int]]:
        """Batches that have written each bucket, in order."""
        path, fs = self._path("state/bucket=*/batch=*/_SUCCESS")
        found: dict[int, list[int]] = {}
        for s in fs.globStatus(path) or []:
            bucket, batch = s.getPath().toString().split("bucket=")[1].split("/")[:2]
            found.setdefault(int(bucket), []).append(int(batch.split("=")[1]))
        return {b: sorted(v) for b, v in found.items()}

    def _states(self, below: int, buckets: list[int] | None = None) -> DataFrame | None:
        """The latest states of batches before `below`."""
        paths = []
        for bucket, versions in self._versions().items():
            old = [v for v in versions if v < below]
            if old and (buckets is None or bucket in buckets):
                paths.append(f"{self.root}/state/bucket={bucket}/batch={old[-1]}")
        return self.spark.read.parquet(*paths) if paths else None

    def bucket(self):
        return F.pmod(F.xxhash64("mmsi"), F.lit(self.buckets)).cast("int")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: accepted fixes with the columns of the log, but for run and line where a stream has none."""
        spark = self.spark
        staging = Staging(spark, "stops", f"{self.root}/_staging/batch-{batch_id}")
        line = F.coalesce("source_line", F.xxhash64("raw_text")) if "raw_text" in batch.columns else F.col("source_line")
        new = batch.withColumn("source_line", line).withColumn("ingest_run_id", F.lit(batch_id).cast("bigint")).select(*POSITION_COLUMNS)
        new.write.mode("overwrite").parquet(f"{self.root}/log/batch={batch_id}")
        new = spark.read.schema(new.schema).parquet(f"{self.root}/log/batch={batch_id}")
        touched = [r[0] for r in new.select(self.bucket()).distinct().collect()]
        states = self._states(batch_id, touched)
        late, fixes, before = None, new, None
        if states is not None:
            first = new.groupBy("mmsi").agg(F.min("ts_utc").alias("_first"))
            held = staging.save(states.join(first, "mmsi").withColumn("late", F.col("_first") < F.element_at("tail", -1)["ts_utc"]), "held")
            on_time = held.where("NOT late")
            before = on_time.where("n IS NOT NULL").select("mmsi", *CARRIED)
            fixes = new.unionByName(on_time.select(F.inline("tail")).select(*POSITION_COLUMNS))
            late = held.where("late").select("mmsi")
            if late.isEmpty():
                late = None
            else:  # their whole tracks; the batch's own fixes are in the log by now
                log = spark.read.schema(new.schema).option("basePath", f"{self.root}/log").parquet(*[f"{self.root}/log/batch={b}" for b in self._batches(batch_id)])
                fixes = fixes.join(late, "mmsi", "left_anti").unionByName(log.join(late, "mmsi", "left_semi").select(*POSITION_COLUMNS))
        fixes, _ = annotate_chunks(fixes.withColumn("chunk", F.lit(0).cast("long")), self.rules, before)
        marked = staging.save(mark_stops_chunks(fixes, self.th, before, keep=True), "marked")
        stops = staging.save(stops_of_marks(marked, self.th), "found")
        last = marked.groupBy("mmsi").agg(F.max_by(F.struct("ingest_run_id", "source_line", "seg", "stop_no"), F.struct(*ORDER)).alias("last"))
        key = F.struct("last.ingest_run_id", "last.source_line")
        found = stops.join(last.select("mmsi", key.alias("_last")), "mmsi").withColumn("_open", F.col("last_fix") == F.col("_last")).drop("_last")
        done = found.where("NOT _open").drop("_open").withColumn("reset", F.lit(False))
        if late is not None:  # one row more says from which batch on a vessel's stops count
            done = done.unionByName(late.withColumn("reset", F.lit(True)), allowMissingColumns=True)
        done.write.mode("overwrite").parquet(f"{self.root}/finished/batch={batch_id}")
        self._write_states(batch_id, touched, states, marked, last, found.where("_open").drop("_open"), before)
        self._forget(batch_id, touched)
        staging.clear()

    def _write_states(self, batch_id: int, touched: list[int], states: DataFrame | None, marked: DataFrame, last: DataFrame, unfinished: DataFrame, before: DataFrame | None) -> None:
        w = Window.partitionBy("mmsi").orderBy(*ORDER)
        prev = F.lag(F.struct(*PREV)).over(w)
        own = marked.withColumn("_prev", prev)
        if before is not None:
            own = own.join(before.select("mmsi", F.col("prev").alias("_held")), "mmsi", "left").withColumn("_prev", F.coalesce("_prev", "_held"))
        in_stop = (F.col("seg") == F.col("last.seg")) & (F.col("stop_no") == F.col("last.stop_no"))
        is_last = (F.col("ingest_run_id") == F.col("last.ingest_run_id")) & (F.col("source_line") == F.col("last.source_line"))
        tail = own.join(last, "mmsi").where(F.coalesce(in_stop, is_last))
        # what stands before the tail's first fix
        opens = (F.col("_nth") == 1) & (F.col("seg") > 0)
        carried = F.struct(
            F.col("_prev").alias("prev"), (F.col("seg") - opens.cast("long")).alias("seg"), (F.col("_nth") - 1).alias("n"), (F.col("_known") - F.col("sog_kn").isNotNull().cast("long")).alias("known"),
            (F.col("_leaves") - F.coalesce(F.col("_signal") == 0, F.lit(False)).cast("long")).alias("leaves"), F.col("_signal_before").alias("signal"),
        )
        fix = F.struct(*ORDER, *[c for c in POSITION_COLUMNS if c not in ORDER])
        new = tail.groupBy("mmsi").agg(F.array_sort(F.collect_list(fix)).alias("tail"), F.min_by(carried, F.struct(*ORDER)).alias("c"))
        # a track's very first fix has nothing before it
        known = F.col("c.prev").isNotNull()
        new = new.select("mmsi", "tail", *[F.when(known, F.col(f"c.{c}")).alias(c) for c in CARRIED])
        new = new.join(unfinished.select("mmsi", F.struct(*[c for c in unfinished.columns if c != "mmsi"]).alias("stop")), "mmsi", "left")
        if states is not None:
            new = new.unionByName(states.select(*new.columns).join(new.select("mmsi"), "mmsi", "left_anti"))
        new = new.withColumn("bucket", self.bucket())
        path = f"{self.root}/_staging/batch-{batch_id}/states"
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        for bucket in touched:
            target, fs = self._path(f"state/bucket={bucket}/batch={batch_id}")
            source, _ = self._path(f"_staging/batch-{batch_id}/states/bucket={bucket}")
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            fs.rename(source, target)
            fs.create(self._path(f"state/bucket={bucket}/batch={batch_id}/_SUCCESS")[0]).close()

    def _batches(self, upto: int) -> list[int]:
        path, fs = self._path("log/batch=*/_SUCCESS")
        found = [int(s.getPath().toString().split("batch=")[1].split("/")[0]) for s in fs.globStatus(path) or []]
        return sorted(b for b in found if b <= upto)

    def _forget(self, batch_id: int, touched: list[int]) -> None:
        """The version before the batch's stays, for the batch may run again."""
        for bucket, versions in self._versions().items():
            for v in [v for v in versions if v < batch_id][:-1] if bucket in touched else []:
                path, fs = self._path(f"state/bucket={bucket}/batch={v}")
                fs.delete(path, True)

    def stops(self) -> DataFrame:
        """All stops of the stream so far: finished ones, and the unfinished one of each vessel."""
        done = self.spark.read.parquet(f"{self.root}/finished")
        since = done.where("reset").groupBy("mmsi").agg(F.max("batch").alias("_since"))
        done = done.where("NOT reset").join(since, "mmsi", "left").where(F.col("_since").isNull() | (F.col("batch") >= F.col("_since"))).drop("_since", "reset", "batch")
        return done.unionByName(self._states(1 << 62).where("stop IS NOT NULL").select("mmsi", "stop.*"))


def keyed_stops(spark: SparkSession, root: str, **options) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function."""
    return StopState(spark, root, **options).update
