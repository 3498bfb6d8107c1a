"""Row rules, deduplication and refreshed projections over a stream of feed lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotate import annotate
from ..operators.ingest import NATURAL_KEY, parse
from ..operators.rules import RowRule, judge
from ..operators.stops import detect_stops
from ..sources.feed import with_fields


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Lines of CSV files as they arrive; source_line is null, for a line's place in its file is not known to a stream."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.lit(None).cast("bigint").alias("source_line"), F.col("value").alias("raw_text"))
    return with_fields(raw.where(~F.startswith(F.col("raw_text"), F.lit("# Timestamp")) & (F.col("raw_text") != "")))


def judge_stream(lines: DataFrame, rules: list[RowRule] | None = None) -> DataFrame:
    """The row rules of a batch ingest; they need no state."""
    return judge(parse(lines), rules)


def dedup_stream(judged: DataFrame, delay: str = "2 days") -> DataFrame:
    """Accepted fixes, each natural key once within the watermark."""
    accepted = judged.where("reject IS NULL").withWatermark("ts_utc", delay)
    return accepted.dropDuplicatesWithinWatermark(NATURAL_KEY)


def refresh_stops(log_path: str, stops_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends a batch to the log once, and recomputes stops of the vessels that it touches.

    A batch has a folder of its own, so a batch that runs again after a failure overwrites itself. Stops are kept by
    batch too, and the latest batch of a vessel holds its stops.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("ingest_run_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        touched = spark.read.parquet(f"{log_path}/batch={batch_id}").select("mmsi").distinct()
        log = spark.read.parquet(log_path).where(F.col("batch") <= batch_id).join(touched, "mmsi", "left_semi")
        fixes, _ = annotate(log.withColumn("source_line", F.coalesce("source_line", F.xxhash64("raw_text"))))
        stops = detect_stops(fixes)
        # a vessel without stops is recorded too, or an earlier batch's would stand
        touched.join(stops, "mmsi", "left").write.mode("overwrite").parquet(f"{stops_path}/batch={batch_id}")

    return refresh


def current_stops(spark: SparkSession, stops_path: str) -> DataFrame:
    df = spark.read.parquet(stops_path)
    latest = df.groupBy("mmsi").agg(F.max("batch").alias("batch"))
    return df.join(latest, ["mmsi", "batch"], "left_semi").where("started_utc IS NOT NULL").drop("batch")
