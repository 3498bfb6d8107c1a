"""Registered queries over chunked tracks, streams, zipped days and sections of an export, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollups
from ..operators.chunks import annotate_and_detect, annotate_chunks, chunk_tracks, mark_stops_chunks
from ..operators.export import export
from ..operators.intervals import read_window, write_intervals
from ..operators.ingest import FEED_COLUMNS, ingest, parse
from ..operators.sof import document_windows, select_calls
from ..sources.feed import unpack_zips, write_zips
from ..streaming.feed_stream import dedup_stream, judge_stream, read_stream
from ..streaming.stop_state import StopState
from .demo_feed import SQL_FEED
from .feed import ORACLE_SQL, QUERIES, Feed, query
from .queries import _r, _s, demo_documents
from .store_queries import _store


#: Files of each of the streamed log's parts; a batch takes as many.
ARRIVING_FILES = 16
#: A third of the vessels share one number.
SHARED = "CASE WHEN u % 3 = 0 THEN 999999999 ELSE 200000000 + u END AS mmsi"


def _shared_sql(sql: str) -> str:
    """The feed's SQL with the shared number; ties of one second, which it brings, go by run and line."""
    feed = SQL_FEED.replace("200000000 + u AS mmsi", SHARED)
    for what in ("arg_min(edge, ts)", "arg_min(draught, ts)", "arg_max(draught, ts)"):
        feed = feed.replace(what, what[:-3] + "(ts, run, source_line))")
    return feed + sql


class SharedFeed(Feed):
    """The feed in which a third of the vessels report under one number, so one track holds a third of all fixes."""

    def records(self) -> DataFrame:
        shared = F.when((F.col("mmsi") - 200_000_000) % 3 == 0, 999_999_999).otherwise(F.col("mmsi"))
        return super().records().withColumn("mmsi", shared.cast("bigint"))


_STOP_COLUMNS = "mmsi, started AS started_s, ended AS ended_s, round(clat, 9) AS centroid_lat, round(clon, 9) AS centroid_lon, round(drift, 6) AS max_drift_nm, n AS fix_count, nr AS reliable_fix_count, said AS reported_status, complete AS is_complete, d_first AS draught_first_m, d_last AS draught_last_m"


def _stop_columns(s: DataFrame) -> DataFrame:
    return s.select("mmsi", _s("started_utc").alias("started_s"), _s("ended_utc").alias("ended_s"), _r("centroid_lat", 9).alias("centroid_lat"), _r("centroid_lon", 9).alias("centroid_lon"), _r("max_drift_nm").alias("max_drift_nm"), "fix_count", "reliable_fix_count", "reported_status", "is_complete", "draught_first_m", "draught_last_m")


@query(f"SELECT {_STOP_COLUMNS} FROM stops")
def stops_by_chunks(spark, sf_dir):
    """The stops of all vessels, every track cut into chunks of a dozen fixes."""
    f = Feed(spark, sf_dir)
    return _stop_columns(annotate_and_detect(f.log(), chunk_rows=12, staging=f.staging)[2])


def shared_number_scan(spark, sf_dir):
    """Per vessel and segment of the feed with the shared number: fixes, flagged fixes and fixes in stops, the long track in chunks."""
    log = SharedFeed(spark, sf_dir).log()
    fixes, _ = annotate_chunks(chunk_tracks(log, rows=200))
    marked = mark_stops_chunks(fixes)
    flagged = F.exists("quality_flags", lambda x: x.isin("R7", "R8", "R11"))
    return marked.groupBy("mmsi", "seg").agg(F.count("*").alias("fixes"), F.count_if(flagged).alias("flagged"), F.count("stop_no").alias("in_stops"), F.count_if("closed").alias("closed"), F.count_if("edge").alias("edges"), F.countDistinct("stop_no").alias("stops"))


QUERIES["shared_number_scan"] = shared_number_scan
ORACLE_SQL["shared_number_scan"] = _shared_sql("""
SELECT mmsi, seg_no AS seg, count(*) AS fixes, count(*) FILTER (p7 OR p8 OR p11 OR n7 OR n8 OR n11) AS flagged, count(*) FILTER (state = 1) AS in_stops, count(*) FILTER (closed) AS closed, count(*) FILTER (edge) AS edges, count(DISTINCT leaves) FILTER (state = 1) AS stops
FROM marked GROUP BY ALL""")


# ---- streams


def _csv_folder(f: Feed) -> str:
    """The feed as CSV files of sixteen parts with a header each; a glob over them."""
    part = F.concat(F.lit("part-"), F.pmod("source_line", F.lit(16)).cast("string"))
    rows = f.lines().select(part.alias("part"), "source_line", "raw_text")
    rows = rows.unionByName(rows.select("part").distinct().select("part", F.lit(0).cast("long").alias("source_line"), F.lit("# " + ",".join(FEED_COLUMNS)).alias("raw_text")))
    path = f"{f.staging.root}/csv"
    rows.repartition("part").sortWithinPartitions("part", "source_line").select("part", "raw_text").write.partitionBy("part").text(path)
    return f"{path}/part=*"


@query("SELECT mmsi, count(*) AS fixes, min(ts) AS first_s, max(ts) AS last_s, count(*) FILTER (r5) AS without_speed FROM (SELECT DISTINCT mmsi, ts, lat, lon, r5 FROM judged WHERE reject IS NULL) GROUP BY mmsi")
def streamed_fixes(spark, sf_dir):
    """CSV files read as a stream in several batches, judged, each natural key once."""
    f = Feed(spark, sf_dir)
    kept = dedup_stream(judge_stream(read_stream(spark, _csv_folder(f), files_per_trigger=4)), "30 days").select("mmsi", "ts_utc", "quality_flags")
    out = f"{f.staging.root}/streamed"
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{f.staging.root}/streamed-at").trigger(availableNow=True).start().awaitTermination()
    fixes = spark.read.schema(kept.schema).parquet(out)
    return fixes.groupBy("mmsi").agg(F.count("*").alias("fixes"), F.min(_s("ts_utc")).alias("first_s"), F.max(_s("ts_utc")).alias("last_s"), F.count_if(F.array_contains("quality_flags", "R5")).alias("without_speed"))


@query("SELECT reject AS rule_id, count(*) AS n FROM judged WHERE reject IS NOT NULL GROUP BY 1")
def streamed_rejects(spark, sf_dir):
    """Rows that the row rules refuse on a stream of CSV files."""
    f = Feed(spark, sf_dir)
    refused = judge_stream(read_stream(spark, _csv_folder(f), files_per_trigger=6)).where("reject IS NOT NULL").select(F.col("reject.rule_id").alias("rule_id"))
    out = f"{f.staging.root}/refused"
    refused.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{f.staging.root}/refused-at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(refused.schema).parquet(out).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"SELECT {_STOP_COLUMNS} FROM stops")
def streamed_stops(spark, sf_dir):
    """The stops of the log as it comes in batches by time, from the state of each vessel."""
    f = Feed(spark, sf_dir)
    log, path = f.log(), f"{f.staging.root}/arriving"
    for day in (1, 2, 3):  # the last takes all later days
        since = F.floor((_s("ts_utc") - 1704067200) / 43200)
        part = log.where(since < 1 if day == 1 else since == 1 if day == 2 else since > 1)
        part.repartition(ARRIVING_FILES).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", ARRIVING_FILES).parquet(path)
    state = StopState(spark, f"{f.staging.root}/stop-state", buckets=8)
    arriving.writeStream.foreachBatch(state.update).option("checkpointLocation", f"{f.staging.root}/arriving-at").trigger(availableNow=True).start().awaitTermination()
    return _stop_columns(state.stops())


# ---- archives of days, the development limit, sections of an export


@query("SELECT source_file, count(*) AS n, count(*) FILTER (failure IS NOT NULL) AS failed, 2 AS first_line, count(*) + 1 AS last_line, sum(CASE WHEN failure IS NULL THEN ts END) AS ts_sum FROM (SELECT * REPLACE ('part-' || (source_line % 16) || '.csv' AS source_file) FROM lines) GROUP BY 1")
def zipped_days(spark, sf_dir):
    """The feed as zip archives of CSV files, read back as streams with line numbers and parsed."""
    f = Feed(spark, sf_dir)
    part = F.concat(F.lit("part-"), F.pmod("source_line", F.lit(16)).cast("string"), F.lit(".csv"))
    folder = f"{f.staging.root}/zips"
    write_zips(f.lines().select(part.alias("source_file"), "source_line", "raw_text"), folder if ":/" in folder else f"file://{folder}")
    parsed = parse(unpack_zips(spark, f"{folder}/*.zip", f"{f.staging.root}/unpacked"))
    return parsed.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("parse_failure").isNotNull()).alias("failed"), F.min("source_line").alias("first_line"), F.max("source_line").alias("last_line"), F.sum(F.when(F.col("parse_failure").isNull(), _s("ts_utc"))).alias("ts_sum"))


@query("""SELECT count(*) AS rows_read, count(*) FILTER (reject IS NOT NULL) AS rows_quarantined, count(DISTINCT (mmsi, ts, lat, lon)) FILTER (reject IS NULL) AS rows_inserted, count(*) FILTER (reject IS NULL) - count(DISTINCT (mmsi, ts, lat, lon)) FILTER (reject IS NULL) AS rows_dup_in_file
  FROM judged WHERE source_file = 'day1.csv' AND source_line <= 501""")
def limited_run(spark, sf_dir):
    """A run of the first 500 lines of a file, the limit for development."""
    lines = Feed(spark, sf_dir).lines().where("source_file = 'day1.csv'")
    return ingest(lines, limit=500).counters.select("rows_read", "rows_quarantined", "rows_inserted", "rows_dup_in_file")


def _exported(f: Feed, section: str, schema: str) -> DataFrame:
    """A section of an export, read back from its JSON."""
    export(_store(f, detect=True), f"{f.staging.root}/export", only=[section])
    return f.spark.read.schema(schema).json(f"{f.staging.root}/export/{section}")


def export_ports(spark, sf_dir):
    b = _exported(Feed(spark, sf_dir), "ports", "port_wpi_number int, port_name string, port_country string, attributed_calls bigint, excluded_incomplete bigint, excluded_too_far bigint, usable_calls bigint, median_waiting_hours double, median_working_hours double, p90_waiting_hours double, waiting_hours double")
    return b.withColumn("waiting_sum", F.col("waiting_hours")).drop("waiting_hours").select(*[_r(c).alias(c) if c.endswith(("hours", "sum")) else F.col(c) for c in ("port_wpi_number", "port_name", "port_country", "attributed_calls", "excluded_incomplete", "excluded_too_far", "usable_calls", "median_waiting_hours", "median_working_hours", "p90_waiting_hours", "waiting_sum")])


def export_cargo(spark, sf_dir):
    names = ["with_draught", "without_draught", "discharged", "loaded", "unchanged", "berthed", "berthed_changed"]
    return _exported(Feed(spark, sf_dir), "cargo", ", ".join(f"{n} bigint" for n in names) + ", balanced boolean")


QUERIES |= {"export_ports": export_ports, "export_cargo": export_cargo}
ORACLE_SQL |= {"export_ports": ORACLE_SQL["port_benchmarks"], "export_cargo": ORACLE_SQL["reported_cargo"]}


# ---- daily partials


def _partials(f: Feed) -> dict[str, DataFrame]:
    """Partials written day by day in two goes, the second over days of the first too."""
    log, root = f.log(), f"{f.staging.root}/partials"
    noon = F.timestamp_seconds(F.lit(1704067200 + 86400))
    rollups.write_partials(log.where(F.col("ts_utc") < noon), root)
    rollups.write_partials(log.where(F.col("ts_utc") >= F.timestamp_seconds(F.lit(1704067200))), root)
    return rollups.read_partials(f.spark, root)


def eta_bins_by_days(spark, sf_dir):
    return rollups.eta_horizon(_partials(Feed(spark, sf_dir)))[0]


def destination_counts_by_days(spark, sf_dir):
    return rollups.destination_counts(_partials(Feed(spark, sf_dir)))


def destination_typists_by_days(spark, sf_dir):
    return rollups.destination_typists(_partials(Feed(spark, sf_dir)))


for _name in ("eta_bins", "destination_counts", "destination_typists"):
    QUERIES[f"{_name}_by_days"] = globals()[f"{_name}_by_days"]
    ORACLE_SQL[f"{_name}_by_days"] = ORACLE_SQL[_name]


# ---- intervals by length and start


def _indexed(f: Feed, name: str, df: DataFrame, start: str, end: str) -> DataFrame:
    """What overlaps the second half of the first day, from files laid out by length and start."""
    path = f"{f.staging.root}/{name}-by-days"
    write_intervals(df, path, start, end)
    return read_window(f.spark, path, start, end, "2024-01-01 12:00:00", "2024-01-02 00:00:00", far_edge=True)


def stops_in_window_by_days(spark, sf_dir):
    f = Feed(spark, sf_dir)
    return _indexed(f, "stops", f.stops(), "started_utc", "ended_utc").select("mmsi", _s("started_utc").alias("started_s"))


def calls_in_window_by_days(spark, sf_dir):
    f = Feed(spark, sf_dir)
    return _indexed(f, "calls", f.calls()[0], "arrived_utc", "departed_utc").select("mmsi", _s("arrived_utc").alias("arrived_s"))


def document_calls_by_days(spark, sf_dir):
    c, p = Feed(spark, sf_dir).calls()
    return select_calls(document_windows(demo_documents(c, p)), c, by_days=True).select("doc_id", _s("arrived_utc").alias("arrived_s"), "overlap_s", "rank", "chosen")


for _name in ("stops_in_window", "calls_in_window", "document_calls"):
    QUERIES[f"{_name}_by_days"] = globals()[f"{_name}_by_days"]
    ORACLE_SQL[f"{_name}_by_days"] = ORACLE_SQL[_name]
