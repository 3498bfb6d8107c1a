"""Filtered and ranked listings. The page clamp holds for listings alone; no operator reads through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drift_text, hours_text, port_text

LARGEST_PAGE = 1000


def clamp(limit: int) -> int:
    return min(max(limit, 1), LARGEST_PAGE)


def page(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(rows, more): the page, and whether rows lie beyond it."""
    n = clamp(limit)
    return df.limit(n), df.limit(n + 1).count() > n


def list_stops(stops: DataFrame, *, mmsi: int | None = None, least_hours: float | None = None, complete_only: bool = False, disagreements_only: bool = False, limit: int = 100) -> DataFrame:
    if mmsi is not None:
        stops = stops.where(F.col("mmsi") == mmsi)
    if least_hours is not None:
        stops = stops.where(F.col("duration_hours") >= least_hours)
    if complete_only:
        stops = stops.where("is_complete")
    if disagreements_only:
        stops = stops.where(~F.col("status_agrees"))
    return stops.orderBy(F.desc("duration_hours"), "mmsi", "started_utc").limit(clamp(limit))


def list_calls(calls: DataFrame, *, mmsi: int | None = None, least_waiting_hours: float | None = None, complete_only: bool = False, limit: int = 100) -> DataFrame:
    """Longest first by waiting and working hours; unclassified hours do not rank."""
    if mmsi is not None:
        calls = calls.where(F.col("mmsi") == mmsi)
    if least_waiting_hours is not None:
        calls = calls.where(F.col("waiting_hours") >= least_waiting_hours)
    if complete_only:
        calls = calls.where("is_complete")
    return calls.orderBy((F.col("waiting_hours") + F.col("working_hours")).desc(), "mmsi", "arrived_utc").limit(clamp(limit))


def list_vessels(vessels: DataFrame, ship_type: str | None = None) -> DataFrame:
    """Case matters here, unlike in the scope of an ingest."""
    if ship_type is not None:
        vessels = vessels.where(F.col("ship_type") == ship_type)
    return vessels.orderBy("mmsi")


def vessel(vessels: DataFrame, mmsi: int) -> DataFrame:
    return vessels.where(F.col("mmsi") == mmsi)


def call(calls: DataFrame, mmsi: int, arrived_utc) -> DataFrame:
    return calls.where((F.col("mmsi") == mmsi) & (F.col("arrived_utc") == F.lit(arrived_utc).cast("timestamp")))


def by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of many keys at once."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def track(fixes: DataFrame, from_, to, mmsi: int | None = None) -> DataFrame:
    """Fixes in [from, to) by time. Filters reach the scan; a log partitioned by date is pruned."""
    lo, hi = F.lit(from_).cast("timestamp"), F.lit(to).cast("timestamp")
    df = fixes.where((F.col("ts_utc") >= lo) & (F.col("ts_utc") < hi))
    if "date" in fixes.columns:
        df = df.where((F.col("date") >= F.to_date(lo)) & (F.col("date") <= F.to_date(hi)))
    if mmsi is not None:
        df = df.where(F.col("mmsi") == mmsi)
    return df.orderBy("ts_utc", "ingest_run_id", "source_line")


def stops_in_window(stops: DataFrame, from_, to) -> DataFrame:
    return stops.where((F.col("started_utc") < F.lit(to).cast("timestamp")) & (F.col("ended_utc") >= F.lit(from_).cast("timestamp")))


def calls_of_vessel_in_window(calls: DataFrame, mmsi: int, from_, to) -> DataFrame:
    """Both edges exclusive."""
    return calls.where((F.col("mmsi") == mmsi) & (F.col("arrived_utc") < F.lit(to).cast("timestamp")) & (F.col("departed_utc") > F.lit(from_).cast("timestamp")))


def calls_in_window(calls: DataFrame, from_, to) -> DataFrame:
    """The far edge inclusive, unlike for one vessel."""
    return calls.where((F.col("arrived_utc") < F.lit(to).cast("timestamp")) & (F.col("departed_utc") >= F.lit(from_).cast("timestamp")))


def latest_calls(calls: DataFrame, k: int = 1, complete_only: bool = False) -> DataFrame:
    """The most recent k calls of every vessel."""
    if complete_only:
        calls = calls.where("is_complete")
    n = F.row_number().over(Window.partitionBy("mmsi").orderBy(F.desc("arrived_utc")))
    return calls.withColumn("nth", n).where(F.col("nth") <= k)


def feed_window(vessels: DataFrame) -> DataFrame:
    """When the feed begins and ends, from the small vessel table."""
    return vessels.agg(F.min("first_seen_utc").alias("from_utc"), F.max("last_seen_utc").alias("to_utc"))


def runs(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("id")


def phases_of_calls(phases: DataFrame, keys: DataFrame) -> DataFrame:
    """Phases with their stops for many calls at once, by call and sequence."""
    return by_keys(phases, keys, ["mmsi", "arrived_utc"]).orderBy("mmsi", "arrived_utc", "seq")


def stop_presentation(stops: DataFrame) -> DataFrame:
    """Figures that may be shown: no duration unless complete, no drift unless trusted; a lower bound is marked as one."""
    drift = F.when(F.col("geometry_trustworthy"), F.col("max_drift_nm"))
    return stops.select(
        "mmsi", "started_utc", F.when(F.col("is_complete"), F.col("duration_hours")).alias("duration_hours"), F.col("duration_hours").alias("observed_hours"), drift.alias("max_drift_nm"),
        hours_text(F.col("duration_hours"), F.col("is_complete")).alias("hours_text"), drift_text(drift).alias("drift_text"), F.when(F.col("is_complete"), "").otherwise("(open)").alias("marker"),
    )


def call_presentation(calls: DataFrame) -> DataFrame:
    """A call's port as it may be shown."""
    return calls.select("mmsi", "arrived_utc", port_text(F.col("port_name"), F.col("port_distance_nm"), F.col("plausibly_at_port")).alias("port_text"), F.when(F.col("is_complete"), "").otherwise("(open)").alias("marker"))
