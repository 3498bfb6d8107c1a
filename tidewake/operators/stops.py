"""Stop detection as windows over a vessel's fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import elapsed_s, haversine_nm
from ..functions.text import reported_activity
from .annotate import ORDER, vessel_order
from .rules import position_unreliable
from .thresholds import Thresholds


def mark_stops(fixes: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Adds seg, stop_no (null outside stops), closed and edge to every fix; one sort by vessel and time serves all.

    A segment ends where coverage does. Slow fixes enter the stopped state and fast ones leave it; others keep it. A
    stop is what lies between leaves. It is closed if a leave follows in its segment. Its start is an edge if it is the
    first fix of all, or after a gap the first fix with a speed.
    """
    w = vessel_order()
    df = fixes.withColumn("_gap", (elapsed_s(F.lag("ts_utc").over(w), F.col("ts_utc")) > th.coverage_gap_s).cast("int"))
    df = df.withColumn("seg", F.coalesce(F.sum("_gap").over(w), F.lit(0)))
    df = df.withColumn("_signal", F.when(F.col("sog_kn") < th.enter_stop_kn, 1).when(F.col("sog_kn") >= th.leave_stop_kn, 0))
    s = Window.partitionBy("mmsi", "seg").orderBy(*ORDER)
    whole = Window.partitionBy("mmsi", "seg")
    df = df.withColumn("_in", F.coalesce(F.last("_signal", ignorenulls=True).over(s), F.lit(0)) == 1)
    df = df.withColumn("_leaves", F.sum(F.when(F.col("_signal") == 0, 1).otherwise(0)).over(s))
    df = df.withColumn("_nth", F.row_number().over(s)).withColumn("_known", F.count("sog_kn").over(s))
    df = df.withColumn("closed", F.max("_leaves").over(whole) > F.col("_leaves"))
    edge = F.when(F.col("seg") == 0, F.col("_nth") == 1).otherwise(F.col("sog_kn").isNotNull() & (F.col("_known") == 1))
    return df.withColumn("edge", edge).withColumn("stop_no", F.when(F.col("_in"), F.col("_leaves"))).drop("_gap", "_signal", "_in", "_leaves", "_nth", "_known")


def detect_stops(fixes: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Stops of all vessels: bounds, counts, geometry over reliable fixes, status, draught ends, first and last fix.

    Kept are stops of two fixes or more, of the least duration, with a reliable fix. Centroid and drift come from
    windows over the stop, within the partitioning by vessel, so no join and no further shuffle is needed.
    """
    df = mark_stops(fixes, th).where("stop_no IS NOT NULL")
    stop = Window.partitionBy("mmsi", "seg", "stop_no")
    df = df.withColumn("reliable", ~position_unreliable())
    df = df.withColumn("_lat", F.avg(F.when(F.col("reliable"), F.col("lat"))).over(stop)).withColumn("_lon", F.avg(F.when(F.col("reliable"), F.col("lon"))).over(stop))
    df = df.withColumn("_drift", F.when(F.col("reliable"), haversine_nm("_lat", "_lon", "lat", "lon")))
    df = df.withColumn("_claims", F.count("*").over(Window.partitionBy("mmsi", "seg", "stop_no", "nav_status")))
    said = F.col("nav_status").isNotNull() & (F.col("nav_status") != "")
    stops = df.groupBy("mmsi", "seg", "stop_no").agg(
        F.first("_lat").alias("centroid_lat"),
        F.first("_lon").alias("centroid_lon"),
        F.max("_drift").alias("max_drift_nm"),
        F.min_by("nav_status", F.when(said, F.struct((-F.col("_claims")).alias("n"), "nav_status"))).alias("reported_status"),
        *stop_figures(),
    )
    return finish_stops(stops, th)


def stop_figures() -> list[Column]:
    """Aggregates of a stop's marked fixes that need no other fix: bounds, counts, how it begins and ends."""
    at, key = F.struct(*ORDER), F.struct("ingest_run_id", "source_line")
    deep = F.when(F.col("draught_m").isNotNull(), at)
    return [
        F.min("ts_utc").alias("started_utc"),
        F.max("ts_utc").alias("ended_utc"),
        F.count("*").alias("fix_count"),
        F.count_if("reliable").alias("reliable_fix_count"),
        F.bool_and("closed").alias("_closed"),
        F.min_by("edge", at).alias("_edge"),
        F.min_by("draught_m", deep).alias("draught_first_m"),
        F.max_by("draught_m", deep).alias("draught_last_m"),
        F.min_by(key, at).alias("first_fix"),
        F.max_by(key, at).alias("last_fix"),
    ]


def finish_stops(stops: DataFrame, th: Thresholds) -> DataFrame:
    """The stops that count, with what follows from their figures."""
    duration = elapsed_s("started_utc", "ended_utc")
    stops = stops.where((F.col("fix_count") >= 2) & (duration >= th.minimum_stop_s) & (F.col("reliable_fix_count") >= 1))
    return stops.select(
        "mmsi", "started_utc", "ended_utc", (duration / 3600.0).alias("duration_hours"), "centroid_lat", "centroid_lon", "max_drift_nm", "fix_count", "reliable_fix_count",
        ((F.col("reliable_fix_count") >= 2) & (2 * F.col("reliable_fix_count") >= F.col("fix_count"))).alias("geometry_trustworthy"),
        "reported_status", (reported_activity(F.col("reported_status")) != "UnderWay").alias("status_agrees"), (F.col("_closed") & ~F.col("_edge")).alias("is_complete"),
        "draught_first_m", "draught_last_m", "first_fix", "last_fix",
    )


def stop_phase(th: Thresholds = Thresholds()):
    """Berth where drift over the root of the hours is small, else Anchorage; Unknown where the geometry is not trusted."""
    hours = F.greatest(F.col("duration_hours"), F.lit(1 / 3600.0))
    return F.when(~F.col("geometry_trustworthy"), "Unknown").when(F.col("max_drift_nm") / F.sqrt(hours) < th.berth_drift_nm_per_root_hour, "Berth").otherwise("Anchorage")
