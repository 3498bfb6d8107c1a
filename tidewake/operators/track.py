"""The fleet at an instant, and the ship's log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import elapsed_s, heading_arrow
from ..functions.text import citation
from .annotate import ORDER, vessel_order
from .rules import is_flagged, position_unreliable
from .thresholds import Thresholds


def vessel_name(name: Column, mmsi: Column) -> Column:
    return F.when(F.trim(name) != "", F.trim(name)).otherwise(F.format_string("MMSI %d", mmsi))


def in_stop(fixes: DataFrame, stops: DataFrame) -> DataFrame:
    """Fixes with the stop that they lie in, edges included; the first by start. Equi join on the vessel, spread further by hour.

    A stop stands in every hour that it touches, so a long history of one vessel does not meet all its stops.
    """
    hours = stops.withColumn("hour", F.explode(F.sequence(F.floor(F.unix_seconds("started_utc") / 3600), F.floor(F.unix_seconds("ended_utc") / 3600))))
    hours = hours.select("mmsi", "hour", F.struct("started_utc", "ended_utc", "status_agrees", "reported_status", "is_complete", "duration_hours", "first_fix", "last_fix").alias("stop"))
    df = fixes.withColumn("hour", F.floor(F.unix_seconds("ts_utc") / 3600)).join(hours, ["mmsi", "hour"], "left")
    inside = (F.col("stop.started_utc") <= F.col("ts_utc")) & (F.col("ts_utc") <= F.col("stop.ended_utc"))
    df = df.withColumn("stop", F.when(inside, F.col("stop")))
    keys = [c for c in fixes.columns]
    one = F.min(F.when(F.col("stop").isNotNull(), F.struct(F.col("stop.started_utc").alias("s"), "stop"))).alias("m")
    groups = [c for c in keys if c in ("mmsi", "ingest_run_id", "source_line")]
    rest = [F.first(c).alias(c) for c in keys if c not in groups]
    return df.groupBy(*groups).agg(*rest, one).withColumn("stop", F.col("m.stop")).drop("m")


def fleet_state(fixes: DataFrame, stops: DataFrame, vessels: DataFrame, at=None, th: Thresholds = Thresholds()) -> DataFrame:
    """One row per vessel heard within the stale limit of the clock: last reliable position, course, state and trail.

    Only the last hour before `at` (a timestamp, or the latest fix) is read; the clock is the latest fix in it. A vessel
    without a reliable fix in its trail is left out.
    """
    if at is None:
        at = fixes.agg(F.max("ts_utc")).first()[0]
    at = F.lit(at).cast("timestamp")
    window = fixes.where((F.col("ts_utc") <= at) & (F.unix_seconds("ts_utc") >= F.unix_seconds(at) - th.trail_s))
    clock = window.agg(F.max("ts_utc").alias("clock"))
    df = in_stop(window, stops)
    key = F.struct(*ORDER)
    latest = df.groupBy("mmsi").agg(F.max_by(F.struct("ts_utc", "stop", is_flagged("R12").alias("r12")), key).alias("latest"))
    df = df.join(latest, "mmsi").where(elapsed_s("ts_utc", "latest.ts_utc") <= th.trail_s)
    good = df.where(~position_unreliable())
    trail = good.groupBy("mmsi").agg(
        F.max_by(F.struct("lat", "lon", "cog"), key).alias("shown"), F.first("latest").alias("latest"), F.array_sort(F.collect_list(F.struct("ts_utc", "ingest_run_id", "source_line", "lat", "lon"))).alias("trail")
    )
    # one row
    heard = trail.crossJoin(F.broadcast(clock)).where(elapsed_s("latest.ts_utc", "clock") <= th.stale_s)
    stop = F.col("latest.stop")
    state = F.when(stop.isNotNull() & ~F.col("latest.stop.status_agrees"), "StoppedClaimingUnderWay").when(stop.isNotNull(), "Stopped").when(F.col("latest.r12"), "MovingClaimingStationary").otherwise("Moving")
    named = heard.join(vessels.select("mmsi", F.col("name").alias("_name")), "mmsi", "left")
    return named.select("mmsi", vessel_name(F.col("_name"), F.col("mmsi")).alias("name"), F.col("shown.lat").alias("lat"), F.col("shown.lon").alias("lon"), F.col("shown.cog").alias("cog"), heading_arrow(F.col("shown.cog")).alias("arrow"), state.alias("state"), F.transform("trail", lambda t: F.struct(t["lat"].alias("lat"), t["lon"].alias("lon"))).alias("trail"), F.col("latest.ts_utc").alias("last_heard_utc"))


def scope_summary(fleet: DataFrame) -> DataFrame:
    return fleet.agg(F.count("*").alias("contacts"), F.count_if(F.col("state").isin("StoppedClaimingUnderWay", "MovingClaimingStationary")).alias("conflicting"))


def ships_log(fixes: DataFrame, stops: DataFrame, calls: DataFrame, phases: DataFrame, vessels: DataFrame, from_=None, to=None) -> DataFrame:
    """Log entries with citations: stops seen, stops ended (on the next fix of the vessel), and moving while claiming rest. Half-open [from_, to)."""
    if from_ is not None:
        fixes = fixes.where(F.col("ts_utc") >= F.lit(from_).cast("timestamp"))
    if to is not None:
        fixes = fixes.where(F.col("ts_utc") < F.lit(to).cast("timestamp"))
    w = vessel_order()
    own = F.struct("ingest_run_id", "source_line")
    port = F.when(F.col("plausibly_at_port"), F.col("port_name")) if "port_name" in calls.columns else F.lit(None).cast("string")
    on_call = phases.select("mmsi", "arrived_utc", "started_utc").join(calls.select("mmsi", "arrived_utc", port.alias("port")), ["mmsi", "arrived_utc"], "left").select("mmsi", "started_utc", "port")
    known = stops.join(on_call, ["mmsi", "started_utc"], "left")
    first = known.select("mmsi", F.col("first_fix.ingest_run_id").alias("ingest_run_id"), F.col("first_fix.source_line").alias("source_line"), F.struct("status_agrees", "reported_status", "is_complete", "port").alias("begins"))
    last = known.select("mmsi", F.col("last_fix.ingest_run_id").alias("ingest_run_id"), F.col("last_fix.source_line").alias("source_line"), F.struct("is_complete", "duration_hours", "port").alias("ends"))
    df = fixes.select("mmsi", "ts_utc", "ingest_run_id", "source_line", "sog_kn", "nav_status", is_flagged("R12").alias("r12"))
    df = df.join(first, ["mmsi", "ingest_run_id", "source_line"], "left").join(last, ["mmsi", "ingest_run_id", "source_line"], "left")
    df = df.withColumn("ended", F.lag("ends").over(w)).withColumn("_r12", F.lag("r12").over(w)).join(vessels.select("mmsi", F.col("name").alias("_name")), "mmsi", "left")
    name = vessel_name(F.col("_name"), F.col("mmsi"))

    def call(s: str) -> Column:
        return F.coalesce(F.concat(F.lit(" on its "), F.col(f"{s}.port"), F.lit(" call")), F.lit(""))

    def shout(status: Column) -> Column:
        return F.when(F.trim(status) != "", F.upper(status)).otherwise("NOTHING")

    hours = F.concat(F.when(F.col("ended.is_complete"), "").otherwise("≥"), F.format_string("%.1f h", F.col("ended.duration_hours")))
    ended = F.when(F.col("ended").isNotNull(), F.struct(F.lit(0).alias("n"), F.lit("StopEnded").alias("kind"), F.concat(name, F.lit(" ends a "), hours, F.lit(" stop"), call("ended"), F.lit(".")).alias("text")))
    verb = F.when(F.col("begins.is_complete"), " stopped").otherwise(" seen stopped")
    plain = F.concat(name, verb, call("begins"), F.lit("."))
    begun = F.when(
        F.col("begins").isNotNull(),
        F.struct(F.lit(1).alias("n"), F.when(F.col("begins.status_agrees"), "Stopped").otherwise("StoppedClaimingUnderWay").alias("kind"), F.when(F.col("begins.status_agrees"), plain).otherwise(F.concat(plain, F.lit(" Transponder says: "), shout(F.col("begins.reported_status")), F.lit("."))).alias("text")),
    )
    moving = F.when(
        F.col("r12") & ~F.coalesce("_r12", F.lit(False)),
        F.struct(F.lit(2).alias("n"), F.lit("MovingClaimingStationary").alias("kind"), F.concat(name, F.lit(" making "), F.format_string("%.1f", "sog_kn"), F.lit(" kn. Transponder says: "), shout(F.col("nav_status")), F.lit(".")).alias("text")),
    )
    out = df.select("mmsi", "ts_utc", "ingest_run_id", "source_line", F.explode(F.array_compact(F.array(ended, begun, moving))).alias("e"))
    return out.select("ts_utc", "mmsi", F.col("e.kind").alias("kind"), F.col("e.text").alias("text"), citation(F.col("ingest_run_id"), F.col("source_line")).alias("citation"), F.col("e.n").alias("entry_no"))
