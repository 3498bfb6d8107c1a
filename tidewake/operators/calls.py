"""Port calls: chains of stops, their phases, and the nearest port."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import elapsed_s, haversine_nm
from ..functions.text import cargo_movement
from .stops import stop_phase
from .thresholds import Thresholds


def nearest_port(points: DataFrame, ports: DataFrame, *, key: list[str], lat: str = "centroid_lat", lon: str = "centroid_lon", max_nm: float = 25.0) -> DataFrame:
    """Key columns with the nearest port within max_nm: wpi_number, port_name, port_country, port_distance_nm. Ties go to the first port of the file.

    An equi join on one-degree cells: a port stands in every cell that its circle can touch, wider towards the poles.
    So neither side need be small, and no pair farther apart than some two degrees is made.
    """
    reach = max_nm / 60.0 + 0.01
    far = F.least(F.abs(F.col("latitude_deg")) + reach, F.lit(89.9))
    wide = F.least(F.lit(180.0), reach / F.cos(F.radians(far)))
    cells = ports.select(
        "wpi_number", "port_name", "country", "latitude_deg", "longitude_deg", "ordinal",
        F.explode(F.sequence(F.floor(F.col("latitude_deg") - reach), F.floor(F.col("latitude_deg") + reach))).alias("cell_lat"), wide.alias("wide"),
    )
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("longitude_deg") - F.col("wide")), F.floor(F.col("longitude_deg") + F.col("wide")))))
    cells = cells.withColumn("cell_lon", F.pmod(F.col("cell") + 180, F.lit(360))).drop("cell", "wide").distinct()
    at = points.where(F.col(lat).isNotNull()).select(*key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).withColumn("cell_lat", F.floor("_lat")).withColumn("cell_lon", F.pmod(F.floor("_lon") + 180, F.lit(360)))
    near = at.join(cells, ["cell_lat", "cell_lon"]).withColumn("nm", haversine_nm("_lat", "_lon", "latitude_deg", "longitude_deg")).where(F.col("nm") <= max_nm)
    best = near.groupBy(*key).agg(F.min_by(F.struct("wpi_number", "port_name", "country", "nm"), F.struct("nm", "ordinal")).alias("p"))
    return best.select(*key, F.col("p.wpi_number").alias("port_wpi_number"), F.col("p.port_name").alias("port_name"), F.col("p.country").alias("port_country"), F.col("p.nm").alias("port_distance_nm"))


def chain_port_calls(stops: DataFrame, ports: DataFrame | None = None, th: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """(calls, phases). A call goes on while the next stop begins within the gap and lies within the radius of the stop before it."""
    w = Window.partitionBy("mmsi").orderBy("started_utc")
    df = stops.withColumn("prev", F.lag(F.struct("ended_utc", "centroid_lat", "centroid_lon")).over(w))
    new = F.col("prev").isNull() | (elapsed_s("prev.ended_utc", "started_utc") > th.call_gap_s) | (haversine_nm("prev.centroid_lat", "prev.centroid_lon", "centroid_lat", "centroid_lon") > th.call_radius_nm)
    df = df.withColumn("_call", F.sum(new.cast("int")).over(w)).drop("prev").withColumn("phase", stop_phase(th))
    in_call = Window.partitionBy("mmsi", "_call")
    df = df.withColumn("arrived_utc", F.min("started_utc").over(in_call)).withColumn("seq", F.row_number().over(in_call.orderBy("started_utc")) - 1)
    phases = df.drop("_call")

    def hours(phase: str):
        return F.sum(F.when(F.col("phase") == phase, F.col("duration_hours")).otherwise(0.0))

    deep_first = F.when(F.col("draught_first_m").isNotNull(), F.col("seq"))
    deep_last = F.when(F.col("draught_last_m").isNotNull(), F.col("seq"))
    calls = phases.groupBy("mmsi", "arrived_utc").agg(
        F.max_by("ended_utc", "seq").alias("departed_utc"), hours("Anchorage").alias("waiting_hours"), hours("Berth").alias("working_hours"), hours("Unknown").alias("unclassified_hours"),
        F.avg("centroid_lat").alias("centroid_lat"), F.avg("centroid_lon").alias("centroid_lon"), F.bool_and("is_complete").alias("is_complete"), F.count("*").alias("stops"),
        F.min_by("draught_first_m", deep_first).alias("draught_arrival_m"), F.max_by("draught_last_m", deep_last).alias("draught_departure_m"),
    )
    calls = calls.withColumn("cargo_movement", cargo_movement(F.col("draught_arrival_m"), F.col("draught_departure_m"), th.draught_dead_band_m))
    if ports is not None:
        calls = calls.join(nearest_port(calls, ports, key=["mmsi", "arrived_utc"], max_nm=th.name_port_within_nm), ["mmsi", "arrived_utc"], "left")
        calls = calls.withColumn("plausibly_at_port", F.coalesce(F.col("port_distance_nm") <= th.at_port_within_nm, F.lit(False)))
    return calls, phases


def nest_calls(calls: DataFrame, phases: DataFrame) -> DataFrame:
    """Calls with their phases in order, as an array of structs."""
    nested = phases.groupBy("mmsi", "arrived_utc").agg(F.array_sort(F.collect_list(F.struct("seq", "phase", "started_utc", "ended_utc", "duration_hours", "is_complete", "reported_status", "status_agrees"))).alias("phases"))
    return calls.join(nested, ["mmsi", "arrived_utc"], "left")


def nest_vessels(vessels: DataFrame, calls: DataFrame, phases: DataFrame, per_vessel: int | None = None) -> DataFrame:
    """Vessels with their calls, latest first, each with its phases."""
    nested = nest_calls(calls, phases)
    if per_vessel is not None:
        nested = nested.withColumn("_n", F.row_number().over(Window.partitionBy("mmsi").orderBy(F.desc("arrived_utc")))).where(F.col("_n") <= per_vessel).drop("_n")
    each = nested.groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("arrived_utc", "departed_utc", "waiting_hours", "working_hours", "is_complete", "phases")), asc=False).alias("port_calls"))
    return vessels.join(each, "mmsi", "left")
