"""All thresholds in one place."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Thresholds:
    enter_stop_kn: float = 0.5
    leave_stop_kn: float = 1.0
    minimum_stop_s: int = 30 * 60
    coverage_gap_s: int = 60 * 60
    berth_drift_nm_per_root_hour: float = 0.008
    call_gap_s: int = 12 * 3600
    call_radius_nm: float = 10.0
    draught_dead_band_m: float = 0.5
    name_port_within_nm: float = 25.0
    at_port_within_nm: float = 5.0
    teleport_nm: float = 0.5
    teleport_kn: float = 50.0
    inconsistent_nm: float = 0.1
    inconsistent_times: float = 3.0
    inconsistent_kn: float = 3.0
    speed_reject_kn: float = 40.0
    speed_flag_kn: float = 30.0
    stationary_speed_kn: float = 3.0
    eta_days: int = 60
    trail_s: int = 60 * 60
    stale_s: int = 30 * 60
    median_least: int = 5
    p90_least: int = 10
    habit_least_stops: int = 3


def thresholds_table(spark: SparkSession, th: Thresholds = Thresholds()) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in asdict(th).items()], "name string, value double")
