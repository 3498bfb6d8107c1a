"""Aggregates over the log and its projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify_destination, normalise_destination
from .rules import is_flagged
from .thresholds import Thresholds


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("rule_id").agg(F.count("*").alias("quarantined"))


def flag_counts(fixes: DataFrame) -> DataFrame:
    """Fixes flagged by each rule. Grouped by the whole flag list first: few lists, many fixes."""
    lists = fixes.groupBy("quality_flags").agg(F.count("*").alias("c"))
    return lists.select(F.explode("quality_flags").alias("rule_id"), "c").groupBy("rule_id").agg(F.sum("c").alias("flagged"))


def quality_report(registry: DataFrame, quarantine: DataFrame, fixes: DataFrame) -> DataFrame:
    """A line for every registered rule, silent ones too, and for every unknown id; ordered by the number in the id."""
    counts = quarantine_counts(quarantine).join(flag_counts(fixes), "rule_id", "full_outer")
    out = registry.join(counts, "rule_id", "full_outer").select(
        "rule_id", F.coalesce("description", F.lit("no rule registered for this id")).alias("description"), F.coalesce("quarantined", F.lit(0).cast("bigint")).alias("quarantined"), F.coalesce("flagged", F.lit(0).cast("bigint")).alias("flagged")
    )
    digits = F.substring("rule_id", 2, 18)
    number = F.coalesce(F.when(digits.rlike(r"^\d+$"), digits.try_cast("bigint")), F.lit(2**31 - 1).cast("bigint"))
    return out.withColumn("rule_no", number).orderBy("rule_no", "rule_id")


def rule_ids_seen(quarantine: DataFrame, fixes: DataFrame) -> DataFrame:
    return quarantine.select("rule_id").union(fixes.select(F.explode("quality_flags"))).distinct()


def status_disagreement(stops: DataFrame) -> DataFrame:
    return stops.agg(F.count("*").alias("total_stops"), F.count_if(~F.col("status_agrees")).alias("disagreeing"))


def stop_status(stops: DataFrame) -> DataFrame:
    """Per vessel with stops: lapses, stops, hours of stops that claim movement. Vessels without lapses stay."""
    lapse = ~F.col("status_agrees")
    return stops.groupBy("mmsi").agg(F.count_if(lapse).alias("lapses"), F.count("*").alias("total_stops"), F.sum(F.when(lapse, F.col("duration_hours")).otherwise(0.0)).alias("hours_claiming_under_way"))


def fix_status(fixes: DataFrame) -> DataFrame:
    """Per vessel that moved while claiming rest: such fixes, all fixes, the greatest such speed."""
    lapse = is_flagged("R12")
    return fixes.groupBy("mmsi").agg(F.count_if(lapse).alias("lapses"), F.count("*").alias("total_fixes"), F.max(F.when(lapse, F.col("sog_kn"))).alias("fastest_kn")).where("lapses > 0")


def call_counts(calls: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Calls of each vessel, of the vessels in keys where given."""
    if keys is not None:
        calls = calls.join(keys.select("mmsi").distinct(), "mmsi", "left_semi")
    return calls.groupBy("mmsi").agg(F.count("*").alias("calls"))


DAYS_AHEAD = "(unix_seconds(eta_utc) - unix_seconds(ts_utc)) div 86400"


def eta_bins(fixes: DataFrame) -> DataFrame:
    """Fixes by whole days from fix to ETA, cut off towards zero: up to a day past is bin 0."""
    return fixes.where("eta_utc IS NOT NULL").groupBy(F.expr(DAYS_AHEAD).alias("days_ahead")).agg(F.count("*").alias("fixes"))


def eta_empty_bands(bins: DataFrame, least_days: int = 7) -> DataFrame:
    """Runs of at least least_days days from 0 on without a fix, up to the next day with one. Between two neighbouring bins, so no day table is needed."""
    w = Window.orderBy("days_ahead")  # a row for each day at most
    ahead = bins.where("days_ahead >= 0 AND fixes > 0").withColumn("_before", F.coalesce(F.lag("days_ahead").over(w), F.lit(-1).cast("bigint")))
    out = ahead.select((F.col("_before") + 1).alias("from_days"), (F.col("days_ahead") - 1).alias("to_days"))
    return out.where(F.col("to_days") - F.col("from_days") + 1 >= least_days)


def eta_horizon(fixes: DataFrame, th: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bins contiguous from day 0, empty bands, summary)."""
    return eta_horizon_of_bins(eta_bins(fixes), th)


def eta_horizon_of_bins(found: DataFrame, th: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame, DataFrame]:
    ahead = found.where("days_ahead >= 0")
    days = ahead.agg(F.max("days_ahead").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("days_ahead"))
    bins = days.join(ahead, "days_ahead", "left").select("days_ahead", F.coalesce("fixes", F.lit(0).cast("bigint")).alias("fixes"))
    bands = eta_empty_bands(found)
    t = th.eta_days
    band = bands.where((F.col("from_days") <= t) & (F.col("to_days") >= t)).agg(F.min(F.struct("from_days", "to_days")).alias("band"))
    sums = found.agg(
        F.coalesce(F.sum("fixes"), F.lit(0)).alias("fixes_with_eta"), F.coalesce(F.sum(F.when(F.col("days_ahead") < 0, F.col("fixes"))), F.lit(0)).alias("fixes_past"),
        F.coalesce(F.sum(F.when((F.col("days_ahead") >= 0) & (F.col("days_ahead") <= t), F.col("fixes"))), F.lit(0)).alias("near_term"), F.coalesce(F.sum(F.when(F.col("days_ahead") > t, F.col("fixes"))), F.lit(0)).alias("beyond"),
    )
    # one row each
    summary = sums.crossJoin(F.broadcast(band)).select("fixes_with_eta", "fixes_past", "near_term", "beyond", F.col("band.from_days").alias("band_from"), F.col("band.to_days").alias("band_to"), F.col("band").isNotNull().alias("threshold_in_empty_band"))
    return bins, bands, summary


def destination_counts(fixes: DataFrame) -> DataFrame:
    """Distinct vessels and fixes of each destination as typed, with its shape; classified once per string, not per fix."""
    out = fixes.where("destination IS NOT NULL").groupBy("destination").agg(F.countDistinct("mmsi").alias("vessels"), F.count("*").alias("fixes"))
    return out.withColumn("shape", classify_destination(F.col("destination"))).withColumn("normalised", normalise_destination(F.col("destination")))


def destination_typists(fixes: DataFrame) -> DataFrame:
    """Vessels that typed any destination, and those that typed more than one."""
    each = fixes.where("destination IS NOT NULL").groupBy("mmsi").agg(F.countDistinct("destination").alias("n"))
    return each.agg(F.count("*").alias("vessels"), F.count_if(F.col("n") > 1).alias("vessels_that_changed_it"))


def destination_summary(counts: DataFrame) -> DataFrame:
    shapes = ["UnLocode", "Route", "ForOrders", "FreeText", "Unreadable"]
    return counts.agg(
        F.coalesce(F.sum("fixes"), F.lit(0)).alias("fixes"), F.count("*").alias("distinct_strings"), F.countDistinct("normalised").alias("distinct_normalised"),
        *[F.coalesce(F.sum(F.when(F.col("shape") == s, F.col("fixes"))), F.lit(0)).alias(f"fixes_{s.lower()}") for s in shapes],
    )


def _usable(th: Thresholds) -> Column:
    return F.col("is_complete") & (F.col("port_distance_nm") <= th.at_port_within_nm)


def port_observations(calls: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """What a named port's usable calls were seen to take: port_wpi_number, kind (waiting, working), hours, calls, at_or_below (calls of so many hours or fewer) and usable_calls.

    A row for each distinct value, so calls are counted before they meet; the order statistics are read off the running
    count, and no task holds a port's values.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_hours").alias("hours")) for k in ("waiting", "working")])
    values = calls.where(F.col("port_wpi_number").isNotNull() & _usable(th)).select("port_wpi_number", F.inline(kinds)).where("hours IS NOT NULL")
    seen = values.groupBy("port_wpi_number", "kind", "hours").agg(F.count("*").alias("calls"))
    up = Window.partitionBy("port_wpi_number", "kind").orderBy("hours").rowsBetween(Window.unboundedPreceding, 0)
    totals = seen.groupBy("port_wpi_number", "kind").agg(F.sum("calls").alias("usable_calls"))
    return seen.withColumn("at_or_below", F.sum("calls").over(up)).join(totals, ["port_wpi_number", "kind"])


def port_benchmarks(calls: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Per named port: calls attributed, left out as incomplete, then as too far, and used; hours in sum, nearest-rank median and p90 where there are enough."""
    near, use = F.col("port_distance_nm") <= th.at_port_within_nm, _usable(th)
    total = lambda kind: F.coalesce(F.sum(F.when(use, F.col(f"{kind}_hours"))), F.lit(0.0)).alias(f"{kind}_hours")
    counts = calls.where("port_wpi_number IS NOT NULL").groupBy("port_wpi_number", "port_name", "port_country")
    counts = counts.agg(F.count("*").alias("attributed_calls"), F.count_if(~F.col("is_complete")).alias("excluded_incomplete"), F.count_if(F.col("is_complete") & ~near).alias("excluded_too_far"), F.count_if(use).alias("usable_calls"), total("waiting"), total("working"))

    def rank(percent: int, kind: str) -> Column:
        # the least value that is seen with enough calls at or below it: nearest rank, never interpolated
        enough = F.col("at_or_below") * 100 >= F.col("usable_calls") * percent
        return F.min(F.when((F.col("kind") == kind) & enough, F.col("hours")))

    ranks = port_observations(calls, th).groupBy("port_wpi_number").agg(rank(50, "waiting").alias("median_waiting_hours"), rank(50, "working").alias("median_working_hours"), rank(90, "waiting").alias("p90_waiting_hours"))
    out = counts.join(ranks, "port_wpi_number", "left")
    for name, least in (("median_waiting_hours", th.median_least), ("median_working_hours", th.median_least), ("p90_waiting_hours", th.p90_least)):
        out = out.withColumn(name, F.when(F.col("usable_calls") >= least, F.col(name)))
    return out.orderBy(F.desc("usable_calls"), "port_name")


def rank_waits(probes: DataFrame, calls: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Where a wait (port_wpi_number, hours) stands among a port's usable calls: calls at or below, all, and the percentage if enough.

    Probes and the port's distinct values are sorted together once, and a running count passes over both.
    """
    seen = port_observations(calls, th).where("kind = 'waiting'").select("port_wpi_number", "hours", "calls", F.lit(0).alias("probe"))
    asked = probes.select("port_wpi_number", "hours").distinct().select("*", F.lit(0).cast("long").alias("calls"), F.lit(1).alias("probe"))
    up = Window.partitionBy("port_wpi_number").orderBy("hours", "probe").rowsBetween(Window.unboundedPreceding, 0)
    df = seen.unionByName(asked).withColumn("at_or_below", F.sum("calls").over(up)).where("probe = 1")
    totals = seen.groupBy("port_wpi_number").agg(F.sum("calls").alias("usable_calls"))
    df = df.join(totals, "port_wpi_number", "left").select("port_wpi_number", "hours", "at_or_below", F.coalesce("usable_calls", F.lit(0)).alias("usable_calls"))
    return df.withColumn("rank_percent", F.when(F.col("usable_calls") >= th.median_least, 100.0 * F.col("at_or_below") / F.col("usable_calls")))


def reported_cargo(calls: DataFrame) -> DataFrame:
    """What draughts say of complete calls, those with a berth against those only at anchor."""
    moved = F.col("cargo_movement").isin("Loaded", "Discharged")
    known = F.col("cargo_movement") != "Unknown"
    berth = F.col("working_hours") > 0
    out = calls.where("is_complete").agg(
        F.count_if(known).alias("with_draught"), F.count_if(~known).alias("without_draught"), *[F.count_if(F.col("cargo_movement") == m).alias(m.lower()) for m in ("Discharged", "Loaded", "Unchanged")],
        F.count_if(known & berth).alias("berthed"), F.count_if(known & berth & moved).alias("berthed_changed"), F.count_if(known & ~berth).alias("anchorage_only"), F.count_if(known & ~berth & moved).alias("anchorage_only_changed"),
    )
    a, b = (F.when(F.col(x) > 0, 100.0 * F.col(f"{x}_changed") / F.col(x)) for x in ("berthed", "anchorage_only"))
    out = out.withColumn("berthed_share_percent", a).withColumn("anchorage_only_share_percent", b)
    return out.withColumn("times_likelier", F.when(F.col("anchorage_only_share_percent") > 0, F.col("berthed_share_percent") / F.col("anchorage_only_share_percent"))).withColumn("balanced", F.col("discharged") + F.col("loaded") + F.col("unchanged") == F.col("with_draught"))


def detection_summary(stops: DataFrame, calls: DataFrame) -> DataFrame:
    a = stops.agg(F.countDistinct("mmsi").alias("vessels"), F.count("*").alias("stops"), F.count_if("is_complete").alias("complete_stops"), F.count_if(~F.col("status_agrees")).alias("disagreeing_stops"))
    b = calls.agg(F.count("*").alias("calls"), F.count("port_name").alias("named_calls"), F.count_if("plausibly_at_port").alias("plausibly_at_port"))
    return a.crossJoin(b)  # one row each


def vessel_records(stops: DataFrame, fixes: DataFrame, vessels: DataFrame) -> DataFrame:
    """Vessels that lapsed on arrival, on departure or both, most lapses first."""
    arrivals = stop_status(stops).where("lapses > 0").select("mmsi", F.col("lapses").alias("arrival_lapses"), "total_stops", "hours_claiming_under_way")
    departures = fix_status(fixes).select("mmsi", F.col("lapses").alias("departure_lapses"), "total_fixes", "fastest_kn")
    out = arrivals.join(departures, "mmsi", "full_outer").join(vessels.select("mmsi", "name", "ship_type"), "mmsi", "left")
    zero = F.lit(0).cast("bigint")
    out = out.select("mmsi", "name", "ship_type", F.coalesce("arrival_lapses", zero).alias("arrival_lapses"), F.coalesce("total_stops", zero).alias("total_stops"), F.coalesce("hours_claiming_under_way", F.lit(0.0)).alias("hours_claiming_under_way"), F.coalesce("departure_lapses", zero).alias("departure_lapses"), F.coalesce("total_fixes", zero).alias("total_fixes"), "fastest_kn")
    return out.orderBy((F.col("arrival_lapses") + F.col("departure_lapses")).desc(), "mmsi")


def habits(stops: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Vessels with stops, with lapses, always wrong and always right among those with enough stops."""
    s = stop_status(stops)
    enough = F.col("total_stops") >= th.habit_least_stops
    return s.agg(
        F.count("*").alias("vessels_with_stops"), F.count_if(F.col("lapses") > 0).alias("vessels_with_lapses"), F.coalesce(F.sum("hours_claiming_under_way"), F.lit(0.0)).alias("hours_claiming_under_way"),
        F.count_if(enough & (F.col("lapses") == F.col("total_stops"))).alias("always_wrong"), F.count_if(enough & (F.col("lapses") == 0)).alias("always_right"),
    )


def leaderboard(records: DataFrame, by: str, k: int = 5, th: Thresholds = Thresholds()) -> DataFrame:
    """Top vessels: by 'share' or 'count' of arrival lapses, 'departures', 'speed', or 'both' directions."""
    if by == "share":
        df = records.where(F.col("total_stops") >= th.habit_least_stops).withColumn("figure", F.col("arrival_lapses") / F.col("total_stops"))
    elif by == "both":
        df = records.where("arrival_lapses > 0 AND departure_lapses > 0").withColumn("figure", (F.col("arrival_lapses") + F.col("departure_lapses")).cast("double"))
    else:
        df = records.withColumn("figure", F.col({"count": "arrival_lapses", "departures": "departure_lapses", "speed": "fastest_kn"}[by]).cast("double")).where("figure > 0")
    return df.orderBy(F.desc("figure"), "mmsi").limit(k)


def manifest(runs: DataFrame) -> DataFrame:
    """Source files in run order: rows read by each file's first run, rows stored by all its runs."""
    return runs.groupBy("source_file").agg(F.min("id").alias("first_run"), F.min_by("rows_read", "id").alias("rows_read"), F.sum("rows_inserted").alias("rows_stored")).orderBy("first_run")
