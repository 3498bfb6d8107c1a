"""Registered queries of the library, on the feed derived from the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_region
from ..operators import calls as C
from ..operators import listing as L
from ..operators import reports as R
from ..operators.annotate import annotate
from ..operators.cited_text import validate_cited_text
from ..operators.laytime import EXCEPTIONS, assess_laytime, priceability, voyage_timeline
from ..operators.rules import registry
from ..operators.sof import document_windows, reconcile, select_calls
from ..operators.track import fleet_state, scope_summary, ships_log
from .feed import ORACLE_SQL, QUERIES, Feed, query as _query  # noqa: F401  the registry is read here too

def _s(c: str):
    return F.unix_seconds(c)


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@_query("SELECT mmsi, count(*) FILTER (NOT agrees) AS lapses, count(*) AS total_stops, round(sum(CASE WHEN agrees THEN 0 ELSE hours END), 6) AS hours_claiming_under_way FROM stops GROUP BY mmsi")
def stops_per_vessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.stop_status(Feed(spark, sf_dir).stops())
    return out.withColumn("hours_claiming_under_way", _r("hours_claiming_under_way"))


@_query("SELECT coalesce(failure, 'ok') AS outcome, count(*) AS n FROM lines GROUP BY 1")
def parse_outcomes(spark, sf_dir):
    return Feed(spark, sf_dir).records().groupBy(F.coalesce("parse_failure", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@_query("SELECT source_file, source_line, mmsi, ts AS ts_s, lat, lon, sog AS sog_kn, cog, status AS nav_status, draught AS draught_m, dest AS destination, eta AS eta_s, name, ship_type, length_m FROM lines WHERE failure IS NULL")
def parsed_records(spark, sf_dir):
    df = Feed(spark, sf_dir).records().where("parse_failure IS NULL")
    return df.select("source_file", "source_line", "mmsi", _s("ts_utc").alias("ts_s"), "lat", "lon", "sog_kn", "cog", "nav_status", "draught_m", "destination", _s("eta_utc").alias("eta_s"), "name", "ship_type", "length_m")


@_query(
    """SELECT rule_id, action, count(*) AS hits FROM (
  SELECT unnest(list_filter([CASE WHEN failure IS NOT NULL THEN 'R1 Reject' END, CASE WHEN failure IS NULL AND lat = 91 THEN 'R4 Reject' END, CASE WHEN r5 THEN 'R5 Flag' END, CASE WHEN failure IS NULL AND sog > 40 THEN 'R6 Reject' WHEN r6 THEN 'R6 Flag' END, CASE WHEN r12 THEN 'R12 Flag' END, CASE WHEN r13 THEN 'R13 Flag' END], lambda x: x IS NOT NULL)) AS h FROM (
    SELECT *, CASE WHEN failure IS NOT NULL AND failure <> 'expected 26 fields, found 25' THEN true ELSE false END AS odd FROM judged WHERE failure IS NULL)
  UNION ALL SELECT 'R1 Reject' FROM judged WHERE failure IS NOT NULL), LATERAL (SELECT split_part(h, ' ', 1) AS rule_id, split_part(h, ' ', 2) AS action) GROUP BY ALL"""
)
def row_rule_hits(spark, sf_dir):
    """Of lines that could be parsed, and R1 of the others."""
    j = Feed(spark, sf_dir).judged()
    h = j.select("parse_failure", F.explode("hits").alias("h")).where("parse_failure IS NULL OR h.rule_id = 'R1'")
    return h.groupBy(F.col("h.rule_id").alias("rule_id"), F.col("h.action").alias("action")).agg(F.count("*").alias("hits"))


@_query("SELECT reject AS rule_id, source_file, source_line FROM judged WHERE reject IS NOT NULL")
def quarantined_rows(spark, sf_dir):
    one, two = Feed(spark, sf_dir).runs()
    return one.quarantine.unionByName(two.quarantine).select("rule_id", "source_file", "source_line")


_COUNTERS = """SELECT run AS ingest_run_id, count(*) AS rows_read, count(*) FILTER (b = 'filtered') AS rows_filtered, count(*) FILTER (b = 'inserted') AS rows_inserted, count(*) FILTER (b = 'dup_in_file') AS rows_dup_in_file,
  count(*) FILTER (b = 'dup_prior_run') AS rows_dup_prior_run, count(*) FILTER (b = 'quarantined') AS rows_quarantined, true AS balanced FROM (
  SELECT CASE WHEN source_file = 'day1.csv' THEN 1 ELSE 2 END AS run, CASE WHEN failure IS NULL AND NOT {scope} THEN 'filtered' WHEN reject IS NOT NULL THEN 'quarantined' WHEN n > 1 THEN 'dup_in_file' WHEN source_file = 'day2.csv' AND f > 0 THEN 'dup_prior_run' ELSE 'inserted' END AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY source_file, reject IS NULL, mmsi, ts, lat, lon ORDER BY source_line) AS n, count(*) FILTER (source_file = 'day1.csv' AND reject IS NULL AND {scope1}) OVER (PARTITION BY mmsi, ts, lat, lon) AS f FROM scoped)) GROUP BY run"""


@_query(", scoped AS (SELECT * FROM judged) " + _COUNTERS.format(scope="true", scope1="true"))
def ingest_counters(spark, sf_dir):
    one, two = Feed(spark, sf_dir).runs()
    return one.counters.unionByName(two.counters)


@_query(
    """, per_file AS (SELECT mmsi, source_file, arg_max(ship_type, source_line) FILTER (ship_type IS NOT NULL) AS st FROM judged WHERE failure IS NULL GROUP BY ALL),
  scoped AS (SELECT j.*, coalesce(st = 'Tanker', false) AS sc FROM judged j LEFT JOIN per_file p ON p.mmsi = j.mmsi AND p.source_file = j.source_file AND j.failure IS NULL) """
    + _COUNTERS.format(scope="sc", scope1="sc")
)
def ingest_counters_scoped(spark, sf_dir):
    one, two = Feed(spark, sf_dir).runs("tanker")
    return one.counters.unionByName(two.counters)


@_query("SELECT mmsi, name, ship_type, length_m, first_seen AS first_seen_s, last_seen AS last_seen_s FROM vessels")
def vessel_identities(spark, sf_dir):
    return Feed(spark, sf_dir).vessels().select("mmsi", "name", "ship_type", "length_m", _s("first_seen_utc").alias("first_seen_s"), _s("last_seen_utc").alias("last_seen_s"))


@_query("SELECT mmsi, ts AS ts_s, lat, lon, run AS ingest_run_id, source_line FROM log")
def position_log(spark, sf_dir):
    return Feed(spark, sf_dir).log().select("mmsi", _s("ts_utc").alias("ts_s"), "lat", "lon", "ingest_run_id", "source_line")


@_query("SELECT rule_id, count(*) AS hits FROM (SELECT unnest(list_filter(['R7', 'R8', 'R11'], lambda x, i: [p7, p8, p11][i])) AS rule_id FROM fixes) GROUP BY 1")
def pair_rule_hits(spark, sf_dir):
    return annotate(Feed(spark, sf_dir).log())[1]


@_query("SELECT mmsi, ts AS ts_s, source_line, string_agg(rule_id, ',' ORDER BY rule_id) AS flags FROM flags GROUP BY mmsi, ts, run, source_line")
def flagged_fixes(spark, sf_dir):
    f = Feed(spark, sf_dir).fixes().where(F.size("quality_flags") > 0)
    return f.select("mmsi", _s("ts_utc").alias("ts_s"), "source_line", F.array_join(F.array_sort("quality_flags"), ",").alias("flags"))


@_query("SELECT mmsi, started AS started_s, ended AS ended_s, round(hours, 6) AS duration_hours, round(clat, 9) AS centroid_lat, round(clon, 9) AS centroid_lon, round(drift, 6) AS max_drift_nm, n AS fix_count, nr AS reliable_fix_count, trusted AS geometry_trustworthy, said AS reported_status, agrees AS status_agrees, complete AS is_complete, d_first AS draught_first_m, d_last AS draught_last_m FROM stops")
def stops(spark, sf_dir):
    s = Feed(spark, sf_dir).stops()
    return s.select("mmsi", _s("started_utc").alias("started_s"), _s("ended_utc").alias("ended_s"), _r("duration_hours").alias("duration_hours"), _r("centroid_lat", 9).alias("centroid_lat"), _r("centroid_lon", 9).alias("centroid_lon"), _r("max_drift_nm").alias("max_drift_nm"), "fix_count", "reliable_fix_count", "geometry_trustworthy", "reported_status", "status_agrees", "is_complete", "draught_first_m", "draught_last_m")


@_query("SELECT mmsi, arrived AS arrived_s, departed AS departed_s, round(waiting, 6) AS waiting_hours, round(working, 6) AS working_hours, round(unclassified, 6) AS unclassified_hours, complete AS is_complete, n AS stops, port AS port_name, round(nm, 6) AS port_distance_nm, at_port AS plausibly_at_port, cargo AS cargo_movement FROM calls")
def port_calls(spark, sf_dir):
    c, _ = Feed(spark, sf_dir).calls()
    return c.select("mmsi", _s("arrived_utc").alias("arrived_s"), _s("departed_utc").alias("departed_s"), _r("waiting_hours").alias("waiting_hours"), _r("working_hours").alias("working_hours"), _r("unclassified_hours").alias("unclassified_hours"), "is_complete", "stops", "port_name", _r("port_distance_nm").alias("port_distance_nm"), "plausibly_at_port", "cargo_movement")


@_query("SELECT mmsi, arrived AS arrived_s, seq, phase, started AS started_s FROM phases")
def port_call_phases(spark, sf_dir):
    _, p = Feed(spark, sf_dir).calls()
    return p.select("mmsi", _s("arrived_utc").alias("arrived_s"), "seq", "phase", _s("started_utc").alias("started_s"))


@_query("SELECT mmsi, arrived AS arrived_s, string_agg(phase, '>' ORDER BY seq) AS phases FROM phases GROUP BY ALL")
def nested_calls(spark, sf_dir):
    c, p = Feed(spark, sf_dir).calls()
    return C.nest_calls(c, p).select("mmsi", _s("arrived_utc").alias("arrived_s"), F.array_join(F.transform("phases", lambda x: x["phase"]), ">").alias("phases"))


@_query("SELECT v.mmsi, count(c.arrived) AS calls, coalesce(sum(c.n), 0) AS phases FROM vessels v LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY arrived DESC) AS k FROM calls) WHERE k <= 2) c ON c.mmsi = v.mmsi GROUP BY v.mmsi")
def nested_vessels(spark, sf_dir):
    f = Feed(spark, sf_dir)
    v = f.vessels()
    c, p = f.calls()
    n = C.nest_vessels(v, c, p, per_vessel=2)
    calls = F.coalesce(F.size("port_calls"), F.lit(0))
    return n.select("mmsi", F.greatest(calls, F.lit(0)).cast("bigint").alias("calls"), F.coalesce(F.aggregate("port_calls", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["phases"])), F.lit(0).cast("bigint")).alias("phases"))


@_query(
    """SELECT rule_id, count(*) FILTER (k = 'q') AS quarantined, count(*) FILTER (k = 'f') AS flagged FROM (
  SELECT reject AS rule_id, 'q' AS k FROM judged WHERE reject IS NOT NULL UNION ALL SELECT rule_id, 'f' FROM flags UNION ALL SELECT unnest(['R1', 'R4', 'R5', 'R6', 'R12', 'R13', 'R7', 'R8', 'R11']), 'n') GROUP BY 1"""
)
def quality_report(spark, sf_dir):
    f = Feed(spark, sf_dir)
    one, two = f.runs()
    return R.quality_report(registry(spark), one.quarantine.unionByName(two.quarantine), f.fixes()).select("rule_id", "quarantined", "flagged")


@_query("SELECT DISTINCT rule_id FROM (SELECT rule_id FROM flags UNION ALL SELECT reject FROM judged WHERE reject IS NOT NULL)")
def rule_ids_seen(spark, sf_dir):
    f = Feed(spark, sf_dir)
    one, two = f.runs()
    return R.rule_ids_seen(one.quarantine.unionByName(two.quarantine), f.fixes())


@_query("SELECT count(*) AS total_stops, count(*) FILTER (NOT agrees) AS disagreeing FROM stops")
def status_disagreement(spark, sf_dir):
    return R.status_disagreement(Feed(spark, sf_dir).stops())


@_query("SELECT mmsi, count(*) FILTER (r12) AS lapses, count(*) AS total_fixes, max(sog) FILTER (r12) AS fastest_kn FROM fixes GROUP BY mmsi HAVING count(*) FILTER (r12) > 0")
def fix_status(spark, sf_dir):
    return R.fix_status(Feed(spark, sf_dir).fixes())


@_query("SELECT mmsi, count(*) AS calls FROM calls WHERE mmsi % 3 = 0 GROUP BY mmsi")
def call_counts(spark, sf_dir):
    f = Feed(spark, sf_dir)
    v = f.vessels()
    return R.call_counts(f.calls()[0], v.where("mmsi % 3 = 0"))


@_query("SELECT mmsi, count(*) AS calls FROM calls GROUP BY mmsi")
def call_counts_all(spark, sf_dir):
    """Of all vessels; call_counts above is the lookup by keys."""
    return R.call_counts(Feed(spark, sf_dir).calls()[0])


_BINS = ", bins AS (SELECT CAST(trunc((eta - ts) / 86400.0) AS BIGINT) AS d, count(*) AS c FROM log WHERE eta IS NOT NULL GROUP BY 1)"


@_query(_BINS + " SELECT day AS days_ahead, coalesce(c, 0) AS fixes FROM (SELECT unnest(range((SELECT max(d) + 1 FROM bins))) AS day) LEFT JOIN bins ON d = day")
def eta_bins(spark, sf_dir):
    return R.eta_horizon(Feed(spark, sf_dir).log())[0]


@_query(_BINS + " SELECT p + 1 AS from_days, d - 1 AS to_days FROM (SELECT d, coalesce(lag(d) OVER (ORDER BY d), -1) AS p FROM bins WHERE d >= 0 AND d % 20 < 12) WHERE d - p >= 8")
def eta_empty_bands(spark, sf_dir):
    """On bins of which some days are taken out, for the feed itself has an ETA on every day."""
    return R.eta_empty_bands(R.eta_bins(Feed(spark, sf_dir).log()).where("days_ahead % 20 < 12"))


@_query(_BINS + " SELECT p + 1 AS from_days, d - 1 AS to_days FROM (SELECT d, coalesce(lag(d) OVER (ORDER BY d), -1) AS p FROM bins WHERE d >= 0) WHERE d - p >= 8")
def eta_empty_bands_all(spark, sf_dir):
    """On all bins of the feed; eta_empty_bands above makes gaps of its own."""
    return R.eta_empty_bands(R.eta_bins(Feed(spark, sf_dir).log()))


@_query(_BINS + " SELECT sum(c) AS fixes_with_eta, coalesce(sum(c) FILTER (d < 0), 0) AS fixes_past, sum(c) FILTER (d BETWEEN 0 AND 60) AS near_term, sum(c) FILTER (d > 60) AS beyond FROM bins")
def eta_summary(spark, sf_dir):
    return R.eta_horizon(Feed(spark, sf_dir).log())[2].select("fixes_with_eta", "fixes_past", "near_term", "beyond")


_DEST = """, dests AS (SELECT dest AS destination, count(DISTINCT mmsi) AS vessels, count(*) AS fixes,
  CASE dest WHEN 'DKSKA' THEN 'UnLocode' WHEN 'DK SKA' THEN 'UnLocode' WHEN 'SEGOT>PLGDN' THEN 'Route' WHEN 'SKAW FOR ORDERS' THEN 'ForOrders' WHEN 'SKAGEN' THEN 'FreeText' ELSE 'Unreadable' END AS shape, replace(upper(dest), ' ', '') AS normalised FROM log WHERE dest IS NOT NULL GROUP BY dest)"""


@_query(_DEST + " SELECT * FROM dests")
def destination_counts(spark, sf_dir):
    return R.destination_counts(Feed(spark, sf_dir).log())


@_query("SELECT count(*) AS vessels, count(*) FILTER (n > 1) AS vessels_that_changed_it FROM (SELECT mmsi, count(DISTINCT dest) AS n FROM log WHERE dest IS NOT NULL GROUP BY mmsi)")
def destination_typists(spark, sf_dir):
    return R.destination_typists(Feed(spark, sf_dir).log())


@_query(_DEST + " SELECT sum(fixes) AS fixes, count(*) AS distinct_strings, count(DISTINCT normalised) AS distinct_normalised, coalesce(sum(fixes) FILTER (shape = 'UnLocode'), 0) AS fixes_unlocode, coalesce(sum(fixes) FILTER (shape = 'Route'), 0) AS fixes_route, coalesce(sum(fixes) FILTER (shape = 'ForOrders'), 0) AS fixes_fororders, coalesce(sum(fixes) FILTER (shape = 'FreeText'), 0) AS fixes_freetext, coalesce(sum(fixes) FILTER (shape = 'Unreadable'), 0) AS fixes_unreadable FROM dests")
def destination_summary(spark, sf_dir):
    return R.destination_summary(R.destination_counts(Feed(spark, sf_dir).log()))


_USE = "complete AND nm <= 5"


@_query(
    f"""SELECT wpi AS port_wpi_number, port AS port_name, country AS port_country, count(*) AS attributed_calls, count(*) FILTER (NOT complete) AS excluded_incomplete, count(*) FILTER (complete AND nm > 5) AS excluded_too_far, count(*) FILTER ({_USE}) AS usable_calls,
  round(CASE WHEN count(*) FILTER ({_USE}) >= 5 THEN quantile_disc(waiting, 0.5) FILTER ({_USE}) END, 6) AS median_waiting_hours, round(CASE WHEN count(*) FILTER ({_USE}) >= 5 THEN quantile_disc(working, 0.5) FILTER ({_USE}) END, 6) AS median_working_hours,
  round(CASE WHEN count(*) FILTER ({_USE}) >= 10 THEN quantile_disc(waiting, 0.9) FILTER ({_USE}) END, 6) AS p90_waiting_hours, round(coalesce(sum(waiting) FILTER ({_USE}), 0), 6) AS waiting_sum FROM calls WHERE wpi IS NOT NULL GROUP BY ALL"""
)
def port_benchmarks(spark, sf_dir):
    b = R.port_benchmarks(Feed(spark, sf_dir).calls()[0])
    return b.select("port_wpi_number", "port_name", "port_country", "attributed_calls", "excluded_incomplete", "excluded_too_far", "usable_calls", *[_r(c).alias(c) for c in ("median_waiting_hours", "median_working_hours", "p90_waiting_hours")], _r("waiting_hours").alias("waiting_sum"))


@_query(
    f""", usable AS (SELECT * FROM calls WHERE {_USE}), probes AS (SELECT wpi, h FROM (SELECT DISTINCT wpi FROM calls WHERE wpi IS NOT NULL), (SELECT unnest([0.4, 0.9, 2.0]) AS h))
  SELECT p.wpi AS port_wpi_number, p.h::DOUBLE AS hours, count(u.waiting) FILTER (u.waiting <= p.h) AS at_or_below, count(u.waiting) AS usable_calls, round(CASE WHEN count(u.waiting) >= 5 THEN 100.0 * count(u.waiting) FILTER (u.waiting <= p.h) / count(u.waiting) END, 6) AS rank_percent FROM probes p LEFT JOIN usable u ON u.wpi = p.wpi GROUP BY ALL"""
)
def wait_ranks(spark, sf_dir):
    c, _ = Feed(spark, sf_dir).calls()
    probes = c.where("port_wpi_number IS NOT NULL").select("port_wpi_number").distinct().withColumn("hours", F.explode(F.array(*[F.lit(h) for h in (0.4, 0.9, 2.0)])))
    return R.rank_waits(probes, c).withColumn("rank_percent", _r("rank_percent"))


@_query("SELECT count(*) FILTER (cargo <> 'Unknown') AS with_draught, count(*) FILTER (cargo = 'Unknown') AS without_draught, count(*) FILTER (cargo = 'Discharged') AS discharged, count(*) FILTER (cargo = 'Loaded') AS loaded, count(*) FILTER (cargo = 'Unchanged') AS unchanged, count(*) FILTER (cargo <> 'Unknown' AND working > 0) AS berthed, count(*) FILTER (cargo IN ('Loaded', 'Discharged') AND working > 0) AS berthed_changed, true AS balanced FROM calls WHERE complete")
def reported_cargo(spark, sf_dir):
    return R.reported_cargo(Feed(spark, sf_dir).calls()[0]).select("with_draught", "without_draught", "discharged", "loaded", "unchanged", "berthed", "berthed_changed", "balanced")


_TIMELINE = """, berths AS (SELECT *, min(started) FILTER (phase = 'Berth') OVER c AS b0, max(ended) FILTER (phase = 'Berth') OVER c AS b1 FROM phases WINDOW c AS (PARTITION BY mmsi, arrived)),
  timeline AS (SELECT mmsi, arrived, any_value(b0) AS berthed, any_value(b1) AS left_berth, sum(CASE WHEN phase = 'Unknown' AND b0 IS NOT NULL THEN greatest(0, least(ended, b1) - greatest(started, b0)) ELSE 0 END) AS untrusted FROM berths GROUP BY mmsi, arrived)"""


@_query(_TIMELINE + " SELECT CASE WHEN berthed IS NULL THEN 'NoBerthPhase' WHEN untrusted > 0 THEN 'BerthGeometryUntrustworthy' ELSE 'Priceable' END AS outcome, count(*) AS calls FROM timeline GROUP BY 1")
def priceable_calls(spark, sf_dir):
    return priceability(Feed(spark, sf_dir).calls()[1])


@_query(_TIMELINE + " SELECT mmsi, arrived AS arrived_s, berthed AS berthed_s, left_berth AS departed_berth_s, untrusted AS untrusted_s FROM timeline")
def voyage_timelines(spark, sf_dir):
    t = voyage_timeline(Feed(spark, sf_dir).calls()[1])
    return t.select("mmsi", _s("arrived_utc").alias("arrived_s"), _s("berthed_utc").alias("berthed_s"), _s("departed_berth_utc").alias("departed_berth_s"), F.col("untrusted_s").cast("bigint").alias("untrusted_s"))


@_query("SELECT a.*, b.* FROM (SELECT count(DISTINCT mmsi) AS vessels, count(*) AS stops, count(*) FILTER (complete) AS complete_stops, count(*) FILTER (NOT agrees) AS disagreeing_stops FROM stops) a, (SELECT count(*) AS calls, count(port) AS named_calls, count(*) FILTER (at_port) AS plausibly_at_port FROM calls) b")
def detection_summary(spark, sf_dir):
    f = Feed(spark, sf_dir)
    return R.detection_summary(f.stops(), f.calls()[0])


_RECORDS = """, records AS (SELECT coalesce(a.mmsi, d.mmsi) AS mmsi, coalesce(a.lapses, 0) AS arrival_lapses, coalesce(a.total, 0) AS total_stops, coalesce(d.lapses, 0) AS departure_lapses, coalesce(d.total, 0) AS total_fixes, d.fastest AS fastest_kn FROM
  (SELECT mmsi, count(*) FILTER (NOT agrees) AS lapses, count(*) AS total FROM stops GROUP BY mmsi HAVING count(*) FILTER (NOT agrees) > 0) a FULL JOIN
  (SELECT mmsi, count(*) FILTER (r12) AS lapses, count(*) AS total, max(sog) FILTER (r12) AS fastest FROM fixes GROUP BY mmsi HAVING count(*) FILTER (r12) > 0) d ON a.mmsi = d.mmsi)"""


def _records(f: Feed) -> DataFrame:
    v = f.vessels()
    return R.vessel_records(f.stops(), f.fixes(), v)


@_query(_RECORDS + " SELECT * FROM records")
def vessel_records(spark, sf_dir):
    return _records(Feed(spark, sf_dir)).select("mmsi", "arrival_lapses", "total_stops", "departure_lapses", "total_fixes", "fastest_kn")


@_query("SELECT count(*) AS vessels_with_stops, count(*) FILTER (l > 0) AS vessels_with_lapses, round(sum(h), 6) AS hours_claiming_under_way, count(*) FILTER (n >= 3 AND l = n) AS always_wrong, count(*) FILTER (n >= 3 AND l = 0) AS always_right FROM (SELECT mmsi, count(*) AS n, count(*) FILTER (NOT agrees) AS l, sum(CASE WHEN agrees THEN 0 ELSE hours END) AS h FROM stops GROUP BY mmsi)")
def vessel_habits(spark, sf_dir):
    return R.habits(Feed(spark, sf_dir).stops()).withColumn("hours_claiming_under_way", _r("hours_claiming_under_way"))


@_query(_RECORDS + " SELECT * FROM (SELECT 'share' AS board, mmsi, round(arrival_lapses / total_stops, 6) AS figure FROM records WHERE total_stops >= 3 ORDER BY arrival_lapses / total_stops DESC, mmsi LIMIT 5) UNION ALL SELECT * FROM (SELECT 'count', mmsi, arrival_lapses FROM records WHERE arrival_lapses > 0 ORDER BY arrival_lapses DESC, mmsi LIMIT 5) UNION ALL SELECT * FROM (SELECT 'speed', mmsi, fastest_kn FROM records WHERE fastest_kn > 0 ORDER BY fastest_kn DESC, mmsi LIMIT 5) UNION ALL SELECT * FROM (SELECT 'both', mmsi, arrival_lapses + departure_lapses FROM records WHERE arrival_lapses > 0 AND departure_lapses > 0 ORDER BY arrival_lapses + departure_lapses DESC, mmsi LIMIT 5)")
def leaderboards(spark, sf_dir):
    f = Feed(spark, sf_dir)
    r = f.staging.save(_records(f), "records")  # every board reads them
    out = None
    for board in ("share", "count", "speed", "both"):
        b = R.leaderboard(r, board).select(F.lit(board).alias("board"), "mmsi", _r("figure").alias("figure"))
        out = b if out is None else out.unionByName(b)
    return out


@_query("SELECT mmsi, started AS started_s, round(hours, 6) AS duration_hours FROM stops WHERE complete AND NOT agrees AND hours >= 0.6 ORDER BY hours DESC, mmsi, started LIMIT 20")
def longest_stops(spark, sf_dir):
    s = L.list_stops(Feed(spark, sf_dir).stops(), least_hours=0.6, complete_only=True, disagreements_only=True, limit=20)
    return s.select("mmsi", _s("started_utc").alias("started_s"), _r("duration_hours").alias("duration_hours"))


@_query("SELECT mmsi, arrived AS arrived_s, round(waiting, 6) AS waiting_hours FROM calls WHERE waiting >= 0.5 ORDER BY round(waiting + working, 9) DESC, mmsi, arrived LIMIT 20")
def longest_calls(spark, sf_dir):
    c, _ = Feed(spark, sf_dir).calls()
    c = c.withColumns({h: F.round(h, 9) for h in ("waiting_hours", "working_hours")})
    return L.list_calls(c, least_waiting_hours=0.5, limit=20).select("mmsi", _s("arrived_utc").alias("arrived_s"), _r("waiting_hours").alias("waiting_hours"))


@_query("SELECT mmsi, arrived AS arrived_s, k AS nth FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY arrived DESC) AS k FROM calls) WHERE k <= 2")
def latest_calls(spark, sf_dir):
    return L.latest_calls(Feed(spark, sf_dir).calls()[0], 2).select("mmsi", _s("arrived_utc").alias("arrived_s"), "nth")


@_query("SELECT mmsi, arrived AS arrived_s FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY arrived DESC) AS k FROM calls WHERE complete) WHERE k = 1")
def latest_complete_call(spark, sf_dir):
    return L.latest_calls(Feed(spark, sf_dir).calls()[0], 1, complete_only=True).select("mmsi", _s("arrived_utc").alias("arrived_s"))


@_query("SELECT mmsi, ship_type FROM vessels WHERE ship_type = 'Tanker'")
def tankers(spark, sf_dir):
    return L.list_vessels(Feed(spark, sf_dir).vessels(), "Tanker").select("mmsi", "ship_type")


@_query("SELECT mmsi, started AS started_s FROM stops WHERE started < 1704153600 AND ended >= 1704110400")
def stops_in_window(spark, sf_dir):
    return L.stops_in_window(Feed(spark, sf_dir).stops(), "2024-01-01 12:00:00", "2024-01-02 00:00:00").select("mmsi", _s("started_utc").alias("started_s"))


@_query("SELECT mmsi, arrived AS arrived_s FROM calls WHERE arrived < 1704153600 AND departed >= 1704110400")
def calls_in_window(spark, sf_dir):
    return L.calls_in_window(Feed(spark, sf_dir).calls()[0], "2024-01-01 12:00:00", "2024-01-02 00:00:00").select("mmsi", _s("arrived_utc").alias("arrived_s"))


@_query("SELECT mmsi, ts AS ts_s, source_line, cog FROM log WHERE ts >= 1704088800 AND ts < 1704096000")
def track_range(spark, sf_dir):
    return L.track(Feed(spark, sf_dir).log(), "2024-01-01 06:00:00", "2024-01-01 08:00:00").select("mmsi", _s("ts_utc").alias("ts_s"), "source_line", "cog")


@_query("SELECT count(*) AS fixes, count(DISTINCT mmsi) AS vessels FROM log WHERE lat BETWEEN 55.9 AND 57.9 AND lon BETWEEN 10.1 AND 12.9")
def fixes_in_kattegat(spark, sf_dir):
    return Feed(spark, sf_dir).log().where(in_region("Kattegat")).agg(F.count("*").alias("fixes"), F.countDistinct("mmsi").alias("vessels"))


@_query("SELECT min(first_seen) AS from_s, max(last_seen) AS to_s FROM vessels")
def feed_window(spark, sf_dir):
    return L.feed_window(Feed(spark, sf_dir).vessels()).select(_s("from_utc").alias("from_s"), _s("to_utc").alias("to_s"))


_FLEET = """, recent AS (SELECT f.*, s.started AS st, s.agrees AS ag FROM fixes f LEFT JOIN stops s ON s.mmsi = f.mmsi AND f.ts BETWEEN s.started AND s.ended WHERE f.ts <= 1704088800 AND f.ts >= 1704088800 - 3600),
  newest AS (SELECT mmsi, max(ts) AS heard, arg_max(st, ts) AS st, arg_max(ag, ts) AS ag, arg_max(CASE WHEN r12 THEN 1 ELSE 0 END, ts) AS r12, count(st) AS any_st, arg_max(CASE WHEN st IS NULL THEN 0 ELSE 1 END, ts) AS in_st FROM recent GROUP BY mmsi),
  fleet AS (SELECT r.mmsi, any_value(n.heard) AS heard, arg_max(r.lat, r.ts) AS lat, arg_max(r.lon, r.ts) AS lon, count(*) AS trail, CASE WHEN any_value(n.in_st) = 1 AND NOT any_value(n.ag) THEN 'StoppedClaimingUnderWay' WHEN any_value(n.in_st) = 1 THEN 'Stopped' WHEN any_value(n.r12) = 1 THEN 'MovingClaimingStationary' ELSE 'Moving' END AS state
    FROM recent r JOIN newest n ON n.mmsi = r.mmsi WHERE r.reliable AND r.ts >= n.heard - 3600 GROUP BY r.mmsi HAVING any_value(n.heard) >= (SELECT max(ts) FROM recent) - 1800)"""


def _fleet(spark, sf_dir) -> DataFrame:
    f = Feed(spark, sf_dir)
    v = f.vessels()
    return fleet_state(f.fixes(), f.stops(), v, "2024-01-01 06:00:00")


@_query(_FLEET + " SELECT mmsi, lat, lon, state, trail, heard AS heard_s FROM fleet")
def fleet(spark, sf_dir):
    return _fleet(spark, sf_dir).select("mmsi", "lat", "lon", "state", F.size("trail").cast("bigint").alias("trail"), _s("last_heard_utc").alias("heard_s"))


@_query(_FLEET + " SELECT count(*) AS contacts, count(*) FILTER (state IN ('StoppedClaimingUnderWay', 'MovingClaimingStationary')) AS conflicting FROM fleet")
def fleet_summary(spark, sf_dir):
    return scope_summary(_fleet(spark, sf_dir))


_LOG = """, keyed AS (SELECT *, run * 100000000 + source_line AS key, lag(r12, 1, false) OVER w AS prev12, lag(run * 100000000 + source_line) OVER w AS prevkey FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY ts, run, source_line)),
  log_entries AS (
  SELECT k.mmsi, k.ts, k.run, k.source_line, CASE WHEN agrees THEN 'Stopped' ELSE 'StoppedClaimingUnderWay' END AS kind FROM keyed k JOIN stops s ON s.mmsi = k.mmsi AND s.first_key = k.key UNION ALL
  SELECT k.mmsi, k.ts, k.run, k.source_line, 'StopEnded' FROM keyed k JOIN stops s ON s.mmsi = k.mmsi AND s.last_key = k.prevkey UNION ALL
  SELECT mmsi, ts, run, source_line, 'MovingClaimingStationary' FROM keyed WHERE r12 AND NOT prev12)"""


def _log_of(f: Feed) -> DataFrame:
    v = f.vessels()
    c, p = f.calls()
    return ships_log(f.fixes(), f.stops(), c, p, v)


@_query(_LOG + " SELECT mmsi, ts AS ts_s, kind, '[r' || run || '·L' || source_line || ']' AS citation FROM log_entries")
def ships_log_entries(spark, sf_dir):
    return _log_of(Feed(spark, sf_dir)).select("mmsi", _s("ts_utc").alias("ts_s"), "kind", "citation")


@_query(_LOG + " SELECT mmsi * 10 + n AS narration_id, 1 AS sentences, CASE WHEN n = 1 THEN 0 ELSE 1 END AS problems, n = 1 AS accepted FROM (SELECT mmsi, min(ts) AS t FROM log_entries WHERE kind = 'StopEnded' GROUP BY mmsi), (SELECT unnest([1, 2, 3]) AS n)")
def cited_text(spark, sf_dir):
    """Three narrations of each vessel's first ended stop: its own words, a wrong figure, and an unknown citation."""
    f = Feed(spark, sf_dir)
    # read three times below, so written once
    log = f.staging.save(_log_of(f).where("kind = 'StopEnded'"), "stops-ended")
    first = log.groupBy("mmsi").agg(F.min_by(F.struct("text", "citation"), "ts_utc").alias("e"))
    text = F.array(F.concat("e.text", F.lit(" "), "e.citation"), F.concat(F.lit("It waited 987654 h "), "e.citation", F.lit(".")), F.lit("It sailed [r9·L9]."))
    n = first.select("mmsi", F.posexplode(text).alias("i", "text")).select((F.col("mmsi") * 10 + F.col("i") + 1).alias("narration_id"), "text")
    evidence = log.join(first.select("mmsi", F.col("e.citation").alias("citation")), ["mmsi", "citation"])
    verdicts, _ = validate_cited_text(n, evidence.select("citation", "ts_utc", "text"))
    return verdicts.select("narration_id", "sentences", F.col("problems").cast("int").alias("problems"), "accepted")


def demo_terms(calls: DataFrame) -> DataFrame:
    """Terms that differ by vessel, with one exception for every other one."""
    m = F.col("mmsi")
    ex = F.array(F.struct((F.col("arrived_utc") + F.expr("INTERVAL 10 MINUTES")).alias("from_utc"), (F.col("arrived_utc") + F.expr("INTERVAL 30 MINUTES")).alias("to_utc"), F.lit("rain").alias("reason"))).cast(EXCEPTIONS)
    return calls.select(
        "mmsi", "arrived_utc", ((m % 5) * 0.25).alias("allowed_hours"), (F.lit(2_800_000) + m % 1000).alias("rate_minor"), F.lit("USD").alias("currency"), (F.col("arrived_utc") - F.expr("INTERVAL 1 HOUR")).alias("notice_utc"), F.lit(False).alias("notice_assumed"),
        F.when(m % 3 == 0, "TurnTimeAfterNotice").when(m % 3 == 1, "OnBerthing").otherwise("TurnTimeOrBerthingWhicheverFirst").alias("commencement"), F.lit(1.0).alias("turn_hours"), F.when(m % 2 == 0, ex).otherwise(F.array().cast(EXCEPTIONS)).alias("exceptions"), (m % 4 < 2).alias("once_on_demurrage"),
    )


_LAYTIME = _TIMELINE + """, priced AS (SELECT *, CASE mmsi % 3 WHEN 0 THEN arrived WHEN 1 THEN berthed ELSE least(arrived, berthed) END AS c0, ((mmsi % 5) * 900)::BIGINT AS allowed FROM timeline WHERE berthed IS NOT NULL AND untrusted = 0),
  ex AS (SELECT *, CASE WHEN mmsi % 2 = 0 THEN greatest(arrived + 600, c0) END AS xf, CASE WHEN mmsi % 2 = 0 THEN least(arrived + 1800, left_berth) END AS xt FROM priced WHERE left_berth >= c0),
  judged_ex AS (SELECT *, coalesce(xt > xf, false) AS has, coalesce(xt > xf, false) AND mmsi % 4 < 2 AND xf - c0 >= allowed AS late FROM ex),
  statements AS (SELECT *, left_berth - c0 - CASE WHEN has AND NOT late THEN xt - xf ELSE 0 END AS used, CASE WHEN has AND NOT late THEN xt - xf ELSE 0 END AS excepted FROM judged_ex)"""


@_query(_LAYTIME + " SELECT mmsi, arrived AS arrived_s, round(used / 3600.0, 6) AS used_hours, round(excepted / 3600.0, 6) AS excepted_hours, round(greatest(0, used - allowed) / 3600.0, 6) AS demurrage_hours, round(greatest(0, allowed - used) / 3600.0, 6) AS saved_hours, CAST(floor(((2800000 + mmsi % 1000) * greatest(0, used - allowed) * 2 + 86400) / 172800) AS BIGINT) AS owed_minor, true AS balanced FROM statements")
def laytime_statements(spark, sf_dir):
    c, p = Feed(spark, sf_dir).calls()
    s, _, _ = assess_laytime(p, demo_terms(c))
    return s.select("mmsi", _s("arrived_utc").alias("arrived_s"), *[_r(x).alias(x) for x in ("used_hours", "excepted_hours", "demurrage_hours", "saved_hours")], "owed_minor", "balanced")


@_query(_LAYTIME + " SELECT mmsi, arrived AS arrived_s, round(used / 3600.0, 6) AS run_hours, round(greatest(0, used - allowed) / 3600.0, 6) AS on_demurrage_hours, round(excepted / 3600.0, 6) AS excepted_hours FROM statements WHERE left_berth > c0")
def laytime_lines(spark, sf_dir):
    """Lines summed by kind: what runs, what of it is on demurrage, what is excepted."""
    c, p = Feed(spark, sf_dir).calls()
    _, lines, _ = assess_laytime(p, demo_terms(c))

    def total(*kinds: str):
        return _r(F.sum(F.when(F.col("kind").isin(*kinds), F.col("hours")).otherwise(0.0)))

    lines = lines.where("kind <> 'BeforeCommencement'")
    return lines.groupBy("mmsi", _s("arrived_utc").alias("arrived_s")).agg(total("Counted", "OnDemurrage").alias("run_hours"), total("OnDemurrage").alias("on_demurrage_hours"), total("Excepted").alias("excepted_hours"))


@_query(_TIMELINE + " SELECT mmsi, arrived AS arrived_s, CASE WHEN berthed IS NULL THEN 'NoBerthPhase' ELSE 'BerthGeometryUntrustworthy' END AS refusal FROM timeline WHERE berthed IS NULL OR untrusted > 0")
def laytime_refusals(spark, sf_dir):
    c, p = Feed(spark, sf_dir).calls()
    _, _, r = assess_laytime(p, demo_terms(c))
    return r.where("refusal IN ('NoBerthPhase', 'BerthGeometryUntrustworthy')").select("mmsi", _s("arrived_utc").alias("arrived_s"), "refusal")


def demo_documents(calls: DataFrame, phases: DataFrame) -> DataFrame:
    """A statement for each call with a berth: made fast and left at offsets by vessel, one suspension, one notice."""
    t = voyage_timeline(phases).where("berthed_utc IS NOT NULL").join(calls.select("mmsi", "arrived_utc", "port_name"), ["mmsi", "arrived_utc"])

    def event(at: str, minutes, label: str, kind: str):
        return F.struct(F.timestamp_seconds(F.unix_seconds(at) + minutes * 60).alias("ts_utc"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("remark"))

    m = F.col("mmsi")
    events = F.array(event("berthed_utc", m % 90, "All fast", "AllFast"), event("departed_berth_utc", m % 25, "Last line off", "LeftBerth"), event("berthed_utc", F.lit(100), "Discharging suspended", "Suspended"), event("berthed_utc", F.lit(110), "Resumed", "Resumed"), event("arrived_utc", F.lit(0), "NOR tendered", "NoticeOfReadinessTendered"))
    doc = F.concat_ws("-", F.col("mmsi").cast("string"), F.unix_seconds("arrived_utc").cast("string"))
    return t.select(doc.alias("doc_id"), "mmsi", F.coalesce("port_name", F.lit("")).alias("port"), F.posexplode(events).alias("event_no", "e")).select("doc_id", "mmsi", "port", "event_no", "e.*")


_DOCS = _TIMELINE + """, docs AS (SELECT mmsi || '-' || arrived AS doc_id, mmsi, arrived, berthed, left_berth, untrusted, berthed + (mmsi % 90) * 60 AS fast, left_berth + (mmsi % 25) * 60 AS gone FROM timeline WHERE berthed IS NOT NULL),
  spans AS (SELECT *, least(arrived, berthed) AS f, greatest(fast, gone, berthed + 6600) AS t FROM docs),
  shared AS (SELECT d.*, c.arrived AS ca, least(d.t, c.departed) - greatest(d.f, c.arrived) AS o FROM spans d JOIN calls c ON c.mmsi = d.mmsi WHERE least(d.t, c.departed) - greatest(d.f, c.arrived) > 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, ca) AS rank, lead(o) OVER (PARTITION BY doc_id ORDER BY o DESC, ca) AS nxt FROM shared)"""


@_query(_DOCS + " SELECT doc_id, ca AS arrived_s, o AS overlap_s, rank, rank = 1 AND (nxt IS NULL OR nxt < o) AS chosen FROM ranked")
def document_calls(spark, sf_dir):
    c, p = Feed(spark, sf_dir).calls()
    return select_calls(document_windows(demo_documents(c, p)), c).select("doc_id", _s("arrived_utc").alias("arrived_s"), "overlap_s", "rank", "chosen")


@_query(_DOCS + """ SELECT verdict, kind, count(*) AS n FROM (
  SELECT 'AllFast' AS kind, CASE WHEN abs(d.fast - t.berthed - 2700) <= 1800 THEN 'Agrees' ELSE 'Disagrees' END AS verdict FROM ranked d JOIN timeline t ON t.mmsi = d.mmsi AND t.arrived = d.ca WHERE d.rank = 1 AND (nxt IS NULL OR nxt < o) AND t.berthed IS NOT NULL AND t.untrusted = 0 UNION ALL
  SELECT 'LeftBerth', CASE WHEN abs(d.gone - t.left_berth) <= 900 THEN 'Agrees' ELSE 'Disagrees' END FROM ranked d JOIN timeline t ON t.mmsi = d.mmsi AND t.arrived = d.ca WHERE d.rank = 1 AND (nxt IS NULL OR nxt < o) AND t.berthed IS NOT NULL AND t.untrusted = 0 UNION ALL
  SELECT 'NoticeOfReadinessTendered', 'AisCannotObserve' FROM ranked d JOIN timeline t ON t.mmsi = d.mmsi AND t.arrived = d.ca WHERE d.rank = 1 AND (nxt IS NULL OR nxt < o) AND t.berthed IS NOT NULL AND t.untrusted = 0 UNION ALL
  SELECT unnest(['CargoCommenced', 'CargoCompleted', 'Anchored', 'AnchorAweigh']), 'AbsentFromStatement' FROM ranked d JOIN timeline t ON t.mmsi = d.mmsi AND t.arrived = d.ca WHERE d.rank = 1 AND (nxt IS NULL OR nxt < o) AND t.berthed IS NOT NULL AND t.untrusted = 0) GROUP BY ALL""")
def document_verdicts(spark, sf_dir):
    comparisons, _, _, _ = _reconciled(Feed(spark, sf_dir))
    return comparisons.groupBy("verdict", "kind").agg(F.count("*").alias("n"))


def _reconciled(f: Feed):
    c, p = f.calls()
    docs = f.staging.save(demo_documents(c, p), "documents")
    terms = docs.groupBy("doc_id").agg(F.min("mmsi").alias("m"), F.min("ts_utc").alias("t0")).select(
        "doc_id", F.lit(1.0).alias("allowed_hours"), F.lit(2_800_000).cast("bigint").alias("rate_minor"), F.lit("USD").alias("currency"), F.col("t0").alias("notice_utc"), F.lit(True).alias("notice_assumed"), F.lit("OnBerthing").alias("commencement"), F.lit(6.0).alias("turn_hours"), F.array().cast(EXCEPTIONS).alias("exceptions"), F.lit(True).alias("once_on_demurrage")
    )
    return reconcile(docs, c, p, terms, staging=f.staging)


#: The chosen call of each document that stands, with what either side says of its end and its suspension.
_STANDING = _DOCS + """, standing AS (
  SELECT d.*, t.berthed AS b0, t.left_berth AS b1, t.untrusted AS u0, c.port AS ais_port, coalesce(own.port, '') AS document_port, d.berthed + 6000 AS s0, d.berthed + 6600 AS s1
  FROM ranked d JOIN timeline t ON t.mmsi = d.mmsi AND t.arrived = d.ca JOIN calls c ON c.mmsi = d.mmsi AND c.arrived = d.ca JOIN calls own ON own.mmsi = d.mmsi AND own.arrived = d.arrived
  WHERE d.rank = 1 AND (nxt IS NULL OR nxt < o) AND t.berthed IS NOT NULL AND t.untrusted = 0)"""


@_query(_STANDING + """, clipped AS (SELECT *, greatest(s0, fast) AS xf, least(s1, gone) AS xt FROM standing),
  used AS (SELECT *, gone - fast - CASE WHEN xt > xf AND NOT xf - fast >= 3600 THEN xt - xf ELSE 0 END AS du, b1 - b0 AS au FROM clipped WHERE gone >= fast),
  owed AS (SELECT *, CAST((2 * 2800000 * greatest(0, du - 3600) + 86400) // 172800 AS BIGINT) AS od, CAST((2 * 2800000 * greatest(0, au - 3600) + 86400) // 172800 AS BIGINT) AS oa, lower(replace(document_port, ' ', '')) AS fd, lower(replace(ais_port, ' ', '')) AS fa FROM used)
  SELECT doc_id, round(du / 3600.0, 6) AS document_used_hours, round(au / 3600.0, 6) AS ais_used_hours, od AS document_owed_minor, oa AS ais_owed_minor, od - oa AS difference_minor, CASE WHEN document_port <> '' AND ais_port IS NOT NULL THEN contains(fd, fa) OR contains(fa, fd) END AS port_names_agree FROM owed""")
def document_prices(spark, sf_dir):
    """What each document and the feed say is owed."""
    _, summary, _, _ = _reconciled(Feed(spark, sf_dir))
    return summary.select("doc_id", _r("document_used_hours").alias("document_used_hours"), _r("ais_used_hours").alias("ais_used_hours"), "document_owed_minor", "ais_owed_minor", "difference_minor", "port_names_agree")


@_query(_STANDING + """ SELECT doc_id, kind, ts_s FROM (SELECT doc_id, 'Suspended' AS kind, s0 AS ts_s FROM standing UNION ALL SELECT doc_id, 'Resumed', s1 FROM standing)""")
def document_events_not_compared(spark, sf_dir):
    """Events of a known kind that no comparison uses."""
    _, _, _, rest = _reconciled(Feed(spark, sf_dir))
    return rest.select("doc_id", "kind", _s("ts_utc").alias("ts_s"))


@_query(_DOCS + """, best AS (SELECT doc_id, any_value(o) AS any_o, bool_or(rank = 1 AND (nxt IS NULL OR nxt < o)) AS chosen FROM ranked GROUP BY doc_id)
  SELECT d.doc_id, CASE WHEN b.doc_id IS NULL THEN 'NoCallInDocumentTime' WHEN NOT b.chosen THEN 'AmbiguousCall' WHEN t.berthed IS NULL THEN 'NoBerthPhase' WHEN t.untrusted > 0 THEN 'BerthGeometryUntrustworthy' ELSE 'document: completed before laytime commenced' END AS refusal
  FROM docs d LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.rank = 1 AND b.chosen LEFT JOIN timeline t ON t.mmsi = d.mmsi AND t.arrived = r.ca
  WHERE b.doc_id IS NULL OR NOT b.chosen OR t.berthed IS NULL OR t.untrusted > 0 OR d.gone < d.fast""")
def document_refusals(spark, sf_dir):
    _, _, refusals, _ = _reconciled(Feed(spark, sf_dir))
    return refusals.select("doc_id", "refusal")
