"""Registered queries over files, the store, retention, exports, lookups and texts, each with its DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import heading_arrow
from ..functions.text import fold_port_name
from ..operators import listing as L
from ..operators import reports as R
from ..operators.export import export
from ..operators.ingest import FEED_COLUMNS, parse
from ..operators.retention import prune
from ..sources.feed import read_lines
from ..sources.reference import PORT_SCHEMA, SOF_SCHEMA, archive_summary, check_ports, read_archive, sof_documents
from ..sources.store import Store
from .feed import Feed, query
from .queries import _COUNTERS, _DOCS, _RECORDS, _r, _s, demo_documents

CUTOFF = datetime(2024, 1, 1, 12)
#: Day 1, day 2, and day 1 once more, of which nothing may be stored.
FILES = ("day1.csv", "day2.csv", "day1.csv")


def _store(f: Feed, *, detect: bool = False) -> Store:
    store = Store(f.spark, f"{f.staging.root}/store")
    for name in FILES if not detect else FILES[:2]:
        store.run_ingest(f.lines().where(F.col("source_file") == name), name)
    if detect:
        store.run_detect(f.ports())
    return store


_BASE = ", scoped AS (SELECT * FROM judged), base AS (" + _COUNTERS.format(scope="true", scope1="true") + ")"


@query(_BASE + """ SELECT ingest_run_id AS id, 'day' || ingest_run_id || '.csv' AS source_file, rows_read, rows_filtered, rows_inserted, rows_dup_in_file, rows_dup_prior_run, rows_quarantined FROM base
  UNION ALL SELECT 3, 'day1.csv', rows_read, rows_filtered, 0, rows_dup_in_file, rows_dup_prior_run + rows_inserted, rows_quarantined FROM base WHERE ingest_run_id = 1""")
def store_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after three runs; the third reads a file again and stores nothing."""
    return L.runs(_store(Feed(spark, sf_dir)).runs()).select("id", "source_file", "rows_read", "rows_filtered", "rows_inserted", "rows_dup_in_file", "rows_dup_prior_run", "rows_quarantined")


@query("SELECT run AS ingest_run_id, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, count(*) AS fixes, min(source_line) AS first_line, max(source_line) AS last_line FROM log GROUP BY ALL")
def stored_positions(spark, sf_dir):
    """What the store holds of each run and day after three runs."""
    p = _store(Feed(spark, sf_dir)).positions()
    return p.groupBy(F.col("ingest_run_id").cast("bigint").alias("ingest_run_id"), F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("fixes"), F.min("source_line").alias("first_line"), F.max("source_line").alias("last_line"))


@query("SELECT reject AS rule_id, CASE WHEN source_file = 'day1.csv' THEN 1 ELSE 2 END AS ingest_run_id, count(*) AS n FROM judged WHERE reject IS NOT NULL GROUP BY ALL")
def stored_quarantine(spark, sf_dir):
    """Rejects by rule and the run that refused first; the third run adds none."""
    q = _store(Feed(spark, sf_dir)).quarantine()
    return q.groupBy("rule_id", F.col("ingest_run_id").cast("bigint").alias("ingest_run_id")).agg(F.count("*").alias("n"))


@query("SELECT mmsi, name, ship_type, length_m, first_seen AS first_seen_s, last_seen AS last_seen_s FROM vessels")
def stored_vessels(spark, sf_dir):
    v = _store(Feed(spark, sf_dir)).table("vessel")
    return v.select("mmsi", "name", "ship_type", "length_m", _s("first_seen_utc").alias("first_seen_s"), _s("last_seen_utc").alias("last_seen_s"))


@query("SELECT 'stop_event' AS name, count(*) AS n, round(sum(hours), 6) AS hours FROM stops UNION ALL SELECT 'port_call', count(*), round(sum(waiting + working + unclassified), 6) FROM calls UNION ALL SELECT 'port_call_phase', count(*), round(sum(hours), 6) FROM phases")
def stored_projections(spark, sf_dir):
    """Projections after a second detection over the first one's."""
    f = Feed(spark, sf_dir)
    store = _store(f, detect=True)
    store.run_detect(f.ports())
    out = None
    for name, hours in (("stop_event", "duration_hours"), ("port_call", "waiting_hours + working_hours + unclassified_hours"), ("port_call_phase", "duration_hours")):
        part = store.table(name).agg(F.count("*").alias("n"), F.round(F.sum(F.expr(hours)), 6).alias("hours")).select(F.lit(name).alias("name"), "n", "hours")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT (SELECT count(*) FROM log WHERE ts < 1704110400) AS fixes_removed, (SELECT count(*) FROM calls WHERE arrived < 1704110400) AS port_calls_archived, (SELECT count(*) FROM log WHERE ts >= 1704110400) AS fixes_left, 0 AS stops_left,
  (SELECT count(*) FROM calls WHERE arrived < 1704110400 AND NOT complete) AS open_calls, (SELECT count(DISTINCT mmsi) FROM calls WHERE arrived < 1704110400) AS vessels""")
def retention(spark, sf_dir):
    """A prune with its archive: what the retention event says, what is left, and a summary of the archive."""
    f = Feed(spark, sf_dir)
    store = _store(f, detect=True)
    gone = prune(store, CUTOFF, f"{f.staging.root}/archive")
    event = store.retention_events().select("fixes_removed", "port_calls_archived")
    # one row each
    left = store.positions().agg(F.count("*").alias("fixes_left")).crossJoin(store.table("stop_event").agg(F.count("*").alias("stops_left")))
    summary = archive_summary(read_archive(spark, gone.archive_path)[0]).select("open_calls", "vessels")
    return event.crossJoin(left).crossJoin(summary)


@query("SELECT c.mmsi, c.arrived AS arrived_s, c.departed AS departed_s, c.port AS port_name, count(*) AS phases, round(sum(p.hours), 6) AS hours FROM calls c JOIN phases p ON p.mmsi = c.mmsi AND p.arrived = c.arrived WHERE c.arrived < 1704110400 GROUP BY ALL")
def archived_calls(spark, sf_dir):
    """Calls and phases as read back from the archive."""
    f = Feed(spark, sf_dir)
    gone = prune(_store(f, detect=True), CUTOFF, f"{f.staging.root}/archive")
    calls, phases = read_archive(spark, gone.archive_path)
    n = phases.groupBy("mmsi", "arrived_utc").agg(F.count("*").alias("phases"), F.round(F.sum("duration_hours"), 6).alias("hours"))
    return calls.join(n, ["mmsi", "arrived_utc"]).select("mmsi", _s("arrived_utc").alias("arrived_s"), _s("departed_utc").alias("departed_s"), "port_name", "phases", "hours")


@query("SELECT mmsi, arrived AS arrived_s FROM calls WHERE arrived < 1704110400")
def calls_losing_fixes(spark, sf_dir):
    from ..operators.retention import losing_calls

    return losing_calls(Feed(spark, sf_dir).calls()[0], CUTOFF).select("mmsi", _s("arrived_utc").alias("arrived_s"))


@query(_BASE + " SELECT 'day' || ingest_run_id || '.csv' AS source_file, ingest_run_id AS first_run, rows_read, rows_inserted AS rows_stored FROM base")
def export_manifest(spark, sf_dir):
    """The manifest of an export, read back from its JSON."""
    f = Feed(spark, sf_dir)
    export(_store(f, detect=True), f"{f.staging.root}/export")
    return spark.read.schema("source_file string, first_run bigint, rows_read bigint, rows_stored bigint").json(f"{f.staging.root}/export/manifest")


@query(_RECORDS + " SELECT mmsi, arrival_lapses, total_stops, departure_lapses, total_fixes, fastest_kn FROM records")
def export_vessels(spark, sf_dir):
    """The vessels of an export, read back from their JSON."""
    f = Feed(spark, sf_dir)
    export(_store(f, detect=True), f"{f.staging.root}/export")
    return spark.read.schema("mmsi bigint, arrival_lapses bigint, total_stops bigint, departure_lapses bigint, total_fixes bigint, fastest_kn double").json(f"{f.staging.root}/export/vessels")


@query("SELECT 'part-' || (u % 16) || '.csv' AS source_file, count(*) AS n, 2 AS first_line, count(*) + 1 AS last_line, count(*) FILTER (failure IS NOT NULL) AS failed, sum(CASE WHEN failure IS NULL THEN ts END) AS ts_sum FROM lines GROUP BY ALL")
def csv_lines(spark, sf_dir):
    """The feed as CSV files with a header each, read back with line numbers and parsed."""
    f = Feed(spark, sf_dir)
    header = "# " + ",".join(FEED_COLUMNS)
    part = F.concat(F.lit("part-"), (F.col("user_id") % 16).cast("string"), F.lit(".csv"))
    rows = f.staging.save(_lines_of_users(f).select(part.alias("file"), F.lit(1).alias("o"), "raw_text"), "csv-rows")
    rows = rows.unionByName(rows.select("file").distinct().select("file", F.lit(0).alias("o"), F.lit(header).alias("raw_text")))
    path = f"{f.staging.root}/csv"
    rows.repartition("file").sortWithinPartitions("file", "o").select("file", "raw_text").write.partitionBy("file").text(path)
    folder = F.regexp_extract("path", "file=([^/]+)/", 1)  # Spark names the files, the folder is the file of the feed
    parsed = parse(read_lines(spark, f"{path}/file=*/*", folder))
    return parsed.groupBy("source_file").agg(F.count("*").alias("n"), F.min("source_line").alias("first_line"), F.max("source_line").alias("last_line"), F.count_if(F.col("parse_failure").isNotNull()).alias("failed"), F.sum(F.when(F.col("parse_failure").isNull(), _s("ts_utc"))).alias("ts_sum"))


def _lines_of_users(f: Feed) -> DataFrame:
    """Lines with their event's user."""
    e = f.spark.read.parquet(f"{f.sf_dir}/events.parquet").select((F.col("event_id") + 2).alias("at"), "user_id")
    return f.lines().withColumn("at", F.pmod(F.col("source_line"), F.lit(10_000_000))).join(e, "at")


@query("SELECT n_nationkey + 1000 AS wpi_number, 'PORT ' || n_nationkey AS port_name, 'C' || (n_nationkey % 5) AS country, 55.0::DOUBLE + n_nationkey * 0.11::DOUBLE AS latitude_deg, 10.0::DOUBLE + (n_nationkey * 7 % 25) * 0.12::DOUBLE AS longitude_deg FROM nation")
def ports_from_csv(spark, sf_dir):
    """The gazetteer as CSV, read back and checked."""
    f = Feed(spark, sf_dir)
    path = f"{f.staging.root}/ports"
    ports = f.ports().select("wpi_number", "port_name", F.lit("").alias("alternate_name"), F.lit("").alias("un_locode"), "country", "latitude_deg", "longitude_deg")
    ports.write.option("header", True).csv(path)
    rows = spark.read.schema(PORT_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return check_ports(rows.withColumn("ordinal", F.monotonically_increasing_id())).select("wpi_number", "port_name", "country", "latitude_deg", "longitude_deg")


@query(_DOCS + """, told AS (SELECT doc_id, mmsi, unnest([[fast, 1], [gone, 2], [berthed + 6000, 3], [berthed + 6600, 4], [arrived, 5]]) AS x FROM docs)
  SELECT doc_id, mmsi, x[1] AS ts_s, CASE x[2] WHEN 1 THEN 'AllFast' WHEN 2 THEN 'LeftBerth' WHEN 3 THEN 'Suspended' WHEN 4 THEN 'Resumed' ELSE 'NoticeOfReadinessTendered' END AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY x[1], x[2]) AS event_no FROM told""")
def document_events(spark, sf_dir):
    """Statements written as JSON without kinds, read back, classified by their labels and numbered by time."""
    f = Feed(spark, sf_dir)
    c, p = f.calls()
    e = demo_documents(c, p).withColumn("e", F.struct("event_no", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestampUtc"), "label", F.lit(None).cast("string").alias("kind"), "remark"))
    docs = e.groupBy("doc_id", "mmsi", F.lit(None).cast("string").alias("vesselName"), "port", F.lit("agent").alias("preparedBy")).agg(F.array_sort(F.collect_list("e")).alias("events"))
    path = f"{f.staging.root}/statements"
    docs.withColumn("events", F.transform("events", lambda x: x.dropFields("event_no"))).write.json(path)
    events, _ = sof_documents(spark.read.schema(f"doc_id string, {SOF_SCHEMA}").json(path))
    return events.select("doc_id", "mmsi", _s("ts_utc").alias("ts_s"), "kind", "event_no")


@query("SELECT mmsi, name, ship_type FROM vessels WHERE mmsi = 200000007")
def vessel_lookup(spark, sf_dir):
    return L.vessel(Feed(spark, sf_dir).vessels(), 200_000_007).select("mmsi", "name", "ship_type")


@query("SELECT mmsi, arrived AS arrived_s, departed AS departed_s FROM calls WHERE mmsi = 200000007 AND arrived < 1705276800 AND departed > 1704067200")
def vessel_calls_in_window(spark, sf_dir):
    c, _ = Feed(spark, sf_dir).calls()
    return L.calls_of_vessel_in_window(c, 200_000_007, "2024-01-01 00:00:00", "2024-01-15 00:00:00").select("mmsi", _s("arrived_utc").alias("arrived_s"), _s("departed_utc").alias("departed_s"))


@query("SELECT p.mmsi, p.arrived AS arrived_s, p.seq, p.phase FROM phases p JOIN (SELECT mmsi, max(arrived) AS arrived FROM calls GROUP BY mmsi) k ON k.mmsi = p.mmsi AND k.arrived = p.arrived")
def phases_of_latest_calls(spark, sf_dir):
    """Phases of many calls at once: those of each vessel's latest call."""
    c, p = Feed(spark, sf_dir).calls()
    return L.phases_of_calls(p, L.latest_calls(c, 1)).select("mmsi", _s("arrived_utc").alias("arrived_s"), "seq", "phase")


@query("SELECT *, (SELECT count(*) FROM stops) > 1000 AS more FROM (SELECT mmsi, started AS started_s, round(hours, 6) AS duration_hours FROM stops ORDER BY hours DESC, mmsi, started LIMIT 1000)")
def first_page_of_stops(spark, sf_dir):
    """A listing that asks for more than a page may hold, and whether rows lie beyond it."""
    stops = Feed(spark, sf_dir).stops()
    rows, more = L.page(stops.orderBy(F.desc("duration_hours"), "mmsi", "started_utc"), 5000)
    return rows.select("mmsi", _s("started_utc").alias("started_s"), _r("duration_hours").alias("duration_hours"), F.lit(more).alias("more"))


@query("SELECT ['↑', '↗', '→', '↘', '↓', '↙', '←', '↖'][1 + CAST(round_even(cog / 45.0, 0) AS BIGINT) % 8] AS arrow, count(*) AS fixes FROM log GROUP BY 1")
def course_arrows(spark, sf_dir):
    return Feed(spark, sf_dir).log().groupBy(heading_arrow(F.col("cog")).alias("arrow")).agg(F.count("*").alias("fixes"))


@query("SELECT DISTINCT port AS port_name, lower(replace(port, ' ', '')) AS folded FROM calls WHERE port IS NOT NULL")
def folded_ports(spark, sf_dir):
    return Feed(spark, sf_dir).calls()[0].where("port_name IS NOT NULL").select("port_name", fold_port_name(F.col("port_name")).alias("folded")).distinct()


@query("""SELECT mmsi, started AS started_s, round(CASE WHEN complete THEN hours END, 6) AS duration_hours, round(CASE WHEN trusted THEN drift END, 6) AS max_drift_nm, CASE WHEN complete THEN '' ELSE '>=' END || printf('%.1f', hours) AS hours_text,
  CASE WHEN trusted THEN 'known' ELSE '?' END AS drift_known, CASE WHEN complete THEN '' ELSE '(open)' END AS marker FROM stops""")
def stop_figures(spark, sf_dir):
    """Figures of stops as they may be shown."""
    s = L.stop_presentation(Feed(spark, sf_dir).stops())
    return s.select("mmsi", _s("started_utc").alias("started_s"), _r("duration_hours").alias("duration_hours"), _r("max_drift_nm").alias("max_drift_nm"), "hours_text", F.when(F.col("drift_text") == "?", "?").otherwise("known").alias("drift_known"), "marker")


@query("SELECT mmsi, arrived AS arrived_s, CASE WHEN port IS NULL THEN '(none named)' ELSE CASE WHEN at_port THEN '' ELSE '~' END || port END AS port_mark, CASE WHEN complete THEN '' ELSE '(open)' END AS marker FROM calls")
def call_figures(spark, sf_dir):
    """Ports of calls as they may be shown; the distance is left to a test, for engines part on halves."""
    c = L.call_presentation(Feed(spark, sf_dir).calls()[0])
    return c.select("mmsi", _s("arrived_utc").alias("arrived_s"), F.regexp_replace("port_text", " [0-9.]+ nm$", "").alias("port_mark"), "marker")


@query("SELECT mmsi FROM stops WHERE NOT agrees UNION SELECT mmsi FROM fixes WHERE r12")
def vessels_to_name(spark, sf_dir):
    """Vessels of either kind of lapse, once each."""
    f = Feed(spark, sf_dir)
    lapsed = R.stop_status(f.stops()).where("lapses > 0").select("mmsi")
    return lapsed.union(R.fix_status(f.fixes()).select("mmsi")).distinct()


@query("SELECT source_file, min(run) AS first_run FROM (SELECT source_file, CASE WHEN source_file = 'day1.csv' THEN 1 ELSE 2 END AS run FROM lines) GROUP BY 1")
def files_in_run_order(spark, sf_dir):
    return R.manifest(_store(Feed(spark, sf_dir)).runs()).select("source_file", "first_run")
