"""A position feed derived from the `events` table by integer expressions, so that any engine derives the same.

Every event is a line of a vessel (its user) at ten-minute steps, with longer gaps at times. Slow and fast stretches
alternate; some lines repeat, some hold sentinels, impossible speeds or text that cannot be parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import FEED_COLUMNS

#: Fixed values of the derivation.
STATUSES = {"click": "Under way using engine", "view": "At anchor", "signup": "Moored", "purchase": "Constrained by her draught", "error": "Unknown value"}
DESTINATIONS = ["DKSKA", "DK SKA", "SEGOT>PLGDN", "SKAW FOR ORDERS", "SKAGEN", "ÅRHUS"]
SHIP_TYPES = {"BUILDING": "Tanker", "MACHINERY": "Cargo", "AUTOMOBILE": "Passenger"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pointed(name: str, digits: int) -> Column:
    """A column of integers as decimal texts, of which the last digits stand behind the point."""
    size, unit = F.abs(name), 10**digits
    return F.concat(F.when(F.col(name) < 0, "-").otherwise(""), F.expr(f"abs({name}) div {unit}").cast("string"), F.lit("."), F.lpad((size % unit).cast("string"), digits, "0"))


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of day1.csv and day2.csv: source_file, source_line, raw_text, fields."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))
    ev = ev.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    ev = ev.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id", "left")
    e, u, rn = F.col("event_id"), F.col("user_id"), F.col("rn")
    minutes = rn * 10 + F.expr("rn div 17") * 90 + F.expr("rn div 34") * 720
    step = F.when(F.expr("(rn div 12) % 2 = 0"), 2).otherwise(300)
    lat = F.when(e % 499 == 0, 91_000_000).otherwise(55_000_000 + (u % 40) * 50_000 + (e % 11) * step + F.expr("rn div 24") * 400_000 + F.when(e % 211 == 0, 500_000).otherwise(0))
    lon = F.when(e % 499 == 0, 0).otherwise(10_000_000 + (u % 37) * 80_000 + (e % 11) * step)
    sog = F.when(e % 13 == 0, None).when(e % 997 == 0, 415).when(F.expr("(rn div 6) % 2 = 0"), e % 5).otherwise(10 + (e % 60) * 5)
    draught = F.when(e % 7 != 0, 100 + F.expr("(rn div 30) % 4") * 6)
    ev = ev.withColumns({"_lat": lat, "_lon": lon, "_sog": sog, "_cog": e % 3600, "_draught": draught, "_seconds": F.lit(1704067200) + minutes * 60})
    form = "dd/MM/yyyy HH:mm:ss"
    none = F.lit("")

    def mapped(c: Column, values: dict[str, str], rest: str) -> Column:
        out = F.lit(rest)
        for k, v in values.items():
            out = F.when(c == k, v).otherwise(out)
        return out

    tenth = lambda c: F.coalesce(_pointed(c, 1), none)
    values = {
        "Timestamp": F.when(e % 701 == 0, "not a time").otherwise(F.date_format(F.timestamp_seconds("_seconds"), form)), "Type of mobile": F.lit("Class A"), "MMSI": F.when(e % 883 == 0, "MMSI").otherwise((u + 200_000_000).cast("string")), "Latitude": _pointed("_lat", 6), "Longitude": _pointed("_lon", 6),
        "Navigational status": mapped(F.col("event_type"), STATUSES, "Unknown value"), "SOG": tenth("_sog"), "COG": tenth("_cog"), "Name": F.when(e % 5 == 0, F.concat(F.lit("VESSEL "), u.cast("string"))).otherwise("Unknown"),
        "Ship type": F.when(e % 4 == 0, "Undefined").otherwise(mapped(F.coalesce("c_mktsegment", none), SHIP_TYPES, "Undefined")), "Length": F.when(e % 6 == 0, (100 + u % 200).cast("string")).otherwise(none),
        "Draught": tenth("_draught"), "Destination": F.when(F.col("k") % 7 == 6, "Unknown").otherwise(F.get(F.array(*[F.lit(d) for d in DESTINATIONS]), F.col("k") % 7)),
        "ETA": F.when(e % 3 == 0, none).otherwise(F.date_format(F.timestamp_seconds(F.col("_seconds") + (e % 400) * 86400), form)),
    }
    # made in parts behind inline, for all in one projection are a method of generated code too long to be compiled
    names = list(values)
    for part in (names[:4], names[4:7], names[7:]):
        ev = ev.withColumn("_part", F.array(F.struct(*[F.coalesce(values[c], none).alias(c) for c in part])))
        ev = ev.select(*[c for c in ev.columns if c != "_part"], F.inline_outer("_part"))
    fields = F.array(*[F.col(c) if c in values else none for c in FEED_COLUMNS])
    fields = F.slice(fields, F.lit(1), F.when(e % 911 == 0, 25).otherwise(len(FEED_COLUMNS)))
    day = F.when(rn < 50, "day1.csv").otherwise("day2.csv")
    copies = F.array(
        F.struct(day.alias("f"), (e + 2).alias("n")), F.when(e % 10 == 0, F.struct(day.alias("f"), (e + 10_000_002).alias("n"))), F.when(rn.between(45, 49), F.struct(F.lit("day2.csv").alias("f"), (e + 20_000_002).alias("n"))),
    )
    # copies that a line doesn't have go after the explode, which is compiled; a lambda within it would be interpreted
    out = ev.select(fields.alias("fields"), F.explode(copies).alias("c")).where("c IS NOT NULL")
    return out.select(F.col("c.f").alias("source_file"), F.col("c.n").cast("bigint").alias("source_line"), F.array_join("fields", ",").alias("raw_text"), "fields")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A port for every nation, on the feed's grid."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select((n + 1000).cast("int").alias("wpi_number"), F.concat(F.lit("PORT "), n.cast("string")).alias("port_name"), F.concat(F.lit("C"), (n % 5).cast("string")).alias("country"), (55.0 + n * 0.11).alias("latitude_deg"), (10.0 + (n * 7 % 25) * 0.12).alias("longitude_deg"), n.cast("bigint").alias("ordinal"))


#: The same feed, log, flags, stops and calls in DuckDB's SQL, derived from the tables and not from text lines.
SQL_FEED = """
WITH ev AS (
  SELECT event_id AS e, user_id AS u, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, c_mktsegment AS seg
  FROM events LEFT JOIN customer ON c_custkey = user_id
), typed AS (
  SELECT *, 200000000 + u AS mmsi, 1704067200 + 60 * (rn * 10 + (rn // 17) * 90 + (rn // 34) * 720) AS ts,
    CASE WHEN e % 499 = 0 THEN 91.0::DOUBLE ELSE (55000000 + (u % 40) * 50000 + (e % 11) * (CASE WHEN (rn // 12) % 2 = 0 THEN 2 ELSE 300 END) + (rn // 24) * 400000 + CASE WHEN e % 211 = 0 THEN 500000 ELSE 0 END)::DOUBLE / 1000000.0::DOUBLE END AS lat,
    CASE WHEN e % 499 = 0 THEN 0.0::DOUBLE ELSE (10000000 + (u % 37) * 80000 + (e % 11) * (CASE WHEN (rn // 12) % 2 = 0 THEN 2 ELSE 300 END))::DOUBLE / 1000000.0::DOUBLE END AS lon,
    CASE WHEN e % 13 = 0 THEN NULL WHEN e % 997 = 0 THEN 41.5::DOUBLE WHEN (rn // 6) % 2 = 0 THEN (e % 5)::DOUBLE / 10.0::DOUBLE ELSE (10 + (e % 60) * 5)::DOUBLE / 10.0::DOUBLE END AS sog,
    (e % 3600)::DOUBLE / 10.0::DOUBLE AS cog,
    CASE event_type WHEN 'click' THEN 'Under way using engine' WHEN 'view' THEN 'At anchor' WHEN 'signup' THEN 'Moored' WHEN 'purchase' THEN 'Constrained by her draught' ELSE 'Unknown value' END AS status,
    CASE WHEN e % 7 = 0 THEN NULL ELSE (100 + ((rn // 30) % 4) * 6)::DOUBLE / 10.0::DOUBLE END AS draught,
    CASE k % 7 WHEN 0 THEN 'DKSKA' WHEN 1 THEN 'DK SKA' WHEN 2 THEN 'SEGOT>PLGDN' WHEN 3 THEN 'SKAW FOR ORDERS' WHEN 4 THEN 'SKAGEN' WHEN 5 THEN 'ÅRHUS' END AS dest,
    CASE WHEN e % 3 = 0 THEN NULL ELSE 1704067200 + 60 * (rn * 10 + (rn // 17) * 90 + (rn // 34) * 720) + (e % 400) * 86400 END AS eta,
    CASE WHEN e % 4 = 0 THEN NULL WHEN seg = 'BUILDING' THEN 'Tanker' WHEN seg = 'MACHINERY' THEN 'Cargo' WHEN seg = 'AUTOMOBILE' THEN 'Passenger' END AS ship_type,
    CASE WHEN e % 5 = 0 THEN 'VESSEL ' || u END AS name, CASE WHEN e % 6 = 0 THEN (100 + u % 200)::DOUBLE END AS length_m,
    CASE WHEN e % 911 = 0 THEN 'expected 26 fields, found 25' WHEN e % 701 = 0 THEN 'unreadable timestamp' WHEN e % 883 = 0 THEN 'unreadable MMSI' END AS failure,
    CASE WHEN rn < 50 THEN 'day1.csv' ELSE 'day2.csv' END AS day
  FROM ev
), lines AS (
  SELECT day AS source_file, e + 2 AS source_line, * FROM typed UNION ALL
  SELECT day, e + 10000002, * FROM typed WHERE e % 10 = 0 UNION ALL
  SELECT 'day2.csv', e + 20000002, * FROM typed WHERE rn BETWEEN 45 AND 49
), judged AS (
  SELECT *, CASE WHEN status IN ('At anchor', 'Moored', 'Aground') THEN 'Stationary' WHEN status IN ('Under way using engine', 'Constrained by her draught') THEN 'UnderWay' ELSE 'Unknown' END AS activity,
    CASE WHEN failure IS NOT NULL THEN 'R1' WHEN lat = 91 THEN 'R4' WHEN sog > 40 THEN 'R6' END AS reject,
    failure IS NULL AND sog IS NULL AS r5, failure IS NULL AND sog >= 30 AND sog <= 40 AS r6, coalesce(failure IS NULL AND status IN ('At anchor', 'Moored', 'Aground') AND sog > 3.0, false) AS r12, failure IS NULL AND eta - ts > 5184000 AS r13
  FROM lines
), log AS (
  SELECT * EXCLUDE (nth), CASE WHEN source_file = 'day1.csv' THEN 1 ELSE 2 END AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY mmsi, ts, lat, lon ORDER BY source_file, source_line) AS nth FROM judged WHERE reject IS NULL) WHERE nth = 1
), gaps AS (
  SELECT *, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(sog) OVER w AS psog FROM log WINDOW w AS (PARTITION BY mmsi ORDER BY ts, run, source_line)
), dist AS (
  SELECT *, ts - pts AS dt, 2 * (6371000.0 / 1852.0) * asin(least(1.0, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) AS nm FROM gaps
), pairs AS (
  SELECT *, coalesce(nm > 0.5 AND dt > 0 AND nm / (dt / 3600.0) > 50, false) AS p7, coalesce(dt > 3600, false) AS p8,
    coalesce(psog IS NOT NULL AND nm > 0.1 AND dt > 0 AND nm / (dt / 3600.0) > 3 * psog AND nm / (dt / 3600.0) > psog + 3, false) AS p11 FROM dist
), fixes AS (
  SELECT *, lead(p7, 1, false) OVER w AS n7, lead(p8, 1, false) OVER w AS n8, lead(p11, 1, false) OVER w AS n11, NOT (p7 OR p11 OR lead(p7, 1, false) OVER w OR lead(p11, 1, false) OVER w) AS reliable
  FROM pairs WINDOW w AS (PARTITION BY mmsi ORDER BY ts, run, source_line)
), segs AS (
  SELECT *, sum(CASE WHEN p8 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY ts, run, source_line ROWS UNBOUNDED PRECEDING) AS seg_no, CASE WHEN sog < 0.5 THEN 1 WHEN sog >= 1.0 THEN 0 END AS sig FROM fixes
), states AS (
  SELECT *, last_value(sig IGNORE NULLS) OVER s AS state, sum(CASE WHEN sig = 0 THEN 1 ELSE 0 END) OVER s AS leaves, row_number() OVER s AS nth_in_seg, count(sog) OVER s AS known
  FROM segs WINDOW s AS (PARTITION BY mmsi, seg_no ORDER BY ts, run, source_line ROWS UNBOUNDED PRECEDING)
), marked AS (
  SELECT *, max(leaves) OVER (PARTITION BY mmsi, seg_no) > leaves AS closed, CASE WHEN seg_no = 0 THEN nth_in_seg = 1 ELSE sog IS NOT NULL AND known = 1 END AS edge FROM states
), in_stop AS (
  SELECT *, avg(lat) FILTER (reliable) OVER x AS clat, avg(lon) FILTER (reliable) OVER x AS clon FROM marked WHERE state = 1 WINDOW x AS (PARTITION BY mmsi, seg_no, leaves)
), claims AS (
  SELECT mmsi, seg_no, leaves, status, count(*) AS c, row_number() OVER (PARTITION BY mmsi, seg_no, leaves ORDER BY count(*) DESC, status) AS r FROM in_stop GROUP BY mmsi, seg_no, leaves, status
), stops0 AS (
  SELECT mmsi, seg_no, leaves, min(ts) AS started, max(ts) AS ended, any_value(clat) AS clat, any_value(clon) AS clon,
    max(2 * (6371000.0 / 1852.0) * asin(least(1.0, sqrt(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lon - clon) / 2), 2))))) FILTER (reliable) AS drift,
    count(*) AS n, count(*) FILTER (reliable) AS nr, bool_and(closed) AS closed, arg_min(edge, ts) AS edge,
    arg_min(draught, ts) FILTER (draught IS NOT NULL) AS d_first, arg_max(draught, ts) FILTER (draught IS NOT NULL) AS d_last, min(run * 100000000 + source_line) AS any_key,
    arg_min(run * 100000000 + source_line, ts * 1000000000 + run * 100000000 + source_line) AS first_key, arg_max(run * 100000000 + source_line, ts * 1000000000 + run * 100000000 + source_line) AS last_key
  FROM in_stop GROUP BY mmsi, seg_no, leaves
), stops AS (
  SELECT s.*, (ended - started) / 3600.0 AS hours, nr >= 2 AND 2 * nr >= n AS trusted, c.status AS said, c.status NOT IN ('Under way using engine', 'Constrained by her draught') AS agrees, closed AND NOT edge AS complete
  FROM stops0 s JOIN claims c ON c.mmsi = s.mmsi AND c.seg_no = s.seg_no AND c.leaves = s.leaves AND c.r = 1 WHERE n >= 2 AND ended - started >= 1800 AND nr >= 1
), chain AS (
  SELECT *, lag(ended) OVER w AS pe, lag(clat) OVER w AS pclat, lag(clon) OVER w AS pclon, CASE WHEN NOT trusted THEN 'Unknown' WHEN drift / sqrt(greatest(hours, 1 / 3600.0)) < 0.008 THEN 'Berth' ELSE 'Anchorage' END AS phase
  FROM stops WINDOW w AS (PARTITION BY mmsi ORDER BY started)
), numbered AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR started - pe > 43200 OR 2 * (6371000.0 / 1852.0) * asin(least(1.0, sqrt(pow(sin(radians(clat - pclat) / 2), 2) + cos(radians(pclat)) * cos(radians(clat)) * pow(sin(radians(clon - pclon) / 2), 2)))) > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY started ROWS UNBOUNDED PRECEDING) AS call_no FROM chain
), phases AS (
  SELECT *, min(started) OVER (PARTITION BY mmsi, call_no) AS arrived, row_number() OVER (PARTITION BY mmsi, call_no ORDER BY started) - 1 AS seq FROM numbered
), calls0 AS (
  SELECT mmsi, arrived, max(ended) AS departed, sum(CASE WHEN phase = 'Anchorage' THEN hours ELSE 0 END) AS waiting, sum(CASE WHEN phase = 'Berth' THEN hours ELSE 0 END) AS working, sum(CASE WHEN phase = 'Unknown' THEN hours ELSE 0 END) AS unclassified,
    avg(clat) AS clat, avg(clon) AS clon, bool_and(complete) AS complete, count(*) AS n, arg_min(d_first, seq) FILTER (d_first IS NOT NULL) AS d_in, arg_max(d_last, seq) FILTER (d_last IS NOT NULL) AS d_out
  FROM phases GROUP BY mmsi, arrived
), ports AS (
  SELECT (n_nationkey + 1000)::INTEGER AS wpi, 'PORT ' || n_nationkey AS port, 'C' || (n_nationkey % 5) AS country, 55.0::DOUBLE + n_nationkey * 0.11::DOUBLE AS plat, 10.0::DOUBLE + (n_nationkey * 7 % 25) * 0.12::DOUBLE AS plon, n_nationkey AS ord FROM nation
), near AS (
  SELECT mmsi, arrived, wpi, port, country, 2 * (6371000.0 / 1852.0) * asin(least(1.0, sqrt(pow(sin(radians(plat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(plat)) * pow(sin(radians(plon - clon) / 2), 2)))) AS nm, ord FROM calls0, ports
), named AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, arrived ORDER BY nm, ord) AS r FROM near WHERE nm <= 25) WHERE r = 1
), calls AS (
  SELECT c.*, wpi, port, country, nm, coalesce(nm <= 5, false) AS at_port,
    CASE WHEN d_out IS NULL OR d_in IS NULL THEN 'Unknown' WHEN abs(d_out - d_in) <= 0.5 THEN 'Unchanged' WHEN d_out < d_in THEN 'Discharged' ELSE 'Loaded' END AS cargo
  FROM calls0 c LEFT JOIN named p ON p.mmsi = c.mmsi AND p.arrived = c.arrived
), vessels AS (
  SELECT mmsi, arg_max(name, (source_file, source_line)) FILTER (name IS NOT NULL) AS name, arg_max(ship_type, (source_file, source_line)) FILTER (ship_type IS NOT NULL) AS ship_type,
    arg_max(length_m, (source_file, source_line)) FILTER (length_m IS NOT NULL) AS length_m, min(ts) AS first_seen, max(ts) AS last_seen
  FROM judged WHERE failure IS NULL GROUP BY mmsi
), flags AS (
  SELECT mmsi, ts, run, source_line, lat, lon, sog, status, r12, unnest(list_filter(['R5', 'R6', 'R12', 'R13', 'R7', 'R8', 'R11'], lambda x, i: [r5, r6, r12, r13, p7 OR n7, p8 OR n8, p11 OR n11][i])) AS rule_id FROM fixes
)
"""
