"""Stop detection by windows against a plain state machine, and the edges of thresholds."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewake.operators.calls import chain_port_calls, nearest_port
from tidewake.operators.stops import detect_stops

T0 = datetime(2024, 1, 1)
SCHEMA = "mmsi bigint, ts_utc timestamp, lat double, lon double, sog_kn double, nav_status string, draught_m double, quality_flags array<string>, ingest_run_id bigint, source_line bigint"


def fixes(spark, rows):
    """rows: (mmsi, minute, sog) or with lat."""
    return spark.createDataFrame([(r[0], T0 + timedelta(minutes=r[1]), r[3] if len(r) > 3 else 55.0, 10.0, r[2], "Moored", None, [], 1, i) for i, r in enumerate(rows)], SCHEMA)


def plain(rows):
    """(start, end, complete) of each stop of one vessel, one fix after another."""
    out, current, edge, stopped = [], [], False, False
    clear = False  # a fix with a speed was seen since the last gap
    for i, (m, sog) in enumerate(rows):
        gap = i > 0 and m - rows[i - 1][0] > 60
        if gap:
            if current:
                out.append((current[0], current[-1], False))
            current, stopped, clear = [], False, False
        if sog is not None and sog < 0.5 and not stopped:
            stopped, current = True, []
            edge = i == 0 if not out_of_gap(rows, i) else not clear
        elif sog is not None and sog >= 1.0 and stopped:
            out.append((current[0], current[-1], not edge))
            stopped, current = False, []
        if sog is not None:
            clear = True
        if stopped:
            current.append(m)
    if current:
        out.append((current[0], current[-1], False))
    return [(a, b, c) for a, b, c in out if b - a >= 30]


def out_of_gap(rows, i):
    """Whether some gap lies before fix i."""
    return any(rows[j][0] - rows[j - 1][0] > 60 for j in range(1, i + 1))


def test_random_sequences(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for mmsi in range(1, 301):
        minute, own = 0, []
        for _ in range(rng.randint(2, 25)):
            own.append((minute, rng.choice([None, 0.0, 0.49, 0.5, 0.7, 0.99, 1.0, 5.0])))
            minute += rng.choice([5, 10, 30, 60, 61, 200])
        rows += [(mmsi, m, s) for m, s in own]
        expected[mmsi] = plain(own)
    got: dict = {m: [] for m in expected}
    for r in detect_stops(fixes(spark, rows)).orderBy("mmsi", "started_utc").collect():
        got[r["mmsi"]].append(tuple(int((r[c] - T0).total_seconds() // 60) for c in ("started_utc", "ended_utc")) + (r["is_complete"],))
    assert got == {m: [e for e in v if sum(e[0] <= x[1] <= e[1] for x in rows if x[0] == m) >= 2] for m, v in expected.items()}


def test_minimum_duration(spark):
    rows = []
    for mmsi, minutes in ((1, 29), (2, 30), (3, 31)):
        rows += [(mmsi, 0, 5.0), (mmsi, 10, 0.1), (mmsi, 10 + minutes, 0.1), (mmsi, 10 + minutes + 5, 5.0)]
    assert {r["mmsi"] for r in detect_stops(fixes(spark, rows)).collect()} == {2, 3}


def test_chain_gap_and_radius(spark):
    rows = []
    for mmsi, hours, far in ((1, 11.9, 0), (2, 12.1, 0), (3, 1, 9.9), (4, 1, 10.1)):
        second = 60 + hours * 60
        rows += [(mmsi, 0, 0.1), (mmsi, 60, 0.1), (mmsi, 61, 5.0), (mmsi, second, 0.1, 55 + far / 60.04), (mmsi, second + 60, 0.1, 55 + far / 60.04)]
    calls, phases = chain_port_calls(detect_stops(fixes(spark, rows)))
    assert {r["mmsi"]: r["count"] for r in calls.groupBy("mmsi").count().collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
    assert phases.count() == 8


def test_nearest_port_matches_all_pairs(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.uniform(-85, 85), rng.choice([-179.9, 179.9, 0.0, 10.0]) + rng.uniform(-0.5, 0.5)) for i in range(300)], "id int, lat double, lon double")
    ports = spark.createDataFrame([(i, f"P{i}", "C", lat + rng.uniform(-0.4, 0.4), lon, i) for i, (lat, lon) in enumerate((r["lat"], ((r["lon"] + rng.uniform(-0.6, 0.6) + 180) % 360) - 180) for r in points.collect()[:200])], "wpi_number int, port_name string, country string, latitude_deg double, longitude_deg double, ordinal bigint")
    points = points.withColumn("lon", F.expr("pmod(lon + 180, 360) - 180"))
    got = {r["id"]: r["port_wpi_number"] for r in nearest_port(points, ports, key=["id"], lat="lat", lon="lon").collect()}
    from math import asin, cos, radians, sin, sqrt

    def nm(a, b, c, d):
        h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        return 2 * 6371000 / 1852 * asin(min(1, sqrt(h)))

    all_ports = ports.collect()
    for p in points.collect():
        best = min((nm(p["lat"], p["lon"], q["latitude_deg"], q["longitude_deg"]), q["ordinal"]) for q in all_ports)
        assert got.get(p["id"]) == (best[1] if best[0] <= 25 else None)
