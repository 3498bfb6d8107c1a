"""Reports from daily partials against those of the fixes, and archives read as streams."""

from __future__ import annotations

import random
import zipfile
from datetime import datetime, timedelta

import pytest

from tidewake.operators import reports, rollups
from tidewake.operators.ingest import ingest
from tidewake.sources import feed

from .test_text_and_documents import FEED_COLUMNS, line, lines_frame

SCHEMA = "mmsi bigint, ts_utc timestamp, eta_utc timestamp, destination string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_partials_give_the_reports_of_the_fixes(spark, tmp_path):
    rng, t0 = random.Random(2), datetime(2024, 3, 1)
    made = []
    for _ in range(3000):
        at = t0 + timedelta(minutes=rng.randint(0, 4 * 1440 - 1))
        made.append((rng.randint(1, 400), at, rng.choice([None, at + timedelta(hours=rng.choice([-30, -2, 0, 23, 24, 24 * 70]))]), rng.choice([None, "DKSKA", "SKAGEN", "A>B"])))
    fixes = spark.createDataFrame(made, SCHEMA)
    root = str(tmp_path / "partials")
    rollups.write_partials(fixes.where("ts_utc < '2024-03-03'"), root)
    rollups.write_partials(fixes.where("ts_utc >= '2024-03-02'"), root)  # a day anew, two for the first time
    parts = rollups.read_partials(spark, root)
    for got, want in zip(rollups.eta_horizon(parts), reports.eta_horizon(fixes)):
        assert rows(got) == rows(want)
    assert rows(rollups.destination_counts(parts)) == rows(reports.destination_counts(fixes).select(*rollups.destination_counts(parts).columns))
    assert rows(rollups.destination_typists(parts)) == rows(reports.destination_typists(fixes))
    exact = {r["destination"]: r for r in reports.destination_counts(fixes).collect()}
    for r in rollups.destination_estimates(parts).collect():
        assert r["fixes"] == exact[r["destination"]]["fixes"] and abs(r["vessels_estimate"] - exact[r["destination"]]["vessels"]) <= 0.04 * exact[r["destination"]]["vessels"]
    two = rollups.read_partials(spark, root, "2024-03-02", "2024-03-03")
    inside = fixes.where("ts_utc >= '2024-03-02' AND ts_utc < '2024-03-04'")
    assert rows(rollups.destination_typists(two)) == rows(reports.destination_typists(inside))
    scan = rollups.destination_counts(two)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in scan


@pytest.mark.parametrize("streams", [True, False])
def test_archives(spark, tmp_path, monkeypatch, streams):
    if not streams:  # a store that only Spark reads
        monkeypatch.setattr(feed, "_reachable", lambda uri: False)
    lines = lines_frame(spark, [line(SOG=str(i % 30)) for i in range(25_000)] + ["", line(Name='"A, B"')])
    folder = tmp_path / "zips"
    assert feed.write_zips(lines, f"file://{folder}") == lines.select("source_file").distinct().count()
    with zipfile.ZipFile(tmp_path / "zips" / "empty.zip", "w") as z:
        z.writestr("readme.txt", "no lines")
    with zipfile.ZipFile(tmp_path / "zips" / "other.zip", "w") as z:
        z.writestr("a.txt", "x")
        z.writestr("b.csv", "﻿# " + ",".join(FEED_COLUMNS) + "\r\n" + line() + "\r\n\r\n" + line() + "\r\n")
        z.writestr("c.csv", "never read")
    got = feed.unpack_zips(spark, f"{folder}/*.zip", str(tmp_path / "staging"))
    other = sorted((r["source_line"], r["raw_text"]) for r in got.where("archive = 'other.zip'").collect())
    assert other == [(2, line()), (4, line())] and got.where("archive = 'empty.zip'").count() == 0
    rest = got.where("archive NOT IN ('other.zip', 'empty.zip')")
    texts = [r["raw_text"] for r in lines.orderBy("source_line").collect()]
    assert [(r["source_line"], r["raw_text"]) for r in rest.orderBy("source_line").collect()] == [(i + 2, t) for i, t in enumerate(texts) if t]
    assert rest.selectExpr("max(size(fields))").first()[0] == len(FEED_COLUMNS)


def test_the_limit_is_in_lines_of_the_file(spark):
    lines = lines_frame(spark, [line(Timestamp=f"01/01/2025 00:{m:02d}:00") for m in range(30)])
    first = lines.agg({"source_line": "min"}).first()[0]
    counters = ingest(lines, limit=10).counters.first()
    assert counters["rows_read"] == sum(first + i <= 11 for i in range(30)) == counters["rows_inserted"] and counters["balanced"]
