"""Text functions, cited text, documents and sources."""

from __future__ import annotations

import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from tidewake.functions.text import cargo_movement, classify_destination, classify_sof_event, port_names_agree, prorate_minor
from tidewake.operators.cited_text import validate_cited_text
from tidewake.operators.ingest import FEED_COLUMNS, ingest, parse
from tidewake.operators.rules import judge
from tidewake.operators.sof import suspension_periods
from tidewake.sources.feed import read_lines, unpack_zips
from tidewake.sources.reference import read_sof


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_destinations(spark):
    assert column(spark, ["DKSKA", "DK SKA", "SKAGEN", "SEGOT>PLGDN", "SKAW FOR ORDER > X", "ÅRHUS", None], classify_destination) == ["UnLocode", "UnLocode", "FreeText", "Route", "ForOrders", "Unreadable", None]


def test_document_labels(spark):
    labels = ["Vessel unmoored", "All Fast", "anchor aweigh", "Completed discharging", "Discharging commenced", "Resumed", " ", "Tug boat cast off"]
    assert column(spark, labels, classify_sof_event) == ["LeftBerth", "AllFast", "AnchorAweigh", "CargoCompleted", "CargoCommenced", "Resumed", "Other", "Other"]


def test_port_names_and_money(spark):
    df = spark.createDataFrame([("Århus", "Aarhus"), ("Goteborg", "Gothenburg"), ("Port of Gdańsk", "GDANSK"), ("", "X")], "a string, b string")
    assert [r[0] for r in df.select(port_names_agree(F.col("a"), F.col("b"))).collect()] == [True, False, True, None]
    assert [r[0] for r in spark.createDataFrame([(1, 43200), (3, 43200), (2_800_000, 86400)], "r bigint, s bigint").select(prorate_minor(F.col("r"), F.col("s"), 86400)).collect()] == [1, 2, 2_800_000]


def test_draught_dead_band(spark):
    df = spark.createDataFrame([(12.0, 12.5), (12.0, 12.6), (12.6, 12.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(cargo_movement(F.col("a"), F.col("b"))).collect()] == ["Unchanged", "Loaded", "Discharged", "Unknown"]


def test_cited_text(spark):
    evidence = spark.createDataFrame([("[r1·L9]", datetime(2026, 9, 4, 22, 2, 21), "X ends a 14.2 h stop."), ("[r1·L12]", datetime(2026, 9, 5, 1, 0, 0), "X making 4.0 kn.")], "citation string, ts_utc timestamp, text string")
    texts = ["X stopped for 14.2 h. [r1·L9] It made 4.0 kn on 5 September [r1.L12].", "X left at 22:02 [r1·L9].", "X waited 4 hours [r1·L9].", "No source.", "Seen 2026-09-06 [r1·L9].", "So [r7·L7].", ""]
    n = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "narration_id int, text string")
    verdicts, problems = validate_cited_text(n, evidence)
    assert {r["narration_id"]: r["accepted"] for r in verdicts.collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert problems.count() == 5


def test_suspensions(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("d", t(1), "Suspended", 1), ("d", t(2), "Suspended", 2), ("d", t(3), "Resumed", 3), ("d", t(4), "Resumed", 4), ("d", t(5), "Suspended", 5)]
    got = suspension_periods(spark.createDataFrame([(d, x, k, "l", None, n) for d, x, k, n in rows], "doc_id string, ts_utc timestamp, kind string, label string, remark string, event_no int")).collect()
    assert [(r["suspended_utc"], r["resumed_utc"]) for r in got] == [(t(1), t(3))]


def line(**values):
    own = {"Timestamp": "01/01/2025 00:00:00", "MMSI": "219000001", "Latitude": "55.5", "Longitude": "10.5", "SOG": "1.0"} | values
    return ",".join(own.get(c, "") for c in FEED_COLUMNS)


def test_feed_files(spark, tmp_path):
    text = "# " + ",".join(FEED_COLUMNS) + "\n" + line() + "\n" + line(Name='"A, B"') + "\n"
    (tmp_path / "a.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("inner.csv", text)
    plain = read_lines(spark, str(tmp_path / "a.csv"))
    assert [(r["source_line"], r["name"]) for r in parse(plain).orderBy("source_line").collect()] == [(2, None), (3, "A, B")]
    zipped = unpack_zips(spark, str(tmp_path / "a.zip"), str(tmp_path / "staging"))
    assert [(r["source_file"], r["source_line"]) for r in zipped.orderBy("source_line").collect()] == [("inner.csv", 2), ("inner.csv", 3)]


def lines_frame(spark, rows):
    return spark.createDataFrame([("f.csv", i + 2, r, r.split(",")) for i, r in enumerate(rows)], "source_file string, source_line bigint, raw_text string, fields array<string>")


def test_rules_at_their_edges(spark):
    cases = {"91": "R4", "90": None, "90.0001": "R4", "NaN": "R1"}
    got = judge(parse(lines_frame(spark, [line(Latitude=v) for v in cases]))).orderBy("source_line").collect()
    assert [r["reject"]["rule_id"] if r["reject"] else None for r in got] == list(cases.values())
    speeds = {"29.9": [], "30": ["R6"], "40": ["R6"], "": ["R5"]}
    assert [r["quality_flags"] for r in judge(parse(lines_frame(spark, [line(SOG=v) for v in speeds]))).orderBy("source_line").collect()] == list(speeds.values())
    assert judge(parse(lines_frame(spark, [line(SOG="40.0001")]))).first()["reject"]["rule_id"] == "R6"
    moored = [line(SOG=v, **{"Navigational status": "Moored"}) for v in ("3.0", "3.1")]
    assert [r["quality_flags"] for r in judge(parse(lines_frame(spark, moored))).orderBy("source_line").collect()] == [[], ["R12"]]


def test_second_ingest_stores_nothing(spark):
    lines = lines_frame(spark, [line(), line(), line(Latitude="91"), line(MMSI="x"), line(Latitude="56")])
    one = ingest(lines)
    c = one.counters.first()
    assert (c["rows_read"], c["rows_inserted"], c["rows_dup_in_file"], c["rows_quarantined"], c["balanced"]) == (5, 2, 1, 2, True)
    again = ingest(lines, one.positions, one.vessels, run_id=2).counters.first()
    assert (again["rows_inserted"], again["rows_dup_prior_run"], again["balanced"]) == (0, 2, True)


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"MMSI": 219000001, "port": "Skagen", "events": [{"timestampUtc": "2025-01-01T05:00:00Z", "label": "All fast"}, {"timestampUtc": "2025-01-01T01:00:00Z", "label": "x", "kind": "Anchored"}]}')
    (tmp_path / "b.json").write_text('{"mmsi": 0, "events": []}')
    (tmp_path / "c.json").write_text("no json")
    events, rejects = read_sof(spark, str(tmp_path))
    assert [(r["kind"], r["event_no"]) for r in events.orderBy("event_no").collect()] == [("Anchored", 1), ("AllFast", 2)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["no vessel number", "unreadable document"]
