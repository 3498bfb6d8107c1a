"""What Spark makes of parsing: a record is read once, whatever is asked of it later."""

from __future__ import annotations

from tidewake.operators.ingest import FEED_COLUMNS, parse
from tidewake.operators.rules import judge
from tidewake.sources.feed import with_fields


def lines(spark):
    values = {"Timestamp": "01/01/2024 00:00:00", "MMSI": "219000001", "Latitude": "55.5", "Longitude": "1e400", "SOG": " 7 "}
    good = [values.get(c, "") for c in FEED_COLUMNS]
    near = [*good[:4], "10.25", *good[5:]]
    rows = [("a", 2, ",".join(near)), ("a", 3, ",".join(good)), ("a", 4, ",".join(near[:25])), ("a", 5, ",".join([*near[:2], "x", *near[3:]]))]
    return with_fields(spark.createDataFrame(rows, "source_file string, source_line bigint, raw_text string"))


def test_filter_does_not_repeat_the_record(spark):
    kept = judge(parse(lines(spark))).where("reject IS NULL").select("mmsi", "quality_flags")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(raw_text") == 1


def test_records(spark):
    got = {r["source_line"]: r for r in parse(lines(spark)).collect()}
    assert [got[n]["parse_failure"] for n in (2, 3, 4, 5)] == [None, "unreadable longitude", "expected 26 fields, found 25", "unreadable MMSI"]
    assert (got[2]["lat"], got[2]["lon"], got[2]["sog_kn"], got[2]["cog"], got[2]["imo"]) == (55.5, 10.25, 7.0, None, None)
