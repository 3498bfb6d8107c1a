"""The log of both runs is dealt once, from lines whose rules are compiled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators.ingest import settle_runs
from tidewake.operators.rules import judge
from tidewake.plans.feed import Feed


def test_runs_at_once_equal_run_after_run(spark):
    f = Feed(spark, "/root/testdata/sf0.001")
    log = f.log()
    assert "judged" not in f._made  # nothing else asked for judged rows
    one, two = f.runs()
    columns = sorted(log.columns)
    assert sorted(map(str, log.select(columns).collect())) == sorted(map(str, one.positions.unionByName(two.positions).select(columns).collect()))


def test_first_by_run_stays_whatever_its_line(spark):
    rows = [("b", 2, 7, 0.0), ("a", 9, 7, -0.0), ("a", 5, 7, 1.0), ("b", 1, 7, 1.0), ("a", 4, 7, 1.0), ("b", 3, 8, 1.0)]
    df = spark.createDataFrame(rows, "source_file string, source_line bigint, mmsi bigint, lat double")
    df = df.withColumns({"ts_utc": F.timestamp_seconds(F.lit(0)), "lon": F.lit(1.0), "reject": F.lit(None).cast("string"), "ingest_run_id": F.lit(None).cast("bigint"), "quality_flags": F.array().cast("array<string>")})
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("sog_kn", "cog", "heading", "rot", "draught_m")}).withColumns({c: F.lit(None).cast("string") for c in ("nav_status", "destination", "eta_utc")})
    got = settle_runs(df, F.when(F.col("source_file") == "b", 1).otherwise(2))
    assert sorted((r["ingest_run_id"], r["source_line"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 3)]


def test_rules_are_no_lambda(spark):
    f = Feed(spark, "/root/testdata/sf0.001")
    hits = judge(f.staging.save(f.records(), "records")).select("hits")
    assert "lambda" not in hits._jdf.queryExecution().optimizedPlan().toString()
    kinds = {h["rule_id"]: h["action"] for r in hits.collect() for h in r["hits"]}
    assert kinds["R1"] == "Reject" and kinds["R5"] == "Flag" and None not in kinds
