"""Keyed stops of a stream against the stops of the whole log."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators.annotate import annotate
from tidewake.operators.ingest import POSITION_COLUMNS
from tidewake.operators.stops import detect_stops
from tidewake.streaming.stop_state import StopState, keyed_stops

from .test_chunks import rounded, tracks


def positions(spark, seed, vessels=25, longest=60):
    df = tracks(spark, seed, vessels, longest)
    for c in POSITION_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast({"destination": "string", "eta_utc": "timestamp"}.get(c, "double")))
    return df.where("mmsi > 0").select(*POSITION_COLUMNS)


def expected(spark, root):
    log = spark.read.parquet(f"{root}/log").drop("batch")
    return detect_stops(annotate(log)[0])


@pytest.mark.parametrize("late", [False, True])
def test_batches_equal_the_whole_log(spark, tmp_path, late):
    log = positions(spark, 11 if late else 12)
    rng = random.Random(3)
    rows = sorted(log.collect(), key=lambda r: (r["ts_utc"], r["source_line"]))
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    if late:  # some fixes come a batch or more too late
        for i in range(1, len(parts)):
            for _ in range(3):
                parts[i].append(parts[i - 1].pop(rng.randrange(len(parts[i - 1]))))
    state = StopState(spark, str(tmp_path / "s"), buckets=4)
    for i, part in enumerate(parts):
        batch = spark.createDataFrame(part, log.schema)
        state.update(batch, i)
        if i == 2:  # a batch that runs again
            state.update(batch, i)
    want = expected(spark, tmp_path / "s")
    assert want.count() > 20 and rounded(state.stops()) == rounded(want)


def test_a_batch_reads_the_buckets_of_its_vessels(spark, tmp_path):
    log = positions(spark, 13)
    state = StopState(spark, str(tmp_path / "s"), buckets=8)
    state.update(log, 0)
    one = log.where("mmsi = 7").withColumn("ts_utc", F.col("ts_utc") + F.expr("INTERVAL 90 DAYS"))
    state.update(one, 1)
    versions = state._versions()
    assert sorted(len(v) for v in versions.values()) == [1] * (len(versions) - 1) + [2]
    assert rounded(state.stops()) == rounded(expected(spark, tmp_path / "s"))


def test_stream(spark, tmp_path):
    log = positions(spark, 14, vessels=8)
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(keyed_stops(spark, str(tmp_path / "s"), buckets=2)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None and len(StopState(spark, str(tmp_path / "s"))._batches(99)) == 3
    assert rounded(StopState(spark, str(tmp_path / "s"), buckets=2).stops()) == rounded(expected(spark, tmp_path / "s"))
