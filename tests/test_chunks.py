"""Chunked scans against whole-track windows on random tracks."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

from tidewake.operators.annotate import annotate
from tidewake.operators.chunks import annotate_and_detect, annotate_chunks, chunk_tracks, mark_stops_chunks
from tidewake.operators.stops import detect_stops, mark_stops

T0 = datetime(2024, 1, 1)
SCHEMA = "mmsi bigint, ts_utc timestamp, lat double, lon double, sog_kn double, nav_status string, draught_m double, quality_flags array<string>, ingest_run_id bigint, source_line bigint"


def tracks(spark, seed, vessels=40, longest=120):
    """Random tracks with gaps, jumps, missing speeds, fixes of one second and a vessel of most fixes."""
    rng, rows = random.Random(seed), []
    for mmsi in range(vessels):
        at, lat, slow = T0, 55.0, True
        for _ in range(600 if mmsi == 0 else rng.randint(1, longest)):
            at += timedelta(minutes=rng.choice([0, 1, 5, 10, 30, 60, 61, 300] if rng.random() < 0.2 else [1, 5, 10]))
            slow = slow if rng.random() < 0.9 else not slow
            lat += rng.choice([0.0, 1e-5, -1e-5]) + (0.5 if rng.random() < 0.03 else 0)
            sog = rng.choice([None, 0.0, 0.3, 0.7] if slow else [None, 0.6, 1.0, 9.0])
            rows.append((mmsi, at, lat, 10.0, sog, rng.choice(["Moored", "Under way using engine", "", None]), rng.choice([None, 7.0, 8.5]), ["R12", "R7"] if rng.random() < 0.05 else [], rng.choice([1, 2]), len(rows)))
    return spark.createDataFrame(rows, SCHEMA)


def rounded(df):
    norm = lambda v: round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, (list, tuple)) else v
    return sorted((tuple(map(norm, r)) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("seed, rows", [(1, 1), (2, 7), (3, 50)])
def test_chunks_equal_whole_tracks(spark, seed, rows):
    log = tracks(spark, seed)
    fixes, hits = annotate(log)
    cut = chunk_tracks(log, rows, 60)
    assert cut.select("mmsi", "chunk").distinct().count() > 40
    got, got_hits = annotate_chunks(cut)
    assert rounded(got.drop("chunk")) == rounded(fixes) and rounded(got_hits) == rounded(hits)
    assert rounded(mark_stops_chunks(got).drop("chunk")) == rounded(mark_stops(fixes))
    one, more, stops = annotate_and_detect(log, chunk_rows=rows, bucket_s=60)
    whole = detect_stops(fixes)
    assert whole.count() > 50 and rounded(stops) == rounded(whole) and rounded(one) == rounded(fixes) and rounded(more) == rounded(hits)


def test_only_long_tracks_are_cut(spark):
    log = tracks(spark, 4)
    cut = chunk_tracks(log, 300, 60)
    sizes = {(r["mmsi"], r["chunk"]): r["count"] for r in cut.groupBy("mmsi", "chunk").count().collect()}
    assert {k for k in sizes if k[1]} and {k[0] for k in sizes if k[1]} == {0}
    # a chunk is over by the last bucket at most; here a minute holds a few fixes
    assert max(sizes.values()) <= 310
    plain = annotate_and_detect(log, chunk_rows=10_000)[2]
    assert rounded(plain) == rounded(detect_stops(annotate(log)[0]))


def test_windows_over_fixes_are_within_chunks(spark):
    fixes, _ = annotate_chunks(chunk_tracks(tracks(spark, 5), 50, 60))
    plan = mark_stops_chunks(fixes)._jdf.queryExecution().optimizedPlan().toString()
    # windows of a whole vessel order buckets, chunks or pieces, never fixes
    for window in re.findall(r"\[mmsi#\d+L?(?:, seg#\d+L?)?\], \[([^\]]*)\]", plan):
        assert "ts_utc" not in window, window
    assert re.search(r"\[mmsi#\d+L?, chunk#\d+L?\], \[ts_utc", plan)
