"""The store from ingest to prune, and the stream, on a small feed."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewake.operators.retention import prune
from tidewake.sources.reference import archive_summary, read_archive
from tidewake.sources.store import Store
from tidewake.streaming.feed_stream import dedup_stream, judge_stream, read_stream

from .test_text_and_documents import FEED_COLUMNS, line, lines_frame


def feed(spark):
    rows = []
    for day in (1, 2):
        for m in range(0, 240, 10):
            rows.append(line(Timestamp=f"{day:02d}/01/2025 {m // 60:02d}:{m % 60:02d}:00", SOG="0.1" if 60 <= m < 150 else "8.0", **{"Navigational status": "Moored"}))
    return lines_frame(spark, rows)


def test_store_round(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run, _ = store.run_ingest(feed(spark), "f.csv")
    again, result = store.run_ingest(feed(spark), "f.csv")
    assert (run, again) == (1, 2) and result.counters.first()["rows_inserted"] == 0
    assert store.positions().count() == 48 and store.runs().count() == 2
    store.run_detect()
    stops = store.table("stop_event").count()
    store.run_detect()
    assert stops == store.table("stop_event").count() == 2 and store.table("port_call").count() == 2
    gone = prune(store, datetime(2025, 1, 2), str(tmp_path / "archive"))
    assert (gone.fixes_removed, gone.calls_archived) == (24, 1) and store.positions().count() == 24
    calls, phases = read_archive(spark, gone.archive_path)
    assert calls.count() == phases.count() == 1 and archive_summary(calls).first()["open_calls"] == 0
    nothing = prune(store, datetime(2025, 1, 2), str(tmp_path / "archive"))
    assert (nothing.fixes_removed, nothing.archive_path) == (0, None) and store.retention_events().count() == 2


def test_archive_refuses(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"formatVersion": 7, "portCalls": []}')
    with pytest.raises(ValueError):
        read_archive(spark, str(tmp_path))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("# " + ",".join(FEED_COLUMNS) + "\n" + "\n".join([line(), line(), line(Latitude="91")]) + "\n")
    out = dedup_stream(judge_stream(read_stream(spark, str(tmp_path / "in")))).select("mmsi", "ts_utc")
    q = out.writeStream.format("memory").queryName("fixes_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("fixes_seen").agg(F.count("*")).first()[0] == 1
