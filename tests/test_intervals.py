"""Overlaps by length and start against plain comparisons."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewake.operators.intervals import LAYOUT, laid_out, meet, read_window, write_intervals

T0 = datetime(2023, 11, 5)


def intervals(spark, n=800):
    rng, rows = random.Random(6), []
    for i in range(n):
        start = T0 + timedelta(minutes=rng.randint(0, 200 * 1440))
        length = rng.choice([0, 1, 600, 1440, 3 * 1440, 20 * 1440, 400 * 1440])
        rows.append((i, rng.randint(1, 5), start, None if rng.random() < 0.03 else start + timedelta(minutes=rng.randint(0, length))))
    return spark.createDataFrame(rows, "id int, mmsi int, a timestamp, b timestamp")


def test_windows_read_few_folders_and_lose_nothing(spark, tmp_path):
    df = intervals(spark)
    write_intervals(df, str(tmp_path / "i"), "a", "b")
    for lo, hi in (("2023-11-01 00:00:00", "2023-11-05 00:10:00"), ("2023-12-24 11:59:00", "2023-12-24 12:00:00"), ("2024-01-31 00:00:00", "2024-03-01 00:00:00"), ("2030-01-01 00:00:00", "2030-01-02 00:00:00")):
        for far in (True, False):
            got = read_window(spark, str(tmp_path / "i"), "a", "b", lo, hi, far_edge=far)
            want = df.where(f"a < timestamp'{hi}' AND (b IS NULL OR b {'>=' if far else '>'} timestamp'{lo}')")
            assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
            assert not set(LAYOUT) & set(got.columns)
    day = read_window(spark, str(tmp_path / "i"), "a", "b", "2023-12-24 00:00:00", "2023-12-25 00:00:00")
    assert re.search(r"PartitionFilters: \[.*length_class", day._jdf.queryExecution().executedPlan().toString())
    assert len(day.inputFiles()) > 0 and day.select(F.input_file_name()).distinct().count() < 0.5 * len(day.inputFiles())


def test_pairs_meet_once(spark):
    df = intervals(spark)
    rng = random.Random(7)
    asked = []
    for i in range(150):
        f = T0 + timedelta(minutes=rng.randint(-10 * 1440, 210 * 1440))
        asked.append((i, rng.randint(1, 6), f, f + timedelta(minutes=rng.choice([0, 30, 2000, 60 * 1440]))))
    windows = spark.createDataFrame(asked, "w int, mmsi int, f timestamp, t timestamp")
    overlap = "a < t AND (b IS NULL OR b > f)"
    got = meet(windows, df, ["mmsi"], ("f", "t"), ("a", "b"))
    pairs = sorted((r["w"], r["id"]) for r in got.where(overlap).collect())
    assert pairs == sorted((r["w"], r["id"]) for r in windows.join(df, "mmsi").where(overlap).collect()) and len(pairs) > 500
    # and few meet that do not overlap
    assert got.count() < 0.7 * windows.join(df, "mmsi").count()
    assert meet(windows, df.limit(0), ["mmsi"], ("f", "t"), ("a", "b")).count() == 0
    assert laid_out(df, "a", "b").groupBy("id").count().where("count > 1").isEmpty()
