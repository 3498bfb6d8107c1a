from __future__ import annotations

import random

from tidewake.operators import reports as R
from tidewake.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_call_counts_of_all_vessels_and_by_keys(spark):
    calls = spark.createDataFrame([(m,) for m in (1, 1, 2, 3, 3, 3)], "mmsi bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.call_counts(calls)) == [(1, 2), (2, 1), (3, 3)]
    assert rows(R.call_counts(calls, spark.createDataFrame([(3,), (3,), (9,)], "mmsi bigint"))) == [(3, 3)]
    counted = {r["mmsi"]: r["calls"] for r in Q.QUERIES["call_counts_all"](spark, SF).collect()}
    assert any(m % 3 for m in counted) and sum(counted.values()) == Q.Feed(spark, SF).calls()[0].count()


def test_eta_empty_bands_are_those_of_all_bins(spark):
    assert "eta_empty_bands_all" in Q.QUERIES and "%" not in Q.ORACLE_SQL["eta_empty_bands_all"].rpartition("FROM bins")[2]
    bins = spark.createDataFrame([(d, 1) for d in [-3, 8, 13, 14, 22, 29, 37]], "days_ahead bigint, fixes bigint")
    # the longest runs without a fix only, and days 13, 14 and 37 count like any
    assert sorted(map(tuple, R.eta_empty_bands(bins).collect())) == [(0, 7), (15, 21), (30, 36)]


def test_port_benchmarks_and_ranks_are_those_of_sorted_lists(spark):
    rng = random.Random(1)
    rows = []
    for port in [1] * 120 + [2] * 9 + [3] * 4 + [None] * 5 + [4] * 3:
        rows.append((port, "P" if port else None, "C", rng.random() < 0.8, rng.choice([0.5, 4.9, 5.0, 5.1, 20.0]), rng.choice([0.0, 0.5, 0.5, 1.25, 7.0, rng.random()]), rng.choice([0.0, 3.0, rng.random()])))
    calls = spark.createDataFrame(rows, "port_wpi_number int, port_name string, port_country string, is_complete boolean, port_distance_nm double, waiting_hours double, working_hours double")
    used = {p: [r for r in rows if r[0] == p and r[3] and r[4] <= 5.0] for p in (1, 2, 3, 4)}
    nearest = lambda values, percent: sorted(values)[-(-len(values) * percent // 100) - 1]
    for r in R.port_benchmarks(calls).collect():
        own = used[r["port_wpi_number"]]
        waits, works = [x[5] for x in own], [x[6] for x in own]
        assert r["usable_calls"] == len(own) and r["attributed_calls"] == sum(x[0] == r["port_wpi_number"] for x in rows)
        assert r["median_waiting_hours"] == (nearest(waits, 50) if len(own) >= 5 else None) and r["median_working_hours"] == (nearest(works, 50) if len(own) >= 5 else None)
        assert r["p90_waiting_hours"] == (nearest(waits, 90) if len(own) >= 10 else None) and abs(r["waiting_hours"] - sum(waits)) < 1e-9
    probes = spark.createDataFrame([(p, h) for p in (1, 2, 3, 4, 9) for h in (-1.0, 0.0, 0.5, 0.7, 99.0, 0.5)], "port_wpi_number int, hours double")
    ranks = R.rank_waits(probes, calls)
    for r in ranks.collect():
        own = [x[5] for x in used.get(r["port_wpi_number"], [])]
        below = sum(w <= r["hours"] for w in own)
        assert (r["at_or_below"], r["usable_calls"]) == (below, len(own)) and r["rank_percent"] == (100.0 * below / len(own) if len(own) >= 5 else None)
    assert ranks.count() == 25
    seen = R.port_observations(calls).where("port_wpi_number = 1 AND kind = 'waiting'").orderBy("hours").collect()
    assert [h for r in seen for h in [r["hours"]] * r["calls"]] == sorted(x[5] for x in used[1]) and seen[-1]["at_or_below"] == len(used[1])
    plan = R.port_benchmarks(calls)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan
