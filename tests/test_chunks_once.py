"""Steps over chunks are computed once, not once for every read."""

from __future__ import annotations

from tidewake.operators.chunks import annotate_and_detect
from tidewake.plans.feed import Feed


def test_chunk_steps_are_written_once(spark):
    f = Feed(spark, "/root/testdata/sf0.001")
    log = f.log()
    staged = annotate_and_detect(log, chunk_rows=12, staging=f.staging)[2]
    lazy = annotate_and_detect(log, chunk_rows=12)[2]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (staged, lazy)]
    # what is left reads the marked fixes; no cut of a track is made anew
    assert "_bucket" not in plans[0] and "_bucket" in plans[1]
    columns = [c for c in lazy.columns if c not in ("centroid_lat", "centroid_lon", "max_drift_nm")]
    assert sorted(map(str, staged.select(columns).collect())) == sorted(map(str, lazy.select(columns).collect()))
