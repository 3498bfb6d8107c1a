"""What of the log a run reads, and changes that break off at any step."""

from __future__ import annotations

import re
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewake.operators.ingest import parse, settle
from tidewake.operators.retention import prune
from tidewake.operators.rules import judge
from tidewake.sources.store import Store

from .test_store import feed
from .test_text_and_documents import line, lines_frame

CUTOFF = datetime(2025, 1, 1, 1, 40)


class Broken(Exception):
    pass


class Breaking(Store):
    """A store whose writer dies before step number `at`."""

    def __init__(self, *args, at: int = -1, **options):
        self.at, self.steps = at, []
        super().__init__(*args, **options)

    def step(self, name):
        if len(self.steps) == self.at:
            raise Broken(name)
        self.steps.append(name.rsplit("/", 1)[-1])


def seen(store):
    """All that a reader can ask of a store."""
    p = store.positions()
    tables = {n: store.table(n).count() for n in ("vessel", "stop_event", "port_call", "port_call_phase") if store.table(n) is not None}
    ledger = sorted((r["id"], r["source_file"], r["rows_inserted"]) for r in store.runs().collect())
    bounds = p.agg(F.count("*"), F.min("ts_utc"), F.max("ts_utc"), F.sum(F.xxhash64("mmsi", "ts_utc", "source_line", "ingest_run_id").bitwiseAND(0xFFFF))).first()
    q = store.quarantine()
    return tuple(bounds), tables, ledger, 0 if q is None else q.count(), [tuple(r)[1:4] for r in store.retention_events().collect()]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A store with one run and its projections."""
    root = tmp_path_factory.mktemp("stores") / "base"
    store = Store(spark, str(root), buckets=4)
    store.run_ingest(feed(spark).where("source_line <= 40"), "f.csv")
    store.run_detect()
    return root


def more(spark):
    return lines_frame(spark, [line(Timestamp=f"0{d}/01/2025 00:10:00", Latitude=lat) for d in (2, 3) for lat in ("55.6", "91")])


def attempts(spark, base, tmp_path, change):
    """Breaks the change off before every step; yields the state before and after, each broken store, and how the whole change went."""
    shutil.copytree(base, tmp_path / "whole")
    whole = Breaking(spark, str(tmp_path / "whole"))
    before = seen(whole)
    change(whole)
    after = seen(whole)
    assert before != after and "publish" in whole.steps
    for at, name in enumerate(whole.steps):
        root = tmp_path / f"at-{at}"
        shutil.copytree(base, root)
        with pytest.raises(Broken):
            change(Breaking(spark, str(root), at=at))
        yield whole.steps, at, before, after, Store(spark, str(root))


def test_prune_breaks_off_at_every_step(spark, base, tmp_path):
    for steps, at, before, after, store in attempts(spark, base, tmp_path, lambda s: prune(s, CUTOFF, str(tmp_path / f"archive-{s.root[-2:]}"))):
        done = at > steps.index("publish")
        assert seen(store) == (after if done else before), steps[at]
        if at in (0, steps.index("publish")):  # run again, it ends as if it had not broken off
            prune(store, CUTOFF, str(tmp_path / "archive-again"))
            assert seen(store) == after


def test_ingest_breaks_off_at_every_step(spark, base, tmp_path):
    for steps, at, before, after, store in attempts(spark, base, tmp_path, lambda s: s.run_ingest(more(spark), "g.csv")):
        assert seen(store) == before, steps[at]
        if steps[at] in ("write quarantine", "publish"):
            store.run_ingest(more(spark), "g.csv")
            assert seen(store) == after


def test_clean_deletes_what_is_not_seen(spark, base, tmp_path):
    shutil.copytree(base, tmp_path / "s")
    with pytest.raises(Broken):
        steps = Breaking(spark, str(tmp_path / "s"), at=99)
        steps.at = 4
        steps.run_ingest(more(spark), "g.csv")
    assert list((tmp_path / "s").rglob("ingest_run_id=2"))
    store = Store(spark, str(tmp_path / "s"))
    store.clean()
    assert not list((tmp_path / "s").rglob("ingest_run_id=2")) and not (tmp_path / "s" / "_staging").exists()
    before = seen(store)
    store.clean()
    assert seen(store) == before


def test_a_later_run_of_pruned_days_is_seen(spark, base, tmp_path):
    shutil.copytree(base, tmp_path / "s")
    store = Store(spark, str(tmp_path / "s"))
    left = prune(store, datetime(2025, 1, 2), str(tmp_path / "archive"))
    count = store.positions().count()
    assert left.fixes_removed == 24 and not list((tmp_path / "s" / "position_report").glob("date=2025-01-01/*"))
    _, result = store.run_ingest(feed(spark).where("source_line <= 40"), "f.csv")
    assert result.counters.first()["rows_inserted"] == 24 and store.positions().count() == count + 24
    again = prune(store, datetime(2025, 1, 1, 1), str(tmp_path / "archive2"))
    assert again.fixes_removed == 6 and store.positions().count() == count + 18 and store.retention_events().count() == 2


def test_a_run_reads_its_days_and_shuffles_no_log(spark, base):
    store = Store(spark, str(base))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = judge(parse(more(spark)))
        days = [datetime(2025, 1, 2).date(), datetime(2025, 1, 3).date()]
        log = store.positions(days)
        result = settle(judged, log, store.table("vessel"), run_id=2, log_buckets=store.buckets)
        assert result.counters.first()["rows_inserted"] == 2
        plan = result.positions._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = re.search(r"FileScan parquet [^\n]*position_report[^\n]*", plan).group()
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ IN", scan) and "Bucketed: true" in scan
    # from the join down to the log there is a sort, and no exchange
    log_side = plan[plan.rindex("Sort", 0, plan.index("FileScan parquet " + scan.split("FileScan parquet ")[1][:20])) : plan.index(scan)]
    assert "Exchange" not in log_side
