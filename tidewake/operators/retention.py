"""Pruning with a verified archive."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PruneResult:
    fixes_removed: int
    calls_archived: int
    archive_path: str | None


def losing_calls(calls: DataFrame, cutoff) -> DataFrame:
    return calls.where(F.col("arrived_utc") < F.lit(cutoff).cast("timestamp"))


def kept_fixes(fixes: DataFrame, cutoff) -> DataFrame:
    return fixes.where(F.col("ts_utc") >= F.lit(cutoff).cast("timestamp"))


def prune(store, cutoff: datetime, archive_dir: str) -> PruneResult:
    """Archives the calls that lose their fixes, reads the archive back, and only if every call is in it drops old fixes and all projections.

    Every call before the cutoff is archived, however many there are. Nothing lost means no archive. One step of the
    store makes the cut, the emptied projections and the event visible together; whole days before the cutoff are deleted
    after it, and what is left of the cutoff's own day stays hidden. A prune that broke off has changed nothing but the archive, or
    is done and leaves files for the next change to delete.
    """
    from ..sources.reference import archive_documents, read_archive

    spark = store.spark
    applied = datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
    calls, phases = store.table("port_call"), store.table("port_call_phase")
    count, path = 0, None
    if calls is not None:
        losing = losing_calls(calls, cutoff)
        count = losing.count()
        if count:
            files = [r["source_file"] for r in store.runs().groupBy("source_file").agg(F.min("id").alias("i")).orderBy("i").collect()]
            path = f"{archive_dir.rstrip('/')}/port-calls-before-{cutoff:%Y%m%dT%H%M%S}Z.json"
            archive_documents(losing, phases.join(losing.select("mmsi", "arrived_utc"), ["mmsi", "arrived_utc"], "left_semi"), cutoff, applied, files).write.mode("overwrite").json(path)
            back, back_phases = read_archive(spark, path)
            expected = phases.join(losing.select("mmsi", "arrived_utc"), ["mmsi", "arrived_utc"], "left_semi").count()
            if back.count() != count or back_phases.count() != expected:
                raise RuntimeError(f"the archive at {path} does not hold the {count} calls and {expected} phases it should; nothing was removed")
    removed = store.positions().where(F.col("ts_utc") < F.lit(cutoff).cast("timestamp")).count()
    store.cut(cutoff, applied, removed, count, path)
    return PruneResult(removed, count, path)
