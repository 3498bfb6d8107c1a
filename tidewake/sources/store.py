"""The store: Parquet tables under one root and one manifest that says what of them is visible."""

from __future__ import annotations

import json
import uuid
from calendar import timegm
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from hashlib import md5

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.calls import chain_port_calls
from ..operators.chunks import CHUNK_ROWS, annotate_and_detect
from ..operators.ingest import POSITION_COLUMNS, IngestResult, parse, settle
from ..operators.rules import RowRule, judge
from ..operators.thresholds import Thresholds
from .staging import Staging

RUN_COLUMNS = "id bigint, source_file string, started_utc timestamp, finished_utc timestamp, rows_read bigint, rows_filtered bigint, rows_inserted bigint, rows_dup_in_file bigint, rows_dup_prior_run bigint, rows_quarantined bigint"
EVENT_COLUMNS = "applied_utc timestamp, cutoff_utc timestamp, fixes_removed bigint, port_calls_archived bigint, archive_path string"
QUARANTINE_COLUMNS = "rule_id string, source_line bigint, raw_text string, detail string, source_file string, ingest_run_id bigint"
_POSITION_TYPES = {"mmsi": "bigint", "ts_utc": "timestamp", "nav_status": "string", "destination": "string", "eta_utc": "timestamp", "quality_flags": "array<string>", "source_line": "bigint"}
#: Days that a read of the log names one by one; of more, it reads from the first to the last.
NAMED_DAYS = 366


def utc_day(ts: Column) -> Column:
    """The day in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def _epoch(t: datetime) -> int:
    return timegm(t.timetuple())


@dataclass(frozen=True)
class Manifest:
    """All that a reader may see.

    Runs up to last_run; of every replaced table one version; fixes of runs up to a cut's run only from its time on; and
    the events of retention.
    """

    version: int = 0
    last_run: int = 0
    tables: dict[str, int] = field(default_factory=dict)
    cuts: list[dict] = field(default_factory=list)  # run, cutoff in seconds
    events: list[dict] = field(default_factory=list)

    def with_cut(self, cutoff: int) -> Manifest:
        """Cuts that this one covers are left out, so the later a run, the earlier its cut."""
        rest = [c for c in self.cuts if c["cutoff"] > cutoff]
        return replace(self, cuts=[*rest, {"run": self.last_run, "cutoff": cutoff}])


class Store:
    """Tables: position_report, quarantine, vessel, ingest_run, stop_event, port_call, port_call_phase, retention_event.

    A change writes its files first, under names that no manifest names yet, and then renames the next manifest into
    place: one step, after which readers see all of the change. What a change that broke off has left is never seen; the
    next one overwrites it, and clean() deletes it, as often as it is called. There is one writer.

    The log lies by day and run, in buckets by vessel and time. A run looks for duplicates only in the days that its
    lines are of, and joins them bucket by bucket, so the log is not shuffled however long it is.
    """

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        self._name = f"tidewake_{md5(self.root.encode()).hexdigest()[:16]}_position_report"
        self._synced: str | None = None
        layout = self._read_text("_layout.json")
        if layout is None:  # the number of buckets is the store's, not the session's
            self._publish_text("_layout.json", json.dumps({"buckets": buckets}))
        self.buckets = json.loads(layout)["buckets"] if layout else buckets

    def step(self, name: str) -> None:
        """Called before everything that a change writes or deletes; tests break off here."""

    # ---- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._fs(f"{self.root}/{name}")
        return fs.exists(path)

    def _delete(self, name: str) -> None:
        path, fs = self._fs(name if ":/" in name or name.startswith("/") else f"{self.root}/{name}")
        if fs.exists(path):
            self.step(f"delete {name}")
            fs.delete(path, True)
            self._synced = None

    def _list(self, pattern: str) -> list[str]:
        path, fs = self._fs(f"{self.root}/{pattern}")
        return sorted(s.getPath().toString() for s in fs.globStatus(path) or [])

    def _read_text(self, name: str) -> str | None:
        path, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish_text(self, name: str, text: str) -> None:
        """Written beside, then renamed: there or not, never in part."""
        beside, fs = self._fs(f"{self.root}/_new-{uuid.uuid4().hex}")
        stream = fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        target, _ = self._fs(f"{self.root}/{name}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(beside, target):
            fs.delete(beside, False)
            raise RuntimeError(f"{name} was written by another writer")

    # ---- manifest

    def manifest(self) -> Manifest:
        names = self._list("_manifest/*.json")
        return Manifest(**json.loads(self._read_text(f"_manifest/{names[-1].rsplit('/', 1)[1]}"))) if names else Manifest()

    def publish(self, change: Manifest) -> None:
        """The one step that makes a change visible."""
        self.step("publish")
        change = replace(change, version=change.version + 1)
        self._publish_text(f"_manifest/{change.version:010d}.json", json.dumps(asdict(change)))

    def clean(self) -> None:
        """Deletes what the manifest doesn't show: files of runs that broke off, old versions of tables (the last one stays for its readers), days before a cut, manifests."""
        now = self.manifest()
        for path in self._list("position_report/date=*/ingest_run_id=*") + self._list("quarantine/source_file=*/ingest_run_id=*") + self._list("ingest_run/id=*"):
            run = int(path.rsplit("=", 1)[1])
            day = path.split("date=")[1][:10] if "/date=" in path else None
            gone = day and any(run <= c["run"] and day < f"{datetime.fromtimestamp(c['cutoff'], timezone.utc):%Y-%m-%d}" for c in now.cuts)
            if run > now.last_run or gone:
                self._delete(path)
        for path in self._list("*/v[0-9]*"):
            name, version = path.rsplit("/", 2)[1:]
            current = now.tables.get(name, 0)
            if not current - 1 <= int(version[1:]) <= current:
                self._delete(path)
        for path in self._list("_manifest/*.json")[:-2] + self._list("_new-*") + self._list("_staging"):
            self._delete(path)

    # ---- readers

    def runs(self) -> DataFrame:
        """The ledger. Raises nothing on an empty store."""
        return self._runs(self.manifest())

    def _runs(self, now: Manifest) -> DataFrame:
        if not now.last_run:
            return self.spark.createDataFrame([], RUN_COLUMNS)
        return self.spark.read.schema(RUN_COLUMNS).parquet(f"{self.root}/ingest_run").where(F.col("id") <= now.last_run)

    def _log(self) -> DataFrame:
        """All files of the log as a bucketed table, seen or not."""
        path, fs = self._fs(f"{self.root}/position_report")
        fs.mkdirs(path)
        columns = ", ".join(f"{c} {_POSITION_TYPES.get(c, 'double')}" for c in POSITION_COLUMNS if c != "ingest_run_id")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name} ({columns}, date DATE, ingest_run_id BIGINT) USING parquet PARTITIONED BY (date, ingest_run_id) CLUSTERED BY (mmsi, ts_utc) SORTED BY (mmsi, ts_utc) INTO {self.buckets} BUCKETS LOCATION '{self.root}/position_report'")
        if self._synced != (version := self._version()):  # the session's list of folders is behind the store's
            self.spark.sql(f"MSCK REPAIR TABLE {self._name} SYNC PARTITIONS")
            self._synced = version
        self.spark.catalog.refreshTable(self._name)
        return self.spark.table(self._name)

    def _version(self) -> str:
        names = self._list("_manifest/*.json")
        return names[-1] if names else ""

    def positions(self, days: list | None = None) -> DataFrame | None:
        """The log, or its given days alone; None before the first run."""
        return self._positions(self.manifest(), days)

    def _positions(self, now: Manifest, days: list | None = None) -> DataFrame | None:
        if not now.last_run:
            return None
        df = self._log().where(F.col("ingest_run_id") <= now.last_run)
        if days is not None and len(days) > NAMED_DAYS:
            df = df.where(F.col("date").between(min(days), max(days)))
        elif days is not None:
            df = df.where(F.col("date").isin(days))
        for c in now.cuts:
            after, cutoff = F.col("ingest_run_id") > c["run"], F.timestamp_seconds(F.lit(c["cutoff"]))
            # the first prunes folders, the second rows
            df = df.where(after | (F.col("date") >= utc_day(cutoff))).where(after | (F.col("ts_utc") >= cutoff))
        return df

    def quarantine(self, files: list[str] | None = None) -> DataFrame | None:
        """Rejects, or those of the given source files alone; None before the first reject."""
        now = self.manifest()
        if not now.last_run or not self.exists("quarantine"):
            return None
        df = self.spark.read.schema(QUARANTINE_COLUMNS).parquet(f"{self.root}/quarantine").where(F.col("ingest_run_id") <= now.last_run)
        return df if files is None else df.where(F.col("source_file").isin(files))

    def table(self, name: str) -> DataFrame | None:
        return self._table(self.manifest(), name)

    def _table(self, now: Manifest, name: str) -> DataFrame | None:
        v = now.tables.get(name, 0)
        return self.spark.read.parquet(f"{self.root}/{name}/v{v}") if v else None

    def retention_events(self) -> DataFrame:
        at = lambda s: datetime.fromtimestamp(s, timezone.utc)
        return self.spark.createDataFrame([(at(e["applied"]), at(e["cutoff"]), e["removed"], e["archived"], e["path"]) for e in self.manifest().events], EVENT_COLUMNS)

    # ---- changes

    def with_table(self, change: Manifest, name: str, df: DataFrame) -> Manifest:
        """Writes the next version of a table; it is seen when the change is published."""
        v = change.tables.get(name, 0) + 1
        self.step(f"write {name}")
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        return replace(change, tables=change.tables | {name: v})

    def run_ingest(self, lines: DataFrame, source_file: str, *, ship_type: str | None = None, limit: int | None = None, rules: list[RowRule] | None = None) -> tuple[int, IngestResult]:
        """One ingest run: positions and rejects that no earlier run stored, vessels and the ledger row. A second run of the same lines stores nothing."""
        started = datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
        self.clean()
        now = self.manifest()
        run_id = now.last_run + 1
        if limit is not None:
            lines = lines.where(F.col("source_line") <= limit + 1)
        self.step("stage")
        # judged rows are written once; positions, rejects, vessels and counters read them
        judged = Staging(self.spark, "judged", f"{self.root}/_staging/run-{run_id}").save(judge(parse(lines), rules), "judged")
        days = [r[0] for r in judged.where("reject IS NULL").select(utc_day(F.col("ts_utc"))).distinct().collect()]
        observed = Observation(), Observation()
        old_log, vessels = self._positions(now, days), self._table(now, "vessel")
        result = settle(judged, old_log, vessels, run_id=run_id, ship_type=ship_type, log_buckets=self.buckets)
        told = settle(judged, old_log, vessels, run_id=run_id, ship_type=ship_type, log_buckets=self.buckets, observed=observed)
        self._log()
        rows = told.positions.withColumn("date", utc_day(F.col("ts_utc"))).repartition(self.buckets, "mmsi", "ts_utc")
        self.step("write position_report")
        rows.select(*[c for c in POSITION_COLUMNS if c != "ingest_run_id"], "date", "ingest_run_id").write.mode("append").insertInto(self._name)
        rejects = told.quarantine
        old = self.quarantine([r[0] for r in result.quarantine.select("source_file").distinct().collect()])  # one name for each file of the run
        if old is not None:
            rejects = rejects.join(old.select("source_file", "source_line", "rule_id"), ["source_file", "source_line", "rule_id"], "left_anti")
        self.step("write quarantine")
        rejects.select("rule_id", "source_line", "raw_text", "detail", "source_file", "ingest_run_id").write.mode("append").partitionBy("source_file", "ingest_run_id").parquet(f"{self.root}/quarantine")
        # both writes have counted what passed them; every line is in one bucket
        counters = {"rows_read": 0} | observed[0].get | observed[1].get
        if counters["rows_read"] != sum(v for k, v in counters.items() if k != "rows_read"):
            raise RuntimeError(f"run {run_id} does not balance: {counters}")
        change = self.with_table(now, "vessel", result.vessels)
        finished = datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
        row = (run_id, source_file, started, finished, counters["rows_read"], counters["rows_filtered"], counters["rows_inserted"], counters["rows_dup_in_file"], counters["rows_dup_prior_run"], counters["rows_quarantined"])
        self.step("write ingest_run")
        self.spark.createDataFrame([row], RUN_COLUMNS).coalesce(1).write.mode("append").partitionBy("id").parquet(f"{self.root}/ingest_run")
        self.publish(replace(change, last_run=run_id))
        return run_id, result

    def run_detect(self, ports: DataFrame | None = None, th: Thresholds = Thresholds(), *, chunk_rows: int = CHUNK_ROWS) -> None:
        """Flags, stops, calls and phases anew from the log; running it twice changes nothing. Tracks of more than chunk_rows fixes are scanned in chunks."""
        self.clean()
        change = self.manifest()
        change = self.with_table(change, "stop_event", annotate_and_detect(self._positions(change), th, chunk_rows=chunk_rows, staging=Staging(self.spark, "detect", f"{self.root}/_staging/detect"))[2])
        calls, phases = chain_port_calls(self._table(change, "stop_event"), ports, th)
        change = self.with_table(change, "port_call", calls)
        change = self.with_table(change, "port_call_phase", phases)
        self.publish(change)

    def cut(self, cutoff: datetime, applied: datetime, fixes_removed: int, calls_archived: int, path: str | None) -> None:
        """Hides fixes before the cutoff, empties the projections and records the event, all at once; then deletes the files of hidden days."""
        change = now = self.manifest()
        if fixes_removed:
            change = now.with_cut(_epoch(cutoff))
            for name in ("stop_event", "port_call", "port_call_phase"):
                if (df := self._table(now, name)) is not None:
                    change = self.with_table(change, name, df.limit(0))
        event = {"applied": _epoch(applied), "cutoff": _epoch(cutoff), "removed": fixes_removed, "archived": calls_archived, "path": path}
        self.publish(replace(change, events=[*now.events, event]))
        self.clean()
