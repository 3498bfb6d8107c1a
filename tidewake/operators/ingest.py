"""Parsing, judging, scoping, deduplication and the ledger of one ingest run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import known_text
from ..sources.staging import Staging
from .rules import RowRule, judge

#: The feed's columns by position.
FEED_COLUMNS = [
    "Timestamp", "Type of mobile", "MMSI", "Latitude", "Longitude", "Navigational status", "ROT", "SOG", "COG", "Heading", "IMO", "Callsign", "Name",
    "Ship type", "Cargo type", "Width", "Length", "Type of position fixing device", "Draught", "Destination", "ETA", "Data source type", "A", "B", "C", "D",
]
FEED_TIME = "dd/MM/yyyy HH:mm:ss"
NATURAL_KEY = ["mmsi", "ts_utc", "lat", "lon"]
VESSEL_TEXTS = ["imo", "name", "callsign", "ship_type", "cargo_type", "position_fixing_device"]
VESSEL_ATTRIBUTES = [*VESSEL_TEXTS, "length_m", "width_m"]
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: A parsed record, after where it stands and why it could not be parsed.
RECORD_COLUMNS = [
    "mmsi", "ts_utc", "lat", "lon", "sog_kn", "cog", "heading", "type_of_mobile", "nav_status", "rot", "draught_m", "destination", "eta_utc",
    "imo", "name", "callsign", "ship_type", "cargo_type", "position_fixing_device", "length_m", "width_m",
]
POSITION_COLUMNS = ["mmsi", "ts_utc", "lat", "lon", "sog_kn", "cog", "heading", "nav_status", "rot", "draught_m", "destination", "eta_utc", "quality_flags", "ingest_run_id", "source_line"]


def number(text: Column) -> Column:
    """A plain decimal number, or null; what only one engine's parser takes (NaN, Infinity, 1d) is refused. What is too large for a double comes out infinite."""
    # most fields of a line are empty; those need no matcher
    return F.when((text != "") & text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def feed_time(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(text, F.lit(FEED_TIME)))


def parse(lines: DataFrame) -> DataFrame:
    """Typed records from (source_file, source_line, raw_text, fields array<string>); parse_failure has the first reason why not.

    A line's fields are read once, as compiled columns in two parts: all of them in one projection make a method of
    generated code too long to be compiled. inline keeps later filters behind it, which would else repeat the record's
    expressions; it is the outer one, as for the plain one Spark adds a filter that makes the record once more.
    """

    def f(name: str) -> Column:
        return F.get("fields", F.lit(FEED_COLUMNS.index(name)))

    numbers = {
        "lat": number(f("Latitude")), "lon": number(f("Longitude")), "sog_kn": number(f("SOG")), "cog": number(f("COG")), "heading": number(f("Heading")), "rot": number(f("ROT")), "draught_m": number(f("Draught")), "length_m": number(f("Length")), "width_m": number(f("Width")),
    }
    others = {
        "n": F.size("fields"), "mmsi": F.when(f("MMSI").rlike(r"^\d+$"), f("MMSI").try_cast("bigint")), "ts_utc": feed_time(f("Timestamp")), "type_of_mobile": f("Type of mobile"), "nav_status": f("Navigational status"),
        "destination": known_text(f("Destination")), "eta_utc": feed_time(f("ETA")), "imo": known_text(f("IMO")), "name": known_text(f("Name")), "callsign": known_text(f("Callsign")),
        "ship_type": known_text(f("Ship type")), "cargo_type": known_text(f("Cargo type")), "position_fixing_device": known_text(f("Type of position fixing device")),
    }
    line = ["source_file", "source_line", "raw_text"]
    df = lines.select(*line, "fields")
    for part, left in ((numbers, ["fields"]), (others, list(numbers))):
        df = df.withColumn("_part", F.array(F.struct(*[c.alias(name) for name, c in part.items()])))
        df = df.select(*line, *left, F.inline_outer("_part"))
    df = df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in numbers})
    failure = (
        F.when(F.col("n") != len(FEED_COLUMNS), F.format_string("expected %d fields, found %d", F.lit(len(FEED_COLUMNS)), F.col("n")))
        .when(F.col("ts_utc").isNull(), "unreadable timestamp")
        .when(F.col("mmsi").isNull(), "unreadable MMSI")
        .when(F.col("lat").isNull(), "unreadable latitude")
        .when(F.col("lon").isNull(), "unreadable longitude")
    )
    return df.select(*line, failure.alias("parse_failure"), *RECORD_COLUMNS)


def merge_identity(records: DataFrame) -> DataFrame:
    """One row per vessel: the latest known value of each attribute in file order, first and last time seen. Over every parsed row."""
    return (
        records.where("parse_failure IS NULL")
        .groupBy("mmsi")
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("source_file", "source_line"))).alias(c) for c in VESSEL_ATTRIBUTES], F.min("ts_utc").alias("first_seen_utc"), F.max("ts_utc").alias("last_seen_utc"))
    )


def upsert_vessels(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """New known values win, the window seen widens."""
    if old is None:
        return new
    joined = old.alias("o").join(new.alias("n"), "mmsi", "full_outer")
    return joined.select("mmsi", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in VESSEL_ATTRIBUTES], F.least("o.first_seen_utc", "n.first_seen_utc").alias("first_seen_utc"), F.greatest("o.last_seen_utc", "n.last_seen_utc").alias("last_seen_utc"))


@dataclass(frozen=True)
class IngestResult:
    positions: DataFrame  # new rows only
    quarantine: DataFrame
    vessels: DataFrame
    counters: DataFrame  # one row
    rule_hits: DataFrame  # over every line read
    buckets: DataFrame  # every line with the bucket that it fell in


def ingest(lines: DataFrame, log: DataFrame | None = None, vessels: DataFrame | None = None, *, run_id: int = 1, ship_type: str | None = None, limit: int | None = None, rules: list[RowRule] | None = None, staging: Staging | None = None) -> IngestResult:
    """One run over raw lines. With a staging, judged rows are written once, and all results read them there instead of parsing anew."""
    if limit is not None:
        lines = lines.where(F.col("source_line") <= limit + 1)
    judged = judge(parse(lines), rules)
    if staging is not None:
        judged = staging.save(judged, f"judged-{run_id}")
    return settle(judged, log, vessels, run_id=run_id, ship_type=ship_type)


def _known(accepted: DataFrame, log: DataFrame) -> DataFrame:
    """Adds old: the log has the natural key. Only vessel and time are join keys, as the log's buckets go by them; places are compared in what meets there."""
    old = log.select(F.col("mmsi").alias("_mmsi"), F.col("ts_utc").alias("_ts"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("old"))
    same_place = (F.col("lat") - F.col("_lat") == 0) & (F.col("lon") - F.col("_lon") == 0)
    return accepted.join(old, (F.col("mmsi") == F.col("_mmsi")) & (F.col("ts_utc") == F.col("_ts")) & same_place, "left").drop("_mmsi", "_ts", "_lat", "_lon")


def settle_runs(judged: DataFrame, run: Column) -> DataFrame:
    """Positions of several runs into an empty log, equal to settle() run after run: of each natural key the first by run, file and line stays.

    The log is dealt once, where every run after the first deals what the runs before have stored anew.
    """
    accepted = judged.where("reject IS NULL").withColumn("ingest_run_id", run.cast("bigint"))
    w = Window.partitionBy(*NATURAL_KEY).orderBy("ingest_run_id", "source_file", "source_line")
    # not by a rank, for whose first place Spark would sort before the shuffle too, and few lines are copies
    return accepted.withColumn("_again", F.lag(F.lit(True)).over(w)).where("_again IS NULL").select(*POSITION_COLUMNS)


def settle(judged: DataFrame, log: DataFrame | None = None, vessels: DataFrame | None = None, *, run_id: int = 1, ship_type: str | None = None, log_buckets: int | None = None, observed: tuple[Observation, Observation] | None = None) -> IngestResult:
    """One run over judged rows. Every line falls in exactly one of filtered, quarantined, dup_in_file, dup_prior_run and inserted.

    Identities are merged over all parsed lines first. Then scope comes before refusal (an unparseable line has no
    vessel and is always refused), and duplicates are looked for among accepted lines in scope alone: the first in file
    order stays, unless the log has its natural key. One shuffle on the vessel, one on the natural key. A log that lies in
    log_buckets buckets by vessel and time is joined where it lies: the lines are dealt to as many parts, and that serves
    the duplicates in the file too.

    observed: the first is told the accepted lines by bucket when positions are written, the second all lines and those
    of the other buckets when rejects are, so that the counters need no job of their own.
    """
    found = merge_identity(judged)
    if ship_type is None:
        judged = judged.withColumn("in_scope", F.lit(True))
    else:
        scope = found.where(F.lower("ship_type") == ship_type.lower()).select("mmsi", F.lit(True).alias("in_scope"))
        judged = judged.join(scope, "mmsi", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    bucket = F.when(F.col("parse_failure").isNull() & ~F.col("in_scope"), "filtered").when(F.col("reject").isNotNull(), "quarantined")
    judged = judged.withColumn("bucket", bucket)
    accepted = judged.where("bucket IS NULL")
    if log_buckets is not None:
        accepted = accepted.repartition(log_buckets, "mmsi", "ts_utc")
    first = F.row_number().over(Window.partitionBy(*NATURAL_KEY).orderBy("source_file", "source_line"))
    accepted = accepted.withColumn("nth", first)
    if log is None:
        accepted = accepted.withColumn("old", F.lit(False))
    else:
        met = accepted.join(log.select(*NATURAL_KEY, F.lit(True).alias("old")), NATURAL_KEY, "left") if log_buckets is None else _known(accepted, log)
        accepted = met.withColumn("old", F.coalesce("old", F.lit(False)))
    accepted = accepted.withColumn("bucket", F.when(F.col("nth") > 1, "dup_in_file").when(F.col("old"), "dup_prior_run").otherwise("inserted"))
    buckets = judged.where("bucket IS NOT NULL").select("source_file", "source_line", "bucket").unionByName(accepted.select("source_file", "source_line", "bucket"))
    names = ["filtered", "inserted", "dup_in_file", "dup_prior_run", "quarantined"]
    many = lambda b: F.count_if(F.coalesce(F.col("bucket") == b, F.lit(False))).alias(f"rows_{b}")
    if observed is not None:
        accepted = accepted.observe(observed[0], many("inserted"), many("dup_in_file"), many("dup_prior_run"))
        judged = judged.observe(observed[1], F.count(F.lit(1)).alias("rows_read"), many("filtered"), many("quarantined"))
    counters = buckets.agg(F.count("*").alias("rows_read"), *[F.count_if(F.col("bucket") == b).alias(f"rows_{b}") for b in names])
    counters = counters.select(F.lit(run_id).cast("bigint").alias("ingest_run_id"), "*", (F.col("rows_read") == sum((F.col(f"rows_{b}") for b in names), F.lit(0))).alias("balanced"))
    positions = accepted.where("bucket = 'inserted'").withColumn("ingest_run_id", F.lit(run_id).cast("bigint")).select(*POSITION_COLUMNS)
    quarantine = judged.where("bucket = 'quarantined'").select(F.col("reject.rule_id").alias("rule_id"), "source_file", "source_line", "raw_text", F.col("reject.detail").alias("detail"), F.lit(run_id).cast("bigint").alias("ingest_run_id"))
    hits = judged.select(F.explode("hits").alias("h")).groupBy(F.col("h.rule_id").alias("rule_id"), F.col("h.action").alias("action")).agg(F.count("*").alias("hits"))
    return IngestResult(positions, quarantine, upsert_vessels(vessels, found), counters, hits, buckets)
