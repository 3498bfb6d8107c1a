"""Gazetteer, Statements of Facts and archive documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import classify_sof_event

PORT_SCHEMA = "wpi_number string, port_name string, alternate_name string, un_locode string, country string, latitude_deg string, longitude_deg string"
SOF_SCHEMA = "mmsi long, vesselName string, port string, preparedBy string, events array<struct<timestampUtc:string,label:string,kind:string,remark:string>>"
PHASE = "struct<sequence:int,phase:string,startedUtc:timestamp,endedUtc:timestamp,observedDurationHours:double,isComplete:boolean,reportedStatus:string,statusAgrees:boolean>"
CALL = f"struct<mmsi:bigint,arrivedUtc:timestamp,departedUtc:timestamp,waitingHours:double,workingHours:double,unclassifiedHours:double,isComplete:boolean,portName:string,portCountry:string,portDistanceNm:double,phases:array<{PHASE}>>"
ARCHIVE_SCHEMA = f"formatVersion int, archivedUtc timestamp, cutoffUtc timestamp, sourceFiles array<string>, portCalls array<{CALL}>"
ARCHIVE_VERSIONS = (0, 1)
SOF_KINDS = ["Other", "EndOfSeaPassage", "Anchored", "AnchorAweigh", "NoticeOfReadinessTendered", "FirstLineAshore", "AllFast", "CargoCommenced", "CargoCompleted", "Suspended", "Resumed", "LeftBerth", "StartOfSeaPassage"]


def check_ports(ports: DataFrame) -> DataFrame:
    """Typed ports in file order. Raises where a required field is empty, a coordinate no number, or no row is there."""
    typed = ports.select(
        F.col("wpi_number").try_cast("int").alias("wpi_number"), "port_name", "alternate_name", "un_locode", "country", F.col("latitude_deg").try_cast("double").alias("latitude_deg"), F.col("longitude_deg").try_cast("double").alias("longitude_deg"), "ordinal"
    )
    bad = F.col("wpi_number").isNull() | (F.coalesce(F.trim("port_name"), F.lit("")) == "") | (F.coalesce(F.trim("country"), F.lit("")) == "") | F.col("latitude_deg").isNull() | F.col("longitude_deg").isNull()
    seen = typed.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("ordinal"))).alias("first")).first()
    if not seen["n"]:
        raise ValueError("the gazetteer has no ports")
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} gazetteer rows lack a required field or have an unreadable number; the first is row {seen['first'] + 1}")
    return typed


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PORT_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return check_ports(rows.withColumn("ordinal", F.monotonically_increasing_id()))


def read_sof(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a folder of statements, one JSON document per file; keys ignore case.

    A document is refused, with its reason, for an unreadable file, a vessel number that is not positive, no events, an
    event without a label or without a readable time. A given kind beats the classifier. Events are numbered by time.
    """
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw"))
    lowered = docs.withColumn("raw", F.regexp_replace("raw", r'(?i)"(mmsi)"\s*:', '"mmsi":'))
    for key in ("vesselName", "port", "preparedBy", "events", "timestampUtc", "label", "kind", "remark"):
        lowered = lowered.withColumn("raw", F.regexp_replace("raw", rf'(?i)"{key}"\s*:', f'"{key}":'))
    return sof_documents(lowered.withColumn("d", F.from_json("raw", SOF_SCHEMA)).select("doc_id", "d.*"))


def sof_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of parsed documents: doc_id and the fields of SOF_SCHEMA."""
    time = lambda e: F.coalesce(F.try_to_timestamp(e["timestampUtc"]), F.lit(None).cast("timestamp"))
    why = (
        F.when(F.col("events").isNull() & F.col("mmsi").isNull(), "unreadable document").when(F.coalesce("mmsi", F.lit(0)) <= 0, "no vessel number").when(F.coalesce(F.size("events"), F.lit(0)) <= 0, "no events")
        .when(F.exists("events", lambda e: F.coalesce(F.trim(e["label"]), F.lit("")) == ""), "an event has no label").when(F.exists("events", lambda e: time(e).isNull()), "an event has no readable time")
    )
    docs = docs.withColumn("reason", why)
    rejects = docs.where("reason IS NOT NULL").select("doc_id", "reason")
    e = docs.where("reason IS NULL").select("doc_id", "mmsi", F.col("vesselName").alias("vessel_name"), "port", F.posexplode("events").alias("given_no", "e"))
    kind = F.when(F.col("e.kind").isin(SOF_KINDS), F.col("e.kind")).otherwise(classify_sof_event(F.col("e.label")))
    e = e.select("doc_id", "mmsi", "vessel_name", "port", F.try_to_timestamp("e.timestampUtc").alias("ts_utc"), kind.alias("kind"), F.col("e.label").alias("label"), F.col("e.remark").alias("remark"), "given_no")
    from pyspark.sql.window import Window

    return e.withColumn("event_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("ts_utc", "given_no"))).drop("given_no"), rejects


def archive_documents(calls: DataFrame, phases: DataFrame, cutoff, archived, source_files: list[str]) -> DataFrame:
    """One archive row per call, each with its phases, in the nested form; call order is by arrival when read."""
    p = phases.select("mmsi", "arrived_utc", F.struct(F.col("seq").cast("int").alias("sequence"), "phase", F.col("started_utc").alias("startedUtc"), F.col("ended_utc").alias("endedUtc"), F.col("duration_hours").alias("observedDurationHours"), F.col("is_complete").alias("isComplete"), F.col("reported_status").alias("reportedStatus"), F.col("status_agrees").alias("statusAgrees")).alias("p"))
    nested = p.groupBy("mmsi", "arrived_utc").agg(F.array_sort(F.collect_list("p")).alias("phases"))
    c = calls.join(nested, ["mmsi", "arrived_utc"], "left")
    extra = {n: (F.col(n) if n in calls.columns else F.lit(None)) for n in ("port_name", "port_country", "port_distance_nm")}
    call = F.struct(
        "mmsi", F.col("arrived_utc").alias("arrivedUtc"), F.col("departed_utc").alias("departedUtc"), F.col("waiting_hours").alias("waitingHours"), F.col("working_hours").alias("workingHours"), F.col("unclassified_hours").alias("unclassifiedHours"), F.col("is_complete").alias("isComplete"),
        extra["port_name"].cast("string").alias("portName"), extra["port_country"].cast("string").alias("portCountry"), extra["port_distance_nm"].cast("double").alias("portDistanceNm"), F.coalesce("phases", F.array().cast(f"array<{PHASE}>")).alias("phases"),
    )
    return c.select(F.lit(1).alias("formatVersion"), F.lit(archived).cast("timestamp").alias("archivedUtc"), F.lit(cutoff).cast("timestamp").alias("cutoffUtc"), F.array(*[F.lit(s) for s in source_files]).cast("array<string>").alias("sourceFiles"), F.array(call).alias("portCalls"))


def read_archive(spark: SparkSession, path: str, mmsi: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, phases) of archives. Raises for bad JSON, an unknown version, or no calls at all."""
    docs = spark.read.schema(ARCHIVE_SCHEMA).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    seen = docs.agg(F.count_if(~F.coalesce("formatVersion", F.lit(0)).isin(*ARCHIVE_VERSIONS)).alias("bad"), F.sum(F.size("portCalls")).alias("calls")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} archive documents have a version other than {', '.join(map(str, ARCHIVE_VERSIONS))}")
    if not seen["calls"]:
        raise ValueError("the archive holds no calls")
    c = docs.select(F.explode("portCalls").alias("c")).select("c.*")
    if mmsi is not None:
        c = c.where(F.col("mmsi") == mmsi)
    calls = c.select("mmsi", F.col("arrivedUtc").alias("arrived_utc"), F.col("departedUtc").alias("departed_utc"), F.col("waitingHours").alias("waiting_hours"), F.col("workingHours").alias("working_hours"), F.col("unclassifiedHours").alias("unclassified_hours"), F.col("isComplete").alias("is_complete"), F.col("portName").alias("port_name"))
    phases = c.select("mmsi", F.col("arrivedUtc").alias("arrived_utc"), F.explode("phases").alias("p")).select("mmsi", "arrived_utc", F.col("p.sequence").alias("seq"), F.col("p.phase").alias("phase"), F.col("p.startedUtc").alias("started_utc"), F.col("p.endedUtc").alias("ended_utc"), F.col("p.observedDurationHours").alias("duration_hours"), F.col("p.isComplete").alias("is_complete"))
    return calls, phases


def archive_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("calls"), F.count_if(~F.col("is_complete")).alias("open_calls"), F.countDistinct("mmsi").alias("vessels"))
