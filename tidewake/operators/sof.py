"""Statements of Facts: which call a document describes, how its events compare, and both prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import elapsed_s, overlap_s
from ..functions.text import port_names_agree
from ..sources.staging import Staging
from .intervals import meet
from .laytime import EXCEPTIONS, calculate, voyage_timeline

UNOBSERVABLE = ["NoticeOfReadinessTendered", "CargoCommenced", "CargoCompleted"]


@dataclass(frozen=True)
class Tolerances:
    all_fast_lag_s: int = 45 * 60
    all_fast_s: int = 30 * 60
    physical_s: int = 15 * 60


def document_windows(events: DataFrame) -> DataFrame:
    """One row per document: its vessel, port and time span. events: doc_id, mmsi, port, ts_utc, kind, label, remark."""
    return events.groupBy("doc_id").agg(F.min("mmsi").alias("mmsi"), F.min("port").alias("document_port"), F.min("ts_utc").alias("from_utc"), F.max("ts_utc").alias("to_utc"))


def select_calls(documents: DataFrame, calls: DataFrame, *, by_days: bool = False) -> DataFrame:
    """Calls of the document's vessel that share time with it, ranked; chosen where one shares most. A tie chooses none.

    An equi join on the vessel with the range as a filter: the calls of one vessel are few. Where they are not (a shared
    number, years of calls), by_days makes a document meet the calls around its own days alone.
    """
    pairs = meet(documents, calls, ["mmsi"], ("from_utc", "to_utc"), ("arrived_utc", "departed_utc")) if by_days else documents.join(calls, "mmsi")
    df = pairs.withColumn("overlap_s", overlap_s("from_utc", "to_utc", "arrived_utc", "departed_utc")).where("overlap_s > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("overlap_s"), "arrived_utc")
    df = df.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead("overlap_s").over(w))
    chosen = (F.col("rank") == 1) & (F.col("_next").isNull() | (F.col("_next") < F.col("overlap_s")))
    return df.withColumn("chosen", chosen).withColumn("ambiguous", F.max(F.when(F.col("rank") == 1, F.coalesce(F.col("_next") == F.col("overlap_s"), F.lit(False)))).over(Window.partitionBy("doc_id"))).drop("_next")


def suspension_periods(events: DataFrame) -> DataFrame:
    """(doc_id, suspended_utc, resumed_utc, reason): a suspension that is not within another, to the next resumption."""
    w = Window.partitionBy("doc_id").orderBy("ts_utc", "event_no")
    df = events.where(F.col("kind").isin("Suspended", "Resumed")).withColumn("_prev", F.lag("kind").over(w))
    df = df.withColumn("_next", F.min(F.when(F.col("kind") == "Resumed", F.struct("ts_utc", "event_no"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    opens = df.where((F.col("kind") == "Suspended") & ~F.col("_prev").eqNullSafe(F.lit("Suspended")) & F.col("_next").isNotNull())
    return opens.select("doc_id", F.col("ts_utc").alias("suspended_utc"), F.col("_next.ts_utc").alias("resumed_utc"), F.coalesce("remark", "label").alias("reason"))


def first_events(events: DataFrame) -> DataFrame:
    """The first event of each kind of each document."""
    at = F.struct("ts_utc", "event_no")
    return events.groupBy("doc_id", "kind").agg(F.min("ts_utc").alias("sof_utc"), F.min_by("label", at).alias("label"), F.max("ts_utc").alias("last_utc"))


def reconcile(events: DataFrame, calls: DataFrame, phases: DataFrame, terms: DataFrame, tolerances: Tolerances = Tolerances(), staging: Staging | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(comparisons, summary, refusals, not_compared) of documents against the call each describes.

    terms: one row per doc_id. Refused are documents without a vessel's call in their time, with a tie, whose call has no
    berth or an untrusted berth span, or that name no end of laytime. With a staging, the ranked calls, the timelines and
    the documents that stand are written once; all four results read them.
    """
    keep = (lambda df, name: df) if staging is None else staging.save
    spark_kinds = [("Anchored", 0, tolerances.physical_s), ("AnchorAweigh", 0, tolerances.physical_s), ("AllFast", tolerances.all_fast_lag_s, tolerances.all_fast_s), ("LeftBerth", 0, tolerances.physical_s)]
    documents = document_windows(events)
    ranked = keep(select_calls(documents, calls), "ranked")
    chosen = ranked.where("chosen")
    anchorage = F.when(F.col("phase") == "Anchorage", F.col("seq"))
    anchored = phases.groupBy("mmsi", "arrived_utc").agg(F.min_by("started_utc", anchorage).alias("anchored_utc"), F.max_by("ended_utc", anchorage).alias("aweigh_utc"))
    base = keep(chosen.join(voyage_timeline(phases), ["mmsi", "arrived_utc"]).join(anchored, ["mmsi", "arrived_utc"]), "timelines")
    firsts = keep(first_events(events), "first-events")
    found = ranked.groupBy("doc_id").agg(F.bool_or("chosen").alias("any_chosen"))
    state = documents.select("doc_id").join(found, "doc_id", "left").join(base.select("doc_id", "berthed_utc", "untrusted_s"), "doc_id", "left")
    ends = firsts.groupBy("doc_id").agg(F.min(F.when(F.col("kind") == "LeftBerth", F.col("sof_utc"))).alias("left"), F.max(F.when(F.col("kind") == "CargoCompleted", F.col("last_utc"))).alias("done"), F.min(F.when(F.col("kind") == "AllFast", F.col("sof_utc"))).alias("fast"))
    state = state.join(ends, "doc_id", "left")
    refusal = (
        F.when(F.col("any_chosen").isNull(), "NoCallInDocumentTime").when(~F.col("any_chosen"), "AmbiguousCall").when(F.col("berthed_utc").isNull(), "NoBerthPhase")
        .when(F.col("untrusted_s") > 0, "BerthGeometryUntrustworthy").when(F.coalesce("left", "done").isNull(), "NoEndOfLaytime")
    )
    state = keep(state.withColumn("refusal", refusal), "state")
    refusals = state.where("refusal IS NOT NULL").select("doc_id", "refusal")
    good = base.join(state.where("refusal IS NULL").select("doc_id", "left", "done", "fast"), "doc_id")
    good = keep(good, "good")
    ais = {"Anchored": "anchored_utc", "AnchorAweigh": "aweigh_utc", "AllFast": "berthed_utc", "LeftBerth": "departed_berth_utc"}
    rows = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(ais[k]).alias("ais_utc"), F.lit(lag).alias("expected_s"), F.lit(tol).alias("tolerance_s"), F.lit(True).alias("seen")) for k, lag, tol in spark_kinds],
        *[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("timestamp").alias("ais_utc"), F.lit(0).alias("expected_s"), F.lit(0).alias("tolerance_s"), F.lit(False).alias("seen")) for k in UNOBSERVABLE],
    )
    compared = good.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").join(firsts.drop("last_utc"), ["doc_id", "kind"], "left")
    off = elapsed_s("ais_utc", "sof_utc") - F.col("expected_s")
    verdict = F.when(F.col("sof_utc").isNull(), "AbsentFromStatement").when(~F.col("seen"), "AisCannotObserve").when(F.col("ais_utc").isNull(), "AbsentFromAis").when(F.abs(off) <= F.col("tolerance_s"), "Agrees").otherwise("Disagrees")
    comparisons = compared.select("doc_id", "kind", "label", "sof_utc", "ais_utc", "expected_s", off.alias("unexplained_s"), verdict.alias("verdict"))
    # classified events that no comparison shows
    used = comparisons.where("sof_utc IS NOT NULL").select("doc_id", "kind", F.col("sof_utc").alias("ts_utc"))
    not_compared = events.where("kind <> 'Other'").join(good.select("doc_id"), "doc_id", "left_semi").join(used, ["doc_id", "kind", "ts_utc"], "left_anti")

    periods = suspension_periods(events).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("suspended_utc").alias("from_utc"), F.col("resumed_utc").alias("to_utc"), "reason"))).cast(EXCEPTIONS).alias("periods"))
    own = good.select("doc_id", "fast", "left", "done").join(terms, "doc_id").join(periods, "doc_id", "left")
    own = own.withColumn("exceptions", F.coalesce("periods", F.array().cast(EXCEPTIONS))).withColumn("berthed_utc", F.col("fast")).withColumn("completed_utc", F.coalesce("left", "done"))
    by_doc, _, doc_errors = calculate(own, ["doc_id"])
    seen = good.select("doc_id", "berthed_utc", F.col("departed_berth_utc").alias("completed_utc")).join(terms, "doc_id")
    by_ais, _, ais_errors = calculate(seen, ["doc_id"])
    refusals = refusals.unionByName(doc_errors.select("doc_id", F.concat(F.lit("document: "), "error").alias("refusal"))).unionByName(ais_errors.select("doc_id", F.concat(F.lit("AIS: "), "error").alias("refusal")))
    summary = (
        good.select("doc_id", "mmsi", "arrived_utc", "overlap_s", "document_port", *[c for c in ("port_name",) if c in good.columns])
        .join(by_doc.select("doc_id", F.col("used_hours").alias("document_used_hours"), F.col("owed_minor").alias("document_owed_minor"), "currency"), "doc_id")
        .join(by_ais.select("doc_id", F.col("used_hours").alias("ais_used_hours"), F.col("owed_minor").alias("ais_owed_minor")), "doc_id")
        .withColumn("difference_minor", F.col("document_owed_minor") - F.col("ais_owed_minor"))
    )
    if "port_name" in summary.columns:
        summary = summary.withColumn("port_names_agree", port_names_agree(F.col("document_port"), F.col("port_name")))
    return comparisons, summary, refusals, not_compared
