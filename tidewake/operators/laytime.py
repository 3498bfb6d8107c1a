"""Laytime and demurrage: what counted, what was excepted, what is owed. Whole batches of calls times terms, in integer seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import overlap_s
from ..functions.text import prorate_minor

EXCEPTIONS = "array<struct<from_utc:timestamp,to_utc:timestamp,reason:string>>"
TERMS = f"allowed_hours double, rate_minor bigint, currency string, notice_utc timestamp, notice_assumed boolean, commencement string, turn_hours double, exceptions {EXCEPTIONS}, once_on_demurrage boolean"
#: 72 hours free, 28,000 a day, six hours of turn time.
DEFAULTS = {"allowed_hours": 72.0, "rate_minor": 2_800_000, "currency": "USD", "turn_hours": 6.0, "commencement": "TurnTimeOrBerthingWhicheverFirst", "once_on_demurrage": True}
COMMENCEMENTS = ("TurnTimeAfterNotice", "OnBerthing", "TurnTimeOrBerthingWhicheverFirst")


def default_terms(calls: DataFrame) -> DataFrame:
    """Default terms of every call, with notice assumed at arrival."""
    d = DEFAULTS
    return calls.select(
        "mmsi", "arrived_utc", F.lit(d["allowed_hours"]).alias("allowed_hours"), F.lit(d["rate_minor"]).cast("bigint").alias("rate_minor"), F.lit(d["currency"]).alias("currency"), F.col("arrived_utc").alias("notice_utc"),
        F.lit(True).alias("notice_assumed"), F.lit(d["commencement"]).alias("commencement"), F.lit(d["turn_hours"]).alias("turn_hours"), F.array().cast(EXCEPTIONS).alias("exceptions"), F.lit(d["once_on_demurrage"]).alias("once_on_demurrage"),
    )


def voyage_timeline(phases: DataFrame) -> DataFrame:
    """Per call: berthed_utc, departed_berth_utc (first berth's start, last berth's end) and untrusted_s, seconds of unknown phases within that span."""
    call = Window.partitionBy("mmsi", "arrived_utc")
    berth = F.when(F.col("phase") == "Berth", F.col("seq"))
    df = phases.withColumn("berthed_utc", F.min_by("started_utc", berth).over(call)).withColumn("departed_berth_utc", F.max_by("ended_utc", berth).over(call))
    # greatest() passes over nulls, so a call without a berth counts nothing
    shared = F.when(F.col("phase") == "Unknown", F.greatest(F.lit(0), overlap_s("started_utc", "ended_utc", "berthed_utc", "departed_berth_utc"))).otherwise(0)
    return df.groupBy("mmsi", "arrived_utc").agg(F.first("berthed_utc").alias("berthed_utc"), F.first("departed_berth_utc").alias("departed_berth_utc"), F.sum(shared).alias("untrusted_s"))


def merged_exceptions(exceptions: Column, begin: Column, end: Column) -> Column:
    """Clipped to begin and end, in order, overlapping or touching ones joined, their reasons too unless equal. Times as epoch seconds."""
    clipped = F.transform(
        F.coalesce(exceptions, F.array().cast(EXCEPTIONS)),
        lambda e: F.struct(F.greatest(F.unix_seconds(e["from_utc"]), begin).alias("f"), F.least(F.unix_seconds(e["to_utc"]), end).alias("t"), e["reason"].alias("r")),
    )
    # a stable order: by start, then as given
    numbered = F.transform(F.filter(clipped, lambda e: e["t"] > e["f"]), lambda e, i: F.struct(e["f"].alias("f"), i.alias("i"), e["t"].alias("t"), e["r"].alias("r")))
    ordered = F.transform(F.array_sort(numbered), lambda e: F.struct(e["f"].alias("f"), e["t"].alias("t"), e["r"].alias("r")))
    empty = F.array().cast("array<struct<f:bigint,t:bigint,r:string>>")

    def fold(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        reason = F.when(last["r"].eqNullSafe(e["r"]), last["r"]).otherwise(F.concat(F.coalesce(last["r"], F.lit("")), F.lit("; "), F.coalesce(e["r"], F.lit(""))))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["f"].alias("f"), F.greatest(last["t"], e["t"]).alias("t"), reason.alias("r"))))
        return F.when(F.size(acc) == 0, F.array(e)).when(e["f"] <= last["t"], joined).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(ordered, empty, fold)


def calculate(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, lines, errors) of rows that hold key, the terms' columns, berthed_utc and completed_utc.

    Whether an exception still stops the clock depends only on the time before it less the exceptions before it, a
    prefix sum; so no statement needs a loop. Counted stretches are split where the allowance ends.
    """
    s = F.unix_seconds
    turned = s("notice_utc") + F.round(F.col("turn_hours") * 3600).cast("bigint")
    berthed = s("berthed_utc")
    commenced = (
        F.when(F.col("commencement") == "TurnTimeAfterNotice", turned)
        .when(F.col("commencement") == "OnBerthing", berthed)
        .when(F.col("commencement") == "TurnTimeOrBerthingWhicheverFirst", F.least(turned, F.coalesce(berthed, turned)))
    )
    turn_text = F.concat(F.format_string("%.0f", "turn_hours"), F.lit("h turn time after notice"))
    why = F.when(F.col("commencement") == "OnBerthing", "on berthing").when((F.col("commencement") == "TurnTimeOrBerthingWhicheverFirst") & (berthed < turned), "berthed before turn time expired").otherwise(turn_text)
    df = df.withColumn("commenced_s", commenced).withColumn("completed_s", s("completed_utc")).withColumn("allowed_s", F.round(F.col("allowed_hours") * 3600).cast("bigint"))
    df = df.withColumn("commencement_reason", F.when(F.col("notice_assumed"), F.concat(why, F.lit(", from an ASSUMED notice time"))).otherwise(why))
    error = F.when(~F.coalesce(F.col("commencement").isin(*COMMENCEMENTS), F.lit(False)), "unsupported commencement rule").when(F.col("commenced_s").isNull(), "no berthing time for commencement on berthing").when(F.col("completed_s").isNull(), "no end of laytime").when(F.col("completed_s") < F.col("commenced_s"), "completed before laytime commenced")
    df = df.withColumn("error", error)
    errors = df.where("error IS NOT NULL").select(*key, "error")
    df = df.where("error IS NULL").withColumn("ex", merged_exceptions(F.col("exceptions"), F.col("commenced_s"), F.col("completed_s")))
    before = F.transform(F.col("ex"), lambda e, i: F.aggregate(F.slice("ex", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["t"] - x["f"]))
    df = df.withColumn("before", before)
    late = F.transform(F.col("ex"), lambda e, i: F.col("once_on_demurrage") & (e["f"] - F.col("commenced_s") - F.get(F.col("before"), i) >= F.col("allowed_s")))
    df = df.withColumn("late", late)
    # deducted seconds before each exception: those of exceptions that stopped the clock
    deducted = F.transform(F.col("ex"), lambda e, i: F.aggregate(F.slice(F.transform(F.col("ex"), lambda x, j: F.when(F.get(F.col("late"), j), F.lit(0).cast("bigint")).otherwise(x["t"] - x["f"])), 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    df = df.withColumn("gone", deducted)
    ops = F.lit("cargo operations")

    def piece(f, t, kind, reason, counted):
        return F.struct(f.cast("bigint").alias("f"), t.cast("bigint").alias("t"), kind.alias("kind"), reason.alias("reason"), counted.cast("bigint").alias("counted"))

    def around(e: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.col("commenced_s")).otherwise(F.get(F.col("ex"), i - 1)["t"])
        gone, on = F.get(F.col("gone"), i), F.get(F.col("late"), i)
        gap = piece(begin, e["f"], F.lit("Run"), ops, begin - F.col("commenced_s") - gone)
        own = piece(e["f"], e["t"], F.when(on, "Run").otherwise("Excepted"), F.when(on, F.concat(e["r"], F.lit(" (not deducted: already on demurrage)"))).otherwise(e["r"]), e["f"] - F.col("commenced_s") - gone)
        return F.array(gap, own)

    total_gone = F.aggregate(F.transform(F.col("ex"), lambda x, j: F.when(F.get(F.col("late"), j), F.lit(0).cast("bigint")).otherwise(x["t"] - x["f"])), F.lit(0).cast("bigint"), lambda a, x: a + x)
    last_end = F.coalesce(F.get(F.col("ex"), F.size("ex") - 1)["t"], F.col("commenced_s"))
    tail = piece(last_end, F.col("completed_s"), F.lit("Run"), ops, last_end - F.col("commenced_s") - total_gone)
    notice_text = F.when(F.col("notice_assumed"), "notice ASSUMED at arrival (AIS cannot observe a notice); laytime not yet running").otherwise("notice tendered; laytime not yet running")
    head = piece(s("notice_utc"), F.col("commenced_s"), F.lit("BeforeCommencement"), notice_text, F.lit(0))
    pieces = F.filter(F.concat(F.array(head), F.flatten(F.transform(F.col("ex"), around)), F.array(tail)), lambda p: p["t"] > p["f"])

    def split(p: Column) -> Column:
        left = F.col("allowed_s") - p["counted"]
        cut = F.least(F.greatest(left, F.lit(0)), p["t"] - p["f"]) + p["f"]
        two = F.array(piece(p["f"], cut, F.lit("Counted"), p["reason"], p["counted"]), piece(cut, p["t"], F.lit("OnDemurrage"), p["reason"], p["counted"]))
        return F.when(p["kind"] != "Run", F.array(p)).otherwise(F.filter(two, lambda q: q["t"] > q["f"]))

    df = df.withColumn("pieces", pieces)
    df = df.withColumn("lines", F.flatten(F.transform("pieces", split)))

    def total(*kinds: str) -> Column:
        return F.aggregate(F.filter("lines", lambda p: p["kind"].isin(*kinds)), F.lit(0).cast("bigint"), lambda a, p: a + p["t"] - p["f"])

    df = df.withColumn("used_s", total("Counted", "OnDemurrage")).withColumn("excepted_s", total("Excepted"))
    df = df.withColumn("demurrage_s", F.greatest(F.lit(0), F.col("used_s") - F.col("allowed_s")))
    lines = df.select(*key, F.posexplode("lines").alias("line_no", "p")).select(*key, "line_no", F.timestamp_seconds("p.f").alias("from_utc"), F.timestamp_seconds("p.t").alias("to_utc"), ((F.col("p.t") - F.col("p.f")) / 3600.0).alias("hours"), F.col("p.kind").alias("kind"), F.col("p.reason").alias("reason"))
    statements = df.select(
        *key, F.timestamp_seconds("commenced_s").alias("commenced_utc"), "commencement_reason", F.timestamp_seconds("completed_s").alias("completed_utc"), "allowed_hours",
        (F.col("used_s") / 3600.0).alias("used_hours"), (F.col("excepted_s") / 3600.0).alias("excepted_hours"), (F.col("demurrage_s") / 3600.0).alias("demurrage_hours"), (F.greatest(F.lit(0), F.col("allowed_s") - F.col("used_s")) / 3600.0).alias("saved_hours"),
        "rate_minor", "currency", prorate_minor(F.col("rate_minor"), F.col("demurrage_s"), 86400).alias("owed_minor"),
        (F.col("used_s") + F.col("excepted_s") == F.col("completed_s") - F.col("commenced_s")).alias("balanced"),
    )
    return statements, lines, errors


def assess_laytime(phases: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, lines, refusals) of calls times their terms (keyed by mmsi, arrived_utc). A call without a berth, or with an untrusted stop in its berth span, is refused."""
    key = ["mmsi", "arrived_utc"]
    df = terms.join(voyage_timeline(phases), key)
    refusal = F.when(F.col("berthed_utc").isNull(), "NoBerthPhase").when(F.col("untrusted_s") > 0, "BerthGeometryUntrustworthy")
    df = df.withColumn("refusal", refusal)
    statements, lines, errors = calculate(df.where("refusal IS NULL").withColumn("completed_utc", F.col("departed_berth_utc")), key)
    refused = df.where("refusal IS NOT NULL").select(*key, "refusal").unionByName(errors.select(*key, F.col("error").alias("refusal")))
    return statements, lines, refused


def priceability(phases: DataFrame) -> DataFrame:
    """Calls that can be priced, that have no berth, and of untrusted geometry."""
    t = voyage_timeline(phases)
    outcome = F.when(F.col("berthed_utc").isNull(), "NoBerthPhase").when(F.col("untrusted_s") > 0, "BerthGeometryUntrustworthy").otherwise("Priceable")
    return t.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("calls"))


def add_money(a: DataFrame, amount: str = "owed_minor", currency: str = "currency") -> DataFrame:
    """Totals by currency: amounts of different currencies are never added."""
    return a.groupBy(currency).agg(F.sum(amount).alias(amount), F.count("*").alias("items"))


def terms_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, f"mmsi bigint, arrived_utc timestamp, {TERMS}")
