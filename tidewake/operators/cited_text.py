"""Checks narrations against the log entries that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CITATION, citations_in

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAMES = "|".join(MONTHS)
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
WRITTEN_DATE = rf"(?i)\b(?:\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{_NAMES})|(?:{_NAMES})\s+\d{{1,2}}(?:st|nd|rd|th)?)\b(?:,?\s+\d{{4}})?"
FIGURE = r"\d+(?::\d+)+|\d+\.\d+|\d+"


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")


def figures(text: Column) -> Column:
    """Figures as they compare: whole numbers without leading zeros; a time with seconds also as hours and minutes."""
    found = F.regexp_extract_all(text, F.lit(f"({FIGURE})"), F.lit(1))

    def forms(x: Column) -> Column:
        whole = F.when(F.ltrim(x, F.lit("0")) == "", F.lit("0")).otherwise(F.ltrim(x, F.lit("0")))
        time = F.when(x.rlike(r"^\d+:\d+:\d+$"), F.array(x, F.regexp_replace(x, r":\d+$", ""))).otherwise(F.array(x))
        return F.when(x.contains(":"), time).when(x.contains("."), F.array(x)).otherwise(F.array(whole))

    return F.array_distinct(F.flatten(F.transform(found, forms)))


def dates(text: Column) -> Column:
    """Dates written in a text, as structs of month, day and wording: ISO, or a day and an English month in either order."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(f"({ISO_DATE})"), F.lit(1)), lambda d: F.struct(F.substring(d, 6, 2).cast("int").alias("month"), F.substring(d, 9, 2).cast("int").alias("day"), d.alias("written")))
    rest = F.regexp_replace(text, ISO_DATE, " ")

    def one(d: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(F.lower(d), f"({_NAMES})", 1)).cast("int")
        day = F.regexp_extract(F.regexp_replace(d, r",?\s+\d{4}$", ""), r"(\d{1,2})", 1).cast("int")
        return F.struct(month.alias("month"), day.alias("day"), F.trim(d).alias("written"))

    return F.concat(iso, F.transform(F.regexp_extract_all(rest, F.lit(f"({WRITTEN_DATE})"), F.lit(1)), one))


def without_dates(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ISO_DATE, " "), WRITTEN_DATE, " ")


def sentences(text: Column) -> Column:
    """Sentences in order. Citations at the start of a piece belong to the sentence before it."""
    lead = r"^((?:\[r\d+[·.]L\d+\]\s*)+)"
    pieces = F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+"), F.trim)

    def fold(acc: Column, piece: Column) -> Column:
        cited = F.regexp_extract(piece, lead, 1)
        moves = (cited != "") & (F.size(acc) > 0)
        kept = F.when(moves, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), F.trim(cited))))).otherwise(acc)
        rest = F.when(moves, F.trim(F.regexp_replace(piece, lead, ""))).otherwise(piece)
        return F.when(rest != "", F.concat(kept, F.array(rest))).otherwise(kept)

    return F.aggregate(pieces, F.array().cast("array<string>"), fold)


def validate_cited_text(narrations: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, problems). narrations: narration_id, text. evidence: citation, ts_utc, text, optionally narration_id to keep each text to its own entries.

    Every sentence must cite known entries; a date must be a cited entry's, and any other figure must stand in a cited
    entry's text or time. One problem refuses the whole text.
    """
    own = ["narration_id"] if "narration_id" in evidence.columns else []
    facts = evidence.groupBy(*own, "citation").agg(
        F.flatten(F.collect_set(F.concat(figures(without_citations(F.col("text"))), figures(F.date_format("ts_utc", "HH:mm:ss"))))).alias("facts"),
        F.collect_set(F.struct(F.month("ts_utc").alias("month"), F.dayofmonth("ts_utc").alias("day"))).alias("dates"),
    )
    said = narrations.withColumn("sentences", sentences(F.coalesce("text", F.lit(""))))
    s = said.select("narration_id", F.posexplode("sentences").alias("i", "sentence")).withColumn("sentence_no", F.col("i") + 1).withColumn("cited", F.array_distinct(citations_in(F.col("sentence"))))
    plain = without_citations(F.col("sentence"))
    s = s.withColumn("stated", dates(plain)).withColumn("figures", figures(without_dates(plain)))
    cites = s.select("narration_id", "sentence_no", F.explode("cited").alias("citation")).join(facts, [*own, "citation"], "left")
    known = cites.groupBy("narration_id", "sentence_no").agg(
        F.flatten(F.collect_list("facts")).alias("facts"), F.flatten(F.collect_list("dates")).alias("dates"), F.array_sort(F.collect_set(F.when(F.col("facts").isNull(), F.col("citation")))).alias("unknown")
    )
    s = s.join(known, ["narration_id", "sentence_no"], "left")
    label = F.format_string("sentence %d", "sentence_no")
    empty = F.array().cast("array<string>")
    unknown = F.transform("unknown", lambda c: F.concat(label, F.lit(" cites "), c, F.lit(", which is not in the log it was given")))
    wrong_dates = F.transform(F.filter("stated", lambda d: ~F.exists("dates", lambda e: (e["month"] == d["month"]) & (e["day"] == d["day"]))), lambda d: F.concat(label, F.lit(" says "), d["written"], F.lit(", which none of its citations is dated")))
    wrong = F.transform(F.filter("figures", lambda x: ~F.array_contains("facts", x)), lambda x: F.concat(label, F.lit(" says "), x, F.lit(", which none of its citations contain")))
    problem = F.when(F.size("cited") == 0, F.array(F.concat(label, F.lit(' cites nothing: "'), "sentence", F.lit('"')))).when(F.size("unknown") > 0, unknown).otherwise(F.concat(F.coalesce(wrong_dates, empty), F.coalesce(wrong, empty)))
    problems = s.select("narration_id", "sentence_no", F.posexplode(problem).alias("problem_no", "problem"))
    none = said.where(F.size("sentences") == 0).select("narration_id", F.lit(0).alias("sentence_no"), F.lit(0).alias("problem_no"), F.lit("the narration is empty").alias("problem"))
    problems = problems.unionByName(none)
    counted = problems.groupBy("narration_id").agg(F.count("*").alias("problems"))
    verdicts = said.select("narration_id", F.size("sentences").alias("sentences")).join(counted, "narration_id", "left").withColumn("problems", F.coalesce("problems", F.lit(0))).withColumn("accepted", F.col("problems") == 0)
    return verdicts, problems
