"""Rules over consecutive fixes of a vessel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import PairRule, pair_rules, with_distance

#: The total order of a vessel's fixes.
ORDER = ["ts_utc", "ingest_run_id", "source_line"]


def vessel_order():
    return Window.partitionBy("mmsi").orderBy(*ORDER)


def judge_pairs(fixes: DataFrame, rules: list[PairRule] | None = None) -> DataFrame:
    """Adds pair_hits: the ids of the rules that fire between a fix and the one before it."""
    rules = rules if rules is not None else pair_rules()
    w = vessel_order()
    df = with_distance(fixes.withColumn("prev", F.lag(F.struct("ts_utc", "lat", "lon", "sog_kn")).over(w)))
    fired = F.array_compact(F.array(*[F.when(F.col("prev").isNotNull() & r.fires(), F.lit(r.id)) for r in rules]))
    return df.withColumn("pair_hits", fired).drop("prev", "dt_s", "nm")


def annotate(fixes: DataFrame, rules: list[PairRule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fixes with both halves of each firing pair flagged, hits of each rule counted by pair).

    Flags of these rules from an earlier pass are dropped first, so a second pass changes nothing.
    """
    rules = rules if rules is not None else pair_rules()
    df = judge_pairs(fixes, rules)
    return flag_both(df, F.coalesce(F.lead("pair_hits").over(vessel_order()), F.array().cast("array<string>")), rules)


def flag_both(df: DataFrame, after: Column, rules: list[PairRule]) -> tuple[DataFrame, DataFrame]:
    """annotate()'s two results from fixes with pair_hits and those of the fix after."""
    own = F.array(*[F.lit(r.id) for r in rules])
    flagged = df.withColumn("quality_flags", F.array_distinct(F.concat(F.array_except("quality_flags", own), "pair_hits", after)))
    hits = df.select(F.explode("pair_hits").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return flagged.drop("pair_hits", "_after"), hits
