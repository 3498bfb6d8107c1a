"""Quality rules as Column expressions. A rule gives a detail text where it fires and null where it does not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import elapsed_s, haversine_nm, implied_speed_kn
from ..functions.text import reported_activity
from .thresholds import Thresholds


@dataclass(frozen=True)
class RowRule:
    """detail(): over the columns of a parsed record. `cases` of (condition, action, detail), the first that holds."""

    id: str
    description: str
    cases: Callable[[], list[tuple[Column, str, Column]]]

    def hits(self) -> Column:
        """A list of the hit alone, or an empty one."""
        out = None
        for when, action, detail in self.cases():
            value = F.array(F.struct(F.lit(self.id).alias("rule_id"), F.lit(action).alias("action"), detail.alias("detail")))
            out = F.when(when, value) if out is None else out.when(when, value)
        return out.otherwise(F.array().cast("array<struct<rule_id: string, action: string, detail: string>>"))


@dataclass(frozen=True)
class PairRule:
    """Fires on a fix and the one before it: columns prev (struct), lat, lon, sog_kn, dt_s, nm."""

    id: str
    description: str
    fires: Callable[[], Column]


def row_rules(th: Thresholds = Thresholds()) -> list[RowRule]:
    c = F.col
    return [
        RowRule("R1", "row could not be parsed", lambda: [(c("parse_failure").isNotNull(), "Reject", c("parse_failure"))]),
        RowRule(
            "R4",
            "position is a sentinel or off the globe",
            lambda: [
                (c("lat") == 91, "Reject", F.lit("latitude 91 means not available")),
                ((c("lat") == 0) & (c("lon") == 0), "Reject", F.lit("position 0, 0")),
                (F.abs("lat") > 90, "Reject", F.lit("latitude out of range")),
                (F.abs("lon") > 180, "Reject", F.lit("longitude out of range")),
            ],
        ),
        RowRule("R5", "speed over ground not available", lambda: [(c("parse_failure").isNull() & c("sog_kn").isNull(), "Flag", F.lit("no speed"))]),
        RowRule(
            "R6",
            "speed over ground implausible",
            lambda: [
                (c("sog_kn") > th.speed_reject_kn, "Reject", F.lit("speed impossible")),
                (c("sog_kn") >= th.speed_flag_kn, "Flag", F.lit("speed unlikely")),
            ],
        ),
        RowRule("R12", "status claims rest while moving", lambda: [((reported_activity(c("nav_status")) == "Stationary") & (c("sog_kn") > th.stationary_speed_kn), "Flag", F.concat(F.lit("moving while "), c("nav_status")))]),
        RowRule("R13", "ETA implausibly far ahead", lambda: [(elapsed_s("ts_utc", "eta_utc") > th.eta_days * 86400, "Flag", F.lit("ETA too far ahead"))]),
    ]


def pair_rules(th: Thresholds = Thresholds()) -> list[PairRule]:
    c = F.col
    speed = implied_speed_kn(c("nm"), c("dt_s"))
    before = c("prev.sog_kn")
    return [
        PairRule("R7", "position jumped", lambda: (c("nm") > th.teleport_nm) & (speed > th.teleport_kn)),
        PairRule("R8", "gap in coverage", lambda: c("dt_s") > th.coverage_gap_s),
        PairRule("R11", "speed disagrees with movement", lambda: before.isNotNull() & (c("nm") > th.inconsistent_nm) & (speed > th.inconsistent_times * before) & (speed > before + th.inconsistent_kn)),
    ]


#: R10 stands on the stop: its modal status claims movement.
OWN_RULES = {"R10": "status claims movement during a stop"}
POSITION_UNRELIABLE = ["R7", "R11"]


def is_flagged(rule_id: str, flags="quality_flags") -> Column:
    return F.array_contains(flags, rule_id)


def position_unreliable(flags="quality_flags") -> Column:
    return F.arrays_overlap(F.col(flags) if isinstance(flags, str) else flags, F.array(*[F.lit(r) for r in POSITION_UNRELIABLE]))


def judge(records: DataFrame, rules: list[RowRule] | None = None) -> DataFrame:
    """Adds hits (all rules that fire, in order), reject (the first rejection) and quality_flags (ids of flags)."""
    rules = rules if rules is not None else row_rules()
    # lists strung together are compiled; a filter of one list would interpret all rules within it
    df = records.withColumn("hits", F.concat(*[r.hits() for r in rules]))
    df = df.withColumn("reject", F.get(F.filter("hits", lambda h: h["action"] == "Reject"), F.lit(0)))
    return df.withColumn("quality_flags", F.transform(F.filter("hits", lambda h: h["action"] == "Flag"), lambda h: h["rule_id"]))


def registry(spark: SparkSession, th: Thresholds = Thresholds()) -> DataFrame:
    rows = [(r.id, r.description) for r in [*row_rules(th), *pair_rules(th)]]
    return spark.createDataFrame(rows, "rule_id string, description string")


def with_distance(df: DataFrame) -> DataFrame:
    """dt_s and nm between a fix and prev."""
    return df.withColumn("dt_s", elapsed_s("prev.ts_utc", "ts_utc")).withColumn("nm", haversine_nm("prev.lat", "prev.lon", "lat", "lon"))
