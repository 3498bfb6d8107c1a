"""The stages of the derived feed that registered queries share, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators.annotate import annotate
from ..operators.ingest import IngestResult, parse, settle, settle_runs
from ..operators.rules import judge
from ..operators.stops import detect_stops
from ..sources.feed import with_fields
from ..sources.staging import Staging
from .demo_feed import SQL_FEED, feed_lines, gazetteer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with DuckDB SQL over the CTEs of SQL_FEED."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = SQL_FEED + sql
        return f

    return register


class Feed:
    """Every stage is written once for one call of a query and read from there; nothing is kept for the next query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.staging = Staging(spark, "feed")
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.staging.save(make(), name)
        return self._made[name]

    def lines(self) -> DataFrame:
        # a line's text is kept, and its fields are split from it wherever they are read
        return with_fields(self._once("lines", lambda: feed_lines(self.spark, self.sf_dir).drop("fields")))

    def records(self) -> DataFrame:
        return parse(self.lines())

    def judged(self) -> DataFrame:
        return self._once("judged", lambda: judge(self.records()))

    def runs(self, ship_type: str | None = None) -> tuple[IngestResult, IngestResult]:
        judged = self.judged()
        one = settle(judged.where("source_file = 'day1.csv'"), run_id=1, ship_type=ship_type)
        return one, settle(judged.where("source_file = 'day2.csv'"), one.positions, one.vessels, run_id=2, ship_type=ship_type)

    def log(self) -> DataFrame:
        """Positions of both runs. Judged rows that no other stage has asked for yet are not written; a query on vessels too asks for these first."""

        def make() -> DataFrame:
            judged = self.judged() if "judged" in self._made else judge(self.records())
            return settle_runs(judged, F.when(F.col("source_file") == "day1.csv", 1).otherwise(2))

        return self._once("log", make)

    def vessels(self) -> DataFrame:
        return self._once("vessels", lambda: self.runs()[1].vessels)

    def fixes(self) -> DataFrame:
        return annotate(self.log())[0]

    def stops(self) -> DataFrame:
        return self._once("stops", lambda: detect_stops(self.fixes()))

    def ports(self) -> DataFrame:
        return gazetteer(self.spark, self.sf_dir)

    def calls(self) -> tuple[DataFrame, DataFrame]:
        calls, phases = C.chain_port_calls(self.stops(), self.ports())
        return self._once("calls", lambda: calls), self._once("phases", lambda: phases)
