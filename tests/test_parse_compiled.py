"""The record of a line is made by compiled code, once."""

from __future__ import annotations

import re

from tests.test_parse_plan import lines
from tidewake.operators.ingest import parse
from tidewake.plans.demo_feed import feed_lines

#: Bytes of a method that the JIT still compiles.
JIT_LIMIT = 8000


def stages(spark, df):
    """(largest method's bytes, operators) of each stage of generated code."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [(found.apply(i)._3().maxMethodCodeSize(), found.apply(i)._1()) for i in range(found.size())]


def test_records_are_compiled(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        found = stages(spark, parse(lines(spark)))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert max(size for size, _ in found) < JIT_LIMIT
    # both parts of the record lie in stages of generated code
    assert len({n for _, plan in found for n in re.findall(r"\*\(\d+\) Generate inline\((_part#\d+)\)", plan)}) == 2


def test_records_are_made_once(spark):
    plan = parse(lines(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "lambda" not in plan.split("Generate", 1)[1].split("\n")[0]


def test_derived_lines_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whose plans have no code before they run
    try:
        found = stages(spark, feed_lines(spark, "/root/testdata/sf0.001").drop("fields"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(size for size, _ in found) < JIT_LIMIT
    assert sum(plan.count("Generate inline(_part") for _, plan in found) >= 3
