"""What a query reads several times is written once."""

from __future__ import annotations

from tidewake.plans import queries as Q


def test_entries_and_records_are_made_once(spark):
    for query in (Q.cited_text, Q.leaderboards):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "quality_flags" not in plan, query.__name__
