"""Laytime by prefix sums against a plain loop over merged exceptions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from tidewake.operators.laytime import TERMS, calculate

T0 = datetime(2024, 1, 1)


def plain(allowed, once, rate, commenced, completed, exceptions):
    """(used, excepted, owed) in seconds and minor units, one exception after another."""
    merged: list[list] = []
    for f, t in sorted((max(f, commenced), min(t, completed)) for f, t in exceptions):
        if t <= f:
            continue
        if merged and f <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], t)
        else:
            merged.append([f, t])
    counted = excepted = 0
    cursor = commenced
    for f, t in merged:
        counted += f - cursor
        if once and counted >= allowed:
            counted += t - f
        else:
            excepted += t - f
        cursor = t
    counted += completed - cursor
    late = max(0, counted - allowed)
    return counted, excepted, int((Decimal(rate) * late / 86400).quantize(Decimal(1), ROUND_HALF_UP))


def test_random_statements(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    at = lambda s: T0 + timedelta(seconds=s)
    for i in range(400):
        notice, berthed = rng.randint(0, 5) * 3600, rng.randint(0, 10) * 3600
        completed = berthed + rng.randint(1, 60) * 1800
        rule = rng.choice(["TurnTimeAfterNotice", "OnBerthing", "TurnTimeOrBerthingWhicheverFirst"])
        turned = notice + 3600
        commenced = {"TurnTimeAfterNotice": turned, "OnBerthing": berthed}.get(rule, min(turned, berthed))
        ex = [(a, a + rng.randint(1, 8) * 900) for a in (rng.randint(0, 90) * 900 for _ in range(rng.randint(0, 5)))]
        allowed, once, rate = rng.randint(0, 30) * 1800, rng.random() < 0.5, rng.randint(1, 3_000_000)
        rows.append((i, allowed / 3600, rate, "USD", at(notice), False, rule, 1.0, [(at(a), at(b), rng.choice(["rain", "shore"])) for a, b in ex], once, at(berthed), at(completed)))
        expected[i] = None if completed < commenced else plain(allowed, once, rate, commenced, completed, ex)
    df = spark.createDataFrame(rows, f"id int, {TERMS}, berthed_utc timestamp, completed_utc timestamp")
    statements, lines, errors = calculate(df, ["id"])
    got = {r["id"]: (round(r["used_hours"] * 3600), round(r["excepted_hours"] * 3600), r["owed_minor"]) for r in statements.collect()}
    assert all(r["balanced"] for r in statements.collect())
    assert got == {k: v for k, v in expected.items() if v is not None}
    assert {r["id"] for r in errors.collect()} == {k for k, v in expected.items() if v is None}
    kinds = {r["kind"] for r in lines.collect()}
    assert kinds == {"BeforeCommencement", "Counted", "OnDemurrage", "Excepted"}


def test_reasons_join(spark):
    at = lambda h: T0 + timedelta(hours=h)
    row = (1, 1.0, 100, "USD", at(0), False, "OnBerthing", 0.0, [(at(2), at(4), "rain"), (at(3), at(5), "shore"), (at(5), at(6), "shore")], False, at(0), at(10))
    _, lines, _ = calculate(spark.createDataFrame([row], f"id int, {TERMS}, berthed_utc timestamp, completed_utc timestamp"), ["id"])
    assert [r["reason"] for r in lines.where("kind = 'Excepted'").collect()] == ["rain; shore; shore"]
