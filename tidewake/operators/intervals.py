"""Intervals laid out by length and start, so that what overlaps a window is found without reading or meeting the rest.

An interval of class c spans fewer than 2^c days beyond its first, and lies in the block of 2^c days that it starts in. What
overlaps a window of that class starts in the window's blocks or in the one before them, so a class has few blocks to look at
however long other intervals are. An interval without an end is in a class of its own that every window looks at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest class with an end, of about 90 years, and the class without one.
LAST_CLASS, NO_END = 15, 99
LAYOUT = ["length_class", "start_block"]


def _day(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 86400)


def laid_out(df: DataFrame, start: str, end: str) -> DataFrame:
    """Adds length_class and start_block. Ends before their starts count as starts."""
    first = _day(F.col(start))
    span = F.greatest(_day(F.col(end)) - first, F.lit(0))
    c = F.when(F.col(end).isNull(), NO_END).when(span == 0, 0).otherwise(F.least(F.length(F.bin(span)), F.lit(LAST_CLASS)))
    df = df.withColumn("length_class", c.cast("int"))
    block = F.when(F.col("length_class") == NO_END, 0).otherwise(F.floor(first / F.pow(F.lit(2), F.col("length_class"))))
    return df.withColumn("start_block", block.cast("bigint"))


def write_intervals(df: DataFrame, path: str, start: str, end: str) -> None:
    laid_out(df, start, end).repartition(*LAYOUT).sortWithinPartitions(start).write.mode("overwrite").partitionBy(*LAYOUT).parquet(path)


def _blocks(from_day, to_day, c: int):
    width = 1 << c
    return (from_day - width + 1) // width, to_day // width


def read_window(spark: SparkSession, path: str, start: str, end: str, from_: str, to: str, *, far_edge: bool = False) -> DataFrame:
    """Intervals that start before `to` and end after `from_` (or at it, with far_edge); only folders that can hold such are opened. from_ and to: timestamps in UTC as text."""
    lo, hi = (F.lit(t).cast("timestamp") for t in (from_, to))
    days = spark.range(1).select(_day(lo).alias("f"), _day(hi).alias("t")).first()
    near = F.col("length_class") == NO_END
    for c in range(LAST_CLASS + 1):
        first, last = _blocks(days["f"], days["t"], c)
        near = near | ((F.col("length_class") == c) & F.col("start_block").between(first, last))
    ends = F.col(end) >= lo if far_edge else F.col(end) > lo
    return spark.read.parquet(path).where(near & (F.col(start) < hi) & (F.col(end).isNull() | ends)).drop(*LAYOUT)


def _looks(blocks: Column, c: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(c).alias("length_class"), b.cast("bigint").alias("start_block")))


def meet(windows: DataFrame, intervals: DataFrame, keys: list[str], window: tuple[str, str], interval: tuple[str, str]) -> DataFrame:
    """Pairs of a window and an interval of equal keys that may overlap: an equi join on the keys, class and block, where every pair meets once.

    A window has a row for each block that it looks at, which is its days and a few more. Exact bounds are the caller's filter.
    """
    at = laid_out(intervals, *interval)
    classes = [r[0] for r in at.select("length_class").distinct().collect()]  # sixteen at most, and one without an end
    f, t = _day(F.col(window[0])), _day(F.col(window[1]))
    looks = []
    for c in sorted(classes):
        if c == NO_END:
            looks.append(F.array(F.struct(F.lit(NO_END).alias("length_class"), F.lit(0).cast("bigint").alias("start_block"))))
        else:
            width = F.lit(1 << c)
            blocks = F.sequence(F.floor((f - width + 1) / width), F.floor(t / width))
            looks.append(_looks(blocks, c))
    if not looks:
        looks = [F.array().cast("array<struct<length_class: int, start_block: bigint>>")]
    asked = windows.where(F.col(window[0]) <= F.col(window[1])).select("*", F.inline(F.concat(*looks)))
    return asked.join(at, [*keys, *LAYOUT]).drop(*LAYOUT)
