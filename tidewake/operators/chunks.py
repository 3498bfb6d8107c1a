"""Flags and stops of tracks that are too long for one task.

A track is cut into chunks of consecutive fixes. What a chunk does to the state that a scan carries (the fix before, the
segment, whether the vessel rests, counts within the segment) is summed up in a few rows; a prefix scan over these rows
gives every chunk the state at its start, and chunks are then scanned side by side. No window over fixes is wider than a chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import elapsed_s, haversine_nm
from ..sources.staging import Staging
from .annotate import ORDER, annotate, flag_both
from .rules import PairRule, pair_rules, position_unreliable, with_distance
from .stops import detect_stops, finish_stops, stop_figures
from .thresholds import Thresholds

#: Fixes of a vessel that one task scans.
CHUNK_ROWS = 2_000_000
#: Seconds of a track that are never cut.
BUCKET_S = 600
_KEY = ["mmsi", "chunk"]
#: What the pair rules and gaps ask of the fix before.
PREV = ["ts_utc", "lat", "lon", "sog_kn"]


def _within_chunk():
    return Window.partitionBy(*_KEY).orderBy(*ORDER)


def chunk_tracks(fixes: DataFrame, rows: int = CHUNK_ROWS, bucket_s: int = BUCKET_S) -> DataFrame:
    """Adds chunk: consecutive stretches of a vessel's fixes, in order of time, of `rows` fixes at most and what one bucket of time holds beyond. Vessels of fewer fixes have chunk 0 alone."""
    bucket = F.floor(F.unix_seconds("ts_utc") / bucket_s)
    w = Window.partitionBy("mmsi").orderBy("_bucket")
    counts = fixes.groupBy("mmsi", bucket.alias("_bucket")).agg(F.count("*").alias("n"))
    cuts = counts.withColumn("chunk", F.expr(f"(sum(n) OVER (PARTITION BY mmsi ORDER BY _bucket ROWS UNBOUNDED PRECEDING) - n) div {int(rows)}"))
    # where a cut has moved a bucket; all others stay in chunk 0
    moved = cuts.where("chunk > 0").select("mmsi", "_bucket", "chunk")
    return fixes.withColumn("_bucket", bucket).join(moved, ["mmsi", "_bucket"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0))).drop("_bucket")


def annotate_chunks(fixes: DataFrame, rules: list[PairRule] | None = None, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """annotate() over chunks: a pair across a boundary is judged on the ends of the chunks alone.

    before: (mmsi, prev) of vessels whose tracks go on from a fix that is not in `fixes`, as a struct ts_utc, lat, lon, sog_kn.
    """
    rules = rules if rules is not None else pair_rules()
    here = F.struct(*PREV)
    fired = F.array_compact(F.array(*[F.when(F.col("prev").isNotNull() & r.fires(), F.lit(r.id)) for r in rules]))
    at, v = F.struct(*ORDER), Window.partitionBy("mmsi").orderBy("chunk")
    ends = fixes.groupBy(*_KEY).agg(F.min_by(F.struct(*[c for c in fixes.columns if c not in _KEY]), at).alias("first"), F.max_by(here, at).alias("last"))
    ends = ends.withColumn("prev", F.lag("last").over(v))
    if before is not None:
        ends = ends.join(before.select("mmsi", F.col("prev").alias("_held")), "mmsi", "left").withColumn("prev", F.coalesce("prev", "_held"))
    ends = with_distance(ends.select(*_KEY, "prev", "first.*")).select(*_KEY, F.col("prev").alias("_before"), fired.alias("first_hits"))
    ends = ends.withColumn("_next_hits", F.lead("first_hits").over(v)).drop("first_hits")
    w = _within_chunk()
    df = fixes.join(ends, _KEY)
    df = with_distance(df.withColumn("prev", F.coalesce(F.lag(here).over(w), F.col("_before")))).withColumn("pair_hits", fired).drop("prev", "dt_s", "nm", "_before")
    df = df.withColumn("_after", F.coalesce(F.lead("pair_hits").over(w), "_next_hits", F.array().cast("array<string>"))).drop("_next_hits")
    return flag_both(df, F.col("_after"), rules)


def mark_stops_chunks(fixes: DataFrame, th: Thresholds = Thresholds(), before: DataFrame | None = None, *, keep: bool = False) -> DataFrame:
    """mark_stops() over chunks.

    A piece is what a gap-free stretch and a chunk have in common. Over the pieces of a vessel, in order, a segment begins
    where one starts after a gap, and within the segment the last signal, the leaves and the known speeds of the pieces
    before are carried in. A vessel has as many pieces as chunks and gaps, and a gap takes time, so they stay few.

    before: (mmsi, prev, seg, n, known, leaves, signal) of vessels whose tracks go on: the fix before and the state of its
    segment up to it, a piece like others. keep: the columns of the state stay, as _nth, _known, _leaves and _signal
    (each with the fix itself), _signal_before.
    """
    w = _within_chunk()
    signal = F.when(F.col("sog_kn") < th.enter_stop_kn, 1).when(F.col("sog_kn") >= th.leave_stop_kn, 0)
    df = fixes.withColumn("_signal", signal).withColumn("_gap", (elapsed_s(F.lag("ts_utc").over(w), F.col("ts_utc")) > th.coverage_gap_s).cast("int"))
    df = df.withColumn("piece", F.coalesce(F.sum("_gap").over(w), F.lit(0))).drop("_gap")
    pieces = df.groupBy(*_KEY, "piece").agg(
        F.count("*").alias("n"), F.count("sog_kn").alias("known"), F.count_if(F.col("_signal") == 0).alias("leaves"), F.max_by("_signal", F.when(F.col("_signal").isNotNull(), F.struct(*ORDER))).alias("signal"), F.min("ts_utc").alias("begin"), F.max("ts_utc").alias("end"),
    )
    if before is not None:
        held = before.select("mmsi", F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("piece"), "n", "known", "leaves", "signal", F.lit(None).cast("timestamp").alias("begin"), F.col("prev.ts_utc").alias("end"), "seg")
        pieces = pieces.withColumn("seg", F.lit(0).cast("long")).unionByName(held)
    else:
        pieces = pieces.withColumn("seg", F.lit(0).cast("long"))
    v = Window.partitionBy("mmsi").orderBy("chunk", "piece")
    parted = F.coalesce(elapsed_s(F.lag("end").over(v), F.col("begin")) > th.coverage_gap_s, F.lit(False)).cast("int")
    pieces = pieces.withColumn("_parted", parted).withColumn("seg", F.sum(F.col("_parted") + F.col("seg")).over(v))
    whole = Window.partitionBy("mmsi", "seg")
    past = whole.orderBy("chunk", "piece").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c)
    carried = pieces.select(*_KEY, "piece", "seg", so_far("n"), so_far("known"), so_far("leaves"), F.last("signal", ignorenulls=True).over(past).alias("signal"), F.sum("leaves").over(whole).alias("all_leaves"))
    fields = ["piece", "seg", "n", "known", "leaves", "signal", "all_leaves"]
    carried = carried.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_pieces"))
    # pieces of a chunk are numbered from 0
    df = df.join(carried, _KEY).withColumn("_in", F.get("_pieces", F.col("piece"))).drop("_pieces")
    s = Window.partitionBy(*_KEY, "piece").orderBy(*ORDER)
    df = df.withColumn("_rests", F.coalesce(F.last("_signal", ignorenulls=True).over(s), F.col("_in.signal"), F.lit(0)) == 1)
    df = df.withColumn("_leaves", F.sum(F.when(F.col("_signal") == 0, 1).otherwise(0)).over(s) + F.col("_in.leaves"))
    df = df.withColumn("_nth", F.row_number().over(s) + F.col("_in.n")).withColumn("_known", F.count("sog_kn").over(s) + F.col("_in.known"))
    df = df.withColumn("seg", F.col("_in.seg")).withColumn("closed", F.col("_in.all_leaves") > F.col("_leaves"))
    edge = F.when(F.col("seg") == 0, F.col("_nth") == 1).otherwise(F.col("sog_kn").isNotNull() & (F.col("_known") == 1))
    df = df.withColumn("edge", edge).withColumn("stop_no", F.when(F.col("_rests"), F.col("_leaves")))
    if keep:
        return df.withColumn("_signal_before", F.coalesce(F.last("_signal", ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1)), F.col("_in.signal"))).drop("_in", "_rests", "piece")
    return df.drop("_signal", "_in", "_rests", "_leaves", "_nth", "_known", "piece")


def detect_stops_chunks(fixes: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """detect_stops() over chunks: a stop's figures are sums and extremes of its chunks' parts; its centroid goes back to every chunk that it spans for the drift."""
    return stops_of_marks(mark_stops_chunks(fixes, th), th)


def stops_of_marks(marked: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    df = marked.where("stop_no IS NOT NULL").withColumn("reliable", ~position_unreliable())
    stop = ["mmsi", "seg", "stop_no"]
    where = [F.avg(F.when(F.col("reliable"), F.col(c))).alias(f"_{c}") for c in ("lat", "lon")]
    figures = df.groupBy(*stop).agg(*where, *stop_figures())
    claims = df.groupBy(*stop, "nav_status").agg(F.count("*").alias("n"))
    said = F.col("nav_status").isNotNull() & (F.col("nav_status") != "")
    claims = claims.groupBy(*stop).agg(F.min_by("nav_status", F.when(said, F.struct((-F.col("n")).alias("n"), "nav_status"))).alias("reported_status"))
    spans = df.groupBy(*stop, "chunk").agg(F.count("*").alias("n")).select(*stop, "chunk").join(figures.select(*stop, F.col("_lat").alias("centroid_lat"), F.col("_lon").alias("centroid_lon")), stop)
    reliable = df.where("reliable").select(*stop, "chunk", "lat", "lon")
    drift = reliable.join(spans, [*stop, "chunk"]).groupBy(*stop).agg(F.max(haversine_nm("centroid_lat", "centroid_lon", "lat", "lon")).alias("max_drift_nm"))
    stops = figures.withColumnsRenamed({"_lat": "centroid_lat", "_lon": "centroid_lon"}).join(claims, stop).join(drift, stop, "left")
    return finish_stops(stops, th)


def annotate_and_detect(log: DataFrame, th: Thresholds = Thresholds(), rules: list[PairRule] | None = None, *, chunk_rows: int = CHUNK_ROWS, bucket_s: int = BUCKET_S, staging: Staging | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flagged fixes, hits by rule, stops). Vessels of more than chunk_rows fixes are scanned in chunks, all others by one window each.

    With a staging, chunked, flagged and marked fixes are written once each; every step reads the one before it several
    times, so without one their work is multiplied along the way.
    """
    once = staging.save if staging is not None else lambda df, _: df
    hot = log.groupBy("mmsi").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).select("mmsi")
    if hot.isEmpty():
        fixes, hits = annotate(log, rules)
        return fixes, hits, detect_stops(fixes, th)
    cold, hits = annotate(log.join(hot, "mmsi", "left_anti"), rules)
    wide, more = annotate_chunks(once(chunk_tracks(log.join(hot, "mmsi", "left_semi"), chunk_rows, bucket_s), "chunked"), rules)
    wide = once(wide, "flagged")
    marked = once(mark_stops_chunks(wide, th), "marked")
    hits = hits.unionByName(more).groupBy("rule_id").agg(F.sum("hits").alias("hits"))
    return cold.unionByName(wide.drop("chunk")), hits, detect_stops(cold, th).unionByName(stops_of_marks(marked, th))
