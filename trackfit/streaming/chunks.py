"""Tracks of an unbounded stream: an extension, not an operator of the surveyed engine, whose streaming means fixed chunks.

A track is complete when all its values have come, or when the watermark passes it: then it is padded as a signal's last
track is. Classification itself is stateless and narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfit.plans.cascade import classify


def stream_tracks(events: DataFrame, blob: Column, pos: Column, value: Column, ts: str, s: int, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(blob, s, track, v) from events with a time: grouped by track within a window of event time, so that state is dropped
    behind the watermark. Positions that never came count as 0."""
    cells = events.withWatermark(ts, late).select(blob.alias("blob"), pos.cast("long").alias("pos"), F.pmod(value.cast("long"), F.lit(256)).cast("int").alias("v"), ts)
    grouped = cells.groupBy("blob", F.window(ts, window).alias("w"), F.floor(F.col("pos") / s).cast("long").alias("track")).agg(F.collect_list(F.struct(F.pmod("pos", F.lit(s)).cast("int").alias("i"), "v")).alias("c"))
    placed = F.expr(f"transform(sequence(0, {s} - 1), k -> coalesce(get(filter(c, x -> x.i = k), 0).v, 0))")
    return grouped.select("blob", F.lit(s).alias("s"), "track", placed.alias("v"))


def stream_encodings(events: DataFrame, blob: Column, pos: Column, value: Column, ts: str, s: int, **times: str) -> DataFrame:
    """Encodings of a stream's tracks as they close."""
    return classify(stream_tracks(events, blob, pos, value, ts, s, **times))
