"""A second pass over raw tracks: put one after the other, they are cut anew at short lengths, and kept so where that is smaller.

The first pass keeps its track numbers; the second one's tracks are those of a signal of their own, whose k-th piece of s
values is the k-th track that the first pass lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackfit.operators import groups, layout, rebuild
from trackfit.plans.cascade import ENTRY_BYTES, classify

# Track lengths of the second pass.
SIZES = [8, 16, 32, 64]
LEAST_TRACKS = 2
#: Tracks are ranked in groups of so many numbers, so that no task orders all of a signal.
GROUP = 4096


def ranked(tracks: DataFrame) -> DataFrame:
    """``tracks`` (blob, s, track, ...) with place: how many of them are before it in its signal."""
    t = tracks.withColumn("_group", F.floor(F.col("track") / GROUP))
    counts = t.groupBy("blob", "s", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("blob", "s").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("blob", "s", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("blob", "s", "_group").orderBy("track")) - 1
    return t.withColumn("_row", inside).join(offsets, ["blob", "s", "_group"]).withColumn("place", (F.col("_before") + F.col("_row")).cast("long")).drop("_group", "_before", "_row")


def recut(encodings: DataFrame) -> DataFrame:
    """Encodings of the second pass, at each of its lengths: blob is (blob, s), the signal and the track length of the first pass."""
    raw = ranked(encodings.filter("pattern = 'RAW'").select("blob", "s", "track", "ints"))
    at = F.floor(F.col("place") * F.col("s") / layout.BLOCK).cast("long")
    blocked = raw.groupBy("blob", "s", at.alias("blk")).agg(F.sort_array(F.collect_list(F.struct("place", "ints"))).alias("c"))
    values = F.transform(F.flatten(F.transform("c", lambda c: c["ints"])), lambda x: x.cast("int"))
    return classify(layout.tracks_of_blocks(blocked.select(F.struct("blob", "s").alias("blob"), "blk", values.alias("a")), SIZES))


def choose(encodings: DataFrame, again: DataFrame) -> DataFrame:
    """(blob, s, raw_tracks, size_before, sub_s, size_after) of the signals whose raw tracks, two at least, are smaller by the second pass
    ``again``: one that finds some structure, the least size, the shorter length on a tie."""
    raw = encodings.filter("pattern = 'RAW'").groupBy("blob", "s").agg(F.count(F.lit(1)).alias("raw_tracks")).filter(F.col("raw_tracks") >= LEAST_TRACKS)
    size = F.coalesce(F.col("meta_size") + ENTRY_BYTES, F.col("payload") + ENTRY_BYTES * F.col("n"))
    sized = groups.pattern_stats(again).groupBy("blob", F.col("s").alias("sub_s")).agg(F.sum(size).cast("long").alias("size_after"), F.max(F.col("pattern") != "RAW").alias("structured"))
    j = sized.filter("structured").select("blob.blob", "blob.s", "sub_s", "size_after").join(raw, ["blob", "s"]).withColumn("size_before", F.col("raw_tracks") * (ENTRY_BYTES + F.col("s")))
    smaller = j.filter("size_after < size_before and (sub_s < s or sub_s < raw_tracks * s)")
    best = smaller.groupBy("blob", "s", "raw_tracks", "size_before").agg(F.min(F.struct("size_after", "sub_s")).alias("b"))
    return best.select("blob", "s", "raw_tracks", "size_before", "b.sub_s", "b.size_after")


def second_pass(encodings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, second): the encodings that stay, and those (blob, s, sub_s, track, ...) that stand for the raw tracks taken out."""
    again = recut(encodings)
    chosen = choose(encodings, again)
    gone = encodings.filter("pattern = 'RAW'").join(chosen.select("blob", "s"), ["blob", "s"], "left_semi").select("blob", "s", "track")
    first = encodings.join(gone, ["blob", "s", "track"], "left_anti")
    flat = again.select("blob.blob", "blob.s", F.col("s").alias("sub_s"), *[c for c in again.columns if c not in ("blob", "s")])
    return first, flat.join(chosen.select("blob", "s", "sub_s"), ["blob", "s", "sub_s"], "left_semi")


def undo(first: DataFrame, second: DataFrame, n_tracks: DataFrame) -> DataFrame:
    """The encodings before ``second_pass``, but for cost. ``n_tracks`` has (blob, s, n_tracks) of every signal."""
    gone = ranked(rebuild.missing_tracks(first, n_tracks, ["blob", "s"]))
    short = second.select(F.col("blob").alias("of"), F.col("s").alias("of_s"), F.col("sub_s").alias("s"), "track", "pattern", "ints", "reals")
    cells = rebuild.rebuild(short).select("of", "of_s", F.col("track").alias("t"), "s", F.posexplode("v").alias("i", "v")).withColumn("pos", F.col("t") * F.col("s") + F.col("i"))
    place = F.floor(F.col("pos") / F.col("of_s")).cast("long")
    back = cells.groupBy(F.col("of").alias("blob"), F.col("of_s").alias("s"), place.alias("place")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("c"))
    raw = back.select("blob", "s", "place", F.transform("c", lambda c: c["v"].cast("long")).alias("ints"))
    none = F.lit(None).cast("array<double>")
    found = gone.join(raw, ["blob", "s", "place"]).select("blob", "s", "track", F.lit("RAW").alias("pattern"), "ints", none.alias("reals"))
    return first.select("blob", "s", "track", "pattern", "ints", "reals").unionByName(found)
