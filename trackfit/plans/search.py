"""Searches by estimated size: track length, record stride, chunk size, mode."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfit.operators import groups, layout
from trackfit.plans import variants
from trackfit.plans.cascade import ENTRY_BYTES, classify

STRIDE_SAMPLE, STRIDE_MOST, STRIDE_SCORE, STRIDE_KEEP = 4096, 1024, 0.4, 8
# Strides that are always tried.
STRIDE_ALWAYS = [4, 8, 12, 16, 20, 24, 32, 48, 64, 128, 256, 512]
CHUNKS = [4096, 8192, 16384, 32768, 65536]
#: Patterns whose parameters the encrypted form can store; others count as raw there.
SEALED = ("CONST", "LINEAR", "RLE", "REPEAT", "DELTA", "LINEAR_WIDE", "LINEAR_F64", "DELTA_F64", "RAW")


def sizes(encodings: DataFrame) -> DataFrame:
    """(blob, s, est_size): entries that stand alone, plus groups."""
    return sizes_of_stats(groups.pattern_stats(encodings))


def sizes_of_stats(p: DataFrame) -> DataFrame:
    """``sizes`` from ``groups.pattern_stats``."""
    size = F.coalesce(F.col("meta_size") + ENTRY_BYTES, F.col("payload") + ENTRY_BYTES * F.col("n"))
    return p.groupBy("blob", "s").agg(F.sum(size).cast("long").alias("est_size"))


def best_geometry(sized: DataFrame) -> DataFrame:
    """(blob, s, est_size) of the least size, the shorter track on a tie."""
    return sized.groupBy("blob").agg(F.min(F.struct("est_size", "s")).alias("b")).select("blob", "b.s", "b.est_size")


def sealed_sizes(encodings: DataFrame) -> DataFrame:
    """(blob, s, est_size) by payload only: the estimate of the encrypted form, without entries or groups."""
    cost = F.when(F.col("pattern").isin(*SEALED), F.col("cost")).otherwise(F.col("s"))
    return encodings.groupBy("blob", "s").agg(F.sum(cost).cast("long").alias("est_size"))


def search_geometry(signal: DataFrame, candidates: list[int] | None = None) -> DataFrame:
    """The best track length of each signal. Blocks are dealt once; all lengths are cut from them without another shuffle."""
    tracks = layout.tracks_of_blocks(layout.blocks(signal), candidates or layout.CANDIDATES)
    return best_geometry(sizes(classify(tracks)))


def encode_best(signal: DataFrame) -> DataFrame:
    """Encodings of each signal at its best track length: all lengths are tried, then only the best is cut and kept."""
    blocked = layout.blocks(signal)
    best = best_geometry(sizes(classify(layout.tracks_of_blocks(blocked)))).select("blob", "s")
    return classify(layout.cut(blocked.join(best, "blob")))


def stride_scores(signal: DataFrame, lengths: DataFrame) -> DataFrame:
    """(blob, stride, score, matches): how often a value equals the one a stride later, over the first values of a signal.

    ``lengths`` has (blob, length). The sample is the feature: at most 4,096 values of a signal are compared, as one array.
    """
    sample = signal.filter(F.col("pos") < STRIDE_SAMPLE).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("c")).select("blob", F.transform("c", lambda c: c["v"]).alias("a"))
    at = sample.join(lengths, "blob").select("blob", "a", F.size("a").alias("m"), F.least(F.lit(STRIDE_MOST), F.floor(F.col("length") / 4)).cast("int").alias("top"))
    each = at.filter("top >= 2").select("blob", "a", "m", F.explode(F.sequence(F.lit(2), F.col("top"))).alias("stride")).filter("stride < m")
    same = F.expr("size(filter(zip_with(slice(a, 1, m - stride), slice(a, stride + 1, m - stride), (x, y) -> x = y), z -> z))")
    return each.select("blob", "stride", same.cast("long").alias("matches"), (F.col("m") - F.col("stride")).cast("long").alias("pairs")).withColumn("score", F.col("matches") / F.col("pairs"))


def stride_candidates(scores: DataFrame, lengths: DataFrame) -> DataFrame:
    """(blob, stride): the eight best scores above 0.4, then the strides that are always tried."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("blob").orderBy(F.desc("score"), "stride"))
    good = scores.filter(F.col("score") > STRIDE_SCORE).withColumn("k", rank).filter(F.col("k") <= STRIDE_KEEP).select("blob", "stride")
    fixed = lengths.select("blob", F.least(F.lit(STRIDE_MOST), F.floor(F.col("length") / 4)).alias("top"), F.explode(F.array(*map(F.lit, STRIDE_ALWAYS))).alias("stride")).filter(F.col("stride") < F.col("top"))
    return good.union(fixed.select("blob", "stride")).distinct()


def strides_of(first: np.ndarray, length: int) -> list[int]:
    """The strides of ``stride_candidates`` from a signal's first values (at most 4,096) and its length."""
    a, m, top = first.astype(np.uint8) if len(first) and 0 <= first.min() and first.max() < 256 else first, len(first), min(STRIDE_MOST, length // 4)
    scored = [(int(np.count_nonzero(a[:-k] == a[k:])) / (m - k), k) for k in range(2, min(top, m - 1) + 1)]
    good = sorted((-score, k) for score, k in scored if score > STRIDE_SCORE)[:STRIDE_KEEP]
    return list(dict.fromkeys([*(k for _, k in good), *(k for k in STRIDE_ALWAYS if k < top)]))


def _plans(segs: DataFrame, chunks: list[int]) -> DataFrame:
    """(blob, length, dense, least, strides, chunks): all settings of a signal, in one row."""
    found = variants.with_strides(variants.heads(segs), strides_of)
    return found.withColumn("chunks", F.filter(F.array(*[F.lit(c) for c in chunks]).cast("array<int>"), lambda c: c < F.col("length")))


def settings(signal: DataFrame, chunks: list[int] | None = None) -> DataFrame:
    """(blob, length, mode, setting): plain, the strides of ``stride_candidates`` and the chunk sizes below the length, of each signal.

    One pass: a signal's count and its first values are one row, and the strides are found within the row."""
    every = "concat(array(struct('plain' as mode, 0 as setting)), transform(strides, k -> struct('stride' as mode, k as setting)), transform(chunks, k -> struct('chunk' as mode, k as setting)))"
    return _plans(variants.segments(signal, STRIDE_SAMPLE), chunks or CHUNKS).selectExpr("blob", "length", f"inline({every})")


def _sized(segs: DataFrame, plans: DataFrame) -> DataFrame:
    """(blob, mode, setting, est_size): each segment is dealt to all its settings in one shuffle and measured there. A stride has 10 bytes of header more."""
    kinds = variants.measured(variants.deal(segs, plans)).groupBy(*groups.KEYS, "ints", "reals").agg(
        F.sum("n").alias("n"), F.sum("payload").alias("payload"), F.max("single").alias("single"), F.min("track").alias("track")
    )
    best = best_geometry(sizes_of_stats(groups.stats_of_kinds(kinds)))
    header = F.when(F.col("blob.mode") == "stride", 10).otherwise(0)
    return best.select("blob.blob", "blob.mode", "blob.setting", (F.col("est_size") + header).cast("long").alias("est_size"))


def all_modes(signal: DataFrame) -> DataFrame:
    """(blob, mode, setting, est_size) for all ``settings`` of each signal, which is read once."""
    segs = variants.segments(signal, STRIDE_SAMPLE)
    return _sized(segs, _plans(segs, CHUNKS))


def modes(signal: DataFrame, lengths: DataFrame, strides: DataFrame, chunks: list[int] | None = None) -> DataFrame:
    """``all_modes`` for the strides and chunk sizes given."""
    chunks = chunks or CHUNKS
    shared, odd = [c for c in chunks if variants.shares_tracks(c)], [c for c in chunks if not variants.shares_tracks(c)]
    segs = variants.segments(signal, STRIDE_SAMPLE)
    some = strides.groupBy("blob").agg(F.collect_set(F.col("stride").cast("int")).alias("strides"))
    below = F.filter(F.array(*[F.lit(c) for c in shared]).cast("array<int>"), lambda c: c < F.col("length"))
    plans = variants.heads(segs).drop("head").join(some, "blob", "left").withColumn("strides", F.coalesce("strides", F.expr("cast(array() as array<int>)"))).withColumn("chunks", below)
    found = _sized(segs, plans)
    if not odd:
        return found
    # Chunks of other sizes have tracks of their own.
    by_chunk = lengths.select("blob", "length", F.lit("chunk").alias("mode"), F.explode(F.array(*map(F.lit, odd))).alias("setting")).filter("setting < length")
    return found.unionByName(modes_of(signal, by_chunk))


def modes_of(signal: DataFrame, chosen: DataFrame) -> DataFrame:
    """(blob, mode, setting, est_size) for each of the settings (blob, length, mode, setting): plain, strides (10 bytes of header
    more, the last record filled with zeros) and chunks of any size. Each variant is written out value by value: ``all_modes`` is for long signals."""
    fill = layout.padding(chosen.filter("mode = 'stride'"), F.col("setting"))
    every = signal.join(chosen, "blob").select("blob", "length", "mode", "setting", "pos", "v").unionByName(fill.select("blob", "length", "mode", "setting", "pos", "v"))
    turned = "pos % setting * ((length + setting - 1) div setting) + pos div setting"
    one = every.select(
        F.expr("struct(blob, mode, setting, if(mode = 'chunk', pos div setting, 0L) as chunk_id)").alias("blob"),
        F.expr(f"cast(case mode when 'stride' then {turned} when 'chunk' then pos % setting else pos end as bigint)").alias("pos"), "v",
    )
    best = search_geometry(one)
    header = F.when(F.col("blob.mode") == "stride", 10).otherwise(0)
    return best.select("blob.blob", "blob.mode", "blob.setting", (F.col("est_size") + header).alias("est_size")).groupBy("blob", "mode", "setting").agg(F.sum("est_size").cast("long").alias("est_size"))


def best_mode(candidates: DataFrame) -> DataFrame:
    """The least size; plain before strides before chunks on a tie, then the smaller setting."""
    order = F.when(F.col("mode") == "plain", 0).when(F.col("mode") == "stride", 1).otherwise(2)
    return candidates.groupBy("blob").agg(F.min(F.struct("est_size", order.alias("o"), "setting", "mode")).alias("b")).select("blob", "b.mode", "b.setting", "b.est_size")
