"""Geometry and layout: tracks, chunks and the columnar transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Track lengths that the search tries. Each divides the block.
CANDIDATES = [8, 16, 32, 64, 128, 256, 512]
BLOCK = 512
CHUNK_GATE, GATED_CHUNK = 1 << 20, 1 << 16


def track_count(length: Column, s: Column | int) -> Column:
    """Tracks of a geometry: the length over s, rounded up; none for an empty signal."""
    s = F.lit(s) if isinstance(s, int) else s
    return F.floor((length + s - 1) / s).cast("long")


def blocks(signal: DataFrame, block: int = BLOCK) -> DataFrame:
    """(blob, blk, a): long-form signal gathered into arrays of a block, in one shuffle keyed by blob and block."""
    grouped = signal.groupBy("blob", F.floor(F.col("pos") / block).cast("long").alias("blk")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("cells"))
    return grouped.select("blob", "blk", F.transform("cells", lambda c: c["v"]).alias("a"))


def tracks_of_blocks(blocked: DataFrame, sizes: list[int] = CANDIDATES, block: int = BLOCK) -> DataFrame:
    """(blob, s, track, v) for every size, zero-padded at the end of the signal. No track crosses a block, so nothing is shuffled."""
    return cut(blocked.withColumn("s", F.explode(F.array(*[F.lit(s) for s in sizes]))), block)


def cut(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """(blob, s, track, v) of blocks with a column s that divides the block."""
    place = "transform(sequence(0, (size(a) + s - 1) div s - 1), k -> struct(k, slice(a, cast(k * s + 1 as int), s) as v))"
    rows = sized.filter(F.size("a") > 0).select("blob", "blk", "s", F.explode(F.expr(place)).alias("c"))
    padded = F.expr("concat(c.v, array_repeat(0, s - size(c.v)))")
    return rows.select("blob", "s", (F.col("blk") * (F.lit(block) / F.col("s")).cast("long") + F.col("c.k")).alias("track"), padded.alias("v"))


def lay_out(signal: DataFrame, s: int) -> DataFrame:
    """(blob, s, track, v) of a long-form signal."""
    block = max(BLOCK, s)
    return tracks_of_blocks(blocks(signal, block // s * s), [s], block // s * s)


def lay_out_arrays(arrays: DataFrame, sizes: list[int]) -> DataFrame:
    """(blob, s, track, v) of signals that are arrays already: narrow."""
    return tracks_of_blocks(arrays.select("blob", F.lit(0).cast("long").alias("blk"), "a"), sizes)


def polar(tracks: Column, sector: Column, s: Column | int) -> tuple[Column, Column]:
    """(r, theta) of a value: its track and its sector's share of a turn."""
    return tracks.cast("double"), 2 * F.lit(3.141592653589793) * sector / (F.lit(s) if isinstance(s, int) else s)


def columnar(signal: DataFrame, record: int, length: Column) -> DataFrame:
    """Records of ``record`` bytes turned to columns: only positions change, so there is no shuffle. The last record is taken as full."""
    rows = F.floor((length + record - 1) / record).cast("long")
    return signal.withColumn("pos", F.pmod("pos", F.lit(record)) * rows + F.floor(F.col("pos") / record).cast("long"))


def padded_length(length: Column, record: Column) -> Column:
    """The length with the last record full."""
    return (F.floor((length + record - 1) / record) * record).cast("long")


def padding(sized: DataFrame, record: Column) -> DataFrame:
    """``sized`` (keys and length) with pos and v: the zeros that fill the last record."""
    end = padded_length(F.col("length"), record)
    return sized.filter(end > F.col("length")).withColumn("pos", F.explode(F.sequence(F.col("length").cast("long"), end - 1))).withColumn("v", F.lit(0))


def uncolumnar(signal: DataFrame, record: int | Column, length: Column) -> DataFrame:
    """The inverse of ``columnar``; what padding added is cut off."""
    rows = F.floor((length + record - 1) / record).cast("long")
    back = F.pmod(F.col("pos"), rows) * record + F.floor(F.col("pos") / rows).cast("long")
    return signal.withColumn("pos", back).filter(F.col("pos") < length)


def chunk_size(length: Column) -> Column:
    """The chunk for a length: all of it up to 32 KiB, else the least power of two from 4 KiB to 1 MiB that makes 64 chunks at most."""
    size = F.when(length <= 32 * 1024, length)
    for k in range(12, 20):
        size = size.when(length <= 64 << k, F.lit(1 << k))
    return size.otherwise(F.lit(1 << 20)).cast("long")


def gated_chunk(length: Column) -> Column:
    """64 KiB for signals over 1 MiB, else one chunk."""
    return F.when(length > CHUNK_GATE, F.lit(GATED_CHUNK)).otherwise(length).cast("long")


def sections(signal: DataFrame, named: DataFrame) -> DataFrame:
    """The named sections (section, start, length) of each signal as signals of their own: (blob, section, pos, v). Sections may
    overlap; values that are in none are left out. ``named`` is a short table."""
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("length"))
    return signal.join(named, inside).select("blob", "section", (F.col("pos") - F.col("start")).alias("pos"), "v")


def chunked(signal: DataFrame, size: Column | int) -> DataFrame:
    """Independent chunks: the chunk joins the blob's key and positions start anew."""
    size = F.lit(size) if isinstance(size, int) else size
    return signal.withColumn("chunk_id", F.floor(F.col("pos") / size).cast("long")).withColumn("pos", F.pmod(F.col("pos"), size))
