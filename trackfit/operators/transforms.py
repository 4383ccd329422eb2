"""Byte transforms of long-form signals and the raw fallback compressors."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GATE_KINDS = 150
# Methods of the raw fallback.
METHODS = {"none": 0, "deflate": 1, "zstd": 2}


def byte_delta(arrays: DataFrame) -> DataFrame:
    """(blob, a) with each value replaced by its difference to the one before, modulo 256. Narrow."""
    return arrays.withColumn("a", F.expr("transform(a, (x, i) -> if(i = 0, x, cast(pmod(x - a[i - 1], 256) as int)))"))


def byte_undelta(arrays: DataFrame) -> DataFrame:
    """The inverse: running sums modulo 256, in Arrow batches."""
    at = arrays.columns.index("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.cumsum(x.as_py() or []) % 256).astype(np.int32) for x in batch.column(at)]
            yield batch.set_column(at, "a", pa.array(out, pa.list_(pa.int32())))

    return arrays.mapInArrow(run, arrays.schema)


def delta_of_signal(signal: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Long-form byte delta. Blocks are ordered each for itself; the value before a block's first comes from the block before."""
    s = signal.withColumn("blk", F.floor(F.col("pos") / block))
    last = s.groupBy("blob", "blk").agg(F.max_by("v", "pos").alias("before")).withColumn("blk", F.col("blk") + 1)
    inside = Window.partitionBy("blob", "blk").orderBy("pos")
    return s.join(last, ["blob", "blk"], "left").select("blob", "pos", F.pmod(F.col("v") - F.coalesce(F.lag("v").over(inside), "before", F.lit(0)), F.lit(256)).cast("int").alias("v"))


def bwt(rows: DataFrame) -> DataFrame:
    """(blob, text) to (blob, bwt): last characters of the sorted rotations, with NUL as the sentinel. Short texts only: a
    text's rotations are one array."""
    whole = rows.select("blob", F.concat("text", F.lit("\0")).alias("w"))
    turns = F.expr("array_sort(transform(sequence(1, length(w)), k -> concat(substring(w, k, length(w)), substring(w, 1, k - 1))))")
    return whole.select("blob", F.array_join(F.transform(turns, lambda t: F.substring(t, -1, 1)), "").alias("bwt"))


def unbwt(rows: DataFrame) -> DataFrame:
    """(blob, bwt) back to (blob, text): follows each character to its place in the sorted first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_invert(x.as_py()) for x in batch.column(1)], pa.string())], ["blob", "text"])

    return rows.select("blob", "bwt").mapInArrow(run, T.StructType([rows.schema["blob"], T.StructField("text", T.StringType())]))


def _invert(last: str) -> str:
    """Text of a transform that ends with the NUL sentinel."""
    order = sorted(range(len(last)), key=lambda i: (last[i], i))  # row of the sorted rotations -> row it moves to
    at, out = last.index("\0"), []
    for _ in range(len(last) - 1):
        at = order[at]
        out.append(last[at])
    return "".join(out)


def _deflate(b: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(b) + c.flush()


def pack_bytes(b: bytes, raw: str = "best") -> tuple[int, bytes]:
    """(method, bytes): the fallback of one raw track. ``raw`` is none, zlib, zstd or best; bytes of 150 kinds and more are deflated
    only, and what gets no shorter stays as it is."""
    import zstandard

    tries = []
    if raw in ("zlib", "best") or (raw == "zstd" and len(set(b)) >= GATE_KINDS):
        tries.append((METHODS["deflate"], _deflate(b)))
    if raw in ("zstd", "best") and len(set(b)) < GATE_KINDS:
        tries.append((METHODS["zstd"], zstandard.ZstdCompressor(level=19).compress(b)))
    method, packed = min(tries, key=lambda x: (len(x[1]), x[0]), default=(METHODS["none"], b))
    return (method, packed) if len(packed) < len(b) else (METHODS["none"], b)


def unpack_bytes(method: int, packed: bytes) -> bytes:
    import zstandard

    if method == METHODS["deflate"]:
        return zlib.decompress(packed, -15)
    return zstandard.ZstdDecompressor().decompress(packed) if method == METHODS["zstd"] else packed


def pack_raw(encodings: DataFrame, raw: str = "best") -> DataFrame:
    """``encodings`` with method and packed: the values of raw tracks go from ints to bytes, compressed where that is shorter.
    Other tracks pass untouched, with both null."""
    names = ["pattern", "ints"]
    place = [encodings.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, ints = (batch.column(p).to_pylist() for p in place)
            found = [pack_bytes(bytes(v), raw) if k == "RAW" else (None, None) for k, v in zip(pattern, ints)]
            left = pa.array([None if k == "RAW" else v for k, v in zip(pattern, ints)], pa.list_(pa.int64()))
            out = batch.set_column(place[1], "ints", left)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([m for m, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], [*out.schema.names, "method", "packed"])

    return encodings.mapInArrow(run, T.StructType([*encodings.schema.fields, T.StructField("method", T.IntegerType()), T.StructField("packed", T.BinaryType())]))


def unpack_raw(encodings: DataFrame) -> DataFrame:
    """The inverse of ``pack_raw``."""
    kept = [c for c in encodings.columns if c not in ("method", "packed")]
    place = {c: encodings.columns.index(c) for c in (*kept, "method", "packed")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            method, packed, ints = (batch.column(place[c]).to_pylist() for c in ("method", "packed", "ints"))
            back = pa.array([v if m is None else list(unpack_bytes(m, b)) for m, b, v in zip(method, packed, ints)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([back if c == "ints" else batch.column(place[c]) for c in kept], kept)

    return encodings.mapInArrow(run, T.StructType([encodings.schema[c] for c in kept]))


def compressed_sizes(rows: DataFrame, binary: str = "content") -> DataFrame:
    """Add raw_bytes, kinds, deflate_bytes, zstd_bytes, bz2_bytes, lzma_bytes, zlib_bytes, in Arrow batches. Brotli isn't available here."""
    import zstandard

    place = rows.columns.index(binary)
    names = ["raw_bytes", "kinds", "deflate_bytes", "zstd_bytes", "bz2_bytes", "lzma_bytes", "zlib_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=19)
        for batch in batches:
            got = []
            for x in batch.column(place):
                b = x.as_py() or b""
                got.append((len(b), len(set(b)), len(_deflate(b)), len(z.compress(b)), len(bz2.compress(b)), len(lzma.compress(b)), len(zlib.compress(b, 9))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, np.array(got, np.int64).reshape(-1, len(names)).T)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def best_fallback(sized: DataFrame) -> DataFrame:
    """Add method and packed_bytes: deflate alone from 150 kinds of bytes on, else the least of deflate and zstd (deflate on a
    tie); none unless it is shorter than the raw bytes."""
    best = F.when((F.col("kinds") >= GATE_KINDS) | (F.col("deflate_bytes") <= F.col("zstd_bytes")), F.struct(F.col("deflate_bytes").alias("b"), F.lit("deflate").alias("m")))
    best = best.otherwise(F.struct(F.col("zstd_bytes").alias("b"), F.lit("zstd").alias("m")))
    s = sized.withColumn("_b", best)
    shorter = F.col("_b.b") < F.col("raw_bytes")
    return s.withColumns({"method": F.when(shorter, F.col("_b.m")).otherwise("none"), "packed_bytes": F.when(shorter, F.col("_b.b")).otherwise(F.col("raw_bytes"))}).drop("_b")


def comparators(sized: DataFrame, ours: str) -> DataFrame:
    """(…, winner, ratio): the shortest of ours and the common compressors."""
    options = F.array(*[F.struct(F.col(c).alias("b"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, c) in enumerate((("tracks", ours), ("zlib", "zlib_bytes"), ("bz2", "bz2_bytes"), ("lzma", "lzma_bytes")))])
    return sized.withColumn("_w", F.array_min(options)).withColumns({"winner": F.col("_w.n"), "ratio": F.col("raw_bytes") / F.col(ours)}).drop("_w")
