"""Sinks and sources for encodings: a Parquet dataset, and a byte container for exchange.

The dataset keeps one row per track, partitioned by platter, with all keys in full width. The container is one binary value
per blob: magic, version, length, track length and entries of (track, tag, parameters) in little-endian order, deflated
where that is shorter; raw tracks may have been compressed one by one before. Version 2 is for blobs turned by a stride or cut to chunks: its head also has the stride, the chunk size
(0: none) and the number of chunks, and each chunk has a track length of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit.operators.detect import TAGS
from trackfit.operators.transforms import pack_bytes, unpack_bytes
from trackfit.plans.cascade import platter

MAGIC = b"TFIT"
SUFFIX = ".tfit"
_HEAD, _ENTRY = "<4sBQIQ", "<QBII"
_MORE, _CHUNK, _PACKED = "<IQQ", "<QIQ", "<BI"  # stride, chunk size, chunks; chunk, track length, entries; method, bytes


def write_encodings(encodings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Never removes the source; an existing target is an error unless the mode says otherwise."""
    encodings.withColumn("platter", platter(F.col("pattern"))).write.mode(mode).partitionBy("platter").parquet(path)


def read_encodings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("platter")


def stored_name(path: Column) -> Column:
    return F.concat(path, F.lit(SUFFIX))


def restored_name(path: Column) -> Column:
    """Without the suffix; an error where it is missing."""
    short = F.substr(path, F.lit(1), F.char_length(path) - len(SUFFIX))
    return F.when(path.endswith(SUFFIX), short).otherwise(F.raise_error(F.concat(path, F.lit(f" has no suffix {SUFFIX}"))))


def size_bound(length: Column) -> Column:
    """An upper bound for the container of a length, not turned and not cut to chunks: the raw bytes, the head, and an entry for each track of 8."""
    return length + struct.calcsize(_HEAD) + (F.floor((length + 7) / 8) + 1) * (struct.calcsize(_ENTRY) + 56)


Entry = tuple[int, str, list[int], list[float] | None]


def _entries(blob: list[Entry], raw: str = "none") -> list[bytes]:
    """With ``raw``, the values of raw tracks are compressed where that is shorter: flag 2, the method, its length and bytes."""
    out = []
    for track, pattern, ints, reals in blob:
        reals = [] if reals is None else list(reals)
        if pattern == "RAW" and raw != "none":
            method, packed = pack_bytes(bytes(ints), raw)
            out.append(struct.pack(_ENTRY, track, TAGS[pattern], len(ints), 0) + b"\2" + struct.pack(_PACKED, method, len(packed)) + packed)
            continue
        out.append(struct.pack(_ENTRY, track, TAGS[pattern], len(ints), len(reals)))
        small = all(0 <= x < 256 for x in ints)
        out.append(b"\1" + bytes(ints) if small else b"\0" + struct.pack(f"<{len(ints)}q", *ints))
        out.append(struct.pack(f"<{len(reals)}d", *reals))
    return out


def _deflated(out: list[bytes]) -> bytes:
    plain = b"".join(out)
    packed = zlib.compress(plain, 9)
    return b"Z" + packed if len(packed) < len(plain) else b"P" + plain


def pack(blob: list[Entry], length: int, s: int, raw: str = "none") -> bytes:
    return _deflated([struct.pack(_HEAD, MAGIC, 1, length, s, len(blob)), *_entries(blob, raw)])


def pack_parts(parts: list[tuple[int, int, list[Entry]]], length: int, stride: int, chunk: int, raw: str = "none") -> bytes:
    """A container of version 2; parts are (chunk_id, s, entries). The head's track length is 0 where there are more parts than one."""
    s = parts[0][1] if len(parts) == 1 else 0
    out = [struct.pack(_HEAD, MAGIC, 2, length, s, sum(len(e) for _, _, e in parts)), struct.pack(_MORE, stride, chunk, len(parts))]
    for chunk_id, s, entries in parts:
        out += [struct.pack(_CHUNK, chunk_id, s, len(entries)), *_entries(entries, raw)]
    return _deflated(out)


def _read_entries(plain: bytes, at: int, n: int) -> tuple[int, list[tuple[int, str, list[int], list[float]]]]:
    names, out = {v: k for k, v in TAGS.items()}, []
    for _ in range(n):
        track, tag, ni, nr = struct.unpack_from(_ENTRY, plain, at)
        at += struct.calcsize(_ENTRY)
        small = plain[at]
        at += 1
        if small == 2:
            method, size = struct.unpack_from(_PACKED, plain, at)
            at += struct.calcsize(_PACKED)
            out.append((track, names[tag], list(unpack_bytes(method, plain[at : at + size])), []))
            at += size
            continue
        ints = list(plain[at : at + ni]) if small else list(struct.unpack_from(f"<{ni}q", plain, at))
        at += ni if small else 8 * ni
        reals = list(struct.unpack_from(f"<{nr}d", plain, at))
        at += 8 * nr
        out.append((track, names[tag], ints, reals))
    return at, out


def unpack_parts(data: bytes) -> tuple[int, int, int, list[tuple[int, int, list[tuple[int, str, list[int], list[float]]]]]]:
    """(length, stride, chunk, [(chunk_id, s, entries)]) of either version; an error for anything that isn't a container."""
    plain = zlib.decompress(data[1:]) if data[:1] == b"Z" else data[1:]
    magic, version, length, s, n = struct.unpack_from(_HEAD, plain)
    if magic != MAGIC or version not in (1, 2):
        raise ValueError("not a track container")
    at = struct.calcsize(_HEAD)
    if version == 1:
        return length, 0, 0, [(0, s, _read_entries(plain, at, n)[1])]
    stride, chunk, count = struct.unpack_from(_MORE, plain, at)
    at, parts = at + struct.calcsize(_MORE), []
    for _ in range(count):
        chunk_id, s, n = struct.unpack_from(_CHUNK, plain, at)
        at, entries = _read_entries(plain, at + struct.calcsize(_CHUNK), n)
        parts.append((chunk_id, s, entries))
    return length, stride, chunk, parts


def unpack(data: bytes) -> tuple[int, int, list[tuple[int, str, list[int], list[float]]]]:
    """(length, s, entries) of a container that is neither turned nor cut to chunks."""
    length, stride, chunk, parts = unpack_parts(data)
    if stride or chunk:
        raise ValueError("a container with a stride or chunks")
    return length, *parts[0][1:]


def to_containers(encodings: DataFrame, lengths: DataFrame, raw: str = "none") -> DataFrame:
    """(blob, content) of encodings (blob, s, track, pattern, ints, reals); one container holds one blob, as a file does.

    With stride, chunk and chunk_id too (those of ``api.fit_as``) the container tells how to undo them. ``raw`` is the fallback for raw
    tracks: none, zlib, zstd or best."""
    entry = F.sort_array(F.collect_list(F.struct("track", "pattern", "ints", "reals"))).alias("e")
    if "chunk_id" in encodings.columns:
        parts = encodings.groupBy("blob", "stride", "chunk", "chunk_id", "s").agg(entry)
        rows = parts.groupBy("blob", "stride", "chunk").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "s", "e"))).alias("parts")).join(lengths, "blob")
    else:
        one = F.array(F.struct(F.lit(0).alias("chunk_id"), "s", "e")).alias("parts")
        rows = encodings.groupBy("blob", "s").agg(entry).select("blob", F.lit(0).alias("stride"), F.lit(0).alias("chunk"), one).join(lengths, "blob")

    def content(parts: list, length: int, stride: int, chunk: int) -> bytes:
        plain = [(int(p["chunk_id"]), int(p["s"]), [(r["track"], r["pattern"], list(r["ints"]), r["reals"]) for r in p["e"]]) for p in parts]
        return pack_parts(plain, length, stride, chunk, raw) if stride or chunk else pack(plain[0][2], length, plain[0][1], raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"blob": pdf.blob, "content": [content(p, int(n), int(t), int(c)) for p, n, t, c in zip(pdf.parts, pdf.length, pdf.stride, pdf.chunk)]})

    return rows.select("blob", "parts", "length", "stride", "chunk").mapInPandas(run, "blob string, content binary")


def from_containers(containers: DataFrame) -> DataFrame:
    """(blob, length, stride, chunk, chunk_id, s, track, pattern, ints, reals)."""
    names = ["blob", "length", "stride", "chunk", "chunk_id", "s", "track", "pattern", "ints", "reals"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob, content in zip(pdf.blob, pdf.content):
                length, stride, chunk, parts = unpack_parts(bytes(content))
                for chunk_id, s, entries in parts:
                    yield pd.DataFrame([(blob, length, stride, chunk, chunk_id, s, *e) for e in entries], columns=names)

    return containers.mapInPandas(run, "blob string, length long, stride int, chunk long, chunk_id long, s int, track long, pattern string, ints array<bigint>, reals array<double>")


def container_heads(containers: DataFrame) -> DataFrame:
    """(blob, length, s, entries) without reading entries; s is 0 where chunks have their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = []
            for blob, content in zip(pdf.blob, pdf.content):
                data = bytes(content)
                plain = zlib.decompressobj().decompress(data[1:], 64) if data[:1] == b"Z" else data[1:]
                _, _, length, s, n = struct.unpack_from(_HEAD, plain)
                heads.append((blob, length, s, n))
            yield pd.DataFrame(heads, columns=["blob", "length", "s", "entries"])

    return containers.mapInPandas(run, "blob string, length long, s int, entries long")
