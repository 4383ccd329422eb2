"""Tiered visibility of encodings: what structure a track has may be shown without its parameters.

Parameters and metadata are sealed per row with AES-GCM by built-in functions; whole structs are sealed, so no pattern loses
parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "struct<ints: array<bigint>, reals: array<double>>"
META = "struct<track: bigint, pattern: string>"


def _seal(value: Column, key: Column) -> Column:
    return F.aes_encrypt(F.to_json(value), key, F.lit("GCM"))


def _open(sealed: Column, key: Column, schema: str) -> Column:
    return F.from_json(F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string"), schema)


def seal_parameters(encodings: DataFrame, key: Column) -> DataFrame:
    """Structure in the open, parameters sealed."""
    return encodings.withColumn("sealed", _seal(F.struct("ints", "reals"), key)).drop("ints", "reals")


def open_parameters(sealed: DataFrame, key: Column) -> DataFrame:
    """The inverse; a wrong key gives nulls."""
    return sealed.withColumn("p", _open(F.col("sealed"), key, PAYLOAD)).select("*", "p.ints", "p.reals").drop("p", "sealed")


def seal_all(encodings: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """Metadata under the outer key, parameters under the inner one (the same key for both is the one-key form)."""
    keys = [c for c in encodings.columns if c not in ("track", "pattern", "ints", "reals")]
    return encodings.select(*keys, _seal(F.struct("track", "pattern"), outer).alias("sealed_meta"), _seal(F.struct("ints", "reals"), inner).alias("sealed"))


def structure_view(sealed: DataFrame, outer: Column) -> DataFrame:
    """What the outer key shows: tracks and patterns, no parameters."""
    keys = [c for c in sealed.columns if c not in ("sealed_meta", "sealed")]
    return sealed.select(*keys, _open(F.col("sealed_meta"), outer, META).alias("m")).select(*keys, "m.track", "m.pattern")


def open_all(sealed: DataFrame, outer: Column, inner: Column) -> DataFrame:
    keys = [c for c in sealed.columns if c not in ("sealed_meta", "sealed")]
    both = sealed.select(*keys, _open(F.col("sealed_meta"), outer, META).alias("m"), _open(F.col("sealed"), inner, PAYLOAD).alias("p"))
    return both.select(*keys, "m.track", "m.pattern", "p.ints", "p.reals")
