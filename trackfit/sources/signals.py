"""Signals: ordered integer sequences, from table columns, texts or binary files.

A signal is (blob, pos, v) in long form, or (blob, a) with all values of a blob in one array. Arrays suit blobs that fit a
row; long signals are dealt by (blob, pos div block), never by blob alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_column(df: DataFrame, pos: Column, value: Column, blob: Column | None = None) -> DataFrame:
    """Long-form signal; ``value`` is taken modulo 256."""
    return df.select((blob if blob is not None else F.lit("signal")).alias("blob"), pos.cast("long").alias("pos"), F.pmod(value.cast("long"), F.lit(256)).cast("int").alias("v"))


def byte_values(binary: Column) -> Column:
    """The bytes of a binary column as an array of integers, with built-in functions: Latin-1 maps each byte to one character."""
    return F.transform(F.regexp_extract_all(F.decode(binary, "ISO-8859-1"), F.lit("(?s)."), F.lit(0)), F.ascii)


def from_text(df: DataFrame, blob: Column, text: Column) -> DataFrame:
    """(blob, a): the UTF-8 bytes of whole texts; a null text is an empty signal."""
    return df.select(blob.alias("blob"), byte_values(F.coalesce(text, F.lit("")).cast("binary")).alias("a"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(blob, a): the bytes of files under ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("blob"), byte_values(F.col("content")).alias("a"))
