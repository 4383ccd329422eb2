"""A small file store as tables: inodes, directory entries, blocks. Every operation is a plan over them; nothing is mutated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 512
ROOT = 0
INODES = "ino bigint, kind string, mode int, size bigint, mtime bigint"
ENTRIES = "parent bigint, name string, ino bigint"
BLOCKS = "block bigint, ino bigint, place bigint"


def create(inodes: DataFrame, entries: DataFrame, files: DataFrame, mtime: int = 0) -> tuple[DataFrame, DataFrame]:
    """Append files (ino, parent, name, size): numbers are the caller's, so that many can be made at once."""
    new = files.select("ino", F.lit("file").alias("kind"), F.lit(0o644).alias("mode"), F.col("size").cast("long").alias("size"), F.lit(mtime).cast("long").alias("mtime"))
    return inodes.unionByName(new), entries.unionByName(files.select("parent", "name", "ino"))


def mkdir(inodes: DataFrame, entries: DataFrame, folders: DataFrame, mtime: int = 0) -> tuple[DataFrame, DataFrame]:
    new = folders.select("ino", F.lit("dir").alias("kind"), F.lit(0o755).alias("mode"), F.lit(0).cast("long").alias("size"), F.lit(mtime).cast("long").alias("mtime"))
    return inodes.unionByName(new), entries.unionByName(folders.select("parent", "name", "ino"))


def stat(inodes: DataFrame, ino: int) -> DataFrame:
    return inodes.filter(F.col("ino") == ino)


def readdir(entries: DataFrame, parent: int) -> DataFrame:
    return entries.filter(F.col("parent") == parent)


def lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(parent, name) to ino; the least where a name occurs twice."""
    return wanted.join(entries, ["parent", "name"]).groupBy("parent", "name").agg(F.min("ino").alias("ino"))


def allocated(inodes: DataFrame) -> DataFrame:
    """Blocks of files as (ino, n_blocks)."""
    return inodes.filter("kind = 'file'").select("ino", F.floor((F.col("size") + BLOCK_BYTES - 1) / BLOCK_BYTES).cast("long").alias("n_blocks"))


def first_free(blocks: DataFrame, total: int, spark: SparkSession) -> DataFrame:
    """The least block below ``total`` that no file holds (null: full)."""
    return spark.range(total).withColumnRenamed("id", "block").join(blocks.select("block"), "block", "left_anti").agg(F.min("block").alias("block"))


def free(blocks: DataFrame, ino: int) -> DataFrame:
    return blocks.filter(F.col("ino") != ino)


def route(sizes: DataFrame) -> DataFrame:
    """Add platter: structured (0) where the encoded form is below three quarters of the length, raw (1) otherwise."""
    return sizes.withColumn("platter", F.when(F.col("encoded") < F.floor(F.col("size") * 3 / 4), 0).otherwise(1).cast("int"))


def write_image(path: str, inodes: DataFrame, entries: DataFrame, data: DataFrame, blocks: DataFrame, mode: str = "errorifexists") -> None:
    """The store as five tables: inodes, entries, files in structured (0) and in raw form (1), and held blocks. ``data`` has a column platter."""
    parts = {"inodes": inodes, "entries": entries, "structured": data.filter("platter = 0").drop("platter"), "raw": data.filter("platter = 1").drop("platter"), "blocks": blocks}
    for name, table in parts.items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def read_image(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """inodes, entries, data (with platter) and blocks of an image."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    data = read("structured").withColumn("platter", F.lit(0)).unionByName(read("raw").withColumn("platter", F.lit(1)))
    return {"inodes": read("inodes"), "entries": read("entries"), "data": data, "blocks": read("blocks")}


def stats(routed: DataFrame) -> DataFrame:
    return routed.groupBy("platter").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"), F.sum(F.when(F.col("platter") == 0, F.col("encoded")).otherwise(F.col("size"))).cast("long").alias("stored"))
