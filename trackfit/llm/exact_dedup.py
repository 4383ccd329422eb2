"""Exact duplicates by progressive refinement: byte length, then a hash of the prefix, then a hash of the whole text.

Only documents that still share (length, prefix hash) with another one have their whole text hashed, unless the digests of
all are asked for. Grouping always aggregates partially before it shuffles, and no shuffle carries text unless the groups
that survive the prefix outgrow the broadcast bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit.llm.common import LOWER, RID, UPPER, bounded, durable, keyed, lower_ascii, table

#: Characters of the prefix that the second level hashes.
PREFIX = 256
#: Groups of equal texts that may be broadcast: rows with a digest, 100,000 of them about 15 MB.
GROUPS = 100_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid: str | None = None, digest_col: str | None = None) -> DataFrame:
    """One row per input row: RID, id_col, keep_id, group_size, kept, and with ``digest_col`` the SHA-256 of every lower-cased
    text by that name (else only texts that survive the first two levels are hashed as a whole).

    Texts are equal when identical after lower-casing A-Z; a null text equals the empty text. The row with the largest
    id stays; a null id counts as smallest, and of rows with the same id and text the last one numbered stays. An
    empty table gives an empty result. Texts of any length are read whole. Extra columns of ``docs`` are not read. ``rid`` names a column of row keys that
    ``docs`` holds already; else a row's key is its place in its file, or rows that are in no file are written once.
    """
    rows = keyed(docs, {"_id": F.col(id_col), "_text": F.coalesce(F.col(text_col), F.lit(""))}, "dedup-rows", rid).select(
        RID, "_id", F.octet_length("_text").alias("_len"), F.xxhash64(lower_ascii(F.substring("_text", 1, PREFIX))).alias("_prefix"), "_text"
    )
    # Joins take stored tables, so that none shares a stage with an aggregate: what is too large to broadcast can be split.
    lengths = durable(rows.groupBy("_len").count().filter("count > 1").select("_len"), "dedup-length")
    crowded = rows.select("_len", "_prefix").join(bounded(lengths), "_len", "left_semi").groupBy("_len", "_prefix").count().filter("count > 1")
    crowded = durable(crowded.drop("count"), "dedup-prefix", done=[lengths])
    digest = F.sha2(lower_ascii(F.col("_text")), 256).alias("_full")
    if digest_col:  # asked for all rows, so each text is hashed once and the rest is done without texts
        rows = durable(rows.select(RID, "_id", "_len", "_prefix", digest), "dedup-digests")
        digest = F.col("_full")
    full = rows.join(bounded(crowded), ["_len", "_prefix"], "left_semi").select(RID, "_id", "_len", digest)
    full = durable(full, "dedup-full", done=[crowded])
    groups = durable(full.groupBy("_len", "_full").agg(F.max(F.struct("_id", RID)).alias("_top"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    same = full.join(bounded(groups, GROUPS), ["_len", "_full"]).select(RID, F.col("_top._id").alias("keep_id"), "group_size", (F.col(RID) == F.col(f"_top.{RID}")).alias("kept"))
    same = durable(same, "dedup-same", done=[full, groups])
    # Rows that are alone by length and prefix are in no group.
    found = rows.select(RID, "_id", *(["_full"] if digest_col else [])).join(bounded(same.withColumn("_many", F.lit(True))), RID, "left")
    return found.select(
        RID, F.col("_id").alias(id_col), F.when(F.col("_many"), F.col("keep_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"), *([F.col("_full").alias(digest_col)] if digest_col else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
