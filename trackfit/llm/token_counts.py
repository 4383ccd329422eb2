"""Token counts from the exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram then answer totals, quantiles and truncated
totals for every context limit, without another look at a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackfit.llm import tokens
from trackfit.llm.common import durable, table

#: Lengths are summed in blocks of so many values, so that no task orders all of a long histogram.
BLOCK = 1024


def lengths(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(length, n_docs): how many documents have each encoded length. Null and empty texts have length 0; repeated rows count
    each; texts of any length are encoded whole; an empty table gives an empty histogram. Other columns aren't read, whatever their names."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.fromiter((len(ids) for ids in tokens.encode_batch(path, batch.column(0))), np.int64, batch.num_rows)
            value, count = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int64))], ["length", "n"])

    return docs.select(text_col).mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per length that occurs, shortest first in meaning: with ``length`` as the context limit,

    docs_at_least and tokens_at_least sum documents of that length or more, docs_below and tokens_below the others;
    truncated_tokens is the total when every document is cut at the limit; docs_to_here / total_docs is its quantile.
    """
    h = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_block", F.expr(f"length div {BLOCK}"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.select("_block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("bd", "bt")), F.sum("bd").over(Window.partitionBy()).alias("total_docs"), F.sum("bt").over(Window.partitionBy()).alias("total_tokens"))
    inside = Window.partitionBy("_block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(after, "_block").select(
        "length", "n_docs", "n_tokens", "total_docs", "total_tokens",
        (F.sum("n_docs").over(inside) + F.col("bd_after")).alias("docs_at_least"),
        (F.sum("n_tokens").over(inside) + F.col("bt_after")).alias("tokens_at_least"),
    )
    return s.select(
        "*",
        (F.col("total_docs") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("total_tokens") - F.col("tokens_at_least")).alias("tokens_below"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_to_here"),
    )


def limits(sums: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers for any limits (column ``context``): docs_over, truncated_tokens and lost_tokens. ``asked`` is a short list."""
    total = sums.agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"))
    next_up = sums.join(F.broadcast(asked), F.col("length") > F.col("context")).groupBy("context").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length").alias("s"))
    row = asked.join(F.broadcast(next_up), "context", "left").join(F.broadcast(total))
    over, tokens_over = F.coalesce("s.docs_at_least", F.lit(0)), F.coalesce("s.tokens_at_least", F.lit(0))
    cut = F.coalesce(F.col("t"), F.lit(0)) - tokens_over + F.col("context") * over
    return row.select("context", over.alias("docs_over"), cut.alias("truncated_tokens"), (F.coalesce(F.col("t"), F.lit(0)) - cut).alias("lost_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least a share of the documents doesn't exceed, for each share."""
    asked = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return sums.join(F.broadcast(asked), F.col("docs_to_here") >= F.ceil(F.col("share") * F.col("total_docs"))).groupBy("share").agg(F.min("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(durable(lengths(table(spark, sf_dir, "documents")), "token-lengths"))
