"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfit.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), both longs; root is the least node that can be reached.

    Each round hangs neighbours below the least one they know, first for larger, then for smaller neighbours; the rounds
    end when no edge changes. No table of a round has more than two rows for each edge, which says in how many files it comes. Minima aggregate partially and are stored before edges join them, so a hub with very many
    neighbours isn't gathered anywhere: the join reads two plain shuffles, and a hot side of one can be split.
    """
    now = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not mark["n"] or mark == before:
            break
        before = mark
        most = 2 * mark["n"]
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars", rows=most)
        large = durable(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges", done=[least], rows=most)
        # small star: every u now points to smaller nodes only
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), "stars", rows=most)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = durable(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct(), "edges", done=[now, large, low], rows=most)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
