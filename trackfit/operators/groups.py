"""Cross-track groups: tracks of one pattern whose parameters follow a common rule are stored once.

A pattern of a signal is one group or none. Counts, minima and maxima decide; only parameters that could be an arithmetic
sequence of byte values are looked at in order, so no group of unbounded size is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 4
MOST_IN_SEQUENCE = 256
SAME_KINDS = ("REPEAT", "LINEAR_WIDE", "LINEAR_F64")
KEYS = ["blob", "s", "pattern"]


def pattern_stats(encodings: DataFrame) -> DataFrame:
    """(blob, s, pattern, n, payload, kind, params, meta_size): each pattern of a signal, and the group it forms (kind null: none).

    One pass over the encodings. They are counted by parameters first, which combines before the shuffle; bytes have at
    most 256 CONST and 65,536 LINEAR parameters, so only those counts are gathered to be put in order.
    """
    return stats_of_kinds(count_kinds(encodings))


def count_kinds(encodings: DataFrame) -> DataFrame:
    """(blob, s, pattern, ints, reals, n, payload, single, track): tracks counted by parameters, those of patterns that form no groups together."""
    grouped = F.col("pattern").isin("CONST", "LINEAR", *SAME_KINDS)
    none = F.expr("cast(array() as array<double>)")
    return encodings.groupBy(
        *KEYS, F.when(grouped, F.col("ints")).alias("ints"), F.when(grouped, F.coalesce("reals", none)).alias("reals")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("payload"), F.max("cost").alias("single"), F.min("track").alias("track"))


def stats_of_kinds(kinds: DataFrame) -> DataFrame:
    """``pattern_stats`` from the counts of ``count_kinds``."""
    value = F.struct("ints", "reals")
    ordered = F.when(F.col("pattern").isin("CONST", "LINEAR"), F.struct("track", F.expr("ints[0]").alias("x"), F.expr("get(ints, 1)").alias("step")))
    stats = kinds.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("payload").cast("long").alias("payload"), F.max("single").alias("single"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.max("n").alias("most"), F.sort_array(F.collect_list(ordered)).alias("g"),
    )
    n, const, linear = F.col("n"), F.col("pattern") == "CONST", F.col("pattern") == "LINEAR"
    grouped = F.col("pattern").isin("CONST", "LINEAR", *SAME_KINDS)
    worth = F.when(const, 4 * n > 7 + 2 * n).when(linear, 10 + 2 * n < 7 * n).otherwise(6 + 2 * n + F.col("single") < n * (3 + F.col("single")))
    all_same = grouped & (n >= LEAST) & (F.col("low") == F.col("high")) & worth
    # Starts are bytes and differ in a sequence: each parameter once, 256 tracks at most.
    even = F.expr("forall(sequence(1, size(g) - 1), k -> g[k].x - g[k - 1].x = g[1].x - g[0].x and g[k].step <=> g[0].step)")
    step = F.expr("g[1].x - g[0].x")
    fits = F.when(const, step.between(-128, 127) & (8 + 2 * n < 4 * n)).otherwise(12 + 2 * n < 7 * n)
    in_order = (const | linear) & (n >= LEAST) & (n <= MOST_IN_SEQUENCE) & (F.col("most") == 1) & (F.col("low") != F.col("high"))
    in_order = F.when(in_order, even & fits).otherwise(False)
    kind = F.when(all_same, "AllSame").when(in_order, F.when(const, "ConstLinear").otherwise("LinearStartsLinear"))
    stats = stats.withColumn("kind", kind)
    is_ = lambda k: F.col("kind") == k
    params = F.when(is_("AllSame"), F.col("low.ints")).when(is_("ConstLinear"), F.array(F.expr("g[0].x"), step)).when(is_("LinearStartsLinear"), F.array(F.expr("g[0].x"), step, F.expr("g[0].step")))
    size = F.when(is_("AllSame"), 5 + 2 * n + F.col("single")).when(is_("ConstLinear"), 5 + 2 * n + 2).when(is_("LinearStartsLinear"), 5 + 2 * n + 6)
    return stats.select(*KEYS, "n", "payload", "kind", params.alias("params"), size.cast("long").alias("meta_size"))


def meta_groups(encodings: DataFrame) -> DataFrame:
    """(blob, s, pattern, kind, n, params, meta_size): one row per group.

    ``params`` are those of the rule: AllSame the common parameters, ConstLinear [start, step], LinearStartsLinear [start,
    step of starts, step]. ``meta_size`` is the estimate 4 + 2n + 1 + p.
    """
    return pattern_stats(encodings).filter(F.col("kind").isNotNull()).drop("payload")


def remaining(encodings: DataFrame, groups: DataFrame) -> DataFrame:
    """Encodings that no group holds."""
    return encodings.join(groups.select(*KEYS), KEYS, "left_anti")


def expand(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Encodings of grouped tracks from the rules of their groups. ``members`` has KEYS, track and place: the rank in the group from 0."""
    j = members.join(groups, KEYS)
    ints = (
        F.when(F.col("kind") == "AllSame", F.col("params")).when(F.col("kind") == "ConstLinear", F.array(F.expr("params[0] + place * params[1]")))
        .otherwise(F.array(F.expr("params[0] + place * params[1]"), F.expr("params[2]")))
    )
    return j.select(*KEYS, "track", ints.alias("ints"))
