"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose value is above a cutoff. In each stratum (language), labelled good documents are the
holdout of each rule: from the mildest cutoff on, a sharper one is taken as long as the exact binomial test rejects
that it turns away more than the rule's share of good documents. Cutoffs of one rule are tested in a fixed order and stop
at the first that fails, which needs no correction within the rule; strata times rules are corrected by Bonferroni. With
probability 1 - DELTA no stratum then loses more than ALPHA of its good documents to all rules together. A stratum with
too few labels certifies no cutoff and the rule rejects nothing there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfit.llm.common import bounded, durable, table

#: Most of a stratum's good documents that the rules may reject together, and the chance that this fails anywhere.
ALPHA, DELTA = 0.05, 0.05
#: Cutoffs of the rules, mildest first: fixed grids that no data moves.
_RATIOS = [round(0.9 * 0.86**k, 6) for k in range(40)]
RULES: dict[str, list[float]] = {
    "symbol_ratio": _RATIOS,
    "dup_line_ratio": _RATIOS,
    "repeat_ratio": _RATIOS,
    "upper_ratio": _RATIOS,
    "exclaim_ratio": _RATIOS,
    "mean_word_chars": [round(40 * 0.95**k, 6) for k in range(40)],
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
UNKNOWN = "und"
SPACES = " \t\n\v\f\r"


def features(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaim of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at the six ASCII spaces only
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) < len(grams):
        count = Counter(grams)
        covered = -1  # last word counted so far
        for i, g in enumerate(grams):
            if count[g] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    n_symbols = sum(map(text.count, "#*$%&|<>"))
    n_upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), n_upper, text.count("!")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim"]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts of ``features`` and the values of the rules. A null text has no words."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([features(t.as_py() or "") for t in batch.column(place)], np.int64).reshape(-1, len(NAMES)).T
            rest = [i for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *map(pa.array, counts)], [*(batch.schema.names[i] for i in rest), *NAMES])

    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text_col), *(T.StructField(n, T.LongType()) for n in NAMES)])
    one = F.lit(1)
    values = {
        "symbol_ratio": F.col("n_symbols") / F.greatest("word_chars", one), "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", one),
        "repeat_ratio": F.col("n_repeat_words") / F.greatest("n_words", one), "upper_ratio": F.col("n_upper") / F.greatest("word_chars", one),
        "exclaim_ratio": F.col("n_exclaim") / F.greatest("word_chars", one), "mean_word_chars": F.col("word_chars") / F.greatest("n_words", one),
    }
    return docs.mapInArrow(run, schema).withColumns(values)


def below(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial with n trials of chance p, exactly."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def sharpest(above: list[int], n: int, cutoffs: list[float], alpha: float, delta: float) -> float | None:
    """The last cutoff, in order, up to which each test of 'rejects more than alpha' is itself rejected at level delta."""
    found = None
    for cutoff, k in zip(cutoffs, above):
        if k > alpha * n or below(k, n, alpha) > delta:
            break
        found = cutoff
    return found


def fit(measured: DataFrame, labels: DataFrame, stratum: Column, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs: stratum, n_good and a double for each rule (null: none certified). All labelled good rows count; null ids and labels don't."""
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_label_id"))
    rows = measured.withColumn("_stratum", stratum).join(good, F.col(id_col) == F.col("_label_id"))
    names = list(RULES)
    # How many cutoffs a value is above; cutoffs fall, so it is above the last ones.
    bins = [F.expr(f"size(filter(array({', '.join(f'{c}D' for c in RULES[r])}), c -> {r} > c))") for r in names]
    long = rows.select("_stratum", F.explode(F.create_map(*[x for r, b in zip(names, bins) for x in (F.lit(r), b)])).alias("rule", "bin"))
    counts = durable(long.groupBy("_stratum", "rule", "bin").agg(F.count(F.lit(1)).alias("n")), "quality-counts")
    tests = max(1, counts.select("_stratum").distinct().count() * len(names))

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, object] = {"stratum": key[0], "n_good": 0}
        for r in names:
            mine = pdf[pdf.rule == r]
            by_bin = np.bincount(mine.bin, weights=mine.n, minlength=len(RULES[r]) + 1).astype(int)
            n = int(by_bin.sum())
            # Above cutoff k (0 the mildest) are the values that are above at least len - k cutoffs.
            above = np.cumsum(by_bin[::-1])[: len(RULES[r])].tolist()
            found["n_good"] = n
            found[r] = sharpest(above, n, RULES[r], alpha / len(names), delta / tests)
        return pd.DataFrame([found])

    # At most one count for each rule and bin in a group: a bounded size.
    return counts.groupBy("_stratum").applyInPandas(choose, "stratum string, n_good long, " + ", ".join(f"{r} double" for r in names))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """Add base_failed and kept. A stratum without cutoffs keeps all that pass the base rules."""
    chosen = cutoffs.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    over = [F.coalesce(F.col(r) > F.col(f"_cut_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    joined = measured.withColumn("_stratum", stratum).join(chosen, F.col("_stratum") == F.col("_s"), "left")
    return joined.withColumns({"base_failed": base, "kept": ~base & ~rejected}).drop("_s", "_stratum", *[f"_cut_{r}" for r in RULES])


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: id_col, stratum_col, the counts, the values of the rules, base_failed and kept.

    A null stratum is one of its own. Documents with null ids are judged but hold no label; repeated ids are judged each
    for itself and each counts as labelled. Empty tables give an empty result.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(UNKNOWN))
    measured = durable(measure(docs.select(id_col, stratum_col, text_col), text_col), "quality-features")
    cutoffs = durable(fit(measured, labels, stratum, id_col), "quality-cutoffs")
    return judge(measured, bounded(cutoffs, 10_000), stratum)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
