"""The corpus pipeline: five stages over ``documents``, each one operator of ``trackfit.llm`` with its decisions in effect.

Language ID drops documents without a language, exact dedup and SimHash near-dedup keep one document of each group, the
suffix stage takes repeated passages out of the texts, and packing deals what is left to sequences. Each stage's result
is written as Parquet in the shared folder and read back as the next one's documents; all but the last return the
columns of ``documents``, whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit.llm import exact_dedup, language, packing, simhash, suffix_dedup
from trackfit.llm.common import RID, durable, table, without, wrapped
from trackfit.session import ready

#: Bytes of a string that the suffix stage takes out where it occurs again: about 50 words, at four bytes a word with its space.
PASSAGE_BYTES = 200


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents for which no language is found: null texts and texts without a letter. Where no row teaches a language the same ones go."""
    label, score = (c + "_" * (1 + max(map(len, docs.columns))) for c in ("pred", "score"))  # longer than any name there
    langs, prototypes = language.fit_documents(docs)
    if not langs:  # nothing to tell languages by, so every text with a letter gets the same one
        langs, prototypes = ["any"], np.zeros((1, language.DIMENSIONS), np.float32)
    found = language.identify(docs, (langs, prototypes), pred_col=label, score_col=score)
    return found.filter(F.col(label) != language.UNKNOWN).drop(label, score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (but for the case of A-Z) the one with the largest doc_id stays."""
    rows = wrapped(docs)
    found = exact_dedup.exact_dedup(rows.select(RID, "row.doc_id", "row.text"), rid=RID)
    return without(rows, durable(found.filter(~F.col("kept")).select(RID), "drop-exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links (op1's rule: 4-word shingles, 4 of 64 bits) the one with the smallest doc_id stays. Most copies of Jaccard similarity under about 0.95 are not linked."""
    rows = wrapped(docs)
    found = simhash.near_duplicates(rows.select(RID, "row.doc_id", "row.text"), rid=RID)
    return without(rows, durable(found.filter(~F.col("kept")).select(RID), "drop-near"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of ``PASSAGE_BYTES`` that occur elsewhere out of the texts, in whole characters; n_chars follows. No document goes."""
    rows = wrapped(docs)
    cut = suffix_dedup.remove(rows.select(RID, "row.doc_id", "row.text"), with_text=True, window=PASSAGE_BYTES, rid=RID).filter("n_removed > 0")
    joined = rows.join(durable(cut.select(RID, "kept_text"), "cut-texts"), RID, "left")
    changed = F.col("kept_text").isNotNull()
    row = F.col("row").withField("text", F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return joined.select(row.alias("row")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned language profiles nor the vocabulary's merges; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
