"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram's vector binds (multiplies) the permuted vectors of its
letters; a document's vector bundles (sums) those of its n-grams; a language's prototype bundles documents of that
language. A document gets the language whose prototype has the largest cosine with it.

The learned rows are a bounded sample for each language (``TRAIN_ROWS``, drawn by a hash of doc_id); prototypes come
from n-gram counts summed on the executors, so no training text reaches the driver. Prediction reads the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfit.llm.common import table

DIMENSIONS = 1024
#: Expected number of learned rows for each language.
TRAIN_ROWS = 2000
#: Languages that are learned, and compared with, at once; it bounds what a task holds. All are learned.
LANGUAGES = 256
SEED = 20
#: Letters share so many slots by a hash; slot 0 is whatever isn't a letter.
SLOTS = 256
#: Sharpness of the score over cosines.
SHARPNESS = 20.0
CHUNK_CHARS, CHUNK_TEXTS, BLOCK = 1 << 20, 1024, 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """Slot of each code point."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, 1 + (points * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(SLOTS - 1), 0).astype(np.uint32)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors permuted for the first, second and third place of an n-gram."""
    v = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, DIMENSIONS))
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram codes."""
    a, b, c = _letters()
    return (a[codes >> 16] * b[codes >> 8 & 255] * c[codes & 255]).astype(np.float32)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram code, count), by text. An n-gram has a letter in its middle and may begin or end outside a word."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    gap = np.zeros(1, np.uint32)
    s = np.concatenate([x for t in raw for x in (gap, _slots()[t])] + [gap, gap])
    who = np.repeat(np.arange(len(raw)), [len(t) + 1 for t in raw])
    middle = s[1:-1]
    at = np.flatnonzero(middle)  # the n-gram around position at + 1
    code = (s[at] << 16 | s[at + 1] << 8 | s[at + 2]).astype(np.int64)
    pair, n = np.unique(who[at] << 24 | code, return_counts=True)
    return pair >> 24, pair & 0xFFFFFF, n


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    start, part, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= CHUNK_CHARS or len(part) >= CHUNK_TEXTS:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of unit length) from rows with a language, every value of it, about ``train_rows`` rows each. Rows with a null id, text or language teach nothing."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    blocks = [_prototypes(rows, {k: sizes[k] for k in langs[at : at + LANGUAGES]}, train_rows) for at in range(0, len(langs), LANGUAGES)]
    return langs, np.concatenate([np.zeros((0, DIMENSIONS), np.float32), *blocks])


def _prototypes(rows: DataFrame, sizes: dict[str, int], train_rows: int) -> np.ndarray:
    """Prototypes of the languages in ``sizes``, in their order; sizes are their rows."""
    langs = list(sizes)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(train_rows / n))])
    mine = rows.filter(F.col("lang").isin(langs))
    drawn = mine.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                who, code, n = ngram_counts(texts)
                lang = batch.column(0).slice(start, len(texts)).to_numpy(zero_copy_only=False)
                for one in set(lang):
                    mine = np.flatnonzero(lang[who] == one)
                    codes, back = np.unique(code[mine], return_inverse=True)
                    total = np.bincount(back, weights=n[mine]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(codes), pa.string()), pa.array(codes), pa.array(total)], ["lang", "code", "n"])

    counted = drawn.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    index = {k: i for i, k in enumerate(langs)}

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), DIMENSIONS))
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            code, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for one in np.unique(lang):
                mine = np.flatnonzero(lang == one)
                for at in range(0, len(mine), BLOCK):
                    k = mine[at : at + BLOCK]
                    sums[one] += n[k].astype(np.float32) @ vectors(code[k])
        filled = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(list(sums[filled]), pa.list_(pa.float64()))], ["lang", "sums"])

    # One row of sums for each language and partition of the counts; the counts are merged into few partitions.
    total = np.zeros((len(langs), DIMENSIONS))
    for row in counted.coalesce(8).mapInArrow(bundle, "lang long, sums array<double>").collect():
        total[row["lang"]] += row["sums"]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def classify(texts: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best prototype, -1 without a letter; score)."""
    who, code, n = ngram_counts(texts)
    codes, at = np.unique(code, return_inverse=True)
    bundle = np.zeros((len(texts), DIMENSIONS), np.float32)
    for start in range(0, len(codes), BLOCK):
        mine = (at >= start) & (at < start + BLOCK)
        counts = np.zeros((len(texts), min(BLOCK, len(codes) - start)), np.float32)
        counts[who[mine], at[mine] - start] = n[mine]
        bundle += counts @ vectors(codes[start : start + BLOCK])
    norm = np.linalg.norm(bundle, axis=1, keepdims=True)
    unit = bundle / np.where(norm > 0, norm, 1)
    blocks = range(0, len(prototypes), LANGUAGES)
    best, most = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf, np.float32)
    for start in blocks:
        cosine = unit @ prototypes[start : start + LANGUAGES].T
        top = cosine.max(axis=1)
        best = np.where(top > most, start + cosine.argmax(axis=1), best)
        most = np.maximum(most, top)
    score = 1 / sum(np.exp(SHARPNESS * (unit @ prototypes[start : start + LANGUAGES].T - most[:, None])).sum(axis=1) for start in blocks)
    has_letter = np.bincount(who, minlength=len(texts)) > 0
    return np.where(has_letter, best, -1), np.where(has_letter, score, 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1). A null text, or one without a letter, is ``und``
    with score 0; so is every text where no language could be learned. All columns stay, but for one that has a new column's name: it
    is replaced. Whole texts are read."""
    docs = docs.drop(pred_col, score_col)
    langs, prototypes = model
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch.column(place)):
                if langs:
                    best, score = classify(texts, prototypes)
                else:
                    best, score = np.full(len(texts), -1), np.zeros(len(texts))
                names = pa.array([langs[b] if b >= 0 else UNKNOWN for b in best], pa.string())
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, names, pa.array(score, pa.float64())], [*part.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def fold_of(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def fit_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the rows that may be learned from: those whose crc32 of doc_id leaves no remainder of 2 by 4."""
    return learn(docs.filter(fold_of() != 2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_documents(docs), score_col="score")
    return found.select("doc_id", F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
