"""Every value of lang is learned, in blocks of languages."""

import numpy as np

from trackfit.llm import language

from .conftest import words

MANY = [f"l{k:03}" for k in range(260)]
TEXTS = [words(1000 + k, 60) for k in range(260)]


def test_more_languages_than_a_block(spark):
    rows = [(k, lang, text) for k, (lang, text) in enumerate(zip(MANY, TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    langs, prototypes = language.learn(docs)
    assert langs == MANY and prototypes.shape == (260, language.DIMENSIONS)
    found = language.identify(docs, (langs, prototypes)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_blocks_change_nothing(monkeypatch):
    prototypes = np.random.default_rng(1).normal(size=(10, language.DIMENSIONS)).astype(np.float32)
    prototypes[7] = prototypes[2]  # a tie goes to the first
    best, score = language.classify([*TEXTS[:20], "", "12"], prototypes)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    again, close = language.classify([*TEXTS[:20], "", "12"], prototypes)
    assert (best == again).all() and np.allclose(score, close, atol=1e-5) and list(best[-2:]) == [-1, -1]
