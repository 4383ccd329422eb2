"""The pipeline's stages one by one and as a whole, against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackfit.llm import language, suffix_dedup

from .conftest import DOCS, words
from .test_dedup import brute_components, brute_fingerprint, brute_repeats, normal

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("table", ["odd", "clashing", "empty"])
def test_stages_keep_the_columns(request, spark, table, store):
    docs = request.getfixturevalue(table)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, store.root)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        docs = store(out, f"after-{table}-{k}")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, store.root).count() >= (table != "empty")


def test_language_stage_drops_texts_without_letters_only(spark, odd, store):
    got = rows_of(STAGES["language_id"](spark, odd, store.root))
    want = Counter(tuple(r) for r in odd.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert got == want


def test_language_stage_keeps_texts_where_no_language_is_known(spark, odd, store):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit_documents(docs)[0] == []
    got = rows_of(STAGES["language_id"](spark, docs, store.root))
    assert got == Counter(tuple(r) for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert got


def test_exact_stage(spark, odd, store):
    got = STAGES["exact_dedup"](spark, odd, store.root).collect()
    texts = [normal(r["text"]) for r in got]
    rows = odd.collect()
    assert len(texts) == len(set(texts)) == len({normal(r["text"]) for r in rows})
    top = {}
    for r in rows:
        top.setdefault(normal(r["text"]), []).append(r["doc_id"])
    assert all(r["doc_id"] == max((x for x in top[normal(r["text"])] if x is not None), default=None) for r in got)


def test_near_stage(spark, odd, store):
    rows = odd.collect()
    root = brute_components([brute_fingerprint(r["text"]) for r in rows])
    got = STAGES["near_dedup"](spark, odd, store.root).collect()
    assert len(got) == len(set(root))
    least = {}
    for r, k in zip(rows, root):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert Counter(r["doc_id"] for r in got) == Counter(least.get(k) for k in set(root))


def test_suffix_stage_cuts_passages_and_keeps_documents(spark, odd, store):
    got = STAGES["suffix_dedup"](spark, odd, store.root).collect()
    rows = odd.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    want = Counter()
    for r, (size, removed, *_) in zip(rows, brute_repeats([r["text"] for r in rows], corpus_pipeline.PASSAGE_BYTES)):
        if not removed:
            want[tuple(r)] += 1
    assert want - rows_of_list(got) == Counter()
    assert sum(len((r["text"] or "").encode()) for r in got) < sum(len((r["text"] or "").encode()) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got if (r["doc_id"], r["text"]) not in {(x["doc_id"], x["text"]) for x in rows} and r["n_chars"] is not None)


def rows_of_list(rows):
    return Counter(tuple(r) for r in rows)


def test_run_against_brute_force(spark, tmp_path):
    passage = words(500, 90)
    near = words(501, 400).split()
    texts = [words(i, 120) for i in range(40)] + [words(3, 120).upper(), words(4, 120), None, "", "12 34", words(600, 30) + " " + passage + " " + words(601, 30), words(602, 30) + " " + passage]
    for k in (10, 200):
        changed = list(near)
        changed[k] = "other"
        texts.append(" ".join(changed))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    last = {normal(t): i for i, t in kept}
    kept = [(i, t) for i, t in kept if last[normal(t)] == i]
    root = brute_components([brute_fingerprint(t) for _, t in kept])
    first = {}
    for (i, _), k in zip(kept, root):
        first[k] = min(first.get(k, i), i)
    kept = [(i, t) for i, t in kept if i in first.values()]
    cut = brute_repeats([t for _, t in kept], corpus_pipeline.PASSAGE_BYTES)
    assert sum(x[1] > 0 for x in cut) == 2
    assert {r["doc_id"] for r in got} == {i for i, _ in kept}
    assert {r["doc_id"] for r in got if r["start"] == 0} == {i for i, _ in kept}
    from trackfit.llm import tokens

    fast, _ = tokens.encoders(tokens.default_path())
    for (i, t), (_, removed, *_) in zip(kept, cut):
        total = {r["doc_tokens"] for r in got if r["doc_id"] == i}
        assert len(total) == 1 and sum(r["length"] for r in got if r["doc_id"] == i) == total.pop()
        if not removed:
            assert {r["doc_tokens"] for r in got if r["doc_id"] == i} == {len(fast(t)) + 1}
    places = Counter()
    for r in got:
        for k in range(r["offset"], r["offset"] + r["length"]):
            places[r["sequence_id"], k] += 1
    assert max(places.values()) == 1 and max(k for _, k in places) < 2048


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    assert language.UNKNOWN == "und" and suffix_dedup.WINDOW == 400 and np.iinfo(np.int64).max > 0
