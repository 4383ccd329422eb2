"""Quality rules, toxicity and language ID: brute force, guarantees, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackfit.llm import language, quality, toxicity

from .conftest import DOCS, words


# ---- quality -------------------------------------------------------------------------------------------------------------

def brute_features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("ab c\n#|<\t\x0b  é"), max_size=60))
def test_features_brute_force(text):
    assert quality.features(text)[:5] == brute_features(text)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.05), (9, 9, 0.5), (40, 1000, 0.05)])
def test_binomial_tail_is_exact(k, n, p):
    assert quality.below(k, n, p) == pytest.approx(min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), rel=1e-9)


def test_cutoffs_are_in_order_and_certified():
    assert quality.sharpest([0, 0, 5, 30], 1000, [4, 3, 2, 1], 0.02, 0.01) == 2
    assert quality.sharpest([0, 0, 0, 0], 50, [4, 3, 2, 1], 0.02, 0.01) is None  # too few labels
    assert quality.sharpest([30, 0, 0, 0], 1000, [4, 3, 2, 1], 0.02, 0.01) is None  # never past a failed test


def test_false_rejections_stay_within_the_bound():
    rng = np.random.default_rng(1)
    cutoffs, wrong = quality.RULES["symbol_ratio"], 0
    for _ in range(200):
        values = rng.beta(1, 20, 2000)
        found = quality.sharpest([int((values > c).sum()) for c in cutoffs], len(values), cutoffs, 0.02, 0.05)
        true_loss = (1 - found) ** 20 if found is not None else 0.0
        wrong += true_loss > 0.02
    assert wrong <= 200 * 0.05 + 10


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_quality_rows_and_base_rules(request, table, spark):
    docs = request.getfixturevalue(table)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 0), (6, None, None), (6, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.assess(docs, labels).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n, chars, symbols, lines, repeated = brute_features(r["text"] or "")
        want[r["doc_id"], n, chars, symbols, lines, repeated, n < 50 or 100 * repeated > 50 * n] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # so few labels certify no cutoff


def test_quality_rejects_junk_and_keeps_the_rest(spark, store):
    rows = [(i, words(i, 80) if i % 5 else " ".join(w + "%%%&" for w in words(i, 80).split()), "en", "s", 1) for i in range(4000)]
    docs = store(spark.createDataFrame(rows, DOCS), "junk")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.assess(docs, labels).collect()}
    assert not any(got[i] for i in range(0, 4000, 5))
    assert sum(not got[i] for i in range(4000) if i % 5) <= quality.ALPHA * 3200


def test_quality_empty(empty, spark):
    assert quality.assess(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- toxicity ------------------------------------------------------------------------------------------------------------

BAD = ["vilegrub", "mudsnout", "rotpate", "foulwit"]


def toxic_corpus(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        w = words(i, 60).split()
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_held_out_accuracy():
    rows = toxic_corpus(700)
    model = toxicity.fit([t for i, t, _ in rows if i % 5], np.array([y for i, _, y in rows if i % 5]))
    held = [(t, y) for i, t, y in rows if not i % 5]
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in held]) > 0.97


def test_toxicity_query_reads_no_column_but_the_text(spark, tmp_path):
    rows = toxic_corpus(300)
    labels = [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows] + [(900, None, None, None, None), (901, "", "x", "y", 0)], DOCS).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, t, None, f"{i}", None) for i, t, _ in rows] + [(900, None, "q", None, 7), (901, "", None, None, None)], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = ({r["doc_id"]: tuple(r) for r in toxicity.query(spark, f"{tmp_path}/{k}").collect()} for k in "ab")
    assert a == b and len(a) == 302 and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in a.values())


def test_toxicity_scores_odd_rows(odd, clashing, empty):
    rows = toxic_corpus(200)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    for docs in (odd, clashing):
        got = toxicity.score(docs, model, score_col="score").collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    for texts, y in (([], []), (["a b"], [1]), (["a", "b"], [0, 0])):
        assert 0 <= toxicity.fit(texts, np.array(y)).score("a b c") <= 1


def test_long_texts_pool_as_a_whole():
    rows = toxic_corpus(300)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    v = model.embed((words(1, 20000) + " " + " ".join(BAD)).split())
    whole = [np.maximum(sum(v[k : k + len(v) - w + 1] @ kernel[k] for k in range(w)).max(axis=0) + b, 0) for w, kernel, b in zip(toxicity.WIDTHS, model.kernels, model.biases)]
    assert np.allclose(model.pooled(v), np.concatenate(whole), atol=1e-4)


def brute_score(model, text):
    """Hashing, convolution, pooling, the logistic layer and the group's threshold, one value at a time."""
    rows = []
    for w in text.lower().split():
        w = w.strip(".,;:!?\"'()[]{}<>*#%&$|")
        slots = [] if not w else [(w, 1)] + [(w[:k], salt) for k, salt in ((4, 2), (5, 3)) if len(w) >= k]
        ids = [1 + zlib.crc32(x.encode(), salt) % (toxicity.BUCKETS - 1) for x, salt in slots]
        rows.append([sum(float(model.table[i][d]) for i in ids) for d in range(toxicity.EMBED)])
    z = model.bias
    for j, (width, kernel, bias) in enumerate(zip((1, 2, 3), model.kernels, model.biases)):
        padded = rows + [[0.0] * toxicity.EMBED] * max(0, width - len(rows))
        for f in range(toxicity.FILTERS):
            values = [sum(padded[at + k][d] * float(kernel[k][d][f]) for k in range(width) for d in range(toxicity.EMBED)) for at in range(len(padded) - width + 1)]
            z += max(0.0, max(values) + float(bias[f])) * float(model.out[j * toxicity.FILTERS + f])
    pairs = Counter((ord(a) * 31 + ord(b)) % 2**32 % toxicity.GROUP_BINS for a, b in zip(text.lower(), text.lower()[1:]))
    size = math.sqrt(sum(pairs.values())) or 1.0
    near = [sum(math.sqrt(n) * float(c[k]) for k, n in pairs.items()) / size for c in model.centres]
    return 1 / (1 + math.exp(-(z - float(model.thresholds[near.index(max(near))]))))


def test_toxicity_forward_pass_brute_force():
    rows = toxic_corpus(300)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    assert any(model.out) and model.table.any()
    for text in [t for _, t, _ in rows[:12]] + ["", "one", "two words", "!!! ??", "漢字 かな é", " ".join(BAD), words(5, 700) + " mudsnout"]:
        assert model.score(text) == pytest.approx(brute_score(model, text), abs=1e-5)


def test_toxicity_groups_are_as_many_as_languages():
    rng = random.Random(2)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "αβγδ"]
    texts = [(k, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(80))) for k, a in enumerate(alphabets) for _ in range(30)]
    centres = toxicity._groups(np.array([toxicity.letter_profile(t) for _, t in texts]))
    found = {(k, int((centres @ toxicity.letter_profile(t)).argmax())) for k, t in texts}
    assert len(found) == len(alphabets) == len({g for _, g in found})


def test_toxicity_sample_is_the_same_each_time(spark, store):
    docs = store(spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(400)], DOCS).repartition(7), "sampled")
    rows = [(i, int(i % 4 == 0)) for i in range(400)] + [(8, 1)] * 500 + [(None, 1), (9, None)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    first = toxicity.training_rows(docs, labels, rows=50)
    second = toxicity.training_rows(docs.repartition(3), labels.repartition(5), rows=50)
    assert first[0] == second[0] and first[1].tolist() == second[1].tolist() and 0 < len(first[0]) <= 200
    assert toxicity.training_rows(docs, labels.filter("doc_id < 0"))[0] == []


# ---- language ------------------------------------------------------------------------------------------------------------

ALPHABETS = {"aa": "abcdefg", "bb": "fghijklm", "cc": "αβγδεζ"}


def language_rows(n):
    rng = random.Random(5)
    text = lambda k: " ".join("".join(rng.choice(ALPHABETS[k]) for _ in range(rng.randint(2, 7))) for _ in range(30))
    return [(i, text(k), k, "s", 1) for i in range(n) for k in [list(ALPHABETS)[i % 3]]]


def test_language_held_out_accuracy_and_undetermined(spark, tmp_path):
    odd = [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "123 ... !", "bb", None, None), (None, "abc abd", "aa", None, None)]
    spark.createDataFrame(language_rows(300) + odd, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in language.query(spark, str(tmp_path)).collect()}
    want = {i: k for i, _, k, *_ in language_rows(300)}
    assert all(got[i]["lang_pred"] == k for i, k in want.items() if got[i]["held_out"])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False


def test_cosine_of_counts_equals_bundled_vectors():
    text = "Abc ab, bca"
    _, code, n = language.ngram_counts([text])
    letters = language._letters()[2]
    slot = lambda ch: int(language._slots()[ord(ch)])
    total = np.zeros(language.DIMENSIONS)
    padded = [0, *(slot(c) for c in text.lower()), 0]
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b:
            total += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
    assert np.allclose(total, n @ language.vectors(code))


def test_language_keeps_columns_and_rows(odd, clashing, empty, spark):
    model = language.learn(spark.createDataFrame(language_rows(60), DOCS))
    for docs in (odd, clashing):
        got = language.identify(docs, model)
        assert set(got.columns) == set(docs.columns) | {"lang_pred", "lang_score"} and got.count() == docs.count()
    assert language.identify(empty, model).count() == 0
    nothing = language.learn(empty)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
