"""Exact, near and repeated-string dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from trackfit.llm import components, exact_dedup, simhash, suffix_dedup

UPPER = re.compile("[A-Z]")


def normal(text):
    return UPPER.sub(lambda m: m[0].lower(), text or "")


# ---- exact ---------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_exact_dedup_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = exact_dedup.exact_dedup(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r["text"]), []).append(r["doc_id"])
    want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)  # one row of each group, of repeated rows too


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# ---- near ----------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", normal(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    root = list(range(len(fps)))
    for i in range(len(fps)):
        todo = [i] if root[i] == i else []
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x]).tolist():
                if root[y] > i:
                    root[y] = i
                    todo.append(y)
    return root


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_near_duplicates_brute_force(request, table):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = brute_components(fps)
    least = {}
    for r, k in zip(rows, root):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f, least.get(k)) for r, f, k in zip(rows, fps, root))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(root))


def test_near_duplicates_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def clusters(seed, n, bases=20, flips=6):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**63, bases, dtype=np.uint64)[rng.integers(0, bases, n)]
    for _ in range(flips):
        fp = fp ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(fp)


@pytest.mark.parametrize("seed", range(6))
def test_forest_has_the_components_of_brute_force(seed):
    fp = clusters(seed, 400, flips=seed + 2)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    child, parent = simhash.forest(np.zeros(len(fp), np.int64), fp)
    label = simhash._join_labels(np.arange(len(fp)), child, parent)
    assert len(child) < len(fp)
    assert len(set(zip(label.tolist(), brute_components(fp)))) == len(set(label.tolist())) == len(set(brute_components(fp)))


@pytest.mark.parametrize("hot", [4, 40, simhash.HOT])
def test_links_survive_the_refinement_of_hot_patterns(spark, hot):
    fp = clusters(11, 300, bases=4, flips=8)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in components.components(simhash.links(df, hot)).collect()}
    want = brute_components(fp)
    got = [roots.get(int(x), int(x)) for x in fp]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- repeated strings ----------------------------------------------------------------------------------------------------

def brute_repeats(texts, window=suffix_dedup.WINDOW):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[k : k + window] for t in raw for k in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("table", ["odd", "clashing"])
@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT])
def test_repeated_strings_brute_force(request, table, hot):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows])))
    got = suffix_dedup.remove(docs, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 0


def test_repeated_strings_with_many_different_surroundings(spark, store):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    core, longer = noise(420), noise(900)
    texts = [noise(rng.randint(0, 300)) + core + noise(rng.randint(0, 300)) for _ in range(30)]
    texts += [noise(100) + longer[a : a + 600] + noise(50) for a in (0, 40, 199, 200, 201, 300)]
    texts += ["ab" * 900, "z" * 401, "z" * 399, noise(400)]
    docs = store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "surroundings")
    want = {i: x for i, x in enumerate(brute_repeats(texts))}
    for hot in (3, suffix_dedup.HOT):
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove(docs, hot=hot).collect()} == want


@pytest.mark.parametrize("window", [30, 97, 200])
@pytest.mark.parametrize("hot", [3, suffix_dedup.HOT])
def test_repeated_strings_of_other_sizes(spark, store, window, hot):
    rng = random.Random(window)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = [noise(window + k) for k in (0, 1, 60)]
    texts = [noise(rng.randint(0, 90)) + rng.choice(shared) + noise(rng.randint(0, 90)) for _ in range(40)] + [noise(window), noise(window - 1), "xy" * window, shared[0][1:], None, ""]
    docs = store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "sizes")
    want = {i: x for i, x in enumerate(brute_repeats(texts, window))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove(docs, hot=hot, window=window).collect()} == want


def test_windows_that_are_too_short_are_refused():
    with pytest.raises(ValueError):
        suffix_dedup.Shape(10)


def test_repeated_strings_empty(empty):
    assert suffix_dedup.remove(empty).count() == 0


def test_query_shows_the_text_that_stays(spark, tmp_path):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    long, short = noise(400), " ".join(noise(5).replace(" ", "k") for _ in range(60))  # 60 words in 359 bytes: less than a window
    around = [noise(90) + str(i) for i in range(4)], [str(i) + noise(70) for i in range(4)]
    texts = [a + x + b for a, x, b in zip(around[0], [long, long, short, short], around[1])] + ["é" * 300, "x" + "é" * 300, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.query(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {i: tuple(r)[1:5] for i, r in rows.items()} == dict(enumerate(brute_repeats(texts)))
    assert [rows[i]["kept_text"] for i in range(8)] == [around[0][0] + around[1][0], around[0][1] + around[1][1], texts[2], texts[3], "", "x", "", ""]


def test_merged_transforms_equal_one_sort():
    rng = np.random.default_rng(3)
    columns = rng.integers(97, 100, (40, 60), dtype=np.uint8)
    columns[:, 30:45] = columns[:, :15]
    shards = [suffix_dedup.transform(columns[:, a : a + 17]) for a in range(0, 60, 17)]
    for c, member, again in suffix_dedup.merge(shards, 20):
        keys = [bytes(columns[c:, m]) for m in member]
        assert keys == sorted(keys)
        seen = Counter(k[:20] for k in keys if len(k) >= 20)
        assert again.tolist() == [len(k) >= 20 and seen[k[:20]] > 1 for k in keys]


def test_text_keeps_whole_characters():
    raw = "aéé漢b".encode()
    assert suffix_dedup.keep_characters(raw, [(2, 4)]) == "aéé漢b"  # halves of two characters stay
    assert suffix_dedup.keep_characters(raw, [(1, 3)]) == "aé漢b"
    assert suffix_dedup.keep_characters(raw, [(0, len(raw))]) == ""
