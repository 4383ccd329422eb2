"""Packing, token counts and SentencePiece against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackfit.llm import packing, sentencepieces, token_counts, tokens


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_packing_holds_every_id_once(request, table, tokenizer):
    docs = request.getfixturevalue(table)
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer(r["text"]) + [1], "<u4")
        for a, n in packing.cut(len(ids), packing.CONTEXT):
            want[r["doc_id"], a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(placed) == list(range(len(placed)))
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CONTEXT


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


def test_long_runs_of_white_space(tokenizer):
    texts = [" " * 1_500_000, "a" + "\n" * 1_200_000 + "b", "word\t\r\n" * 5_000, " " * 9_999 + "x", "\u3000" * 400_000]
    got = list(tokens.encode_batch(tokens.default_path(), pa.array(texts)))
    assert [g.tolist() for g in got] == [tokenizer(t) for t in texts]


def test_cache_of_parts_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_CHARS", 1000)
    vocab = sentencepieces.Pieces(sentencepieces.default_path())
    for text in ("short words here", "x" * 900, "y" * 900, "short words here"):
        assert vocab.encode(text) == b"".join(b"%d," % i for i in vocab.library.encode(text))
        vocab.check()
        assert sum(map(len, vocab)) == vocab.chars <= 1000
        assert sum(map(len, vocab.cores)) == vocab.core_chars <= 1000


def test_common_lengths_get_more_salts(spark, store):
    rows = [(i % 150, "same text" if i % 3 else "another text that is longer") for i in range(300)]  # ids and texts repeat
    cut_up = store(packing.pieces(store(spark.createDataFrame(rows, "doc_id long, text string"), "same"), context=16), "same-pieces")
    plain, dealt = packing.pack(cut_up, context=16), packing.pack(cut_up, context=16, part=1)
    content = lambda df: Counter((r["doc_id"], r["start"], r["length"]) for r in df.collect())
    slots = lambda df: sorted((r["sequence_id"], r["offset"], r["length"]) for r in df.collect())
    assert content(plain) == content(dealt) and sum(content(dealt).values()) >= 300
    assert slots(plain) == slots(dealt) and len(set(slots(dealt))) == len(slots(dealt))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_shortest_pack_first_places_each_length(histogram):
    packs = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for pattern, n in packs:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            placed[length] += n
    assert placed == Counter(histogram)


def test_shortest_pack_first_is_item_by_item():
    rng = random.Random(2)
    for _ in range(20):
        histogram = Counter(rng.randint(1, 32) for _ in range(rng.randint(1, 80)))
        packs = []
        for length in sorted(histogram.elements(), reverse=True):
            k = min(range(len(packs)), key=lambda j: packs[j], default=None)
            if k is not None and packs[k] + length <= 32:
                packs[k] += length
            else:
                packs.append(length)
        got = packing.shortest_pack_first(histogram, 32)
        assert sorted(packs) == sorted(sum(p) for p, n in got for _ in range(n))


def test_little_padding():
    rng = np.random.default_rng(0)
    histogram = Counter()
    for total in np.exp(rng.normal(6.5, 1.2, 20000)).astype(int) + 1:
        histogram.update(n for _, n in packing.cut(int(total), 2048))
    packs = packing.shortest_pack_first(histogram, 2048)
    used = sum(k * n for k, n in histogram.items())
    assert used / (2048 * sum(n for _, n in packs)) > 0.99


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_token_counts_brute_force(request, table, tokenizer, spark):
    docs = request.getfixturevalue(table)
    sizes = sorted(len(tokenizer(r["text"])) for r in docs.select("text").collect())
    sums = token_counts.suffix_sums(token_counts.lengths(docs)).cache()
    for r in sums.collect():
        n = r["length"]
        assert r["n_docs"] == sizes.count(n) and r["docs_at_least"] == sum(s >= n for s in sizes) and r["tokens_at_least"] == sum(s for s in sizes if s >= n)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes) and r["docs_to_here"] == sum(s <= n for s in sizes) and r["total_tokens"] == sum(sizes)
    asked = spark.createDataFrame([(c,) for c in (0, 1, 5, 100, 2048, 10**9)], "context long")
    for r in token_counts.limits(sums, asked).collect():
        c = r["context"]
        assert r["docs_over"] == sum(s > c for s in sizes) and r["truncated_tokens"] == sum(min(s, c) for s in sizes) and r["lost_tokens"] == sum(max(0, s - c) for s in sizes)
    for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r["length"] == sizes[max(0, -(-int(r["share"] * 1000) * len(sizes) // 1000) - 1)]


def test_token_counts_empty(empty):
    assert token_counts.suffix_sums(token_counts.lengths(empty)).count() == 0


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_sentencepiece_equals_the_library(request, table):
    docs = request.getfixturevalue(table)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest()] += 1
    assert Counter(tuple(r) for r in sentencepieces.encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_sentencepiece_ids_and_text(odd):
    for r in sentencepieces.encode_documents(odd, with_ids=True).join(odd.select("doc_id", "text"), "doc_id").filter("doc_id not in (3, 6)").collect():
        assert r["decoded"] == (r["text"] or "") and len(r["ids"]) == r["n_tokens"]


def test_sentencepiece_empty(empty):
    assert sentencepieces.encode_documents(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\tab.,é漢▁<s>😀\u0301\u200b\x00", "  ", "the ", " a", "<0x0A>", "</s>"]), max_size=14))
def test_agenda_equals_the_library(parts):
    text = "".join(parts)
    vocab = sentencepieces.vocabulary(sentencepieces.default_path())
    ids = [int(x) for x in vocab.encode(text).split(b",")[:-1]]
    assert ids == vocab.library.encode(text)
    assert vocab.decode(ids) == (vocab.library.decode(ids) if ids else "")


def test_rank_file_equals_the_tokenizer_file(tokenizer):
    import pyarrow as pa

    texts = ["", "a  b\n\n c", "it's <|endoftext|> 12345 　x", "漢字 é́ 😀"]
    assert [x.tolist() for x in tokens.encode_batch(tokens.default_path(), pa.array(texts))] == [tokenizer(t) for t in texts]
