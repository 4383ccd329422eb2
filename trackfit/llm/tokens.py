"""Byte-level BPE ids in Arrow batches. The vocabulary file's path is a parameter; nothing is trained or copied.

The ids are those of the ``tokenizers`` library for its JSON file. The same vocabulary as merge ranks gives the same ids
some three times faster through ``tiktoken``, so that does the work, and the first text that isn't empty and every
``CHECKED``-th text of an Arrow batch are encoded by both; a difference raises an error. Texts with a very long run of white space overflow the fast encoder's stack; the
tokenizers library encodes those. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: One text in so many is encoded by both libraries.
CHECKED = 16
#: Starts at the head of a run only, so that a search takes linear time.
LONG_BLANK = re.compile(r"(?<!\s)\s{10000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoders(path: str) -> tuple[Callable[[str], list[int]], Callable[[str], list[int]]]:
    """(fast encoder, reference encoder) of the vocabulary at ``path``; the ranks lie beside it."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary, lambda text: exact.encode(text, add_special_tokens=False).ids


def encode_batch(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text (null: none), one array at a time."""
    fast, exact = encoders(path)
    checked = False
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        ids = exact(text) if LONG_BLANK.search(text) else fast(text)
        if text and (not checked or i % CHECKED == 0):
            checked = True
            if list(ids) != exact(text):
                raise ValueError("the rank file and the tokenizer file disagree")
        yield np.asarray(ids, dtype="<u4")
