"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no piece of the vocabulary can reach across. Each part is merged from its letters by an agenda of
adjacent symbol pairs: the pair with the best score, leftmost first among equals, is merged and its new neighbours join
the agenda. What is no piece in the end falls back to bytes. Parts seen before come from a bounded cache. In every Arrow
batch, the parts that were merged anew are encoded by the sentencepiece library too, and a difference raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit.llm.common import table

SPACE = "▁"
#: Parts that a worker's cache holds, and their characters: a part can be as long as a text.
CACHE_PARTS, CACHE_CHARS = 600_000, 16_000_000
CHECK_ROWS = 1000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """Cache of parts: a part (without its first space mark) to its ids, decimal, each followed by a comma."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type vocabulary with leading space marks is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only the identity normaliser with a space mark in front is supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.cost = {p.piece: -p.score for _, p in normal}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.text = [b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in model.pieces]
        #: Neighbours that some piece holds together: merges never cross others.
        self.joints = {p.piece[i : i + 2] for _, p in normal for i in range(len(p.piece) - 1)}
        self.cuts_at_spaces = not any(j[1] == SPACE and j[0] != SPACE for j in self.joints)
        self.before: dict[str, bytes] = {}  # the cache as it was when it was last full
        self.cores: dict[str, bytes] = {}
        self.chars = self.core_chars = 0  # of the parts in the two caches
        self.new: list[str] = []

    def merge(self, part: str) -> list[str]:
        """The symbols that are left when the agenda is empty."""
        cost = self.cost
        symbols, n = list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, p) for i in range(n - 1) if (c := cost.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, whole = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != whole:
                continue  # one of the pair is already part of something else
            symbols[i], symbols[j] = whole, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(p := whole + symbols[k])) is not None:
                    heapq.heappush(agenda, (c, i, p))
            if (h := before[i]) >= 0 and (c := cost.get(p := symbols[h] + whole)) is not None:
                heapq.heappush(agenda, (c, h, p))
        return [s for s in symbols if s]

    def core(self, part: str) -> bytes:
        found = self.cores.get(part)
        if found is None:
            out: list[int] = []
            for s in self.merge(part):
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.bytes.get(b, self.unknown) for b in s.encode()] if self.bytes else [self.unknown]
            self.core_chars += len(part)
            found = self.cores[part] = b"%s," % b",".join(b"%d" % i for i in out)
        return found

    def __missing__(self, key: str) -> bytes:
        if (found := self.before.get(key)) is not None:  # checked then
            self[key] = found
            self.chars += len(key)
            return found
        marked = SPACE + key.replace(" ", SPACE)
        joints, start, out = self.joints, 0, []
        for i in range(1, len(marked)):
            if marked[i - 1 : i + 1] not in joints:
                out.append(self.core(marked[start:i]))
                start = i
        out.append(self.core(marked[start:]))
        found = self[key] = b"".join(out)
        self.new.append(key)
        return found

    def parts(self, text: str) -> list[str]:
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.cuts_at_spaces:
            return [text]
        if "  " not in text and text[:1] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.parts(text))) if text else b""

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes read as UTF-8, space marks as spaces; the mark in front goes."""
        raw = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return raw[1:] if raw[:1] == " " else raw

    def check(self) -> None:
        """Compare what was merged since the last check with the library; then bound the caches."""
        if self.new:
            for key, ids in zip(self.new, self.library.encode(self.new, num_threads=1)):
                if key and b"".join(b"%d," % i for i in ids) != self[key]:
                    raise ValueError(f"the agenda and the library disagree on {key!r}")
            self.chars += sum(map(len, self.new))
            self.new = []
        # One goes without the other: parts that come again are then put together from cores, not merged.
        if len(self) > CACHE_PARTS or self.chars > CACHE_CHARS:
            self.before = dict(self) if self.chars <= CACHE_CHARS else {}
            self.clear()
            self.chars = 0
        if len(self.cores) > CACHE_PARTS or self.core_chars > CACHE_CHARS:
            self.cores.clear()
            self.core_chars = 0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids and the decoded text.

    A null text is an empty one and has no ids; whole texts of any length are encoded; null and repeated ids are carried, and
    repeated rows give equal rows; an empty table gives an empty result. Other columns aren't read, whatever their names.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, CHECK_ROWS):
                part = batch.slice(at, CHECK_ROWS)
                counts, digests, decoded, ids_out, texts_out = [], [], [], [], []
                for i, value in enumerate(part.column(1)):
                    raw = vocab.encode(value.as_py() or "")
                    ids = [int(x) for x in raw.split(b",")[:-1]]
                    text = vocab.library.decode(ids) if ids else ""
                    if i == 0 and text != vocab.decode(ids):
                        raise ValueError("decoding and the library disagree")
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(raw[:-1]).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids_out.append(ids)
                        texts_out.append(text)
                vocab.check()
                more = [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts_out, pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *more], ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
