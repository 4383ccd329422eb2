"""Toxicity by a convolutional text classifier, trained in numpy.

Words have hashed embeddings (the whole word and two of its prefixes, summed). Filters of several widths slide over the
word vectors; the maximum of each over the whole text feeds a logistic layer. Thresholds are calibrated by language: the
language groups are found in the letters of the training texts themselves, so that no column but the text enters a score.

Fitting uses a bounded sample of labelled rows (``TRAIN_ROWS`` of each class, in expectation, and four times as many rows in all
at most, the first by a hash of the id); scoring reads whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfit.llm.common import table

#: Labelled rows of each class in the training sample, in expectation.
TRAIN_ROWS = 1200
BUCKETS, EMBED, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
STEPS, BATCH, RATE, DECAY = 400, 32, 0.02, 1e-4
#: A bucket seen in fewer training texts stays at zero and isn't trained: it would only name its texts.
MIN_TEXTS = 3
#: Weight of the cut 0 against a calibrated one, in texts of label 1 kept out of training.
PRIOR = 5
#: Texts whose letter profiles are as like as this are of one language; so many of them, at least, found a group of their own.
GROUP_COSINE, GROUP_TEXTS, GROUP_BINS = 0.8, 8, 512
#: Words that a worker's cache holds before it is emptied, and their characters.
CACHE_WORDS, CACHE_CHARS = 200_000, 4_000_000
STRIP = ".,;:!?\"'()[]{}<>*#%&$|"


def buckets(word: str) -> tuple[int, int, int]:
    """Buckets of a word and its prefixes of four and five letters; 0 is nobody's."""
    w = word.strip(STRIP)
    if not w:
        return 0, 0, 0
    one = lambda s, salt: 1 + zlib.crc32(s.encode("utf-8", "surrogatepass"), salt) % (BUCKETS - 1)
    return one(w, 1), one(w[:4], 2) if len(w) >= 4 else 0, one(w[:5], 3) if len(w) >= 5 else 0


def letter_profile(text: str) -> np.ndarray:
    """Unit vector of hashed letter pairs of a lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.bincount((c[:-1] * np.uint32(31) + c[1:]) % np.uint32(GROUP_BINS), minlength=GROUP_BINS).astype(np.float32) if len(c) > 1 else np.zeros(GROUP_BINS, np.float32)
    h = np.sqrt(h)
    return h / max(float(np.linalg.norm(h)), 1e-9)


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    centres: np.ndarray
    thresholds: np.ndarray
    _cache: dict[str, int] = field(default_factory=dict)
    _dense: np.ndarray | None = None
    _chars: int = 0

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}, "_dense": None, "_chars": 0}

    def group(self, text: str) -> int:
        return int((self.centres @ letter_profile(text)).argmax())

    def embed(self, words: list[str]) -> np.ndarray:
        """Vectors of words; those seen before come from a bounded cache."""
        if not words:
            return np.zeros((0, EMBED), np.float32)
        cache = self._cache
        if len(cache) > CACHE_WORDS or self._chars > CACHE_CHARS:
            cache.clear()
            self._dense, self._chars = None, 0
        new = {w for w in words if w not in cache}
        if new:
            self._chars += sum(map(len, new))
            for w in new:
                cache[w] = len(cache)
            size = len(cache)
            if self._dense is None or size > len(self._dense):
                grown = np.zeros((max(1024, 2 * size), EMBED), np.float32)
                if self._dense is not None:
                    grown[: len(self._dense)] = self._dense
                self._dense = grown
            self._dense[size - len(new) : size] = self.table[np.array([buckets(w) for w in new], np.int64)].sum(axis=1)
        return self._dense[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]

    def pooled(self, vectors: np.ndarray) -> np.ndarray:
        """Maxima of all filters over one text; a text shorter than a filter is padded with zero vectors."""
        found = []
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            v = vectors if len(vectors) >= width else np.vstack([vectors, np.zeros((width - len(vectors), EMBED), np.float32)])
            n = len(v) - width + 1
            top = np.full(FILTERS, -np.inf, np.float32)
            for at in range(0, n, 8192):  # bounded memory for very long texts
                m = min(8192, n - at)
                h = sum(v[at + k : at + k + m] @ kernel[k] for k in range(width))
                top = np.maximum(top, h.max(axis=0))
            found.append(np.maximum(top + bias, 0))
        return np.concatenate(found)

    def logit(self, text: str) -> float:
        return float(self.pooled(self.embed(text.lower().split())) @ self.out + self.bias)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text) - self.thresholds[self.group(text)], -60, 60))))


def _groups(profiles: np.ndarray) -> np.ndarray:
    """Centres of language groups, as many as there are: the text with most others like it founds the first, that with most like it
    of the texts left the next, and so on; then spherical k-means. Rarer languages go with the centre they are nearest to."""
    left, centres = np.ones(len(profiles), bool), []
    like = profiles @ profiles.T >= GROUP_COSINE  # of a bounded sample
    while left.any():
        count = (like & left).sum(axis=1) * left
        first = int(count.argmax())
        if centres and count[first] < GROUP_TEXTS:
            break
        centres.append(profiles[like[first] & left | (np.arange(len(profiles)) == first)].mean(axis=0))
        centres[-1] /= max(float(np.linalg.norm(centres[-1])), 1e-9)
        left &= ~like[first] & (profiles @ centres[-1] < GROUP_COSINE)
        left[first] = False
    c = np.array(centres)
    for _ in range(15):
        near = (c @ profiles.T).argmax(axis=0)
        c = np.array([profiles[near == g].mean(axis=0) if (near == g).any() else c[g] for g in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(texts: list[str], labels: np.ndarray, seed: int = 8) -> Model:
    """Train on (text, 0/1). One text in five is kept for calibration. Without both classes every score is the share of ones."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    model = Model(
        np.zeros((BUCKETS, EMBED), np.float32), [rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, np.zeros((1, GROUP_BINS), np.float32), np.zeros(1),
    )
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        model.out[:] = 0
        model.bias = -6.0 if share < 0.5 else 6.0
        return model
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    kinds: dict[str, int] = {}
    words = [np.array([kinds.setdefault(w, len(kinds)) for w in t.lower().split()], np.int64) for t in texts]
    feats = np.array([buckets(w) for w in kinds] or [(0, 0, 0)], np.int64)

    # Document frequencies by class give the first component its start; rare buckets stay out.
    seen = np.zeros((2, BUCKETS))
    for i in train:
        seen[int(y[i]), np.unique(feats[words[i]])] += 1
    n1, n0 = max(1, y[train].sum()), max(1, (1 - y[train]).sum())
    use = seen.sum(axis=0) >= MIN_TEXTS
    use[0] = False
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    model.table[use] = rng.normal(0, 0.02, (int(use.sum()), EMBED))
    model.table[use, 0] = 0.5 * np.clip(odds[use], -3, 3) * seen.sum(axis=0)[use] / (seen.sum(axis=0)[use] + 5)
    for k in model.kernels:
        k[:, 0, :] = np.abs(k[:, 0, :])

    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    step = 0

    def adam(key: int, w: np.ndarray, g: np.ndarray) -> None:
        m, v = state.setdefault(key, (np.zeros_like(w), np.zeros_like(w)))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    queue = np.zeros(0, np.int64)
    for _ in range(STEPS):
        if len(queue) < BATCH:
            queue = np.concatenate([queue, rng.permutation(train)])
        some, queue = queue[:BATCH], queue[BATCH:]
        step += 1
        gk = [np.zeros_like(k) for k in model.kernels]
        gb = [np.zeros_like(b) for b in model.biases]
        go, gbias = np.zeros_like(model.out), 0.0
        rows, grads = [], []
        for i in some:
            w = words[i]
            e = model.table[feats[w]].sum(axis=1) if len(w) else np.zeros((0, EMBED), np.float32)
            pad = max(WIDTHS)
            e = np.vstack([e, np.zeros((max(0, pad - len(e)), EMBED), np.float32)])
            tops, acts = [], []
            for width, kernel, bias in zip(WIDTHS, model.kernels, model.biases):
                n = len(e) - width + 1
                h = sum(e[k : k + n] @ kernel[k] for k in range(width))
                top = h.argmax(axis=0)
                tops.append(top)
                acts.append(np.maximum(h[top, np.arange(FILTERS)] + bias, 0))
            act = np.concatenate(acts)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.bias, -60, 60)))
            d = float(p - y[i]) / len(some)
            go += d * act
            gbias += d
            back = (d * model.out * (act > 0)).reshape(len(WIDTHS), FILTERS)
            for j, width in enumerate(WIDTHS):
                gb[j] += back[j]
                for k in range(width):
                    x = e[tops[j] + k]
                    gk[j][k] += x.T * back[j]
                    inside = tops[j] + k < len(w)
                    rows.append(feats[w[(tops[j] + k)[inside]]] if len(w) else np.zeros((0, 3), np.int64))
                    grads.append((model.kernels[j][k] * back[j]).T[inside])
        for j in range(len(WIDTHS)):
            adam(10 + j, model.kernels[j], gk[j] + DECAY * model.kernels[j])
            adam(20 + j, model.biases[j], gb[j])
        adam(1, model.out, go + DECAY * model.out)
        one = np.array([model.bias])
        adam(2, one, np.array([gbias]))
        model.bias = float(one[0])
        hit, grad = np.concatenate(rows), np.concatenate(grads)
        for c in range(3):
            ok = use[hit[:, c]]
            np.subtract.at(model.table, hit[ok, c], 2 * RATE * grad[ok])
    # Thresholds: in each language group the middle of the cuts with fewest errors on texts kept out of training. Few
    # texts of label 1 draw a group to the common cut, and that to 0.
    profiles = np.array([letter_profile(t) for t in texts])
    model.centres = _groups(profiles)
    logits = np.array([model.logit(texts[i]) for i in held])
    near = (model.centres @ profiles[held].T).argmax(axis=0)

    def cut(z: np.ndarray, t: np.ndarray) -> float:
        ends = np.sort(z)
        tries = np.concatenate([[ends[0] - 1], (ends[1:] + ends[:-1]) / 2, [ends[-1] + 1]]) if len(z) else np.zeros(1)
        wrong = np.array([((z >= c) != (t > 0.5)).sum() for c in tries])
        best = tries[wrong == wrong.min()]
        return float((best.min() + best.max()) / 2)

    ones = int(y[held].sum())
    common = cut(logits, y[held]) * ones / (ones + PRIOR) if ones else 0.0
    model.thresholds = np.full(len(model.centres), common)
    for g in range(len(model.centres)):
        mine = near == g
        if n := int(y[held][mine].sum()):
            model.thresholds[g] = (n * cut(logits[mine], y[held][mine]) + PRIOR * common) / (n + PRIOR)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """A sample of labelled texts, about ``rows`` of each class, drawn by a hash of the id: the same rows each time. At most four
    times ``rows`` labels, and texts, are taken, those first by that hash, should ids repeat so often. Null ids and labels are
    left out; a repeated label row counts again; empty tables give an empty sample."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    sizes = {r["y"]: r["n"] for r in known.filter("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda k: rows / sizes[k] * (1 << 20) if sizes.get(k) else 0.0
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.when(F.col("y") == 1, share(1)).otherwise(share(0))).orderBy(F.xxhash64("id"), "id", "y").limit(4 * rows)
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id", "y", "text").limit(4 * rows)
    got = sorted((r["id"], r["text"], r["y"]) for r in found.collect())
    return [t for _, t, _ in got], np.array([y for _, _, y in got], np.int64)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """``docs`` with a score from 0 to 1. Null and empty texts are scored as a text without words; repeated rows get equal
    scores; texts of any length are read whole, in parts of bounded size; an empty table gives an empty result. All columns stay,
    but one named like the score is replaced."""
    docs = docs.drop(score_col)
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: its tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = [m.score(t.as_py() or "") for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def fold_of(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*training_rows(docs, labels.filter(fold_of() != 0)))
    scored = score(docs.select("doc_id", "text"), model, score_col="score")
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
