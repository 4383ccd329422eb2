"""Detectors and inverses that need float arithmetic, in Arrow batches: f64 words, Fourier, least squares, geometric growth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FOUND = T.StructType([T.StructField("ints", T.ArrayType(T.LongType())), T.StructField("reals", T.ArrayType(T.DoubleType())), T.StructField("cost", T.LongType())])


FLOAT_NAMES = ["LINEAR_F64", "DELTA_F64", "PERIODIC", "POLY", "EXPONENTIAL"]


def f64_words(v: np.ndarray) -> np.ndarray | None:
    if len(v) < 16 or len(v) % 8:
        return None
    w = v.astype(np.uint8).view("<f8")
    return w if np.isfinite(w).all() else None


def linear_f64(v: np.ndarray) -> tuple[list[int], list[float], int] | None:
    w = f64_words(v)
    if w is None or len(v) <= 18:
        return None
    step = w[1] - w[0]
    with np.errstate(all="ignore"):
        even = np.abs(np.diff(w[1:]) - step) <= abs(step) * 1e-12 + 1e-15
        same = (w[0] + np.arange(len(w)) * step).tobytes() == w.tobytes()
    return ([len(w)], [float(w[0]), float(step)], 18) if even.all() and same else None


def delta_f64(v: np.ndarray) -> tuple[list[int], list[float], int] | None:
    w = f64_words(v)
    cost = 10 + 4 * (len(v) // 8 - 1)
    if w is None or cost >= len(v):
        return None
    with np.errstate(all="ignore"):
        d = np.diff(w)
        if (np.abs(d) > 3.4e38).any():
            return None
        single = d.astype(np.float32).astype(np.float64)
        if (np.abs(single - d) > np.abs(d) * 1e-6 + 1e-30).any() or np.cumsum(np.r_[w[0], single]).tobytes() != w.tobytes():
            return None
    return [len(w)], [float(w[0]), *single.tolist()], cost


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def cosine_sum(n: int, bins: np.ndarray, re: np.ndarray, im: np.ndarray) -> np.ndarray:
    """What the stored components give back. Detection uses this very sum, so that what is accepted can be rebuilt."""
    angle = 2 * np.pi * np.outer(bins, np.arange(n)) / n
    twice = np.where((bins == 0) | (2 * bins == n), 1.0, 2.0)[:, None]
    return np.clip(_half_up((twice * (re[:, None] * np.cos(angle) - im[:, None] * np.sin(angle))).sum(axis=0) / n), 0, 255)


def periodic(v: np.ndarray) -> tuple[list[int], list[float], int] | None:
    n = len(v)
    if not 16 <= n <= 4096:
        return None
    f = np.fft.rfft(v)
    by_size = np.argsort(-np.abs(f), kind="stable")
    # Beyond this many components the cost can't be less than the track's.
    for k in range(1, min(len(f), n // 4, (n - 5) // 18 + 1)):
        bins = by_size[:k]
        if (cosine_sum(n, bins, f.real[bins], f.imag[bins]) == v).all():
            cost = 4 + 18 * k
            return ([n, *bins.tolist()], [x for b in bins for x in (float(f[b].real), float(f[b].imag))], cost) if cost < n else None
    return None


def poly_values(coeffs: np.ndarray, n: int) -> np.ndarray:
    x = np.arange(n, dtype=np.float64)
    degree = len(coeffs) - 1
    return _half_up(sum(c * x ** (degree - j) for j, c in enumerate(coeffs)))


def poly(v: np.ndarray) -> tuple[list[int], list[float], int] | None:
    """The least degree from 2 to 8 whose least-squares fit rounds to the track, if it is shorter than the track."""
    n = len(v)
    x = np.arange(n, dtype=np.float64)
    for degree in range(2, min(8, n - 1) + 1):
        cost = 1 + 8 * (degree + 1)
        if cost >= n:
            return None
        basis = np.vander(x, degree + 1)
        try:
            coeffs = np.linalg.solve(basis.T @ basis, basis.T @ v)
        except np.linalg.LinAlgError:
            continue
        if (poly_values(coeffs, n) == v).all():
            return [degree], coeffs.tolist(), cost
    return None


def growth(base: np.float32, ratio: np.float32, n: int) -> np.ndarray:
    """base * ratio**i in single precision, powers by repeated squaring."""
    out = np.ones(n, np.float32)
    square, e = np.float32(ratio), np.arange(n)
    with np.errstate(all="ignore"):
        while e.any():
            out = np.where(e & 1, out * square, out).astype(np.float32)
            square, e = np.float32(square * square), e >> 1
        return _half_up((np.float32(base) * out).astype(np.float64))


def exponential(v: np.ndarray) -> tuple[list[int], list[float], int] | None:
    if len(v) <= 10 or not v[0] or not v[1]:
        return None
    base = np.float32(v[0])
    ratio = np.float32(v[1]) / base
    if ratio == 1 or not (growth(base, ratio, len(v)) == v).all():
        return None
    return [len(v)], [float(base), float(ratio)], 10


def detect_float(tracks: DataFrame, pattern: str) -> DataFrame:
    """The operator of one float pattern: fires, ints, reals and cost (null where it doesn't fire) for each track."""
    rule = {"LINEAR_F64": linear_f64, "DELTA_F64": delta_f64, "PERIODIC": periodic, "POLY": poly, "EXPONENTIAL": exponential}[pattern]
    place = tracks.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rule(np.array(v.as_py() or [], np.int64)) for v in batch.column(place)]
            part = [pa.array([f[k] if f else None for f in found], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f is not None for f in found]), *part], [*batch.schema.names, "fires", "ints", "reals", "cost"])

    return tracks.mapInArrow(run, T.StructType([*tracks.schema.fields, T.StructField("fires", T.BooleanType()), *FOUND.fields]))


def rebuild_floats(encodings: DataFrame) -> DataFrame:
    """``v`` of encodings (s, pattern, ints, reals) of the float patterns; null for others."""
    place = {c: encodings.columns.index(c) for c in ("s", "pattern", "ints", "reals")}

    def values(pattern: str, s: int, ints: list[int], reals: list[float]) -> list[int] | None:
        if pattern == "LINEAR_F64":
            return list((reals[0] + np.arange(ints[0]) * reals[1]).astype("<f8").tobytes())
        if pattern == "DELTA_F64":
            return list(np.cumsum(reals).astype("<f8").tobytes())
        if pattern == "PERIODIC":
            r = np.array(reals).reshape(-1, 2)
            return cosine_sum(ints[0], np.array(ints[1:]), r[:, 0], r[:, 1]).astype(int).tolist()
        if pattern == "POLY":
            return poly_values(np.array(reals), s).astype(int).tolist()
        if pattern == "EXPONENTIAL":
            return growth(np.float32(reals[0]), np.float32(reals[1]), ints[0]).astype(int).tolist()
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = pc.fill_null(pc.is_in(batch.column(place["pattern"]), pa.array(FLOAT_NAMES)), False)
            some = batch.filter(mine)
            found = [values(p, s, i, r) for p, s, i, r in zip(*(some.column(place[c]).to_pylist() for c in ("pattern", "s", "ints", "reals")))]
            out: list[list[int] | None] = [None] * batch.num_rows
            for k, v in zip(np.flatnonzero(mine.to_numpy(zero_copy_only=False)), found):
                out[k] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "v"])

    return encodings.mapInArrow(run, T.StructType([*encodings.schema.fields, T.StructField("v", T.ArrayType(T.IntegerType()))]))
