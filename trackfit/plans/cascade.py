"""Classification of tracks: first match in a fixed order, or least cost.

The cascade runs in Arrow batches: the tracks of a batch with equal length are one matrix, each rule is tried on all rows
that no earlier rule has claimed, and a row leaves with its pattern. It is narrow: a track never leaves its task. The same
rules as single operators are built-in expressions in ``operators.detect``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfit.operators import detect, numeric

ENTRY_BYTES = 3
Found = tuple[str, list[int], list[float] | None, int]


def _run_pairs(row: np.ndarray) -> list[int]:
    """[value, count, ...], runs cut at 255."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    out: list[int] = []
    for value, size in zip(row[starts].tolist(), np.diff(np.r_[starts, len(row)]).tolist()):
        while size > 0:
            out += [value, min(size, 255)]
            size -= 255
    return out


def _even(d: np.ndarray) -> np.ndarray:
    return (d == d[:, :1]).all(axis=1) if d.shape[1] else np.zeros(len(d), bool)


def _kinds(m: np.ndarray) -> np.ndarray:
    s = np.sort(m, axis=1)
    return 1 + (s[:, 1:] != s[:, :-1]).sum(axis=1)


def _words(m: np.ndarray, width: int) -> np.ndarray:
    return (m.reshape(len(m), -1, width) << (8 * np.arange(width))).sum(axis=2)


# Each rule takes the rows that are left and returns, for each row that fires, its place and what was found.
Rule = Callable[[np.ndarray], Iterator[tuple[int, Found]]]


def _const(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    for i in np.flatnonzero((m == m[:, :1]).all(axis=1)):
        yield i, ("CONST", [int(m[i, 0])], None, 1)


def _linear(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    for i in np.flatnonzero(_even(np.diff(m))):
        yield i, ("LINEAR", [int(m[i, 0]), int(m[i, 1] - m[i, 0])], None, 4)


def _rle(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    for i in np.flatnonzero(2 * (1 + (np.diff(m) != 0).sum(axis=1)) < m.shape[1]):
        pairs = _run_pairs(m[i])
        if len(pairs) < m.shape[1]:
            yield i, ("RLE", pairs, None, 2 + len(pairs))


def _repeat(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    left = np.arange(len(m))
    for p in range(1, m.shape[1] // 3):
        maybe = left[m[left, p] == m[left, 0]]
        hit = maybe[(m[maybe, p:] == m[maybe, :-p]).all(axis=1)]
        for i in hit:
            yield i, ("REPEAT", m[i, :p].tolist(), None, 2 + p)
        left = np.setdiff1d(left, hit, assume_unique=True)


def _rle_or_repeat(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    """The smaller one where both fire, the repeated period on equal size."""
    runs = dict(_rle(m))
    for i, found in _repeat(m):
        if i not in runs or found[3] <= runs[i][3]:
            runs[i] = found
    yield from runs.items()


def _linear_wide(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n, seen = m.shape[1], np.zeros(len(m), bool)
    for width, least in ((4, 8), (2, 4)):
        if n >= least and n % width == 0:
            w = _words(m, width)
            hit = _even(np.diff(w)) & ~seen
            seen |= hit
            for i in np.flatnonzero(hit):
                yield i, ("LINEAR_WIDE", [width, n // width, int(w[i, 0]), int(w[i, 1] - w[i, 0])], None, 19)


def _by_row(name: str, rule: Callable) -> Rule:
    def run(m: np.ndarray) -> Iterator[tuple[int, Found]]:
        for i, row in enumerate(m):
            if (hit := rule(row)) is not None:
                yield i, (name, *hit)

    return run


def _delta_wide(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n = m.shape[1]
    if n < 8 or n % 4:
        return
    w = _words(m, 4)
    d = np.diff(w)
    seen = np.zeros(len(m), bool)
    for width, bound in ((1, 128), (2, 32768)):
        cost = 6 + width * d.shape[1]
        if cost * 4 < 3 * n:
            hit = ((d >= -bound) & (d < bound)).all(axis=1) & ~seen
            seen |= hit
            for i in np.flatnonzero(hit):
                yield i, ("DELTA_WIDE", [4, width, int(w[i, 0]), *d[i].tolist()], None, cost)


def _bit_packed(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n = m.shape[1]
    if n < 8:
        return
    bits = np.maximum(1, np.ceil(np.log2(m.max(axis=1) + 1)).astype(int))
    cost = 1 + (n * bits + 7) // 8
    for i in np.flatnonzero((bits < 7) & (cost < n)):
        yield i, ("BIT_PACKED", [int(bits[i]), *m[i].tolist()], None, int(cost[i]))


def _small_deltas(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(m)
    return d, ((d >= -128) & (d <= 127)).all(axis=1)


def _delta(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    if m.shape[1] < 2:
        return
    d, small = _small_deltas(m)
    for i in np.flatnonzero(small & (_kinds(d) <= 8)):
        yield i, ("DELTA", [int(m[i, 0]), *d[i].tolist()], None, m.shape[1] + 1)


def _periodic(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    """Rows whose energy outside the components that may be kept allows the rounding to be exact are tried in full."""
    n = m.shape[1]
    if not 16 <= n <= 4096:
        return
    energy = np.abs(np.fft.rfft(m, axis=1)) ** 2
    energy[:, 1 : (n + 1) // 2] *= 2
    most = max(0, min(energy.shape[1] - 1, n // 4 - 1, (n - 5) // 18))
    dropped = np.sort(energy, axis=1)[:, : energy.shape[1] - most].sum(axis=1) / n
    # Clipping at 0 and 255 may hide larger errors; elsewhere each value is off by a half at most.
    clipped = ((m == 0) | (m == 255)).any(axis=1)
    for i in np.flatnonzero(clipped | (dropped <= n / 4 + 1e-6)):
        if (hit := numeric.periodic(m[i])) is not None:
            yield i, ("PERIODIC", *hit)


def _poly(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n = m.shape[1]
    x, left = np.arange(n, dtype=np.float64), np.arange(len(m))
    for degree in range(2, min(8, n - 1) + 1):
        if 1 + 8 * (degree + 1) >= n or not len(left):
            return
        basis = np.vander(x, degree + 1)
        try:
            fit = basis @ np.linalg.solve(basis.T @ basis, basis.T @ m[left].T)
        except np.linalg.LinAlgError:
            continue
        # A fit of this degree that is off by more than rounding can be leaves the row; the others are tried exactly.
        for i in left[(np.abs(fit.T - m[left]) <= 0.5 + 1e-6).all(axis=1)]:
            if (hit := numeric.poly(m[i])) is not None:
                yield i, ("POLY", *hit)
                left = left[left != i]


def _diff_table(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n, seen, d = m.shape[1], np.zeros(len(m), bool), np.diff(m)
    for order in (2, 3, 4):
        d = np.diff(d)
        if n >= 8 and 6 + order < n:
            hit = _even(d) & ~seen
            seen |= hit
            for i in np.flatnonzero(hit):
                yield i, ("DIFF_TABLE", [order, *m[i, : order + 1].tolist(), int(d[i, 0])], None, 6 + order)


def _mod_arith(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    if m.shape[1] < 8:
        return
    b, seen, at = m[:, 0], np.zeros(len(m), bool), np.arange(m.shape[1])
    for mod in detect.MODULI:
        a = (m[:, 1] - b) % mod
        hit = (a != 0) & ~seen & ((a[:, None] * at + b[:, None]) % mod % 256 == m).all(axis=1)
        seen |= hit
        for i in np.flatnonzero(hit):
            yield i, ("MOD_ARITH", [int(a[i]), int(b[i]), mod], None, 6)


def _fibonacci(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    if m.shape[1] < 8:
        return
    left = np.arange(len(m))
    for k in range(1, 289):
        c1, c2 = divmod(k, 17)
        if k == 17 or not len(left):
            continue
        maybe = left[(c1 * m[left, 1] + c2 * m[left, 0]) % 256 == m[left, 2]]
        hit = maybe[((c1 * m[maybe, 1:-1] + c2 * m[maybe, :-2]) % 256 == m[maybe, 2:]).all(axis=1)]
        for i in hit:
            yield i, ("FIBONACCI", [int(m[i, 0]), int(m[i, 1]), c1, c2], None, 4)
        left = np.setdiff1d(left, hit, assume_unique=True)


def _mirror(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n = m.shape[1]
    if n >= 8 and n % 2 == 0:
        for i in np.flatnonzero((m == m[:, ::-1]).all(axis=1)):
            yield i, ("MIRROR", m[i, : n // 2].tolist(), None, n // 2)


def _sparse(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n = m.shape[1]
    if n < 8:
        return
    fill = np.sort(m, axis=1)[:, n // 2]  # a value that fills three quarters is the median
    other = m != fill[:, None]
    count = other.sum(axis=1)
    for i in np.flatnonzero((4 * (n - count) >= 3 * n) & (3 + 3 * count < n)):
        at = np.flatnonzero(other[i])
        yield i, ("SPARSE", [int(fill[i]), *np.stack([at, m[i, at]], axis=1).ravel().tolist()], None, 3 + 3 * int(count[i]))


def _piecewise(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n, seen, d = m.shape[1], np.zeros(len(m), bool), np.diff(m)
    if n < 16:
        return
    for parts in (2, 3, 4):
        size = n // parts
        if size < 4 or 1 + 6 * parts >= n:
            continue
        ends = [*(size * k for k in range(parts)), n]
        hit = ~seen & np.all([_even(d[:, a : b - 1]) for a, b in zip(ends, ends[1:])], axis=0)
        seen |= hit
        for i in np.flatnonzero(hit):
            yield i, ("PIECEWISE_LINEAR", [x for a in ends[:-1] for x in (a, int(m[i, a]), int(d[i, a]))], None, 1 + 6 * parts)


def _interleaved(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n = m.shape[1]
    if n <= 10 or n % 2:
        return
    hit, k = np.ones(len(m), bool), np.arange(n // 2)
    for j in (0, 1):
        start, step = m[:, j : j + 1], m[:, j + 2 : j + 3] - m[:, j : j + 1]
        hit &= ((start + k * step) % 256 == m[:, j::2]).all(axis=1)
    for i in np.flatnonzero(hit):
        a, b, c, e = m[i, :4].tolist()
        yield i, ("INTERLEAVED_LINEAR", [n // 2, a, c - a, b, e - b], None, 10)


def _delta_rle(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n = m.shape[1]
    if n < 8:
        return
    d, small = _small_deltas(m)
    for i in np.flatnonzero(small & (2 * (1 + (np.diff(d) != 0).sum(axis=1)) + 3 < n)):
        pairs = _run_pairs(d[i])
        if 3 + len(pairs) < n and len(pairs) < n - 1:
            yield i, ("DELTA_RLE", [int(m[i, 0]), *pairs], None, 3 + len(pairs))


def _xor_mask(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    n, seen = m.shape[1], np.zeros(len(m), bool)
    if n < 8:
        return
    for mask in detect.MASKS:
        x = m ^ mask
        flat, even = (x == x[:, :1]).all(axis=1), _even(np.diff(x))
        for i in np.flatnonzero(even & ~seen):
            inner = [0, int(x[i, 0])] if flat[i] else [1, int(x[i, 0]), int(x[i, 1] - x[i, 0])]
            yield i, ("XOR_MASK", [mask, *inner], None, 3 if flat[i] else 6)
        seen |= even


def _raw(m: np.ndarray) -> Iterator[tuple[int, Found]]:
    for i in range(len(m)):
        yield i, ("RAW", m[i].tolist(), None, m.shape[1])


#: The rules in the order of the cascade; the gate stands where None is.
STEPS: list[Rule | None] = [
    _const, _linear, _rle_or_repeat, _linear_wide, _by_row("LINEAR_F64", numeric.linear_f64), _by_row("DELTA_F64", numeric.delta_f64), _delta_wide, _bit_packed, _delta,
    None, _periodic, _poly, _diff_table, _mod_arith, _fibonacci, _mirror, _sparse, _piecewise, _interleaved, _by_row("EXPONENTIAL", numeric.exponential), _delta_rle, _xor_mask, _raw,
]


def first_match(m: np.ndarray) -> list[Found]:
    """What the cascade finds for each row of a matrix of byte values."""
    found: list[Found | None] = [None] * len(m)
    left, closed = np.arange(len(m)), np.zeros(0, np.int64)
    for step in STEPS:
        if step is None:
            shut = _kinds(m[left]) > detect.GATE_KINDS if len(left) else np.zeros(0, bool)
            closed, left = left[shut], left[~shut]
            continue
        if step is _raw:
            left = np.r_[left, closed]
        if not len(left):
            continue
        hit = np.zeros(len(left), bool)
        for i, what in step(m[left]):
            found[left[i]] = what
            hit[i] = True
        left = left[~hit]
    return found  # type: ignore[return-value]


def cheapest(m: np.ndarray) -> list[Found]:
    """The least payload over all rules, the earlier in the order on equal cost. The gate doesn't apply."""
    rank = {n: k for k, n in enumerate(detect.ORDER)}
    best: list[Found | None] = [None] * len(m)
    for step in (_rle, _repeat, *(s for s in STEPS if s not in (None, _rle_or_repeat))):
        for i, what in step(m):
            if best[i] is None or (what[3], rank[what[0]]) < (best[i][3], rank[best[i][0]]):
                best[i] = what
    return best  # type: ignore[return-value]


RESULT = [T.StructField("pattern", T.StringType()), T.StructField("ints", T.ArrayType(T.LongType())), T.StructField("reals", T.ArrayType(T.DoubleType())), T.StructField("cost", T.LongType())]


def _apply(tracks: DataFrame, rule: Callable[[np.ndarray], list[Found]], keep_values: bool) -> DataFrame:
    place = tracks.columns.index("v")
    kept = [i for i in range(len(tracks.columns)) if keep_values or i != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(place)
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, start = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size) - size
            found: list[Found | None] = [None] * len(size)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                for i, what in zip(rows, rule(flat[start[rows][:, None] + np.arange(n)])):
                    found[i] = what
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], [*(batch.schema.names[i] for i in kept), "pattern", "ints", "reals", "cost"])

    schema = T.StructType([*(tracks.schema.fields[i] for i in kept), *RESULT])
    return tracks.filter(F.size("v") > 0).mapInArrow(run, schema)


def classify(tracks: DataFrame, keep_values: bool = False) -> DataFrame:
    """``tracks`` (any keys and v) with pattern, ints, reals and cost: the first match of the cascade. Empty tracks are left out."""
    return _apply(tracks, first_match, keep_values)


def least_cost(tracks: DataFrame, keep_values: bool = False) -> DataFrame:
    """``tracks`` with the pattern of least payload. Not what a first match gives: a mode of its own."""
    return _apply(tracks, cheapest, keep_values)


def platter(pattern: Column) -> Column:
    """1 for raw tracks, 0 for structured ones."""
    return F.when(pattern == "RAW", 1).otherwise(0).cast("int")
