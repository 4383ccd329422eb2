"""Sizes by the cascade for matrices of bytes, without the encodings themselves.

What the searches by size need of a track is its pattern, its cost and, for patterns that form groups, its parameters. Equal
tracks are looked at once. Rules that often fire are whole-matrix expressions here; each of the others gets, from a necessary
condition on a few columns, the rows that it could fire for, and decides itself (``cascade``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

from trackfit.operators import detect, groups, numeric
from trackfit.plans import cascade

ENTRY_BYTES = cascade.ENTRY_BYTES
CODE = {name: k for k, name in enumerate(detect.ORDER)}
KINDS = len(CODE)
CONST, LINEAR, RAW = CODE["CONST"], CODE["LINEAR"], CODE["RAW"]
SAME = [CODE[p] for p in groups.SAME_KINDS]
GROUPED = np.isin(np.arange(KINDS), [CONST, LINEAR, *SAME])
_BITS = np.maximum(1, np.ceil(np.log2(np.arange(256) + 1.0)).astype(int))
_HASH = np.random.default_rng(7).integers(1 << 62, size=512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PROBES = 16


@dataclass
class Tracks:
    """Of each row: pattern and cost, and for grouped patterns ``x`` and ``step`` (CONST, LINEAR) or ``same``, equal for equal parameters."""

    code: np.ndarray
    cost: np.ndarray
    x: np.ndarray
    step: np.ndarray
    same: np.ndarray
    found: dict[int, tuple[list[int], list[float] | None]]  # parameters by ``same``
    words: np.ndarray | None = None

    def take(self, rows: np.ndarray) -> Tracks:
        return Tracks(self.code[rows], self.cost[rows], self.x[rows], self.step[rows], self.same[rows], self.found, self.words)


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(first row of each kind, kind of each row), or none if hashes of different rows are equal."""
    w = np.ascontiguousarray(m).view(np.uint64)
    h = w[:, 0] if w.shape[1] == 1 else (((w ^ (w >> np.uint64(29))) * _HASH[: w.shape[1]]) ^ (w >> np.uint64(17))).sum(axis=1, dtype=np.uint64)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    return (first, kind) if (w[first[kind]] == w).all() else None


def by_rules(m: np.ndarray) -> Tracks:
    """The rows of any integers, by the rules of the cascade as they are."""
    t, known = _empty(len(m), m.shape[1]), {}
    for i, found in enumerate(cascade.first_match(m.astype(np.int64))):
        _put(t, i, found, known)
    return t


def measure(m: np.ndarray) -> Tracks:
    """The rows of a byte matrix whose width is a multiple of 8."""
    if not len(m):
        return _empty(0, m.shape[1])
    if (both := _distinct(m)) is None:
        return _measure(np.ascontiguousarray(m))
    return _measure(m[both[0]]).take(both[1])


def _empty(rows: int, n: int) -> Tracks:
    none = np.zeros(rows, np.int64)
    return Tracks(np.full(rows, RAW), np.full(rows, n), none, none.copy(), np.arange(rows), {})


def _put(t: Tracks, i: int, found: cascade.Found, known: dict) -> None:
    name, ints, reals, cost = found
    t.code[i], t.cost[i] = CODE[name], cost
    if name in ("CONST", "LINEAR"):
        t.x[i], t.step[i] = ints[0], ints[1] if name == "LINEAR" else 0
    elif name in groups.SAME_KINDS:
        t.same[i] = known.setdefault((name, tuple(ints), tuple(reals or [])), i)
        t.found[int(t.same[i])] = (ints, reals)


def _measure(m: np.ndarray) -> Tracks:
    n, t, known = m.shape[1], _empty(*m.shape), {}
    todo = np.ones(len(m), bool)
    c = np.ascontiguousarray(m.T).astype(np.int16)  # columns: one value of every row lies together
    d = np.diff(c, axis=0)
    runs = 1 + (d != 0).view(np.uint8).sum(axis=0, dtype=np.int32)

    def mark(rows: np.ndarray, name: str, cost: np.ndarray | int) -> None:
        t.code[rows], t.cost[rows], todo[rows] = CODE[name], cost, False

    def ask(maybe: np.ndarray, rule: cascade.Rule) -> None:
        rows = np.flatnonzero(maybe & todo)
        if len(rows):
            for i, found in rule(m[rows].astype(np.int64)):
                _put(t, rows[i], found, known)
                todo[rows[i]] = False

    mark(rows := np.flatnonzero(runs == 1), "CONST", 1)
    t.x[rows] = c[0, rows]
    rows = np.flatnonzero(todo & (d[0] == d[1]) & (d[1] == d[2]))
    rows = rows[(d[:, rows] == d[0, rows]).all(axis=0)]
    mark(rows, "LINEAR", 4)
    t.x[rows], t.step[rows] = c[0, rows], d[0, rows]
    _runs_and_repeats(m, c, runs, todo, t, mark, known)

    if n == 8:  # two words of four bytes always have an even step: nothing is left for the rules after it
        rows = np.flatnonzero(todo)
        mark(rows, "LINEAR_WIDE", 19)
        t.same[rows] = rows
        t.words = m.view("<u4")
        return t
    w4, w2 = (m.view(f"<u{k}")[:, :4].astype(np.int64) for k in (4, 2))
    even = lambda w: (w[:, 1] - w[:, 0] == w[:, 2] - w[:, 1]) & (w[:, 2] - w[:, 1] == w[:, 3] - w[:, 2])
    ask(even(w4) | even(w2), cascade._linear_wide)
    f = m.view("<f8")
    with np.errstate(all="ignore"):
        step = f[:, 1] - f[:, 0]
        if n > 18:
            ask(f[:, 0] + 2 * step == f[:, 2], cascade._by_row("LINEAR_F64", numeric.linear_f64))
        ask(f[:, 0] + step.astype(np.float32).astype(np.float64) == f[:, 1], cascade._by_row("DELTA_F64", numeric.delta_f64))
    first = w4[:, 1] - w4[:, 0]
    ask((first >= -32768) & (first < 32768), cascade._delta_wide)

    bits = _BITS[c.max(axis=0)]
    packed = 1 + (n * bits + 7) // 8
    rows = np.flatnonzero(todo & (bits < 7) & (packed < n))
    mark(rows, "BIT_PACKED", packed[rows])
    small = (d.min(axis=0) >= -128) & (d.max(axis=0) <= 127)
    rows = np.flatnonzero(todo & small)
    for width in (16, n):
        s = np.sort(d[:width, rows], axis=0)
        rows = rows[1 + (s[1:] != s[:-1]).sum(axis=0) <= 8]
    mark(rows, "DELTA", n + 1)

    if n > detect.GATE_KINDS:
        rows = np.flatnonzero(todo)
        seen = np.zeros((len(rows), 256), bool)
        np.put_along_axis(seen, m[rows].astype(np.intp), True, axis=1)
        todo[rows[seen.sum(axis=1) > detect.GATE_KINDS]] = False  # raw
    ask(_waves(m, todo), cascade._periodic)
    if n > 25:
        ask(_smooth(m, todo), cascade._poly)
    ask(_differences(c), cascade._diff_table)
    ask(_moduli(c), cascade._mod_arith)
    ask(_recurrent(c), cascade._fibonacci)
    ask((c[0] == c[-1]) & (c[1] == c[-2]) & (c[2] == c[-3]), cascade._mirror)
    ask(runs <= n // 2 + 1, cascade._sparse)
    ask((d[0] == d[1]) & (d[1] == d[2]) & (d[-1] == d[-2]), cascade._piecewise)
    ask(((2 * c[2] - c[0] - c[4]) % 256 == 0) & ((2 * c[3] - c[1] - c[5]) % 256 == 0) & ((3 * c[2] - 2 * c[0] - c[6]) % 256 == 0), cascade._interleaved)
    with np.errstate(all="ignore"):
        ratio = c[1] / c[0]
        third = c[1] * ratio
        ask((c[0] != 0) & (c[1] != 0) & (c[0] != c[1]) & (np.abs(third - c[2]) < 0.51) & (np.abs(third * ratio - c[3]) < 0.52), cascade._by_row("EXPONENTIAL", numeric.exponential))
    turns = (d[1:] != d[:-1]).view(np.uint8).sum(axis=0, dtype=np.int32)
    ask(small & (2 * (1 + turns) + 3 < n), cascade._delta_rle)
    maybe = np.zeros(len(m), bool)
    for mask in detect.MASKS:
        x = np.diff(c[:4] ^ np.int16(mask), axis=0)
        maybe |= (x[0] == x[1]) & (x[1] == x[2])
    ask(maybe, cascade._xor_mask)
    return t


def parameters(t: Tracks, same: int) -> tuple[list[int], list[float] | None]:
    """Parameters of the tracks with this ``same``; those of two words of four bytes are made only here."""
    if t.words is None or same in t.found:
        return t.found[same]
    first, second = t.words[same].tolist()
    return [4, 2, first, second - first], None


def _runs_and_repeats(m, c, runs, todo, t, mark, known) -> None:  # noqa: ANN001
    """RLE and REPEAT: the smaller one where both fire, the repeated period on equal size."""
    n, pieces = m.shape[1], runs.copy()
    some = np.flatnonzero(todo & (2 * runs < n))
    if n > 256 and len(some):  # runs over 255 are cut
        part = m[some]
        starts = np.flatnonzero(np.concatenate([np.ones((len(part), 1), bool), part[:, 1:] != part[:, :-1]], axis=1))
        longer = (np.diff(np.r_[starts, part.size]) - 1) // 255
        pieces[some] += np.bincount(starts // n, weights=longer, minlength=len(part)).astype(pieces.dtype)
        some = some[2 * pieces[some] < n]
    maybe = np.zeros(len(m), bool)
    for p in range(1, n // 3):
        maybe |= (c[p] == c[0]) & (c[p + 1] == c[1]) & (c[p + 2] == c[2]) & (c[n - 1] == c[n - 1 - p]) & (c[n - 2] == c[n - 2 - p])
    asked = np.flatnonzero(maybe & todo)
    mark(some, "RLE", 2 + 2 * pieces[some])
    for i, found in cascade._repeat(m[asked].astype(np.int64)) if len(asked) else ():
        i = asked[i]
        if todo[i] or found[3] <= t.cost[i]:
            _put(t, i, found, known)
            todo[i] = False


def _waves(m: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """Rows that a few Fourier components may give back."""
    n, maybe = m.shape[1], np.zeros(len(m), bool)
    most = min(n // 2, n // 4 - 1, (n - 5) // 18)
    rows = np.flatnonzero(todo)
    if most < 1 or not len(rows):
        return maybe
    if most == 1:  # a component as large as the sum of all values: at least every other one is zero
        maybe[rows] = 2 * (m[rows] == 0).sum(axis=1) >= n
        return maybe
    a = m[rows]
    f = np.fft.rfft(a, axis=1)
    e = f.real**2 + f.imag**2
    e[:, 1 : (n + 1) // 2] *= 2
    rest = e[:, 1:]
    clipped = ((a == 0) | (a == 255)).any(axis=1)
    # The largest of them hold at most sqrt(most * sum of squares), so the others at least what is left.
    dropped = (rest.sum(axis=1) - np.sqrt(most * (rest**2).sum(axis=1))) / n
    maybe[rows[~clipped & (dropped <= n / 4 + 1e-3)]] = True
    # Where values are clipped, errors may be larger there. What is dropped is orthogonal to what is kept, so its energy is its product
    # with the values: a half of each at most, nothing at 0. What is left by that is tried in a few places.
    cut = np.flatnonzero(clipped & (dropped <= a.sum(axis=1) / 2 + 1e-3 * n))
    g = f[cut]
    size = np.abs(g)
    top = np.argpartition(-size, most, axis=1)[:, : most + 1]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1), 1)
    ordered = np.take_along_axis(size, top, 1)
    unsure = (ordered[:, :-1] - ordered[:, 1:] <= 1e-9 * ordered[:, :1]).any(axis=1)
    place = np.arange(PROBES) * (n // PROBES) + np.arange(PROBES) % (n // PROBES)
    v, total, fits = a[cut][:, place].astype(float), np.zeros((len(cut), PROBES)), np.zeros(len(cut), bool)
    wave = np.exp(2j * np.pi * np.arange(n) / n)
    for k in range(most):
        b = top[:, k]
        part = np.take_along_axis(g, b[:, None], 1) * wave[b[:, None] * place % n]
        total += np.where((b == 0) | (2 * b == n), 1.0, 2.0)[:, None] * part.real / n
        fits |= (((total <= v + 0.5 + 1e-6) | (v == 255)) & ((total >= v - 0.5 - 1e-6) | (v == 0))).all(axis=1)
    maybe[rows[cut[unsure | fits]]] = True
    return maybe


@cache
def _polynomials(n: int) -> np.ndarray:
    return np.linalg.qr(np.polynomial.legendre.legvander(np.linspace(-1, 1, n), 8))[0]


def _smooth(m: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """Rows that a polynomial of degree 8 comes so near to that it may be off by a half at most in each place."""
    maybe, rows = np.zeros(len(m), bool), np.flatnonzero(todo)
    a = m[rows].astype(float)
    p = a @ _polynomials(m.shape[1])
    maybe[rows] = np.einsum("ij,ij->i", a, a) - np.einsum("ij,ij->i", p, p) <= m.shape[1] / 4 + 1e-2
    return maybe


def _differences(c: np.ndarray) -> np.ndarray:
    maybe, x = np.zeros(c.shape[1], bool), np.diff(c[:8].astype(np.int32), axis=0)
    for _ in (2, 3, 4):
        x = np.diff(x, axis=0)
        maybe |= (x[1:] == x[:1]).all(axis=0)
    return maybe


def _moduli(c: np.ndarray) -> np.ndarray:
    maybe, (b, x1, x2, x3) = np.zeros(c.shape[1], bool), c[:4].astype(np.int32)
    for mod in detect.MODULI:
        a = (x1 - b) % mod
        maybe |= (a != 0) & ((2 * a + b) % mod % 256 == x2) & ((3 * a + b) % mod % 256 == x3)
    return maybe


def _recurrent(c: np.ndarray) -> np.ndarray:
    """Rows whose first values fit some recurrence of two: the determinants of three neighbours, shifted, are zero modulo 256."""
    maybe, v = np.ones(c.shape[1], bool), c[:8].astype(np.uint8)
    for k in range(4):
        p, q, r, s, u = v[k : k + 5]
        maybe &= p * (r * u - s * s) - q * (q * u - s * r) + r * (q * s - r * r) == 0
    return maybe


def _pairs(t: Tracks, unit: np.ndarray):  # noqa: ANN202
    """Of each grouped pattern of a unit: (key, first row in ``order``, rows, least and largest parameter, largest cost, x and step even)."""
    rows = np.flatnonzero(GROUPED[t.code])
    order = rows[np.argsort(unit[rows] * KINDS + t.code[rows], kind="stable")]
    key = unit[order] * KINDS + t.code[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(order) else order
    n = np.diff(np.r_[starts, len(order)])
    plain = t.code[order] <= LINEAR
    value = np.where(plain, t.x[order] * 65536 + t.step[order], t.same[order])
    if not len(order):
        return key, order, starts, n, value, value, value, value.astype(bool)
    jump = np.r_[np.diff(t.x[order]), 0]
    last = starts + n - 1
    jump[last] = np.where(n > 1, jump[starts], 0)
    even = (np.minimum.reduceat(jump, starts) == np.maximum.reduceat(jump, starts)) & (np.minimum.reduceat(t.step[order], starts) == np.maximum.reduceat(t.step[order], starts))
    jump = jump[starts]
    # The step of a sequence of constants is kept in a byte.
    code = key[starts] % KINDS
    even &= (jump != 0) & ((code == LINEAR) | ((code == CONST) & (jump >= -128) & (jump <= 127)))
    return key[starts], order, starts, n, np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts), np.maximum.reduceat(t.cost[order], starts), even


def unit_sizes(t: Tracks, unit: np.ndarray, units: int) -> np.ndarray:
    """The estimated size of each unit (a whole signal or chunk) whose rows are here in the order of its tracks: ``search.sizes``."""
    key = unit * KINDS + t.code
    size = np.bincount(key, weights=t.cost + ENTRY_BYTES, minlength=units * KINDS)
    at, _, _, n, low, high, single, even = _pairs(t, unit)
    code = at % KINDS
    worth = np.where(code == CONST, 4 * n > 7 + 2 * n, np.where(code == LINEAR, 10 + 2 * n < 7 * n, 6 + 2 * n + single < n * (3 + single)))
    same = (n >= groups.LEAST) & (low == high) & worth
    fits = np.where(code == CONST, 8 + 2 * n < 4 * n, 12 + 2 * n < 7 * n)
    in_order = (n >= groups.LEAST) & (n <= groups.MOST_IN_SEQUENCE) & even & fits
    meta = np.where(same, 5 + 2 * n + single, 5 + 2 * n + np.where(code == CONST, 2, 6)) + ENTRY_BYTES
    size[at[same | in_order]] = meta[same | in_order]
    return size.reshape(units, KINDS).sum(axis=1).astype(np.int64)


def kinds(t: Tracks, unit: np.ndarray, track: np.ndarray) -> list[tuple]:
    """(unit, pattern, ints, reals, n, payload, single, track) of parts of signals, to be added up for ``groups.stats_of_kinds``.

    Parameters that can't be a sequence any more only have to show whether they differ: the first and another one stand for all."""
    out = []
    key = unit * KINDS + t.code
    at, place = np.unique(key, return_inverse=True)
    total, n = np.bincount(place, weights=t.cost), np.bincount(place)
    paid = dict(zip(at.tolist(), total.astype(np.int64).tolist()))
    for k, m in zip(at.tolist(), n.tolist()):
        if not GROUPED[k % KINDS]:
            out.append((k // KINDS, detect.ORDER[k % KINDS], None, None, m, paid[k], 0, 0))
    keys, order, starts, count, low, high, single, _ = _pairs(t, unit)
    for k, a, m, lo, hi, most in zip(keys.tolist(), starts.tolist(), count.tolist(), low.tolist(), high.tolist(), single.tolist()):
        u, code, rows = k // KINDS, k % KINDS, order[a : a + m]
        name, plain = detect.ORDER[code], code <= LINEAR
        value = t.x[rows] * 65536 + t.step[rows] if plain else t.same[rows]
        given = lambda i, plain=plain, code=code: (([int(t.x[i])] if code == CONST else [int(t.x[i]), int(t.step[i])]), []) if plain else parameters(t, int(t.same[i]))
        if plain and m <= groups.MOST_IN_SEQUENCE and len(np.unique(value)) == m:
            out += [(u, name, *given(i), 1, int(t.cost[i]), int(t.cost[i]), int(track[i])) for i in rows]
            continue
        ends = [rows[np.argmax(value == lo)]] + ([rows[np.argmax(value == hi)]] if lo != hi else [])
        for j, i in enumerate(ends):
            ints, reals = given(i)
            out.append((u, name, ints, reals or [], m - len(ends) + 1 if j == 0 else 1, paid[k] if j == 0 else 0, most, int(track[i])))
    return out
