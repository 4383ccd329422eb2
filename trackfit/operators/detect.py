"""Exact pattern detectors over tracks: a track ``v`` is an array of n integers from 0 to 255.

Every rule is an expression over ``v``, ``n`` and ``d`` (first differences) from ``functions.dialect``. A rule states when it
fires, its integer parameters and its payload cost in bytes. Rules that need float arithmetic are in ``numeric``.

Parameter layouts (``ints``): CONST [value]; LINEAR [start, step]; RLE [value, count, ...]; REPEAT the period;
LINEAR_WIDE [width, count, start, step]; DELTA_WIDE [width, delta width, start, deltas...]; BIT_PACKED [bits, values...];
DELTA [start, deltas...]; DIFF_TABLE [order, first order + 1 values, difference]; MOD_ARITH [a, b, m];
FIBONACCI [seed, seed, c1, c2]; MIRROR the first half; SPARSE [fill, place, value, ...]; PIECEWISE_LINEAR [place, start,
step, ...]; INTERLEAVED_LINEAR [count, start, step, start, step]; DELTA_RLE [start, delta, count, ...]; XOR_MASK [mask, inner
tag, inner parameters...]; RAW the values. A track that is all of it zero padding is an ordinary track.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfit.functions.dialect import SPARK, Spark

# Tags of the patterns, as stored.
TAGS = {
    "CONST": 0, "LINEAR": 1, "RLE": 2, "REPEAT": 3, "DELTA": 4, "PERIODIC": 5, "POLY": 6, "RAW": 7, "LINEAR_WIDE": 9, "LINEAR_F64": 10, "DELTA_F64": 11,
    "XOR_MASK": 13, "SPARSE": 14, "PIECEWISE_LINEAR": 15, "MIRROR": 16, "INTERLEAVED_LINEAR": 17, "EXPONENTIAL": 18, "DELTA_RLE": 19, "BIT_PACKED": 20,
    "DIFF_TABLE": 21, "MOD_ARITH": 22, "FIBONACCI": 23, "DELTA_WIDE": 24,
}
# The order in which the first match wins.
ORDER = [
    "CONST", "LINEAR", "RLE", "REPEAT", "LINEAR_WIDE", "LINEAR_F64", "DELTA_F64", "DELTA_WIDE", "BIT_PACKED", "DELTA", "PERIODIC", "POLY", "DIFF_TABLE",
    "MOD_ARITH", "FIBONACCI", "MIRROR", "SPARSE", "PIECEWISE_LINEAR", "INTERLEAVED_LINEAR", "EXPONENTIAL", "DELTA_RLE", "XOR_MASK", "RAW",
]
FLOAT_PATTERNS = ("LINEAR_F64", "DELTA_F64", "PERIODIC", "POLY", "EXPONENTIAL")
#: Patterns behind the gate: tracks of more than 200 different values skip them.
GATED = ORDER[ORDER.index("PERIODIC") : ORDER.index("RAW")]
GATE_KINDS = 200
MODULI = [256, 128, 64, 32, 16, 100, 200, 255]
MASKS = [0xFF, 0xAA, 0x55, 0x0F, 0xF0]


@dataclass(frozen=True)
class Rule:
    name: str
    fires: str
    ints: str
    cost: str


def _first(s: Spark, items: str) -> str:
    return s.at(items, 0)


def words(s: Spark, width: int) -> str:
    """Little-endian words of ``width`` bytes."""
    value = " + ".join(f"{s.big(s.at('v', f'{width} * k + {j}'))} * {1 << 8 * j}" for j in range(width))
    return s.each(s.seq(0, f"{s.div('n', width)} - 1"), "k", value)


def differences(s: Spark, items: str) -> str:
    return s.diff(items)


def run_starts(s: Spark, items: str) -> str:
    return s.keep(s.seq(0, f"{s.size(items)} - 1"), "i", f"i = 0 or {s.at(items, 'i')} <> {s.at(items, 'i - 1')}")


def runs(s: Spark, items: str, starts: str) -> str:
    """[value, count, ...] of runs, each cut at 255."""
    size = s.size(items)
    nexts = s.join(s.part(starts, 1, f"{s.size(starts)} - 1"), f"{s.make(size)}" if s.name == "duck" else f"array(cast({size} as int))")
    length = f"({s.at(nexts, 'r')} - {s.at(starts, 'r')})"
    piece = f"case when {length} - 255 * c < 255 then {length} - 255 * c else 255 end"
    cut = s.flat(s.each(s.seq(0, f"{s.div(f'{length} - 1', 255)}"), "c", s.make(s.at(items, s.at(starts, "r")), piece)))
    return s.flat(s.each(s.seq(0, f"{s.size(starts)} - 1"), "r", cut))


def bound_runs(s: Spark, items: str) -> str:
    return s.let("rv", items, s.let("rs", run_starts(s, "rv"), runs(s, "rv", "rs")))


def rules(s: Spark = SPARK) -> dict[str, Rule]:
    """Rules over the columns v, n, d, w4, w2 (words), dd, d3, d4 (higher differences), rl and dl (runs of v and of d)."""
    v0 = s.at("v", 0)
    constant = lambda items: f"({s.size(items)} > 0 and {s.least(items)} = {s.most(items)})"
    found = []

    def rule(name: str, fires: str, ints: str, cost: str) -> None:
        found.append(Rule(name, f"coalesce({fires}, false)", ints, cost))

    rule("CONST", f"{s.least('v')} = {s.most('v')}", s.make(v0), "1")
    rule("LINEAR", f"n >= 2 and {constant('d')}", s.make(v0, s.at("d", 0)), "4")
    rule("RLE", f"{s.size('rl')} < n", "rl", f"2 + {s.size('rl')}")
    period = _first(s, s.keep(s.seq(1, f"{s.div('n', 3)} - 1"), "p", f"{s.part('v', 0, 'n - p')} = {s.part('v', 'p', 'n - p')}"))
    rule("REPEAT", f"{period} is not null", s.longs(s.part("v", 0, period)), f"2 + {period}")
    four, two = "(n >= 8 and n % 4 = 0 and {})", "(n >= 4 and n % 2 = 0 and {})"
    flat4, flat2 = four.format(constant("d_w4")), two.format(constant("d_w2"))
    wide = lambda w, width: s.make(width, s.size(w), s.at(w, 0), f"{s.at(w, 1)} - {s.at(w, 0)}")
    rule("LINEAR_WIDE", f"{flat4} or {flat2}", f"case when {flat4} then {wide('w4', 4)} else {wide('w2', 2)} end", "19")
    within = lambda items, low, high: f"({s.least(items)} >= {low} and {s.most(items)} <= {high})"
    steps = s.size("d_w4")
    narrow = f"({within('d_w4', -128, 127)} and (6 + {steps}) * 4 < 3 * n)"
    broad = f"({within('d_w4', -32768, 32767)} and (6 + 2 * {steps}) * 4 < 3 * n)"
    rule(
        "DELTA_WIDE", four.format(f"({narrow} or {broad})"),
        s.join(s.make(4, f"case when {narrow} then 1 else 2 end", s.at("w4", 0)), s.longs("d_w4")), f"case when {narrow} then 6 + {steps} else 6 + 2 * {steps} end",
    )
    top = s.most("v")
    bits = f"(case {' '.join(f'when {top} < {1 << b} then {b}' for b in range(1, 8))} else 8 end)"
    packed = f"(1 + {s.div(f'n * {bits} + 7', 8)})"
    rule("BIT_PACKED", f"n >= 8 and {bits} < 7 and {packed} < n", s.join(s.make(bits), s.longs("v")), packed)
    rule("DELTA", f"n >= 2 and {within('d', -128, 127)} and {s.kinds('d')} <= 8", s.join(s.make(v0), s.longs("d")), "n + 1")
    order = f"(case when 8 < n and {constant('dd')} then 2 when 9 < n and {constant('d3')} then 3 when 10 < n and {constant('d4')} then 4 end)"
    last = f"(case {order} when 2 then {s.at('dd', 0)} when 3 then {s.at('d3', 0)} else {s.at('d4', 0)} end)"
    rule("DIFF_TABLE", f"n >= 8 and {order} is not null", s.join(s.make(order), s.longs(s.part("v", 0, f"{order} + 1")), s.make(last)), f"6 + {order}")
    a_of = lambda m: s.mod(f"{s.at('v', 1)} - {v0}", m)
    every = lambda cond: s.every(s.seq(0, "n - 1"), "i", cond)
    modulus = f"(case {' '.join(f'when {a_of(m)} <> 0 and ' + every(f'{s.at("v", "i")} = (({a_of(m)} * i + {v0}) % {m}) % 256') + f' then {m}' for m in MODULI)} end)"
    rule("MOD_ARITH", f"n >= 8 and {modulus} is not null", s.make(s.mod(f"{s.at('v', 1)} - {v0}", modulus), v0, modulus), "6")
    step = lambda i: f"(({s.div('k', 17)}) * {s.at('v', f'{i} - 1')} + (k % 17) * {s.at('v', f'{i} - 2')}) % 256"
    # The coefficients that explain the third and fourth value are few; only they are tried on the whole track.
    likely = s.keep(s.seq(1, 288), "k", f"k <> 17 and {s.at('v', 2)} = {step('2')} and {s.at('v', 3)} = {step('3')}")
    pair = _first(s, s.keep(likely, "k", s.every(s.seq(2, "n - 1"), "i", f"{s.at('v', 'i')} = {step('i')}")))
    rule("FIBONACCI", f"n >= 8 and {pair} is not null", s.make(v0, s.at("v", 1), s.div(pair, 17), f"({pair}) % 17"), "4")
    rule("MIRROR", f"n >= 8 and n % 2 = 0 and {s.reverse('v')} = v", s.longs(s.part("v", 0, s.div("n", 2))), s.div("n", 2))
    # A value that fills three quarters of a track is its median.
    fill = s.at(s.sort("v"), s.div("n", 2))
    others = s.keep(s.seq(0, "n - 1"), "i", f"{s.at('v', 'i')} <> {fill}")
    count = s.size(others)
    rule("SPARSE", f"n >= 8 and 4 * (n - {count}) >= 3 * n and 3 + 3 * {count} < n", s.join(s.make(fill), s.flat(s.each(others, "o", s.make("o", s.at("v", "o"))))), f"3 + 3 * {count}")

    def segments(k: int) -> tuple[str, str]:
        size = s.div("n", k)
        starts = [f"{j} * {size}" for j in range(k)]
        lengths = [f"({size})"] * (k - 1) + [f"(n - {k - 1} * {size})"]
        straight = " and ".join(constant(s.part("d", a, f"{m} - 1")) for a, m in zip(starts, lengths))
        return f"({size} >= 4 and {1 + 6 * k} < n and {straight})", s.make(*[x for a in starts for x in (a, s.at("v", a), s.at("d", a))])

    parts = {k: segments(k) for k in (2, 3, 4)}
    pieces = f"(case {' '.join(f'when {cond} then {k}' for k, (cond, _) in parts.items())} end)"
    rule("PIECEWISE_LINEAR", f"n >= 16 and {pieces} is not null", f"(case {pieces} {' '.join(f'when {k} then {ints}' for k, (_, ints) in parts.items())} end)", f"1 + 6 * {pieces}")
    strand = lambda j: f"{s.at('v', f'2 * i + {j}')} = {s.mod(f'{s.at("v", j)} + i * ({s.at("v", j + 2)} - {s.at("v", j)})', 256)}"
    rule(
        "INTERLEAVED_LINEAR", f"n > 10 and n % 2 = 0 and {s.every(s.seq(0, f'{s.div("n", 2)} - 1'), 'i', f'{strand(0)} and {strand(1)}')}",
        s.make(s.div("n", 2), v0, f"{s.at('v', 2)} - {v0}", s.at("v", 1), f"{s.at('v', 3)} - {s.at('v', 1)}"), "10",
    )
    half = s.div(s.size("dl"), 2)
    rule("DELTA_RLE", f"n >= 8 and {within('d', -128, 127)} and 3 + {s.size('dl')} < n and {s.size('dl')} < n - 1", s.join(s.make(v0), "dl"), f"3 + 2 * {half}")
    masked = lambda m: s.each("v", "x", s.xor("x", m))
    slope = lambda m: s.each(s.seq(1, "n - 1"), "i", f"{s.xor(s.at('v', 'i'), m)} - {s.xor(s.at('v', 'i - 1'), m)}")
    flat_at = lambda m: f"(n > 3 and {s.least(masked(m))} = {s.most(masked(m))})"
    mask = f"(case {' '.join(f'when {flat_at(m)} or (n > 6 and {constant(slope(m))}) then {m}' for m in MASKS)} end)"
    inner = f"(case {mask} {' '.join(f'when {m} then case when {flat_at(m)} then {s.make(m, 0, s.xor(v0, m))} else {s.make(m, 1, s.xor(v0, m), s.at(slope(m), 0))} end' for m in MASKS)} end)"
    rule("XOR_MASK", f"n >= 8 and {mask} is not null", inner, f"2 + case when {s.size(inner)} = 3 then 1 else 4 end")
    rule("RAW", "true", s.longs("v"), "n")
    return {r.name: r for r in found}


def helpers(s: Spark = SPARK) -> list[dict[str, str]]:
    """Columns that rules share, in steps that build on each other."""
    return [
        {"n": s.size("v"), "d": differences(s, "v"), "w4": words(s, 4), "w2": words(s, 2), "rl": bound_runs(s, "v")},
        {"dd": differences(s, "d"), "d_w4": differences(s, "w4"), "d_w2": differences(s, "w2"), "dl": bound_runs(s, "d")},
        {"d3": differences(s, "dd")},
        {"d4": differences(s, "d3")},
    ]


HELPERS = [c for step in helpers() for c in step if c != "n"]


def prepare(tracks: DataFrame) -> DataFrame:
    """Add the columns that the rules read."""
    for step in helpers():
        tracks = tracks.withColumns({k: F.expr(e) for k, e in step.items()})
    return tracks


def detect(tracks: DataFrame, pattern: str) -> DataFrame:
    """The operator of one integer pattern: fires, ints and cost (null where it doesn't fire) for each track."""
    r = rules()[pattern]
    out = prepare(tracks).withColumn("fires", F.expr(r.fires))
    return out.withColumns({"ints": F.when(F.col("fires"), F.expr(r.ints)), "cost": F.when(F.col("fires"), F.expr(r.cost).cast("long"))}).drop(*HELPERS)


def all_matches(tracks: DataFrame) -> DataFrame:
    """One row per track and integer pattern that fires, with its cost."""
    table = rules()
    fires = F.array(*[F.when(F.expr(r.fires), F.struct(F.lit(n).alias("pattern"), F.expr(r.cost).cast("long").alias("cost"))) for n, r in table.items()])
    return prepare(tracks).withColumn("m", F.explode(F.filter(fires, lambda x: x.isNotNull()))).select("*", "m.pattern", "m.cost").drop("m", *HELPERS)
