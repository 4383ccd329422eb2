"""Inverse operators: encodings (s, pattern, ints, reals) back to values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfit.operators import detect, numeric

_SEQ = "sequence(0, s - 1)"
_WORD_BYTES = "transform(sequence(0, s - 1), i -> pmod(shiftright(w[i div {0}], cast(8 * (i % {0}) as int)), 256))"
_RUNS = "flatten(transform(sequence(0, size({0}) div 2 - 1), k -> array_repeat({0}[2 * k], cast({0}[2 * k + 1] as int))))"


def _running(first: str, steps: str) -> str:
    """Running sums of ``steps`` from ``first``: prefixes grow in an array state."""
    return f"aggregate({steps}, array(cast({first} as bigint)), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# Rules of reconstruction over ints and s, for integer patterns.
RULES: dict[str, str] = {
    "CONST": "array_repeat(ints[0], s)",
    "LINEAR": f"transform({_SEQ}, i -> pmod(ints[0] + i * ints[1], 256))",
    "RLE": f"slice({_RUNS.format('ints')}, 1, s)",
    "REPEAT": f"transform({_SEQ}, i -> ints[i % size(ints)])",
    "DELTA": f"transform({_running('ints[0]', 'slice(ints, 2, size(ints) - 1)')}, x -> pmod(x, 256))",
    "RAW": "ints",
    "LINEAR_WIDE": f"transform({_SEQ}, i -> pmod(shiftright(ints[2] + (i div cast(ints[0] as int)) * ints[3], cast(8 * (i % ints[0]) as int)), 256))",
    "DELTA_WIDE": _let("w", _running("ints[2]", "slice(ints, 4, size(ints) - 3)"), _WORD_BYTES.format(4)),
    "BIT_PACKED": "slice(ints, 2, s)",
    "XOR_MASK": f"transform({_SEQ}, i -> pmod(ints[2] + if(ints[1] = 0, 0, i * ints[3]), 256) ^ ints[0])",
    "SPARSE": f"transform({_SEQ}, i -> coalesce(get(filter(transform(sequence(0, (size(ints) - 1) div 2), k -> if(k > 0 and ints[2 * k - 1] = i, ints[2 * k], null)), x -> x is not null), 0), ints[0]))",
    "PIECEWISE_LINEAR": f"transform({_SEQ}, i -> element_at(filter(transform(sequence(0, size(ints) div 3 - 1), k -> if(ints[3 * k] <= i, ints[3 * k + 1] + (i - ints[3 * k]) * ints[3 * k + 2], null)), x -> x is not null), -1))",
    "MIRROR": "concat(ints, reverse(ints))",
    "INTERLEAVED_LINEAR": f"transform({_SEQ}, i -> pmod(if(i % 2 = 0, ints[1] + (i div 2) * ints[2], ints[3] + (i div 2) * ints[4]), 256))",
    "DELTA_RLE": f"slice({_running('ints[0]', _RUNS.format('slice(ints, 2, size(ints) - 1)'))}, 1, s)",
    "MOD_ARITH": f"transform({_SEQ}, i -> pmod((ints[0] * i + ints[1]) % ints[2], 256))",
    "FIBONACCI": "slice(aggregate(sequence(3, s), array(ints[0], ints[1]), (acc, i) -> concat(acc, array((ints[2] * element_at(acc, -1) + ints[3] * element_at(acc, -2)) % 256))), 1, s)",
    # Newton's forward differences from the first order + 1 values and the constant difference, exact in integers.
    "DIFF_TABLE": (
        f"transform({_SEQ}, i -> ints[1] + i * (ints[2] - ints[1]) + (i * (i - 1) div 2) * (ints[3] - 2 * ints[2] + ints[1])"
        " + if(ints[0] >= 3, (i * (i - 1) * (i - 2) div 6) * (ints[4] - 3 * ints[3] + 3 * ints[2] - ints[1]), 0)"
        " + if(ints[0] >= 4, (i * (i - 1) * (i - 2) * (i - 3) div 24) * ints[size(ints) - 1], 0))"
    ),
}


def integer_values() -> Column:
    """The values of integer patterns; null for float patterns."""
    out = F.lit(None)
    for name, rule in RULES.items():
        out = F.when(F.col("pattern") == name, F.expr(f"transform({rule}, q -> cast(q as int))")).otherwise(out)
    return out


def rebuild(encodings: DataFrame) -> DataFrame:
    """``encodings`` with their values ``v``, read once: float patterns are rebuilt in Arrow batches, which the others pass through untouched."""
    other = [c for c in encodings.columns if c != "v"]
    kinds = F.col("pattern").isin(*detect.FLOAT_PATTERNS)
    return numeric.rebuild_floats(encodings.select(*other)).withColumn("v", F.when(kinds, F.col("v")).otherwise(integer_values()))


def cells(rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, v) in long form."""
    return rebuilt.select(*keys, F.posexplode("v").alias("i", "v"))


def reassemble(rebuilt: DataFrame, length: Column, keys: list[str]) -> DataFrame:
    """(keys, pos, v) of the signal: track by track, cut to its length."""
    long = rebuilt.select(*keys, "s", "track", length.alias("_length"), F.posexplode("v").alias("i", "v"))
    return long.select(*keys, (F.col("track") * F.col("s") + F.col("i")).alias("pos"), "v", "_length").filter(F.col("pos") < F.col("_length")).drop("_length")


def missing_tracks(encodings: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, track) that should be there (``expected`` has keys and n_tracks) but have no encoding."""
    ids = expected.filter("n_tracks > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tracks").cast("long") - 1)).alias("track"))
    return ids.join(encodings.select(*keys, "track"), [*keys, "track"], "left_anti")
