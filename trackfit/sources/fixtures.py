"""Signal families over a table with a contiguous key: each reaches one pattern. They are stated once, for Spark or DuckDB."""

from __future__ import annotations

import math
import re
import struct

from pyspark.sql import DataFrame

from trackfit.functions.dialect import SPARK, Spark


def _recurrence(a: int, b: int, c1: int, c2: int, n: int) -> list[int]:
    out = [a, b]
    while len(out) < n:
        out.append((c1 * out[-1] + c2 * out[-2]) % 256)
    return out


def _slopes() -> list[int]:
    v, out = 64, [64]
    for slope in (1, -2, 3, -4, 5, -6, 7, -3, 2, -1, 4):
        for _ in range(11):
            v += slope
            out.append(v)
    return (out + [v] * 128)[:128]


def _doubles(values: list[float]) -> list[int]:
    return list(struct.pack(f"<{len(values)}d", *values))


def _float_steps() -> list[float]:
    v, out = 0.1, [0.1]
    for k in range(63):
        v += struct.unpack("<f", struct.pack("<f", (0.1, 0.37, 0.73, 0.05)[(k * k + 3 * k // 2) % 4]))[0]
        out.append(v)
    return out


#: Families that are lists of one track's values.
LISTS: dict[str, list[int]] = {
    "FIBONACCI": _recurrence(70, 90, 3, 2, 32),
    "SPARSE": [{2: 201, 5: 190, 8: 255, 12: 144, 15: 230, 19: 177, 23: 149, 28: 222}.get(i, 0) for i in range(32)],
    "EXPONENTIAL": [round(200 * 0.9**i) for i in range(16)],
    "DELTA_RLE": _slopes(),
    "XOR_MASK": [(i + 100) ^ 0xAA for i in range(64)],
    "LINEAR_F64": _doubles([1e6 + 60.0 * k for k in range(64)]),
    "DELTA_F64": _doubles(_float_steps()),
    "PERIODIC": [round(128 + 50 * math.sin(2 * math.pi * 2 * i / 64)) for i in range(64)],
}


def families(s: Spark = SPARK) -> dict[str, tuple[int, str]]:
    """Name: (track length, expression over i, the place in the track, and t, the track)."""
    scramble = lambda j: f"(({j}) * ({j}) * ({j}) * 31 + ({j}) * ({j}) * 17 + ({j}) * 101 + 13) % 256"
    word = f"(2147483648 + {s.div('i', 4)} * 50 + ({s.div('i', 4)} * {s.div('i', 4)} * 37) % 101)"
    byte = f"(case i % 4 when 0 then {word} when 1 then {s.div(word, 256)} when 2 then {s.div(word, 65536)} else {s.div(word, 16777216)} end) % 256"
    known = {
        "CONST": (64, "255"),
        "LINEAR": (64, "255 - i"),
        "RLE": (256, "case i when 10 then 200 when 50 then 255 when 200 then 180 else 0 end"),
        "REPEAT": (256, "((i % 45) * (i % 45) * 3 + (i % 45) * 7 + t) % 251"),
        "LINEAR_WIDE": (64, f"case when i % 2 = 0 then {s.div('i', 2)} else 100 + {s.div('i', 2)} end"),
        "DELTA_WIDE": (256, byte),
        "BIT_PACKED": (64, "(37 * i + 11 * i * i) % 64"),
        "DELTA": (64, "100 + (i * i * i * 13 + i * i * 7 + t) % 67 % 3"),
        "POLY": (32, "i * (31 - i)"),
        "DIFF_TABLE": (16, "i * i"),
        "MOD_ARITH": (64, "(7 * i + 3) % 200"),
        "MIRROR": (64, scramble("case when i < 32 then i else 63 - i end")),
        "PIECEWISE_LINEAR": (64, "case when i < 32 then i else 168 + i end"),
        "INTERLEAVED_LINEAR": (64, f"case when i % 2 = 0 then (10 + 9 * {s.div('i', 2)}) % 256 else (506 - 5 * {s.div('i', 2)}) % 256 end"),
        "RAW": (64, "(i * i * i * 7919 + i * i * 104729 + (t % 97) * 31 * i + i * 13 + t) % 65521 % 256"),
    }
    for name, values in LISTS.items():
        items = f"array({', '.join(map(str, values))})" if s.name == "spark" else f"[{', '.join(map(str, values))}]"
        known[name] = (len(values), s.at(items, "i"))
    return known


def cells(events: DataFrame, names: list[str], near_miss: bool = True) -> DataFrame:
    """(family, n, track, i, v) for each event and family, from one scan of ``events``. In every fifth track one value is changed: the near miss."""
    rows = []
    for name in names:
        n, value = families(SPARK)[name]
        place, track = f"(event_id % {n})", f"(event_id div {n})"
        v = "cast(" + re.sub(r"\b[it]\b", lambda m: place if m[0] == "i" else track, value) + " as int)"
        if near_miss:
            v = f"if({track} % 5 = 4 and {place} = {n // 2 + 1}, {SPARK.xor(v, 5)}, {v})"
        rows.append(f"struct('{name}' as family, {n} as n, {track} as track, {place} as i, {v} as v)")
    return events.select("event_id").selectExpr(f"inline(array({', '.join(rows)}))")


def cells_sql(s: Spark, names: list[str], near_miss: bool = True) -> str:
    """The same in SQL, a select for each family."""
    parts = []
    for name in names:
        n, value = families(s)[name]
        spoilt = f"case when t % 5 = 4 and i = {n // 2 + 1} then {s.xor(f'cast({value} as int)', 5)} else cast({value} as int) end" if near_miss else f"cast({value} as int)"
        parts.append(f"select '{name}' as family, {n} as n, t as track, i, {spoilt} as v from (select event_id % {n} as i, {s.div('event_id', n)} as t from events)")
    return " union all ".join(parts)
