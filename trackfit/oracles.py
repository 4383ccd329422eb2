"""DuckDB SQL that states what the registered queries return, from the rules themselves."""

from __future__ import annotations

from trackfit.functions.dialect import DUCK
from trackfit.operators import detect
from trackfit.sources import fixtures

CAST = "CAST({} AS BIGINT)"


def family_tracks(names: list[str], near_miss: bool = True) -> str:
    return (
        f"cells AS ({fixtures.cells_sql(DUCK, names, near_miss)}), "
        "tracks AS (SELECT family, CAST(n AS BIGINT) AS n, track, list_resize(list(CAST(v AS INTEGER) ORDER BY i), n, 0) AS v FROM cells GROUP BY family, n, track)"
    )


def prepared(source: str, name: str = "ready") -> str:
    """``source`` has v and n; adds the columns that the rules read."""
    inner = source
    for step in detect.helpers(DUCK):
        columns = ", ".join(f"{e} AS {k}" for k, e in step.items() if k != "n")
        inner = f"(SELECT *, {columns} FROM {inner})"
    return f"{name} AS (SELECT * FROM {inner})"


#: The doubles of a track, from their bits, and the rules over them by hand. Infinities and what is no number are null.
_BYTE = "CAST(v[8 * k + {0}] AS BIGINT)"
_EXPONENT = f"(({_BYTE.format(8)} % 128) * 16 + {_BYTE.format(7)} // 16)"
_MANTISSA = f"({_BYTE.format(7)} % 16 * {1 << 48} + " + " + ".join(f"{_BYTE.format(j + 1)} * {1 << 8 * j}" for j in range(6)) + ")"
_DOUBLE = f"CASE WHEN {_EXPONENT} = 2047 THEN NULL ELSE (CASE WHEN {_BYTE.format(8)} >= 128 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN {_EXPONENT} = 0 THEN {_MANTISSA}::DOUBLE * pow(2.0::DOUBLE, -1074) ELSE (1.0::DOUBLE + {_MANTISSA}::DOUBLE / {1 << 52}::DOUBLE) * pow(2.0::DOUBLE, {_EXPONENT} - 1023) END) END"
_DOUBLES = f"list_transform(range(CASE WHEN n % 8 = 0 THEN n // 8 ELSE 0 END), lambda k: {_DOUBLE})"
_SINGLE = "CAST(TRY_CAST(w8[j + 1] - w8[j] AS FLOAT) AS DOUBLE)"
FLOAT_RULES = {
    "LINEAR_F64": "n > 18 AND n % 8 = 0 AND len(list_filter(range(len(w8)), lambda i: NOT coalesce(w8[1] + i * (w8[2] - w8[1]) = w8[i + 1], false))) = 0 "
    "AND len(list_filter(range(2, len(w8)), lambda j: NOT coalesce(abs(w8[j + 1] - w8[j] - (w8[2] - w8[1])) <= abs(w8[2] - w8[1]) * 1e-12::DOUBLE + 1e-15::DOUBLE, false))) = 0",
    "DELTA_F64": "n >= 16 AND n % 8 = 0 AND 10 + 4 * (n // 8 - 1) < n "
    f"AND len(list_filter(range(1, len(w8)), lambda j: NOT coalesce(abs(w8[j + 1] - w8[j]) <= 3.4e38::DOUBLE AND abs({_SINGLE} - (w8[j + 1] - w8[j])) <= abs(w8[j + 1] - w8[j]) * 1e-6::DOUBLE + 1e-30::DOUBLE AND w8[j] + {_SINGLE} = w8[j + 1], false))) = 0",
}
FLOAT_COSTS = {"LINEAR_F64": "18", "DELTA_F64": "10 + 4 * (n // 8 - 1)"}


def cascade(source: str, name: str = "enc") -> str:
    """CTEs that add pattern, ints and cost by the rules in order, those of doubles among them. Signals here reach no other float
    pattern (PERIODIC, POLY, EXPONENTIAL)."""
    r = detect.rules(DUCK)
    whens = []
    for p in detect.ORDER:
        if p in FLOAT_RULES:
            whens.append(f"WHEN {FLOAT_RULES[p]} THEN '{p}'")
        if p in detect.FLOAT_PATTERNS or p == "REPEAT":
            continue
        if p == "RLE":
            whens.append(f"WHEN {r['RLE'].fires} THEN CASE WHEN {r['REPEAT'].fires} AND {r['REPEAT'].cost} <= {r['RLE'].cost} THEN 'REPEAT' ELSE 'RLE' END WHEN {r['REPEAT'].fires} THEN 'REPEAT'")
        elif p in detect.GATED:
            whens.append(f"WHEN kinds <= {detect.GATE_KINDS} AND {r[p].fires} THEN '{p}'")
        else:
            whens.append(f"WHEN {r[p].fires} THEN '{p}'")
    named = f"(SELECT *, CASE {' '.join(whens)} END AS pattern FROM (SELECT *, len(list_distinct(v)) AS kinds, {_DOUBLES} AS w8 FROM ready))"
    # The first two doubles are the start and step of an even sequence.
    ints = " ".join(f"WHEN '{p}' THEN {r[p].ints}" for p in r) + " WHEN 'LINEAR_F64' THEN list_transform(list_slice(v, 1, 16), lambda q: CAST(q AS BIGINT))"
    cost = " ".join(f"WHEN '{p}' THEN {c}" for p, c in ({p: r[p].cost for p in r} | FLOAT_COSTS).items())
    return f"{prepared(source)}, {name} AS (SELECT *, CASE pattern {ints} END AS ints, CAST(CASE pattern {cost} END AS BIGINT) AS cost FROM {named})"


def cheapest(source: str) -> str:
    r = detect.rules(DUCK)
    options = ", ".join(f"CASE WHEN {r[p].fires} THEN {{'cost': CAST({r[p].cost} AS BIGINT), 'k': {k}, 'pattern': '{p}'}} END" for k, p in enumerate(detect.ORDER) if p in r)
    return f"{prepared(source)}, enc AS (SELECT *, list_min(list_filter([{options}], lambda o: o IS NOT NULL)) AS best FROM ready)"


def detector(pattern: str) -> str:
    """Statements of some patterns are written by hand over cells (family, track, n, i, v); those of the others are rendered from the rule."""
    tracks = family_tracks(list(dict.fromkeys([pattern, "RAW"])))
    if pattern in BY_HAND:
        return (
            f"WITH {tracks}, x AS (SELECT family, track, n, unnest(v) AS v, unnest(range(n)) AS i FROM tracks), {BY_HAND[pattern]} "
            "SELECT t.family, CAST(t.track AS BIGINT) AS track, h.params IS NOT NULL AS fires, coalesce(h.params, '') AS params, CAST(coalesce(h.cost, -1) AS BIGINT) AS cost FROM tracks t LEFT JOIN hit h USING (family, track)"
        )
    r = detect.rules(DUCK)[pattern]
    return (
        f"WITH {tracks}, {prepared('tracks')} "
        f"SELECT family, CAST(track AS BIGINT) AS track, {r.fires} AS fires, CASE WHEN {r.fires} THEN array_to_string({r.ints}, ',') ELSE '' END AS params, CAST(CASE WHEN {r.fires} THEN {r.cost} ELSE -1 END AS BIGINT) AS cost FROM ready"
    )


#: hit (family, track, params, cost) of patterns, in windows, joins and aggregates: nothing here comes from ``operators.detect``.
BY_HAND = {
    "RLE": """
s AS (SELECT *, sum(c) OVER (PARTITION BY family, track ORDER BY i) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY family, track ORDER BY i) THEN 0 ELSE 1 END AS c FROM x)),
r AS (SELECT family, track, n, run, v, count(*) AS len FROM s GROUP BY ALL),
p AS (SELECT *, unnest(range((len + 254) // 255)) AS c FROM r),
hit AS (SELECT family, track, string_agg(concat(v, ',', least(255, len - 255 * c)), ',' ORDER BY run, c) AS params, 2 + 2 * count(*) AS cost FROM p GROUP BY family, track, n HAVING 2 * count(*) < n)""",
    "REPEAT": """
k AS (SELECT family, track, n, unnest(range(1, n // 3)) AS p FROM tracks),
ok AS (SELECT k.family, k.track, k.p FROM k JOIN x a ON a.family = k.family AND a.track = k.track AND a.i >= k.p JOIN x b ON b.family = a.family AND b.track = a.track AND b.i = a.i - k.p GROUP BY ALL HAVING bool_and(a.v = b.v)),
best AS (SELECT family, track, min(p) AS p FROM ok GROUP BY ALL),
hit AS (SELECT family, track, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS params, 2 + p AS cost FROM best JOIN x USING (family, track) WHERE i < p GROUP BY family, track, p)""",
    "PIECEWISE_LINEAR": """
k AS (SELECT family, track, n, i, v, q, least(i // (n // q), q - 1) AS seg FROM x, (SELECT unnest([2, 3, 4]) AS q) WHERE n >= 16 AND n // q >= 4 AND 1 + 6 * q < n),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY family, track, q, seg ORDER BY i) AS step FROM k),
s AS (SELECT family, track, q, seg, min(i) AS place, arg_min(v, i) AS first, min(step) AS step, count(DISTINCT step) AS kinds FROM d GROUP BY family, track, q, seg),
g AS (SELECT family, track, q, string_agg(concat_ws(',', place, first, step), ',' ORDER BY seg) AS params FROM s GROUP BY family, track, q HAVING max(kinds) = 1 AND min(kinds) = 1),
hit AS (SELECT family, track, arg_min(params, q) AS params, 1 + 6 * min(q) AS cost FROM g GROUP BY family, track)""",
    "FIBONACCI": """
y AS (SELECT family, track, i, v, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b FROM x WHERE n >= 8 WINDOW w AS (PARTITION BY family, track ORDER BY i)),
c AS (SELECT c1.range AS c1, c2.range AS c2 FROM range(17) c1, range(17) c2 WHERE NOT (c2.range = 0 AND c1.range <= 1)),
ok AS (SELECT family, track, c1, c2 FROM y, c WHERE i >= 2 GROUP BY ALL HAVING bool_and(v = (c1 * a + c2 * b) % 256)),
one AS (SELECT family, track, min(c1 * 17 + c2) AS k FROM ok GROUP BY family, track),
hit AS (SELECT o.family, o.track, concat_ws(',', p.v, q.v, k // 17, k % 17) AS params, 4 AS cost FROM one o JOIN x p ON p.family = o.family AND p.track = o.track AND p.i = 0 JOIN x q ON q.family = o.family AND q.track = o.track AND q.i = 1)""",
    "MOD_ARITH": """
f AS (SELECT family, track, n, max(v) FILTER (WHERE i = 0) AS b, max(v) FILTER (WHERE i = 1) AS w FROM x GROUP BY family, track, n HAVING n >= 8),
m AS (SELECT family, track, k, m, b, ((w - b) % m + m) % m AS a FROM f, (SELECT unnest([256, 128, 64, 32, 16, 100, 200, 255]) AS m, unnest(range(8)) AS k)),
ok AS (SELECT m.family, m.track, m.k, m.m, m.a, m.b FROM m JOIN x USING (family, track) WHERE m.a <> 0 GROUP BY ALL HAVING bool_and(x.v = ((m.a * x.i + m.b) % m.m) % 256)),
hit AS (SELECT family, track, arg_min(concat_ws(',', a, b, m), k) AS params, 6 AS cost FROM ok GROUP BY family, track)""",
    "XOR_MASK": """
z AS (SELECT family, track, i, k, m, xor(v, m) AS u FROM x, (SELECT unnest([255, 170, 85, 15, 240]) AS m, unnest(range(5)) AS k) WHERE n >= 8),
d AS (SELECT *, u - lag(u) OVER (PARTITION BY family, track, k ORDER BY i) AS step FROM z),
s AS (SELECT family, track, k, m, arg_min(u, i) AS first, min(step) AS low, max(step) AS high FROM d GROUP BY family, track, k, m),
hit AS (SELECT family, track, arg_min(CASE WHEN low = 0 THEN concat_ws(',', m, 0, first) ELSE concat_ws(',', m, 1, first, low) END, k) AS params, arg_min(CASE WHEN low = 0 THEN 3 ELSE 6 END, k) AS cost FROM s WHERE low = high GROUP BY family, track)""",
}


def float_detector(pattern: str) -> str:
    """Closed form: the family's tracks fire but for the near misses and a last track that padding has changed."""
    n = fixtures.families(DUCK)[pattern][0]
    return (
        f"WITH t AS (SELECT event_id // {n} AS track, count(*) AS m FROM events GROUP BY 1) "
        f"SELECT '{pattern}' AS family, CAST(track AS BIGINT) AS track, track % 5 <> 4 AND m = {n} AS fires FROM t"
    )


def signals_sql() -> str:
    """Real and made signals (blob, pos, v) over tables with contiguous keys. Every event is in one of the signals stairs/k, in one of ramps/k and in filled."""
    return (
        "SELECT 'prices' AS blob, CAST(p_partkey AS BIGINT) AS pos, CAST(CAST(round(p_retailprice * 10) AS BIGINT) % 256 AS INT) AS v FROM part "
        "UNION ALL SELECT 'totals', CAST(o_orderkey AS BIGINT), CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 256 AS INT) FROM orders "
        "UNION ALL SELECT concat('stairs/', event_id // 4096), CAST(event_id % 4096 AS BIGINT), CAST((event_id // 64) % 256 AS INT) FROM events "
        "UNION ALL SELECT concat('ramps/', event_id // 8192), CAST(event_id % 8192 AS BIGINT), CAST((event_id % 8192) // 64 + event_id % 64 AS INT) FROM events "
        "UNION ALL SELECT 'filled', CAST(event_id AS BIGINT), 255 FROM events"
    )


def geometry(sizes: list[int], signals: str = "") -> str:
    """CTEs sig, tracks and enc (and more) of ``signals`` (blob, pos, v), at each of the track lengths."""
    return (
        f"sig AS ({signals or signals_sql()}), wide AS (SELECT *, CAST(unnest({sizes}) AS BIGINT) AS s FROM sig), "
        "tracks AS (SELECT blob, s, s AS n, pos // s AS track, list_resize(list(CAST(v AS INTEGER) ORDER BY pos), s, 0) AS v FROM wide GROUP BY blob, s, pos // s), "
        + cascade("tracks")
    )


META = """
g AS (SELECT blob, s, pattern, count(*) AS n, min(ints) AS low, max(ints) AS high, max(cost) AS c, list(ints[1] ORDER BY track) AS x, list(ints[2] ORDER BY track) AS y
      FROM enc WHERE pattern IN ('CONST', 'LINEAR', 'REPEAT', 'LINEAR_WIDE', 'LINEAR_F64') GROUP BY blob, s, pattern HAVING count(*) >= 4),
g2 AS (SELECT *, low = high AS same, x[2] - x[1] AS dx,
      len(list_filter(range(2, len(x) + 1), lambda k: x[k] - x[k - 1] <> x[2] - x[1])) = 0 AS even, list_min(y) = list_max(y) AS one_step FROM g),
meta AS (
  SELECT blob, s, pattern, 'AllSame' AS kind, n, low AS params, 5 + 2 * n + c AS meta_size FROM g2 WHERE same AND CASE pattern WHEN 'CONST' THEN 4 * n > 7 + 2 * n WHEN 'LINEAR' THEN 10 + 2 * n < 7 * n ELSE 6 + 2 * n + c < n * (3 + c) END
  UNION ALL SELECT blob, s, pattern, 'ConstLinear', n, [x[1], dx], 5 + 2 * n + 2 FROM g2 WHERE NOT same AND pattern = 'CONST' AND even AND dx BETWEEN -128 AND 127 AND 8 + 2 * n < 4 * n
  UNION ALL SELECT blob, s, pattern, 'LinearStartsLinear', n, [x[1], dx, y[1]], 5 + 2 * n + 6 FROM g2 WHERE NOT same AND pattern = 'LINEAR' AND even AND one_step AND 12 + 2 * n < 7 * n)
"""

SIZES = """
sizes AS (SELECT blob, s, CAST(sum(x) AS BIGINT) AS est_size FROM (
  SELECT e.blob, e.s, e.cost + 3 AS x FROM enc e ANTI JOIN meta m ON e.blob = m.blob AND e.s = m.s AND e.pattern = m.pattern
  UNION ALL SELECT blob, s, meta_size + 3 FROM meta) GROUP BY blob, s)
"""


def modes(always: list[int], chunks: list[int]) -> str:
    """CTEs up to ``modes`` (blob, mode, setting, est_size): each variant of each signal written out, and its best track length."""
    variants = f"""WITH sig0 AS ({signals_sql()}), {scores("sig0")}, cand AS ({candidates(always)}),
full_sig AS (SELECT blob, length, stride, pos, v FROM sig0 JOIN l USING (blob) JOIN cand USING (blob) UNION ALL SELECT blob, length, stride, unnest(range(length, (length + stride - 1) // stride * stride)), 0 FROM l JOIN cand USING (blob))
SELECT concat_ws('|', blob, 'plain', 0, 0) AS blob, pos, v FROM sig0
UNION ALL SELECT concat_ws('|', blob, 'stride', stride, 0), pos % stride * ((length + stride - 1) // stride) + pos // stride, v FROM full_sig
UNION ALL SELECT concat_ws('|', blob, 'chunk', chunk, pos // chunk), pos % chunk, v FROM sig0 JOIN l USING (blob), (SELECT CAST(unnest({chunks}) AS BIGINT) AS chunk) WHERE chunk < length"""
    return (
        "WITH " + geometry([8, 16, 32, 64, 128, 256, 512], variants) + f", {META}, {SIZES}, least_size AS (SELECT blob, min(est_size) AS est_size FROM sizes GROUP BY blob), "
        "modes AS (SELECT split_part(blob, '|', 1) AS blob, split_part(blob, '|', 2) AS mode, CAST(split_part(blob, '|', 3) AS BIGINT) AS setting, "
        "CAST(sum(est_size) + max(CASE WHEN split_part(blob, '|', 2) = 'stride' THEN 10 ELSE 0 END) AS BIGINT) AS est_size FROM least_size GROUP BY 1, 2, 3)"
    )


def scores(sig: str) -> str:
    """CTEs l (blob, length) and sc (blob, stride, matches, pairs) of a signal CTE."""
    return f"""l AS (SELECT blob, count(*) AS length FROM {sig} GROUP BY blob),
c AS (SELECT blob, length, least(1024, length // 4) AS top, least(4096, length) AS m, CAST(unnest(range(2, least(1024, length // 4) + 1)) AS BIGINT) AS stride FROM l),
sc AS (SELECT c.blob, c.stride, CAST(sum(CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS BIGINT) AS matches, max(c.m) - c.stride AS pairs
 FROM c JOIN {sig} a ON a.blob = c.blob AND a.pos < c.m - c.stride JOIN {sig} b ON b.blob = c.blob AND b.pos = a.pos + c.stride GROUP BY c.blob, c.stride)"""


def candidates(always: list[int]) -> str:
    return (
        "SELECT blob, stride FROM (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY matches / pairs DESC, stride) AS k FROM sc WHERE matches / pairs > 0.4) WHERE k <= 8 "
        f"UNION SELECT blob, stride FROM (SELECT blob, least(1024, length // 4) AS top, CAST(unnest({always}) AS BIGINT) AS stride FROM l) WHERE stride < top"
    )


def second_pass() -> str:
    """Raw tracks of each signal and track length, put one after the other and cut anew."""
    raw = (
        "WITH " + geometry([8, 16, 32, 64, 128, 256, 512]) + ", raw AS (SELECT blob, s, v, row_number() OVER (PARTITION BY blob, s ORDER BY track) - 1 AS k, count(*) OVER (PARTITION BY blob, s) AS m FROM enc WHERE pattern = 'RAW') "
        "SELECT concat_ws('|', blob, s, m) AS blob, k * s + unnest(range(s)) AS pos, unnest(v) AS v FROM raw WHERE m >= 2"
    )
    return (
        "WITH " + geometry([8, 16, 32, 64], raw) + f", {META}, {SIZES}, "
        "found AS (SELECT blob, s, max(CASE WHEN pattern = 'RAW' THEN 0 ELSE 1 END) AS structured FROM enc GROUP BY blob, s), "
        "f AS (SELECT split_part(blob, '|', 1) AS blob, CAST(split_part(blob, '|', 2) AS BIGINT) AS s, CAST(split_part(blob, '|', 3) AS BIGINT) AS raw_tracks, s AS sub_s, est_size FROM sizes JOIN found USING (blob, s) WHERE structured = 1) "
        "SELECT blob, s, raw_tracks, raw_tracks * (3 + s) AS size_before, arg_min(sub_s, est_size * 1000 + sub_s) AS sub_s, min(est_size) AS size_after FROM f "
        "WHERE est_size < raw_tracks * (3 + s) AND (sub_s < s OR sub_s < raw_tracks * s) GROUP BY blob, s, raw_tracks"
    )


def sections(named: list[tuple[str, int, int]]) -> str:
    """The best track length of each section of each signal."""
    rows = ", ".join(f"('{n}', {a}, {m})" for n, a, m in named)
    cut = f"SELECT concat_ws('|', blob, section) AS blob, pos - start AS pos, v FROM ({signals_sql()}) JOIN (VALUES {rows}) AS t(section, start, length) ON pos >= start AND pos < start + length"
    return (
        "WITH " + geometry([8, 16, 32, 64, 128, 256, 512], cut) + f", {META}, {SIZES} SELECT split_part(blob, '|', 1) AS blob, split_part(blob, '|', 2) AS section, arg_min(s, est_size * 1000 + s) AS s, min(est_size) AS est_size FROM sizes GROUP BY 1, 2"
    )
