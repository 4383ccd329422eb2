"""Detectors, cascade, reconstruction, groups and searches against plain Python and the rules' own statements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfit import api
from trackfit.functions.dialect import SPARK
from trackfit.operators import detect, groups, layout, numeric, rebuild
from trackfit.plans import cascade, search, second
from trackfit.sources import fixtures

FAMILIES = fixtures.families()


def track(name, t=0):
    """Values of a family by DuckDB: not the engine under test."""
    import duckdb

    from trackfit.functions.dialect import DUCK

    n, value = fixtures.families(DUCK)[name]
    return [int(r[0]) for r in duckdb.sql(f"SELECT CAST({value} AS INT) FROM (SELECT range AS i, {t} AS t FROM range({n})) ORDER BY i").fetchall()]


def odd_tracks():
    rng = random.Random(42)
    out = [track(f, t) for f in FAMILIES for t in (0, 3)]
    for v in list(out):
        k = rng.randrange(len(v))
        out.append([*v[:k], v[k] ^ 9, *v[k + 1 :]])  # near misses
        out.append([*v[: len(v) - 3], 0, 0, 0])  # padding at the end
    out += [[rng.randrange(256) for _ in range(n)] for n in (1, 2, 3, 4, 7, 8, 16, 33, 64, 128) for _ in range(3)]
    out += [[rng.randrange(4) for _ in range(n)] for n in (8, 16, 64, 300) for _ in range(3)]
    out += [[5], [5, 5], [5, 6], [0] * 300, [i % 256 for i in range(300)], [255, 0] * 20, list(range(256))]
    return out


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [("x", len(v), k, v) for k, v in enumerate(odd_tracks())]
    return spark.createDataFrame(rows, "blob string, s int, track long, v array<int>").repartition(4).cache()


@pytest.fixture(scope="module")
def encodings(tracks):
    return cascade.classify(tracks, keep_values=True).cache()


@pytest.mark.parametrize("name", list(FAMILIES))
def test_each_family_is_won_by_its_pattern(name):
    assert cascade.first_match(np.array([track(name)]))[0][0] == name


@pytest.mark.parametrize("pattern", [p for p in detect.ORDER if p not in detect.FLOAT_PATTERNS])
def test_expressions_equal_the_matrix_rules(tracks, pattern):
    """The built-in expression of a pattern and the rule of the cascade find the same rows and parameters."""
    rule = {"RLE": cascade._rle, "REPEAT": cascade._repeat, "CONST": cascade._const, "LINEAR": cascade._linear}.get(pattern) or getattr(cascade, {"PIECEWISE_LINEAR": "_piecewise", "INTERLEAVED_LINEAR": "_interleaved"}.get(pattern, "_" + pattern.lower()))
    got = {r["track"]: (r["ints"], r["cost"]) for r in detect.detect(tracks, pattern).filter("fires").select("track", "ints", "cost").collect()}
    want = {}
    for k, v in enumerate(odd_tracks()):
        for _, (_, ints, _, cost) in rule(np.array([v])):
            want[k] = (ints, cost)
    assert want and got == want


@pytest.mark.parametrize("pattern", detect.FLOAT_PATTERNS)
def test_float_detectors_find_their_family(spark, pattern):
    df = spark.createDataFrame([(0, track(pattern)), (1, track("RAW")), (2, [])], "k int, v array<int>")
    assert [r["k"] for r in numeric.detect_float(df, pattern).filter("fires").collect()] == [0]


def test_everything_is_rebuilt(encodings):
    wrong = rebuild.rebuild(encodings.withColumnRenamed("v", "was")).filter(~F.col("was").eqNullSafe(F.col("v")))
    assert wrong.select("track", "pattern", "was", "v").collect() == []


def test_order_is_first_match_not_least_cost(tracks, encodings):
    first = {r["track"]: r for r in encodings.collect()}
    least = {r["track"]: r for r in cascade.least_cost(tracks).collect()}
    assert all(least[k]["cost"] <= first[k]["cost"] for k in first)
    assert any(least[k]["cost"] < first[k]["cost"] for k in first)
    walk = [100]
    rng = random.Random(1)
    for _ in range(63):
        walk.append(walk[-1] + rng.choice([-2, -1, 1, 2]))
    assert cascade.first_match(np.array([walk]))[0][0] == "DELTA" and cascade.cheapest(np.array([walk]))[0][3] <= 64


def test_gate_skips_tracks_of_many_values():
    v = [(7 * i + 3) % 256 for i in range(512)]
    assert cascade.first_match(np.array([v]))[0][0] != "MOD_ARITH"
    assert dict(cascade._mod_arith(np.array([v])))[0][0] == "MOD_ARITH"


def test_all_matches_holds_the_cascade_winner(tracks, encodings):
    some = tracks.filter("track % 9 = 0")
    pairs = {(r["track"], r["pattern"]) for r in detect.all_matches(some).select("track", "pattern").collect()}
    for r in encodings.filter("track % 9 = 0").collect():
        assert r["pattern"] in detect.FLOAT_PATTERNS or (r["track"], r["pattern"]) in pairs


def test_empty_and_single_values(spark):
    df = spark.createDataFrame([(0, []), (1, [7])], "track int, v array<int>")
    assert [(r["track"], r["pattern"]) for r in cascade.classify(df).collect()] == [(1, "CONST")]


def enc(spark, rows):
    return spark.createDataFrame([("b", 64, k, p, i, None, c) for k, (p, i, c) in enumerate(rows)], "blob string, s int, track long, pattern string, ints array<long>, reals array<double>, cost long")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("CONST", [9], 1)] * 4, ("AllSame", [9], 14)),
        ([("CONST", [9], 1)] * 3, None),  # too few
        ([("CONST", [k], 1) for k in (3, 5, 7, 9, 11)], ("ConstLinear", [3, 2], 17)),
        ([("CONST", [k], 1) for k in (3, 5, 7, 9, 12)], None),  # one outlier
        ([("CONST", [k], 1) for k in (3, 3, 5, 7, 9)], None),
        ([("LINEAR", [5, 1], 4)] * 4, ("AllSame", [5, 1], 17)),
        ([("LINEAR", [k, 1], 4) for k in (9, 7, 5, 3)], ("LinearStartsLinear", [9, -2, 1], 19)),
        ([("LINEAR", [k, k], 4) for k in (9, 7, 5, 3)], None),
        ([("REPEAT", [1, 2, 3], 5)] * 5, ("AllSame", [1, 2, 3], 20)),
        ([("DELTA", [1, 1], 9)] * 5, None),  # not a kind that groups
        ([("CONST", [k % 256], 1) for k in range(600)], None),  # longer than any sequence of bytes
    ],
)
def test_meta_groups(spark, rows, want):
    got = groups.meta_groups(enc(spark, rows)).collect()
    assert [(r["kind"], r["params"], r["meta_size"]) for r in got] == ([want] if want else [])
    left = groups.remaining(enc(spark, rows), groups.meta_groups(enc(spark, rows))).count()
    assert left == (0 if want else len(rows))


def test_groups_expand(spark):
    e = enc(spark, [("CONST", [3 + 2 * k], 1) for k in range(6)])
    members = e.select("blob", "s", "pattern", "track", F.col("track").alias("place"))
    assert sorted((r["track"], r["ints"]) for r in groups.expand(groups.meta_groups(e), members).collect()) == [(k, [3 + 2 * k]) for k in range(6)]


def signal(spark, values, blob="s"):
    return spark.createDataFrame([(blob, i, v) for i, v in enumerate(values)], "blob string, pos long, v int")


@pytest.mark.parametrize(
    "values",
    [
        [255] * 700, list(range(200)) * 6, [7], [random.Random(5).randrange(256) for _ in range(1500)],
        # half 0xFF and half random in each 256: a second pass over raw tracks must not lose their places
        [x for _ in range(4) for x in [255] * 128 + [random.Random(9).randrange(256) for _ in range(128)]],
        [b for k in range(100) for b in (k % 256, 3, 9, 200, (3 * k) % 256)],
    ],
)
def test_signals_come_back_whole(spark, values):
    s = signal(spark, values)
    lengths = spark.createDataFrame([("s", len(values))], "blob string, length long")
    assert api.verify(s, api.fit(s), lengths).count() == 0
    assert api.verify(s, api.fit(s, 16), lengths).count() == 0
    spoilt = s.withColumn("v", F.when(F.col("pos") == 0, F.col("v").bitwiseXOR(1)).otherwise(F.col("v")))
    assert api.verify(spoilt, api.fit(s), lengths).count() == 2


def half_raw(n=12):
    rng = random.Random(9)
    return [x for _ in range(n) for x in [255] * 128 + [rng.randrange(256) for _ in range(128)]]


@pytest.mark.parametrize("s", [8, 64, 128, 256, 512])
def test_second_pass_and_back(spark, s):
    sig = signal(spark, half_raw()).unionByName(signal(spark, [255] * 600, "even")).unionByName(signal(spark, half_raw(3)[128:], "other"))
    e = api.fit(sig, s).cache()
    chosen = {r["blob"]: r for r in second.choose(e, second.recut(e)).collect()}
    raw = {blob: [r["ints"] for r in e.filter((F.col("blob") == blob) & (F.col("pattern") == "RAW")).orderBy("track").collect()] for blob in ("s", "even", "other")}
    for blob, rows in raw.items():
        flat, sizes = [x for r in rows for x in r], {}
        for k in second.SIZES:
            if len(rows) >= 2 and not (k >= s and k >= len(flat)):
                again = api.fit(signal(spark, flat), k)
                if again.filter("pattern <> 'RAW'").count():
                    sizes[k] = search.sizes(again).first()["est_size"]
        best = min(sizes, key=lambda k: (sizes[k], k), default=None)
        wanted = best is not None and sizes[best] < len(rows) * (3 + s)
        assert (blob in chosen) == wanted
        if wanted:
            assert (chosen[blob]["sub_s"], chosen[blob]["size_after"], chosen[blob]["size_before"], chosen[blob]["raw_tracks"]) == (best, sizes[best], len(rows) * (3 + s), len(rows))
    if s >= 256:
        assert "s" in chosen
    first, again = second.second_pass(e)
    n_tracks = e.groupBy("blob", "s").agg(F.count(F.lit(1)).alias("n_tracks"))
    back = second.undo(first, again, n_tracks)
    key = lambda r: (r["blob"], r["s"], r["track"], r["pattern"], tuple(r["ints"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, e.collect()))


def test_sections(spark):
    named = spark.createDataFrame([("a", 0, 3), ("b", 2, 100), ("none", 50, 9)], "section string, start long, length long")
    got = {}
    for r in layout.sections(signal(spark, [7, 8, 9, 10]), named).orderBy("pos").collect():
        got.setdefault(r["section"], []).append((r["pos"], r["v"]))
    assert got == {"a": [(0, 7), (1, 8), (2, 9)], "b": [(0, 9), (1, 10)]}


def test_missing_tracks_are_found(spark):
    e = api.fit(signal(spark, list(range(128))), 16).filter("track <> 3")
    expected = spark.createDataFrame([("s", 8), ("none", 0)], "blob string, n_tracks long")
    assert [(r["blob"], r["track"]) for r in rebuild.missing_tracks(e, expected, ["blob"]).collect()] == [("s", 3)]


def test_published_sizes(spark):
    """Sizes that follow from the cost model: 64 KiB of one value, and 16 KiB of equal ramps."""
    const = search.sizes(cascade.classify(layout.lay_out(signal(spark, [255] * 65536), 512))).first()["est_size"]
    assert const == (5 + 2 * 128 + 1) + 3
    ramps = search.sizes(cascade.classify(layout.lay_out(signal(spark, [i % 256 for i in range(16384)]), 256))).first()["est_size"]
    assert ramps == (5 + 2 * 64 + 4) + 3


def test_columnar_literal(spark):
    s = signal(spark, list(b"A1xA2xA3xA4x"))
    turned = layout.columnar(s, 3, F.lit(12)).orderBy("pos").collect()
    assert bytes(r["v"] for r in turned) == b"AAAA1234xxxx"
    back = layout.uncolumnar(layout.columnar(s, 3, F.lit(12)), 3, F.lit(12)).orderBy("pos").collect()
    assert bytes(r["v"] for r in back) == b"A1xA2xA3xA4x"


@pytest.mark.parametrize(("n", "want"), [(0, 0), (100, 100), (32768, 32768), (32769, 4096), (262144, 4096), (262145, 8192), (1 << 26, 1 << 20), (1 << 40, 1 << 20)])
def test_chunk_sizes(spark, n, want):
    assert spark.range(1).select(layout.chunk_size(F.lit(n).cast("long")).alias("c")).first()["c"] == want


def test_stride_of_records_wins(spark):
    rng = random.Random(3)
    values = [b for k in range(120) for b in (17, k % 256, rng.randrange(256), 4, 5, 6, 7)]
    s = signal(spark, values)
    lengths = spark.createDataFrame([("s", len(values))], "blob string, length long")
    scores = {r["stride"]: r["matches"] for r in search.stride_scores(s, lengths).collect()}
    assert scores[7] == sum(values[i] == values[i + 7] for i in range(len(values) - 7))
    strides = search.stride_candidates(search.stride_scores(s, lengths), lengths)
    assert any(r["stride"] % 7 == 0 for r in strides.collect())
    assert search.best_mode(search.modes(s, lengths, strides)).first()["mode"] == "stride"


@pytest.mark.parametrize(("text", "want"), [("12", 12), ("4k", 4096), ("2M", 2 << 20), (" 1g ", 1 << 30)])
def test_parse_size(text, want):
    assert api.parse_size(text) == want


@pytest.mark.parametrize(("text", "want"), [("0", 8), ("all", 8), ("50%", 4), ("1%", 1), ("3", 3)])
def test_parse_threads(text, want):
    assert api.parse_threads(text, 8) == want


def test_rules_are_rendered_for_spark_only_with_known_names():
    assert set(detect.rules(SPARK)) == set(detect.ORDER) - set(detect.FLOAT_PATTERNS)
