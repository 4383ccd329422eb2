"""Sizes in many settings at once, against the cascade's own rules and against every variant written out value by value."""

import random

import numpy as np
import pytest

from trackfit import catalog
from trackfit.operators import detect
from trackfit.plans import cascade, matrix, report, search, variants


def some_tracks(n):
    """Tracks that each of the rules may find, near misses and noise, a third of them twice."""
    rng, x, out = np.random.default_rng(n), np.arange(n), []
    for _ in range(25):
        a, b = (int(k) for k in rng.integers(0, 256, 2))
        noise, half = rng.integers(0, 256, n), rng.integers(0, 256, n // 2)
        two = [a, b]
        for _ in range(n - 2):
            two.append((3 * two[-1] + 5 * two[-2]) % 256)
        few = np.full(n, a)
        few[rng.integers(0, n, n // 6)] = b
        one = np.zeros(n, int)
        one[rng.integers(0, n)] = a
        wave = 2 * np.pi * rng.integers(1, n // 2 + 1) * x / n
        out += [
            np.full(n, a), a + b * x, np.minimum(255, a + b % 5 * x), np.repeat(noise, rng.integers(1, 40, n))[:n], np.resize(noise, (n, rng.integers(1, max(2, n // 3)))).ravel()[:n],
            np.resize(noise[: rng.integers(1, max(2, n // 3))], n), noise, noise % (1 << rng.integers(1, 8)), np.cumsum(rng.integers(-3, 4, n)), np.where(x % 2, (a + 3 * x) % 256, (b + 5 * x) % 256),
            np.clip(np.round(128 + 120 * np.cos(wave)), 0, 255), np.clip(np.round(128 + 300 * np.cos(wave)), 0, 255), np.clip(np.round(90 * np.cos(wave) + 60 * np.cos(4 * np.pi * x / n)) + 128, 0, 255),
            np.clip(x * x // 4 + a % 9, 0, 255), x * x * a + b * x, (a % 100 * x + b) % 100, two, [*half, *half[::-1]], few, one, np.minimum(255, np.floor((1 + a % 9) * 1.25**x + 0.5)),
            np.minimum(255, a % 40 + x) ^ 0x55, np.r_[a % 50 + x[: n // 2], b % 90 + 2 * x[: n - n // 2]], (x[: n // 4] * b + a * 999).astype("<u4").view("u1"), (x[: n // 2] * b + a).astype("<u2").view("u1"),
            np.cumsum(rng.integers(0, 60000, n // 4)).astype("<u4").view("u1"), (a + x[: n // 8] * b / 8).astype("<f8").view("u1"), np.cumsum(rng.integers(-50, 50, n // 8) / 4).astype("<f8").view("u1"),
            np.where(noise < 128, 0, noise), np.where(x % (2 + a % 7) == 0, b, 0), np.where(np.sin(x * b / 40) > 0, 255, 0),
        ]
    m = np.stack([np.asarray(r)[:n].astype(np.int64) % 256 for r in out]).astype(np.uint8)
    return np.concatenate([m, m[::3]])


@pytest.mark.parametrize("n", [8, 16, 32, 64, 128, 256, 512])
def test_measures_are_those_of_the_cascade(n):
    m = some_tracks(n)
    t, known = matrix.measure(m), {}
    for i, (name, ints, reals, cost) in enumerate(cascade.first_match(m.astype(np.int64))):
        assert (detect.ORDER[t.code[i]], t.cost[i]) == (name, cost)
        if name in ("CONST", "LINEAR"):
            assert [t.x[i], t.step[i]][: len(ints)] == ints
        elif t.code[i] in matrix.SAME:
            same = int(t.same[i])
            assert matrix.parameters(t, same) == (ints, reals)
            assert known.setdefault(same, (name, ints, reals)) == (name, ints, reals)
    assert len(known) == len({str(k) for k in known.values()})


def written_out(spark, signal):
    return {tuple(r) for r in search.modes_of(signal, search.settings(signal)).collect()}


@pytest.fixture(scope="module")
def long_signal(spark):
    """Signals of more than a segment, short ones, and one with negative values."""
    rng, n = random.Random(5), variants.SEGMENT
    values = {
        "records": [b for k in range(n // 7 + 90) for b in (17, k % 256, rng.randrange(256), 4, 5, 6, 7)], "runs": [i // 700 % 256 for i in range(n + 3000)],
        "ramps": [(i % 64 + i // 64) % 256 for i in range(9001)], "one": [3], "below": [rng.randrange(-9, 9) for _ in range(600)],
    }
    rows = [(blob, pos, v) for blob, a in values.items() for pos, v in enumerate(a)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "blob string, pos long, v int").repartition(5).localCheckpoint()


def test_sizes_equal_variants_written_out(spark, long_signal):
    got = {tuple(r) for r in search.all_modes(long_signal).collect()}
    assert got == written_out(spark, long_signal)
    assert {("runs", "chunk", 65536), ("one", "plain", 0)} <= {r[:3] for r in got}
    assert any(blob == "records" and mode == "stride" and k % 7 == 0 for blob, mode, k, _ in got)


def test_chunks_of_any_size(spark, long_signal):
    s = long_signal.filter("blob = 'ramps'")
    lengths = spark.createDataFrame([("ramps", 9001)], "blob string, length long")
    none = spark.createDataFrame([], "blob string, stride int")
    got = {tuple(r) for r in search.modes(s, lengths, none, [512, 1000, 4096]).collect()}
    chosen = spark.createDataFrame([("ramps", 9001, m, k) for m, k in (("plain", 0), ("chunk", 512), ("chunk", 1000), ("chunk", 4096))], "blob string, length long, mode string, setting int")
    assert got == {tuple(r) for r in search.modes_of(s, chosen).collect()}


def test_values_travel_in_runs(spark, long_signal):
    """Before, each value was dealt once for each of some twenty settings: the mode queries failed by time on 60 times sf0.1."""
    segs = variants.segments(long_signal, search.STRIDE_SAMPLE)
    plans = search._plans(segs, search.CHUNKS)
    values, settings = long_signal.count(), plans.selectExpr("sum(1 + size(strides))").first()[0]
    runs = variants.deal(segs, plans).selectExpr("sum(size(c)) as n", "sum(aggregate(c, 0L, (a, x) -> a + length(x.v))) as bytes").first()
    assert runs["bytes"] > 15 * values and settings > 60
    assert runs["n"] < values / 5


def test_recommendation_reads_the_sizes_once(spark):
    """Before, the sizes of all settings were found a second time for those of the plain signals."""
    read = spark.sparkContext.accumulator(0)
    rows = [("a", "plain", 0, 200), ("a", "stride", 7, 150), ("a", "chunk", 4096, 150), ("b", "plain", 0, 5), ("b", "stride", 4, 9)]
    counted = spark.sparkContext.parallelize(rows, 1).map(lambda r: read.add(1) or r)
    modes = spark.createDataFrame(counted, "blob string, mode string, setting int, est_size long")
    assert sorted(tuple(r) for r in report.recommend(modes).collect()) == [("a", "chunk 4096", 25), ("b", "plain", 0)]
    assert read.value == len(rows)


def test_sizes_equal_sql_where_keys_have_gaps(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    rows = [(k + 40 * (k > 700) + 66_000 * (k > 1500), round(rng.choice([20.0, 21.5, rng.uniform(0, 99)]), 1)) for k in range(3000)]
    events = "event_id long, ts timestamp"
    for name, data, kind in (("part", rows, "p_partkey long, p_retailprice double"), ("orders", [(i + 1, i % 7 * 1.0) for i in range(900)], "o_orderkey long, o_totalprice double"), ("events", [(i, None) for i in range(300)], events)):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    db = duckdb.connect()
    for name in ("part", "orders", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    # Positions beyond the count meet others when they are turned by a stride; their order is open in SQL.
    whole = lambda rows: sorted(tuple(r) for r in rows if r[1] != "stride" or r[0] not in ("prices", "totals"))
    got = catalog.queries()["mode_sizes"](spark, str(tmp_path)).collect()
    want = db.execute(catalog.oracle_sql()["mode_sizes"]).fetchall()
    assert whole(got) == whole(want)
    assert {r[:3] for r in map(tuple, got)} == {r[:3] for r in want}
