"""The mode queries against brute force, on small tables made here."""

import random
from datetime import datetime

import pytest

from trackfit import catalog
from trackfit.plans import search


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(folder, values of each signal): records of 12 and of 21 bytes that no other stride fits as well, and a long last chunk."""
    rng = random.Random(4)
    prices = [b for k in range(140) for b in (*rng.sample(range(256), 2), *range(7, 17))][:1676]
    totals = [b for k in range(420) for b in (k % 256, *range(3, 22), rng.randrange(256))][:8815]
    path = str(tmp_path_factory.mktemp("made"))
    # v = retailprice * 10 % 256 and totalprice * 100 % 256
    spark.createDataFrame([(i, v / 10) for i, v in enumerate(prices)], "p_partkey long, p_retailprice double").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(i, v / 100) for i, v in enumerate(totals)], "o_orderkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, datetime(2024, 1, 1)) for i in range(300)], "event_id long, ts timestamp").write.parquet(f"{path}/events.parquet")
    events = range(300)
    return path, {"prices": prices, "totals": totals, "stairs/0": [i // 64 % 256 for i in events], "ramps/0": [i // 64 + i % 64 for i in events], "filled": [255 for _ in events]}


def candidates(v):
    """Strides as the reference finds them: the eight best scores, then the fixed ones."""
    top, m = min(1024, len(v) // 4), min(4096, len(v))
    score = {s: sum(v[i] == v[i + s] for i in range(m - s)) / (m - s) for s in range(2, top + 1) if s < m}
    good = sorted((s for s in score if score[s] > 0.4), key=lambda s: (-score[s], s))[:8]
    return sorted({*good, *(s for s in search.STRIDE_ALWAYS if s < top)})


def turned(v, stride):
    v = v + [0] * (-len(v) % stride)
    return [v[r] for c in range(stride) for r in range(c, len(v), stride)]


@pytest.fixture(scope="module")
def brute(spark, made):
    """{(blob, mode, setting): size}: every variant is written out in full and fitted as a signal of its own."""
    parts = []
    for blob, v in made[1].items():
        parts.append((blob, "plain", 0, 0, v))
        parts += [(blob, "stride", s, 0, turned(v, s)) for s in candidates(v)]
        parts += [(blob, "chunk", c, k, v[k : k + c]) for c in (4096, 8192, 16384, 32768, 65536) if c < len(v) for k in range(0, len(v), c)]
    df = spark.createDataFrame([(i, p[4]) for i, p in enumerate(parts)], "blob int, a array<int>").selectExpr("blob", "posexplode(a) as (pos, v)")
    size = {r["blob"]: r["est_size"] for r in search.search_geometry(df).collect()}
    out = {}
    for i, (blob, mode, setting, _, _) in enumerate(parts):
        out[blob, mode, setting] = out.get((blob, mode, setting), 10 * (mode == "stride")) + size[i]
    return out


@pytest.fixture(scope="module")
def got(spark, made):
    return {(r["blob"], r["mode"], r["setting"]): r["est_size"] for r in catalog.queries()["mode_sizes"](spark, made[0]).collect()}


def test_every_stride_and_chunk_is_tried(brute, got):
    assert set(got) == set(brute)
    assert {("prices", "stride", 12), ("totals", "chunk", 4096), ("totals", "chunk", 8192)} <= set(got)
    assert any(blob == "totals" and mode == "stride" and s % 21 == 0 for blob, mode, s in got)  # which multiple is open


def test_sizes_equal_brute_force_where_records_are_whole(made, brute, got):
    whole = [k for k in brute if k[1] != "stride" or len(made[1][k[0]]) % k[2] == 0]
    assert {k: got[k] for k in whole} == {k: brute[k] for k in whole}


def test_the_winner_is_a_stride_that_two_fixed_ones_miss(spark, made, brute):
    best = {r["blob"]: (r["mode"], r["setting"]) for r in catalog.queries()["best_mode"](spark, made[0]).collect()}
    advice = {r["blob"]: r["advice"] for r in catalog.queries()["recommend_mode"](spark, made[0]).collect()}
    for blob in ("prices", "totals"):
        order = {"plain": 0, "stride": 1, "chunk": 2}
        want = min((size, order[m], s, m) for (b, m, s), size in brute.items() if b == blob)
        assert best[blob] == (want[3], want[2]) and want[2] not in (8, 64, 4096)
        assert advice[blob] == f"{want[3]} {want[2]}"


def test_sizes_equal_brute_force_with_the_last_record_filled(made, brute, got):
    assert any(m == "stride" and len(made[1][blob]) % s for blob, m, s in brute)
    assert got == brute


def test_settings_are_those_of_the_candidates(spark, made):
    got = {(r["blob"], r["setting"]) for r in search.settings(catalog._signals(spark, made[0])).filter("mode = 'stride'").collect()}
    assert got == {(blob, s) for blob, v in made[1].items() for s in candidates(v)}
    want = catalog.queries()["stride_candidates"](spark, made[0]).collect()
    assert got == {(r["blob"], r["stride"]) for r in want}
