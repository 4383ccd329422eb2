"""Media, storage, access, transforms, files and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfit import api
from trackfit.operators import access, filesystem, media, transforms, video
from trackfit.plans import cascade, report
from trackfit.sources import signals, store
from trackfit.streaming import chunks


def encodings(spark):
    rng = random.Random(1)
    rows = [("a", 64, 0, [3] * 64), ("a", 64, 1, list(range(64))), ("a", 64, 2, [rng.randrange(256) for _ in range(64)]), ("b", 16, 0, [round(200 * 0.9**i) for i in range(16)])]
    return cascade.classify(spark.createDataFrame(rows, "blob string, s int, track long, v array<int>"), keep_values=False)


def test_containers_round_trip_and_heads(spark):
    e = encodings(spark)
    lengths = spark.createDataFrame([("a", 190), ("b", 16)], "blob string, length long")
    packed = store.to_containers(e, lengths).cache()
    back = store.from_containers(packed)
    key = lambda r: (r["blob"], r["track"], r["pattern"], tuple(r["ints"]), tuple(r["reals"] or ()))
    assert sorted(map(key, back.collect())) == sorted(map(key, e.collect()))
    assert {(r["blob"], r["length"], r["s"], r["entries"]) for r in store.container_heads(packed).collect()} == {("a", 190, 64, 3), ("b", 16, 16, 1)}
    bound = packed.join(lengths, "blob").filter(F.length("content") > store.size_bound(F.col("length")))
    assert bound.count() == 0
    with pytest.raises(ValueError):
        store.unpack(b"P" + b"x" * 64)


def test_dataset_round_trip_never_overwrites_by_itself(spark, tmp_path):
    e = encodings(spark)
    store.write_encodings(e, f"{tmp_path}/e")
    assert store.read_encodings(spark, f"{tmp_path}/e").exceptAll(e).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        store.write_encodings(e, f"{tmp_path}/e")


def test_names(spark):
    df = spark.createDataFrame([("x.bin.tfit",)], "p string")
    assert df.select(store.restored_name(F.col("p")).alias("n")).first()["n"] == "x.bin"
    with pytest.raises(Exception, match="suffix"):
        spark.createDataFrame([("x.bin",)], "p string").select(store.restored_name(F.col("p"))).collect()


def test_access_tiers(spark):
    e = encodings(spark).drop("cost")
    outer, inner, wrong = F.lit("0123456789abcdef"), F.lit("fedcba9876543210"), F.lit("ffffffffffffffff")
    sealed = access.seal_all(e, outer, inner)
    assert not {"ints", "reals", "pattern"} & set(sealed.columns)
    assert {r["pattern"] for r in access.structure_view(sealed, outer).collect()} == {r["pattern"] for r in e.collect()}
    assert all(r["pattern"] is None for r in access.structure_view(sealed, wrong).collect())
    assert access.open_all(sealed, outer, inner).select(*sorted(e.columns)).exceptAll(e.select(*sorted(e.columns))).count() == 0
    assert all(r["ints"] is None for r in access.open_parameters(access.seal_parameters(e, inner), wrong).collect())
    assert access.open_parameters(access.seal_parameters(e, inner), inner).select(*sorted(e.columns)).exceptAll(e.select(*sorted(e.columns))).count() == 0


def test_file_store(spark):
    inodes, entries = spark.createDataFrame([], filesystem.INODES), spark.createDataFrame([], filesystem.ENTRIES)
    inodes, entries = filesystem.mkdir(inodes, entries, spark.createDataFrame([(1, 0, "d")], "ino long, parent long, name string"))
    inodes, entries = filesystem.create(inodes, entries, spark.createDataFrame([(2, 1, "f", 1000), (3, 1, "f", 1), (4, 0, "g", 0)], "ino long, parent long, name string, size long"))
    assert filesystem.stat(inodes, 2).first()["size"] == 1000
    assert {r["name"] for r in filesystem.readdir(entries, 0).collect()} == {"d", "g"}
    wanted = spark.createDataFrame([(1, "f"), (1, "no")], "parent long, name string")
    assert [(r["name"], r["ino"]) for r in filesystem.lookup(entries, wanted).collect()] == [("f", 2)]
    assert {(r["ino"], r["n_blocks"]) for r in filesystem.allocated(inodes).collect()} == {(2, 2), (3, 1), (4, 0)}
    blocks = spark.createDataFrame([(0, 2, 0), (1, 2, 1), (3, 3, 0)], filesystem.BLOCKS)
    assert filesystem.first_free(blocks, 10, spark).first()["block"] == 2
    assert filesystem.first_free(blocks, 2, spark).first()["block"] is None  # never beyond the end
    assert filesystem.free(blocks, 2).count() == 1
    routed = filesystem.route(spark.createDataFrame([(100, 74), (100, 75), (3, 2)], "size long, encoded long"))
    assert [r["platter"] for r in routed.orderBy("size", "encoded").collect()] == [1, 0, 1]


def test_rows_fit_within_the_bound(spark):
    n = 48
    x = np.arange(n) / n
    rows = [[100, 101, 99] * 16, [10 + 3 * i for i in range(n)], np.round(40 + 100 * x - 90 * x * x).astype(int).tolist(), np.round(200 * x**3 - 150 * x**2 + 60).astype(int).tolist(), [random.Random(i).randrange(256) for i in range(n)]]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(rows)], "image_id int, row_idx int, v array<int>")
    fits = media.fit_rows(df, 2.0).cache()
    assert [r["kind"] for r in fits.orderBy("row_idx").collect()] == ["CONST", "LINEAR", "POLY2", "POLY3", "RAW"]
    for r in media.rebuild_rows(fits, F.size("v")).collect():
        assert max(abs(a - b) for a, b in zip(r["v"], r["w"])) <= 2.5
    assert all(r["v"] == r["w"] for r in media.rebuild_rows(media.fit_rows(df, 0.0), F.size("v")).filter("kind = 'RAW'").collect())


def test_colour_round_trip_of_greys(spark):
    df = spark.createDataFrame([(0, x, y, v, v, v) for x in range(4) for y in range(2) for v in [40 * x + y]], "frame int, x long, y long, r int, g int, b int")
    back = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in media.from_planes(media.planes(df), ["frame"]).collect()}
    assert back == {(x, y): (40 * x + y,) * 3 for x in range(4) for y in range(2)}


def test_motion_finds_a_shift_and_compensates(spark):
    rng = np.random.default_rng(2)
    ref = rng.integers(0, 256, (32, 32))
    cur = np.roll(ref, (3, -2), axis=(0, 1))
    df = spark.createDataFrame([(0, 32, 32, cur.ravel().tolist(), ref.ravel().tolist())], "key int, width int, height int, cur array<int>, ref array<int>")
    got = {(r["bx"], r["by"]): (r["dx"], r["dy"], r["sad"]) for r in media.motion(df).collect()}
    assert got[0, 1] == (2, -3, 0)
    cells = spark.createDataFrame([(0, x, y, int(ref[y, x])) for x in range(32) for y in range(32)], "key long, x long, y long, v int")
    vectors = media.motion(df)
    predicted = {(r["x"], r["y"]): r["v"] for r in media.compensate(cells, vectors).collect()}
    assert all(predicted[x, y] == cur[y, x] for x in range(16) for y in range(16, 32))
    assert all(r["v"] == 128 for r in media.compensate(cells, vectors.filter("bx < 0")).collect())


def moving(n, w=32, h=32, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (h + 40, w + 40))
    rows = []
    for f in range(n):
        y = base[f % 9 : f % 9 + h, 2 * (f % 5) : 2 * (f % 5) + w] // (1 + (f == 6))
        for p, a in (("Y", y), ("Cb", y[::2, ::2] // 2 + 40), ("Cr", y[1::2, ::2] // 3)):
            rows.append(("v", f, p, a.shape[1], a.shape[0], a.ravel().tolist()))
    return rows


@pytest.mark.parametrize(("n", "gop"), [(1, 4), (4, 4), (10, 4), (9, 8), (5, 1)])
def test_video_without_loss_where_residuals_fit(spark, n, gop):
    """With q = 0 a frame comes back exactly but for residuals beyond 127; the reader and the writer predict from the same."""
    rows = moving(n)
    coded = video.encode(spark.createDataFrame(rows, video.DECODED), gop, 0.0)
    got = {(r["frame"], r["plane"]): r["a"] for r in video.decode(coded, gop).collect()}
    assert set(got) == {(f, p) for _, f, p, *_ in rows}
    kinds = {r["frame"]: r["kind"] for r in coded.select("frame", "kind").distinct().collect()}
    want = {r["frame"]: r["kind"] for r in media.frame_kinds(spark.range(n).withColumnRenamed("id", "frame").withColumn("last_frame", F.lit(n - 1)), gop).collect()}
    assert kinds == want
    for _, f, p, _, _, a in rows:
        if kinds[f] == "I":
            assert got[f, p] == a
        wrong = np.abs(np.array(got[f, p]) - a)
        assert (wrong == 0).mean() > 0.6


def test_video_errors_do_not_add_up(spark):
    """Smooth frames whose residuals fit a byte: every frame is within q and rounding of its source, however late in its group."""
    rows = []
    for f in range(16):
        y, x = np.mgrid[0:32, 0:32]
        for p, step in (("Y", 1), ("Cb", 2), ("Cr", 2)):
            a = (60 + 2 * x + y + 3 * f + (x * y + f) % 3)[::step, ::step]
            rows.append(("v", f, p, a.shape[1], a.shape[0], a.ravel().tolist()))
    coded = video.encode(spark.createDataFrame(rows, video.DECODED), 16, 2.0).cache()
    got = {(r["frame"], r["plane"]): r["a"] for r in video.decode(coded, 16).collect()}
    assert max(np.abs(np.array(got[f, p]) - a).max() for _, f, p, _, _, a in rows) <= 3
    sizes = {r["kind"]: r["numbers"] for r in video.size_of(coded).collect()}
    assert set(sizes) == {"I", "P"} and sum(sizes.values()) < sum(len(a) for *_, a in rows) / 2


def test_row_rule_equals_the_dataframe_rule(spark):
    rng = np.random.default_rng(3)
    x = np.arange(40)
    rows = [[9] * 40, [7 + 3 * i for i in range(40)], (x * x // 9).tolist(), (x * x * x // 300).tolist(), rng.integers(0, 256, 40).tolist(), [5, 6, 5, 6] * 10]
    fits = media.fit_rows(spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v array<int>"), 1.5).orderBy("k").collect()
    for r, v in zip(fits, rows):
        kind, params = video.fit_row(np.array(v, float), 1.5)
        assert kind == r["kind"] and np.allclose(params, r["params"], atol=1e-6)


def test_sound_frames_rebuild(spark):
    s = spark.createDataFrame([("a", i, i % 7) for i in range(1000)], "audio_id string, pos long, v int")
    rows = media.frame_rows(media.audio_frames(s, 40, 2)).orderBy("frame").collect()
    assert [v for r in rows for v in r["v"]] == [i % 7 for i in range(1000)] and len(rows) == 13


def test_text_transforms(spark):
    df = spark.createDataFrame([(1, "banana"), (2, ""), (3, "a")], "blob int, text string")
    b = transforms.bwt(df)
    assert {r["blob"]: r["bwt"] for r in b.collect()}[1] == "annb\0aa"
    assert {r["blob"]: r["text"] for r in transforms.unbwt(b).collect()} == {1: "banana", 2: "", 3: "a"}
    arrays = spark.createDataFrame([("x", [5, 3, 250, 0]), ("y", [])], "blob string, a array<int>")
    d = transforms.byte_delta(arrays)
    assert {r["blob"]: r["a"] for r in d.collect()} == {"x": [5, 254, 247, 6], "y": []}
    assert {r["blob"]: r["a"] for r in transforms.byte_undelta(d).collect()} == {"x": [5, 3, 250, 0], "y": []}


def test_fallback_and_comparators(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(0, bytearray(b"ab" * 500)), (1, bytearray(rng.randrange(256) for _ in range(400))), (2, bytearray())], "k int, content binary")
    got = {r["k"]: r for r in transforms.best_fallback(transforms.compressed_sizes(df)).collect()}
    assert got[0]["method"] in ("deflate", "zstd") and got[0]["packed_bytes"] < 100
    assert (got[1]["method"], got[1]["packed_bytes"], got[2]["method"]) == ("none", 400, "none")
    won = transforms.comparators(transforms.compressed_sizes(df).withColumn("ours", F.lit(1).cast("long")), "ours").collect()
    assert all(r["winner"] == "tracks" for r in won)


@pytest.mark.parametrize("raw", ["none", "zlib", "zstd", "best"])
def test_raw_tracks_are_packed_and_back(spark, raw):
    rng = random.Random(4)
    rows = [("RAW", [1, 2] * 300), ("RAW", [rng.randrange(256) for _ in range(400)]), ("RAW", [5, 6, 5]), ("DELTA", [3, 1, -1]), ("RAW", [])]
    e = spark.createDataFrame([(k, p, v, None) for k, (p, v) in enumerate(rows)], "k int, pattern string, ints array<long>, reals array<double>")
    packed = transforms.pack_raw(e, raw).orderBy("k").collect()
    assert [r["method"] for r in packed][1:] == [0, 0, None, 0] and (packed[0]["method"] > 0) == (raw != "none")
    assert all(r["ints"] is None for r in packed if r["pattern"] == "RAW") and len(packed[0]["packed"]) < (601 if raw == "none" else 60)
    assert [r["ints"] for r in transforms.unpack_raw(transforms.pack_raw(e, raw)).orderBy("k").collect()] == [v for _, v in rows]


def test_image_of_a_file_store(spark, tmp_path):
    inodes, entries = filesystem.create(
        spark.createDataFrame([], filesystem.INODES), spark.createDataFrame([], filesystem.ENTRIES), spark.createDataFrame([(2, 0, "f", 100), (3, 0, "g", 7)], "ino long, parent long, name string, size long")
    )
    data = spark.createDataFrame([(2, bytearray(b"a" * 100), 0), (3, bytearray(b"1234567"), 1)], "ino long, content binary, platter int")
    blocks = spark.createDataFrame([(0, 2, 0), (1, 3, 0)], filesystem.BLOCKS)
    filesystem.write_image(f"{tmp_path}/image", inodes, entries, data, blocks)
    back = filesystem.read_image(spark, f"{tmp_path}/image")
    for name, table in (("inodes", inodes), ("entries", entries), ("data", data), ("blocks", blocks)):
        assert sorted(map(str, back[name].select(table.columns).collect())) == sorted(map(str, table.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        filesystem.write_image(f"{tmp_path}/image", inodes, entries, data, blocks)


def test_files_through_the_command_line(spark, tmp_path):
    data = bytes(range(256)) * 3 + b"\0" * 100 + bytes(random.Random(7).randrange(256) for _ in range(333))
    (tmp_path / "x.bin").write_bytes(data)
    assert bytes(signals.from_files(spark, f"{tmp_path}/x.bin").first()["a"]) == data
    assert api.main([f"{tmp_path}/x.bin", "-t"]) == 0
    assert api.main([f"{tmp_path}/x.bin"]) == 0
    (tmp_path / "x.bin").rename(tmp_path / "y.bin")
    assert api.main([f"{tmp_path}/x.bin.tfit"]) == 0
    assert (tmp_path / "x.bin").read_bytes() == data
    assert api.main([f"{tmp_path}/x.bin", "--visualize"]) == 0 and (tmp_path / "x.bin.svg").read_text().startswith("<svg")


def test_text_bytes(spark):
    df = spark.createDataFrame([(0, "aé漢\n\x00z"), (1, None)], "k int, t string")
    assert {r["blob"]: r["a"] for r in signals.from_text(df, F.col("k"), F.col("t")).collect()} == {0: list("aé漢\n\x00z".encode()), 1: []}


def test_svg_counts_every_pattern(spark):
    picture = report.svg(encodings(spark).filter("blob = 'a'"))
    assert picture.count("<circle") == 3 and all(n in picture for n in ("CONST: 1", "LINEAR: 1", "RAW: 1"))


def test_stream_of_tracks(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i), i % 5) for i in range(100)]
    spark.createDataFrame(rows, "pos long, ts timestamp, v int").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("pos long, ts timestamp, v int").parquet(f"{tmp_path}/in")
    out = chunks.stream_encodings(events, F.lit("s"), F.col("pos"), F.col("v"), "ts", 20, late="10 seconds", window="20 seconds")
    q = out.writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["track"]: r["pattern"] for r in spark.sql("select * from tracks").collect()}
    assert got and set(got.values()) == {"REPEAT"} and set(got) <= {0, 1, 2, 3, 4}
