"""Turned and chunked containers through the command line: the file comes back, and the container tells how."""

import random

import pytest

from trackfit import api
from trackfit.operators import layout
from trackfit.sources import store

RECORDS = [b for k in range(150) for b in (17, k % 256, random.Random(k).randrange(256), 4, 5, 6, 7)]
#: 1,003 and 1,303 values: neither 7, 10 nor 256 divides them
DATA = bytes(RECORDS[:1003] + [255] * 200 + [random.Random(2).randrange(256) for _ in range(100)])


def there_and_back(tmp_path, data, *flags):
    """(stride, chunk, number of chunks) of the container."""
    (tmp_path / "x.bin").write_bytes(data)
    assert api.main([f"{tmp_path}/x.bin", "-t", *flags]) == 0
    assert api.main([f"{tmp_path}/x.bin", *flags]) == 0
    (tmp_path / "x.bin").unlink()
    assert api.main([f"{tmp_path}/x.bin.tfit", "-d"]) == 0
    assert (tmp_path / "x.bin").read_bytes() == data
    length, stride, chunk, parts = store.unpack_parts((tmp_path / "x.bin.tfit").read_bytes())
    assert length == len(data)
    return stride, chunk, len(parts)


@pytest.mark.parametrize(
    ("flags", "want"),
    [((), (0, 0, 1)), (("-r", "7"), (7, 0, 1)), (("-r", "10"), (10, 0, 1)), (("-C", "256"), (0, 256, 6)), (("-r", "10", "-C", "300"), (10, 300, 5)), (("-r", "2000"), (2000, 0, 1))],
)
def test_files_come_back(spark, tmp_path, flags, want):
    assert there_and_back(tmp_path, DATA, *flags) == want


def test_best_encodes_by_the_winner(spark, tmp_path):
    """Records of 12, one of the strides that are always tried; 7 and 28 are not among them."""
    records = bytes([b for k in range(84) for b in (17, k, random.Random(k).randrange(256), *range(4, 13))][:1003])
    stride, chunk, _ = there_and_back(tmp_path, records, "-b")
    assert stride == 12 and not chunk
    turned = (tmp_path / "x.bin.tfit").stat().st_size
    (tmp_path / "x.bin.tfit").unlink()
    there_and_back(tmp_path, records)
    assert turned < (tmp_path / "x.bin.tfit").stat().st_size


def test_best_takes_a_chunk(spark, tmp_path):
    """Two values, each of which groups all tracks of its chunk."""
    assert there_and_back(tmp_path, bytes([255] * 4096 + [7] * 4096), "-b", "-C", "4k", "-r", "3") == (0, 4096, 2)


def test_long_files_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "CHUNK_GATE", 1000)
    monkeypatch.setattr(layout, "GATED_CHUNK", 500)
    assert there_and_back(tmp_path, DATA) == (0, 500, 3)


def test_heads(spark, tmp_path):
    there_and_back(tmp_path, DATA, "-C", "500")
    df = spark.createDataFrame([("x", bytearray((tmp_path / "x.bin.tfit").read_bytes()))], "blob string, content binary")
    r = store.container_heads(df).first()
    assert (r["length"], r["s"]) == (len(DATA), 0) and r["entries"] == store.from_containers(df).count()
    with pytest.raises(ValueError):
        store.unpack((tmp_path / "x.bin.tfit").read_bytes())


@pytest.mark.parametrize("raw", ["none", "zlib", "zstd", "best", "nonsense"])
def test_raw_tracks_of_a_file(spark, tmp_path, raw):
    data = bytes(random.Random(k).choice(b"abcdefgh~") for k in range(2000))
    there_and_back(tmp_path, data, "--raw", raw)


def test_raw_fallback_within_the_container():
    rng = random.Random(1)
    entries = [(0, "RAW", [rng.choice([7, 9, 200]) for _ in range(512)], None), (1, "RAW", [rng.randrange(256) for _ in range(64)], None), (2, "CONST", [5], None)]
    sizes = {}
    for raw in ("none", "zlib", "zstd", "best"):
        plain = b"".join(store._entries(entries, raw))
        sizes[raw] = len(plain)
        assert [(t, p, v) for t, p, v, _ in store._read_entries(plain, 0, 3)[1]] == [(t, p, v) for t, p, v, _ in entries]
    assert sizes["best"] == min(sizes.values()) < sizes["none"] - 300


def test_standard_output_test_and_empty_files(spark, tmp_path, capfdbinary):
    (tmp_path / "x.bin").write_bytes(DATA)
    assert api.main([f"{tmp_path}/x.bin", "-c", "-k"]) == 0
    content = capfdbinary.readouterr().out
    assert (tmp_path / "x.bin").exists() and not (tmp_path / "x.bin.tfit").exists()
    (tmp_path / "x.bin.tfit").write_bytes(content)
    assert api.main([f"{tmp_path}/x.bin.tfit", "-c"]) == 0
    assert capfdbinary.readouterr().out == DATA
    assert api.main([f"{tmp_path}/x.bin.tfit", "-t"]) == 0
    (tmp_path / "empty.bin").write_bytes(b"")
    assert api.main([f"{tmp_path}/empty.bin", "-v"]) == 0
    (tmp_path / "empty.bin").unlink()
    assert api.main([f"{tmp_path}/empty.bin.tfit", "-d"]) == 0
    assert (tmp_path / "empty.bin").read_bytes() == b""
