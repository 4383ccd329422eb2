"""Results that don't depend on how a table is split when a step reads it, as it is after executors come or go."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackfit.llm import common, components, exact_dedup, simhash, suffix_dedup

from .conftest import DOCS, odd_rows, words
from .test_dedup import brute_components, brute_fingerprint, brute_repeats, normal

MODULES = [common, components, exact_dedup, simhash, suffix_dedup, corpus_pipeline]


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('files')}/documents.parquet"
    rows = odd_rows() + [(100 + i, words(40 + i % 30, 60 + i % 3), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, DOCS).repartition(40).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def unsettled(spark, monkeypatch):
    """The number of splits changes after each table that is stored."""
    steps = iter([k % 5 + 1 for k in range(10_000)])
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def change():
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(7 * next(steps)))

    def durable(*args, **named):
        out = common_durable(*args, **named)
        change()
        return out

    common_durable = common.durable
    for m in MODULES:
        if hasattr(m, "durable"):
            monkeypatch.setattr(m, "durable", durable)
    yield change
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_numbers_of_a_plan_do_change(many_files, unsettled):
    seen = set()
    for _ in range(5):
        unsettled()
        seen.add(frozenset((r["k"], r["text"]) for r in many_files.select(F.monotonically_increasing_id().alias("k"), "text").collect()))
    assert len(seen) > 1  # or the tests below would show nothing


def test_exact_dedup(many_files, unsettled):
    got = exact_dedup.exact_dedup(many_files, digest_col="sha")
    unsettled()
    got = got.collect()
    rows = many_files.collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len({normal(r["text"]) for r in rows}) == len({r["sha"] for r in got})
    assert len({r["sha"] for r in got if r["kept"]}) == sum(r["kept"] for r in got)


def test_near_duplicates(many_files, unsettled):
    got = simhash.near_duplicates(many_files)
    unsettled()
    root = brute_components([brute_fingerprint(r["text"]) for r in many_files.collect()])
    assert sum(r["kept"] for r in got.collect()) == len(set(root))


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT])
def test_repeated_strings(many_files, unsettled, hot):
    got = suffix_dedup.remove(many_files, hot=hot)
    unsettled()
    rows = many_files.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows])))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup", "suffix_dedup"])
def test_stages(spark, many_files, unsettled, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, many_files, "")
    unsettled()
    got, rows = out.collect(), many_files.collect()
    if name == "exact_dedup":
        assert Counter(normal(r["text"]) for r in got) == Counter({normal(r["text"]) for r in rows})
    elif name == "near_dedup":
        root = brute_components([brute_fingerprint(r["text"]) for r in rows])
        first = {}
        for r, k in zip(rows, root):
            if r["doc_id"] is not None:
                first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
        assert Counter(r["doc_id"] for r in got) == Counter(first.get(k) for k in set(root))
    else:
        cut = brute_repeats([r["text"] for r in rows], corpus_pipeline.PASSAGE_BYTES)
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
        assert Counter(tuple(r) for r, x in zip(rows, cut) if not x[1]) - Counter(map(tuple, got)) == Counter()
        ascii_rows = [(r["doc_id"], x[3]) for r, x in zip(rows, cut) if x[1] and r["text"].isascii()]
        sha = spark.createDataFrame(got, out.schema).select("doc_id", F.sha2("text", 256).alias("h")).collect()
        assert ascii_rows and Counter(ascii_rows) - Counter((r["doc_id"], r["h"]) for r in sha) == Counter()


@pytest.mark.parametrize("shape", ["scan", "narrow", "join", "values", "exploded", "drawn"])
def test_row_keys_are_unique_and_stay(spark, many_files, unsettled, shape):
    docs = {
        "scan": lambda: many_files,
        "narrow": lambda: many_files.filter("doc_id > 3").select("doc_id", F.upper("text").alias("text")),
        "join": lambda: many_files.join(spark.range(3), F.lit(True)).select("doc_id", "text"),
        "values": lambda: spark.createDataFrame(odd_rows(), DOCS),
        "exploded": lambda: many_files.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2)))),
        "drawn": lambda: many_files.filter(F.rand(3) < 0.5),
    }[shape]()
    assert (common.stored_key(docs) is not None) == (shape in ("scan", "narrow"))
    rows = common.keyed(docs, {"t": F.col("text"), "i": F.col("doc_id")}, "keys")
    seen = []
    for _ in range(3):
        unsettled()
        seen.append({r[common.RID]: (r["i"], r["t"]) for r in rows.collect()})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == rows.count() and None not in seen[0]


def test_row_keys_of_files_whose_hashes_meet(many_files, monkeypatch):
    monkeypatch.setattr(common, "FILE_BITS", 4)  # 40 files, 16 values
    assert common.stored_key(many_files) is None
    monkeypatch.setattr(common, "FILE_BITS", 40)
    monkeypatch.setattr(common, "PLACE_BITS", 0)
    assert common.stored_key(many_files) is None


def test_intermediate_tables_are_deleted(many_files, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    suffix_dedup.remove(many_files, hot=2).count()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left <= {"suffix-rows", "suffix-repeated", "suffix-runs", "suffix-hot", "suffix-hot-runs", "suffix-owners"}, left


def test_known_sizes_give_few_files(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 7)
    assert len(common.durable(rows, "files").inputFiles()) == 7
    assert len(common.durable(rows, "files", rows=1000).inputFiles()) == 1
    monkeypatch.setattr(common, "FILE_ROWS", 300)
    for bound in (0, 1000, 10**6):  # a wrong bound loses no row
        stored = common.durable(rows, "files", rows=bound)
        assert len(stored.inputFiles()) == min(7, max(1, -(-bound // 300)))
        assert sorted(r["id"] for r in stored.collect()) == list(range(1000))


def test_folder_where_none_is_set(monkeypatch):
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "local[2]"})

    first = common.shared_dir(Session)
    assert first == common.shared_dir(Session) and first.startswith("file:///")
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert common.shared_dir(Session) == "hdfs://shared"
    Session.conf, Session.sparkContext.master = {}, "spark://host:7077"
    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_long_texts_come_in_parts_that_share_no_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1000)
    window = 50
    texts = ["a" * 999, "", "b" * 5000, "c" * 49, "d" * 1050, "e" * 1049]
    seen = Counter()
    for row, place, parts in suffix_dedup._parts(pa.array([*texts, None]), window):
        for r, at, raw in zip(row, place, parts):
            seen.update((r, at + k) for k in range(len(raw) - window + 1))
    assert seen == Counter((r, k) for r, t in enumerate(texts) for k in range(len(t) - window + 1))
