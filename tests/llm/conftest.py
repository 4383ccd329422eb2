"""Small documents with everything that may go wrong: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use inside.
CLASHES = ["_rid", "id", "fp", "row", "kept", "keep_id", "core", "spans", "score", "pred", "kept_text", "wanted", "group_size", "_id", "lang_pred", "length"]


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeglmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    passage = words(77, 90)
    near = words(5, 300).split()
    nearer = list(near)
    nearer[150] = "changed"
    texts = [
        None, "", " \n\t ", "1234 5678 !!", words(1, 60), words(1, 60).upper(), words(2, 80), words(2, 80), " ".join(near), " ".join(nearer),
        words(3, 40) + " " + passage + " " + words(4, 40), words(6, 30) + "\n" + passage + " tail " + words(7, 20), "é" * 600, "x" + "é" * 600, "aaaa" * 300, words(8, 30000),
        "漢字かな交じり文 " * 50, "one", "two words", "three word text",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, words(9, 50), "en", None, None))
    rows.append((None, words(9, 50), None, "s1", 3))
    rows.append((3, "another text under a used number " + words(10, 20), "en", "s0", 1))
    return rows


@pytest.fixture(scope="session")
def store(tmp_path_factory):
    """Writes a table and reads it back: operators take stored tables."""
    root = tmp_path_factory.mktemp("tables")

    def put(df, name):
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
        return df.sparkSession.read.parquet(f"{root}/{name}.parquet")

    put.root = str(root)
    return put


@pytest.fixture(scope="session")
def odd(spark, store):
    return store(spark.createDataFrame(odd_rows(), DOCS).repartition(3), "odd")


@pytest.fixture(scope="session")
def clashing(odd, store):
    from pyspark.sql import functions as F

    return store(odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES}), "clashing")


@pytest.fixture(scope="session")
def empty(spark, store):
    return store(spark.createDataFrame([], DOCS), "empty")
