"""Shared pieces of the corpus operators: table access, durable intermediate tables, safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of two longs that may be broadcast; beyond it joins shuffle. 500,000 rows are about 20 MB as a hash relation.
BROADCAST_ROWS = 500_000

#: Rows of a file, and so of a task, where the number of rows is known beforehand.
FILE_ROWS = 65_536

#: Name of the row key that operators add. It stands for a row, where doc_id may be null or repeated.
RID = "_rid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    local = tempfile.mkdtemp(prefix="trackfit-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    return "file://" + local


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset is allowed on a local master only; a folder of this process is used then and deleted at its end."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def durable(df: DataFrame, label: str, done: Iterable[DataFrame] = (), rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it cuts the lineage, and lost executors cost nothing.

    The stored tables ``done`` are deleted then: nothing that is still to run may read them. A table whose writing fails is
    deleted too. What a returned plan reads stays; whoever owns the folder empties it. ``rows`` is a number of rows that ``df``
    is known not to exceed: it comes in a file for each ``FILE_ROWS`` of these, not in one for every shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
    except BaseException:
        _delete(spark, path)
        raise
    for table_done in done:
        _delete(spark, table_done._stored_at)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of a row key that hold the place of the row within its file; the others hold a hash of the file's path.
PLACE_BITS, FILE_BITS, SALTS = 23, 40, 8
#: Plans that give each row of one file scan at most once.
_NARROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _file_key(salt: int) -> Column:
    return F.xxhash64("_metadata.file_path", F.lit(salt)).bitwiseAND((1 << FILE_BITS) - 1)


def stored_key(docs: DataFrame) -> Column | None:
    """A long that names a row by its file and its place there, which no splitting of files changes. None if ``docs`` isn't
    a scan of files, or their paths or sizes don't allow it: a scan of no column checks that hashes of paths differ."""
    plan = docs._jdf.queryExecution().analyzed()
    while True:
        if plan.nodeName() not in _NARROW or not plan.deterministic():
            return None
        if plan.children().isEmpty():
            break
        plan = plan.children().head()
    try:
        files = docs.select("_metadata.file_path", "_metadata.row_index", *[_file_key(k).alias(f"h{k}") for k in range(SALTS)])
    except AnalysisException:  # a source without this metadata
        return None
    keys = [f"h{k}" for k in range(SALTS)]
    files = files.groupBy("file_path", *keys).agg(F.max("row_index").alias("last"))
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"), *[F.count_distinct(k).alias(k) for k in keys]).first()
    if (seen["last"] or 0) >> PLACE_BITS:
        return None
    salt = next((k for k in range(SALTS) if seen[f"h{k}"] == seen["n"]), None)
    return None if salt is None else F.shiftleft(_file_key(salt), PLACE_BITS) + F.col("_metadata.row_index")


def keyed(docs: DataFrame, columns: dict[str, Column], label: str, rid: str | None = None) -> DataFrame:
    """(RID, columns) of ``docs``, to be read any number of times: a row has the same key each time.

    ``rid`` names a column of the stored table ``docs`` that holds a different long in each row. Without it the key is the
    row's place in its file. A plan that isn't a scan of files is numbered and written once: numbers given by a plan follow
    the splits of its files, and these the number of cores at the time.
    """
    chosen = [c.alias(k) for k, c in columns.items()]
    key = F.col(rid) if rid is not None else stored_key(docs)
    if key is not None:
        return docs.select(key.alias(RID), *chosen)
    return durable(docs.select(F.monotonically_increasing_id().alias(RID), *chosen), label)


def lower_ascii(text: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted size is within the bound; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def wrapped(docs: DataFrame) -> DataFrame:
    """(RID, row): whole rows as one column, so that no name of theirs can clash with a name added here."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.struct()
    return keyed(docs, {"row": row}, "rows")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of ``rows`` (RID, row) whose row key is not in the stored table ``dropped``."""
    return rows.join(bounded(dropped.select(RID)), RID, "left_anti").select("row.*")
