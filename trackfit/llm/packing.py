"""Packing by shortest-pack-first over the length histogram.

Documents are encoded once, in Arrow batches, and cut into pieces: whole sequences, then the largest multiple of a
quarter of a sequence, then a tail shorter than that. Only the histogram of piece lengths reaches the driver (at most
one row for each length up to the sequence length). Lengths are placed longest first, each on the shortest open pack;
packs of the same content are one pattern with a count. Patterns are joined back to the pieces by their rank within
their length. Ranks come from counts per (length, salt), so no length is ranked in a single task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackfit.llm import tokens
from trackfit.llm.common import bounded, durable, table

CONTEXT = 2048
#: Id that closes a document.
END_ID = 1
#: Parts, at least, into which the pieces of one length are dealt for ranking, and pieces of a part, about, at most.
SALTS, PART = 64, 1 << 18


def cut(total: int, context: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    quarter = max(1, context // 4)
    whole = total // context * context
    middle = whole + (total - whole) // quarter * quarter
    cuts = [*range(0, whole, context), whole]
    if whole < middle:
        cuts.append(middle)
    if middle < total:
        cuts.append(total)
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def shortest_pack_first(histogram: dict[int, int], context: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs). Each length of the histogram is placed as often as it is counted."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= context:
            raise ValueError(f"a piece of {length} ids doesn't fit {context}")
        while left:
            shortest = min(open_packs, default=context + 1)
            if shortest + length <= context:
                pattern, count = open_packs[shortest].pop()
                if not open_packs[shortest]:
                    del open_packs[shortest]
                n = min(left, count)
                if count > n:
                    open_packs.setdefault(shortest, []).append((pattern, count - n))
                open_packs.setdefault(shortest + length, []).append((pattern + (length,), n))
                left -= n
            else:  # one item after the other: a new pack takes as many as fit before the next opens
                fit = context // length
                n, fit = (left // fit, fit) if left >= fit else (1, left)
                open_packs.setdefault(fit * length, []).append(((length,) * fit, n))
                left -= n * fit
    return [p for total in sorted(open_packs, reverse=True) for p in open_packs[total]]


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens) of each piece; a null text has the closing id only."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                who, rows = [], []
                for i, ids in enumerate(tokens.encode_batch(path, part.column(1))):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    total = len(raw) // 4
                    for start, length in cut(total, context):
                        who.append(i)
                        rows.append((start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total))
                columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who, pa.int64())), *map(pa.array, columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    cut_up = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return cut_up.withColumnRenamed("doc_id", id_col)


def pack(cut_up: DataFrame, id_col: str = "doc_id", context: int = CONTEXT, part: int = PART) -> DataFrame:
    """Add sequence_id and offset to stored pieces. Sequences are gapless from offset 0; pieces that tie in every column take either place."""
    # At most ``context`` rows. A length that is very common gets more salts, so that a part stays bounded at any size.
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = {length: -(-n // part) for length, n in histogram.items() if n > SALTS * part}
    salts = F.lit(SALTS).cast("long")
    if many:
        salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in many.items() for x in pair]), F.col("length")), salts)
    salted = cut_up.withColumn("_salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), salts))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))  # at most context * SALTS rows, and pieces / part
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")

    # Slots of a length, in order of rank: where a run of ranks begins, its first sequence, its place there.
    slots: dict[int, list[tuple[int, int, int]]] = {length: [] for length in histogram}
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, n in shortest_pack_first(histogram, context):
        offset = 0
        for length in pattern:
            slots[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    packed = {length: np.array(rows, dtype=np.int64).T for length, rows in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            seq, off = np.empty_like(rank), np.empty_like(rank)
            for value in np.unique(length):
                first, base, place_in = packed[int(value)]
                rows = np.flatnonzero(length == value)
                k = np.searchsorted(first, rank[rows], side="right") - 1
                seq[rows], off[rows] = base[k] + rank[rows] - first[k], place_in[k]
            kept = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    within = Window.partitionBy("length", "_salt").orderBy(id_col, "start", "ids_crc32")
    ranked = (
        salted.withColumn("_row", F.row_number().over(within) - 1)
        .join(bounded(offsets.select("length", "_salt", "_before")), ["length", "_salt"])
        .select(*cut_up.columns, (F.col("_before") + F.col("_row")).alias("_rank"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null ids are carried; rows with the same id, repeated rows too, are documents of their own; a null or empty text is one piece
    with the closing id; a text of any length is encoded whole and cut into whole sequences first; an empty table gives an
    empty result; other columns of ``docs`` are not read, whatever their names.
    """
    return pack(durable(pieces(docs, path, id_col, text_col, context), "pack-pieces"), id_col, context)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
