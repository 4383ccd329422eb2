"""Sizes of a signal in many settings at once: plain, in chunks, and turned to columns at many strides.

Values travel in runs of up to 65,536, not one by one. Chunks of whole blocks have the tracks of the plain signal, only other
groups, so these are measured once for all chunk sizes. A stride sends each column of a run to where it lies in the turned
signal. Signals whose positions have gaps or come twice keep their positions: a track has the values of its places in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfit.operators import layout
from trackfit.plans import matrix

#: Values of a segment; chunk sizes that divide it into whole blocks share the plain signal's tracks.
SEGMENT = 65536
#: Values that are measured together.
TOGETHER = 1 << 20
RUN = [T.StructField("first", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("v", T.BinaryType()), T.StructField("wide", T.BooleanType())]
Run = tuple[int, bytes | None, bytes, bool]


def shares_tracks(chunk: int) -> bool:
    return chunk % layout.BLOCK == 0 and SEGMENT % chunk == 0


def _run(pos: np.ndarray, v: np.ndarray) -> Run:
    """Values at ascending positions, which are kept only if they aren't neighbours; a byte each if they are bytes."""
    wide = bool(v.min() < 0 or v.max() > 255)
    gaps = bool((np.diff(pos) != 1).any())
    return int(pos[0]), pos.astype("<i8").tobytes() if gaps else None, v.astype("<i4" if wide else np.uint8).tobytes(), wide


def _values(run: Run) -> np.ndarray:
    return np.frombuffer(run[2], "<i4" if run[3] else np.uint8)


def _cells(runs: list[Run]) -> tuple[np.ndarray | int, np.ndarray]:
    """(first position, values) of runs that follow each other, else (positions, values) in order."""
    runs = sorted(runs, key=lambda r: r[0])
    values = [_values(r) for r in runs]
    v = values[0] if len(values) == 1 else np.concatenate(values)
    if all(r[1] is None for r in runs) and all(a[0] + len(x) == b[0] for a, x, b in zip(runs, values, runs[1:])):
        return runs[0][0], v
    pos = np.concatenate([np.arange(r[0], r[0] + len(x)) if r[1] is None else np.frombuffer(r[1], "<i8") for r, x in zip(runs, values)])
    order = np.argsort(pos, kind="stable")
    pos, v = pos[order], v[order]
    return (int(pos[0]), v) if (np.diff(pos) == 1).all() else (pos, v)


def _rows(column: pa.Array) -> list[list[Run]]:
    return [[(r["first"], r["at"], r["v"], r["wide"]) for r in runs] for runs in column.to_pylist()]


def _write(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(blob: pa.DataType, **kinds: pa.DataType) -> pa.Schema:
    return pa.schema([("blob", blob), *kinds.items()])


_RUN = {"first": pa.int64(), "at": pa.binary(), "v": pa.binary(), "wide": pa.bool_()}


def segments(signal: DataFrame, head: int) -> DataFrame:
    """(blob, blk, n, gaps, last, head, first, at, v, wide): the signal in runs of a segment; ``head`` has the values below that position.

    Rows are packed where they are read, so that few and short rows are shuffled."""
    blob = T.StructField("blob", signal.schema["blob"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            kind = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            pos = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            v = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((pos, kind))
            kind, pos, v = kind[order], pos[order], v[order]
            blk = pos // SEGMENT
            ends = [*np.flatnonzero((np.diff(kind) != 0) | (np.diff(blk) != 0)) + 1, len(pos)]
            rows = [(names.dictionary[kind[a]].as_py() if kind[a] >= 0 else None, int(blk[a]), *_run(pos[a:b], v[a:b])) for a, b in zip([0, *ends], ends)]
            yield _write(rows, _arrow(batch.schema.field(0).type, blk=pa.int64(), **_RUN))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, blk, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _rows(batch.column(2))):
                pos, v = _cells(runs)
                gaps = not isinstance(pos, int)
                pos = pos if gaps else np.arange(pos, pos + len(v))
                rows.append((name, blk, len(v), gaps, int(pos[-1]), v[pos < head].astype("<i4").tobytes() if blk * SEGMENT < head else None, *_run(pos, v)))
            yield _write(rows, _arrow(batch.schema.field(0).type, blk=pa.int64(), n=pa.int64(), gaps=pa.bool_(), last=pa.int64(), head=pa.binary(), **_RUN))

    key = [blob, T.StructField("blk", T.LongType())]
    packed = signal.select("blob", F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("v")).mapInArrow(pack, T.StructType([*key, *RUN]))
    found = [T.StructField("n", T.LongType()), T.StructField("gaps", T.BooleanType()), T.StructField("last", T.LongType()), T.StructField("head", T.BinaryType())]
    return packed.groupBy("blob", "blk").agg(F.collect_list(F.struct("first", "at", "v", "wide")).alias("c")).mapInArrow(gather, T.StructType([*key, *found, *RUN]))


def heads(segs: DataFrame) -> DataFrame:
    """(blob, length, dense, least, head) of each signal: its values, whether they are at 0, 1, 2 ..., its first segment and first values."""
    found = segs.groupBy("blob").agg(F.sum("n").alias("length"), F.max("gaps").alias("gaps"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("blk").alias("least"), F.max("head").alias("head"))
    return found.select("blob", "length", (~F.col("gaps") & (F.col("first") == 0) & (F.col("last") + 1 == F.col("length"))).alias("dense"), "least", "head")


def with_strides(found: DataFrame, strides: Callable[[np.ndarray, int], list[int]]) -> DataFrame:
    """``heads`` with strides in the place of head: those of ``strides`` (first values, length)."""
    kept = [c for c in found.columns if c != "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            lengths, first = batch.column(at["length"]).to_pylist(), batch.column(at["head"]).to_pylist()
            chosen = pa.array([strides(np.frombuffer(h or b"", "<i4"), n) for h, n in zip(first, lengths)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in kept), chosen], [*kept, "strides"])

    return found.mapInArrow(run, T.StructType([*(found.schema[c] for c in kept), T.StructField("strides", T.ArrayType(T.IntegerType()))]))


def _columns(pos: np.ndarray | int, v: np.ndarray, k: int, length: int) -> Iterator[tuple[int, Run]]:
    """(segment, run) of the values turned to columns of records of k: a run of each column, cut where segments end."""
    rows = (length + k - 1) // k
    if not isinstance(pos, int):
        t = pos % k * rows + pos // k
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        ends = [*np.flatnonzero(np.diff(t // SEGMENT)) + 1, len(t)]
        for a, b in zip([0, *ends], ends):
            yield int(t[a] // SEGMENT), _run(t[a:b], v[a:b])
        return
    wide = v.dtype != np.uint8
    for i in range(min(k, len(v))):
        first = (pos + i) % k * rows + (pos + i) // k
        column = v[i::k]
        while len(column):
            blk = first // SEGMENT
            here = min(len(column), (blk + 1) * SEGMENT - first)
            yield blk, (first, None, column[:here].tobytes(), wide)
            column, first = column[here:], first + here


def deal(segs: DataFrame, plans: DataFrame) -> DataFrame:
    """(blob (blob, mode, setting), blk, whole, chunks, c): the runs of each segment of each plain and turned signal.

    ``plans`` has blob, length, dense, least, strides and chunks. The last record of a turned signal is filled with zeros."""
    blob = T.StructField("blob", segs.schema["blob"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            kinds = _arrow(batch.schema.field("blob").type, mode=pa.string(), setting=pa.int32(), blk=pa.int64(), whole=pa.bool_(), chunks=pa.list_(pa.int32()), **_RUN)
            for i in range(batch.num_rows):
                r = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
                length, one = r["length"], (r["first"], r["at"], r["v"], r["wide"])
                rows = [(r["blob"], "plain", 0, r["blk"], r["dense"] and length <= SEGMENT, r["chunks"], *one)]
                pos, v = _cells([one])
                for k in r["strides"]:
                    fill = -length % k
                    at, values = pos, v
                    if r["dense"]:
                        values = np.r_[v, np.zeros(fill, v.dtype)] if pos + len(v) == length else v
                    else:
                        at = np.arange(pos, pos + len(v)) if isinstance(pos, int) else pos
                        if r["blk"] == r["least"]:
                            at, values = np.r_[at, length : length + fill], np.r_[v, np.zeros(fill, v.dtype)]
                    whole = r["dense"] and length + fill <= SEGMENT
                    if whole:  # the turned signal is one run
                        rows.append((r["blob"], "stride", k, 0, True, [], 0, None, values.reshape(-1, k).T.tobytes(), r["wide"]))
                    else:
                        rows += [(r["blob"], "stride", k, blk, False, [], *part) for blk, part in _columns(at, values, k, length)]
                yield _write(rows, kinds)

    schema = [blob, T.StructField("mode", T.StringType()), T.StructField("setting", T.IntegerType()), T.StructField("blk", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("chunks", T.ArrayType(T.IntegerType()))]
    dealt = segs.select("blob", "blk", *(f.name for f in RUN)).join(plans, "blob").mapInArrow(run, T.StructType([*schema, *RUN]))
    # Runs are short and costly to measure: the number of tasks isn't left to their bytes.
    spark = segs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(tasks, *(f.name for f in schema))
    return dealt.groupBy(*(f.name for f in schema)).agg(F.collect_list(F.struct("first", "at", "v", "wide")).alias("c"))


MEASURED = [
    T.StructField("s", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("ints", T.ArrayType(T.LongType())), T.StructField("reals", T.ArrayType(T.DoubleType())),
    T.StructField("n", T.LongType()), T.StructField("payload", T.LongType()), T.StructField("single", T.LongType()), T.StructField("track", T.LongType()),
]


def _tracks(cells: list[tuple[np.ndarray | int, np.ndarray]], s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of tracks, the segment and the number of each): numbers ascend within a segment."""
    parts, of, numbers = [], [], []
    for k, (pos, v) in enumerate(cells):
        if isinstance(pos, int) and pos % s == 0:
            n = -(-len(v) // s)
            parts.append(v if len(v) == n * s else np.r_[v, np.zeros(n * s - len(v), v.dtype)])
            numbers.append(np.arange(pos // s, pos // s + n))
        else:  # what is there closes up within its track
            pos = np.arange(pos, pos + len(v)) if isinstance(pos, int) else pos
            number, first, n = np.unique(pos // s, return_index=True, return_counts=True)
            place = np.arange(len(v)) - np.repeat(first, n)
            m = np.zeros((len(number), s), v.dtype)
            fits = place < s
            m[np.repeat(np.arange(len(number)), n)[fits], place[fits]] = v[fits]
            parts.append(m.ravel())
            numbers.append(number)
        of.append(np.full(len(numbers[-1]), k))
    return np.concatenate(parts).reshape(-1, s), np.concatenate(of), np.concatenate(numbers)


def _measure(given: list[tuple], measure: Callable[[np.ndarray], matrix.Tracks], sizes: list[int]) -> list[tuple]:
    """Rows of MEASURED, after blob, mode and setting, for segments (blob, blk, whole, chunks, cells).

    A signal that is one segment, and a chunk, is sized here (no pattern, its size as payload); of others the kinds of tracks are given."""
    out: list[tuple] = []
    whole = np.array([g[2] for g in given])
    least = np.full(len(given), np.iinfo(np.int64).max)
    chunks = {c: np.array([c in g[3] for g in given]) for c in sorted({c for g in given for c in g[3]})}
    best: dict[int, np.ndarray] = {}
    start = np.array([g[1] for g in given]) * SEGMENT
    for s in sizes:
        m, of, track = _tracks([g[4] for g in given], s)
        t = measure(m)
        rows = np.flatnonzero(whole[of])
        if len(rows):
            size = matrix.unit_sizes(t.take(rows), of[rows], len(given))
            least = np.minimum(least, size)
        for c, mine in chunks.items():
            rows, each = np.flatnonzero(mine[of]), SEGMENT // c
            unit = of[rows] * each + (track[rows] * s - start[of[rows]]) // c
            size = matrix.unit_sizes(t.take(rows), unit, len(given) * each)
            best[c] = np.minimum(best[c], size) if c in best else size
        rows = np.flatnonzero(~whole[of])
        if len(rows):
            out += [(*given[k][0], s, *rest) for k, *rest in matrix.kinds(t.take(rows), of[rows], track[rows])]
    out += [(*given[k][0], 0, "", None, None, 0, int(least[k]), 0, 0) for k in np.flatnonzero(whole)]
    for c, mine in chunks.items():
        total = best[c].reshape(len(given), -1).sum(axis=1)
        out += [(given[k][0][0], "chunk", c, 0, "", None, None, 0, int(total[k]), 0, 0) for k in np.flatnonzero(mine)]
    return out


def measured(dealt: DataFrame, sizes: list[int] = layout.CANDIDATES) -> DataFrame:
    """(blob (blob, mode, setting), s, pattern, ints, reals, n, payload, single, track): what ``groups.count_kinds`` counts, by segment."""
    own = dealt.schema["blob"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[tuple]] = {False: [], True: []}
        values, name = {False: 0, True: 0}, None

        def ready(wide: bool) -> pa.RecordBatch:
            rows = _measure(waiting[wide], matrix.by_rules if wide else matrix.measure, sizes)
            waiting[wide], values[wide] = [], 0
            kinds = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), *[pa.int64()] * 4]
            return _write(rows, _arrow(name, mode=pa.string(), setting=pa.int32(), **{f.name: k for f, k in zip(MEASURED, kinds)}))

        for batch in batches:
            name = batch.schema.field("blob").type
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in column.items()}
                cells = _cells([(x["first"], x["at"], x["v"], x["wide"]) for x in r["c"]])
                wide = cells[1].dtype != np.uint8
                waiting[wide].append(((r["blob"], r["mode"], r["setting"]), r["blk"], r["whole"], r["chunks"], cells))
                values[wide] += len(cells[1])
                if values[wide] >= TOGETHER:
                    yield ready(wide)
        for wide in (False, True):
            if waiting[wide]:
                yield ready(wide)

    schema = T.StructType([T.StructField("blob", own), T.StructField("mode", T.StringType()), T.StructField("setting", T.IntegerType()), *MEASURED])
    return dealt.mapInArrow(run, schema).select(F.struct("blob", "mode", "setting").alias("blob"), *(f.name for f in MEASURED))
