"""Removal of byte strings that occur again, by merged Burrows-Wheeler transforms.

A window is a string of so many bytes (``WINDOW`` unless another size is given); one that starts anywhere else too is removed. Equal windows must meet in one task,
and that without sorting all suffixes of the corpus:

1. Anchors. The anchor of a window is its least 8-byte gram by a hash, among the first ``reach`` places, leftmost of equals.
   Equal windows have their anchor at the same offset, so they share the ``core`` bytes after it. Consecutive windows with
   the same anchor form one member: an anchor, the range of offsets at which its windows begin, and their bytes.
2. Members whose core occurs once hold no repeated window. Members with equal bytes are one, with a count.
3. The members of a core stand in columns aligned at the anchor. Shards of them get a column-wise Burrows-Wheeler
   transform (from the last column to the first, each column's symbols in the order of the suffixes after it). The shards
   are merged by refining their interleave column by column, from the transforms alone: the interleave of a column is the
   stable partition of that of the column behind it. Longest common prefixes of neighbours follow along; where they reach
   the window's length, a repeated interval begins.
4. A core with more than ``HOT`` different members is refined: offsets are halved, parts of members that are equal become
   one, and the rest are dealt by the longer bytes that the windows of a half have in common, at last by whole windows,
   which are only counted.

Documents are joined by a row key; repeated intervals become byte spans of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfit.llm.common import RID, durable, keyed, table

WINDOW, GRAM = 400, 8
#: Members of a core that one task takes, of a merged collection, and of a shard.
HOT, COLLECTION, SHARD = 8_192, 8_192, 4_096
CHUNK_BYTES = 1 << 20
#: No UTF-8 text has this byte; it stands where a member has none.
NOTHING = 0xFF
RUNS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
KEYS = ["core", "g1", "g2"]


@dataclass(frozen=True)
class Shape:
    """Bytes of a window, places of its anchor, and bytes from the anchor on that equal windows share."""

    window: int = WINDOW

    def __post_init__(self):
        if self.core < GRAM:
            raise ValueError(f"a window of {self.window} bytes is too short")

    @property
    def reach(self) -> int:
        return self.window * 16 // 25

    @property
    def core(self) -> int:
        return self.window - self.reach + 1


def find_anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the members of texts that lie one after the other in ``data``."""
    n, window = len(data), shape.window
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    gram = np.ndarray((n - GRAM + 1,), np.dtype("<u8"), np.ascontiguousarray(data), 0, (1,))
    h = gram * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < shape.reach:
        step = min(span, shape.reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    ok = np.zeros(n + 1, np.int64)  # windows that lie within one text
    long = end - begin >= window
    np.add.at(ok, begin[long], 1)
    np.add.at(ok, end[long] - window + 1, -1)
    s = np.flatnonzero(np.cumsum(ok)[: n - window + 1])
    if not len(s):
        return (np.zeros(0, np.int64),) * 3
    anchor = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)])
    return anchor[first], s[first], s[np.r_[first[1:], len(s)] - 1]


def _parts(texts: pa.Array, window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, places, bytes) of texts, about CHUNK_BYTES at once. A longer text comes in parts; each window lies in one of them."""
    row, place, raw, size = [], [], [], 0
    for i, text in enumerate(texts):
        whole = (text.as_py() or "").encode("utf-8")
        for at in range(0, max(1, len(whole) - window + 1), CHUNK_BYTES):
            part = whole[at : at + CHUNK_BYTES + window - 1]
            if size and size + len(part) > CHUNK_BYTES:
                yield row, place, raw
                row, place, raw, size = [], [], [], 0
            row.append(i)
            place.append(at)
            raw.append(part)
            size += len(part)
    if row:
        yield row, place, raw


def anchors(rows: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(RID, anchor, lo, hi, core, g1, g2) of the members of rows (RID, id, text): window offsets lo to hi before the anchor,
    a hash of the core and a 128-bit hash of all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for row, place, parts in _parts(batch.column(2), shape.window):
                raw = b"".join(parts)
                length = np.fromiter(map(len, parts), np.int64, len(parts))
                end = np.cumsum(length)
                begin = end - length
                anchor, first, last = find_anchors(np.frombuffer(raw, np.uint8), begin, end, shape)
                part = np.searchsorted(end, first, side="right")
                core = np.fromiter((xxhash.xxh64_intdigest(raw[a : a + shape.core]) for a in anchor.tolist()), np.uint64, len(anchor))
                whole = b"".join(xxhash.xxh3_128_digest(raw[a : b + shape.window]) for a, b in zip(first.tolist(), last.tolist()))
                g = np.frombuffer(whole, "<i8").reshape(-1, 2)
                at = anchor - begin[part] + np.array(place, np.int64)[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[np.array(row)[part]]), pa.array(at.astype(np.int32)), pa.array((anchor - last).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(core.view(np.int64)), pa.array(g[:, 0]), pa.array(g[:, 1])],
                    [RID, "anchor", "lo", "hi", *KEYS],
                )

    return rows.mapInArrow(run, f"{RID} long, anchor int, lo int, hi int, core long, g1 long, g2 long")


def transform(columns: np.ndarray) -> np.ndarray:
    """Column-wise Burrows-Wheeler transform of a shard (columns x members): row c has the symbols of column c in the order
    of the suffixes that begin after it."""
    out = np.empty_like(columns)
    order = np.arange(columns.shape[1])
    for c in range(len(columns) - 1, -1, -1):
        out[c] = columns[c][order]
        order = order[np.argsort(out[c], kind="stable")]
    return out


def merge(shards: list[np.ndarray], window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merge transforms: for each column from the last on, the members in the order of their suffixes and whether the
    ``window`` symbols from there are those of a neighbour in that order."""
    sizes = [s.shape[1] for s in shards]
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    member = np.arange(len(interleave))
    common = np.zeros(len(interleave), np.int32)  # prefix shared with the member before
    for c in range(len(shards[0]) - 1, -1, -1):
        symbols = np.empty(len(interleave), np.uint8)
        for k, shard in enumerate(shards):
            symbols[interleave == k] = shard[c]
        refined = np.argsort(symbols, kind="stable")
        s = symbols[refined]
        new = np.zeros(len(s), np.int32)
        same = np.flatnonzero(s[1:] == s[:-1]) + 1
        here, there = refined[same], refined[same - 1]
        # One more than the least common prefix between the two places they had.
        new[same] = common[here] + 1
        far = np.flatnonzero(here != there + 1)
        if len(far):
            cuts = np.empty(2 * len(far), np.int64)
            cuts[::2], cuts[1::2] = there[far] + 1, here[far] + 1
            padded = np.append(common, 0)
            new[same[far]] = np.minimum.reduceat(padded, cuts)[::2] + 1
        interleave, member, common = interleave[refined], member[refined], new
        long = common >= window
        yield c, member, long | np.append(long[1:], False)


def repeated_offsets(texts: list[bytes], lo: np.ndarray, hi: np.ndarray, count: np.ndarray, shard: int = SHARD, shape: Shape = Shape()) -> np.ndarray:
    """(members x reach) booleans: the window that begins so far before the anchor occurs again. Bytes run from hi before the
    anchor to the end of the window at lo."""
    n, reach = len(texts), shape.reach
    width = reach - 1 + shape.window
    matrix = np.full((n, width), NOTHING, np.uint8)
    for i, t in enumerate(texts):
        at = reach - 1 - hi[i]
        matrix[i, at : at + len(t)] = np.frombuffer(t, np.uint8)
    columns = np.ascontiguousarray(matrix.T)
    found = np.zeros((reach, n), bool)
    for c, member, again in merge([transform(columns[:, a : a + shard]) for a in range(0, n, shard)], shape.window):
        if c < reach:
            found[reach - 1 - c, member] = again
    offsets = np.arange(reach)[:, None]
    return ((found | (count > 1)) & (offsets >= lo) & (offsets <= hi)).T


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _merge_members(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeated offsets of the members of a partition, sorted by core; whole cores are merged, many at once."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        column = lambda name: t.column(name).to_numpy()
        found = repeated_offsets(t.column("bytes").to_pylist(), column("lo"), column("hi"), column("n"), shape=shape)
        row, first, last = _runs(found)
        starts = np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["lo", "hi"]))
        out = pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks() for k in KEYS), runs], [*KEYS, "runs"])
        return out.filter(pa.array(np.diff(starts) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held.append(batch.slice(at, 4096))
                n += held[-1].num_rows
                if n < COLLECTION:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # where the last core begins
                if cut:
                    yield flush(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                n -= cut
        if n:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _halve(members: DataFrame, hot: int, shape: Shape) -> DataFrame:
    """Runs of members (KEYS, n, lo, hi, bytes) of cores that are too many for a task, by halves of the offsets.

    The parts of members that are equal are one kind, with a count: what very many members share is carried once, and only
    a narrow table (``owner``) says whose part it is.
    """
    of = [f"of_{k}" for k in KEYS]
    parents = [F.col(k).alias(o) for k, o in zip(KEYS, of)]
    now = durable(members.select(*KEYS, "n", "lo", "hi", "bytes", F.lit(0).alias("from"), F.lit(shape.reach - 1).alias("to")), "suffix-hot")
    owner = None
    done = []
    while held := now.count():
        most = 2 * held  # a round cuts each member into two parts at most
        most_links = most if owner is None else 2 * owner.count()
        half = F.expr("inline(array(struct(`from`, int((`from` + `to`) div 2) as `to`), struct(int((`from` + `to`) div 2 + 1) as `from`, `to`)))")
        cut = now.select(*parents, "n", F.col("lo").alias("l"), F.col("hi").alias("h"), "bytes", half).filter("l <= `to` and h >= `from`")
        lo, hi = F.greatest("l", "from"), F.least("h", "to")
        trimmed = F.substring("bytes", F.col("h") - hi + 1, hi - lo + shape.window)
        part = cut.select(*of, "n", lo.alias("lo"), hi.alias("hi"), trimmed.alias("bytes"), "from", "to")
        # What every window of a half has in common: from its least offset to the end of the window at its largest.
        common = F.substring("bytes", F.col("hi") - F.col("from") + 1, F.col("from") - F.col("to") + shape.window)
        part = part.withColumns({"core": F.xxhash64("from", common), "g1": F.xxhash64("lo", "hi", "bytes"), "g2": F.xxhash64("bytes", "hi", "lo", F.lit(1))})
        part = durable(part, "suffix-parts", done=[now], rows=most)
        kinds = part.groupBy(*KEYS).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("lo", "hi", "bytes", "from", "to")])
        kinds = durable(kinds, "suffix-part-kinds", rows=most)
        crowd = durable(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("m")), "suffix-part-counts", rows=most)
        sized = durable(kinds.join(crowd, "core"), "suffix-part-sizes", done=[kinds, crowd], rows=most)
        # Of one window, or alone with what its windows share: a repetition if it is found more than once.
        whole = sized.filter("n > 1 and (m = 1 or `from` = `to`)").select(*KEYS, F.array(F.struct("lo", "hi")).alias("runs"))
        cool = sized.filter((F.col("m") > 1) & (F.col("m") <= hot) & (F.col("from") < F.col("to")))
        runs = durable(whole.unionByName(_search(cool.withColumn("key", F.col("core")), shape)), "suffix-part-runs")
        now = durable(sized.filter((F.col("m") > hot) & (F.col("from") < F.col("to"))).drop("m"), "suffix-hot", done=[sized], rows=most)
        links = part.select(*of, *KEYS)
        if owner is not None:
            links = owner.join(links.withColumnsRenamed(dict(zip(of, (f"via_{k}" for k in KEYS)))), [F.col(f"in_{k}") == F.col(f"via_{k}") for k in KEYS]).select(*of, *KEYS)
        links = durable(links, "suffix-links", done=[part] if owner is None else [part, owner], rows=most_links)
        done.append(durable(links.join(runs, KEYS).select(*[F.col(o).alias(k) for k, o in zip(KEYS, of)], "runs"), "suffix-hot-runs", done=[runs], rows=most_links))
        owner = durable(links.join(now.select(*KEYS), KEYS, "left_semi").withColumnsRenamed({k: f"in_{k}" for k in KEYS}), "suffix-owners", done=[links], rows=most_links)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _search(members: DataFrame, shape: Shape) -> DataFrame:
    order = ["key", *KEYS, "n", "lo", "hi", "bytes"]
    return members.select(order).repartition("key").sortWithinPartitions("key").mapInArrow(_merge_members(shape), T.StructType([*(T.StructField(k, T.LongType()) for k in KEYS), T.StructField("runs", RUNS)]))


def _with_bytes(rows: DataFrame, members: DataFrame, shape: Shape) -> DataFrame:
    """Bytes of the members (KEYS, n, at: RID, anchor, lo, hi) from the texts."""
    wanted = members.groupBy(F.col(f"at.{RID}").alias(RID)).agg(F.collect_list(F.struct(*KEYS, "n", "at.anchor", "at.lo", "at.hi")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEYS, "n", "lo", "hi"]
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(2)[i].as_py() or "").encode("utf-8")
                own = batch.column(3)[i].values
                field = {k: own.field(k) for k in [*names, "anchor"]}
                cut = [text[a - h : a - low + shape.window] for a, low, h in zip(field["anchor"].to_pylist(), field["lo"].to_pylist(), field["hi"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*(field[k] for k in names), pa.array(cut, pa.binary())], [*names, "bytes"])

    joined = rows.join(wanted, RID).select(RID, "id", "text", "wanted")
    return joined.mapInArrow(run, "core long, g1 long, g2 long, n long, lo int, hi int, bytes binary")


def spans(rows: DataFrame, hot: int = HOT, shape: Shape = Shape()) -> DataFrame:
    """(RID, spans) for each row of the stored table (RID, id, text) with a repeated window: the byte ranges [start, stop) that such windows cover, as found."""
    found = durable(anchors(rows, shape), "suffix-anchors")
    # Joins take stored tables, so that none shares a stage with an aggregate and a core with very many members can be split.
    again = durable(found.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core"), "suffix-cores")
    repeated = durable(found.join(again, "core"), "suffix-repeated", done=[found, again])
    members = repeated.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(RID, "anchor", "lo", "hi")).alias("at"))
    members = durable(members, "suffix-members")
    kinds = durable(members.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")), "suffix-counts")
    sized = durable(members.join(kinds, "core"), "suffix-kinds", done=[members, kinds])
    # One kind of member, found more than once: the interval is whole, there is nothing to sort.
    whole = sized.filter("kinds = 1").select(*KEYS, F.array(F.struct("at.lo", "at.hi")).alias("runs"))
    runs = whole.unionByName(_search(_with_bytes(rows, sized.filter((F.col("kinds") > 1) & (F.col("kinds") <= hot)), shape).withColumn("key", F.col("core")), shape))
    crowded = sized.filter(F.col("kinds") > hot)
    if not crowded.isEmpty():
        runs = runs.unionByName(_halve(_with_bytes(rows, crowded, shape), hot, shape))
    runs = durable(runs, "suffix-runs", done=[sized])
    ranges = F.transform("runs", lambda r: F.struct((F.col("anchor") - r["hi"]).alias("start"), (F.col("anchor") - r["lo"] + shape.window).alias("stop")))
    return repeated.join(runs, KEYS).select(RID, ranges.alias("spans")).groupBy(RID).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def join_spans(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    head = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]]) if len(start) else np.zeros(0, np.int64)
    return list(zip(start[head].tolist(), stop[np.r_[head[1:], len(stop)] - 1].tolist())) if len(start) else []


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_text: bool = False, window: int = WINDOW, rid: str | None = None) -> DataFrame:
    """One row per document: RID, id_col, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the spans and the text
    without them (a character goes only if all its bytes do). Strings of ``window`` bytes are compared.

    A null text is empty; texts shorter than a window keep all, and long ones are read whole, in overlapping parts; repeated
    rows are each other's repetition; null and repeated ids are carried; an empty table gives an empty result. Extra columns
    aren't read. ``rid`` names a column of row keys that ``docs`` holds already; else a row's key is its place in its file, or
    rows that are in no file are written once, as texts are joined with what is found in them.
    """
    shape = Shape(window)
    rows = keyed(docs, {"id": F.col(id_col), "text": F.col(text_col)}, "suffix-rows", rid)
    joined = rows.join(spans(rows, hot, shape), RID, "left").select(RID, "id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, found, kept_texts = [], [], [], []
            for text, own in zip(batch.column(2), batch.column(3)):
                raw = (text.as_py() or "").encode("utf-8")
                cut = join_spans(own.values.field("start").to_numpy(), own.values.field("stop").to_numpy()) if own.is_valid else []
                ends = [0, *(x for r in cut for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                numbers.append((len(raw), len(raw) - len(kept), len(cut)))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    found.append([{"start": a, "stop": b} for a, b in cut])
                    kept_texts.append(keep_characters(raw, cut))
            n = np.array(numbers, np.int64).reshape(-1, 3).T
            more = [pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept_texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, n), pa.array(digests, pa.string()), *more], [RID, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["removed", "kept_text"][: len(more)]])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{RID} long, id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", removed array<struct<start: long, stop: long>>, kept_text string" if with_text else "")
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_characters(raw: bytes, cut: list[tuple[int, int]]) -> str:
    """The text without the spans, each drawn in to whole characters."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out, at = [], 0
    for start, stop in cut:
        while inside(start):
            start += 1
        while stop > start and inside(stop):
            stop -= 1
        if start < stop:
            out.append(raw[at:start])
            at = stop
    return b"".join([*out, raw[at:]]).decode("utf-8")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the text that stays, as digests and counts alone don't show what was taken."""
    return remove(table(spark, sf_dir, "documents"), with_text=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
