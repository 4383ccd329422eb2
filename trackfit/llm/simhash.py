"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints of word shingles are linked when at most ``MAX_DIFFERENCES`` bits differ. Equal fingerprints are one node from
the start. For a distributed search the 64 bits are cut into six blocks: two fingerprints within four bits agree in two
blocks at least, so each fingerprint is dealt to the 15 masked patterns of two blocks. Patterns that hold too many are
refined by a mask of one part in five of the bits left, again and again, or dealt to pairs of chunks where that takes fewer
copies, so that no task holds a hot pattern.

Within a pattern, fingerprints are sorted by Gray rank and form a tree: a node keeps the bits that all below it share.
Pairs of nodes descend together; the differences of bits that both newly fix are added to those known above, a pair is
pruned once they exceed the limit, and is linked as a whole once even all bits left free couldn't exceed it. A task
returns a spanning forest of its links, not the links, and the forests meet in a distributed component search.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit.llm.common import RID, durable, table
from trackfit.llm.components import components

SHINGLE, SEED, MAX_DIFFERENCES = 4, 42, 4
BLOCKS = (11, 11, 11, 11, 10, 10)
FANOUT = 8
#: Fingerprints of a pattern that one task takes; more are refined.
HOT = 16_384
#: Node pairs that descend at once.
FRONT = 1 << 17


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the hashes of the shingles; without words the fingerprint is zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        h = np.array([digest(joined, SEED)], np.uint64)
    else:
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rid: str | None = None) -> DataFrame:
    """(RID, id, fp) of each row; fp is the fingerprint as a signed long. Without a column ``rid`` of keys, rows are numbered by the plan."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], [RID, "id", "fp"])

    key = F.monotonically_increasing_id() if rid is None else F.col(rid)
    return docs.select(key.alias(RID), F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"{RID} long, id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks() -> list[int]:
    at, blocks = 0, []
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(blocks, 2)]


def finer(mask: int) -> list[int]:
    """``mask`` with one of five parts of the bits that it leaves out: four differences leave one part equal."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // (MAX_DIFFERENCES + 1) for k in range(MAX_DIFFERENCES + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def gray_rank(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, offset within) for runs of the given sizes."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i]; label names a set by its least member."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(bucket: np.ndarray, fp: np.ndarray, limit: int = MAX_DIFFERENCES) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (child, parent), as positions, of the links within buckets. Input is sorted by bucket, then Gray rank."""
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    # levels[0] are the fingerprints; each level above groups FANOUT neighbours of a bucket.
    shared, pattern, first, count, child, kids, group = [np.full(n, ~np.uint64(0))], [fp], [np.arange(n)], [np.ones(n, np.int64)], [None], [None], bucket
    low, high = fp, fp
    while True:
        new = np.r_[True, group[1:] != group[:-1]]
        begin = np.flatnonzero(new)
        place = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
        heads = np.flatnonzero(place % FANOUT == 0)
        low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
        sizes = np.diff(np.r_[heads, len(group)])
        shared.append(~(low ^ high))
        pattern.append(low)
        first.append(first[-1][heads])
        count.append(np.add.reduceat(count[-1], heads))
        child.append(heads)
        kids.append(sizes)
        group = group[heads]
        if len(group) == len(begin):
            break
    top = len(shared) - 1
    roots = np.flatnonzero(count[top] > 1)
    stack = [(top, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.uint64))]
    while stack:
        level, a, b, known, fixed = stack.pop()
        if len(a) > FRONT:
            stack.append((level, a[FRONT:], b[FRONT:], known[FRONT:], fixed[FRONT:]))
            a, b, known, fixed = a[:FRONT], b[:FRONT], known[:FRONT], fixed[:FRONT]
        both = shared[level][a] & shared[level][b]
        differ = known + np.bitwise_count((pattern[level][a] ^ pattern[level][b]) & both & ~fixed)
        near = differ <= limit
        if level == 0:
            near &= a != b
            label = _join_labels(label, a[near], b[near])
            continue
        whole = near & (differ + np.bitwise_count(~both) <= limit)
        if whole.any():
            for side in (a, b):
                node, offset = _spread(count[level][side[whole]])
                label = _join_labels(label, first[level][side[whole]][node] + offset, first[level][a[whole]][node])
        down = near & ~whole
        a, b, known, fixed = a[down], b[down], differ[down], both[down]
        ka, kb = kids[level][a], kids[level][b]
        which, k = _spread(ka * kb)
        x, y = child[level][a[which]] + k // kb[which], child[level][b[which]] + k % kb[which]
        keep = (a[which] != b[which]) | (x <= y)
        # A pair that is one set already has nothing to add.
        done = keep & (count[level - 1][x] == 1) & (count[level - 1][y] == 1) & (label[first[level - 1][x]] == label[first[level - 1][y]])
        keep &= ~done
        stack.append((level - 1, x[keep], y[keep], known[which[keep]].astype(np.int64), fixed[which[keep]]))
    below = np.flatnonzero(label != np.arange(n))
    return below, label[below]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the patterns of a partition, which come sorted by pattern. Whole patterns are searched, many at once."""
    rest: list[tuple[np.ndarray, ...]] = []
    held = 0

    def flush(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        *keys, fp = columns
        fp = fp.view(np.uint64)
        new = np.zeros(len(fp), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        bucket = np.cumsum(new)
        crowd = np.bincount(bucket)[bucket] > 1
        bucket, fp = bucket[crowd], fp[crowd]
        order = np.lexsort((gray_rank(fp), bucket))
        bucket, fp = bucket[order], fp[order]
        child, parent = forest(bucket, fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[parent].view(np.int64))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(tuple(c.to_numpy() for c in batch.columns))
        held += batch.num_rows
        if held >= 2 * HOT:
            columns = tuple(np.concatenate(c) for c in zip(*rest))
            last = np.ones(len(columns[0]), bool)
            for k in columns[:-1]:
                last &= k == k[-1]
            cut = int(np.argmax(last))  # where the last pattern begins
            if cut:
                yield flush(tuple(c[:cut] for c in columns))
            rest, held = [tuple(c[cut:] for c in columns)], len(columns[0]) - cut
    if rest:
        yield flush(tuple(np.concatenate(c) for c in zip(*rest)))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """A forest (u, v) that connects distinct fingerprints (column fp) just as their links do.

    A pattern with more than ``hot`` fingerprints is either dealt to pairs of chunks, or refined where a finer mask means fewer
    copies; a pattern of few free bits can't hold many, so refining ends.
    """
    keys = ["mask", "value", "part"]
    deal = lambda masks: F.explode(masks).alias("mask")
    dealt = fps.select("fp", deal(F.array(*[F.lit(_signed(m)) for m in block_masks()]))).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    parts = []
    while True:
        crowded = durable(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "simhash-hot")
        masks = [r["mask"] % 2**64 for r in crowded.select("mask").distinct().collect()]  # of the few in use
        if not masks:
            parts.append(dealt.withColumn("part", F.lit(0).cast("long")))
            break
        parts.append(dealt.join(crowded, ["mask", "value"], "left_anti").withColumn("part", F.lit(0).cast("long")))
        refined = {_signed(m): [_signed(x) for x in finer(m)] for m in masks if len(finer(m)) > MAX_DIFFERENCES}
        chunks = F.ceil(F.col("n") * 2 / hot)
        paired = (chunks <= MAX_DIFFERENCES + 1) | ~F.col("mask").isin(*refined) if refined else F.lit(True)
        hotter = dealt.join(crowded, ["mask", "value"])
        mine = F.pmod(F.xxhash64("fp"), chunks)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.least(mine, j) * chunks + F.greatest(mine, j) + 1)
        parts.append(hotter.filter(paired).select("fp", "mask", "value", F.explode(pairs).alias("part")))
        if not refined:
            break
        choice = F.create_map(*[x for m, finest in refined.items() for x in (F.lit(m), F.array(*map(F.lit, finest)))])
        # A mask may come from several; a pattern is one table of fingerprints whichever way they came.
        dealt = hotter.filter(~paired).select("fp", deal(F.element_at(choice, F.col("mask")))).withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        dealt = durable(dealt, "simhash-finer")
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)
    return dealt.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rid: str | None = None) -> DataFrame:
    """One row per document: RID, id_col, fp, component_id, kept.

    component_id is the smallest id that links lead to, the row's own included; kept marks the row that has it (of equal
    ids the one numbered first). Null and empty texts, and texts without words, have fingerprint zero and are linked
    like any other. Texts of any length are read whole; an empty table gives an empty result. Null ids count as largest.
    Extra columns aren't read. ``rid`` names a column of row keys that ``docs`` holds already; else new ones are stored with
    the fingerprints.
    """
    rows = durable(fingerprints(docs, id_col, text_col, shingle, rid), "simhash")
    nodes = durable(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", RID)).alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp")))
    rooted = durable(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots", done=[nodes])
    # Stored, so that the join with a root of very many fingerprints shares no stage with the aggregate and can be split.
    heads = durable(rooted.groupBy("root").agg(F.min("least").alias("head")), "simhash-heads")
    of = durable(rooted.join(heads, "root").select("fp", "head"), "simhash-components", done=[rooted, heads])
    return rows.join(of, "fp").select(RID, F.col("id").alias(id_col), "fp", F.col("head.id").alias("component_id"), (F.col(RID) == F.col(f"head.{RID}")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
