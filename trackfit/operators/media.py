"""Media operators: row fits within an error bound, colour planes, block matching, frames of sound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_ROWS = 4
MACROBLOCK, REACH = 16, 16


# ---- rows of an image -------------------------------------------------------------------------------------------------

def pixels16(low: Column, high: Column) -> Column:
    """Little-endian 16-bit pixels."""
    return low + high * 256


def fit_rows(rows: DataFrame, q: float) -> DataFrame:
    """(keys, v) with kind and params: the first of CONST, LINEAR, POLY2 and POLY3 that is within q of every pixel, else RAW.

    CONST and LINEAR are sums over the row's array in the JVM. The rows that neither fits get least-squares curves over
    x = i / n in Arrow batches, which the others pass through untouched; rows are read once.
    """
    keys = [c for c in rows.columns if c != "v"]
    n = F.size("v")
    total = F.expr("aggregate(v, 0D, (a, x) -> a + x)")
    weighted = F.expr("aggregate(zip_with(v, sequence(0, size(v) - 1), (x, i) -> cast(x as double) * i), 0D, (a, x) -> a + x)")
    r = rows.filter(F.size("v") > 0).withColumns({"n": n, "sy": total, "sxy": weighted})
    sx, sxx = F.col("n") * (F.col("n") - 1) / 2.0, (F.col("n") - 1) * F.col("n") * (2 * F.col("n") - 1) / 6.0
    slope = F.when(F.col("n") > 1, (F.col("n") * F.col("sxy") - sx * F.col("sy")) / (F.col("n") * sxx - sx * sx)).otherwise(F.lit(0.0))
    r = r.withColumns({"mean": F.col("sy") / F.col("n"), "slope": slope}).withColumn("icept", (F.col("sy") - F.col("slope") * sx) / F.col("n"))
    flat = F.expr("array_max(transform(v, x -> abs(x - mean)))")
    line = F.expr("array_max(transform(v, (x, i) -> abs(x - (slope * i + icept))))")
    r = r.withColumns({"e_const": flat, "e_line": line})
    kind = F.when(F.col("e_const") <= q, "CONST").when(F.col("e_line") <= q, "LINEAR")
    params = F.when(F.col("e_const") <= q, F.array(F.round("mean"))).when(F.col("e_line") <= q, F.array("icept", "slope"))
    known = r.withColumns({"kind": kind, "params": params}).select(*keys, "v", "kind", "params")
    return _curves(known, q)


def _curves(rows: DataFrame, q: float) -> DataFrame:
    """Fill in kind and params of rows (..., v, kind, params) where kind is null."""
    place = rows.columns.index("v")

    def fit(v: np.ndarray) -> tuple[str, list[float]]:
        x = np.arange(len(v)) / len(v)
        for degree in (2, 3):
            if len(v) > degree:
                basis = np.vander(x, degree + 1, increasing=True)
                try:
                    c = np.linalg.solve(basis.T @ basis, basis.T @ v)
                except np.linalg.LinAlgError:
                    continue
                if np.abs(basis @ c - v).max() <= q:
                    return f"POLY{degree}", c.tolist()
        return "RAW", v.astype(float).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, params = batch.column(place + 1).to_pylist(), batch.column(place + 2).to_pylist()
            for i in (i for i, k in enumerate(kind) if k is None):
                kind[i], params[i] = fit(np.array(batch.column(place)[i].as_py(), float))
            yield pa.RecordBatch.from_arrays([*batch.columns[: place + 1], pa.array(kind, pa.string()), pa.array(params, pa.list_(pa.float64()))], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def rebuild_rows(fits: DataFrame, n: Column, top: int = 255) -> DataFrame:
    """Pixels of fitted rows: the curve, rounded and held within 0 and ``top``."""
    x = "(i / cast(n as double))"
    value = F.expr(
        f"transform(sequence(0, n - 1), i -> cast(greatest(0D, least({float(top)}D, round(case kind when 'CONST' then params[0] when 'LINEAR' then params[0] + params[1] * i"
        f" when 'RAW' then get(params, i) else params[0] + params[1] * {x} + params[2] * {x} * {x} + coalesce(get(params, 3), 0D) * {x} * {x} * {x} end))) as int))"
    )
    return fits.withColumn("n", n.cast("int")).withColumn("w", value).drop("n")


def row_groups(fits: DataFrame, image: str = "image_id", row: str = "row_idx") -> DataFrame:
    """Rows of an image with equal kind and parameters, four at least, are one group: (image, kind, params, n, first_row)."""
    return fits.groupBy(image, "kind", "params").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first_row")).filter(F.col("n") >= LEAST_ROWS)


# ---- colour ------------------------------------------------------------------------------------------------------------

def _byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(x))).cast("int")


# Coefficients of the colour transform.
def to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return _byte(y), _byte(128 - 0.168736 * r - 0.331264 * g + 0.5 * b), _byte(128 + 0.5 * r - 0.418688 * g - 0.081312 * b)


def to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return _byte(y + 1.402 * (cr - 128)), _byte(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), _byte(y + 1.772 * (cb - 128))


def planes(pixels: DataFrame) -> DataFrame:
    """(keys, x, y, r, g, b) to (keys, plane, x, y, v). Chroma takes the top left pixel of each two by two."""
    keys = [c for c in pixels.columns if c not in ("x", "y", "r", "g", "b")]
    luma, cb, cr = to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.select(*keys, "x", "y", luma.alias("p_Y"), cb.alias("p_Cb"), cr.alias("p_Cr"))
    chosen = F.filter(F.array(*[F.struct(F.lit(n).alias("plane"), F.col(f"p_{n}").alias("v")) for n in ("Y", "Cb", "Cr")]), lambda e: (e["plane"] == "Y") | ((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)))
    out = p.select(*keys, "x", "y", F.inline(chosen))
    half = lambda c: F.when(F.col("plane") == "Y", F.col(c)).otherwise(F.floor(F.col(c) / 2)).cast("long")
    return out.select(*keys, "plane", half("x").alias("x"), half("y").alias("y"), "v")


def from_planes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, plane, x, y, v) back to (keys, x, y, r, g, b); a pixel takes the chroma of its two by two."""
    luma = parts.filter("plane = 'Y'").select(*keys, "x", "y", F.col("v").alias("luma"), F.floor(F.col("x") / 2).alias("hx"), F.floor(F.col("y") / 2).alias("hy"))
    chroma = parts.filter("plane <> 'Y'").groupBy(*keys, F.col("x").alias("hx"), F.col("y").alias("hy")).agg(
        F.max(F.when(F.col("plane") == "Cb", F.col("v"))).alias("cb"), F.max(F.when(F.col("plane") == "Cr", F.col("v"))).alias("cr")
    )
    r, g, b = to_rgb(F.col("luma"), F.col("cb"), F.col("cr"))
    return luma.join(chroma, [*keys, "hx", "hy"]).select(*keys, "x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


# ---- video -------------------------------------------------------------------------------------------------------------

def frame_kinds(frames: DataFrame, gop: int, frame: str = "frame", last: str = "last_frame") -> DataFrame:
    """Add kind (I, B, P), past and future reference frames. I starts a group; odd frames are B where the next group's start
    exists. The future reference is the next I, for writing and reading alike."""
    i = F.col(frame)
    start = (F.floor(i / gop) * gop).cast("long")
    kind = F.when(i % gop == 0, "I").when((i % 2 == 1) & (start + gop <= F.col(last)), "B").otherwise("P")
    before_is_b = ((i - 1) % gop != 0) & ((i - 1) % 2 == 1) & (F.floor((i - 1) / gop) * gop + gop <= F.col(last))
    past = F.when(i % gop != 0, F.when(before_is_b, i - 2).otherwise(i - 1))
    return frames.withColumns({"kind": kind, "past": past.cast("long"), "future": F.when(kind == "B", start + gop).cast("long")})


def residual(current: Column, predicted: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), current - F.coalesce(predicted, F.lit(128)) + 128)).cast("int")


def from_residual(stored: Column, predicted: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), stored + F.coalesce(predicted, F.lit(128)) - 128)).cast("int")


def frame_difference(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of absolute differences of whole frames: pairs (frame, other) over cells (frame, x, y, v)."""
    a = cells.join(pairs, "frame")
    b = cells.select(F.col("frame").alias("other"), "x", "y", F.col("v").alias("w"))
    return a.join(b, ["other", "x", "y"]).groupBy("frame", "other").agg(F.sum(F.abs(F.col("v") - F.col("w"))).cast("long").alias("sad"))


def motion(frames: DataFrame, reach: int = REACH, block: int = MACROBLOCK) -> DataFrame:
    """(key, width, height, cur, ref: arrays) to (key, bx, by, dx, dy, sad): for each block of the luma plane the offset of least
    absolute difference, the first by dy, then dx, among those within the frame. A frame pair is one row, so work is bounded by a frame."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, w, h, cur, ref in pdf[["key", "width", "height", "cur", "ref"]].itertuples(index=False):
            a, b = (np.asarray(x, np.int16).reshape(h, w) for x in (cur, ref))
            for by in range(0, h, block):
                for bx in range(0, w, block):
                    part = a[by : by + block, bx : bx + block]
                    ph, pw = part.shape
                    top, left = max(-reach, -by), max(-reach, -bx)
                    near = b[by + top : by + min(reach, h - by - ph) + ph, bx + left : bx + min(reach, w - bx - pw) + pw]
                    # Every offset at once: rows by dy, columns by dx, so the first least one is first by dy, then dx.
                    sad = np.abs(np.lib.stride_tricks.sliding_window_view(near, (ph, pw)) - part).sum(axis=(2, 3), dtype=np.int64)
                    dy, dx = np.unravel_index(sad.argmin(), sad.shape)
                    out.append((key, bx // block, by // block, int(dx) + left, int(dy) + top, int(sad[dy, dx])))
        return pd.DataFrame(out, columns=["key", "bx", "by", "dx", "dy", "sad"])

    return frames.mapInPandas(lambda it: (search(x) for x in it), "key long, bx long, by long, dx long, dy long, sad long")


def compensate(reference: DataFrame, vectors: DataFrame, block: int = MACROBLOCK) -> DataFrame:
    """Prediction (key, x, y, v) from reference cells (key, x, y, v) and vectors (key, bx, by, dx, dy); 128 where nothing is covered."""
    want = reference.select("key", "x", "y", F.floor(F.col("x") / block).cast("long").alias("bx"), F.floor(F.col("y") / block).cast("long").alias("by")).join(vectors, ["key", "bx", "by"], "left")
    source = reference.select("key", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    moved = want.withColumns({"sx": F.col("x") + F.col("dx"), "sy": F.col("y") + F.col("dy")})
    return moved.join(source, ["key", "sx", "sy"], "left").select("key", "x", "y", F.coalesce("v", F.lit(128)).cast("int").alias("v"))


# ---- sound -------------------------------------------------------------------------------------------------------------

def audio_frames(samples: DataFrame, frame_size: int, channels: int) -> DataFrame:
    """Interleaved samples (audio_id, pos, v) dealt to frames of frame_size samples per channel: adds frame, place and channel."""
    width = frame_size * channels
    return samples.withColumns({"frame": F.floor(F.col("pos") / width).cast("long"), "place": F.pmod("pos", F.lit(width)), "channel": F.pmod("pos", F.lit(channels))})


def frame_rows(framed: DataFrame) -> DataFrame:
    """Frames as rows for ``fit_rows``: (audio_id, frame, v)."""
    return framed.groupBy("audio_id", "frame").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("c")).select("audio_id", "frame", F.transform("c", lambda c: c["v"]).alias("v"))
