"""Video in a closed loop: what a frame is predicted from is what the reader will have, so that errors don't add up.

A frame has a luma plane and two chroma planes of half its width and height, as flat arrays. Groups of frames start with an I
frame of their own planes. P frames store motion vectors and residuals against the frame before, B frames against it or the next
group's I frame, whichever differs less. Planes and residuals are stored row by row, as ``media.fit_rows`` fits them within ``q``.
Frames of a group depend on each other, so a group and the I frame after it are one task's work; groups are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackfit.operators import media

CODED = "video string, frame long, kind string, ahead boolean, vectors array<int>, plane string, width int, height int, row int, pattern string, params array<double>"
DECODED = "video string, frame long, plane string, width int, height int, a array<int>"
PLANES = ("Y", "Cb", "Cr")


def fit_row(v: np.ndarray, q: float) -> tuple[str, list[float]]:
    """The rule of ``media.fit_rows`` for one row."""
    mean = v.mean()
    if np.abs(v - mean).max() <= q:
        return "CONST", [float(np.floor(mean + 0.5))]
    x = np.arange(len(v))
    slope, start = np.polyfit(x, v, 1) if len(v) > 1 else (0.0, float(v[0]))
    if np.abs(v - (start + slope * x)).max() <= q:
        return "LINEAR", [float(start), float(slope)]
    for degree in (2, 3):
        if len(v) > degree:
            basis = np.vander(x / len(v), degree + 1, increasing=True)
            c, *_ = np.linalg.lstsq(basis, v, rcond=None)
            if np.abs(basis @ c - v).max() <= q:
                return f"POLY{degree}", c.tolist()
    return "RAW", v.astype(float).tolist()


def row_values(pattern: str, params: list[float], n: int) -> np.ndarray:
    x, p = np.arange(n), np.asarray(params)
    if pattern == "CONST":
        v = np.full(n, p[0])
    elif pattern == "LINEAR":
        v = p[0] + p[1] * x
    else:
        v = p if pattern == "RAW" else np.vander(x / n, len(p), increasing=True) @ p
    return np.clip(np.floor(v + 0.5), 0, 255).astype(np.int16)


def vectors(cur: np.ndarray, ref: np.ndarray, block: int = media.MACROBLOCK, reach: int = media.REACH) -> list[tuple[int, int]]:
    """(dx, dy) of each block, by rows: the least absolute difference within the frame, the first by dy, then dx."""
    h, w = cur.shape
    out = []
    for by in range(0, h, block):
        for bx in range(0, w, block):
            part = cur[by : by + block, bx : bx + block]
            ph, pw = part.shape
            top, left = max(-reach, -by), max(-reach, -bx)
            near = ref[by + top : by + min(reach, h - by - ph) + ph, bx + left : bx + min(reach, w - bx - pw) + pw]
            sad = np.abs(np.lib.stride_tricks.sliding_window_view(near, (ph, pw)) - part).sum(axis=(2, 3), dtype=np.int64)
            dy, dx = np.unravel_index(sad.argmin(), sad.shape)
            out.append((int(dx) + left, int(dy) + top))
    return out


def predicted(ref: np.ndarray, found: list[tuple[int, int]], block: int = media.MACROBLOCK) -> np.ndarray:
    h, w = ref.shape
    out, moves = np.empty_like(ref), iter(found)
    for by in range(0, h, block):
        for bx in range(0, w, block):
            dx, dy = next(moves)
            ph, pw = min(block, h - by), min(block, w - bx)
            out[by : by + ph, bx : bx + pw] = ref[by + dy : by + dy + ph, bx + dx : bx + dx + pw]
    return out


def _kinds(frames: list[int], gop: int, last: int) -> dict[int, str]:
    """The rule of ``media.frame_kinds``."""
    return {f: "I" if f % gop == 0 else "B" if f % 2 == 1 and f // gop * gop + gop <= last else "P" for f in frames}


def _dealt(frames: DataFrame, gop: int) -> DataFrame:
    """Rows (video, frame, ...) with last_frame and group; the I frame that follows a group joins it, to be looked at only."""
    last = F.max("frame").over(Window.partitionBy("video"))
    own = F.floor(F.col("frame") / gop).cast("long")
    groups = F.when((F.col("frame") % gop == 0) & (F.col("frame") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    return frames.withColumn("last_frame", last).withColumn("group", F.explode(groups))


def encode(frames: DataFrame, gop: int, q: float) -> DataFrame:
    """Rows (CODED) of frames (video, frame, plane, width, height, a): frames number from 0 without gaps; planes are Y, Cb and Cr."""

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, rows = int(key[1]) * gop, []
        shape = {p: (int(x.height.iloc[0]), int(x.width.iloc[0])) for p, x in pdf.groupby("plane")}
        source = {(int(f), p): np.asarray(a, np.int16).reshape(shape[p]) for f, p, a in zip(pdf.frame, pdf.plane, pdf.a)}
        kinds = _kinds(sorted({f for f, _ in source}), gop, int(pdf.last_frame.iloc[0]))
        done: dict[tuple[int, str], np.ndarray] = {}

        def store(f: int, kind: str, ahead: bool, moves: list[tuple[int, int]], p: str, a: np.ndarray) -> np.ndarray:
            back = np.empty_like(a)
            for r, v in enumerate(a):
                pattern, params = fit_row(v.astype(float), q)
                back[r] = row_values(pattern, params, len(v))
                rows.append((key[0], f, kind, ahead, [x for m in moves for x in m], p, a.shape[1], a.shape[0], r, pattern, params))
            return back

        def against(f: int, kind: str, ref: int, ahead: bool) -> None:
            moves = vectors(source[f, "Y"], done[ref, "Y"])
            for p in PLANES:
                guess = predicted(done[ref, p], moves) if p == "Y" else done[ref, p]
                stored = np.clip(source[f, p] - guess + 128, 0, 255)
                done[f, p] = np.clip(store(f, kind, ahead, moves if p == "Y" else [], p, stored) + guess - 128, 0, 255)

        def own(f: int) -> None:
            for p in PLANES:
                done[f, p] = store(f, "I", False, [], p, source[f, p])

        following = first + gop
        if following in kinds:
            own(following)
            rows.clear()  # its own group stores it
        before = None
        for f in (f for f, k in kinds.items() if first <= f < following and k != "B"):
            own(f) if kinds[f] == "I" else against(f, "P", before, False)
            before = f
        for f in (f for f, k in kinds.items() if first <= f < following and k == "B"):
            past = max(g for g, k in kinds.items() if g < f and k != "B")
            far = {g: int(np.abs(source[f, "Y"] - done[g, "Y"]).sum(dtype=np.int64)) for g in (past, following)}
            ahead = far[following] < far[past]
            against(f, "B", following if ahead else past, ahead)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CODED.split(", ")])

    return _dealt(frames, gop).groupBy("video", "group").applyInPandas(group, CODED)


def decode(coded: DataFrame, gop: int) -> DataFrame:
    """Planes (DECODED) of the rows of ``encode``."""

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, following = int(key[1]) * gop, int(key[1]) * gop + gop
        planes: dict[tuple[int, str], np.ndarray] = {}
        facts: dict[tuple[int, str], tuple] = {}
        for (f, p), x in pdf.sort_values("row").groupby(["frame", "plane"]):
            w = int(x.width.iloc[0])
            planes[int(f), p] = np.stack([row_values(k, v, w) for k, v in zip(x.pattern, x.params)])
            facts[int(f), p] = (x.kind.iloc[0], bool(x.ahead.iloc[0]), list(x.vectors.iloc[0]))
        kind = {f: k for (f, p), (k, _, _) in facts.items() if p == "Y"}
        done = {k: v for k, v in planes.items() if kind[k[0]] == "I"}
        mine = sorted(f for f in kind if first <= f < following)
        for f in [f for f in mine if kind[f] == "P"] + [f for f in mine if kind[f] == "B"]:
            _, ahead, flat = facts[f, "Y"]
            ref = following if ahead else max(g for g in mine if g < f and kind[g] != "B")
            moves = list(zip(flat[::2], flat[1::2]))
            for p in PLANES:
                guess = predicted(done[ref, p], moves) if p == "Y" else done[ref, p]
                done[f, p] = np.clip(planes[f, p] + guess - 128, 0, 255)
        out = [(key[0], f, p, done[f, p].shape[1], done[f, p].shape[0], done[f, p].ravel().astype(int).tolist()) for f in mine for p in PLANES]
        return pd.DataFrame(out, columns=["video", "frame", "plane", "width", "height", "a"])

    own = F.floor(F.col("frame") / gop).cast("long")
    needed = F.when((F.col("kind") == "I") & (F.col("frame") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    return coded.withColumn("group", F.explode(needed)).groupBy("video", "group").applyInPandas(group, DECODED)


def size_of(coded: DataFrame) -> DataFrame:
    """(video, kind, rows, numbers): what is stored by kind of frame."""
    return coded.groupBy("video", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("params")).cast("long").alias("numbers"))
