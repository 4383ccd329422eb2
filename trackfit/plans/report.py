"""Reports over encodings: histograms, recommendation, an SVG picture."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANALYSIS_SIZE = 256


def pattern_histogram(encodings: DataFrame, *keys: str) -> DataFrame:
    """(keys, pattern, n_tracks, payload): most frequent patterns are the largest n_tracks."""
    return encodings.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("cost").cast("long").alias("payload"))


def platter_split(encodings: DataFrame, *keys: str) -> DataFrame:
    """(keys, platter, n_tracks, payload): 0 structured, 1 raw."""
    return encodings.groupBy(*keys, F.when(F.col("pattern") == "RAW", 1).otherwise(0).cast("int").alias("platter")).agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("cost").cast("long").alias("payload"))


def recommend(modes: DataFrame) -> DataFrame:
    """(blob, advice, saving_percent) from (blob, mode, setting, est_size): a mode is advised if it beats plain. ``modes`` are read once."""
    plain = F.min(F.when(F.col("mode") == "plain", F.col("est_size"))).alias("plain_size")
    best = modes.groupBy("blob").agg(F.min(F.struct("est_size", "mode", "setting")).alias("b"), plain).filter("plain_size is not null")
    saving = F.floor(100 * (F.col("plain_size") - F.col("b.est_size")) / F.greatest("plain_size", F.lit(1))).cast("long")
    advice = F.when(F.col("b.est_size") < F.col("plain_size"), F.concat_ws(" ", "b.mode", F.col("b.setting").cast("string"))).otherwise("plain")
    return best.select("blob", advice.alias("advice"), saving.alias("saving_percent"))


def palette(patterns: Iterable[str]) -> dict[str, str]:
    """A hue for each pattern, spread evenly; raw tracks are grey."""
    names = sorted(set(patterns) - {"RAW"})
    return {n: f"hsl({360 * k // max(1, len(names))},65%,50%)" for k, n in enumerate(names)} | {"RAW": "#999999"}


def svg(encodings: DataFrame, most_rings: int = 2000) -> str:
    """Rings of one signal, a track each, coloured by pattern, with a legend of counts.

    A picture has room for so many rings: longer signals show every k-th track; the legend counts all."""
    counts = {r["pattern"]: r["n_tracks"] for r in pattern_histogram(encodings).collect()}
    total = sum(counts.values())
    step = max(1, math.ceil(total / most_rings))
    rings = encodings.filter(F.col("track") % step == 0).select("track", "pattern").orderBy("track").limit(most_rings).collect()
    colour = palette(counts)
    width = 360 / max(1, len(rings))
    parts = ['<svg xmlns="http://www.w3.org/2000/svg" width="1000" height="800" viewBox="0 0 1000 800">']
    parts += [f'<circle cx="400" cy="400" r="{20 + k * width:.2f}" fill="none" stroke="{colour[r["pattern"]]}" stroke-width="{max(width, 0.2):.2f}"/>' for k, r in enumerate(rings)]
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
        parts.append(f'<rect x="800" y="{20 + 24 * k}" width="16" height="16" fill="{colour[name]}"/><text x="824" y="{33 + 24 * k}" font-size="13">{name}: {n}</text>')
    return "".join([*parts, "</svg>"])
