"""Programming interface and command line: fit, rebuild, verify, analyse, recommend, picture, over files or tables."""

from __future__ import annotations

import argparse
import os
import re
import sys
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit.operators import layout, rebuild
from trackfit.plans import cascade, report, search
from trackfit.session import ready
from trackfit.sources import signals, store


def parse_size(text: str) -> int:
    """A number with an optional binary suffix k, m or g."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgKMG]?)[bB]?\s*", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


def parse_threads(text: str, cores: int | None = None) -> int:
    """A count; 0, ``unlimited`` or ``all`` for every core; or a percentage of them, one at least."""
    cores = cores or os.cpu_count() or 1
    t = text.strip().lower()
    if t in ("0", "unlimited", "all"):
        return cores
    return max(1, cores * int(t[:-1]) // 100) if t.endswith("%") else int(t)


def long_form(arrays: DataFrame) -> DataFrame:
    return arrays.select("blob", F.posexplode("a").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


def fit(signal: DataFrame, s: int | None = None) -> DataFrame:
    """Encodings (blob, s, track, pattern, ints, reals, cost) of a long-form signal, at the best track length or the one given."""
    return cascade.classify(layout.tracks_of_blocks(layout.blocks(signal), [s])) if s else search.encode_best(signal)


def fit_as(signal: DataFrame, lengths: DataFrame, stride: int = 0, chunk: int = 0) -> DataFrame:
    """Encodings (blob, stride, chunk, chunk_id, s, track, ...) of a signal whose records of ``stride`` values are turned to columns, the
    last one filled with zeros, and which is then cut to chunks, each at its best track length; 0: not turned, one chunk."""
    if stride:
        whole = signal.join(lengths, "blob").select("blob", "length", "pos", "v").union(layout.padding(lengths.select("blob", "length"), F.lit(stride)))
        signal = layout.columnar(whole, stride, F.col("length")).select("blob", "pos", "v")
    chunked = layout.chunked(signal, chunk) if chunk else signal.withColumn("chunk_id", F.lit(0).cast("long"))
    e = fit(chunked.select(F.struct("blob", "chunk_id").alias("blob"), "pos", "v"))
    return e.select("blob.blob", F.lit(stride).alias("stride"), F.lit(chunk).cast("long").alias("chunk"), "blob.chunk_id", *[c for c in e.columns if c != "blob"])


def restore(encodings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(blob, pos, v) of encodings; lengths has (blob, length). Stride and chunks of ``fit_as`` are undone."""
    if "chunk_id" not in encodings.columns:
        rebuilt = rebuild.rebuild(encodings.select("blob", "s", "track", "pattern", "ints", "reals")).join(lengths, "blob")
        return rebuild.reassemble(rebuilt, F.col("length"), ["blob"])
    keys = ["blob", "stride", "chunk", "chunk_id"]
    rebuilt = rebuild.rebuild(encodings.select(*keys, "s", "track", "pattern", "ints", "reals")).join(lengths.select("blob", "length"), "blob")
    turned = F.when(F.col("stride") > 0, layout.padded_length(F.col("length"), F.nullif(F.col("stride"), F.lit(0)))).otherwise(F.col("length"))
    start = F.col("chunk_id") * F.col("chunk")
    mine = F.when(F.col("chunk") > 0, F.least(F.col("chunk"), turned - start)).otherwise(turned)
    whole = rebuild.reassemble(rebuilt, mine, [*keys, "length"]).withColumn("pos", F.col("pos") + start)
    # A signal that was not turned is one column: its positions stay.
    return layout.uncolumnar(whole, F.greatest("stride", F.lit(1)), F.col("length")).select("blob", "pos", "v")


def verify(signal: DataFrame, encodings: DataFrame, lengths: DataFrame) -> DataFrame:
    """Differences between a signal and what its encodings give back: no row means equal."""
    a, b = signal.select("blob", "pos", "v"), restore(encodings, lengths)
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))


def stride_choices(signal: DataFrame, lengths: DataFrame, stride: int = 0) -> DataFrame:
    """(blob, stride): the one given, else those that the search tries."""
    if stride:
        return lengths.select("blob", F.lit(stride).alias("stride"))
    return search.stride_candidates(search.stride_scores(signal, lengths), lengths)


#: Fallbacks of raw tracks by the names of --raw; any other name means best.
RAW_NAMES = {"none": "none", "fast": "zlib", "zlib": "zlib", "good": "zstd", "zstd": "zstd", "brotli": "best", "best": "best"}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="trackfit", description=__doc__)
    p.add_argument("files", nargs="*")
    p.add_argument("-d", "--decompress", action="store_true")
    p.add_argument("-t", "--test", action="store_true", help="rebuild and compare")
    p.add_argument("-f", "--force", action="store_true", help="overwrite")
    p.add_argument("-r", "--record", type=int, help="turn records of so many bytes to columns first; with -b the only stride tried")
    p.add_argument("-C", "--chunk", type=parse_size, help="chunk size, with k, m or g; with -b the only one tried. Files over 1 MiB are cut at 64 KiB without -r, -C and -b")
    p.add_argument("-b", "--best", action="store_true", help="search strides and chunks too and encode by the best")
    p.add_argument("-k", "--keep", action="store_true", help="keep the input; it is always kept")
    p.add_argument("-c", "--stdout", action="store_true", help="write to standard output")
    p.add_argument("-v", "--verbose", action="store_true", help="say what was done, on standard error")
    p.add_argument("--raw", default="none", help="compress raw tracks one by one: fast or zlib, good or zstd, best (brotli, which isn't available here, and unknown names mean best); none, as a container is deflated as a whole where that is shorter")
    p.add_argument("--no-zlib", action="store_true", help="the same as --raw none")
    p.add_argument("-j", "--threads", type=parse_threads, default=parse_threads("all"))
    p.add_argument("--analyze", action="store_true")
    p.add_argument("--visualize", action="store_true")
    a = p.parse_args(argv)
    spark = ready(SparkSession.builder.master(f"local[{a.threads}]").config("spark.ui.enabled", "false").getOrCreate())
    for path in a.files:
        if a.decompress or path.endswith(store.SUFFIX):
            e = store.from_containers(spark.read.format("binaryFile").load(path).select(F.col("path").alias("blob"), "content")).cache()
            lengths = e.select("blob", "length").distinct()
            values = restore(e, lengths).orderBy("pos").select("v").toLocalIterator()
            if a.test:  # the container can be read and no value is missing
                n, want = sum(1 for _ in values), sum(r["length"] for r in lengths.collect())
                print(path, "ok" if n == want else f"{want - n} values are missing")
                if n != want:
                    return 1
                continue
            target = path.removesuffix(store.SUFFIX) + ("" if path.endswith(store.SUFFIX) else ".out")
            with nullcontext(sys.stdout.buffer) if a.stdout else open(target, "wb" if a.force else "xb") as f:
                for r in values:
                    f.write(bytes([r["v"]]))
            if a.verbose:
                print(f"{path}: restored", file=sys.stderr)
            continue
        arrays = signals.from_files(spark, path).cache()
        lengths = arrays.select("blob", F.size("a").cast("long").alias("length"))
        signal = long_form(arrays)
        stride, chunk = a.record or 0, a.chunk or 0
        if a.analyze or a.best:
            found = search.modes(signal, lengths, stride_choices(signal, lengths, stride), [chunk] if chunk else None).cache()
            (report.recommend(found) if a.analyze else search.best_mode(found)).show(truncate=False)
            if a.analyze:
                report.pattern_histogram(fit(signal, report.ANALYSIS_SIZE)).orderBy(F.desc("n_tracks")).show(truncate=False)
                continue
            best = search.best_mode(found).first()
            stride, chunk = (best["setting"] if best and best["mode"] == mode else 0 for mode in ("stride", "chunk"))
        elif not stride and not chunk:
            n = arrays.select(F.size("a").alias("n"), layout.gated_chunk(F.size("a")).alias("chunk")).first()
            chunk = n["chunk"] if n and n["chunk"] < n["n"] else 0  # no row: an empty file
        encodings = fit_as(signal, lengths, stride, chunk).cache()
        if a.visualize:
            with open(path + ".svg", "w" if a.force else "x") as f:
                f.write(report.svg(encodings))
        elif a.test:
            wrong = verify(signal, encodings, lengths).count()
            print(path, "ok" if not wrong else f"{wrong} differences")
            if wrong:
                return 1
        else:
            found = store.to_containers(encodings, lengths, "none" if a.no_zlib else RAW_NAMES.get(a.raw, "best")).first()
            content = found["content"] if found else store.pack([], 0, layout.CANDIDATES[0])  # an empty file has no track
            with nullcontext(sys.stdout.buffer) if a.stdout else open(path + store.SUFFIX, "wb" if a.force else "xb") as f:
                f.write(content)
            if a.verbose:
                n = os.path.getsize(path)
                print(f"{path}: {n} to {len(content)} bytes, {100 * len(content) / max(1, n):.1f} %, stride {stride}, chunk {chunk}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
