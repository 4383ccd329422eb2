"""All registered queries of the track engine and the DuckDB SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit import api, oracles
from trackfit.functions.dialect import DUCK
from trackfit.operators import access, detect, filesystem, groups, layout, media, numeric, rebuild, transforms
from trackfit.plans import cascade, report, search, second
from trackfit.sources import fixtures, signals, store
from trackfit.streaming import chunks

Query = Callable[[SparkSession, str], DataFrame]
INTEGER = [p for p in detect.ORDER if p not in detect.FLOAT_PATTERNS]
FAMILIES = list(fixtures.families())
INTEGER_FAMILIES = [f for f in FAMILIES if f not in detect.FLOAT_PATTERNS]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _register(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql:
        _oracles[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _families(spark: SparkSession, sf_dir: str, names: list[str], near_miss: bool = True) -> DataFrame:
    """(family, s, track, v, filled): tracks of families, and how many of their values aren't padding; only event_id is read, once.
    Grouping is keyed by family and track."""
    cells = fixtures.cells(_table(spark, sf_dir, "events"), names, near_miss)
    grouped = cells.groupBy("family", "n", "track").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    values = F.transform("c", lambda c: c["v"])
    return grouped.select("family", F.col("n").alias("s"), "track", F.concat(values, F.array_repeat(F.lit(0), F.col("n") - F.size("c"))).alias("v"), F.size("c").alias("filled"))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- detectors -----------------------------------------------------------------------------------------------------------

def _detector(pattern: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.detect(_families(spark, sf_dir, list(dict.fromkeys([pattern, "RAW"]))), pattern)
        return found.select("family", F.col("track").cast("long").alias("track"), "fires", F.coalesce(F.array_join("ints", ","), F.lit("")).alias("params"), F.coalesce("cost", F.lit(-1)).alias("cost"))

    return query


def _float_detector(pattern: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = numeric.detect_float(_families(spark, sf_dir, [pattern]), pattern)
        return found.select("family", F.col("track").cast("long").alias("track"), "fires")

    return query


for _p in INTEGER:
    _register(f"detect_{_p.lower()}", _detector(_p), oracles.detector(_p))
for _p in detect.FLOAT_PATTERNS:
    _register(f"detect_{_p.lower()}", _float_detector(_p), oracles.float_detector(_p))


# ---- cascade -------------------------------------------------------------------------------------------------------------

def _cascade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pattern_histogram(cascade.classify(_families(spark, sf_dir, INTEGER_FAMILIES)), "family")


_register("cascade_histogram", _cascade_histogram, f"WITH {oracles.family_tracks(INTEGER_FAMILIES)}, {oracles.cascade('tracks')} SELECT family, pattern, count(*) AS n_tracks, CAST(sum(cost) AS BIGINT) AS payload FROM enc GROUP BY family, pattern")


def _cascade_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cascade.classify(_families(spark, sf_dir, INTEGER_FAMILIES))
    return found.select("family", F.col("track").cast("long").alias("track"), "pattern", F.array_join("ints", ",").alias("params"), "cost")


_register("cascade_tracks", _cascade_tracks, f"WITH {oracles.family_tracks(INTEGER_FAMILIES)}, {oracles.cascade('tracks')} SELECT family, CAST(track AS BIGINT) AS track, pattern, array_to_string(ints, ',') AS params, cost FROM enc")


def _cascade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tracks of every family, float patterns included, without near misses: each is won by its own pattern."""
    complete = _families(spark, sf_dir, FAMILIES, near_miss=False).filter("filled = s")
    return cascade.classify(complete).groupBy("family", "pattern").agg(F.count(F.lit(1)).alias("n_tracks"))


_register("cascade_all_families", _cascade_all, " UNION ALL ".join(f"SELECT '{f}' AS family, '{f}' AS pattern, count(*) // {n} AS n_tracks FROM events HAVING count(*) >= {n}" for f, (n, _) in fixtures.families(DUCK).items()))


def _least_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pattern_histogram(cascade.least_cost(_families(spark, sf_dir, INTEGER_FAMILIES)), "family")


_register("min_cost_mode", _least_cost, f"WITH {oracles.family_tracks(INTEGER_FAMILIES)}, {oracles.cheapest('tracks')} SELECT family, best.pattern AS pattern, count(*) AS n_tracks, CAST(sum(best.cost) AS BIGINT) AS payload FROM enc GROUP BY 1, 2")


def _platter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(report.platter_split(cascade.classify(_families(spark, sf_dir, INTEGER_FAMILIES)), "family"), "platter")


_register("platter_split", _platter_split, f"WITH {oracles.family_tracks(INTEGER_FAMILIES)}, {oracles.cascade('tracks')} SELECT family, CAST(CASE WHEN pattern = 'RAW' THEN 1 ELSE 0 END AS BIGINT) AS platter, count(*) AS n_tracks, CAST(sum(cost) AS BIGINT) AS payload FROM enc GROUP BY 1, 2")


# ---- reconstruction ------------------------------------------------------------------------------------------------------

def _sums(rebuilt: DataFrame, *keys: str) -> DataFrame:
    total = F.expr("aggregate(v, 0L, (a, x) -> a + x)")
    weighted = F.expr("aggregate(transform(v, (x, i) -> cast(x as bigint) * (i + 1)), 0L, (a, x) -> a + x)")
    squares = F.expr("aggregate(transform(v, (x, i) -> cast(x as bigint) * x * ((i * 7) % 31 + 1)), 0L, (a, x) -> a + x)")
    return rebuilt.select(*keys, F.col("track").cast("long").alias("track"), F.size("v").cast("long").alias("n"), total.alias("total"), weighted.alias("weighted"), squares.alias("squares"))


def _original(names: list[str]) -> str:
    return (
        f"WITH {oracles.family_tracks(names)}, x AS (SELECT family, track, n, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM tracks) "
        "SELECT family, CAST(track AS BIGINT) AS track, CAST(max(n) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (i + 1)) AS BIGINT) AS weighted, CAST(sum(v * v * ((i * 7) % 31 + 1)) AS BIGINT) AS squares FROM x GROUP BY family, track"
    )


def _rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(rebuild.rebuild(cascade.classify(_families(spark, sf_dir, FAMILIES))), "family")


_register("rebuild_all_patterns", _rebuild, _original(FAMILIES))


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cascade.classify(_families(spark, sf_dir, FAMILIES)).withColumn("blob", F.concat_ws("/", "family", (F.col("track") % 7).cast("string")))
    lengths = e.groupBy("blob").agg(F.sum("s").cast("long").alias("length"))
    back = store.from_containers(store.to_containers(e, lengths)).withColumn("family", F.substring_index("blob", "/", 1))
    return _sums(rebuild.rebuild(back), "family")


_register("container_roundtrip", _containers, _original(FAMILIES))


def _container_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the heads of real containers say."""
    e = cascade.classify(_families(spark, sf_dir, FAMILIES)).withColumn("blob", F.concat_ws("/", "family", (F.col("track") % 7).cast("string")))
    return _long(store.container_heads(store.to_containers(e, e.groupBy("blob").agg(F.sum("s").cast("long").alias("length")))), "s")


_register("container_heads", _container_heads, f"WITH {oracles.family_tracks(FAMILIES)} SELECT concat_ws('/', family, track % 7) AS blob, CAST(sum(n) AS BIGINT) AS length, n AS s, count(*) AS entries FROM tracks GROUP BY family, n, track % 7")


def _parameters_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in the open, parameters sealed; both come back."""
    key = F.lit("0123456789abcdef")
    sealed = access.seal_parameters(cascade.classify(_families(spark, sf_dir, INTEGER_FAMILIES)).drop("cost"), key)
    rebuilt = rebuild.rebuild(access.open_parameters(sealed, key))
    return _sums(rebuilt, "family", "pattern")


_register(
    "parameters_sealed", _parameters_sealed,
    f"WITH {oracles.family_tracks(INTEGER_FAMILIES)}, {oracles.cascade('tracks')}, x AS (SELECT family, pattern, track, n, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM enc) "
    "SELECT family, pattern, CAST(track AS BIGINT) AS track, CAST(max(n) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (i + 1)) AS BIGINT) AS weighted, CAST(sum(v * v * ((i * 7) % 31 + 1)) AS BIGINT) AS squares FROM x GROUP BY family, pattern, track",
)


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer, inner = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    e = cascade.classify(_families(spark, sf_dir, FAMILIES)).drop("cost")
    return _sums(rebuild.rebuild(access.open_all(access.seal_all(e, outer, inner), outer, inner)), "family")


_register("sealed_roundtrip", _sealed, _original(FAMILIES))


def _structure_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer, inner = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    e = cascade.classify(_families(spark, sf_dir, INTEGER_FAMILIES)).drop("cost")
    return access.structure_view(access.seal_all(e, outer, inner), outer).select("family", F.col("track").cast("long").alias("track"), "pattern")


_register("structure_view", _structure_view, f"WITH {oracles.family_tracks(INTEGER_FAMILIES)}, {oracles.cascade('tracks')} SELECT family, CAST(track AS BIGINT) AS track, pattern FROM enc")


# ---- geometry and searches -----------------------------------------------------------------------------------------------

def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of ``oracles.signals_sql``: one scan of each table."""
    column = lambda name, blob, pos, value: _table(spark, sf_dir, name).selectExpr(f"'{blob}' as blob", f"cast({pos} as bigint) as pos", f"cast(cast(round({value}) as bigint) % 256 as int) as v")
    made = _table(spark, sf_dir, "events").selectExpr(
        "inline(array(struct(concat('stairs/', event_id div 4096) as blob, cast(event_id % 4096 as bigint) as pos, cast((event_id div 64) % 256 as int) as v),"
        " struct(concat('ramps/', event_id div 8192) as blob, cast(event_id % 8192 as bigint) as pos, cast((event_id % 8192) div 64 + event_id % 64 as int) as v),"
        " struct('filled' as blob, cast(event_id as bigint) as pos, 255 as v)))"
    )
    return column("part", "prices", "p_partkey", "p_retailprice * 10").unionByName(column("orders", "totals", "o_orderkey", "o_totalprice * 100")).unionByName(made)


def _encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.classify(layout.tracks_of_blocks(layout.blocks(_signals(spark, sf_dir))))


_GEOMETRY = "WITH " + oracles.geometry(layout.CANDIDATES)
_register("geometry_sizes", lambda s, d: _long(search.sizes(_encodings(s, d)), "s"), f"{_GEOMETRY}, {oracles.META}, {oracles.SIZES} SELECT * FROM sizes")
_register("best_geometry", lambda s, d: _long(search.best_geometry(search.sizes(_encodings(s, d))), "s"), f"{_GEOMETRY}, {oracles.META}, {oracles.SIZES} SELECT blob, arg_min(s, est_size * 1000 + s) AS s, min(est_size) AS est_size FROM sizes GROUP BY blob")
_register(
    "meta_groups", lambda s, d: _long(groups.meta_groups(_encodings(s, d)), "s").select("blob", "s", "pattern", "kind", "n", F.array_join("params", ",").alias("params"), "meta_size"),
    f"{_GEOMETRY}, {oracles.META} SELECT blob, s, pattern, kind, n, array_to_string(params, ',') AS params, CAST(meta_size AS BIGINT) AS meta_size FROM meta",
)


def _remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encodings(spark, sf_dir)
    return _long(groups.remaining(e, groups.meta_groups(e)).groupBy("blob", "s", "pattern").agg(F.count(F.lit(1)).alias("n_tracks")), "s")


_register("remaining_individuals", _remaining, f"{_GEOMETRY}, {oracles.META} SELECT e.blob, e.s, e.pattern, count(*) AS n_tracks FROM enc e ANTI JOIN meta m ON e.blob = m.blob AND e.s = m.s AND e.pattern = m.pattern GROUP BY ALL")
_register(
    "sealed_geometry", lambda s, d: _long(search.best_geometry(search.sealed_sizes(_encodings(s, d))), "s"),
    f"{_GEOMETRY}, z AS (SELECT blob, s, CAST(sum(CASE WHEN pattern IN ({', '.join(repr(p) for p in search.SEALED)}) THEN cost ELSE s END) AS BIGINT) AS est_size FROM enc GROUP BY blob, s) "
    "SELECT blob, arg_min(s, est_size * 1000 + s) AS s, min(est_size) AS est_size FROM z GROUP BY blob",
)
_register("analyze_histogram_256", lambda s, d: report.pattern_histogram(cascade.classify(layout.tracks_of_blocks(layout.blocks(_signals(s, d)), [report.ANALYSIS_SIZE])), "blob"), "WITH " + oracles.geometry([256]) + " SELECT blob, pattern, count(*) AS n_tracks, CAST(sum(cost) AS BIGINT) AS payload FROM enc GROUP BY blob, pattern")


def _breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pattern_histogram(search.encode_best(_signals(spark, sf_dir)), "blob")


_register("pattern_breakdown", _breakdown, f"{_GEOMETRY}, {oracles.META}, {oracles.SIZES}, best AS (SELECT blob, arg_min(s, est_size * 1000 + s) AS s FROM sizes GROUP BY blob) SELECT e.blob, pattern, count(*) AS n_tracks, CAST(sum(cost) AS BIGINT) AS payload FROM enc e JOIN best b ON e.blob = b.blob AND e.s = b.s GROUP BY e.blob, pattern")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals rebuilt from their best encodings: what differs (nothing), and how many values there are."""
    sig = _signals(spark, sf_dir)
    lengths = sig.groupBy("blob").agg(F.count(F.lit(1)).alias("length"))
    wrong = api.verify(sig, api.fit(sig), lengths).groupBy("blob").agg(F.count(F.lit(1)).alias("w"))
    return lengths.join(wrong, "blob", "left").select("blob", "length", F.coalesce("w", F.lit(0)).cast("long").alias("differences"))


_register("verify_roundtrip", _verified, f"SELECT blob, count(*) AS length, CAST(0 AS BIGINT) AS differences FROM ({oracles.signals_sql()}) GROUP BY blob")


def _lay_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(layout.lay_out(_signals(spark, sf_dir), 64), "blob")


_register("layout_tracks", _lay_out, f"WITH sig AS ({oracles.signals_sql()}) SELECT blob, pos // 64 AS track, CAST(64 AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (pos % 64 + 1)) AS BIGINT) AS weighted, CAST(sum(v * v * ((pos % 64 * 7) % 31 + 1)) AS BIGINT) AS squares FROM sig GROUP BY blob, pos // 64")


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.explode(F.array(*[F.lit(s).cast("long") for s in layout.CANDIDATES])).alias("s"))
    tracks = layout.track_count(F.col("n_bytes"), F.col("s"))
    return d.select("doc_id", "s", tracks.alias("tracks"), (tracks * F.col("s")).alias("capacity"))


_register("geometry_capacity", _capacity, f"SELECT doc_id, s, (strlen(coalesce(text, '')) + s - 1) // s AS tracks, (strlen(coalesce(text, '')) + s - 1) // s * s AS capacity FROM (SELECT doc_id, text, CAST(unnest({layout.CANDIDATES}) AS BIGINT) AS s FROM documents)")
_register(
    "chunk_sizes", lambda s, d: _table(s, d, "orders").select("o_orderkey", layout.chunk_size(F.col("o_orderkey") * 9973).alias("chunk"), layout.gated_chunk(F.col("o_orderkey") * 9973).alias("gated")),
    "SELECT o_orderkey, CAST(CASE WHEN n <= 32768 THEN n WHEN n > 33554432 THEN 1048576 ELSE greatest(4096, power(2, ceil(log2((n + 63) // 64)))) END AS BIGINT) AS chunk, CASE WHEN n > 1048576 THEN 65536 ELSE n END AS gated FROM (SELECT o_orderkey, o_orderkey * 9973 AS n FROM orders)",
)


def _columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = _signals(spark, sf_dir)
    lengths = sig.groupBy("blob").agg(F.count(F.lit(1)).alias("length"))
    j = sig.join(lengths, "blob")
    turned = layout.columnar(j, 21, F.col("length")).select("blob", "pos", "v", "length")
    back = layout.uncolumnar(turned.withColumn("turned", F.col("pos")), 21, F.col("length"))
    return back.select("blob", "turned", "pos", F.col("v").cast("long").alias("v"))


_register("columnar_roundtrip", _columnar, f"WITH sig AS ({oracles.signals_sql()}), l AS (SELECT blob, (count(*) + 20) // 21 AS r FROM sig GROUP BY blob) SELECT blob, pos % 21 * r + pos // 21 AS turned, pos, CAST(v AS BIGINT) AS v FROM sig JOIN l USING (blob)")


def _stride_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sig = _signals(spark, sf_dir)
    return sig, sig.groupBy("blob").agg(F.count(F.lit(1)).alias("length"))


_SCORES = f"WITH sig AS ({oracles.signals_sql()}), {oracles.scores('sig')}"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(search.stride_scores(*_stride_inputs(spark, sf_dir)).select("blob", "stride", "matches", "pairs"), "stride")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig, lengths = _stride_inputs(spark, sf_dir)
    return _long(search.stride_candidates(search.stride_scores(sig, lengths), lengths), "stride")


_register("stride_scores", _scores, f"{_SCORES} SELECT * FROM sc")
_register("stride_candidates", _candidates, f"{_SCORES} {oracles.candidates(search.STRIDE_ALWAYS)}")


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stride that is detected or always tried, and every chunk size."""
    return _long(search.all_modes(_signals(spark, sf_dir)), "setting")


_MODES = oracles.modes(search.STRIDE_ALWAYS, search.CHUNKS)
_register("mode_sizes", _modes, f"{_MODES} SELECT * FROM modes")
_register(
    "recommend_mode", lambda s, d: report.recommend(_modes(s, d)),
    f"{_MODES}, p AS (SELECT blob, est_size AS plain FROM modes WHERE mode = 'plain'), b AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY est_size, mode, setting) AS k FROM modes) "
    "SELECT blob, CASE WHEN est_size < plain THEN concat(mode, ' ', setting) ELSE 'plain' END AS advice, CAST(floor(100 * (plain - est_size) / greatest(plain, 1)) AS BIGINT) AS saving_percent FROM b JOIN p USING (blob) WHERE k = 1",
)
_register(
    "best_mode", lambda s, d: search.best_mode(_modes(s, d)),
    f"{_MODES} SELECT blob, mode, setting, est_size FROM modes QUALIFY row_number() OVER (PARTITION BY blob ORDER BY est_size, CASE mode WHEN 'plain' THEN 0 WHEN 'stride' THEN 1 ELSE 2 END, setting) = 1",
)


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pass over raw tracks, for each track length of the first."""
    e = _encodings(spark, sf_dir)
    return _long(second.choose(e, second.recut(e)), "s", "sub_s")


_register("second_pass", _second, oracles.second_pass())

_SECTIONS = [("head", 0, 256), ("table", 256, 1024), ("body", 1280, 4096), ("rest", 5376, 1 << 40)]


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.createDataFrame(_SECTIONS, "section string, start long, length long")
    cut = layout.sections(_signals(spark, sf_dir), named)
    best = search.search_geometry(cut.select(F.struct("blob", "section").alias("blob"), "pos", "v"))
    return best.select("blob.blob", "blob.section", F.col("s").cast("long").alias("s"), "est_size")


_register("section_sizes", _sections, oracles.sections(_SECTIONS))


def _entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = layout.tracks_of_blocks(layout.blocks(_signals(spark, sf_dir)), [512])
    kinds = F.size(F.array_distinct("v")).cast("long")
    return t.select("blob", "track", kinds.alias("kinds"), (kinds > detect.GATE_KINDS).alias("gated"))


_TRACKS512 = f"WITH sig AS ({oracles.signals_sql()}), t AS (SELECT blob, pos // 512 AS track, list_resize(list(v ORDER BY pos), 512, 0) AS v FROM sig GROUP BY blob, pos // 512)"
_register("entropy_gate", _entropy, f"{_TRACKS512} SELECT blob, track, CAST(len(list_distinct(v)) AS BIGINT) AS kinds, len(list_distinct(v)) > 200 AS gated FROM t")


def _mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _signals(spark, sf_dir).groupBy("blob", F.floor(F.col("pos") / 256).cast("long").alias("track"), F.col("v").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("blob", "track").agg(F.max(F.struct("n", "v")).alias("m")).select("blob", "track", "m.v", "m.n")


_register("histogram_mode", _mode, f"WITH sig AS ({oracles.signals_sql()}), c AS (SELECT blob, pos // 256 AS track, CAST(v AS BIGINT) AS v, count(*) AS n FROM sig GROUP BY ALL) SELECT blob, track, arg_max(v, n * 256 + v) AS v, max(n) AS n FROM c GROUP BY blob, track")
_register("byte_delta", lambda s, d: _long(transforms.delta_of_signal(_signals(s, d)), "v"), f"WITH sig AS ({oracles.signals_sql()}) SELECT blob, pos, CAST((v - coalesce(lag(v) OVER (PARTITION BY blob ORDER BY pos), 0) + 256) % 256 AS BIGINT) AS v FROM sig")


def _text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = signals.from_text(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    weighted = F.expr("aggregate(transform(a, (x, i) -> cast(x as bigint) * ((i + 1) % 1009)), 0L, (z, x) -> z + x)")
    return a.select(F.col("blob").alias("doc_id"), F.size("a").cast("long").alias("n_bytes"), weighted.alias("weighted"))


_register("text_bytes", _text_bytes, "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST(coalesce(list_sum(list_transform(range(1, strlen(coalesce(text, '')) + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS INT) * (i % 1009))), 0) AS BIGINT) AS weighted FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents)")


def _text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in the bytes of all documents, in tracks of 64: narrow from the scan to the histogram."""
    a = signals.from_text(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return report.pattern_histogram(cascade.classify(layout.lay_out_arrays(a, [64])))


_register(
    "text_patterns", _text_patterns,
    "WITH d AS (SELECT strlen(coalesce(text, '')) AS m, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE strlen(coalesce(text, '')) > 0), k AS (SELECT h, m, unnest(range((m + 63) // 64)) AS track FROM d), "
    "tracks AS (SELECT CAST(64 AS BIGINT) AS n, list_resize(list_transform(range(64 * track, least(m, 64 * track + 64)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)), 64, 0) AS v FROM k), "
    + oracles.cascade("tracks") + " SELECT pattern, count(*) AS n_tracks, CAST(sum(cost) AS BIGINT) AS payload FROM enc GROUP BY pattern",
)
_register("fallback_sizes", lambda s, d: transforms.best_fallback(transforms.compressed_sizes(_table(s, d, "pages").select("page_id", F.col("html").cast("binary").alias("content")))).drop("content"))


def _bwt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = transforms.bwt(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("blob"), F.col("c_name").alias("text")))
    # One Python pass: the transform goes along as part of the key.
    back = transforms.unbwt(b.select(F.struct("blob", F.hex(F.col("bwt").cast("binary")).alias("bwt_hex")).alias("blob"), "bwt"))
    return back.select(F.col("blob.blob").alias("c_custkey"), "blob.bwt_hex", F.col("text").alias("c_name"))


_register(
    "bwt_names", _bwt_names,
    "SELECT c_custkey, hex(encode(array_to_string(list_transform(list_sort(list_transform(range(1, length(w) + 1), lambda k: substr(w, k) || substr(w, 1, k - 1))), lambda t: substr(t, length(t), 1)), ''))) AS bwt_hex, c_name "
    "FROM (SELECT c_custkey, c_name, c_name || chr(0) AS w FROM customer)",
)


def _fallback_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = transforms.pack_raw(cascade.classify(_families(spark, sf_dir, ["RAW", "DELTA"])))
    return _sums(rebuild.rebuild(transforms.unpack_raw(e)), "family")


_register("fallback_roundtrip", _fallback_roundtrip, _original(["RAW", "DELTA"]))

# ---- media ---------------------------------------------------------------------------------------------------------------

_ROWS = "SELECT CAST(o_orderkey {d} 4096 AS BIGINT) AS image_id, CAST((o_orderkey {d} 64) % 64 AS BIGINT) AS row_idx, CAST(o_orderkey % 64 AS INT) AS i, CAST(CASE (o_orderkey {d} 64) % 5 WHEN 0 THEN 90 + o_orderkey % 3 WHEN 1 THEN 20 + 2 * (o_orderkey % 64) + o_orderkey % 2 WHEN 2 THEN (o_orderkey % 64) * (o_orderkey % 64) {d} 16 WHEN 3 THEN (o_orderkey % 64) * (o_orderkey % 64) * (o_orderkey % 64) {d} 1040 ELSE (o_orderkey * 7919) % 251 END AS INT) AS v FROM {t}"


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.sql(_ROWS.format(d="div", t="{t}"), t=_table(spark, sf_dir, "orders"))
    return cells.groupBy("image_id", "row_idx").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c")).select("image_id", "row_idx", F.transform("c", lambda c: c["v"]).alias("v"))


def _row_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fit_rows(_image_rows(spark, sf_dir), 2.5).select("image_id", "row_idx", "kind")


_FITS = f"""WITH c AS ({_ROWS.format(d='//', t='orders')}), f AS (SELECT image_id, row_idx, avg(v) AS m, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM c GROUP BY ALL),
e AS (SELECT image_id, row_idx, max(abs(v - m)) AS e1, max(abs(v - (coalesce(a, m) + coalesce(b, 0) * i))) AS e2 FROM c JOIN f USING (image_id, row_idx) GROUP BY ALL)"""
# Curves by orthogonal polynomials of the row: the same least squares, by another way than the normal equations.
_CURVES = """,
q1 AS (SELECT image_id, row_idx, v, CAST(i AS DOUBLE) / count(*) OVER r AS x, count(*) OVER r AS n FROM c WINDOW r AS (PARTITION BY image_id, row_idx)),
q2 AS (SELECT *, x - avg(x) OVER r AS p1, x * x - avg(x * x) OVER r AS y2, x * x * x - avg(x * x * x) OVER r AS y3 FROM q1 WINDOW r AS (PARTITION BY image_id, row_idx)),
q3 AS (SELECT *, y2 - p1 * sum(y2 * p1) OVER r / nullif(sum(p1 * p1) OVER r, 0) AS p2, y3 - p1 * sum(y3 * p1) OVER r / nullif(sum(p1 * p1) OVER r, 0) AS z3 FROM q2 WINDOW r AS (PARTITION BY image_id, row_idx)),
q4 AS (SELECT *, z3 - p2 * sum(z3 * p2) OVER r / nullif(sum(p2 * p2) OVER r, 0) AS p3 FROM q3 WINDOW r AS (PARTITION BY image_id, row_idx)),
q5 AS (SELECT *, avg(v) OVER r + p1 * sum(v * p1) OVER r / nullif(sum(p1 * p1) OVER r, 0) + p2 * sum(v * p2) OVER r / nullif(sum(p2 * p2) OVER r, 0) AS f2, p3 * sum(v * p3) OVER r / nullif(sum(p3 * p3) OVER r, 0) AS g3 FROM q4 WINDOW r AS (PARTITION BY image_id, row_idx)),
h AS (SELECT image_id, row_idx, max(n) AS n, max(abs(v - f2)) AS e3, max(abs(v - f2 - g3)) AS e4 FROM q5 GROUP BY image_id, row_idx)"""
_register(
    "row_fit", _row_fit,
    f"{_FITS}{_CURVES} SELECT image_id, row_idx, CASE WHEN e1 <= 2.5 THEN 'CONST' WHEN e2 <= 2.5 THEN 'LINEAR' WHEN n > 2 AND e3 <= 2.5 THEN 'POLY2' WHEN n > 3 AND e4 <= 2.5 THEN 'POLY3' ELSE 'RAW' END AS kind FROM e JOIN h USING (image_id, row_idx)",
)


def _row_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows rebuild within the bound (and the half that rounding adds)."""
    back = media.rebuild_rows(media.fit_rows(_image_rows(spark, sf_dir), 2.5), F.size("v"))
    worst = F.expr("array_max(zip_with(v, w, (x, y) -> abs(x - y)))")
    return back.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(worst <= 3, 1).otherwise(0)).cast("long").alias("within"))


_register("row_rebuild", _row_error, f"SELECT image_id, count(DISTINCT row_idx) AS n_rows, count(DISTINCT row_idx) AS within FROM ({_ROWS.format(d='//', t='orders')}) GROUP BY image_id")
_register(
    "row_groups", lambda s, d: media.row_groups(media.fit_rows(_image_rows(s, d), 2.5).filter("kind = 'CONST'")).select("image_id", "kind", F.expr("cast(params[0] as bigint)").alias("value"), "n", "first_row"),
    f"{_FITS} SELECT image_id, 'CONST' AS kind, CAST(round(m) AS BIGINT) AS value, count(*) AS n, min(row_idx) AS first_row FROM e JOIN f USING (image_id, row_idx) WHERE e1 <= 2.5 GROUP BY 1, 2, 3 HAVING count(*) >= 4",
)

_PIXELS = "SELECT CAST(event_id {d} 1024 AS BIGINT) AS frame, CAST(event_id % 32 AS BIGINT) AS x, CAST((event_id {d} 32) % 32 AS BIGINT) AS y, CAST((event_id * 37) % 256 AS INT) AS r, CAST((event_id * event_id) % 253 AS INT) AS g, CAST((event_id {d} 7) % 251 AS INT) AS b FROM {t}"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PIXELS.format(d="div", t="{t}"), t=_table(spark, sf_dir, "events"))


def _byte_sql(x: str) -> str:
    return f"CAST(greatest(0, least(255, round({x}))) AS BIGINT)"


_Y = _byte_sql("0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b")
_CB = _byte_sql("128::DOUBLE - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b")
_CR = _byte_sql("128::DOUBLE + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b")
_PLANES = f"""WITH p AS ({_PIXELS.format(d='//', t='events')}), q AS (SELECT frame, x, y, {_Y} AS l, {_CB} AS cb, {_CR} AS cr FROM p),
pl AS (SELECT frame, 'Y' AS plane, x, y, l AS v FROM q UNION ALL SELECT frame, 'Cb', x // 2, y // 2, cb FROM q WHERE x % 2 = 0 AND y % 2 = 0 UNION ALL SELECT frame, 'Cr', x // 2, y // 2, cr FROM q WHERE x % 2 = 0 AND y % 2 = 0)"""
_register("colour_planes", lambda s, d: _long(media.planes(_pixels(s, d)), "v"), f"{_PLANES} SELECT * FROM pl")
_register(
    "colour_back", lambda s, d: _long(media.from_planes(media.planes(_pixels(s, d)), ["frame"]), "r", "g", "b"),
    f"{_PLANES}, c AS (SELECT frame, x AS hx, y AS hy, max(v) FILTER (WHERE plane = 'Cb') AS cb, max(v) FILTER (WHERE plane = 'Cr') AS cr FROM pl WHERE plane <> 'Y' GROUP BY ALL) "
    f"SELECT pl.frame, x, y, {_byte_sql('v + 1.402::DOUBLE * (cr - 128)')} AS r, {_byte_sql('v - 0.344136::DOUBLE * (cb - 128) - 0.714136::DOUBLE * (cr - 128)')} AS g, {_byte_sql('v + 1.772::DOUBLE * (cb - 128)')} AS b "
    "FROM pl JOIN c ON pl.frame = c.frame AND x // 2 = hx AND y // 2 = hy WHERE plane = 'Y'",
)


def _frame_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"))
    last = e.agg(F.max("frame").alias("last_frame"))
    return media.frame_kinds(e.join(F.broadcast(last)), 8).select("frame", "kind", F.coalesce("past", F.lit(-1)).alias("past"), F.coalesce("future", F.lit(-1)).alias("future"))


_register(
    "frame_kinds", _frame_kinds,
    """WITH f AS (SELECT event_id AS frame, event_id // 8 * 8 AS st, (SELECT max(event_id) FROM events) AS z FROM events),
    k AS (SELECT *, CASE WHEN frame % 8 = 0 THEN 'I' WHEN frame % 2 = 1 AND st + 8 <= z THEN 'B' ELSE 'P' END AS kind FROM f)
    SELECT frame, kind, CASE WHEN kind <> 'I' THEN max(CASE WHEN kind <> 'B' THEN frame END) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE -1 END AS past, CASE WHEN kind = 'B' THEN st + 8 ELSE -1 END AS future FROM k""",
)


def _luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.planes(_pixels(spark, sf_dir)).filter("plane = 'Y'").select("frame", "x", "y", "v")


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = _luma(spark, sf_dir)
    before = cur.select((F.col("frame") + 1).alias("frame"), "x", "y", F.col("v").alias("p"))
    j = cur.join(before, ["frame", "x", "y"], "left")
    kept = media.residual(F.col("v"), F.col("p"))
    return j.select("frame", "x", "y", kept.cast("long").alias("residual"), media.from_residual(kept, F.col("p")).cast("long").alias("rebuilt"))


_LUMA = f"{_PLANES}, cur AS (SELECT frame, x, y, v FROM pl WHERE plane = 'Y')"
_register("residuals", _residuals, f"{_LUMA} SELECT a.frame, a.x, a.y, greatest(0, least(255, a.v - coalesce(b.v, 128) + 128)) AS residual, greatest(0, least(255, greatest(0, least(255, a.v - coalesce(b.v, 128) + 128)) + coalesce(b.v, 128) - 128)) AS rebuilt FROM cur a LEFT JOIN cur b ON a.frame = b.frame + 1 AND a.x = b.x AND a.y = b.y")


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _luma(spark, sf_dir)
    frames = cells.select("frame").distinct()
    pairs = frames.withColumn("other", F.explode(F.array(F.col("frame") - 1, F.col("frame") + 2)))
    return media.frame_difference(cells, pairs)


_register("frame_differences", _differences, f"{_LUMA} SELECT a.frame, b.frame AS other, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS sad FROM cur a JOIN cur b ON a.x = b.x AND a.y = b.y AND (b.frame = a.frame - 1 OR b.frame = a.frame + 2) GROUP BY a.frame, b.frame")


def _frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _luma(spark, sf_dir).groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("c")).filter(F.size("c") == 1024).select("frame", F.transform("c", lambda c: c["v"]).alias("a"))
    before = whole.select((F.col("frame") + 1).alias("frame"), F.col("a").alias("ref"))
    return whole.join(before, "frame").select(F.col("frame").alias("key"), F.lit(32).alias("width"), F.lit(32).alias("height"), F.col("a").alias("cur"), "ref")


_register(
    "motion_vectors", lambda s, d: media.motion(_frame_pairs(s, d)).withColumnsRenamed({"bx": "block_x", "by": "block_y"}),
    f"""{_LUMA}, w AS (SELECT frame FROM cur GROUP BY frame HAVING count(*) = 1024), o AS (SELECT a.range AS dx, b.range AS dy FROM range(-16, 17) a, range(-16, 17) b),
    s AS (SELECT a.frame AS key, a.x // 16 AS block_x, a.y // 16 AS block_y, dx, dy, count(*) AS n, sum(abs(a.v - b.v)) AS sad FROM cur a, o, cur b
      WHERE b.frame = a.frame - 1 AND b.x = a.x + dx AND b.y = a.y + dy AND a.frame IN (SELECT frame FROM w) AND b.frame IN (SELECT frame FROM w) GROUP BY ALL HAVING count(*) = 256)
    SELECT key, block_x, block_y, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, CAST(sad AS BIGINT) AS sad FROM s QUALIFY row_number() OVER (PARTITION BY key, block_x, block_y ORDER BY sad, dy, dx) = 1""",
)


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "events").select(F.lit("a").alias("audio_id"), F.col("event_id").alias("pos"), F.pmod(F.col("event_id") * 31, F.lit(256)).alias("v"))
    framed = media.audio_frames(samples, 160, 2)
    return framed.groupBy("frame", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("place").alias("last_place"))


_register("audio_frames", _audio, "SELECT event_id // 320 AS frame, event_id % 2 AS channel, count(*) AS n, CAST(sum((event_id * 31) % 256) AS BIGINT) AS total, max(event_id % 320) AS last_place FROM events GROUP BY 1, 2")


# ---- file store ----------------------------------------------------------------------------------------------------------

def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files: a folder for each source, named by it."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id"), F.coalesce("source", F.lit("none")).alias("source"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    folder = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(1 << 31)) + (1 << 40)
    inodes, entries = spark.createDataFrame([], filesystem.INODES), spark.createDataFrame([], filesystem.ENTRIES)
    folders = docs.select("source").distinct().select(folder.alias("ino"), F.lit(filesystem.ROOT).cast("long").alias("parent"), F.col("source").alias("name"))
    inodes, entries = filesystem.mkdir(inodes, entries, folders)
    files = docs.select((F.col("doc_id") + 1).alias("ino"), folder.alias("parent"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "size")
    return filesystem.create(inodes, entries, files)


def _readdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    inodes, entries = _tree(spark, sf_dir)
    top = filesystem.readdir(entries, filesystem.ROOT).select(F.col("name").alias("folder"), F.col("ino").alias("parent"))
    return top.join(entries, "parent").join(inodes, "ino").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


_register("fs_readdir", _readdir, "SELECT coalesce(source, 'none') AS folder, count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY 1")


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, entries = _tree(spark, sf_dir)
    wanted = entries.filter(F.col("parent") != filesystem.ROOT).select("parent", "name")
    return filesystem.lookup(entries, wanted).select("name", "ino")


_register("fs_lookup", _lookup, "SELECT 'doc' || doc_id AS name, doc_id + 1 AS ino FROM documents")


def _fs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    inodes, _ = _tree(spark, sf_dir)
    sized = inodes.filter("kind = 'file'").select("ino", "size", F.floor(F.col("size") * F.pmod("ino", F.lit(5)) / 4).cast("long").alias("encoded"))
    return _long(filesystem.stats(filesystem.route(sized)), "platter")


_register("fs_stats", _fs_stats, "WITH f AS (SELECT strlen(coalesce(text, '')) AS size, strlen(coalesce(text, '')) * ((doc_id + 1) % 5) // 4 AS encoded FROM documents), r AS (SELECT *, CASE WHEN encoded < size * 3 // 4 THEN 0 ELSE 1 END AS platter FROM f) SELECT CAST(platter AS BIGINT) AS platter, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN platter = 0 THEN encoded ELSE size END) AS BIGINT) AS stored FROM r GROUP BY 1")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    inodes, _ = _tree(spark, sf_dir)
    return filesystem.allocated(inodes).select((F.col("ino") - 1).alias("doc_id"), "n_blocks")


_register("fs_blocks", _blocks, "SELECT doc_id, (strlen(coalesce(text, '')) + 511) // 512 AS n_blocks FROM documents")


def _stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    inodes, _ = _tree(spark, sf_dir)
    return filesystem.stat(inodes, 1).select("ino", "kind", F.col("mode").cast("long").alias("mode"), "size")


_register("fs_stat", _stat, "SELECT CAST(1 AS BIGINT) AS ino, 'file' AS kind, CAST(420 AS BIGINT) AS mode, strlen(coalesce(text, '')) AS size FROM documents WHERE doc_id = 0")


def _first_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files take 128 places each from the first on, filled from the front."""
    inodes, _ = _tree(spark, sf_dir)
    held = filesystem.allocated(inodes).filter("n_blocks > 0").select("ino", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("place"))
    blocks = held.select(((F.col("ino") - 1) * 128 + F.col("place")).alias("block"), "ino", "place")
    return filesystem.first_free(blocks, 1 << 16, spark)


_register("fs_first_free", _first_free, "WITH h AS (SELECT doc_id * 128 + unnest(range((strlen(coalesce(text, '')) + 511) // 512)) AS block FROM documents) SELECT min(range) AS block FROM range(65536) WHERE range NOT IN (SELECT block FROM h)")


# ---- streams -------------------------------------------------------------------------------------------------------------

def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the streaming form over a stored table: one pane holds all, so that it equals the batch layout."""
    e = _table(spark, sf_dir, "events")
    t = chunks.stream_tracks(e, F.lit("events"), F.col("event_id"), F.col("user_id"), "ts", 32, window="36500 days")
    return _sums(t, "blob")


_register("stream_tracks", _stream, "SELECT 'events' AS blob, event_id // 32 AS track, CAST(32 AS BIGINT) AS n, CAST(sum(user_id % 256) AS BIGINT) AS total, CAST(sum(user_id % 256 * (event_id % 32 + 1)) AS BIGINT) AS weighted, CAST(sum((user_id % 256) * (user_id % 256) * ((event_id % 32 * 7) % 31 + 1)) AS BIGINT) AS squares FROM events GROUP BY event_id // 32")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade_histogram(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
