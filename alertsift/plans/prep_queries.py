"""Queries on cleaning, profiling and feature building."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import cleaning as L
from ..operators import features as X
from ..operators import profiling as P
from ..session import materialise
from . import views as V
from .catalog import near, query, r
from .mapping_queries import SPLIT, with_split

COLS = {
    "fwd_packets": "fwd_pkts", "bwd_packets": "bwd_pkts", "fwd_bytes": "fwd_bytes", "bwd_bytes": "bwd_bytes",
    "syn": "fwd_pkts", "ack": "bwd_pkts", "duration": "duration_us", "src_port": "src_port", "dst_port": "dst_port",
    "protocol": "protocol", "src_ip": "src_ip", "dst_ip": "dst_ip",
}


def raw(spark, sf_dir):
    """Segments with the marks of raw captures: -1, infinities, NaN, hexadecimal and empty text."""
    key = F.col("l_orderkey")
    inf = float("inf")
    return V.segments(spark, sf_dir).select(
        F.col("segment_no").alias("row_id"), "label",
        F.when(key % 11 == 0, -1).otherwise(F.col("fwd_pkts")).alias("pkts"),
        F.when(key % 23 == 0, inf).when(key % 29 == 0, -inf).when(key % 31 == 0, float("nan"))
        .otherwise(F.col("len_mean")).alias("rate"),
        F.when(key % 23 == 0, inf).otherwise(F.col("len_mean")).alias("burst"),
        F.col("init_win").cast("double").alias("win"),
        F.lit(None).cast("double").alias("void"),
        F.when(key % 7 == 0, "-1").when(key % 5 == 0, None).otherwise(F.concat(F.lit("m"), (key % 4).cast("string"))).alias("http_request_method"),
        F.concat(F.lit("none"), F.lit("")).alias("http_host"),
        F.when(key % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex("bwd_pkts")))).when(key % 3 == 1, F.col("bwd_pkts").cast("string"))
        .otherwise("n/a").alias("code"),
        "src_ip", "fwd_bytes",
    )


RAW = f"""{V.BASE}, raw AS (SELECT segment_no AS row_id, label, CASE WHEN l_orderkey % 11 = 0 THEN -1 ELSE fwd_pkts END AS pkts,
  CASE WHEN l_orderkey % 23 = 0 THEN 'inf'::DOUBLE WHEN l_orderkey % 29 = 0 THEN '-inf'::DOUBLE WHEN l_orderkey % 31 = 0 THEN 'nan'::DOUBLE ELSE len_mean END AS rate,
  CASE WHEN l_orderkey % 23 = 0 THEN 'inf'::DOUBLE ELSE len_mean END AS burst, CAST(init_win AS DOUBLE) AS win, NULL::DOUBLE AS void,
  CASE WHEN l_orderkey % 7 = 0 THEN '-1' WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'm' || (l_orderkey % 4) END AS http_request_method,
  CASE WHEN l_orderkey % 3 = 0 THEN '0x' || lower(hex(bwd_pkts)) WHEN l_orderkey % 3 = 1 THEN CAST(bwd_pkts AS VARCHAR) ELSE 'n/a' END AS code,
  bwd_pkts, l_orderkey, src_ip, fwd_bytes FROM seg),
cl AS (SELECT row_id, label, nullif(pkts, -1) AS pkts, CASE WHEN isnan(rate) OR isinf(rate) OR rate = -1 THEN NULL ELSE rate END AS rate, burst,
  nullif(win, -1) AS win, void, nullif(http_request_method, '-1') AS method, fwd_bytes FROM raw)"""


def cleaned(spark, sf_dir):
    return L.sentinel_to_null(raw(spark, sf_dir), ["pkts", "rate", "win", "http_request_method"])


@query("b1_sentinel_to_null", f"{RAW} SELECT row_id, fwd_bytes, CAST(pkts AS BIGINT) AS pkts, {r('rate')} AS rate, method FROM cl")
def b1(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "row_id", "fwd_bytes", "pkts", near(F.col("rate")).alias("rate"), F.col("http_request_method").alias("method")
    )


@query(
    "b2_cap_infinity",
    f"""{RAW}, m AS (SELECT max(burst) FILTER (WHERE NOT isinf(burst)) AS mx FROM raw) SELECT row_id, fwd_bytes,
    CAST(coalesce(isinf(burst), false) AS INTEGER) AS burst_is_infinite,
    {r("CASE WHEN burst = 'inf'::DOUBLE THEN mx ELSE burst END")} AS burst FROM raw, m""",
)
def b2(spark, sf_dir):
    df = L.cap_infinity(raw(spark, sf_dir), ["burst", "win"])
    return df.select("row_id", "fwd_bytes", "burst_is_infinite", near(F.col("burst")).alias("burst"))


@query(
    "b3_missing_indicators",
    f"""{RAW} SELECT row_id, fwd_bytes, CAST(pkts IS NULL AS INTEGER) AS pkts_is_missing, CAST(rate IS NULL AS INTEGER) AS rate_is_missing,
    CAST(win IS NULL AS INTEGER) AS win_is_missing, 1 AS void_is_missing FROM cl""",
)
def b3(spark, sf_dir):
    df = L.missing_indicators(cleaned(spark, sf_dir), ["pkts", "rate", "win", "void", "fwd_bytes"])
    return df.select("row_id", *[c for c in df.columns if c.endswith("_is_missing")], "fwd_bytes")


@query(
    "b4_median_impute",
    f"""{RAW}, m AS (SELECT quantile_cont(pkts, 0.5) AS a, quantile_cont(rate, 0.5) AS b FROM cl)
    SELECT row_id, fwd_bytes, {r('coalesce(pkts, a)')} AS pkts, {r('coalesce(rate, b)')} AS rate FROM cl, m""",
)
def b4(spark, sf_dir):
    df = L.median_impute(cleaned(spark, sf_dir), ["pkts", "rate"])
    return df.select("row_id", "fwd_bytes", near(F.col("pkts").cast("double")).alias("pkts"), near(F.col("rate")).alias("rate"))


FIT = f"""{RAW}, sp AS (SELECT *, {SPLIT.format('CAST(row_id AS VARCHAR)')} AS split FROM cl),
md AS (SELECT quantile_cont(pkts, 0.5) AS a, quantile_cont(rate, 0.5) AS b, quantile_cont(win, 0.5) AS c FROM sp WHERE split = 'train'),
mo AS (SELECT method AS mm FROM sp WHERE split = 'train' AND method IS NOT NULL GROUP BY method ORDER BY count(*) DESC, method LIMIT 1)"""


def _fit_frame(spark, sf_dir):
    return with_split(raw(spark, sf_dir).withColumn("key", F.col("row_id").cast("string")), "key")


@query(
    "b5_fit_impute",
    f"""{FIT} SELECT row_id, fwd_bytes, {r('coalesce(pkts, a)')} AS pkts, {r('coalesce(rate, b)')} AS rate, {r('coalesce(win, c)')} AS win,
    CAST(pkts IS NULL AS DOUBLE) AS pkts_is_missing, CAST(rate IS NULL AS DOUBLE) AS rate_is_missing, CAST(win IS NULL AS DOUBLE) AS win_is_missing
    FROM sp, md""",
)
def b5(spark, sf_dir):
    df = _fit_frame(spark, sf_dir)
    model = L.fit_preprocessor(df.where("split = 'train'"), ["pkts", "rate", "win", "void"])
    kept = [c for c in model.features if not c.endswith("_is_missing")]
    return model.apply(df).select(
        "row_id", "fwd_bytes", *[near(F.col(c)).alias(c) for c in kept], *[f"{c}_is_missing" for c in model.indicators]
    )


@query(
    "b6_impute_fallback",
    f"""{RAW}, m AS (SELECT quantile_cont(win, 0.5) AS a FROM cl) SELECT row_id, fwd_bytes, {r('coalesce(win, a)')} AS win, {r('0')} AS void FROM cl, m""",
)
def b6(spark, sf_dir):
    df = L.median_impute(cleaned(spark, sf_dir), ["win", "void"], fallback=0.0)
    return df.select("row_id", "fwd_bytes", near(F.col("win")).alias("win"), near(F.col("void")).alias("void"))


@query(
    "b7_categorical_fill",
    f"{FIT} SELECT row_id, fwd_bytes, coalesce(method, 'unknown') AS unknown_fill, coalesce(method, mm) AS mode_fill FROM sp, mo",
)
def b7(spark, sf_dir):
    df = L.sentinel_to_null(_fit_frame(spark, sf_dir), ["http_request_method"])
    df = df.withColumns({"unknown_fill": F.col("http_request_method"), "mode_fill": F.col("http_request_method")})
    modes = L.fit_modes(df.where("split = 'train'"), ["mode_fill"])
    filled = L.mode_impute(L.fill_unknown(df, ["unknown_fill"]), modes)
    return filled.select("row_id", "fwd_bytes", "unknown_fill", "mode_fill")


@query(
    "b8_one_hot",
    f"""{RAW} SELECT row_id, fwd_bytes, CAST(coalesce(method = 'm0', false) AS INTEGER) AS http_request_method_m0, CAST(coalesce(method = 'm1', false) AS INTEGER) AS http_request_method_m1,
    CAST(coalesce(method = 'm2', false) AS INTEGER) AS http_request_method_m2, CAST(coalesce(method = 'm3', false) AS INTEGER) AS http_request_method_m3 FROM cl""",
)
def b8(spark, sf_dir):
    df = L.one_hot_packets(cleaned(spark, sf_dir).select("row_id", "fwd_bytes", "http_request_method", "http_host"))
    assert "http_host" not in df.columns
    return df


@query(
    "b9_one_hot_fitted",
    f"""{RAW}, sp AS (SELECT *, {SPLIT.format('CAST(row_id AS VARCHAR)')} AS split FROM cl),
    seen AS (SELECT list(DISTINCT method) AS vs FROM sp WHERE split = 'train' AND method <> 'm3')
    SELECT row_id, fwd_bytes, CAST(coalesce(method = 'm0', false) AS INTEGER) AS method_m0, CAST(coalesce(method = 'm1', false) AS INTEGER) AS method_m1,
    CAST(coalesce(method = 'm2', false) AS INTEGER) AS method_m2 FROM sp""",
)
def b9(spark, sf_dir):
    df = L.sentinel_to_null(_fit_frame(spark, sf_dir), ["http_request_method"])
    df = df.select("row_id", "fwd_bytes", "split", F.col("http_request_method").alias("method"))
    train = df.where("split = 'train' AND method <> 'm3'")  # m3 is unseen in training
    return L.one_hot(df, L.fit_categories(train, ["method"])).drop("split")


def _present(df, columns, flag, flagged):
    """Non-null values per column, with a mark for some columns."""
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(F.lit(c).alias("name"), F.lit(int(c in flagged)).alias(flag), F.col(f"n{i}").alias("present"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


@query(
    "b10_split_identifiers",
    V.WITH_PACKETS + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS name, {int(c in ('src_ip', 'dst_ip', 'src_port', 'dst_port'))} AS is_identifier, count({c}) AS present FROM pk"
        for c in ("packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "l4_tcp", "l4_udp", "fwd_pkts", "len_mean", "init_win")
    ) + ")",
)
def b10(spark, sf_dir):
    p = V.packets(spark, sf_dir).select(
        "packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "l4_tcp", "l4_udp", "fwd_pkts", "len_mean", "init_win"
    )
    _, ids = L.split_identifiers(p)
    return _present(p, p.columns, "is_identifier", ids.columns)


@query("b11_keep_numeric", f"{RAW} SELECT row_id, CAST(pkts AS BIGINT) AS pkts, {r('win')} AS win, fwd_bytes FROM cl")
def b11(spark, sf_dir):
    df = L.keep_numeric(cleaned(spark, sf_dir).select("row_id", "pkts", "win", "void", "http_request_method", "fwd_bytes"))
    return df.withColumn("win", near(F.col("win")))


@query(
    "b12_log1p",
    f"{V.BASE} SELECT segment_no, fwd_bytes, {r('ln(1 + CAST(fwd_pkts AS DOUBLE))', 6)} AS plain, {r('ln(1 + abs(CAST(bwd_pkts - 15 AS DOUBLE)))', 6)} AS absolute FROM seg",
)
def b12(spark, sf_dir):
    s = V.segments(spark, sf_dir).select("segment_no", "fwd_bytes", F.col("fwd_pkts").alias("plain"), (F.col("bwd_pkts") - 15).alias("absolute"))
    out = L.log1p(L.log1p(s, ["plain"]), ["absolute"], absolute=True)
    return out.withColumns({c: near(F.col(c), 6) for c in ("plain", "absolute")})


@query(
    "b13_robust_scale",
    f"""{V.BASE}, m AS (SELECT quantile_cont(fwd_bytes, 0.5) AS a, quantile_cont(fwd_bytes, 0.75) - quantile_cont(fwd_bytes, 0.25) AS b FROM seg)
    SELECT segment_no, {r('len_std')} AS len_std, {r('(fwd_bytes - a) / b', 6)} AS scaled, {r('0', 6)} AS flat FROM seg, m""",
)
def b13(spark, sf_dir):
    s = V.segments(spark, sf_dir).select("segment_no", "len_std", F.col("fwd_bytes").alias("scaled"), F.lit(7.0).alias("flat"))
    out = L.fit_robust(s, ["scaled", "flat"]).apply(s)
    return out.select("segment_no", near(F.col("len_std")).alias("len_std"), *[near(F.col(c), 6).alias(c) for c in ("scaled", "flat")])


@query(
    "b14_standard_scale",
    f"""{V.BASE}, sp AS (SELECT *, {SPLIT.format('CAST(segment_no AS VARCHAR)')} AS split FROM seg),
    m AS (SELECT avg(fwd_bytes) AS a, stddev_pop(fwd_bytes) AS b FROM sp WHERE split = 'train')
    SELECT segment_no, split, {r('(fwd_bytes - a) / b', 5)} AS scaled FROM sp, m""",
)
def b14(spark, sf_dir):
    s = V.segments(spark, sf_dir).select("segment_no", F.col("segment_no").cast("string").alias("key"), F.col("fwd_bytes").alias("scaled"))
    s = with_split(s, "key")
    out = L.fit_standard(s.where("split = 'train'"), ["scaled"]).apply(s)
    return out.select("segment_no", "split", near(F.col("scaled"), 5).alias("scaled"))


@query(
    "b15_hex_to_number",
    f"""{RAW}, p AS (SELECT row_id, fwd_bytes, CASE WHEN l_orderkey % 3 < 2 THEN bwd_pkts END AS v FROM raw), m AS (SELECT quantile_cont(v, 0.5) AS a FROM p)
    SELECT row_id, fwd_bytes, {r('coalesce(v, a)')} AS code FROM p, m""",
)
def b15(spark, sf_dir):
    out = L.hex_to_number(raw(spark, sf_dir), ["code"])
    return out.select("row_id", "fwd_bytes", near(F.col("code")).alias("code"))


@query(
    "b16_prepare_packets",
    f"""{V.WITH_PACKETS}, f AS (SELECT packet_id, src_ip, label, ln(1 + CAST(fwd_bytes AS DOUBLE)) AS x, len_mean, init_win FROM pk),
    md AS (SELECT quantile_cont(len_mean, 0.5) AS a, quantile_cont(init_win, 0.5) AS b FROM f),
    g AS (SELECT packet_id, src_ip, label, x, ln(1 + coalesce(len_mean, a)) AS y, ln(1 + coalesce(init_win, b)) AS z,
      CASE WHEN len_mean IS NULL THEN ln(2.0::DOUBLE) ELSE 0.0::DOUBLE END AS m FROM f, md),
    q AS (SELECT quantile_cont(x, 0.5) AS xm, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS xr, quantile_cont(y, 0.5) AS ym,
      quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS yr, quantile_cont(z, 0.5) AS zm, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS zr FROM g)
    SELECT packet_id, src_ip AS id_src_ip, label, {r('(x - xm) / xr', 5)} AS fwd_bytes, {r('(y - ym) / yr', 5)} AS len_mean,
    {r('(z - zm) / zr', 5)} AS init_win, {r('m', 5)} AS len_mean_is_missing FROM g, q""",
)
def b16(spark, sf_dir):
    p = V.packets(spark, sf_dir).select(
        "packet_id", *S.PACKET_ID_COLUMNS, "label", "fwd_bytes", F.col("len_mean"), F.col("init_win").cast("double").alias("init_win")
    )
    out, names = L.prepare_packets(p, ["packet_id", *S.PACKET_ID_COLUMNS])
    wanted = ["fwd_bytes", "len_mean", "init_win", "len_mean_is_missing"]
    assert set(wanted) <= set(names) and not set(names) & {"src_port", "dst_port"}
    return out.select(F.col("id_packet_id").alias("packet_id"), "id_src_ip", "label", *[near(F.col(c), 5).alias(c) for c in wanted])


_B17 = ["label", "source_file", "ts_first", "fwd_pkts", "len_mean", "SegmentCount", "src_port"]


@query(
    "b17_forbid_columns",
    V.WITH_FLOWS + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS name, {int(c in ('label', 'source_file', 'ts_first'))} AS forbidden, count({c}) AS present FROM fl" for c in _B17
    ) + ")",
)
def b17(spark, sf_dir):
    refused = []
    for name in _B17:
        try:
            L.forbid_columns([name])
        except ValueError:
            refused.append(name)
    return _present(V.unified_flows(spark, sf_dir), _B17, "forbidden", refused)


@query(
    "b18_encode_target",
    f"""{V.BASE}, c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM seg))
    SELECT label, CAST(label <> 'benign' AS INTEGER) AS y_binary, CAST(k AS INTEGER) AS y_class, count(*) AS n FROM seg JOIN c USING (label) GROUP BY ALL""",
)
def b18(spark, sf_dir):
    out = L.encode_target(V.segments(spark, sf_dir).select("label"))
    return out.groupBy("label", "y_binary", "y_class").agg(F.count("*").alias("n"))


@query(
    "c1_infinity_report",
    f"""{RAW} SELECT * FROM (SELECT 'rate' AS "column", count(*) FILTER (WHERE isinf(rate)) AS n FROM raw UNION ALL SELECT 'burst', count(*) FILTER (WHERE isinf(burst)) FROM raw)""",
)
def c1(spark, sf_dir):
    return P.infinity_report(raw(spark, sf_dir))


def _union_sql(columns, template):
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


_NUM = ["fwd_pkts", "fwd_bytes", "bwd_bytes", "len_mean", "duration_us"]


@query(
    "c2_outlier_report",
    V.BASE + " SELECT \"column\", outliers, " + r("percent") + " AS percent FROM (" + _union_sql(
        _NUM,
        """SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers,
        100.0 * count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*) AS percent
        FROM seg, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM seg)""",
    ) + ") WHERE outliers > 0",
)
def c2(spark, sf_dir):
    t = P.outlier_report(V.segments(spark, sf_dir), _NUM)
    return t.select("column", "outliers", near(F.col("percent")).alias("percent"))


@query(
    "c3_missing_report",
    V.BASE + " SELECT \"column\", " + r("percent") + " AS percent FROM (" + _union_sql(
        [*_NUM, "init_win"], """SELECT '{c}' AS "column", 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS percent FROM seg"""
    ) + ") WHERE percent > 0",
)
def c3(spark, sf_dir):
    t = P.missing_report(V.segments(spark, sf_dir), [*_NUM, "init_win"])
    return t.select("column", near(F.col("percent")).alias("percent"))


@query(
    "c4_class_counts",
    f"""{V.BASE} SELECT 'class' AS level, label AS value, count(*) AS n, {r('100.0 * count(*) / sum(count(*)) OVER ()')} AS percent FROM seg GROUP BY label
    UNION ALL SELECT 'group', CASE WHEN label = 'benign' THEN 'benign' ELSE 'attack' END, count(*), {r('100.0 * count(*) / sum(count(*)) OVER ()')} FROM seg GROUP BY 2""",
)
def c4(spark, sf_dir):
    t = P.class_counts(V.segments(spark, sf_dir))
    return t.select("level", "value", "n", near(F.col("percent")).alias("percent"))


def vectors(spark, sf_dir):
    """Embedding rows as vectors; label 0 stands for attacks."""
    e = V.table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", (F.col("label") == 0).cast("int").alias("y"), F.col("label").cast("int").alias("klass"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


@query("c5_pca_projection")
def c5(spark, sf_dir):
    out, shares = P.pca_projection(vectors(spark, sf_dir), "features")
    return out.select("vec_id", "pc1", "pc2", *[F.lit(s).alias(f"share{i + 1}") for i, s in enumerate(shares)])


_DIST = ["fwd_pkts", "len_std", "bwd_pkts"]
_DIST_SQL = """m AS (SELECT avg(fwd_pkts) AS a, avg(len_std) AS b, avg(bwd_pkts) AS c FROM seg WHERE label = 'benign'),
  d AS (SELECT segment_no, fwd_bytes, label, sqrt((fwd_pkts - a) * (fwd_pkts - a) + (len_std - b) * (len_std - b) + (bwd_pkts - c) * (bwd_pkts - c)) AS distance FROM seg, m)"""


def _distances(spark, sf_dir):
    return P.centroid_distance(V.segments(spark, sf_dir), _DIST, F.col("label") == "benign")


@query("c6_centroid_distance", f"{V.BASE}, {_DIST_SQL} SELECT segment_no, fwd_bytes, {r('distance')} AS distance FROM d")
def c6(spark, sf_dir):
    return _distances(spark, sf_dir).select("segment_no", "fwd_bytes", near(F.col("distance")).alias("distance"))


@query(
    "c6_centroid_summary",
    f"""{V.BASE}, {_DIST_SQL} SELECT {r("quantile_cont(distance, 0.5) FILTER (WHERE label = 'benign')")} AS benign_median,
    {r("quantile_cont(distance, 0.95) FILTER (WHERE label = 'benign')")} AS benign_p95, {r("quantile_cont(distance, 0.5) FILTER (WHERE label <> 'benign')")} AS attack_median,
    {r("quantile_cont(distance, 0.05) FILTER (WHERE label <> 'benign')")} AS attack_p5 FROM d""",
)
def c6_summary(spark, sf_dir):
    t = P.centroid_summary(_distances(spark, sf_dir), F.col("label") == "benign")
    return t.select(*[near(F.col(c)).alias(c) for c in t.columns])


@query(
    "c7_correlations",
    V.BASE + " SELECT a, b, " + r("c", 5) + " AS corr FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM seg" for a, b in [("fwd_bytes", "duration_us"), ("fwd_bytes", "bwd_bytes"), ("duration_us", "bwd_bytes")]
    ) + ")",
)
def c7(spark, sf_dir):
    t = P.correlations(V.segments(spark, sf_dir), ["fwd_pkts", "bwd_bytes", "fwd_bytes", "duration_us", "len_std"], k=3)
    return t.select("a", "b", near(F.col("corr"), 5).alias("corr"))


@query(
    "c8_mean_differences",
    V.BASE + " SELECT \"column\", " + r("d") + " AS difference FROM (" + _union_sql(
        _NUM, """SELECT '{c}' AS "column", abs(avg({c}) FILTER (WHERE label <> 'benign') - avg({c}) FILTER (WHERE label = 'benign')) AS d FROM seg"""
    ) + ") ORDER BY d DESC LIMIT 3",
)
def c8(spark, sf_dir):
    t = P.mean_differences(V.segments(spark, sf_dir), _NUM, F.col("label") == "benign", 3)
    return t.select("column", near(F.col("difference")).alias("difference"))


@query(
    "c9_crosstab",
    f"""{V.BASE}, t AS (SELECT label, count(*) FILTER (WHERE protocol = 1) AS a, count(*) FILTER (WHERE protocol = 6) AS b, count(*) FILTER (WHERE protocol = 17) AS c FROM seg GROUP BY label)
    SELECT label, a AS "1", b AS "6", c AS "17", {r('a / (a + b + c)', 6)} AS "1_share", {r('b / (a + b + c)', 6)} AS "6_share", {r('c / (a + b + c)', 6)} AS "17_share" FROM t""",
)
def c9(spark, sf_dir):
    t = P.crosstab(V.segments(spark, sf_dir), "label", "protocol", [1, 6, 17])
    return t.select("label", "1", "6", "17", *[near(F.col(f"`{v}_share`"), 6).alias(f"{v}_share") for v in (1, 6, 17)])


@query(
    "c10_score_histogram",
    f"""{V.BASE}, q AS (SELECT min(fwd_bytes) AS lo, (max(fwd_bytes) - min(fwd_bytes)) / 80.0::DOUBLE AS w FROM seg),
    b AS (SELECT label <> 'benign' AS y, CAST(least(floor((fwd_bytes - lo) / w), 79) AS INTEGER) AS bin, lo, w FROM seg, q)
    SELECT CAST(y AS INTEGER) AS y, bin, count(*) AS n, {r('any_value(lo) + bin * any_value(w)', 3)} AS bin_start,
    round(count(*) / (sum(count(*)) OVER (PARTITION BY y) * any_value(w)) * 1e6, 4) AS density FROM b GROUP BY y, bin""",
)
def c10(spark, sf_dir):
    s = V.segments(spark, sf_dir).withColumn("y", (F.col("label") != "benign").cast("int"))
    t = P.histogram(s, "fwd_bytes", ["y"])
    return t.select("y", "bin", "n", near(F.col("bin_start"), 3).alias("bin_start"), F.round(F.col("density") * 1e6, 4).alias("density"))


@query(
    "c10_histogram_2d",
    f"""{V.BASE}, q AS (SELECT min(fwd_bytes) AS x0, (max(fwd_bytes) - min(fwd_bytes)) / 60.0::DOUBLE AS xw, min(bwd_bytes) AS y0, (max(bwd_bytes) - min(bwd_bytes)) / 60.0::DOUBLE AS yw FROM seg)
    SELECT CAST(least(floor((fwd_bytes - x0) / xw), 59) AS INTEGER) AS bin_x, CAST(least(floor((bwd_bytes - y0) / yw), 59) AS INTEGER) AS bin_y, count(*) AS n FROM seg, q GROUP BY 1, 2""",
)
def c10_2d(spark, sf_dir):
    return P.histogram_2d(V.segments(spark, sf_dir), "fwd_bytes", "bwd_bytes")


_ENG = {
    "BytesPerPacket": ("(fwd_bytes + bwd_bytes) / (fwd_pkts + bwd_pkts + 1e-9)", 4),
    "BackwardFraction": ("bwd_pkts / (fwd_pkts + bwd_pkts + 1e-9)", 6),
    "SynAckRatio": ("(fwd_pkts + 1) / (bwd_pkts + 1)", 6),
    "LogDuration": ("ln(1 + CAST(greatest(duration_us, 0) AS DOUBLE))", 6),
    "LogTotalPackets": ("ln(1 + CAST(fwd_pkts + bwd_pkts AS DOUBLE))", 6),
    "LogTotalBytes": ("ln(1 + CAST(fwd_bytes + bwd_bytes AS DOUBLE))", 6),
    "FwdBwdPacketRatio": ("ln((fwd_pkts + 1e-9) / (bwd_pkts + 1e-9))", 5),
    "FwdBwdByteRatio": ("ln((fwd_bytes + 1e-9) / (bwd_bytes + 1e-9))", 5),
}


@query(
    "h1_engineered_behaviour",
    f"{V.BASE} SELECT segment_no, fwd_bytes, " + ", ".join(f"{r(e, d)} AS {n}" for n, (e, d) in _ENG.items()) + " FROM seg",
)
def h1(spark, sf_dir):
    out = X.engineered_behaviour(V.segments(spark, sf_dir), COLS)
    show = lambda n: F.log(F.col(n)) if n.startswith("FwdBwd") else F.col(n)  # noqa: E731 - ratios span 18 decades
    return out.select("segment_no", "fwd_bytes", *[near(show(n), d).alias(n) for n, (_, d) in _ENG.items()])


_RANGE = """CASE WHEN {0} IS NULL OR {0} <= 0 THEN 'none' WHEN {0} <= 1023 THEN 'well_known' WHEN {0} <= 49151 THEN 'registered' ELSE 'ephemeral' END"""


@query("h2_port_range", f"{V.BASE} SELECT {_RANGE.format('src_port')} AS src_range, {_RANGE.format('dst_port')} AS dst_range, count(*) AS n FROM seg GROUP BY 1, 2")
def h2(spark, sf_dir):
    s = V.segments(spark, sf_dir)
    return s.groupBy(X.port_range(F.col("src_port")).alias("src_range"), X.port_range(F.col("dst_port")).alias("dst_range")).agg(
        F.count("*").alias("n")
    )


_SVC = "CASE {0} WHEN 80 THEN 'http' WHEN 8080 THEN 'http' WHEN 443 THEN 'https' WHEN 53 THEN 'dns' END"


@query(
    "h3_service_fields",
    f"""{V.WITH_PACKETS}, p AS (SELECT *, CASE WHEN l4_tcp = 1 THEN 6 WHEN l4_udp = 1 THEN 17 END AS protocol FROM pk)
    SELECT coalesce({_SVC.format('dst_port')}, {_SVC.format('src_port')}, 'other') AS KnownServiceCategory, CAST(coalesce(protocol, 0) AS VARCHAR) AS Protocol,
    CAST(src_port IN (80, 8080, 443) OR dst_port IN (80, 8080, 443) AS INTEGER) AS IsHTTPService, CAST(src_port = 53 OR dst_port = 53 AS INTEGER) AS IsDNSService,
    CAST(dst_port > 0 AND dst_port <= 1023 AS INTEGER) AS IsWellKnownDestinationPort, count(*) AS n FROM p GROUP BY ALL""",
)
def h3(spark, sf_dir):
    p = V.packets(spark, sf_dir).withColumn("protocol", F.when(F.col("l4_tcp") == 1, 6).when(F.col("l4_udp") == 1, 17))
    out = X.service_fields(p, COLS)
    return out.groupBy(
        "KnownServiceCategory", F.col("Protocol"), "IsHTTPService", "IsDNSService", "IsWellKnownDestinationPort"
    ).agg(F.count("*").alias("n")).withColumnRenamed("protocol", "Protocol")


@query(
    "h4_service_aligned",
    f"""{V.BASE}, a AS (SELECT label, CASE
      WHEN label = 'DNS_spoofing' AND protocol IN (6, 17) AND (src_port = 53 OR dst_port = 53) THEN 'aligned'
      WHEN label = 'XSS' AND protocol = 6 AND (src_port IN (80, 443) OR dst_port IN (80, 443)) THEN 'aligned'
      WHEN label IN ('DoS-HTTP', 'DDOS-HTTP_flood') AND protocol = 6 AND (src_port IN (80, 8080) OR dst_port IN (80, 8080)) THEN 'aligned'
      WHEN label = 'brute_force' THEN 'service_indeterminate' WHEN label = 'benign' THEN 'benign' ELSE 'unaligned' END AS service_aligned FROM seg)
    SELECT label, service_aligned, count(*) AS n FROM a GROUP BY ALL""",
)
def h4(spark, sf_dir):
    s = V.segments(spark, sf_dir).withColumn("service_aligned", X.service_aligned(COLS))
    return s.groupBy("label", "service_aligned").agg(F.count("*").alias("n"))


_WINDOWS = {"attempts_hour": 3_600, "attempts_day": 86_400}


@query(
    "h5_attempts_same_target",
    f"""{V.BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, segment_no) AS rn FROM seg)
    SELECT segment_no, rn - count(*) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 3601 PRECEDING) AS attempts_hour,
    rn - count(*) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 2592001 PRECEDING) AS attempts_month FROM n""",
)
def h5(spark, sf_dir):
    windows = {"attempts_hour": 3_600, "attempts_month": 2_592_000}
    s = V.segments(spark, sf_dir).select("segment_no", "src_ip", "dst_ip", "ts")
    out = X.attempts_same_target(s, windows, ["src_ip", "dst_ip"], "ts", "segment_no")
    return out.select("segment_no", *windows)


def _diagnosed(spark, sf_dir):
    s = V.segments(spark, sf_dir).withColumn("attempts_same_target_60s", F.col("bwd_pkts") % 10)
    s = with_split(X.engineered_behaviour(s, COLS).withColumn("key", F.col("segment_no").cast("string")), "key")
    t = X.fit_repetition_thresholds(s.where("label = 'benign' AND split = 'train'"), "duration_us")
    return X.repetition_flags(s, t, "duration_us"), t


_FLAGS = f"""{V.BASE}, e AS (SELECT *, bwd_pkts / (fwd_pkts + bwd_pkts + 1e-9) AS bf, (fwd_pkts + 1) / (bwd_pkts + 1) AS sa, bwd_pkts % 10 AS att,
  {SPLIT.format('CAST(segment_no AS VARCHAR)')} AS split FROM seg),
t AS (SELECT quantile_cont(duration_us, 0.25) AS t1, quantile_cont(bf, 0.10) AS t2, quantile_cont(sa, 0.90) AS t3, quantile_cont(att, 0.99) AS t4
  FROM e WHERE label = 'benign' AND split = 'train'),
f AS (SELECT e.*, CAST(duration_us <= t1 AS INTEGER) AS short_flow, CAST(bf <= t2 AS INTEGER) AS low_response, CAST(sa >= t3 AS INTEGER) AS syn_dominant,
  CAST(att >= t4 AS INTEGER) AS repetition_extreme FROM e, t),
g AS (SELECT *, CAST(repetition_extreme = 1 AND short_flow + low_response + syn_dominant >= 2 AS INTEGER) AS behaviorally_attack_like FROM f)"""


@query(
    "h6_repetition_thresholds",
    f"{_FLAGS} SELECT {r('t1')} AS short_duration, {r('t2', 6)} AS low_backward_fraction, {r('t3', 6)} AS high_syn_ack, {r('t4')} AS extreme_attempts FROM t",
)
def h6(spark, sf_dir):
    _, t = _diagnosed(spark, sf_dir)
    row = [F.lit(t.short_duration), F.lit(t.low_backward_fraction), F.lit(t.high_syn_ack), F.lit(t.extreme_attempts)]
    names = ["short_duration", "low_backward_fraction", "high_syn_ack", "extreme_attempts"]
    return spark.range(1).select(*[near(v, d).alias(n) for v, n, d in zip(row, names, (4, 6, 6, 4))])


@query(
    "h7_repetition_bucket",
    f"""{_FLAGS} SELECT segment_no, fwd_bytes, short_flow, low_response, syn_dominant, repetition_extreme, CASE WHEN behaviorally_attack_like = 1 THEN 'behaviorally_attack_like'
    ELSE 'behaviorally_ambiguous' END AS behavioral_bucket FROM g""",
)
def h7(spark, sf_dir):
    df, _ = _diagnosed(spark, sf_dir)
    return df.select("segment_no", "fwd_bytes", "short_flow", "low_response", "syn_dominant", "repetition_extreme", "behavioral_bucket")


@query(
    "h8_flag_prevalence",
    f"{_FLAGS} SELECT label, split, count(*) AS n, " + ", ".join(f"{r(f'avg({c})', 6)} AS {c}" for c in X.FLAGS) + " FROM g GROUP BY label, split",
)
def h8(spark, sf_dir):
    t = X.flag_prevalence(_diagnosed(spark, sf_dir)[0], ["label", "split"])
    return t.select("label", "split", "n", *[near(F.col(c), 6).alias(c) for c in X.FLAGS])


MODEL_NUMERIC = ["fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "len_mean", "len_std", "init_win", "SegmentCount", *S.ENGINEERED]


def model_frame(spark, sf_dir, variant="service", scale=False, flows=None):
    """(flows with a feature vector, fitted preprocessor): train-only statistics."""
    flows = materialise(V.unified_flows(spark, sf_dir)) if flows is None else flows
    df = with_split(X.flow_features(flows, COLS), "lfid")
    numeric, categorical = X.feature_lists(variant, MODEL_NUMERIC)
    pre = L.fit_preprocessor(df.where("split = 'train'"), numeric, categorical, scale)
    return X.assemble(pre.apply(df), pre.features), pre


@query("h9_feature_matrices")
def h9(spark, sf_dir):
    df, pre = model_frame(spark, sf_dir)
    return df.select(
        "lfid", "label", "split", "service_aligned", F.size(vector_to_array("features")).alias("width"),
        F.lit(len(pre.features)).alias("expected_width"),
    )
