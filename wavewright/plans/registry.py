"""Queries over the driver's tables, each with a DuckDB counterpart where SQL can say it.

Series are users' events in order of time: a key that grows with the data, so no series outgrows a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as cols
from ..functions import kernels
from ..operators import controller as ct
from ..operators import corrupt, cues, digests, filters, metrics, scorers, sessions, sets, stats, validate, verify
from ..operators import intervals as iv
from ..operators import windows as wn
from . import benchmark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WINDOW = 32
#: Detection thresholds on raw values.
HIGH = 100.0
K = ["series_id"]
KW = ["series_id", "w"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("series_id"), "event_type", "value")
    return wn.number_samples(e, K, ["ts", "event_id"]).withColumn("t", F.col("t").cast("long")).withColumn("label", F.col("event_type") == "error").drop("ts")


def window_samples(spark: SparkSession, d: str, length: int = WINDOW) -> DataFrame:
    return wn.full_windows(samples(spark, d), K, length)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


S = """s AS (SELECT event_id, user_id AS series_id, event_type, value, event_type = 'error' AS label,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"""


def W(n: int = WINDOW) -> str:
    return S + f""", w0 AS (SELECT *, t // {n} AS w, CAST(t % {n} AS INTEGER) AS i, count(*) OVER (PARTITION BY series_id, t // {n}) AS n FROM s),
    win AS (SELECT event_id, series_id, event_type, value, label, t, w, i FROM w0 WHERE n = {n})"""


def isl(name: str, src: str, keys: str, flag: str, t: str = "t") -> str:
    return f"""{name} AS (SELECT {keys}, min({t}) AS a, max({t}) + 1 AS b FROM (SELECT {keys}, {t},
        {t} - row_number() OVER (PARTITION BY {keys} ORDER BY {t}) AS g FROM {src} WHERE {flag}) GROUP BY {keys}, g)"""


def med3(src: str, keys: str, v: str, order: str) -> str:
    return f"""SELECT *, list_sort([coalesce(lag({v}) OVER k, {v}), {v}, coalesce(lead({v}) OVER k, {v})])[2] AS filtered
        FROM {src} WINDOW k AS (PARTITION BY {keys} ORDER BY {order})"""


SCALE = "greatest((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, stddev_pop(value), 1e-4)"


def noise(key: str) -> str:
    h = f"sha256({key})"
    u = lambda p: f"CAST(CAST('0x' || substr({h}, {p}, 8) AS UBIGINT) AS DOUBLE)"
    return f"sqrt(-2 * ln(({u(1)} + 1) / 4294967297.0)) * cos(2 * pi() * {u(9)} / 4294967296.0)"


# Flagship ---------------------------------------------------------------------------------------------------------


def noisy_windows(spark: SparkSession, d: str, length: int = WINDOW) -> DataFrame:
    w = window_samples(spark, d, length)
    w = filters.with_scale(w, KW)
    return corrupt.hashed_noise(w, KW, F.concat_ws("|", F.lit("n"), F.col("event_id").cast("string")), 0.5)


def flagship(spark: SparkSession, d: str, window: int = WINDOW) -> DataFrame:
    """Error over scale of the median-of-three filter on noisy windows: mean over windows, by series."""
    n = filters.with_scale(noisy_windows(spark, d, window), KW, "observation")
    out = filters.median3(n, KW, "observation", "output", "i")
    rows = metrics.os_nrmse(out, KW, "value", "output", F.col("label"))
    return rows.groupBy(*K).agg(F.count("*").alias("n_windows"), r6(F.avg("os_nrmse"), "os_nrmse"), r6(F.avg("anomaly_os_nrmse"), "anomaly_os_nrmse"))


NOISY = f"""sc AS (SELECT series_id, w, {SCALE} AS scale FROM win GROUP BY ALL),
    noisy AS (SELECT win.*, value + 0.125 * scale * {noise("'n|' || CAST(event_id AS VARCHAR)")} AS obs FROM win JOIN sc USING (series_id, w))"""


@query(f"""WITH {W()}, {NOISY},
    os AS (SELECT series_id, w, greatest((quantile_cont(obs, 0.75) - quantile_cont(obs, 0.25)) / 1.349, stddev_pop(obs), 1e-4) AS oscale FROM noisy GROUP BY ALL),
    f AS ({med3("noisy", "series_id, w", "obs", "i")}),
    m AS (SELECT series_id, w, sqrt(avg(pow(filtered - value, 2))) / first(oscale) AS e, sqrt(avg(pow(filtered - value, 2)) FILTER (WHERE label)) / first(oscale) AS ae
          FROM f JOIN os USING (series_id, w) GROUP BY ALL)
    SELECT series_id, count(*) AS n_windows, round(avg(e), 6) AS os_nrmse, round(avg(ae), 6) AS anomaly_os_nrmse FROM m GROUP BY ALL""")
def os_nrmse_median3(spark, d):
    return flagship(spark, d)


# Sources, parsing, validation ---------------------------------------------------------------------------------------


@query(f"""WITH {S} SELECT series_id, count(*) AS n, round(stddev_pop(value), 6) AS deviation, count(*) FILTER (WHERE NOT isfinite(value)) AS n_bad FROM s GROUP BY ALL""")
def series_validation(spark, d):
    r = validate.series_report(samples(spark, d), K)
    return r.select("series_id", "n", r6(F.col("deviation"), "deviation"), "n_bad")


@query(f"""WITH {S}, c AS (SELECT series_id, count(*) AS n FROM s GROUP BY ALL) SELECT series_id, n, 'too_short' AS reason FROM c WHERE n < 60""")
def series_rejected(spark, d):
    r = validate.series_report(samples(spark, d), K)
    return r.where("n < 60").select("series_id", "n", F.lit("too_short").alias("reason"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'normal' WHEN 2 THEN CAST(value AS VARCHAR) WHEN 3 THEN '' WHEN 4 THEN 'Anomalous' ELSE '-2' END AS raw FROM events)
    SELECT event_id, CASE WHEN lower(trim(raw)) IN ('', '0', 'false', 'normal', 'no') THEN false WHEN lower(trim(raw)) IN ('1', 'true', 'anomaly', 'anomalous', 'yes') THEN true ELSE TRY_CAST(raw AS DOUBLE) <> 0 END AS label FROM x""")
def label_parsing(spark, d):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, " TRUE ").when(k == 1, "normal").when(k == 2, F.col("value").cast("string")).when(k == 3, "").when(k == 4, "Anomalous").otherwise("-2")
    return table(spark, d, "events").select("event_id", validate.parse_label(raw).alias("label"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) || '.0' WHEN 1 THEN '' ELSE 'at ' || CAST(event_id AS VARCHAR) END AS raw FROM events)
    SELECT event_id, CASE WHEN trim(raw) = '' THEN event_id WHEN TRY_CAST(raw AS DOUBLE) = floor(TRY_CAST(raw AS DOUBLE)) THEN CAST(TRY_CAST(raw AS DOUBLE) AS BIGINT) END AS number,
           CASE WHEN trim(raw) <> '' AND TRY_CAST(raw AS DOUBLE) IS NULL THEN raw END AS raw FROM x""")
def time_parsing(spark, d):
    k, i = F.col("event_id") % 3, F.col("event_id").cast("string")
    raw = F.when(k == 0, F.concat(i, F.lit(".0"))).when(k == 1, "").otherwise(F.concat(F.lit("at "), i))
    number, text = validate.parse_time(raw, F.col("event_id"))
    return table(spark, d, "events").select("event_id", number.alias("number"), text.alias("raw"))


@query("""WITH f AS (SELECT user_id, lpad(CAST(user_id AS VARCHAR), 3, '0') || '_SRC' || CAST(user_id % 3 AS VARCHAR) || '_id_' || CAST(user_id % 50 AS VARCHAR) || '_' || first(event_type ORDER BY event_id) || '_tr_' || CAST(count(*) // 2 AS VARCHAR) || '_1st_' || CAST(count(*) AS VARCHAR) || CASE WHEN user_id % 7 = 0 THEN '.txt' ELSE '.csv' END AS name FROM events GROUP BY user_id)
    SELECT name AS file_name, regexp_extract(name, '^(\\d+)_(.+)_id_(\\d+)_(.+)_tr_(\\d+)_1st_(\\d+)\\.csv$', 2) AS source_collection,
           CAST(regexp_extract(name, '^(\\d+)_(.+)_id_(\\d+)_(.+)_tr_(\\d+)_1st_(\\d+)\\.csv$', 3) AS INTEGER) AS source_id, regexp_extract(name, '^(\\d+)_(.+)_id_(\\d+)_(.+)_tr_(\\d+)_1st_(\\d+)\\.csv$', 4) AS domain,
           CAST(regexp_extract(name, '^(\\d+)_(.+)_id_(\\d+)_(.+)_tr_(\\d+)_1st_(\\d+)\\.csv$', 5) AS BIGINT) AS training_end
    FROM f WHERE regexp_matches(name, '^(\\d+)_(.+)_id_(\\d+)_(.+)_tr_(\\d+)_1st_(\\d+)\\.csv$')""")
def file_name_parsing(spark, d):
    return validate.parse_file_name(file_names(spark, d)).select("file_name", "source_collection", "source_id", "domain", "training_end")


def file_names(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("e"), F.count("*").alias("n"))
    u = F.col("user_id")
    ext = F.when(u % 7 == 0, ".txt").otherwise(".csv")
    return e.select(F.concat(F.lpad(u.cast("string"), 3, "0"), F.lit("_SRC"), (u % 3).cast("string"), F.lit("_id_"), (u % 50).cast("string"), F.lit("_"), "e", F.lit("_tr_"), F.expr("n div 2").cast("string"), F.lit("_1st_"), F.col("n").cast("string"), ext).alias("file_name"))


@query("""SELECT 'o_totalprice' AS numeric_column, count(*) AS n FROM orders""")
def numeric_column_choice(spark, d):
    from ..sources.readers import numeric_column

    o = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    return o.agg(F.lit(numeric_column(o, o.columns)).alias("numeric_column"), F.count("*").alias("n"))


@query("""SELECT page_id, regexp_matches(regexp_extract(url, '[^/]*$'), '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AND NOT contains(regexp_extract(url, '[^/]*$'), '..') AS safe FROM pages""")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", validate.safe_name(F.regexp_extract("url", "[^/]*$", 0)).alias("safe"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'uploaded_signal' WHEN o.o_custkey IS NULL THEN 'case_not_certified' WHEN c_custkey % 7 = 0 THEN 'signal_differs' WHEN c_custkey % 11 <> 0 AND c_nationkey <> 3 THEN NULL ELSE 'length_differs' END AS reason
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o_custkey""")
def certificate_eligibility(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    length = F.when((k % 11 != 0) & (F.col("c_nationkey") != 3), 512).otherwise(256)
    requests = c.select("c_custkey", k.cast("string").alias("case_id"), F.when(k % 5 == 0, "upload").otherwise("catalog").alias("origin"), F.when(k % 7 == 0, "x").otherwise("h").alias("signal_digest"), length.alias("length"))
    known = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case_id")).distinct().select("case_id", F.lit("h").alias("signal_digest"), F.lit(512).alias("length"))
    return validate.eligibility(requests, known).select("c_custkey", "reason")


# Windowing ------------------------------------------------------------------------------------------------------------


@query(f"WITH {W()} SELECT series_id, w, count(*) AS n, min(t) AS first_t, round(sum(value), 4) AS total FROM win GROUP BY ALL")
def fixed_windows(spark, d):
    return window_samples(spark, d).groupBy(*KW).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {S}, m AS (SELECT series_id, coalesce(floor(quantile_cont(CASE WHEN label THEN t END, 0.5)), count(*) // 2) AS mid, count(*) AS n FROM s GROUP BY series_id),
    p AS (SELECT series_id, CAST(greatest(0, least(mid - 16, n - 32)) AS BIGINT) AS window_start FROM m WHERE n >= 32)
    SELECT series_id, window_start, count(*) AS n, round(sum(value), 4) AS total FROM s JOIN p USING (series_id) WHERE t >= window_start AND t < window_start + 32 GROUP BY ALL""")
def label_centred_window(spark, d):
    w = wn.extract_window(samples(spark, d), K, WINDOW, F.col("label"))
    return w.groupBy("series_id", "window_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")}, z AS (SELECT series_id, count(*) AS n FROM s GROUP BY ALL)
    SELECT series_id, a AS event_start, b AS event_end, CAST(row_number() OVER (PARTITION BY series_id ORDER BY a) - 1 AS INTEGER) AS event_index, CAST(greatest(0, least((a + b - 1) // 2 - 16, n - 32)) AS BIGINT) AS window_start
    FROM e JOIN z USING (series_id) WHERE n >= 32 QUALIFY b - a <= 3""")
def event_centred_windows(spark, d):
    s = samples(spark, d)
    events = iv.numbered(iv.islands(s, K, F.col("label")), K)
    sizes = s.groupBy(*K).agg(F.count("*").alias("n"))
    return wn.event_windows(events, sizes, K, WINDOW, 3)


@query("""WITH g AS (SELECT source, min(doc_id) AS doc_id, sha256(source) AS h, CAST(100 + count(*) AS BIGINT) AS prefix FROM documents GROUP BY source)
    SELECT source, doc_id, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) % CAST(prefix - 64 + 1 AS UBIGINT) AS BIGINT) AS window_start FROM g WHERE prefix >= 64""")
def normal_prefix_window(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), (F.count("*") + 100).alias("prefix")).withColumn("h", F.sha2("source", 256))
    return wn.normal_prefix_windows(g, "source", "doc_id", "h", "prefix", 64)


@query(f"""WITH {W()}, d AS (SELECT DISTINCT series_id, w FROM win), h AS (SELECT series_id, w, sha256('val|' || CAST(series_id AS VARCHAR) || '|' || CAST(w AS VARCHAR)) AS digest FROM d)
    SELECT series_id, w, digest FROM h QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY digest, w) = 1""")
def window_by_least_hash(spark, d):
    return wn.least_hash_window(window_samples(spark, d).select(*KW).distinct(), "series_id", "w", "val")


@query(f"""WITH {S}, c AS (SELECT series_id, t, list(value) OVER k AS v, first_value(value) OVER (PARTITION BY series_id ORDER BY t) AS f FROM s WINDOW k AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
    SELECT series_id, t, CAST(CASE WHEN v IS NULL THEN 0 ELSE len(v) END AS INTEGER) AS n_seen, round(((4 - CASE WHEN v IS NULL THEN 0 ELSE len(v) END) * f + coalesce(list_sum(v), 0)) / 4, 6) AS mean FROM c""")
def causal_context(spark, d):
    c = wn.causal_contexts(samples(spark, d), K, 4)
    mean = F.aggregate("context", F.lit(0.0), lambda a, x: a + x) / 4
    return c.select("series_id", "t", F.least(F.col("t"), F.lit(4)).cast("int").alias("n_seen"), r6(mean, "mean"))


@query(f"""WITH {S}, z AS (SELECT series_id, count(*) AS n FROM s GROUP BY ALL) SELECT series_id, least(greatest(20, 64), 2048, n) AS window_length, greatest(0, least(40, n - least(greatest(20, 64), 2048, n))) AS window_start FROM z""")
def request_clamp(spark, d):
    z = samples(spark, d).groupBy(*K).agg(F.count("*").alias("n"))
    return wn.clamp_request(z, F.lit(40), F.lit(20)).drop("n")


@query(f"""WITH {W()} SELECT series_id, w, i, value FROM win""")
def pack_round_trip(spark, d):
    return wn.unpack(wn.pack(window_samples(spark, d), KW, ["value"]), KW, ["value"])


# Intervals ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")} SELECT series_id, a AS "start", b AS "end" FROM e""")
def label_islands(spark, d):
    return iv.islands(samples(spark, d), K, F.col("label"))


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")} SELECT series_id, a AS "start", b - 1 AS stop FROM e""")
def label_islands_inclusive(spark, d):
    return iv.islands_inclusive(samples(spark, d), K, F.col("label"))


@query(f"""WITH {S} SELECT series_id, t, max(CAST(value >= 100 AS INTEGER)) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS dilated FROM s""")
def dilated_mask(spark, d):
    return iv.dilate(samples(spark, d), K, F.col("value") >= HIGH, 2).select("series_id", "t", "dilated")


MERGE = """m0 AS (SELECT series_id, a, b, CASE WHEN a > max(b) OVER (PARTITION BY series_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS nw FROM {src}),
    m1 AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY a) AS g FROM m0), m AS (SELECT series_id, min(a) AS a, max(b) AS b FROM m1 GROUP BY series_id, g)"""


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")}, {MERGE.format(gap=2, src="e")} SELECT series_id, a AS "start", b AS "end" FROM m""")
def merged_intervals(spark, d):
    return iv.merge(iv.islands(samples(spark, d), K, F.col("label")), K, gap=2)


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")}, z AS (SELECT series_id, count(*) AS n FROM s GROUP BY ALL), x AS (SELECT series_id, a - 3 AS a, b + 3 AS b FROM e), {MERGE.format(gap=-1, src="x")}
    SELECT series_id, greatest(a, 0) AS "start", least(b, n) - 1 AS stop FROM m JOIN z USING (series_id)""")
def buffered_events(spark, d):
    s = samples(spark, d)
    events = iv.islands_inclusive(s, K, F.col("label")).join(s.groupBy(*K).agg(F.count("*").alias("n")), K)
    return iv.merge_buffered(events, K, 6, F.col("n"))


DIST = """d AS (SELECT s.series_id, s.t, {expr} AS v FROM s LEFT JOIN (SELECT series_id, a, b FROM e) e ON s.series_id = e.series_id AND s.t >= a - {r} AND s.t < b + {r} AND (s.t < a OR s.t >= b) GROUP BY s.series_id, s.t)"""


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")}, {DIST.format(expr="sum(sqrt(1 - greatest(a - s.t, s.t - b + 1) / 6.0))", r=3)}
    SELECT series_id, t, round(least(1.0, CAST(label AS INTEGER) + coalesce(v, 0)), 6) AS extended FROM s JOIN d USING (series_id, t)""")
def extended_labels(spark, d):
    return iv.extend_labels(samples(spark, d), K, F.col("label"), 6).select("series_id", "t", r6(F.col("extended"), "extended"))


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")}, {DIST.format(expr="max(1 - greatest(a - s.t, s.t - b + 1) / 4.0)", r=3)}
    SELECT series_id, t, round(greatest(CAST(label AS INTEGER), coalesce(v, 0)), 6) AS soft FROM s JOIN d USING (series_id, t)""")
def soft_labels(spark, d):
    return iv.soft_labels(samples(spark, d), K, F.col("label"), 3).select("series_id", "t", r6(F.col("soft"), "soft"))


TILES = f"""WITH {S}, {isl("e", "s", "series_id", "label")}, {isl("h", "s", "series_id", "value >= 100")}, z AS (SELECT series_id, count(*) AS n FROM s GROUP BY ALL),
    r AS (SELECT series_id, greatest(0, a - 2) AS a, b + 2 AS b, 'A:retention' AS reason FROM e UNION ALL SELECT series_id, greatest(0, a - 1) AS a, b + 1 AS b, 'B:fabrication' FROM h),
    x AS (SELECT DISTINCT series_id, n, reason, unnest(generate_series(a // 8, (least(b, n) - 1) // 8)) AS tile FROM r JOIN z USING (series_id) WHERE least(b, n) > a),
    tl AS (SELECT series_id, tile * 8 AS a, least(tile * 8 + 8, n) AS b, list_sort(list(reason)) AS reasons FROM x GROUP BY series_id, tile, n)"""


def reason_rows(spark, d):
    s = samples(spark, d)
    rows = iv.islands(s, K, F.col("label")).select("series_id", (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end"), F.lit("A:retention").alias("reason"))
    more = iv.islands(s, K, F.col("value") >= HIGH).select("series_id", (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"), F.lit("B:fabrication").alias("reason"))
    return rows.unionByName(more).join(s.groupBy(*K).agg(F.count("*").alias("n")), K)


@query(TILES + """ SELECT series_id, a AS tile_start, b AS tile_end, array_to_string(reasons, ';') AS reasons FROM tl""")
def tile_cover(spark, d):
    return iv.tiles(reason_rows(spark, d), K, 8, F.col("n")).withColumn("reasons", F.array_join("reasons", ";"))


@query(TILES + """, g0 AS (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY series_id ORDER BY a) THEN 0 ELSE 1 END AS nw FROM tl), g1 AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY a) AS g FROM g0)
    SELECT series_id, min(a) AS "start", max(b) AS "end", array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ';') AS reasons FROM g1 GROUP BY series_id, g""")
def merged_tiles(spark, d):
    out = iv.merge_tiles(iv.tiles(reason_rows(spark, d), K, 8, F.col("n")), K)
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")}, {isl("h", "s", "series_id", "value >= 100")}
    SELECT series_id, a - 2 - 8 AS "start", b + 1 + 8 AS "end", 'A:retention' AS reason FROM e UNION ALL SELECT series_id, a - 8, b + 8, 'B:fabrication' FROM h""")
def failure_localisation(spark, d):
    s = samples(spark, d)
    w = spark.createDataFrame([("A", 2, 1), ("B", 0, 0)], "witness_id string, context_left int, context_right int")
    return iv.localise_failures(iv.islands(s, K, F.col("label")).withColumn("witness_id", F.lit("A")), iv.islands(s, K, F.col("value") >= HIGH).withColumn("witness_id", F.lit("B")), K, w, 8)


HALO = ", ".join(map(str, (1.0, *iv.HALO)))


@query(f"""WITH {S}, {isl("e", "s", "series_id", "value >= 200")},
    d AS (SELECT s.series_id, s.t, max(CASE WHEN a IS NOT NULL THEN [{HALO}][CAST(greatest(a - s.t, s.t - b + 1, 0) + 1 AS BIGINT)] END) AS v FROM s LEFT JOIN e ON s.series_id = e.series_id AND s.t >= a - 8 AND s.t < b + 8 GROUP BY s.series_id, s.t)
    SELECT series_id, t, round(coalesce(v, 0), 8) AS weight FROM d""")
def halo_weights(spark, d):
    s = samples(spark, d)
    return iv.halo_weights(s, iv.islands(s, K, F.col("value") >= 200), K).select("series_id", "t", F.round("weight", 8).alias("weight"))


@query(f"""WITH {S}, x AS (SELECT series_id, t, least(4, floor(value / 60)) / 4.0 AS beta FROM s), y AS (SELECT *, CASE WHEN beta = lag(beta) OVER k AND t = lag(t) OVER k + 1 THEN 0 ELSE 1 END AS nw FROM x WHERE beta > 0 WINDOW k AS (PARTITION BY series_id ORDER BY t)),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY t) AS g FROM y)
    SELECT series_id, min(t) AS "start", max(t) + 1 AS "end", first(CAST(beta AS DOUBLE)) AS beta, CASE WHEN first(beta) = 1 THEN 'protect' ELSE 'blend' END AS action FROM g GROUP BY series_id, g""")
def beta_runs(spark, d):
    s = samples(spark, d).withColumn("beta", F.least(F.lit(4), F.floor(F.col("value") / 60)) / 4.0)
    return iv.beta_runs(s, K)


@query(f"""WITH {S}, r AS (SELECT *, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM s WHERE value >= 60)
    SELECT series_id, min(t) AS "start", max(t) + 1 AS "end", first(t ORDER BY value DESC, t) AS peak_t, max(value) AS peak_score FROM r GROUP BY series_id, g""")
def component_peaks(spark, d):
    return iv.components(samples(spark, d), K, F.col("value") >= 60, "value")


EXTREMA = f"""WITH {W()}, sc AS (SELECT series_id, w, {SCALE} AS scale FROM win GROUP BY ALL), dd AS (SELECT *, value - lag(value) OVER k AS l, lead(value) OVER k - value AS r, 0.01 * scale AS f FROM win JOIN sc USING (series_id, w) WINDOW k AS (PARTITION BY series_id, w ORDER BY i)),
    ex AS (SELECT series_id, w, i, value, CASE WHEN l > f AND r <= -f THEN 1 WHEN l < -f AND r >= f THEN -1 END AS polarity FROM dd)"""


@query(EXTREMA + " SELECT series_id, w, i, value, polarity FROM ex WHERE polarity IS NOT NULL")
def local_extrema(spark, d):
    w = window_samples(spark, d)
    w = filters.with_scale(w, KW)
    return iv.local_extrema(w, KW, "value", F.col("scale"), "i")


@query(f"""WITH {S}, d AS (SELECT a.series_id, a.t, max((p.value / 300.0) * (1 - abs(a.t - p.t) / 4.0)) AS v FROM s a LEFT JOIN (SELECT * FROM s WHERE value >= 150) p ON a.series_id = p.series_id AND abs(a.t - p.t) <= 3 GROUP BY ALL)
    SELECT series_id, t, round(coalesce(v, 0), 6) AS spread FROM d""")
def peak_spreading(spark, d):
    s = samples(spark, d)
    peaks = s.where("value >= 150").select("series_id", F.col("t").alias("center"), (F.col("value") / 300.0).alias("height"))
    return iv.spread_peaks(s, peaks, K, 3).select("series_id", "t", r6(F.col("spread"), "spread"))


@query(f"""WITH {S}, z AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s) SELECT series_id, t, t >= 16 AND t < n - 2 AS valid FROM z""")
def warm_up_mask(spark, d):
    s = samples(spark, d)
    return iv.certifiable(s.join(s.groupBy(*K).agg(F.count("*").alias("n")), K), 16, 2, F.col("n")).select("series_id", "t", "valid")


@query(f"""WITH {S} SELECT series_id, t, max(CAST(value >= 100 AS INTEGER)) OVER k = 1 AND max(CAST(label AS INTEGER)) OVER k = 1 AS shared FROM s WINDOW k AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def shared_evidence(spark, d):
    return iv.shared_evidence(samples(spark, d), K, [F.col("value") >= HIGH, F.col("label")]).select("series_id", "t", "shared")


@query(TILES + """, x2 AS (SELECT series_id, t, least(4, floor(value / 60)) / 4.0 AS beta FROM s), y AS (SELECT *, CASE WHEN beta = lag(beta) OVER k AND t = lag(t) OVER k + 1 THEN 0 ELSE 1 END AS nw FROM x2 WHERE beta > 0 WINDOW k AS (PARTITION BY series_id ORDER BY t)),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY t) AS g FROM y), b0 AS (SELECT series_id, min(t) AS a, max(t) + 1 AS b FROM g GROUP BY series_id, g)
    SELECT b0.series_id, b0.a AS "start", b0.b AS "end", coalesce(array_to_string(list_sort(list_distinct(flatten(list(tl.reasons) FILTER (WHERE tl.reasons IS NOT NULL)))), ';'), '') AS reasons FROM b0 LEFT JOIN tl ON tl.series_id = b0.series_id AND tl.a < b0.b AND tl.b > b0.a GROUP BY b0.series_id, b0.a, b0.b""")
def runs_with_reasons(spark, d):
    s = samples(spark, d).withColumn("beta", F.least(F.lit(4), F.floor(F.col("value") / 60)) / 4.0)
    tiled = iv.tiles(reason_rows(spark, d), K, 8, F.col("n"))
    out = iv.runs_with_reasons(iv.beta_runs(s, K), tiled, K)
    return out.select("series_id", "start", "end", F.array_join("reasons", ";").alias("reasons"))


# Joins -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")}, {isl("h", "s", "series_id", "value >= 100")} SELECT h.series_id, h.a AS "start", h.b AS "end" FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.series_id = h.series_id AND e.a < h.b AND h.a < e.b)""")
def newly_false_runs(spark, d):
    s = samples(spark, d)
    return verify.newly_false(iv.islands(s, K, F.col("label")), iv.islands(s, K, F.col("value") >= HIGH), K)


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")} SELECT e.series_id, a AS "start", b AS "end", bool_or(value >= 100) AS hit FROM e JOIN s ON s.series_id = e.series_id AND t >= a AND t < b GROUP BY ALL""")
def event_hits(spark, d):
    s = samples(spark, d)
    return metrics.event_hits(s, iv.islands(s, K, F.col("label")), K, {"hit": F.col("value") >= HIGH})


@query(EXTREMA + """, l AS (SELECT * FROM ex WHERE polarity IS NOT NULL), o AS (SELECT series_id, w, i, polarity FROM l WHERE value >= 40), n AS (SELECT series_id, w, i AS j, polarity FROM l WHERE value < 90),
    p AS (SELECT o.series_id, o.w, o.i, o.polarity, j, abs(o.i - j) AS distance FROM o LEFT JOIN n ON o.series_id = n.series_id AND o.w = n.w AND o.polarity = n.polarity AND abs(o.i - j) <= 4)
    SELECT series_id, w, i, polarity, j AS match_t, distance FROM p QUALIFY row_number() OVER (PARTITION BY series_id, w, i, polarity ORDER BY distance, j) = 1""")
def nearest_extremum(spark, d):
    w = window_samples(spark, d)
    e = iv.local_extrema(filters.with_scale(w, KW), KW, "value", F.col("scale"), "i")
    left, right = e.where("value >= 40").select(*KW, "i", "polarity"), e.where("value < 90").select(*KW, "i", "polarity")
    return sets.nearest_match(left, right, KW, 4, "polarity", "i")


@query("""SELECT c_nationkey, count(*) AS n, round(avg(d), 6) AS mean_difference FROM (SELECT c_nationkey, avg(o_totalprice) - avg(c_acctbal) AS d FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey, c_custkey) GROUP BY ALL""")
def paired_clusters(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("value")).withColumnRenamed("o_custkey", "c_custkey")
    left = sets.only_keys(c.select("c_custkey", F.col("c_acctbal").alias("value")), o, ["c_custkey"])
    p = sets.paired_values(left, o, ["c_custkey"])
    return p.join(c.select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("n"), r6(F.avg(F.col("right") - F.col("left")), "mean_difference"))


@query("""SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey""")
def prefix_semi_join(spark, d):
    return sets.only_keys(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT m.method, s.scorer, n_nationkey, n_name FROM nation CROSS JOIN (VALUES ('a'), ('b'), ('c')) m(method) CROSS JOIN (VALUES ('A'), ('B')) s(scorer)""")
def condition_expansion(spark, d):
    m, s = spark.createDataFrame([("a",), ("b",), ("c",)], "method string"), spark.createDataFrame([("A",), ("B",)], "scorer string")
    return sets.expand(table(spark, d, "nation").select("n_nationkey", "n_name"), m, s)


@query("""WITH a AS (SELECT doc_id, sha256(source) AS h FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN lang ELSE source END) AS h FROM documents WHERE doc_id % 50 <> 7)
    SELECT doc_id, a.h AS expected, b.h AS actual FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def hash_audit(spark, d):
    t = table(spark, d, "documents")
    a = t.select("doc_id", F.sha2("source", 256).alias("h"))
    b = t.where("doc_id % 50 <> 7").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.col("lang")).otherwise(F.col("source")), 256).alias("h"))
    return sets.mismatches(a, b, ["doc_id"], "h")


# Normalisation and filters ---------------------------------------------------------------------------------------------


@query(f"""WITH {W()} SELECT series_id, w, round(quantile_cont(value, 0.5), 6) AS center, round({SCALE}, 6) AS scale FROM win GROUP BY ALL""")
def window_scales(spark, d):
    s = filters.scales(window_samples(spark, d), KW)
    return s.select(*KW, r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@query(f"""WITH {W()}, sc AS (SELECT series_id, w, quantile_cont(value, 0.5) AS c, {SCALE} AS scale FROM win GROUP BY ALL) SELECT series_id, w, i, round((value - c) / scale, 6) AS value, round(value, 6) AS restored FROM win JOIN sc USING (series_id, w)""")
def normalise_restore(spark, d):
    n = filters.normalise(window_samples(spark, d), KW, ["value"], "value")
    back = filters.restore(n.withColumn("restored", F.col("value")), ["restored"])
    return back.select(*KW, "i", r6(F.col("value"), "value"), r6(F.col("restored"), "restored"))


@query(f"WITH {W()}, f AS ({med3('win', 'series_id, w', 'value', 'i')}) SELECT series_id, w, i, filtered FROM f")
def median_filter_w3(spark, d):
    return filters.median3(window_samples(spark, d), KW, order="i").select(*KW, "i", "filtered")


def ma_sql(width: int, index: str) -> str:
    half = width // 2
    return f"""WITH {W()}, x AS (SELECT series_id, w, i, unnest(generate_series(-{half}, {half})) AS k FROM win), y AS (SELECT series_id, w, i, CASE WHEN {index} THEN 1 END AS dummy, i + k AS j FROM x)
    SELECT y.series_id, y.w, y.i, round(avg(win.value), 6) AS filtered FROM y JOIN win ON win.series_id = y.series_id AND win.w = y.w AND win.i = """


@query(ma_sql(9, "true") + "(CASE WHEN j < 0 THEN -j WHEN j > 31 THEN 62 - j ELSE j END) GROUP BY ALL")
def moving_average_reflect(spark, d):
    return filters.moving_average(window_samples(spark, d), KW, 9, "reflect_odd", order="i").select(*KW, "i", r6(F.col("filtered"), "filtered"))


@query(ma_sql(7, "true") + "greatest(0, least(31, j)) GROUP BY ALL")
def moving_average_edge(spark, d):
    return filters.moving_average(window_samples(spark, d), KW, 8, "edge", order="i").select(*KW, "i", r6(F.col("filtered"), "filtered"))


@query(ma_sql(5, "true") + "(CASE WHEN j < 0 THEN -j WHEN j > 31 THEN 62 - j ELSE j END) GROUP BY ALL")
def moving_average_reflect_even(spark, d):
    return filters.moving_average(window_samples(spark, d), KW, 6, "reflect", order="i").select(*KW, "i", r6(F.col("filtered"), "filtered"))


@query(f"""WITH {W()}, f AS ({med3('win', 'series_id, w', 'value', 'i')}) SELECT series_id, w, i, CASE WHEN i >= 8 AND i < 20 THEN 0.25 * value + 0.75 * filtered ELSE filtered END AS current FROM f""")
def interval_blend(spark, d):
    f = filters.median3(window_samples(spark, d), KW, order="i").withColumn("current", F.col("filtered"))
    return filters.interval_action(f, F.lit(8), F.lit(20), F.lit("blend"), F.lit(0.25), "current", "value", "filtered", "i").select(*KW, "i", "current")


@query(f"""WITH {W()}, p AS (SELECT series_id, w, i, value * (1 + k * 0.01 * (i % 5)) AS v FROM win CROSS JOIN (VALUES (0), (1), (2)) q(k)), m AS (SELECT series_id, w, i, median(v) AS m FROM p GROUP BY ALL)
    SELECT series_id, w, i, round(first(m), 6) AS value, round(median(abs(v - m)), 6) AS mad FROM p JOIN m USING (series_id, w, i) GROUP BY ALL""")
def pass_median(spark, d):
    w = window_samples(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    w = w.withColumn("value", F.col("value") * (1 + F.col("k") * 0.01 * (F.col("i") % 5)))
    return filters.pass_median(w, KW, order="i").select(*KW, "i", r6(F.col("value"), "value"), r6(F.col("mad"), "mad"))


# Corruption ------------------------------------------------------------------------------------------------------------


@query(f"WITH {W()}, {NOISY} SELECT series_id, w, i, round(obs, 6) AS observation FROM noisy")
def gaussian_by_hash(spark, d):
    return noisy_windows(spark, d).select(*KW, "i", r6(F.col("observation"), "observation"))


@query(f"""WITH {W()}, sc AS (SELECT series_id, w, {SCALE} AS scale FROM win GROUP BY ALL), h AS (SELECT *, sha256('p|' || CAST(event_id AS VARCHAR)) AS h FROM win JOIN sc USING (series_id, w)),
    u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS UBIGINT) / 4294967296.0 AS u1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) / 4294967296.0 AS u2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) / 4294967296.0 AS u3 FROM h)
    SELECT series_id, w, i, round(value + CASE WHEN u1 < 0.08 THEN CASE WHEN u2 < 0.5 THEN -1 ELSE 1 END * 3 * scale * (0.65 + 0.35 * u3) ELSE 0 END, 6) AS observation FROM u""")
def impulses_by_hash(spark, d):
    w = window_samples(spark, d)
    w = filters.with_scale(w, KW)
    return corrupt.hashed_impulses(w, KW, F.concat_ws("|", F.lit("p"), F.col("event_id").cast("string")), 1.0).select(*KW, "i", r6(F.col("observation"), "observation"))


@query(f"""WITH {W()}, sc AS (SELECT series_id, w, {SCALE} AS scale FROM win GROUP BY ALL),
    a AS (SELECT win.*, scale, sum({noise("'d|' || CAST(event_id AS VARCHAR)")}) OVER (PARTITION BY series_id, w ORDER BY i ROWS UNBOUNDED PRECEDING) AS walk, i / 31.0 AS tau, sha256('drift|' || CAST(series_id AS VARCHAR) || '|' || CAST(w AS VARCHAR)) AS h FROM win JOIN sc USING (series_id, w)),
    b AS (SELECT *, walk - (first_value(walk) OVER k * (1 - tau) + last_value(walk) OVER k * tau) AS flat FROM a WINDOW k AS (PARTITION BY series_id, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    c AS (SELECT *, flat / greatest(stddev_pop(flat) OVER (PARTITION BY series_id, w), 1e-6) AS rough, 0.35 + 0.9 * CAST('0x' || substr(h, 1, 8) AS UBIGINT) / 4294967296.0 AS cyc, pi() * (2 * (CAST('0x' || substr(h, 9, 8) AS UBIGINT) / 4294967296.0) - 1) AS ph FROM b)
    SELECT series_id, w, i, round(value + 0.25 * scale * (0.8 * sin(2 * pi() * cyc * tau + ph) + 0.2 * rough), 6) AS observation FROM c""")
def drift_by_hash(spark, d):
    w = window_samples(spark, d)
    w = filters.with_scale(w, KW)
    return corrupt.hashed_drift(w, KW, F.concat_ws("|", F.lit("d"), F.col("event_id").cast("string")), 0.5, WINDOW).select(*KW, "i", r6(F.col("observation"), "observation"))


@query("""WITH h AS (SELECT c_custkey, sha256('seed|' || CAST(c_custkey AS VARCHAR) || '|gaussian') AS h FROM customer)
    SELECT c_custkey, CAST(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) AS BIGINT) AS seed FROM h""")
def stable_seeds(spark, d):
    return table(spark, d, "customer").select("c_custkey", cols.stable_seed(F.lit("seed"), F.col("c_custkey").cast("string"), F.lit("gaussian")).alias("seed"))


@query(f"""WITH {S}, m AS (SELECT series_id, coalesce(floor(quantile_cont(CASE WHEN label THEN t END, 0.5)), count(*) // 2) AS mid, count(*) AS n FROM s GROUP BY series_id),
    p AS (SELECT series_id, CAST(greatest(0, least(mid - 16, n - 32)) AS BIGINT) AS ws FROM m WHERE n >= 32), x AS (SELECT s.* FROM s JOIN p USING (series_id) WHERE t >= ws AND t < ws + 32), sc AS (SELECT series_id, {SCALE} AS scale FROM x GROUP BY ALL)
    SELECT series_id, t, round(value + 0.125 * scale * {noise("'c|' || CAST(event_id AS VARCHAR)")}, 6) AS observation FROM x JOIN sc USING (series_id)""")
def prepared_cases(spark, d):
    c = corrupt.prepare_case(samples(spark, d), K, WINDOW, F.col("label"), F.concat_ws("|", F.lit("c"), F.col("event_id").cast("string")), 0.5)
    return c.select("series_id", "t", r6(F.col("observation"), "observation"))


@query(f"""WITH {W()}, d AS (SELECT DISTINCT series_id, w FROM win) SELECT series_id, w, family, CAST(severity AS DOUBLE) AS severity, 0 AS replicate FROM d CROSS JOIN (VALUES ('gaussian'), ('impulse'), ('drift'), ('mixed')) f(family) CROSS JOIN (VALUES (0.25), (0.5), (0.75)) v(severity)""")
def condition_grid(spark, d):
    return sets.condition_grid(window_samples(spark, d).select(*KW).distinct(), list(benchmark.FAMILIES), list(benchmark.SEVERITIES))


def packed_windows(spark, d) -> DataFrame:
    p = wn.spread(wn.pack(window_samples(spark, d), KW, ["value", "label"]), KW)
    return p.withColumnsRenamed({"value": "values", "label": "labels"}).withColumn("window_id", F.concat_ws(":", "series_id", "w")).withColumn("source_group_id", F.col("series_id").cast("string"))


@query()
def corruption_pcg64(spark, d):
    """Exact seeded corruption of every window by every family and severity."""
    c = benchmark.conditions(packed_windows(spark, d), "demo")
    return c.select("condition_id", "seed", F.round(F.aggregate("observation", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# Metrics ---------------------------------------------------------------------------------------------------------------

FILT = f"WITH {W()}, f AS ({med3('win', 'series_id, w', 'value', 'i')})"


def filtered_windows(spark, d) -> DataFrame:
    return filters.median3(window_samples(spark, d), KW, order="i")


@query(FILT + """, g AS (SELECT *, value * 1.1 AS noisy, value - lag(value) OVER k AS dv, filtered - lag(filtered) OVER k AS df FROM f WINDOW k AS (PARTITION BY series_id, w ORDER BY i)),
    a AS (SELECT series_id, w, sqrt(avg(pow(value - filtered, 2))) AS rmse, avg(abs(value - filtered)) AS mae, sqrt(avg(pow(dv - df, 2))) AS drmse, avg(value * value) AS p, avg(pow(value - filtered, 2)) AS e, avg(pow(value - noisy, 2)) AS en FROM g GROUP BY ALL)
    SELECT series_id, w, round(rmse, 8) AS rmse, round(mae, 8) AS mae, round(drmse, 8) AS derivative_rmse, round(CASE WHEN e = 0 THEN 'inf'::DOUBLE WHEN p = 0 THEN '-inf'::DOUBLE ELSE 10 * log10(p / e) END, 8) AS snr_db, round(10 * log10(p / en), 8) AS input_snr_db FROM a""")
def signal_metrics(spark, d):
    f = filtered_windows(spark, d).withColumn("noisy", F.col("value") * 1.1)
    m = metrics.signal_metrics(f, KW, "value", "noisy", "filtered", "i")
    return m.select(*KW, *(F.round(c, 8).alias(c) for c in ("rmse", "mae", "derivative_rmse", "snr_db", "input_snr_db")))


LONG = f"""WITH {S}, f AS ({med3('s', 'series_id', 'value', 't')}), {isl("e", "s", "series_id", "label")}, {isl("q", "f", "series_id", "filtered >= 60")}, k AS (SELECT DISTINCT series_id FROM s)"""


def filtered_series(spark, d) -> DataFrame:
    return filters.median3(samples(spark, d), K)


@query(LONG + """, h AS (SELECT e.series_id, a, bool_or(filtered >= 60) AS hit FROM e JOIN f ON f.series_id = e.series_id AND t >= a AND t < b GROUP BY ALL)
    SELECT k.series_id, round(coalesce(avg(CAST(hit AS INTEGER)), 0), 6) AS event_recall FROM k LEFT JOIN h USING (series_id) GROUP BY ALL""")
def event_recall(spark, d):
    r = metrics.event_recall(filtered_series(spark, d), K, F.col("label"), F.col("filtered") >= 60)
    return r.select("series_id", r6(F.col("event_recall"), "event_recall"))


@query(LONG + """, h AS (SELECT e.series_id, a, bool_or(value >= 60) AS x, bool_or(filtered >= 60) AS y FROM e JOIN f ON f.series_id = e.series_id AND t >= a AND t < b GROUP BY ALL)
    SELECT k.series_id, round(coalesce(count(*) FILTER (WHERE x AND NOT y) / nullif(count(*) FILTER (WHERE x), 0), 0), 6) AS erasure FROM k LEFT JOIN h USING (series_id) GROUP BY ALL""")
def anomaly_erasure(spark, d):
    r = metrics.erasure_rate(filtered_series(spark, d), K, F.col("label"), F.col("value") >= 60, F.col("filtered") >= 60)
    return r.select("series_id", r6(F.col("erasure"), "erasure"))


@query(LONG + """, h AS (SELECT q.series_id, a, bool_or(label OR value >= 120) AS known FROM q JOIN f ON f.series_id = q.series_id AND t >= a AND t < b GROUP BY ALL)
    SELECT k.series_id, round(coalesce(count(*) FILTER (WHERE NOT known) / nullif(count(known), 0), 0), 6) AS false_event_rate FROM k LEFT JOIN h USING (series_id) GROUP BY ALL""")
def false_event_generation(spark, d):
    r = metrics.false_event_rate(filtered_series(spark, d), K, F.col("label"), F.col("value") >= 120, F.col("filtered") >= 60)
    return r.select("series_id", r6(F.col("false_event_rate"), "false_event_rate"))


AP = """SELECT {k}, round(CASE WHEN sum(p) > 0 THEN least(1, greatest(0, sum(p * tp / c) / sum(p))) ELSE 0 END, 6) AS ap FROM (
    SELECT {k}, p, sum(p) OVER o AS tp, sum(n) OVER o AS c FROM (SELECT {k}, {score} AS score, sum({truth}) AS p, count(*) AS n FROM {src} GROUP BY ALL) WINDOW o AS (PARTITION BY {k} ORDER BY score DESC)) GROUP BY {k}"""


@query(f"WITH {S} " + AP.format(k="series_id", score="floor(value)", truth="CAST(label AS INTEGER)", src="s"))
def average_precision(spark, d):
    s = samples(spark, d).withColumn("score", F.floor("value"))
    r = metrics.average_precision(s, K, "label", "score")
    return r.select("series_id", r6(F.col("ap"), "ap"))


@query("WITH x AS (SELECT quality AS q, toxic, n_chars FROM labels JOIN documents USING (doc_id)) " + AP.format(k="q", score="n_chars", truth="toxic", src="x"))
def label_average_precision(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    r = metrics.average_precision(x.withColumnRenamed("quality", "q"), ["q"], "toxic", "n_chars")
    return r.select("q", r6(F.col("ap"), "ap"))


def _vus_sql(tolerances: list[int]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT s.series_id, {tol} AS tolerance, s.value AS score, greatest(CAST(first(label) AS INTEGER), coalesce(max(CASE WHEN a IS NOT NULL THEN 1 - greatest(a - s.t, s.t - b + 1) / {tol + 1}.0 END), 0)) AS soft FROM s LEFT JOIN e ON s.series_id = e.series_id AND s.t >= a - {tol} AND s.t < b + {tol} AND (s.t < a OR s.t >= b) GROUP BY s.series_id, s.t, s.value"
        for tol in tolerances
    )
    return f"WITH {S}, {isl('e', 's', 'series_id', 'label')}, z AS ({parts}), ap AS (" + AP.format(k="series_id, tolerance", score="score", truth="soft", src="z").replace("round(", "(").replace(", 6) AS ap", ") AS ap") + ") SELECT series_id, round(avg(ap), 6) AS vus FROM ap GROUP BY ALL"


@query(_vus_sql(metrics.tolerance_steps(4, 3)))
def vus_approximation(spark, d):
    a = metrics.vus_approximation(samples(spark, d), K, "label", "value", 4, 3)
    return metrics.mean_over_tolerances(a, K).select("series_id", r6(F.col("vus"), "vus"))


def _official_sql(buffers: int, m: int) -> str:
    return f"""WITH {S}, {isl("e", "s", "series_id", "label")}, z AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE label) AS p FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE label) BETWEEN 1 AND count(*) - 1),
    bb AS (SELECT unnest(generate_series(0, {buffers})) AS bf),
    ext AS (SELECT s.series_id, bf, s.t, first(value) AS v, first(label) AS label, least(1.0, CAST(first(label) AS INTEGER) + coalesce(sum(CASE WHEN a IS NOT NULL THEN sqrt(1 - greatest(a - s.t, s.t - b + 1) / bf) END), 0)) AS ext FROM s CROSS JOIN bb
        LEFT JOIN e ON s.series_id = e.series_id AND bf // 2 > 0 AND s.t >= a - bf // 2 AND s.t < b + bf // 2 AND (s.t < a OR s.t >= b) GROUP BY s.series_id, bf, s.t),
    x AS (SELECT series_id, bf, a - bf // 2 AS a, b + bf // 2 AS b FROM e CROSS JOIN bb),
    m0 AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY series_id, bf ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 THEN 1 ELSE 0 END AS nw FROM x),
    m1 AS (SELECT *, sum(nw) OVER (PARTITION BY series_id, bf ORDER BY a) AS g FROM m0), mg AS (SELECT series_id, bf, g, greatest(min(a), 0) AS a, max(b) AS b FROM m1 GROUP BY series_id, bf, g),
    rk AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, t) - 1 AS r FROM s),
    th AS (SELECT z.series_id, p, k, rk.value AS thr FROM z CROSS JOIN (SELECT unnest(generate_series(0, {m - 1})) AS k) q JOIN rk ON rk.series_id = z.series_id AND rk.r = CAST(floor(k * ((n - 1) / {m - 1})) AS BIGINT)),
    c AS (SELECT th.series_id, bf, k, first(p) AS p, sum(ext) AS tp, first(p) + sum(CASE WHEN label THEN 0 ELSE ext END) AS nn, count(*) AS pred FROM th JOIN ext ON ext.series_id = th.series_id AND v >= thr GROUP BY th.series_id, bf, k),
    hit AS (SELECT th.series_id, bf, k, count(DISTINCT g) AS hits FROM th JOIN mg ON mg.series_id = th.series_id JOIN s ON s.series_id = th.series_id AND s.t >= mg.a AND s.t < mg.b AND s.value >= thr GROUP BY ALL),
    ne AS (SELECT series_id, bf, count(*) AS ne FROM mg GROUP BY ALL),
    cur AS (SELECT c.series_id, bf, k, least(1.0, tp / ((p + nn) / 2.0)) * coalesce(hits, 0) / ne AS tpr, tp / pred AS prec FROM c JOIN ne USING (series_id, bf) LEFT JOIN hit USING (series_id, bf, k)),
    ar AS (SELECT series_id, bf, (tpr - coalesce(lag(tpr) OVER (PARTITION BY series_id, bf ORDER BY k), 0)) * prec AS area FROM cur), su AS (SELECT series_id, bf, sum(area) AS area FROM ar GROUP BY ALL)
    SELECT series_id, round(avg(area), 6) AS vus_pr, count(*) AS n_buffers FROM su GROUP BY ALL"""


@query(_official_sql(4, 250))
def vus_pr(spark, d):
    r = metrics.vus_pr(samples(spark, d), K, "label", "value", 4, 250)
    return r.select("series_id", r6(F.col("vus_pr"), "vus_pr"), "n_buffers")


@query(LONG + """, h AS (SELECT e.series_id, a, bool_or(value >= 80) AS r, bool_or(value >= 100) AS o, bool_or(filtered >= 60) AS c FROM e JOIN f ON f.series_id = e.series_id AND t >= a AND t < b GROUP BY ALL),
    m AS (SELECT q.series_id, a, bool_or(label OR value >= 100) AS known FROM q JOIN f ON f.series_id = q.series_id AND t >= a AND t < b GROUP BY ALL),
    x AS (SELECT series_id, count(*) AS le, count(*) FILTER (WHERE r AND c) AS ret, count(*) FILTER (WHERE r) AS rd, count(*) FILTER (WHERE o AND NOT c) AS er, count(*) FILTER (WHERE o) AS od, count(*) FILTER (WHERE r AND NOT o AND c) AS rec, count(*) FILTER (WHERE r AND NOT o) AS re FROM h GROUP BY ALL),
    y AS (SELECT series_id, count(*) FILTER (WHERE NOT known) AS fg, count(*) AS pr FROM m GROUP BY ALL)
    SELECT k.series_id, coalesce(le, 0) AS labelled_events, round(ret / nullif(rd, 0), 6) AS retention, round(er / nullif(od, 0), 6) AS erasure, round(rec / nullif(re, 0), 6) AS recovery, round(fg / nullif(pr, 0), 6) AS false_generation FROM k LEFT JOIN x USING (series_id) LEFT JOIN y USING (series_id)""")
def event_decisions(spark, d):
    r = metrics.event_decisions(filtered_series(spark, d), K, F.col("label"), F.col("value") >= 80, F.col("value") >= 100, F.col("filtered") >= 60)
    return r.select("series_id", "labelled_events", *(r6(F.col(c), c) for c in ("retention", "erasure", "recovery", "false_generation")))


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")} SELECT series_id, CAST(floor(median(b - a)) AS INTEGER) AS median_length FROM e GROUP BY ALL""")
def median_event_length(spark, d):
    return metrics.median_event_length(samples(spark, d), K, F.col("label"))


@query(FILT + f""", sc AS (SELECT series_id, w, {SCALE} AS scale FROM win GROUP BY ALL) SELECT series_id, w, round(sqrt(avg(pow(filtered - value, 2))) / first(scale), 8) AS os_nrmse, round(sqrt(avg(pow(filtered - value, 2)) FILTER (WHERE label)) / first(scale), 8) AS anomaly_os_nrmse,
    round(sqrt(avg(pow(filtered - value, 2))), 8) AS native_rmse, round(avg(abs(filtered - value)), 8) AS mean_abs_correction, bool_and(isfinite(filtered)) AS finite FROM f JOIN sc USING (series_id, w) GROUP BY ALL""")
def waveform_metrics(spark, d):
    f = filtered_windows(spark, d)
    f = filters.with_scale(f, KW)
    m = metrics.waveform_metrics(f, KW, "value", "value", "filtered", F.col("label"))
    return m.select(*KW, *(F.round(c, 8).alias(c) for c in ("os_nrmse", "anomaly_os_nrmse", "native_rmse", "mean_abs_correction")), "finite")


@query("""WITH a AS (SELECT l_returnflag, r_name, n_name, s_suppkey, avg(l_extendedprice) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
    b AS (SELECT l_returnflag, r_name, n_name, avg(m) AS m FROM a GROUP BY ALL), c AS (SELECT l_returnflag, r_name, avg(m) AS m FROM b GROUP BY ALL) SELECT l_returnflag, round(avg(m), 4) AS mean FROM c GROUP BY ALL""")
def hierarchical_mean(spark, d):
    t = lambda n: table(spark, d, n)
    x = t("lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = metrics.hierarchical_mean(x, ["r_name", "n_name", "s_suppkey"], "l_extendedprice", ["l_returnflag"])
    return m.select("l_returnflag", F.round("mean", 4).alias("mean"))


@query("""SELECT l_linestatus AS method, sum(l_linenumber % 2) AS retained, sum(l_linenumber % 3) AS eligible, CASE WHEN l_linestatus <> 'F' AND sum(l_linenumber % 3) > 0 THEN round(100.0 * sum(l_linenumber % 2) / sum(l_linenumber % 3), 6) END AS retained_percent FROM lineitem GROUP BY l_linestatus""")
def pooled_evidence(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("method"), (F.col("l_linenumber") % 2).alias("k"), (F.col("l_linenumber") % 3).alias("e"))
    r = metrics.pooled_evidence(x, "method", "k", "e", "F")
    return r.withColumn("retained_percent", F.round("retained_percent", 6))


@query(FILT + f""", g AS (SELECT *, i BETWEEN 10 AND 20 AS target, value >= 100 AS o, filtered >= 60 AS p, max(CAST(value >= 100 AS INTEGER)) OVER (PARTITION BY series_id, w ORDER BY i RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS wide FROM f), {isl("r", "g", "series_id, w", "p", "i")},
    x AS (SELECT r.series_id, r.w, a, bool_or(wide) AS near FROM r JOIN g ON g.series_id = r.series_id AND g.w = r.w AND i >= a AND i < b GROUP BY ALL), y AS (SELECT series_id, w, count(*) FILTER (WHERE NOT near) AS extra FROM x GROUP BY ALL),
    q AS (SELECT series_id, w, bool_or(target AND o) AS od, bool_or(target AND p) AS pd FROM g GROUP BY ALL)
    SELECT series_id, w, CAST(od AS INTEGER) AS observation_detectable, CAST(pd AS INTEGER) AS output_detectable, CAST(od AND NOT pd AS INTEGER) AS erased, coalesce(extra, 0) AS output_only FROM q LEFT JOIN y USING (series_id, w)""")
def detector_counts(spark, d):
    f = filtered_windows(spark, d)
    return metrics.detector_counts(f, KW, F.col("i").between(10, 20), F.col("value") >= HIGH, F.col("filtered") >= 60, 2, "i")


@query("""WITH a AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT o_orderpriority, round(avg(m), 4) AS mean FROM a GROUP BY ALL""")
def group_balanced_mean(spark, d):
    return metrics.group_balanced(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", ["o_orderpriority"]).select("o_orderpriority", F.round("mean", 4).alias("mean"))


@query(f"""WITH {S}, a AS ({AP.format(k="series_id", score="value", truth="CAST(label AS INTEGER)", src="s")}) SELECT series_id, ap AS ap_before, ap AS ap_after, CAST(NULL AS DOUBLE) AS erasure FROM a""")
def score_bundle(spark, d):
    s = samples(spark, d).withColumn("twice", F.col("value") * 2)
    b = metrics.score_bundle(s, K, "label", "value", "twice", None)
    return b.select("series_id", r6(F.col("ap_before"), "ap_before"), r6(F.col("ap_after"), "ap_after"), "erasure")


@query(LONG + """, g AS (SELECT *, value * 1.1 AS noisy FROM f), a AS (SELECT series_id, sqrt(avg(pow(value - filtered, 2))) AS rmse FROM g GROUP BY ALL),
    h AS (SELECT e.series_id, a, bool_or(value >= 100) AS x, bool_or(filtered >= 100) AS y FROM e JOIN f ON f.series_id = e.series_id AND t >= a AND t < b GROUP BY ALL)
    SELECT k.series_id, round(first(rmse), 8) AS rmse, round(coalesce(count(*) FILTER (WHERE x AND NOT y) / nullif(count(*) FILTER (WHERE x), 0), 0), 6) AS erasure FROM k JOIN a USING (series_id) LEFT JOIN h USING (series_id) GROUP BY k.series_id""")
def demo_bundle(spark, d):
    f = filtered_series(spark, d).withColumn("noisy", F.col("value") * 1.1)
    b = metrics.demo_bundle(f, K, "label", "value", "noisy", "filtered", "value", "filtered", HIGH)
    return b.select("series_id", F.round("rmse", 8).alias("rmse"), r6(F.col("erasure"), "erasure"))


@query("""SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, sum(n_chars) AS chars FROM documents GROUP BY ROLLUP (lang)""")
def manifest_summary(spark, d):
    x = table(spark, d, "documents")
    return metrics.rollup_counts(x, "lang", {"documents": F.count("*"), "sources": F.count_distinct("source"), "chars": F.sum("n_chars")})


@query(FILT + """, g AS (SELECT *, (i % 4) / 4.0 AS beta, filtered + (i % 4) / 4.0 * (value - filtered) AS output FROM f)
    SELECT series_id, w, round(avg(CAST(beta > 0 AS INTEGER)), 6) AS retained_sample_fraction, round(CASE WHEN sum(pow(value - filtered, 2)) <= 2.220446049250313e-16 THEN 0 ELSE least(1, sum(pow(output - filtered, 2)) / sum(pow(value - filtered, 2))) END, 6) AS retained_energy_fraction, round(avg(beta), 6) AS mean_weight, CAST(max(beta) AS DOUBLE) AS max_weight FROM g GROUP BY ALL""")
def intervention_cost(spark, d):
    f = filtered_windows(spark, d).withColumn("beta", (F.col("i") % 4) / 4.0)
    f = filters.blend(f, "value", "filtered", F.col("beta"))
    c = metrics.intervention_cost(f, KW, "value", "filtered", "output", "beta")
    return c.select(*KW, *(r6(F.col(x), x) for x in ("retained_sample_fraction", "retained_energy_fraction", "mean_weight", "max_weight")))


@query(f"""WITH {S}, x AS (SELECT *, least(1.0, floor(value / 50) / 4) AS wt FROM s) SELECT series_id, round(avg(CAST(wt = 1 AS INTEGER)), 6) AS repair_fraction, round(avg(CAST(wt > 0 AND wt < 1 AS INTEGER)), 6) AS halo_fraction, round(avg(CAST(wt = 0 AS INTEGER)), 6) AS classical_fraction, round(avg(wt), 6) AS mean_weight FROM x GROUP BY ALL""")
def routing_fractions(spark, d):
    s = samples(spark, d).withColumn("weight", F.least(F.lit(1.0), F.floor(F.col("value") / 50) / 4))
    r = metrics.routing_fractions(s, K)
    return r.select("series_id", *(r6(F.col(c), c) for c in ("repair_fraction", "halo_fraction", "classical_fraction", "mean_weight")))


@query(f"""WITH {S}, r AS (SELECT *, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM s WHERE value >= 60),
    a AS (SELECT series_id, min(t) AS a, max(t) + 1 AS b, max(value) AS peak, avg(value) AS mean, avg(value / 100) AS m1, avg(CAST(label AS INTEGER) * 1.5) AS m2, avg(t % 3) AS m3 FROM r GROUP BY series_id, g)
    SELECT series_id, a AS "start", b AS "end", peak, round(mean, 6) AS mean, CASE WHEN m1 >= m2 AND m1 >= m3 THEN 'one' WHEN m2 >= m3 THEN 'two' ELSE 'three' END AS dominant_cue FROM a""")
def interval_summary(spark, d):
    s = samples(spark, d).withColumns({"c1": F.col("value") / 100, "c2": F.col("label").cast("int") * 1.5, "c3": (F.col("t") % 3).cast("double")})
    return metrics.interval_summary(s, K, F.col("value") >= 60, "value", {"one": "c1", "two": "c2", "three": "c3"}).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {S}, e AS (SELECT series_id, min(value) AS lo, max(value) AS hi, avg(value) FILTER (WHERE t BETWEEN 5 AND 20) AS m FROM s GROUP BY ALL)
    SELECT series_id, round(lo - 0.08 * CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS low, round(hi + 0.08 * CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS high, round(m, 6) AS mean FROM e""")
def display_extent(spark, d):
    s = samples(spark, d)
    x = metrics.extent(s, K).join(metrics.selection_mean(s, K, 5, 20), K)
    return x.select("series_id", r6(F.col("low"), "low"), r6(F.col("high"), "high"), r6(F.col("mean"), "mean"))


@query(f"WITH {S} SELECT series_id, t // 8 AS bucket, max(value) AS peak FROM s GROUP BY ALL")
def bucket_max(spark, d):
    return metrics.bucket_max(samples(spark, d), K, 8)


@query(f"WITH {S} SELECT series_id, t, value FROM s WHERE t % 5 = 0")
def stride_decimation(spark, d):
    return metrics.stride(samples(spark, d), 5).select("series_id", "t", "value")


@query("""SELECT n_regionkey AS region, score, n_name FROM (SELECT n_regionkey, length(n_name) % 4 AS score, n_name FROM nation) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY score, n_name) = 1""")
def grid_argmin(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), (F.length("n_name") % 4).cast("long").alias("score"), "n_name")
    return metrics.grid_argmin(n, "score", ["n_name"], ["region"])


# Sets, splits, statistics ----------------------------------------------------------------------------------------------


@query("""SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ';') AS splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")
def split_overlaps(spark, d):
    return sets.split_overlaps(table(spark, d, "documents"), "source", "lang").withColumn("splits", F.array_join("splits", ";"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 200000)""")
def except_keys(spark, d):
    return sets.except_keys(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice < 200000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_texts(spark, d):
    return sets.duplicates(table(spark, d, "documents"), ["text"])


@query("""WITH h AS (SELECT DISTINCT c_nationkey, c_custkey, sha256('9:' || CAST(c_custkey AS VARCHAR)) AS digest FROM customer) SELECT c_nationkey, c_custkey, digest, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY digest, c_custkey) AS INTEGER) AS place FROM h QUALIFY place <= 3""")
def calibration_top_k(spark, d):
    return sets.top_by_hash(table(spark, d, "customer"), "c_custkey", 3, 9, ["c_nationkey"])


def official_sources(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("file_name"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2).alias("source_group_id"))
    k = F.col("file_name")
    return validate.official_split(x, x.where(k % 41 == 0).select("file_name"), x.where(k % 59 == 1).select("file_name"))


@query("""WITH x AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS g, CASE WHEN doc_id % 41 = 0 THEN 'e' WHEN doc_id % 59 = 1 THEN 't' ELSE 'u' END AS s FROM documents),
    f AS (SELECT g, bool_or(s = 'e') AS e, bool_or(s = 't') AS t, sha256('41:' || g) AS h FROM x GROUP BY g), c AS (SELECT greatest(0, greatest(1, CAST(ceil(0.2 * count(*) FILTER (WHERE NOT e)) AS BIGINT)) - count(*) FILTER (WHERE NOT e AND t)) AS extra FROM f),
    r AS (SELECT g, row_number() OVER (ORDER BY h) AS k FROM f WHERE NOT e AND NOT t)
    SELECT f.g AS source_group_id, CASE WHEN e THEN 'test' WHEN t OR k <= extra THEN 'validation' ELSE 'train' END AS split FROM f CROSS JOIN c LEFT JOIN r ON f.g = r.g""")
def group_splits(spark, d):
    return sets.assign_splits(official_sources(spark, d), 0.2, 41).drop("reason")


@query("""SELECT doc_id AS file_name, CASE WHEN doc_id % 41 = 0 THEN 'evaluation' WHEN doc_id % 59 = 1 THEN 'tuning' ELSE 'unlisted' END AS official_split FROM documents""")
def official_splits(spark, d):
    return official_sources(spark, d).select("file_name", "official_split")


@query("""WITH g AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS g, bool_or(doc_id % 41 <> 0) AS a, bool_or(doc_id % 97 = 5) AS b, bool_or(n_chars < 300) AS c, bool_or(lang IN (SELECT lang FROM documents GROUP BY lang ORDER BY count(*), lang LIMIT 1)) AS d FROM documents GROUP BY 1)
    SELECT g AS source_group_id, nullif(concat_ws(';', CASE WHEN a THEN 'group_not_exclusively_official_evaluation' END, CASE WHEN b THEN 'declared_normal_prefix_contains_positive_labels' END, CASE WHEN c THEN 'insufficient_samples_for_fixed_window' END, CASE WHEN d THEN 'exact_normal_prefix_seen_in_prior_protocol' END), '') AS reason FROM g""")
def group_quarantine(spark, d):
    x = table(spark, d, "documents")
    k = F.col("doc_id")
    rows = x.select(F.substring(F.sha2(k.cast("string"), 256), 1, 3).alias("source_group_id"), k.cast("string").alias("file_name"), F.when(k % 41 == 0, "evaluation").otherwise("unlisted").alias("official_split"), (k % 97 == 5).cast("int").alias("prefix_positive"), F.col("n_chars").alias("n_samples"), F.lit(300).alias("training_end"), F.col("lang").alias("prefix_digest"))
    prior = x.groupBy("lang").count().orderBy("count", "lang").limit(1).select(F.col("lang").alias("prefix_digest"))
    return validate.quarantine(rows, prior, 300).drop("members")


@query(f"""WITH {S}, {isl("e", "s", "series_id", "label")} SELECT series_id, a AS "start", b AS "end", 'event_longer_than_limit' AS reason FROM e WHERE b - a > 1""")
def long_event_exclusions(spark, d):
    return validate.split_by_length(iv.islands(samples(spark, d), K, F.col("label")), 1)[1]


@query("""SELECT vec_id AS id, 'vector' AS kind FROM embeddings UNION ALL SELECT item_id, 'benchmark' FROM benchmark""")
def union_rows(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("vector").alias("kind"))
    return a.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind")))


@query("""SELECT n_nationkey, round(p, 10) AS p, round(least(1.0, max(f) OVER (ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING)), 10) AS p_adjusted FROM (SELECT n_nationkey, p, (count(*) OVER () - row_number() OVER (ORDER BY p, n_nationkey) + 1) * p AS f FROM (SELECT n_nationkey, CAST('0x' || substr(sha256(n_name), 1, 8) AS UBIGINT) / 4294967296.0 / 8 AS p FROM nation))""")
def holm_adjustment(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (cols.unit_of(F.sha2("n_name", 256), 1) / 8).alias("p"))
    return stats.holm(n, "p", ties=["n_nationkey"]).select("n_nationkey", F.round("p", 10).alias("p"), F.round("p_adjusted", 10).alias("p_adjusted"))


def cluster_pairs(spark, d):
    s = samples(spark, d)
    left = s.where("t % 2 = 0").groupBy("series_id").agg(F.avg("value").alias("value"))
    right = s.where("t % 2 = 1").groupBy("series_id").agg(F.avg("value").alias("value"))
    return left, right


PAIRS = f"WITH {S}, p AS (SELECT series_id, avg(value) FILTER (WHERE t % 2 = 1) - avg(value) FILTER (WHERE t % 2 = 0) AS d FROM s GROUP BY series_id)"
POISSON = "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(11)]).tolist())) + " ELSE 11 END"


@query(PAIRS + f""", q AS (SELECT r, d, CAST('0x' || substr(sha256('2026|' || CAST(r AS VARCHAR) || '|' || CAST(series_id AS VARCHAR)), 1, 8) AS UBIGINT) / 4294967296.0 AS u FROM p CROSS JOIN (SELECT unnest(generate_series(1, 10000)) AS r)),
    m AS (SELECT r, sum({POISSON} * d) / sum({POISSON}) AS m FROM q GROUP BY r), i AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m)
    SELECT round(avg(d), 6) AS estimate, round(first(lo), 6) AS "lower", round(first(hi), 6) AS "upper", count(*) AS clusters FROM p CROSS JOIN i""")
def cluster_bootstrap(spark, d):
    p = stats.contributions(*cluster_pairs(spark, d), K)
    b = stats.bootstrap_hashed(p, K, replicates=10_000)
    return b.select(r6(F.col("estimate"), "estimate"), r6(F.col("lower"), "lower"), r6(F.col("upper"), "upper"), "clusters")


@query(PAIRS + """, q AS (SELECT r, d, CAST('0x' || substr(sha256('2026|' || CAST(r AS VARCHAR) || '|' || CAST(series_id AS VARCHAR)), 1, 8) AS UBIGINT) / 4294967296.0 AS u FROM p CROSS JOIN (SELECT unnest(generate_series(1, 100000)) AS r)),
    m AS (SELECT r, avg(CASE WHEN u < 0.5 THEN -d ELSE d END) AS m FROM q GROUP BY r) SELECT round((count(*) FILTER (WHERE abs(m) >= (SELECT abs(avg(d)) FROM p)) + 1) / 100001.0, 8) AS p_value FROM m""")
def sign_permutation(spark, d):
    p = stats.contributions(*cluster_pairs(spark, d), K)
    return stats.sign_permutation_hashed(p, K, replicates=100_000).select(F.round("p_value", 8).alias("p_value"))


@query()
def cluster_bootstrap_pcg64(spark, d):
    """The exact form: PCG64 draws over clusters in key order."""
    return stats.bootstrap_exact(stats.contributions(*cluster_pairs(spark, d), K), K, replicates=10_000)


@query()
def sign_permutation_pcg64(spark, d):
    return stats.sign_permutation_exact(stats.contributions(*cluster_pairs(spark, d), K), K, replicates=100_000)


@query(PAIRS + """ SELECT false AS preservation_pass, true AS restoration_pass, round(avg(d), 6) AS erasure_estimate, false AS supported FROM p""")
def claim_gate(spark, d):
    p = stats.contributions(*cluster_pairs(spark, d), K)
    e = p.agg(F.avg("d").alias("estimate"), F.lit(1.0).alias("upper"))
    r = p.agg(F.avg("d").alias("estimate"), F.lit(0.05).alias("upper"))
    return stats.claim_gate(e, r).select("preservation_pass", "restoration_pass", r6(F.col("erasure_estimate"), "erasure_estimate"), "supported")


@query("""SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 32)""")
def newest_sessions(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    return sets.newest(c, F.struct(F.col("c_acctbal"), -F.col("c_custkey")), 32)


@query(f"""WITH {S}, k AS (SELECT series_id FROM s GROUP BY series_id HAVING count(*) >= 70 ORDER BY series_id LIMIT 20) SELECT series_id, t, value FROM s SEMI JOIN k USING (series_id)""")
def bounded_cases(spark, d):
    return sets.bounded_cases(samples(spark, d), "series_id", 70, 20).select("series_id", "t", "value")


# Scores, cues, verification, control -----------------------------------------------------------------------------------


@query(f"""WITH {S} SELECT series_id, t, round(CASE WHEN t < 8 THEN 0 ELSE pow(value - avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 2) END, 4) AS score FROM s""")
def causal_forecast_scores(spark, d):
    return scorers.forecast_scores(samples(spark, d), K, 8).select("series_id", "t", F.round("score", 4).alias("score"))


@query()
def spectral_residual_scores(spark, d):
    p = scorers.score_packed(packed_windows(spark, d), "spectral_residual")
    return p.select(*KW, r6(F.array_max("scores"), "peak"), F.size("scores").alias("n"))


@query()
def linear_forecaster_scores(spark, d):
    """A forecaster fitted on a bounded sample, then run on every window."""
    p = packed_windows(spark, d)
    w, b = scorers.fit_forecaster(p, 4)
    return scorers.score_packed(p, scorers.linear(w, b)).select(*KW, r6(F.array_max("scores"), "peak"))


@query()
def wavelet_shrinkage(spark, d):
    p = scorers.filter_packed(packed_windows(spark, d), kernels.wavelet_shrink)
    return p.select(*KW, F.round(F.aggregate("output", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query()
def spectral_gating(spark, d):
    p = scorers.filter_packed(packed_windows(spark, d), kernels.spectral_gate)
    return p.select(*KW, F.round(F.aggregate("output", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def cue_samples(spark, d):
    f = filters.moving_average(filters.median3(window_samples(spark, d), KW, order="i"), KW, 5, "edge", "filtered", "candidate", "i")
    both = f.withColumn("i", F.col("i").cast("long")).withColumn("observation", F.col("value"))
    return both.withColumns({"score_before": F.col("observation") / 100, "score_after": F.col("candidate") / 100, "mad": F.abs(F.col("filtered") - F.col("candidate")) / 100})


def edge_mean(name: str, src: str, v: str, half: int) -> str:
    return f"""{name} AS (SELECT a.series_id, a.w, a.i, avg(b.{v}) AS m FROM {src} a CROSS JOIN (SELECT unnest(generate_series(-{half}, {half})) AS k) q
        JOIN {src} b ON b.series_id = a.series_id AND b.w = a.w AND b.i = greatest(0, least(31, a.i + k)) GROUP BY ALL)"""


POLARITY = "CASE WHEN {v} - lag({v}) OVER k > 0.01 * scale AND lead({v}) OVER k - {v} <= -0.01 * scale THEN 1 WHEN {v} - lag({v}) OVER k < -0.01 * scale AND lead({v}) OVER k - {v} >= 0.01 * scale THEN -1 END"
KEYED = "{a}.series_id = {b}.series_id AND {a}.w = {b}.w"
CONCERN = FILT + f""", {edge_mean("c0", "f", "filtered", 2)}, sc AS (SELECT series_id, w, {SCALE} AS scale FROM win GROUP BY ALL), c1 AS (SELECT f.series_id, f.w, f.i, value AS o, m AS c, abs(filtered - m) / 100 AS mad, scale FROM f JOIN c0 USING (series_id, w, i) JOIN sc USING (series_id, w)),
    {edge_mean("so", "c1", "o", 2)}, {edge_mean("sn", "c1", "c", 2)}, c2 AS (SELECT c1.*, so.m AS so, sn.m AS sn FROM c1 JOIN so USING (series_id, w, i) JOIN sn USING (series_id, w, i)),
    c3 AS (SELECT *, {POLARITY.format(v="so")} AS po, {POLARITY.format(v="sn")} AS pn FROM c2 WINDOW k AS (PARTITION BY series_id, w ORDER BY i)),
    mt AS (SELECT x.series_id, x.w, x.i, y.i AS j, abs(x.i - y.i) AS dist, x.o, y.c, x.scale FROM c3 x LEFT JOIN c3 y ON {KEYED.format(a="x", b="y")} AND y.pn = x.po AND abs(x.i - y.i) <= 8 WHERE x.po IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x.series_id, x.w, x.i ORDER BY abs(x.i - y.i) NULLS LAST, y.i) = 1),
    pk AS (SELECT series_id, w, i AS p, CASE WHEN j IS NULL THEN 1.0 ELSE 0.55 * least(abs(c - o) / scale, 1.0) + 0.45 * dist / 8 END AS h FROM mt
        UNION ALL SELECT series_id, w, i, 0.8 FROM c3 n WHERE pn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mt WHERE {KEYED.format(a="mt", b="n")} AND mt.j = n.i) AND NOT EXISTS (SELECT 1 FROM c3 x WHERE {KEYED.format(a="x", b="n")} AND x.po IS NOT NULL AND abs(x.i - n.i) <= 8)),
    sp AS (SELECT c3.series_id, c3.w, c3.i, max(h * (1 - abs(c3.i - p) / 9.0)) AS s FROM c3 LEFT JOIN pk ON {KEYED.format(a="pk", b="c3")} AND abs(c3.i - p) <= 8 GROUP BY ALL),
    c4 AS (SELECT c3.*, least(1, greatest(0.2 * least(1, abs(c - o) / scale), coalesce(s, 0))) AS morphology, least(1, abs(c - o) / 100 / 0.3) AS ch, least(1, mad / 0.12) AS uncertainty FROM c3 JOIN sp USING (series_id, w, i)),
    c5 AS (SELECT *, 0.5 * ch + 0.3 * morphology + 0.2 * uncertainty AS mix FROM c4), {edge_mean("c6", "c5", "mix", 3)}, cc AS (SELECT c5.*, least(1, greatest(0, m)) AS concern, CASE WHEN m >= 0.62 THEN 'high' WHEN m >= 0.32 THEN 'medium' ELSE 'low' END AS level FROM c5 JOIN c6 USING (series_id, w, i))"""


@query(CONCERN + " SELECT series_id, w, i, round(morphology, 6) AS morphology, round(uncertainty, 6) AS uncertainty, round(concern, 6) AS concern, level FROM cc")
def concern_cues(spark, d):
    c = cues.concern(cue_samples(spark, d), KW, order="i")
    return c.select(*KW, "i", *(r6(F.col(x), x) for x in ("morphology", "uncertainty", "concern")), "level")


@query(CONCERN + """, r AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, w ORDER BY i) AS g FROM cc WHERE level <> 'low'),
    a AS (SELECT series_id, w, min(i) AS a, max(i) + 1 AS b, max(concern) AS peak, avg(concern) AS mean, avg(ch) AS m1, avg(morphology) AS m2, avg(uncertainty) AS m3, bool_or(level = 'high') AS hi FROM r GROUP BY series_id, w, g)
    SELECT series_id, w, a AS "start", b AS "end", round(peak, 4) AS peak, round(mean, 4) AS mean, CASE WHEN m1 >= m2 AND m1 >= m3 THEN 'score change' WHEN m2 >= m3 THEN 'morphology' ELSE 'stochastic disagreement' END AS dominant_cue, CASE WHEN hi THEN 'high' ELSE 'medium' END AS level FROM a""")
def concern_intervals(spark, d):
    c = cues.concern(cue_samples(spark, d), KW, order="i")
    return cues.concern_intervals(c, KW, "i").select(*KW, "start", "end", F.round("peak", 4).alias("peak"), F.round("mean", 4).alias("mean"), "dominant_cue", "level")


@query(FILT + """ SELECT series_id, w, i, round(least(1, abs(filtered - value) / 100.0), 6) AS score_cue, round(least(1, abs(filtered - value) / 60.0), 6) AS signal_cue FROM f""")
def replay_cues(spark, d):
    f = filtered_windows(spark, d).withColumns({"score_before": F.col("value"), "score_after": F.col("filtered"), "observation": F.col("value"), "candidate": F.col("filtered")})
    return cues.replay_cues(f, 100.0, 20.0).select(*KW, "i", r6(F.col("score_cue"), "score_cue"), r6(F.col("signal_cue"), "signal_cue"))


VERIFY = FILT + f""", z AS (SELECT series_id, w, i, i AS t, value AS o, filtered AS p, value >= 100 AND i >= 2 AS x FROM f), {isl("ev", "z", "series_id, w", "x")},
    fl AS (SELECT ev.series_id, ev.w, a, b, greatest(100, max(o)) AS fl, max(p) AS pk FROM ev JOIN z ON z.series_id = ev.series_id AND z.w = ev.w AND t >= a AND t < b GROUP BY ALL),
    al AS (SELECT *, max(CAST(x AS INTEGER)) OVER (PARTITION BY series_id, w ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 OR t < 2 AS ok FROM z), {isl("fb", "al", "series_id, w", "p >= 100 AND NOT ok")}"""


@query(VERIFY + """ SELECT k.series_id, k.w, (SELECT count(*) FROM fl WHERE fl.series_id = k.series_id AND fl.w = k.w) AS n_events, (SELECT count(*) FROM fl WHERE fl.series_id = k.series_id AND fl.w = k.w AND fl - pk - 1e-6 > 0) AS n_failed,
    (SELECT count(*) FROM fb WHERE fb.series_id = k.series_id AND fb.w = k.w) AS n_fabricated FROM (SELECT DISTINCT series_id, w FROM win) k""")
def witness_verification(spark, d):
    f = filtered_windows(spark, d).withColumn("t", F.col("i").cast("long")).withColumn("witness_id", F.lit("A"))
    w = spark.createDataFrame([("A", 100.0, 2, 0)], "witness_id string, threshold double, context_left int, context_right int")
    before, after = f.select(*KW, "witness_id", "t", F.col("value").alias("score")), f.select(*KW, "witness_id", "t", F.col("filtered").alias("score"))
    sizes = f.select(*KW).distinct().withColumn("n", F.lit(WINDOW))
    events, allowed = verify.constraints(before, KW, w, sizes, dilation=1)
    return verify.verify(after, events, allowed, KW, w)[0].select(*KW, "n_events", "n_failed", "n_fabricated")


def demo_controller() -> ct.Controller:
    """Two witnesses and the settings' own defaults."""
    return ct.Controller([scorers.Witness("A", scorers.magnitude, 2.5), scorers.Witness("B", scorers.SCORERS["last_value"], 14.0, 1)])


def packed_signals(spark, d):
    """Windows of 512 of suppliers' scaled prices: observation, a repaired and a classical candidate."""
    x = ((F.col("l_extendedprice") - 36000) / 23000).cast("double")
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series_id"), "l_orderkey", "l_linenumber", x.alias("value"))
    p = wn.full_windows(wn.number_samples(p, K, ["l_orderkey", "l_linenumber"]), K, 512)
    p = wn.spread(wn.pack(p, KW, ["value"]), KW).withColumnRenamed("value", "observation")
    p = scorers.filter_packed(p, kernels.median3, "observation", "candidate")
    return scorers.filter_packed(p, scorers.METHODS["moving_average_w9"], "observation", "classical")


@query()
def evidence_projection(spark, d):
    p = ct.project_windows(packed_signals(spark, d), KW, demo_controller())
    return p.select(*KW, "decision", "status", "fallback_reason", "evaluations", r6(F.col("retained_sample_fraction"), "retained_sample_fraction"), F.size("intervals").alias("n_intervals"), "audit_hash")


@query()
def evidence_routing(spark, d):
    p = ct.route_windows(packed_signals(spark, d), KW, demo_controller(), repair="candidate")
    return p.select(*KW, "source", "classical_status", "candidate_status", F.size("intervals").alias("n_intervals"), r6(F.aggregate("weight", F.lit(0.0), lambda a, x: a + x.cast("double")), "weight"))


@query()
def hybrid_runs(spark, d):
    return ct.run_hybrid(packed_signals(spark, d), KW, demo_controller(), repair="candidate").drop("output")


# Sessions, hashes ------------------------------------------------------------------------------------------------------


def action_log(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    k = F.col("conv_id") + F.col("turn")
    action = F.when((F.col("turn") > 0) & (k % 3 == 0), "revert").when(k % 3 == 1, "protect").otherwise("blend")
    return c.select("conv_id", F.col("turn").alias("revision"), action.alias("action"), (k % 5).alias("start"), (k % 5 + 3).alias("end"), F.lit(0.5).alias("beta"))


@query("""WITH a AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn > 0 AND (conv_id + turn) % 3 = 0 THEN 'revert' WHEN (conv_id + turn) % 3 = 1 THEN 'protect' ELSE 'blend' END AS action FROM conversations),
    h AS (SELECT *, sum(CASE WHEN action = 'revert' THEN -1 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM a), l AS (SELECT *, min(h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM h)
    SELECT conv_id, turn AS revision, action FROM l WHERE action <> 'revert' AND coalesce(later, h) >= h""")
def standing_edits(spark, d):
    return sessions.standing_edits(action_log(spark, d), ["conv_id"]).select("conv_id", "revision", "action")


@query("""WITH a AS (SELECT DISTINCT conv_id, turn, conv_id + turn AS k, CASE WHEN turn > 0 AND (conv_id + turn) % 3 = 0 THEN 'revert' WHEN (conv_id + turn) % 3 = 1 THEN 'protect' ELSE 'blend' END AS action FROM conversations),
    h AS (SELECT *, sum(CASE WHEN action = 'revert' THEN -1 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM a), l AS (SELECT *, min(h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM h),
    e AS (SELECT conv_id, turn, action, k % 5 AS a, k % 5 + 3 AS b FROM l WHERE action <> 'revert' AND coalesce(later, h) >= h), t AS (SELECT DISTINCT conv_id, unnest(generate_series(0, 7)) AS t FROM conversations),
    x AS (SELECT t.conv_id, t.t, last(action ORDER BY turn) AS action FROM t LEFT JOIN e ON e.conv_id = t.conv_id AND t.t >= a AND t.t < b GROUP BY t.conv_id, t.t)
    SELECT conv_id, t, CASE action WHEN 'protect' THEN CAST(t AS DOUBLE) WHEN 'blend' THEN 0.5 * t - 0.5 ELSE -1.0 END AS current FROM x""")
def session_signals(spark, d):
    log = action_log(spark, d)
    s = log.select("conv_id").distinct().withColumn("t", F.explode(F.expr("sequence(0L, 7L)"))).withColumns({"observation": F.col("t").cast("double"), "candidate": F.lit(-1.0), "baseline": F.lit(-1.0)})
    return sessions.current_signal(s, log, ["conv_id"]).select("conv_id", "t", "current")


@query("""WITH a AS (SELECT DISTINCT conv_id, turn, conv_id + turn AS k, CASE WHEN turn > 0 AND (conv_id + turn) % 3 = 0 THEN 'revert' WHEN (conv_id + turn) % 3 = 1 THEN 'protect' ELSE 'blend' END AS action FROM conversations)
    SELECT conv_id, count(*) AS n_actions, list_reduce(list_prepend(repeat('0', 64), list(concat_ws('|', turn, action, k % 5, k % 5 + 3) ORDER BY turn)), lambda x, y: sha256(x || '|' || y)) AS chain FROM a GROUP BY conv_id""")
def action_chain(spark, d):
    return sessions.chain_actions(action_log(spark, d), ["conv_id"], ["action", "start", "end"])


@query("""SELECT conv_id, turn AS revision FROM (SELECT DISTINCT conv_id, turn FROM conversations) QUALIFY turn % 4 <> row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1""")
def stale_revisions(spark, d):
    log = action_log(spark, d).withColumn("expected_revision", F.col("revision") % 4)
    return sessions.stale_actions(log, ["conv_id"]).select("conv_id", "revision")


@query("""SELECT doc_id, sha256(text) AS sha256 FROM documents""")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query()
def array_hashes(spark, d):
    p = digests.array_digests(packed_windows(spark, d))
    return digests.prefix_digests(p.withColumn("training_end", F.lit(16))).select(*KW, "digest", "prefix_digest")


@query("""SELECT event_id, sha256(CAST(json(props) AS VARCHAR)) AS digest FROM events""")
def canonical_json_hashes(spark, d):
    return digests.json_digests(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "digest")


@query()
def table_fingerprint(spark, d):
    return digests.table_digest(table(spark, d, "nation"))


@query(f"""WITH {W()}, {NOISY}, os AS (SELECT series_id, w, greatest((quantile_cont(obs, 0.75) - quantile_cont(obs, 0.25)) / 1.349, stddev_pop(obs), 1e-4) AS sc FROM noisy GROUP BY ALL), f AS ({med3("noisy", "series_id, w", "obs", "i")}),
    m AS (SELECT series_id, w, sqrt(avg(pow(filtered - value, 2))) / first(sc) AS e FROM f JOIN os USING (series_id, w) GROUP BY ALL), g AS (SELECT series_id, avg(e) AS e FROM m GROUP BY ALL) SELECT round(avg(e), 6) AS mean FROM g""")
def median_diagnostic(spark, d):
    n = noisy_windows(spark, d).select(*KW, "i", "label", F.col("value").alias("reference"), "observation").withColumn("t", F.col("i"))
    return benchmark.median_diagnostic(n, KW, K).select(r6(F.col("mean"), "mean"))


# Benchmark job ---------------------------------------------------------------------------------------------------------


def demo_conditions(spark, d):
    p = packed_windows(spark, d).withColumn("domain", F.when(F.col("series_id") % 2 == 0, "even").otherwise("odd")).withColumn("identity", F.lit(False))
    return benchmark.conditions(p, "bench")


@query()
def benchmark_waveforms(spark, d):
    s = benchmark.summary(benchmark.waveform_rows(demo_conditions(spark, d)))
    return s.select("method", r6(F.col("overall_os_nrmse"), "overall_os_nrmse"), r6(F.col("anomaly_os_nrmse"), "anomaly_os_nrmse"))


@query()
def benchmark_witnesses(spark, d):
    r = benchmark.witness_rows(demo_conditions(spark, d), [scorers.Witness("A", scorers.magnitude, 100.0), scorers.Witness("B", scorers.SCORERS["last_value"], 10000.0, 1)])
    return benchmark.evidence_summary(r).withColumn("retained_percent", F.round("retained_percent", 6))


@query()
def benchmark_tuning(spark, d):
    c = demo_conditions(spark, d)
    return benchmark.tune(c, benchmark.WAVELET_GRID, kernels.wavelet_shrink).withColumn("os_nrmse", F.round("os_nrmse", 6))
