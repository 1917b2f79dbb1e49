"""Queries for sources, sinks and protocol checks: tables go out through a sink, or into files' bytes, and come back."""

from __future__ import annotations

import io
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import digests, filters, sets, validate, verify
from ..operators import windows as wn
from ..sources import readers, sinks
from ..sources.staging import staging_dir
from . import analysis, benchmark, protocol
from .registry import ORACLE_SQL, QUERIES, SCALE, K, S, W, packed_windows, r6, samples, table, window_samples

KW = [*K, "w"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def folder(spark, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Series files -----------------------------------------------------------------------------------------------------------

#: Customers' balances as one series for each nation.
C = """c AS (SELECT c_nationkey AS nation, c_custkey, c_acctbal AS value, c_mktsegment = 'BUILDING' AS label, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS t FROM customer)"""


def balances(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("series_id"), "c_custkey", F.col("c_acctbal").cast("double").alias("value"), (F.col("c_mktsegment") == "BUILDING").alias("label"))
    return wn.number_samples(c, K, ["c_custkey"]).withColumn("t", F.col("t").cast("long"))


def nation_of(path: str = "series_id"):
    return F.regexp_extract(path, r"nation=(\d+)", 1).cast("long").alias("nation")


def written_balances(spark, d: str) -> str:
    path = folder(spark, "balances")
    sinks.write_case_csv(balances(spark, d), path, "nation")
    return path


@query(f"WITH {C} SELECT nation, t, t AS time, round(value, 6) AS value, label FROM c")
def csv_series(spark, d):
    """Series written as CSV files and read back by the names in their headers."""
    s = readers.read_csv_series(spark, f"{written_balances(spark, d)}/*")
    return s.select(nation_of(), "t", "time", r6(F.col("value"), "value"), "label")


@query(f"WITH {C} SELECT nation, t, round(value, 6) AS value FROM c WHERE t < 5")
def csv_series_limited(spark, d):
    s = readers.read_csv_series(spark, f"{written_balances(spark, d)}/*", signal="VALUE", time="time", max_rows=5)
    return s.select(nation_of(), "t", r6(F.col("value"), "value"))


@query("SELECT DISTINCT c_nationkey AS nation, CAST(1 AS BIGINT) AS files FROM customer")
def discovered_files(spark, d):
    f = readers.discover(spark, written_balances(spark, d))
    return f.where("length > 0").groupBy(nation_of("path")).agg(F.count("*").alias("files"))


@query(f"WITH {C}, k AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY t) - 1 AS place FROM c WHERE t % 3 <> 0) SELECT nation, place AS t, CASE WHEN t % 5 = 0 THEN 'x' || t END AS t_raw, round(value, 6) AS value, label FROM k")
def csv_blank_signals(spark, d):
    """Other names, blank signals left out, times that are no numbers, labels in words."""
    s, path = balances(spark, d), folder(spark, "blank")
    stamp = F.when(F.col("t") % 5 == 0, F.concat(F.lit("x"), F.col("t"))).otherwise(F.col("t").cast("string"))
    rows = s.select(F.col("series_id").alias("nation"), stamp.alias("Date"), F.when(F.col("t") % 3 != 0, F.col("value")).alias("Observation"), F.when(F.col("label"), "Anomalous").otherwise("normal").alias("class"), "t")
    rows.repartition("nation").sortWithinPartitions("nation", "t").drop("t").write.partitionBy("nation").csv(path, header=True)
    found = readers.read_csv_series(spark, f"{path}/*")
    return found.select(nation_of(), "t", "t_raw", r6(F.col("value"), "value"), "label")


def archives(spark, d: str) -> DataFrame:
    """(path, content) of a ZIP archive for each region, with a member for each nation."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("series_id"), "n_regionkey")
    packed = wn.pack(balances(spark, d).withColumn("label", F.col("label").cast("int")), K, ["value", "label"], "t").join(n, "series_id")

    def run(batches):
        for pdf in batches:
            out = []
            for region, members in pdf.groupby("n_regionkey"):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("README.txt", "no member")
                    for r in members.itertuples():
                        body = "".join(f"{v!r},{k}\n" for v, k in zip(map(float, r.value), r.label, strict=True))
                        z.writestr(f"{r.series_id:03d}_{'TPC' if r.series_id % 2 else 'ODD'}_id_{r.series_id}_Bank_tr_8_1st_9.csv", "Data,Label\n" + body)
                out.append((f"{region}.zip", data.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return packed.mapInPandas(run, "path string, content binary")


@query(f"WITH {C} SELECT printf('%03d', nation) || CASE WHEN nation % 2 = 1 THEN '_TPC' ELSE '_ODD' END || '_id_' || nation || '_Bank_tr_8_1st_9.csv' AS file_name, CAST(nation AS INTEGER) AS source_id, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE label) AS positive FROM c GROUP BY nation")
def archive_scan(spark, d):
    a = readers.archive_members(archives(spark, d))
    total, ones = F.aggregate("signal", F.lit(0.0), lambda x, y: x + y), F.size(F.filter("labels", lambda x: x > 0)).cast("long")
    return a.select("file_name", "source_id", F.size("signal").cast("long").alias("n"), F.round(total, 4).alias("total"), ones.alias("positive"))


@query(f"WITH {C} SELECT 'TPC' AS source_collection, 'Bank' AS domain, CAST(nation AS INTEGER) AS source_id, 'bank' AS domain_key FROM c WHERE nation % 2 = 1 GROUP BY nation")
def archive_domains(spark, d):
    """Members of the wanted collections only; others are not read."""
    specs = spark.createDataFrame([("bank", "TPC", None)], "domain_key string, source_collection string, domain string")
    a = readers.archive_members(archives(spark, d), specs)
    return validate.in_domain(a, specs).select("source_collection", "domain", "source_id", "domain_key")


@query(f"WITH {C} SELECT nation, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE label) AS positive FROM c GROUP BY nation HAVING count(*) >= 64")
def npz_cases(spark, d):
    packed = wn.pack(balances(spark, d), K, ["value", "label"], "t").where("size(value) >= 64")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                data = io.BytesIO()
                np.savez(data, signal=np.asarray(r.value, np.float64), labels=np.asarray(r.label, np.int8))
                out.append((f"nation={r.series_id}", data.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    c = readers.npz_cases(packed.mapInPandas(run, "path string, content binary"))
    total, ones = F.aggregate("values", F.lit(0.0), lambda x, y: x + y), F.size(F.filter("labels", lambda x: x > 0)).cast("long")
    return c.select(nation_of("path"), F.size("values").cast("long").alias("n"), F.round(total, 4).alias("total"), ones.alias("positive"))


# Tables of runs ---------------------------------------------------------------------------------------------------------


def traces(spark, d: str) -> DataFrame:
    p = packed_windows(spark, d)
    least = p.select(*KW).orderBy(*KW).limit(1).withColumn("identity", F.lit(True))
    p = p.join(F.broadcast(least), KW, "left").withColumn("identity", F.coalesce("identity", F.lit(False)))
    domain = F.when(F.col("series_id") % 2 == 0, "even").otherwise("odd")
    return p.select(F.concat_ws(":", "series_id", "w").alias("condition_id"), domain.alias("domain"), F.lit("raw").alias("family"), F.lit(0.5).alias("severity"), F.lit(0).alias("replicate"), "identity", F.lit("raw").alias("method"), F.col("values").cast("array<float>").alias("values"))


@query(f"WITH {W()} SELECT series_id || ':' || w AS condition_id, row_number() OVER (ORDER BY series_id, w) = 1 AS identity, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 4) AS total FROM win GROUP BY series_id, w")
def replay_scan(spark, d):
    t, path = traces(spark, d), folder(spark, "replay")
    receipt = sinks.write_with_receipt(t, path)
    r = readers.read_replay(spark, path, receipt["digest"], receipt["rows"], 32)
    return r.select("condition_id", "identity", F.round(F.aggregate("values", F.lit(0.0), lambda x, y: x + y.cast("double")), 4).alias("total"))


@query(f"WITH {W()} SELECT CASE WHEN series_id % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, count(DISTINCT series_id || ':' || w) AS conditions FROM win GROUP BY ALL")
def trace_scan(spark, d):
    t, path = traces(spark, d), folder(spark, "traces")
    sinks.write_cases(t, path, ["method"])
    expected = {r["domain"]: r["n"] for r in t.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    return readers.read_traces(spark, path, expected).groupBy("domain").agg(F.count("*").alias("conditions"))


@query(f"WITH {W()} SELECT series_id || ':' || w AS condition_id, row_number() OVER (ORDER BY series_id, w) = 1 AS asked FROM win GROUP BY series_id, w QUALIFY asked")
def identity_condition(spark, d):
    return validate.condition_row(traces(spark, d), "none", 0.0, 0).select("condition_id", F.lit(True).alias("asked"))


@query("SELECT DISTINCT 'f' || (p_partkey // 2) || '.csv' AS file_name FROM part")
def official_list(spark, d):
    path = folder(spark, "list")
    k = F.floor(F.col("p_partkey") / 2)
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("data\\f"), k, F.lit(".csv"))).otherwise(F.concat(F.lit("data/f"), k, F.lit(".csv,")))
    lines = table(spark, d, "part").select(line.alias("value")).union(spark.createDataFrame([("file_name",)], "value string"))
    lines.write.text(path)
    return readers.read_official_list(spark, path)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 2) END AS balance, c_mktsegment FROM customer")
def metric_rows_csv(spark, d):
    """Metric rows with empty cells, out and back."""
    path = folder(spark, "rows")
    c = table(spark, d, "customer")
    sinks.write_rows_csv(c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("double")).alias("balance"), "c_mktsegment"), path)
    return readers.read_rows_csv(spark, path, "c_custkey long, balance double, c_mktsegment string").withColumn("balance", F.round("balance", 2))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS condition_id, round(o_totalprice / 1000, 6) AS latency_ms FROM orders WHERE o_orderpriority = '1-URGENT'")
def latency_scan(spark, d):
    path = folder(spark, "latencies")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("condition_id"), F.col("o_orderpriority").alias("method"), (F.col("o_totalprice").cast("double") / 1000).alias("latency_ms"))
    sinks.write_rows_csv(o, path)
    return readers.read_latencies(spark, path, "1-URGENT").withColumn("latency_ms", F.round("latency_ms", 6))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS t, CAST(c_custkey AS VARCHAR) AS t_raw, CAST(c_acctbal AS DOUBLE) AS value, c_mktsegment = 'BUILDING' AS label FROM customer ORDER BY c_custkey LIMIT 250000")
def uploaded_series(spark, d):
    """An upload is one request's arrays, of the most samples that one may have."""
    rows = table(spark, d, "customer").orderBy("c_custkey").limit(readers.UPLOAD_MOST).select("c_custkey", F.col("c_acctbal").cast("double"), (F.col("c_mktsegment") == "BUILDING").cast("int")).collect()
    return readers.upload(spark, [r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows]).drop("series_id")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey / 8.0 END AS share FROM nation")
def json_documents(spark, d):
    """Numbers that JSON lacks become null."""
    path = folder(spark, "json")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 == 0, float("nan")).otherwise(F.col("n_nationkey") / 8.0).alias("share"))
    sinks.write_json(n, path)
    return spark.read.schema("n_nationkey long, n_name string, share double").json(path)


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS body FROM nation""")
def json_responses(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return sinks.response(n).select(F.get_json_object("body", "$.n_nationkey").cast("long").alias("n_nationkey"), "body")


@query("SELECT r_name AS name, r_regionkey AS key, true AS whole FROM region")
def config_scan(spark, d):
    """A configuration written as one JSON object and read on the driver."""
    path = folder(spark, "config")
    regions = table(spark, d, "region").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r_name", "r_regionkey")))).alias("regions"), F.lit(1).alias("version"))
    regions.select(F.to_json(F.struct("version", "regions"))).coalesce(1).write.text(path)
    found = readers.read_config(f"{path}/part-*", ("version", "regions"), spark)
    return spark.createDataFrame([(k, int(v), found["version"] == 1) for k, v in found["regions"].items()], "name string, key long, whole boolean")


@query("SELECT o_orderstatus AS split, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY ALL")
def split_cases(spark, d):
    """Cases by split, out and back with the split from their folders."""
    path = folder(spark, "splits")
    sinks.write_cases(table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_totalprice").cast("double").alias("price")), path, ["split"])
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 1).alias("total"))


@query("SELECT count(*) AS n_rows, true AS holds, true AS other_differs FROM orders")
def receipts(spark, d):
    """A rebuild in other files has the same receipt; a changed table has not."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    a, b = folder(spark, "receipt"), folder(spark, "receipt")
    first, second = sinks.write_with_receipt(o, a), sinks.write_with_receipt(o.repartition(5, "o_totalprice"), b)
    changed = digests.table_digest(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0).otherwise(F.col("o_totalprice")))).first()["digest"]
    return spark.createDataFrame([(first["rows"], first["digest"] == second["digest"], changed != first["digest"])], "n_rows long, holds boolean, other_differs boolean")


# Checks and protocol ----------------------------------------------------------------------------------------------------


@query(f"WITH {S} SELECT series_id, t, value, value * 2 AS twice FROM s")
def paired_samples(spark, d):
    s = samples(spark, d).select("series_id", "t", "value")
    return validate.paired(s, s.select("series_id", "t", (F.col("value") * 2).alias("twice")), K)


@query(f"WITH {S}, r AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE t % 7 = 6) AS odd FROM s GROUP BY ALL) SELECT series_id, n, odd AS n_odd_labels FROM r WHERE odd > 0 AND n >= 2")
def odd_labels(spark, d):
    """Series with a label that is neither 0 nor 1."""
    s = samples(spark, d).withColumn("flag", F.when(F.col("t") % 7 == 6, 2).otherwise(F.col("label").cast("int")))
    return validate.invalid_series(s, K, label="flag").where("reason = 'labels_not_binary'").select("series_id", "n", "n_odd_labels")


@query("SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, n_name AS witness_id, CAST(n_nationkey AS DOUBLE) AS threshold FROM nation")
def frozen_thresholds(spark, d):
    """Witnesses with the thresholds recorded for their model and warm-up."""
    n = table(spark, d, "nation")
    domain = F.when(F.col("n_regionkey") % 2 == 0, "even").otherwise("odd").alias("domain")
    key = [domain, F.col("n_name").alias("witness_id"), F.sha2("n_name", 256).alias("model_sha256"), F.col("n_regionkey").cast("int").alias("context_left")]
    return validate.require_thresholds(n.select(*key), n.select(*key, F.col("n_nationkey").cast("double").alias("threshold"))).select("domain", "witness_id", "threshold")


@query("SELECT true AS grids_equal, false AS without_one, true AS reports_match, true AS scores_equal FROM region LIMIT 1")
def equal_grids(spark, d):
    """Grids, witness sets and scores of two tables compared in both directions."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("condition_id"), F.col("n_name").alias("witness_id"), F.lit(0).alias("t"), F.col("n_regionkey").cast("double").alias("score"))
    less = n.where("condition_id <> 3")
    found = (sets.grids_equal(n, n.repartition(3), ["condition_id"]), sets.grids_equal(n, less, ["condition_id"]), verify.reports_match(n, n), verify.scores_equal(n, n.repartition(2), ["condition_id"]))
    return spark.createDataFrame([found], "grids_equal boolean, without_one boolean, reports_match boolean, scores_equal boolean")


@query(f"WITH {W()}, sc AS (SELECT series_id, w, median(value) AS center, {SCALE} AS scale FROM win GROUP BY ALL) SELECT series_id, w, i, round((value - center) / scale, 6) AS observation, round((value * 1.5 - center) / scale, 6) AS target FROM win JOIN sc USING (series_id, w)")
def normalised_pairs(spark, d):
    """Observation and target by the statistics of the observation."""
    w = window_samples(spark, d).withColumns({"observation": F.col("value"), "target": F.col("value") * 1.5})
    n = filters.normalise(w.select(*KW, "i", "observation", "target"), KW, ["observation", "target"], "observation")
    return n.select(*KW, "i", r6(F.col("observation"), "observation"), r6(F.col("target"), "target"))


@query("SELECT o_orderkey AS request, CASE WHEN o_orderkey % 3 <> 0 THEN 'accept' END AS shown, CASE WHEN o_orderkey % 3 <> 0 THEN 'automatic' ELSE 'review_only' END AS mode FROM orders")
def automatic_payloads(spark, d):
    """Certificates are shown for eligible requests only."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"))
    decided = o.withColumns({"status": F.lit("passed"), "decision": F.lit("accept")})
    eligible = o.select("request", (F.col("request") % 3 != 0).alias("eligible"), F.lit(None).cast("string").alias("reason"))
    return analysis.automatic_payload(decided, eligible, ["request"]).select("request", F.col("certificate.decision").alias("shown"), "mode")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def parity_sentinel(spark, d):
    """Rows whose metric is off by more than its tolerance."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("metric"))
    off = o.withColumn("metric", F.col("metric") + F.when(F.col("o_orderkey") % 10 == 0, 1e-3).otherwise(0.0))
    return benchmark.parity(o, off, ["o_orderkey"], {"metric": 1e-6}).select("o_orderkey")


def bank_sources(spark, d: str) -> DataFrame:
    """Sources as an archive gives them: each user's values with the errors as labels, eight normal samples declared."""
    s = samples(spark, d).withColumn("flag", (F.col("label") & (F.col("t") >= 8)).cast("int"))
    p = wn.pack(s, K, ["value", "flag"], "t").where("size(value) >= 32")
    return p.select(F.concat(F.lit("u"), F.col("series_id"), F.lit(".csv")).alias("file_name"), F.col("value").alias("signal"), F.col("flag").alias("labels"), F.lit(8).cast("long").alias("training_end"))


PROTOCOL = f"""WITH {S}, k AS (SELECT series_id, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 32), l AS (SELECT s.*, n, label AND t >= 8 AS x FROM s JOIN k USING (series_id)),
    e AS (SELECT series_id, any_value(n) AS n, min(t) AS a, max(t) + 1 AS b FROM (SELECT *, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM l WHERE x) GROUP BY series_id, g)"""


@query(PROTOCOL + """ SELECT 'u' || k.series_id || '.csv' AS file_name, k.n AS n_samples, CASE WHEN k.series_id % 5 = 0 THEN 'evaluation' WHEN k.series_id % 5 = 1 THEN 'tuning' ELSE 'unlisted' END AS official_split,
    count(*) FILTER (WHERE b - a <= 2) AS eligible_events, count(*) FILTER (WHERE b - a > 2) AS excluded_events FROM k LEFT JOIN e USING (series_id) GROUP BY ALL""")
def protocol_manifest(spark, d):
    """A row for each source with its split and its events within and beyond the longest allowed."""
    return protocol.primary_protocol(bank_sources(spark, d), *official(spark, d), protocol.ProtocolSettings(window=32, longest_event=2))[1].select("file_name", "n_samples", "official_split", "eligible_events", "excluded_events")


def official(spark, d: str) -> tuple[DataFrame, DataFrame]:
    names = samples(spark, d).select("series_id").distinct().withColumn("file_name", F.concat(F.lit("u"), F.col("series_id"), F.lit(".csv")))
    return names.where("series_id % 5 = 0").select("file_name"), names.where("series_id % 5 = 1").select("file_name")


@query(PROTOCOL + """ SELECT 'u' || series_id || '.csv' AS file_name, greatest(0, least((a + b - 1) // 2 - 16, n - 32)) AS window_start, b - a AS n_labels FROM e WHERE b - a <= 2""")
def protocol_event_windows(spark, d):
    """The event windows of the protocol: centred on each event and held inside the series."""
    w = protocol.primary_protocol(bank_sources(spark, d), *official(spark, d), protocol.ProtocolSettings(window=32, longest_event=2))[0].where("kind = 'event'")
    e = protocol.source_events(bank_sources(spark, d)).select("file_name", F.col("event_index"), (F.col("end") - F.col("start")).alias("n_labels"))
    return w.select("file_name", "event_index", F.col("window_start").cast("long").alias("window_start")).join(e, ["file_name", "event_index"]).drop("event_index")


@query(f"WITH {S}, k AS (SELECT series_id FROM s GROUP BY ALL HAVING count(*) >= 32) SELECT count(*) AS sources, true AS holds, false AS other_holds FROM k")
def protocol_lock(spark, d):
    """The lock of a protocol's tables holds for a rebuild and not for other settings."""
    build = lambda longest: protocol.primary_protocol(bank_sources(spark, d), *official(spark, d), protocol.ProtocolSettings(window=32, longest_event=longest))[1]
    locked, again, other = (protocol.lock({"manifest": build(longest)}) for longest in (2, 2, 1))
    n = build(2).count()
    return spark.createDataFrame([(n, locked == again, locked == other)], "sources long, holds boolean, other_holds boolean")


# Learned scorers with fixed weights -------------------------------------------------------------------------------------

#: A difference and a mean of two samples, an identity output: perceptrons and convolutions that SQL can follow.
LINEAR_LAYER = [(np.array([[0.25], [0.75]]), np.array([0.5]))]
CONV_LAYERS = [(np.array([[[0.5, 0.5]]]), np.array([0.0]), 2), (np.array([[[0.25, 0.75]]]), np.array([1.0]), 1)]


def lagged(k: int) -> str:
    return f"coalesce(lag(value, {k}) OVER o, first_value(value) OVER o)"


@query(f"WITH {W()}, p AS (SELECT series_id, w, i, value, {lagged(1)} AS l1, {lagged(2)} AS l2 FROM win WINDOW o AS (PARTITION BY series_id, w ORDER BY i)) SELECT series_id, w, round(sum(CASE WHEN i < 2 THEN 0 ELSE pow(value - (0.25 * l2 + 0.75 * l1 + 0.5), 2) END), 3) AS total FROM p GROUP BY ALL")
def perceptron_scores(spark, d):
    return _totals(spark, d, lambda x: kernels.mlp_forecast_score(x, LINEAR_LAYER))


@query(f"""WITH {W()}, p AS (SELECT series_id, w, i, value, {lagged(1)} AS x0, {lagged(3)} AS x2 FROM win WINDOW o AS (PARTITION BY series_id, w ORDER BY i)),
    h AS (SELECT series_id, w, i, value, greatest(0.0, 0.5 * x2 + 0.5 * x0) AS h FROM p), g AS (SELECT series_id, w, i, value, h, coalesce(lag(h) OVER o, h) AS h1 FROM h WINDOW o AS (PARTITION BY series_id, w ORDER BY i))
    SELECT series_id, w, round(sum(CASE WHEN i < 4 THEN 0 ELSE pow(value - (0.25 * h1 + 0.75 * h + 1.0), 2) END), 3) AS total FROM g GROUP BY ALL""")
def dilated_convolution_scores(spark, d):
    return _totals(spark, d, lambda x: kernels.conv_forecast_score(x, CONV_LAYERS))


def _totals(spark, d: str, scorer) -> DataFrame:
    from ..operators import scorers

    p = scorers.score_packed(packed_windows(spark, d), scorer)
    return p.select(*KW, F.round(F.aggregate("scores", F.lit(0.0), lambda x, y: x + y), 3).alias("total"))


# Responses --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {W()}, v AS (SELECT series_id, w, CASE WHEN series_id % 3 = 0 THEN 0.0 ELSE value / 100 END AS x, value / 200 AS y FROM win)
    SELECT series_id, w, CAST(count_if(x >= 0.66) AS BIGINT) AS n_high, CAST(count_if(x >= 0.33 AND x < 0.66) AS BIGINT) AS n_medium, CAST(count_if(x < 0.33) AS BIGINT) AS n_low, round(sum(y), 6) AS changed, CAST(0 AS DOUBLE) AS moved,
    'Inspection priority; not a calibrated probability.' AS interpretation FROM v GROUP BY ALL""")
def response_fallbacks(spark, d):
    """What responses show for windows whose concern has the wrong length in every third series."""
    p = packed_windows(spark, d).withColumn("n", F.size("values"))
    part = F.when(F.col("series_id") % 3 == 0, F.slice("values", 1, 5)).otherwise(F.col("values"))
    p = p.select(*KW, "n", F.transform(part, lambda x: x / 100).alias("concern"), F.lit(None).cast("array<double>").alias("score_delta"), F.transform("values", lambda x: x / 200).alias("possible_suppression"))
    out = analysis.cues_response(analysis.concern_response(p))
    graded = [F.expr(f"cast(size(filter(levels, x -> x = '{k}')) as bigint)").alias(f"n_{k}") for k in ("high", "medium", "low")]
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda x, y: x + y), 6)
    return out.select(*KW, *graded, total("score_change").alias("changed"), total("morphology").alias("moved"), "interpretation")


@query("SELECT t, t BETWEEN 235 AND 257 AS label, true AS near FROM range(512) AS r(t)")
def demo_case(spark, d):
    """The synthetic labelled case: where its bump lies, and that its noise stays within six deviations."""
    phase = F.col("t") * F.lit(12 * np.pi / 511)
    bump = F.when(F.col("label"), 0.38 * F.pow(F.sin((F.col("t") - 235) * F.lit(np.pi / 22)), 2)).otherwise(0.0)
    smooth = 0.72 * F.sin(phase) + 0.18 * F.sin(0.23 * phase + 0.7) + 0.0007 * F.col("t") + bump
    return readers.demo_series(spark).select("t", "label", (F.abs(F.col("value") - smooth) < 6 * 0.012).alias("near"))
