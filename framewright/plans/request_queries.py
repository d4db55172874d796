"""Queries of stream diagnostics, calibration runs, requests and digests."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import requests, signals
from framewright.plans import oracle_sql as sql
from framewright.plans.voice_queries import rounded
from framewright.sources.surrogates import face_frames


def a47_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 20 ms from events: every 53rd number is missing, every 61st block is 90 ms late, some latencies are unknown."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value").filter(F.col("event_id") % 53 != 7)
    seq = F.col("event_id") % 1000
    b = e.select(
        F.expr("event_id div 1000").alias("session_id"), F.col("event_id").alias("arrival"), seq.alias("seq"), (seq * 20 + F.when(F.col("event_id") % 61 == 5, 90).otherwise(0)).cast("double").alias("t_ms"),
        F.lit(960).alias("samples"), F.lit(48000).alias("sample_rate_hz"), F.when(F.col("event_id") % 9 != 4, F.col("value") / 10).alias("latency_ms"))
    return rounded(signals.diagnostics(b))


def w12_calibration_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh session shows two faces every second for its first 20 s, every seventh has a new epoch at frame 30, every fifth loses frames 20 to 29."""
    f, s = face_frames(spark, sf_dir), F.col("session_id")
    f = f.withColumn("face_count", F.when((s % 11 == 3) & (F.col("seq") < 500) & (F.col("seq") % 25 == 24), 2).otherwise(F.col("face_count")))
    f = f.withColumn("capture_epoch", F.when((s % 7 == 2) & (F.col("seq") >= 30), 2).otherwise(F.col("capture_epoch")))
    return rounded(signals.calibration_runs(f.filter((s % 5 != 1) | ~F.col("seq").between(20, 29))))


def f17_request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sound of 64 samples, which the limits allow here, with one kind of fault or none."""

    @F.pandas_udf("string")
    def packed(v: pd.Series, n: pd.Series) -> pd.Series:
        def one(x: np.ndarray, i: int) -> str:
            x = np.array(x, "<f4")
            if i % 7 == 1:
                x[3] = np.nan
            if i % 11 == 2:
                x[5] = -1.75
            return ("*" if i % 19 == 5 else "") + base64.b64encode(x.tobytes()).decode()

        return pd.Series([one(x, i) for x, i in zip(v, n, strict=True)])

    i = F.col("vec_id")
    pick = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    r = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", pick(i % 41 == 11, "request.v0", "request.v1").alias("schema_version"), F.when(i % 43 == 12, F.array(F.lit("sampleCount"), F.lit("note"))).alias("extra"), pick(i % 29 == 7, "", "request").alias("request_ref"), pick(i % 31 == 8, -1, 1).alias("capture_epoch"),
        F.when(i % 37 != 9, F.lit("window")).alias("window_ref"), pick(i % 5 == 0, "rapid-syllables", "standardized-reading").alias("task_context"), pick(i % 23 == 6, 8000, 16000).alias("sample_rate_hz"), F.lit(1).alias("channel_count"),
        pick(i % 13 == 3, 65, 64).alias("duration_samples"), F.when(i % 17 == 4, F.array(F.lit(6), F.lit(12))).otherwise(F.array(*map(F.lit, requests.LAYERS))).alias("requested_layers"), packed("embedding", "vec_id").alias("pcm_base64"))
    return requests.request_errors(r, "request.v1", 64, 480_000).select("vec_id", F.array_join("errors", ",").alias("errors"))


def r21_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer, its keys out of order; every third claims another digest, every fourth none."""
    k = F.col("c_custkey").cast("string")
    canonical = F.concat(F.lit('{"a":['), k, F.lit(',0.5,null,{"x":"é","y":true}],"id":"c'), k, F.lit('","z":{"k":1,"m":"/"}}'))
    claim = F.when(F.col("c_custkey") % 3 == 1, F.lit("0" * 64)).when(F.col("c_custkey") % 4 != 2, F.sha2(canonical, 256))
    text = F.concat(
        F.lit('{"z": {"m": "\\/", "k": 1.0}, "id": "c'), k, F.lit('", '), F.coalesce(F.concat(F.lit('"contentSha256": "'), claim, F.lit('", ')), F.lit("")), F.lit('"a": ['), k, F.lit(', 5e-1, null, {"y": true, "x": "\\u00e9"}]}'))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.alias("document"))
    return requests.digests(c, "document").select("c_custkey", "digest", "verified")


QUERIES = {"a47_diagnostics": a47_diagnostics, "w12_calibration_runs": w12_calibration_runs, "f17_request_errors": f17_request_errors, "r21_digests": r21_digests}

ORACLES = {
    "a47_diagnostics": """
        WITH b AS (SELECT event_id // 1000 AS session_id, event_id, event_id % 1000 AS seq, (event_id % 1000) * 20 + CASE WHEN event_id % 61 = 5 THEN 90 ELSE 0 END AS t, CASE WHEN event_id % 9 <> 4 THEN value / 10 END AS ms
                   FROM events WHERE event_id % 53 <> 7),
        s AS (SELECT session_id, ms, CASE WHEN lag(seq) OVER w > 0 THEN greatest(0, seq - lag(seq) OVER w - 1) ELSE 0 END AS lost, coalesce(greatest(0, t - lag(t) OVER w - 20), 0) AS gap, coalesce(t < lag(t) OVER w, false) AS back
              FROM b WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
        d AS (SELECT session_id, count(*) AS received, sum(lost)::BIGINT AS lost, max(gap)::DOUBLE AS maximum_gap_ms, count(*) FILTER (back) AS regressions, list_sort(list(ms) FILTER (ms IS NOT NULL)) AS l FROM s GROUP BY ALL)
        SELECT session_id, received, lost, maximum_gap_ms, regressions, round(coalesce(l[least(len(l) - 1, floor(len(l) * 0.95))::INT + 1], 0), 6) AS p95_latency_ms, round(lost / (received + lost), 6) AS lost_fraction FROM d""",
    "w12_calibration_runs": "WITH " + sql.FACE + """,
        g AS (SELECT session_id, seq, t_ms, CASE WHEN session_id % 11 = 3 AND seq < 500 AND seq % 25 = 24 THEN 2 ELSE faces END AS faces, session_id % 7 = 2 AND seq >= 30 AS fresh,
                     NOT nocam AND sharp >= 0.0008 AS good FROM face WHERE session_id % 5 <> 1 OR seq NOT BETWEEN 20 AND 29),
        h AS (SELECT *, CASE WHEN faces <> 1 OR t_ms - lag(t_ms) OVER w > 200 OR fresh <> lag(fresh) OVER w THEN 1 ELSE 0 END AS cut FROM g WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
        r AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM h),
        c AS (SELECT session_id, t_ms, t_ms - min(t_ms) OVER w AS duration_ms, count(*) OVER w AS frames, count(*) FILTER (good) OVER w / count(*) OVER w AS share FROM r WHERE faces = 1
              WINDOW w AS (PARTITION BY session_id, run ORDER BY seq))
        SELECT session_id, t_ms AS resolved_ms, duration_ms, frames, round(share, 6) AS usable_fraction, round((frames - 1) * 1000 / duration_ms, 6) AS rate
        FROM c WHERE duration_ms >= 1500 AND share >= 0.8 AND (frames - 1) * 1000 / duration_ms >= 20 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t_ms) = 1""",
    "f17_request_errors": """
        WITH r AS (SELECT vec_id, concat_ws(',', CASE WHEN vec_id % 41 = 11 THEN 'schemaVersion' END, CASE WHEN vec_id % 29 = 7 THEN 'requestRef' END, CASE WHEN vec_id % 31 = 8 THEN 'captureEpoch' END, CASE WHEN vec_id % 37 = 9 THEN 'windowRef' END,
                     CASE WHEN vec_id % 23 = 6 THEN 'sampleRateHz' END, CASE WHEN vec_id % 17 = 4 THEN 'requestedLayers' END, CASE WHEN vec_id % 43 = 12 THEN 'note,sampleCount' END) AS f,
                   vec_id % 11 = 2 OR list_max(list_transform(embedding, lambda x: abs(x))) > 1.5 AS loud FROM embeddings)
        SELECT vec_id, CASE WHEN f <> '' THEN f WHEN vec_id % 19 = 5 THEN 'pcm-invalid' WHEN vec_id % 13 = 3 THEN 'pcm-length' WHEN vec_id % 7 = 1 THEN 'pcm-nonfinite' WHEN loud THEN 'pcm-out-of-range' ELSE '' END AS errors FROM r""",
    "r21_digests": """
        SELECT c_custkey, sha256('{"a":[' || c_custkey || ',0.5,null,{"x":"é","y":true}],"id":"c' || c_custkey || '","z":{"k":1,"m":"/"}}') AS digest, c_custkey % 3 <> 1 AND c_custkey % 4 <> 2 AS verified FROM customer""",
}
