"""Requests, digests, stream diagnostics and calibration runs, on rows written out."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import requests, signals
from framewright.sources.surrogates import face_frames


@pytest.mark.parametrize(("text", "want"), [
    ('{"b": 1.0, "a": [1e-7, 1E21, 0.000001, -0, 123456789012345680000, 0.1]}', '{"a":[1e-7,1e+21,0.000001,0,123456789012345680000,0.1],"b":1}'),
    ('{"\\u20ac": "a\\/b", "\\ud83d\\ude00": "\\n", "": null}', '{"":null,"€":"a/b","😀":"\\n"}'), ('[true, false, []]', "[true,false,[]]"), ("{broken", None), ("", None), (None, None)])
def test_canonical_json(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(requests.canonical_json(F.col("t"))).first()[0] == want


def test_digest_leaves_the_claim_out(spark):
    right = hashlib.sha256(b'{"a":1,"b":{"contentSha256":2}}').hexdigest()
    rows = [(f'{{"b":{{"contentSha256":2}},"contentSha256":"{right}","a":1}}',), ('{"a":1}',), (None,)]
    assert [r.verified for r in requests.digests(spark.createDataFrame(rows, "t string"), "t").collect()] == [True, False, False]


def test_request_errors(spark):
    def request(samples, **changes):
        good = {
            "schema_version": "v1", "request_ref": "r", "capture_epoch": 0, "window_ref": "w", "task_context": "rapid-syllables", "sample_rate_hz": 16000, "channel_count": 1,
            "duration_samples": 4, "requested_layers": list(requests.LAYERS), "pcm_base64": base64.b64encode(np.array(samples, "<f4").tobytes()).decode()}
        return tuple((good | changes).values())

    fine = [0.0, 1.5, -1.5, 1e-9]
    cases = {
        "": request(fine), "pcm-nonfinite": request([0, np.inf, 9, 0]), "pcm-out-of-range": request([0, 0, -1.6, 0]), "pcm-length": request([0.0] * 5), "pcm-invalid": request(fine, pcm_base64="AAA"),
        "requestRef,requestedLayers": request([np.nan] * 4, request_ref="x" * 121, requested_layers=[6]), "durationSamples": request(fine, duration_samples=3), "windowRef,pcmFloat32Base64": request(fine, window_ref=None, pcm_base64="")}
    schema = ("schema_version string, request_ref string, capture_epoch int, window_ref string, task_context string, sample_rate_hz int, channel_count int, duration_samples int, requested_layers array<int>, pcm_base64 string")
    got = requests.request_errors(spark.createDataFrame(list(cases.values()), schema), "v1", 4, 8).select("errors").collect()
    assert [",".join(r.errors) for r in got] == list(cases)
    assert requests.request_errors(spark.createDataFrame([], schema), "v1").count() == 0
    more = spark.createDataFrame([(*request(fine), ["z", "b"]), (*request(fine, schema_version="v2"), None), (*request(fine), [])], f"{schema}, extra array<string>")
    assert sorted(",".join(r.errors) for r in requests.request_errors(more, "v1", 4, 8).collect()) == ["", "b,z", "schemaVersion"]


def test_diagnostics(spark):
    rows = [("a", 1, 0, 0.0, 3.0), ("a", 2, 5, 20.0, None), ("a", 3, 8, 100.0, 1.0), ("a", 4, 9, 90.0, 2.0), ("b", 1, 4, 7.0, None)]
    b = spark.createDataFrame(rows, "session_id string, arrival int, seq long, t_ms double, latency_ms double").withColumns({"samples": F.lit(960), "sample_rate_hz": F.lit(48000)})
    got = {r.session_id: r for r in signals.diagnostics(b).collect()}
    a = got["a"]  # numbers skipped after block 0 do not count
    assert (a.received, a.lost, a.maximum_gap_ms, a.regressions, a.p95_latency_ms, a.lost_fraction) == (4, 2, 60.0, 1, 3.0, 2 / 6)
    assert (got["b"].received, got["b"].lost, got["b"].p95_latency_ms) == (1, 0, 0.0)


def test_calibration_runs(spark, tmp_path):
    line = spark.range(60).select(
        F.lit(0).cast("long").alias("l_orderkey"), F.col("id").alias("l_linenumber"), *(F.lit(0.0).alias(f"l_{c}") for c in ("partkey", "suppkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")))
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    f = face_frames(spark, str(tmp_path))
    assert [(r.resolved_ms, r.frames) for r in signals.calibration_runs(f).collect()] == [(1520.0, 39)]
    two = f.withColumn("face_count", F.when(F.col("seq") == 10, 2).otherwise(1))
    assert [(r.resolved_ms, r.frames) for r in signals.calibration_runs(two).collect()] == [(11 * 40 + 1520.0, 39)]
    late = f.withColumn("t_ms", F.col("t_ms") + F.when(F.col("seq") >= 30, 201).otherwise(0))
    assert signals.calibration_runs(late).count() == 0
    assert signals.calibration_runs(f.filter("seq < 0")).count() == 0
