"""Queries of landmark geometry and of the small rules of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tables import settle
from framewright.operators import landmarks, records, report, voice
from framewright.plans import oracle_sql as sql
from framewright.plans.voice_queries import rounded
from framewright.sources.surrogates import face_frames, face_sessions, voice_frames, voice_sessions

WIDTH, HEIGHT = 640.0, 480.0
#: Landmarks that lie outside the image in some faces: of an eye's corners and lids, the mouth, and the brows.
ODD = (263, 385, 291, 13, 70, 33, 158)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """478 landmarks from each vector, a little apart even where values repeat.

    Every seventeenth face has only 300.  Some have one landmark right of the
    image, above it, or at no finite place; some have one on its very edge.
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    last = F.when(F.col("vec_id") % 17 == 0, 299).otherwise(477)
    at = lambda i, k: F.get("v", (2 * i + k) % 64) * 0.3 + 0.5 + i / 2000
    k = F.col("vec_id")
    odd = lambda i: i == F.element_at(F.array(*map(F.lit, ODD)), (k % len(ODD) + 1).cast("int"))
    x = lambda i: F.when(odd(i) & (k % 13 == 5), 1.01).when(odd(i) & (k % 23 == 7), float("inf")).when(odd(i) & (k % 29 == 3), float("nan")).when(odd(i) & (k % 31 == 9), 1.0).otherwise(at(i, 0))
    y = lambda i: F.when(odd(i) & (k % 19 == 4), -0.001).when(odd(i) & (k % 37 == 2), 0.0).otherwise(at(i, 1))
    return e.select("vec_id", "label", (k * 40).cast("double").alias("acquired_at_ms"), F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(x(i).alias("x"), y(i).alias("y"))).alias("points"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(landmarks.features(faces(spark, sf_dir), "points", WIDTH, HEIGHT).drop("points"))


def p13_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(landmarks.features(faces(spark, sf_dir), "points", WIDTH, HEIGHT).select(
        "vec_id", F.col("system.x").alias("centre_x"), F.col("system.y").alias("centre_y"), F.col("system.scale").alias("scale"), F.col("system.angle").alias("angle"), F.col("mouth_left.x").alias("left_x"),
        F.col("mouth_left.y").alias("left_y"), F.col("mouth_right.x").alias("right_x"), F.col("mouth_right.y").alias("right_y")))


def p15_apertures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(landmarks.features(faces(spark, sf_dir), "points", WIDTH, HEIGHT).select("vec_id", "eye_left", "eye_right", "mouth_aperture"))


def p18_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of one label follow each other; every seventh may not carry its points on."""
    return rounded(landmarks.movement_speed(_features(spark, sf_dir), ["label"], "vec_id", F.col("vec_id") % 7 != 3).select("vec_id", F.size(F.coalesce("motion", F.array())).alias("points"), "movement_speed"))


def f11_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    f = frames.join(face_sessions(frames), "session_id")
    return f.groupBy("session_id").agg(F.count_if(landmarks.continuity_eligible(F.expr("session_id % 4 <> 1"))).alias("eligible"), F.count("*").alias("frames"))


def p10_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    hz = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 > 0, F.col("value"))
    return rounded(e.select("event_id", records.level_fraction(F.col("value") / 5 - 70).alias("level"), records.pitch_fraction(hz).alias("pitch")))


def p22_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    z = F.transform("embedding", lambda x, i: F.when((i == 3) & (F.col("vec_id") % 3 == 0), F.lit(float("nan"))).when(F.col("vec_id") % 19 == 0, 1.0).otherwise(x.cast("double")))
    return rounded(e.select("vec_id", F.posexplode(records.depth_fractions(z)).alias("point", "depth")))


def p25_safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", records.safe_id(F.concat_ws(" / ", "c_name", "c_mktsegment", F.repeat(F.lit("é#x."), F.col("c_custkey").cast("int") % 60))).alias("safe_id"))


def p26_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    o = voice.voice_outcomes(frames, voice_sessions(frames))
    names = {"eligibleDurationMs": "eligible_ms", "segmentCount": "segments", "activeSpeechDurationMs": "active_ms", "pitchedDurationMs": "pitched_ms", "pauseCount": "pauses", "speechRunCount": "speech_runs", "nucleusCount": "nuclei"}
    facts = records.present_facts({k: F.col(v) for k, v in names.items()} | {"pitchCoverage": F.when(F.col("active_ms") > 0, F.col("pitched_ms") / F.col("active_ms"))})
    return rounded(o.select("session_id", "ordinal", F.explode(facts).alias("fact", "value")))


def p27_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = voice_frames(spark, sf_dir).groupBy("session_id").agg(F.collect_set(F.when(F.expr("session_id % 6 <> 2"), F.col("processor_ref"))).alias("processors"), F.collect_set("track_segment_id").alias("tracks"))
    voice_ = F.lit("voice")
    return refs.select("session_id", records.primary(F.col("processors"), voice_, F.lit("voice-processor-unavailable")).alias("processor"), records.primary(F.col("tracks"), voice_, F.lit("voice-track-unavailable")).alias("track"))


def p30_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = records.observed(face_frames(spark, sf_dir), F.lit(5000.0), F.expr("session_id % 3"))
    return f.groupBy("session_id", "track_segment_id").agg(F.max("t_ms").alias("last_ms"), F.count_if(F.col("t_ms") == 0).alias("at_origin"), F.count_if(F.array_contains("quality_reasons", "multiple-faces")).alias("several"))


def r09_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons in the record where every fourth session has no microphone and one reason is not registered."""
    frames = voice_frames(spark, sf_dir)
    o = voice.voice_outcomes(frames, voice_sessions(frames))
    known = F.array(*map(F.lit, ("quality-threshold-failed", "no-usable-signal", "insufficient-segments", "insufficient-duration", "insufficient-active-speech", "insufficient-events", "insufficient-nuclei")))
    return o.select("session_id", "code", records.contract_reason(F.expr("session_id % 4 <> 1"), F.col("status"), F.col("reason"), known).alias("contract_reason"))


def r14_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition errors after units, sections and reasons of some sessions were changed."""
    frames = voice_frames(spark, sf_dir)
    r = report.registry(spark)
    o = voice.voice_outcomes(frames, voice_sessions(frames)).join(F.broadcast(r.select("code", "section", "modality")), "code")
    s = F.col("session_id")
    o = o.withColumn("unit", F.when(s % 3 == 1, "furlongs").otherwise(F.col("unit"))).withColumn("section", F.when(s % 5 == 2, F.lit(None).cast("string")).otherwise(F.col("section")))
    reasons = F.array(*map(F.lit, ("quality-threshold-failed", "insufficient-pitched-speech")))
    return records.definition_errors(o, r.withColumn("reasons", reasons), ["session_id"])


def r20_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    types, stages = [*records.STAGES, "unknown.type"], ["requesting-permission", "calibrating", "observing", "finalizing", "report", "discarded", "error"]
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return records.stage_errors(e.select("event_id", pick(types, F.col("event_id")).alias("type"), pick(stages, F.expr("event_id div 3")).alias("stage")))


def a35_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.when(F.col("event_id") % 10 > 0, F.col("value") > 50).alias("eligible"))
    return records.window_counts(e, ["user_id"])


def x11_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of consecutive orders, some without a version; and the processor reference of each."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    ref = lambda pack, version: F.struct(pack.alias("pack_id"), version.alias("version"), F.sha2(pack, 256).alias("content_sha256"))
    a, b = ref(F.col("o_orderstatus"), F.when(k % 4 > 0, "1")), ref(F.when(k % 5 == 0, "F").otherwise(F.col("o_orderstatus")), F.when(k % 8 > 0, "1"))
    pipeline = records.pipeline_ref(F.lit("landmarker"), F.col("o_orderpriority"), F.sha2(k.cast("string"), 256), F.lit("v1"), F.when(k % 2 == 0, "GPU").otherwise("CPU"))
    return o.select("o_orderkey", a.alias("a"), b.alias("b"), pipeline.alias("processor_ref")).select("o_orderkey", records.same_protocol("a", "b").alias("same"), "processor_ref")


QUERIES = {
    "p13_coordinates": p13_coordinates, "p15_apertures": p15_apertures, "p18_movement_speed": p18_movement, "f11_continuity": f11_continuity, "p10_gauges": p10_gauges, "p22_depth_fractions": p22_depths,
    "p25_safe_ids": p25_safe_ids, "p26_quality_facts": p26_facts, "p27_primary_refs": p27_primary, "p30_observed_frames": p30_observed, "r09_contract_reasons": r09_reasons, "r14_definition_errors": r14_definitions,
    "r20_stage_errors": r20_stages, "a35_window_counts": a35_windows, "x11_same_protocol": x11_protocols,
}

#: The points that are looked at, and with them the coordinates of the face.
POINTS = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
o AS (SELECT *, i = [263, 385, 291, 13, 70, 33, 158][vec_id % 7 + 1] AS odd
      FROM e, (SELECT unnest([362, 263, 385, 380, 387, 373, 33, 133, 160, 144, 158, 153, 291, 61, 13, 14, 70, 300]) AS i) k WHERE vec_id % 17 <> 0 OR i < 300),
u AS (SELECT vec_id, label, i, CASE WHEN odd AND (vec_id % 13 = 5 OR vec_id % 23 = 7 OR vec_id % 29 = 3) THEN NULL WHEN odd AND vec_id % 31 = 9 THEN 1 ELSE v[(2 * i) % 64 + 1] * 0.3 + 0.5 + i / 2000.0::DOUBLE END AS x,
             CASE WHEN odd AND vec_id % 19 = 4 THEN NULL WHEN odd AND vec_id % 37 = 2 THEN 0 ELSE v[(2 * i + 1) % 64 + 1] * 0.3 + 0.5 + i / 2000.0::DOUBLE END AS y FROM o),
p AS (SELECT vec_id, label, i, x * 640 AS x, y * 480 AS y FROM u WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1),
w AS (SELECT vec_id, label, map_from_entries(list(struct_pack(k := i, v := struct_pack(x := x, y := y)))) AS m FROM p GROUP BY ALL),
g AS (SELECT *, m[362] AS la, m[263] AS lb, m[33] AS ra, m[133] AS rb FROM w),
c AS (SELECT *, (la.x + lb.x) / 2 AS lx, (la.y + lb.y) / 2 AS ly, (ra.x + rb.x) / 2 AS rx, (ra.y + rb.y) / 2 AS ry FROM g),
s AS (SELECT *, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS scale, atan2(ly - ry, lx - rx) AS angle FROM c)"""
NORMAL = "(cos(angle) * ({p}.x - cx) + sin(angle) * ({p}.y - cy)) / scale", "(cos(angle) * ({p}.y - cy) - sin(angle) * ({p}.x - cx)) / scale"
_D = "sqrt((m[{a}].x - m[{b}].x) ** 2 + (m[{a}].y - m[{b}].y) ** 2)"
_d = lambda a, b: _D.format(a=a, b=b)
_n = lambda i, k: f"round({NORMAL[k].format(p=f'm[{i}]')}, 6)"
#: Apertures and corners of a face.
SHAPES = {
    "eye_l": f"({_d(385, 380)} + {_d(387, 373)}) / 2 / {_d(362, 263)}", "eye_r": f"({_d(160, 144)} + {_d(158, 153)}) / 2 / {_d(33, 133)}", "mouth_gap": f"{_d(13, 14)} / {_d(291, 61)}",
    "left_x": NORMAL[0].format(p="m[291]"), "right_x": NORMAL[0].format(p="m[61]"),
}

ORACLES = {
    "p13_coordinates": POINTS + f"""
        SELECT vec_id, round(cx, 6) AS centre_x, round(cy, 6) AS centre_y, round(scale, 6) AS scale, round(angle, 6) AS angle, {_n(291, 0)} AS left_x, {_n(291, 1)} AS left_y, {_n(61, 0)} AS right_x, {_n(61, 1)} AS right_y FROM s""",
    "p15_apertures": POINTS + f"""
        SELECT vec_id, round(({_d(385, 380)} + {_d(387, 373)}) / 2 / {_d(362, 263)}, 6) AS eye_left, round(({_d(160, 144)} + {_d(158, 153)}) / 2 / {_d(33, 133)}, 6) AS eye_right,
               round({_d(13, 14)} / {_d(291, 61)}, 6) AS mouth_aperture FROM s""",
    "p18_movement_speed": POINTS + f""",
        q AS (SELECT vec_id, label, unnest([33, 133, 362, 263, 61, 291, 13, 14, 70, 300]) AS i, m, cx, cy, scale, angle FROM s),
        z AS (SELECT vec_id, label, i, {NORMAL[0].format(p='m[i]')} AS x, {NORMAL[1].format(p='m[i]')} AS y FROM q),
        b AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM e),
        r AS (SELECT vec_id, count(x) AS n FROM z GROUP BY ALL),
        d AS (SELECT z.vec_id, avg(sqrt((z.x - o.x) ** 2 + (z.y - o.y) ** 2)) / ((z.vec_id - before) * 40 / 1000.0::DOUBLE) AS speed, count(*) FILTER (z.x IS NOT NULL AND o.x IS NOT NULL) AS n
              FROM z JOIN b USING (vec_id) JOIN z o ON o.vec_id = before AND o.i = z.i WHERE before % 7 <> 3 GROUP BY z.vec_id, before)
        SELECT r.vec_id, CASE WHEN r.n = 10 THEN 10 ELSE 0 END AS points, round(CASE WHEN d.n = 10 THEN speed END, 6) AS movement_speed FROM r LEFT JOIN d USING (vec_id)""",
    "f11_continuity": "WITH " + sql.FACE + """
        SELECT session_id, count(*) FILTER (NOT nocam AND abs(yaw) <= 7 AND abs(pitch) <= 10 AND abs(roll) <= 5 AND (rgap IS NULL OR rgap <= 200)
                 AND (session_id % 4 = 1 OR (abs(wpx / 384 - 1) <= 0.2 AND abs(hpx / 360 - 1) <= 0.2))) AS eligible, count(*) AS frames FROM face GROUP BY ALL""",
    "p10_gauges": """
        SELECT event_id, round(greatest(0, least(1, (value / 5 - 70 + 60) / 60)), 6) AS level,
               round(CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0 ELSE greatest(0, least(1, (value - 60) / 340)) END, 6) AS pitch FROM events""",
    "p22_depth_fractions": """
        WITH z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS z, unnest(range(len(embedding)))::INT AS point FROM embeddings),
        y AS (SELECT vec_id, point, CASE WHEN point = 3 AND vec_id % 3 = 0 THEN NULL WHEN vec_id % 19 = 0 THEN 1 ELSE z END AS z FROM z),
        x AS (SELECT *, min(z) OVER v AS low, max(z) OVER v AS high FROM y WINDOW v AS (PARTITION BY vec_id))
        SELECT vec_id, point, round(CASE WHEN z IS NULL OR high - low <= 1e-9 THEN 0.5 ELSE 1 - (z - low) / (high - low) END, 6) AS depth FROM x""",
    "p25_safe_ids": """
        SELECT c_custkey, substring(regexp_replace(c_name || ' / ' || c_mktsegment || ' / ' || repeat('é#x.', (c_custkey % 60)::INT), '[^A-Za-z0-9._:-]', '-', 'g'), 1, 150) AS safe_id FROM customer""",
    "p26_quality_facts": "WITH o AS (" + sql.VOICE_METRICS + """),
        f AS (SELECT session_id, ordinal, unnest(['eligibleDurationMs', 'segmentCount', 'activeSpeechDurationMs', 'pitchedDurationMs', 'pauseCount', 'speechRunCount', 'nucleusCount', 'pitchCoverage']) AS fact,
                     unnest([eligible_ms, segments, active_ms, pitched_ms, pauses, speech_runs, nuclei, CASE WHEN active_ms > 0 THEN pitched_ms / active_ms END]::DOUBLE[]) AS value FROM o)
        SELECT session_id, ordinal, fact, round(value, 6) AS value FROM f WHERE value IS NOT NULL""",
    "p27_primary_refs": """
        WITH f AS (SELECT event_id // 1000 AS session_id, CASE WHEN event_id // 1000 % 11 = 7 AND event_id % 1000 >= 400 THEN 'proc-b' ELSE 'proc-a' END AS p,
                          CASE WHEN event_id // 1000 % 7 = 5 AND event_id % 1000 >= 500 THEN 'mic-2' ELSE 'mic-1' END AS t FROM events)
        SELECT session_id, CASE WHEN session_id % 6 = 2 THEN 'voice-processor-unavailable' WHEN count(DISTINCT p) = 1 THEN min(p) ELSE 'voice-mixed-provenance' END AS processor,
               CASE WHEN count(DISTINCT t) = 1 THEN min(t) ELSE 'voice-mixed-provenance' END AS track FROM f GROUP BY session_id""",
    "p30_observed_frames": "WITH " + sql.FACE + """
        SELECT session_id, 'face-' || (session_id % 3) AS track_segment_id, max(greatest(t_ms - 5000, 0)) AS last_ms, count(*) FILTER (t_ms <= 5000) AS at_origin, count(*) FILTER (faces > 1) AS several FROM face GROUP BY ALL""",
    "r09_contract_reasons": "WITH o AS (" + sql.VOICE_METRICS + """)
        SELECT session_id, code, CASE WHEN session_id % 4 = 1 THEN 'modality-unavailable' WHEN status = 'measured' THEN 'quality-threshold-failed'
               WHEN reason IN ('insufficient-pitched-speech', 'insufficient-pitch-bins') THEN 'unregistered' ELSE reason END AS contract_reason FROM o""",
    "r14_definition_errors": "WITH o AS (" + sql.VOICE_METRICS + """)
        SELECT session_id, code, 'unit' AS error FROM o WHERE session_id % 3 = 1
        UNION ALL SELECT session_id, code, 'report section' FROM o WHERE session_id % 5 = 2
        UNION ALL SELECT session_id, code, 'withheld reason' FROM o WHERE status = 'withheld' AND reason NOT IN ('quality-threshold-failed', 'insufficient-pitched-speech')""",
    "r20_stage_errors": """
        WITH t AS (SELECT event_id, ['consent.recorded', 'capture.permission.requested', 'capture.calibration.started', 'capture.lane.ready', 'capture.started', 'capture.quality.changed', 'measurement.recorded',
                     'measurement.withheld', 'capture.finalizing', 'capture.discarded', 'observation.created', 'report.created', 'capture.error', 'unknown.type'][event_id % 14 + 1] AS type,
                     ['requesting-permission', 'calibrating', 'observing', 'finalizing', 'report', 'discarded', 'error'][event_id // 3 % 7 + 1] AS stage FROM events)
        SELECT * FROM t WHERE NOT (CASE WHEN type IN ('consent.recorded', 'capture.permission.requested') THEN stage = 'requesting-permission' WHEN type IN ('capture.calibration.started', 'capture.lane.ready') THEN stage = 'calibrating'
          WHEN type IN ('capture.started', 'capture.quality.changed') THEN stage = 'observing' WHEN type LIKE 'measurement.%' THEN stage IN ('observing', 'finalizing') WHEN type IN ('capture.finalizing', 'observation.created') THEN stage = 'finalizing'
          WHEN type = 'capture.discarded' THEN stage = 'discarded' WHEN type = 'report.created' THEN stage = 'report' WHEN type = 'capture.error' THEN stage = 'error' ELSE false END)""",
    "a35_window_counts": """
        SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 10 > 0 AND value > 50) AS eligible, count(*) FILTER (NOT (event_id % 10 > 0 AND coalesce(value > 50, false))) AS withheld FROM events GROUP BY ALL""",
    "x11_same_protocol": """
        SELECT o_orderkey, (o_orderkey % 5 <> 0 OR o_orderstatus = 'F') AND (CASE WHEN o_orderkey % 4 > 0 THEN '1' END) IS NOT DISTINCT FROM (CASE WHEN o_orderkey % 8 > 0 THEN '1' END) AS same,
               'landmarker:' || o_orderpriority || ':' || substring(sha256(o_orderkey::VARCHAR), 1, 12) || ':v1:' || CASE WHEN o_orderkey % 2 = 0 THEN 'gpu' ELSE 'cpu' END AS processor_ref FROM orders""",
}
