"""Queries of operators that carry state, of composed face frames, and of gates and registries that every rule of theirs meets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions import gates
from framewright.operators import landmarks, loop, report
from framewright.plans import oracle_sql as sql
from framewright.plans import record_queries, report_queries
from framewright.plans.voice_queries import rounded
from framewright.sources.surrogates import face_frames, voice_frames


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as blocks of 20 ms at 3200 Hz: every 17th is lost, every 23rd is 90 ms late."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("session_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("vec_id")).cast("long")
    e = e.withColumn("seq", n).filter("seq % 17 <> 0")
    return e.select(
        "session_id", F.lit(1).cast("long").alias("capture_epoch"), "seq", F.col("seq").alias("arrival"), (F.col("seq") * 64).alias("absolute_sample_index"),
        (F.col("seq") * 20 + F.when(F.col("seq") % 23 == 5, 90).otherwise(0)).cast("double").alias("acquired_at_ms"), F.lit(3200.0).alias("sample_rate_hz"), "samples")


def t02_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the voice loop: where its windows lie, their level, and the gap of their block."""
    f = loop.over_sessions(_blocks(spark, sf_dir), ["session_id", "capture_epoch"], ["arrival"], loop.voice_features(), loop.VOICE)
    return rounded(f.select("session_id", "seq", "t_ms", "acquired_at_ms", "absolute_sample_index", "rms", "dc_offset", "block_gap_ms"))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice_frames(spark, sf_dir).select("session_id", "seq", "t_ms", "speech_active", (F.col("rms") / 4).alias("rms"), (F.col("seq") % 7 / 90).alias("spectral_flux"))


def t02_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop.over_sessions(_analysed(spark, sf_dir), ["session_id"], ["seq"], loop.find_onsets, loop.ONSETS).withColumn("score", F.round("score", 9))


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that come 5 or 40 places late, with a second epoch from frame 500 on and some times that are 400 ms back."""
    seq = F.col("seq")
    late = F.when(seq % 29 == 3, 40).when(seq % 7 == 0, 5).otherwise(0)
    return voice_frames(spark, sf_dir).select(
        "session_id", F.when(seq >= 500, 2).otherwise(1).cast("long").alias("capture_epoch"), "seq", (F.col("t_ms") - F.when(seq % 31 == 4, 400).otherwise(0)).alias("t_ms"), (seq + late + seq / 10000).alias("arrival"))


def t14_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames are kept, and how many left out for which reason."""
    judged = loop.over_sessions(_arriving(spark, sf_dir), ["session_id"], ["arrival"], loop.judge_arrival, loop.ARRIVED)
    return judged.groupBy("session_id", "capture_epoch", "verdict").agg(F.count("*").alias("frames"), F.sum("seq").alias("sequences"))


def p20_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames of the landmark results, with what image and pace say, and the movement since the last usable frame."""
    k = F.col("vec_id")
    still = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    pick = lambda rest, odd, usual: F.when(k % rest[0] == rest[1], F.lit(odd)).otherwise(F.lit(usual))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    d = record_queries.faces(spark, sf_dir).join(e, "vec_id").select(
        "vec_id", "label", "acquired_at_ms", "points", F.when(k % 6 == 0, F.slice("v", 1, 16)).otherwise(still).alias("matrix"), pick((41, 0), 0.05, 0.5).alias("illumination_mean"), F.lit(0.01).alias("dark_clipping"), F.lit(0.01).alias("bright_clipping"),
        pick((43, 1), 0.0001, 0.01).alias("sharpness"), pick((47, 2), float("nan"), 25.0).alias("frame_rate"), pick((53, 3), 250.0, 40.0).alias("inter_result_gap_ms"), pick((59, 4), 0.3, 0.1).alias("skipped_fraction"))
    f = landmarks.movement_speed(landmarks.composed(d, "points", "matrix", record_queries.WIDTH, record_queries.HEIGHT), ["label"], "vec_id", F.col("usable"))
    return rounded(f.select("vec_id", "face_visible", "box_width_px", "edge_margin", "yaw_deg", "eye_left", "mouth_right_x", "mouth_aperture", "movement_speed", F.array_join("quality_reasons", ",").alias("reasons")))


def _each(column: str, by: Column, changes: dict[int, object]) -> Column:
    """The column, with other values where ``by`` has a number."""
    return reduce(lambda rest, n: F.when(by == n, F.lit(changes[n]).cast("double")).otherwise(rest), changes, F.col(column))


def f06_reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by their list of reasons: in every 41 frames each limit is crossed once or more, also by NaN, infinity and null."""
    m, nan, inf = F.col("seq") % 41, float("nan"), float("inf")
    changes = {
        "box_width_px": {4: 100}, "box_width": {5: 0.8}, "edge_margin": {6: 0.01, 26: None}, "yaw_deg": {7: 20, 17: None}, "pitch_deg": {8: nan}, "illumination_mean": {9: 0.05, 25: 0.95}, "dark_clipping": {10: 0.3}, "bright_clipping": {11: nan},
        "sharpness": {12: nan}, "frame_rate": {13: 10, 18: inf}, "inter_result_gap_ms": {14: 250, 22: nan}, "skipped_fraction": {15: 0.3, 16: nan}, "box_height": {19: 0.95}, "box_height_px": {20: nan}, "roll_deg": {21: -11}, "mouth_left_x": {23: None}}
    f = face_frames(spark, sf_dir)
    given = F.coalesce(*(F.when(m == n, F.array(F.lit(r))) for n, r in ((1, "document-hidden"), (2, "worker-unavailable"), (24, "of-no-policy"))), F.col("quality_reasons"))
    f = f.withColumns({c: _each(c, m, v) for c, v in changes.items()} | {"face_visible": m != 3, "quality_reasons": given})
    counted = f.groupBy("session_id", "quality_reasons", gates.visual_mask().alias("mask")).agg(F.count("*").alias("n"))
    return counted.groupBy("session_id", F.array_join(gates.reasons_of(F.col("mask")), ",").alias("reasons")).agg(F.sum("n").alias("frames"))


def f04_reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice frames by their list of reasons and what it leaves usable: each limit is crossed, and NaN crosses none."""
    m, nan = F.col("seq") % 29, float("nan")
    changes = {"block_gap_ms": {1: 41, 5: nan}, "lost_block_fraction": {2: 0.06}, "sample_rate_hz": {3: 22050, 10: nan}, "dc_offset": {4: -0.03, 11: nan}, "rms": {6: nan, 13: 0.002}, "snr_db": {7: nan}, "clipped_sample_fraction": {12: nan}}
    f = voice_frames(spark, sf_dir)
    given = F.coalesce(*(F.when(m == n, F.array(F.lit(r))) for n, r in ((8, "microphone-unavailable"), (9, "voice-worker-unavailable"), (14, "audio-worklet-unavailable"))), F.col("quality_reasons"))
    reasons = F.col("reasons")
    f = f.withColumns({c: _each(c, m, v) for c, v in changes.items()} | {"quality_reasons": given}).withColumn("reasons", gates.voice_reasons(F.col("echo_cancellation")))
    free = {"timing": gates.TIMING_BLOCKERS, "general": gates.GENERAL_BLOCKERS, "fine": gates.FINE_BLOCKERS}
    return f.groupBy("session_id", F.array_join(reasons, ",").alias("reasons"), *(gates.free_of(reasons, b).alias(c) for c, b in free.items())).agg(F.count("*").alias("frames"))


def j03_every_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry violations of all four kinds: metrics taken out, renamed, repeated, and measured without a number or with a score over 1."""
    o, k, r = report_queries.outcomes(spark, sf_dir), F.col("session_id"), F.col("registry_order")
    o = o.filter(~((k % 3 == 1) & r.isin(2, 4))).withColumns({
        "code": F.when((k % 5 == 2) & (r == 0), "some.other.metric").otherwise(F.col("code")), "value": F.when((k % 3 == 0) & (r == 1), float("nan")).otherwise(F.col("value")), "quality_score": F.when((k % 7 == 2) & (r == 8), 1.5).otherwise(F.col("quality_score"))})
    return report.incomplete(o.unionByName(o.filter((k % 4 == 1) & (r >= 14))), spark)


QUERIES = {
    "t02_windows": t02_windows, "t02_onsets": t02_onsets, "t14_arrivals": t14_arrivals, "p20_composed_frames": p20_composed, "f06_reason_lists": f06_reason_lists, "f04_reason_lists": f04_reason_lists, "j03_every_violation": j03_every_violation,
}

_F = record_queries.POINTS.replace("(SELECT unnest([362, 263, 385, 380, 387, 373, 33, 133, 160, 144, 158, 153, 291, 61, 13, 14, 70, 300]) AS i) k", "(SELECT unnest(range(478)) AS i) k")
_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
ORACLES = {
    "t02_windows": f"""
        WITH e AS (SELECT label::BIGINT AS session_id, {_VEC} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
        b AS (SELECT *, n * 64 AS idx, (n * 20 + CASE WHEN n % 23 = 5 THEN 90 ELSE 0 END)::DOUBLE AS tt FROM e WHERE n % 17 <> 0),
        g AS (SELECT *, coalesce(n - lag(n) OVER w > 1, true) AS lost, coalesce(greatest(0, tt - lag(tt) OVER w - 20), 0) AS gap FROM b WINDOW w AS (PARTITION BY session_id ORDER BY n)),
        r AS (SELECT *, sum(CASE WHEN lost OR gap > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY n) AS run FROM g),
        j AS (SELECT *, row_number() OVER w - 1 AS j, min(idx) OVER (PARTITION BY session_id, run) AS s0, list_concat(list_concat(coalesce(lag(v, 2) OVER w, []), coalesce(lag(v) OVER w, [])), v) AS sound FROM r WINDOW w AS (PARTITION BY session_id, run ORDER BY n)),
        k AS (SELECT *, unnest(range(greatest(0, ((64 * j - 128) // 32 + 1)::BIGINT), ((64 * (j + 1) - 128) // 32 + 1)::BIGINT)) AS k FROM j WHERE j > 0),
        x AS (SELECT session_id, s0 + 32 * k AS first, tt - (64 * (j + 1) - 128 - 32 * k) / 3200 * 1000 AS got, gap, sound[len(sound) - (64 * (j + 1) - 128 - 32 * k) - 127 : len(sound) - (64 * (j + 1) - 128 - 32 * k)] AS w FROM k)
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first) AS seq, round(first / 3200 * 1000, 6) AS t_ms, round(got, 6) AS acquired_at_ms, first AS absolute_sample_index,
               round(sqrt(list_avg(list_transform(w, lambda y: (y - list_avg(w)) ** 2))), 6) AS rms, round(list_avg(w), 6) AS dc_offset, gap AS block_gap_ms FROM x""",
    "t02_onsets": "WITH RECURSIVE " + sql.VOICE + """,
        f AS (SELECT session_id, seq, t_ms, speech_active, rms / 4 * (1 + least(2, seq % 7 / 90 * 20)) AS score FROM voice),
        l AS (SELECT session_id, seq, t_ms, score, speech_active AND score > 0.012 AS nucleus, 0.3 * score AS smooth, CASE WHEN speech_active AND score > 0.012 THEN t_ms ELSE -1e9 END AS last FROM f WHERE seq = 0
              UNION ALL SELECT f.session_id, f.seq, f.t_ms, f.score, f.speech_active AND f.t_ms - last >= 100 AND f.score > greatest(0.012, smooth * 1.15), 0.7 * smooth + 0.3 * f.score,
                     CASE WHEN f.speech_active AND f.t_ms - last >= 100 AND f.score > greatest(0.012, smooth * 1.15) THEN f.t_ms ELSE last END FROM l JOIN f ON f.session_id = l.session_id AND f.seq = l.seq + 1)
        SELECT session_id, seq, t_ms, round(score, 9) AS score, nucleus FROM l""",
    "t14_arrivals": """
        WITH x AS (SELECT event_id // 1000 AS session_id, event_id % 1000 AS seq, CASE WHEN event_id % 1000 >= 500 THEN 2 ELSE 1 END AS epoch, event_id % 1000 * 40 - CASE WHEN event_id % 1000 % 31 = 4 THEN 400 ELSE 0 END AS t,
                     event_id % 1000 + CASE WHEN event_id % 1000 % 29 = 3 THEN 40 WHEN event_id % 1000 % 7 = 0 THEN 5 ELSE 0 END + event_id % 1000 / 10000 AS a FROM events),
        y AS (SELECT *, coalesce(epoch < max(epoch) OVER (PARTITION BY session_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM x),
        z AS (SELECT *, max(seq) OVER w AS s, max(t) OVER w AS m FROM y WINDOW w AS (PARTITION BY session_id, epoch, stale ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT *, CASE WHEN stale THEN 'stale-epoch' WHEN seq <= s THEN 'sequence' WHEN t <= m THEN 'time' ELSE 'kept' END AS verdict FROM z)
        SELECT session_id, epoch::BIGINT AS capture_epoch, verdict, count(*) AS frames, sum(seq)::BIGINT AS sequences FROM v GROUP BY ALL""",
    "p20_composed_frames": record_queries.POINTS + ", every AS (" + _F + """ SELECT * FROM u),
        b AS (SELECT vec_id, bool_and(coalesce(x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1, false)) AS ok, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM every GROUP BY ALL),
        h AS (SELECT s.*, e.v, b.ok, x0, x1, y0, y1, """ + ", ".join(f"{x} AS {n}" for n, x in record_queries.SHAPES.items()) + """ FROM s JOIN e USING (vec_id) JOIN b USING (vec_id)),
        q AS (SELECT *, sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2) AS a, sqrt(v[5] ** 2 + v[6] ** 2 + v[7] ** 2) AS b, sqrt(v[9] ** 2 + v[10] ** 2 + v[11] ** 2) AS c FROM h),
        pp AS (SELECT *, CASE WHEN vec_id % 6 = 0 THEN degrees(asin(greatest(-1, least(1, -v[3] / a)))) ELSE 0 END AS yaw, CASE WHEN vec_id % 6 = 0 THEN degrees(atan2(v[7] / b, v[11] / c)) ELSE 0 END AS pitch, CASE WHEN vec_id % 6 = 0 THEN degrees(atan2(v[2] / a, v[1] / a)) ELSE 0 END AS roll,
                     ok AND eye_l IS NOT NULL AND eye_r IS NOT NULL AS eyes, ok AND right_x IS NOT NULL AND left_x IS NOT NULL AS mouth FROM q),
        d AS (SELECT *, eyes AND mouth AS present, least(x0, y0, 1 - x1, 1 - y1) AS edge FROM pp),
        r AS (SELECT *, concat_ws(',', CASE WHEN NOT present THEN 'face-not-visible' END, CASE WHEN present AND ((x1 - x0) * 640 < 180 OR (y1 - y0) * 480 < 220) THEN 'face-too-small' END, CASE WHEN present AND (x1 - x0 > 0.7 OR y1 - y0 > 0.9) THEN 'face-too-large' END,
                CASE WHEN present AND edge < 0.02 THEN 'face-edge-margin' END, CASE WHEN present AND (abs(yaw) > 15 OR abs(pitch) > 15 OR abs(roll) > 10) THEN 'pose-out-of-range' END, CASE WHEN vec_id % 41 = 0 THEN 'illumination-out-of-range' END, CASE WHEN vec_id % 43 = 1 THEN 'blur' END,
                CASE WHEN vec_id % 47 = 2 THEN 'frame-rate-below-minimum' END, CASE WHEN vec_id % 53 = 3 THEN 'visual-frame-gap' END, CASE WHEN vec_id % 59 = 4 THEN 'too-many-skipped-frames' END) AS reasons FROM d),
        z AS (SELECT vec_id, label, ok, i, """ + record_queries.NORMAL[0].format(p="m[i]") + " AS x, " + record_queries.NORMAL[1].format(p="m[i]") + """ AS y FROM (SELECT *, unnest([33, 133, 362, 263, 61, 291, 13, 14, 70, 300]) AS i FROM r)),
        oo AS (SELECT vec_id, label, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before, lag(reasons = '') OVER (PARTITION BY label ORDER BY vec_id) AS good FROM r),
        y AS (SELECT oo.vec_id, avg(sqrt((n.x - l.x) ** 2 + (n.y - l.y) ** 2)) / (any_value(oo.vec_id - before) * 40 / 1000.0::DOUBLE) AS speed, count(*) FILTER (n.ok AND l.ok AND n.x IS NOT NULL AND l.x IS NOT NULL) AS k
              FROM oo JOIN z n USING (vec_id) JOIN z l ON l.vec_id = before AND l.i = n.i WHERE good GROUP BY oo.vec_id)
        SELECT r.vec_id, ok AS face_visible, round(CASE WHEN ok THEN (x1 - x0) * 640 END, 6) AS box_width_px, round(CASE WHEN ok THEN edge END, 6) AS edge_margin, round(CASE WHEN ok THEN yaw END, 6) AS yaw_deg, round(CASE WHEN eyes THEN eye_l END, 6) AS eye_left,
               round(CASE WHEN mouth THEN right_x END, 6) AS mouth_right_x, round(CASE WHEN ok THEN mouth_gap END, 6) AS mouth_aperture, round(CASE WHEN y.k = 10 THEN speed END, 6) AS movement_speed, reasons FROM r LEFT JOIN y USING (vec_id)""",
    "f06_reason_lists": "WITH " + sql.FACE + """,
        x AS (SELECT session_id, seq % 41 AS m, nocam, sharp FROM face),
        r AS (SELECT session_id, concat_ws(',', CASE WHEN m = 1 THEN 'document-hidden' END, CASE WHEN nocam AND m NOT IN (1, 2, 24) THEN 'camera-unavailable' END, CASE WHEN m = 2 THEN 'worker-unavailable' END, CASE WHEN m IN (3, 17, 23) THEN 'face-not-visible' END,
                CASE WHEN m IN (4, 20) THEN 'face-too-small' END, CASE WHEN m IN (5, 19) THEN 'face-too-large' END, CASE WHEN m IN (6, 26) THEN 'face-edge-margin' END, CASE WHEN m IN (7, 8, 21) THEN 'pose-out-of-range' END, CASE WHEN m IN (9, 10, 11, 25) THEN 'illumination-out-of-range' END,
                CASE WHEN m = 12 OR sharp < 0.0008 THEN 'blur' END, CASE WHEN m IN (13, 18) THEN 'frame-rate-below-minimum' END, CASE WHEN m IN (14, 22) THEN 'visual-frame-gap' END, CASE WHEN m IN (15, 16) THEN 'too-many-skipped-frames' END) AS reasons FROM x)
        SELECT session_id, reasons, count(*) AS frames FROM r GROUP BY ALL""",
    "f04_reason_lists": "WITH " + sql.VOICE + """,
        x AS (SELECT *, seq % 29 AS m FROM voice),
        y AS (SELECT *, CASE m WHEN 8 THEN 'microphone-unavailable' WHEN 9 THEN 'voice-worker-unavailable' WHEN 14 THEN 'audio-worklet-unavailable' ELSE CASE WHEN blocked THEN 'audio-frame-gap' WHEN noisy THEN 'noisy-room' END END AS given FROM x),
        z AS (SELECT *, m IN (1, 2) AS gap, m = 3 AS rate, m <> 7 AND snr < 15 AS low, m <> 6 AND (m = 13 OR rms < 0.003) AS quiet, m <> 12 AND clipped > 0.01 AS clip, m = 4 AS dc FROM y),
        r AS (SELECT session_id, concat_ws(',', given, CASE WHEN gap AND given IS DISTINCT FROM 'audio-frame-gap' THEN 'audio-frame-gap' END, CASE WHEN rate THEN 'sample-rate-below-minimum' END, CASE WHEN echo THEN 'audio-processing-enabled' END,
                CASE WHEN low THEN 'snr-below-minimum' END, CASE WHEN quiet THEN 'signal-too-quiet' END, CASE WHEN clip THEN 'audio-clipping' END, CASE WHEN dc THEN 'dc-offset' END) AS reasons,
                NOT (gap OR quiet OR clip OR coalesce(given <> 'noisy-room', false)) AS timing, low OR dc AS g, rate OR echo AS f FROM z)
        SELECT session_id, reasons, timing, timing AND NOT g AS general, timing AND NOT g AND NOT f AS fine, count(*) AS frames FROM r GROUP BY ALL""",
    "j03_every_violation": report_queries.BOTH + """,
        a AS (SELECT session_id, ordinal AS r, code, status FROM v UNION ALL SELECT session_id, r, code, status FROM f),
        m AS (SELECT DISTINCT code, r FROM a),
        o AS (SELECT session_id, r, CASE WHEN session_id % 5 = 2 AND r = 0 THEN 'some.other.metric' ELSE code END AS code, status FROM a WHERE NOT (session_id % 3 = 1 AND r IN (2, 4))),
        t AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE session_id % 4 = 1 AND r >= 14)
        SELECT s.session_id, m.code, 'missing' AS violation FROM (SELECT DISTINCT session_id FROM t) s CROSS JOIN m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = s.session_id AND t.code = m.code)
        UNION ALL SELECT DISTINCT session_id, code, 'unregistered' FROM t WHERE code = 'some.other.metric'
        UNION ALL SELECT session_id, code, 'repeated' FROM t GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT session_id, code, 'invalid-value' FROM t WHERE status = 'measured' AND (session_id % 3 = 0 AND r = 1 OR session_id % 7 = 2 AND r = 8)""",
}
