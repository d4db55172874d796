"""Queries over terminal outcomes: finalisation, lanes, evidence, windows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tables import settle
from framewright.operators import face, report, voice
from framewright.plans import oracle_sql as sql
from framewright.plans.voice_queries import rounded
from framewright.sources.surrogates import face_frames, face_sessions, voice_frames, voice_sessions


def _voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    return voice.voice_outcomes(frames, voice_sessions(frames))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    return settle(report.finalize(_voice(spark, sf_dir), face.face_outcomes(frames, face_sessions(frames))))


def r08_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes(spark, sf_dir))


def r18_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report(outcomes(spark, sf_dir), spark)


def r15_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of both modalities against tightened evidence: half of the eligible time is taken away first."""
    o = outcomes(spark, sf_dir)
    return rounded(report.evidence_errors(o.withColumn("eligible_ms", F.col("eligible_ms") / 2), spark))


def a34_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    return rounded(report.lanes(o).withColumn("reasons", F.array_join("reasons", ",")))


def j03_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry violations after two metrics were taken out of some sessions; sessions of one modality lack the other's."""
    o = outcomes(spark, sf_dir)
    return report.incomplete(o.filter("not (session_id % 3 = 1 and registry_order in (2, 4))"), spark)


def f18_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References built from events, good and bad, taken apart again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    i = F.col("event_id")
    ref = F.concat_ws(":", F.when(i % 5 == 0, "face").otherwise("voice"), (i % 3 - F.when(i % 11 == 0, 5).otherwise(0)).cast("string"), F.when(i % 7 == 0, "a:b").when(i % 13 == 0, "").otherwise("mic"), (i % 100).cast("string"), (i % 90 + 20).cast("string"))
    w = e.select("event_id", report.parse_window(ref, F.lit("voice"), F.lit(100.0)).alias("w"))
    return w.select("event_id", "w.*")


QUERIES = {"r08_finalize": r08_finalize, "r18_report": r18_report, "r15_evidence_errors": r15_evidence, "a34_lanes": a34_lanes, "j03_registry_violations": j03_incomplete, "f18_window_refs": f18_windows}

#: Both modalities; blinks without their count, which no check looks at (their frames' gaps are all 40 ms).
BOTH = "WITH v AS (" + sql.VOICE_METRICS + "), g AS (" + sql.FACE_METRICS + """),
    k AS (SELECT session_id, coalesce(reason, CASE WHEN exposure_ms < 60000 THEN 'insufficient-exposure' WHEN frames / (exposure_ms / 1000) < 24 THEN 'insufficient-frame-cadence' END) AS reason,
                 bins, exposure_ms, frames, quality_score FROM g WHERE ordinal = 0),
    f AS (SELECT session_id, 7 + ordinal AS r, code, status, quality_score, reason, bins, exposure_ms, frames FROM g
          UNION ALL SELECT session_id, 15, 'ambient.face.blink_rate.bilateral', CASE WHEN reason IS NULL THEN 'measured' ELSE 'withheld' END, CASE WHEN reason IS NULL THEN quality_score END, reason, bins, exposure_ms, frames FROM k)"""
ORACLES = {
    "r15_evidence_errors": BOTH + """,
        r AS (SELECT * FROM (VALUES (0, 'minimumSegments', 3), (0, 'minimumPitchedDurationMs', 10000), (0, 'minimumPitchCoverage', 0.6), (0, 'minimumF0Hz', 50), (0, 'maximumF0Hz', 700), (1, 'minimumSegments', 3),
          (1, 'minimumPitchedDurationMs', 10000), (1, 'minimumPitchCoverage', 0.6), (2, 'minimumSegments', 3), (2, 'minimumEligibleSpanMs', 30000), (2, 'minimumActiveSpeechMs', 15000), (3, 'minimumSegments', 3),
          (3, 'minimumEligibleSpanMs', 30000), (3, 'minimumActiveSpeechMs', 15000), (4, 'minimumSegments', 3), (4, 'minimumEligibleSpanMs', 30000), (4, 'minimumActiveSpeechMs', 15000), (4, 'minimumEventsForMedian', 5),
          (5, 'minimumSegments', 3), (5, 'minimumEligibleSpanMs', 30000), (5, 'minimumActiveSpeechMs', 15000), (5, 'minimumEventsForMedian', 5), (6, 'minimumSegments', 3), (6, 'minimumEligibleSpanMs', 30000),
          (6, 'minimumActiveSpeechMs', 15000), (6, 'minimumNuclei', 30), (15, 'minimumExposureMs', 60000), (15, 'minimumCadenceHz', 24)) t(k, requirement, threshold)
          UNION ALL SELECT unnest(range(7, 15)), 'minimumBins', 3 UNION ALL SELECT unnest(range(7, 15)), 'minimumObservationSpanMs', 30000),
        a AS (SELECT session_id, code, requirement, threshold::DOUBLE AS threshold, CASE requirement WHEN 'minimumSegments' THEN segments WHEN 'minimumPitchedDurationMs' THEN pitched_ms WHEN 'minimumPitchCoverage' THEN pitched_ms / active_ms
          WHEN 'minimumEligibleSpanMs' THEN eligible_ms / 2 WHEN 'minimumActiveSpeechMs' THEN active_ms WHEN 'minimumEventsForMedian' THEN greatest(pauses, speech_runs, nuclei) WHEN 'minimumNuclei' THEN greatest(pauses, speech_runs, nuclei)
          ELSE value END AS actual FROM v JOIN r ON k = ordinal WHERE status = 'measured'
          UNION ALL SELECT session_id, code, requirement, threshold::DOUBLE, CASE requirement WHEN 'minimumBins' THEN bins WHEN 'minimumCadenceHz' THEN frames / (exposure_ms / 2 / 1000) ELSE exposure_ms / 2 END
          FROM f JOIN r ON k = f.r WHERE status = 'measured')
        SELECT session_id, code, requirement, threshold, round(actual, 6) AS actual FROM a WHERE CASE WHEN requirement LIKE 'maximum%' THEN actual > threshold ELSE actual < threshold END""",
    "a34_lanes": BOTH + """,
        o AS (SELECT session_id, 'voice' AS modality, status, eligible_ms, quality_score, reason FROM v UNION ALL SELECT session_id, 'face', status, coalesce(exposure_ms, 0), quality_score, reason FROM f)
        SELECT session_id, modality, CASE WHEN count(*) FILTER (status = 'measured') > 0 THEN 'ready' ELSE 'withheld' END AS state, max(eligible_ms)::DOUBLE AS eligible_ms,
               round(avg(quality_score) FILTER (status = 'measured'), 6) AS quality_score, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ','), '') AS reasons FROM o GROUP BY ALL""",
    "j03_registry_violations": BOTH + """,
        o AS (SELECT session_id, ordinal AS r, code FROM v UNION ALL SELECT session_id, r, code FROM f)
        SELECT s.session_id, m.code, 'missing' AS violation FROM (SELECT DISTINCT session_id FROM o WHERE NOT (session_id % 3 = 1 AND r IN (2, 4))) s CROSS JOIN (SELECT DISTINCT code FROM o) m
        WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = s.session_id AND o.code = m.code AND NOT (o.session_id % 3 = 1 AND o.r IN (2, 4)))""",
    "f18_window_refs": """
        WITH x AS (SELECT event_id, event_id % 5 <> 0 AS voice, event_id % 3 - CASE WHEN event_id % 11 = 0 THEN 5 ELSE 0 END AS epoch, CASE WHEN event_id % 7 = 0 THEN 'a:b' WHEN event_id % 13 = 0 THEN '' ELSE 'mic' END AS track,
                          (event_id % 100)::DOUBLE AS s, (event_id % 90 + 20)::DOUBLE AS e FROM events),
        y AS (SELECT *, voice AND epoch >= 0 AND track <> '' AND e > s AND e <= 100 AS ok FROM x)
        SELECT event_id, CASE WHEN ok THEN epoch END AS capture_epoch, CASE WHEN ok THEN track END AS track_segment_id, CASE WHEN ok THEN s END AS start_ms, CASE WHEN ok THEN e END AS end_ms FROM y""",
}
ORACLES["r08_finalize"] = "WITH v AS (" + sql.VOICE_METRICS + "), x AS (" + sql.FACE_METRICS + "), y AS (" + sql.BLINK_RATE + """)
    SELECT session_id, ordinal::INT AS registry_order, code, 'voice' AS modality, status, value, quality_score, dispersion, reason, segments::DOUBLE AS segments, NULL::DOUBLE AS bins, eligible_ms::DOUBLE AS eligible_ms, active_ms::DOUBLE AS active_ms,
           pitched_ms::DOUBLE AS pitched_ms, greatest(pauses, speech_runs, nuclei)::DOUBLE AS events, NULL::DOUBLE AS frames FROM v
    UNION ALL SELECT session_id, (7 + ordinal)::INT, code, 'face', status, value, quality_score, dispersion, reason, NULL, bins::DOUBLE, exposure_ms::DOUBLE, NULL, NULL, NULL, frames::DOUBLE FROM (SELECT * FROM x UNION ALL BY NAME SELECT * EXCLUDE (blinks) FROM y)"""
ORACLES["r18_report"] = BOTH + ", bad AS (" + ORACLES["r15_evidence_errors"].replace("eligible_ms / 2", "eligible_ms").replace("exposure_ms / 2", "exposure_ms") + """),
    o AS (SELECT session_id, ordinal AS r, code, status, reason FROM v UNION ALL SELECT session_id, r, code, status, reason FROM f),
    p AS (SELECT *, ['pitch', 'pitch', 'speech-timing', 'speech-timing', 'speech-timing', 'speech-timing', 'speech-timing', 'eye-geometry', 'eye-geometry', 'symmetry', 'mouth-geometry', 'mouth-geometry', 'mouth-geometry', 'symmetry', 'movement',
                  'blink-behavior'][r + 1] AS section FROM o WHERE session_id NOT IN (SELECT session_id FROM bad)),
    s AS (SELECT DISTINCT session_id FROM p), n AS (SELECT unnest(range(8))::INT AS position, unnest(['capture-quality', 'pitch', 'speech-timing', 'eye-geometry', 'mouth-geometry', 'symmetry', 'movement', 'blink-behavior']) AS section),
    l AS (SELECT session_id, section, string_agg(code || '=' || coalesce(reason, status), ';' ORDER BY r) AS entries FROM p GROUP BY ALL)
    SELECT s.session_id, n.position, n.section, coalesce(entries, '') AS entries FROM s CROSS JOIN n LEFT JOIN l ON l.session_id = s.session_id AND l.section = n.section"""
