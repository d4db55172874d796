"""Queries over face frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.gates import reasons_of, visual_mask
from framewright.operators import face
from framewright.plans import oracle_sql as sql
from framewright.plans.voice_queries import rounded
from framewright.sources.surrogates import face_frames, face_sessions


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    return face.screened(frames, face_sessions(frames))


def r07_face_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight geometric metrics; ``t01_blink_rate`` has the ninth."""
    frames = face_frames(spark, sf_dir)
    return rounded(face.face_outcomes(frames, face_sessions(frames)).filter("ordinal < 8").drop("blinks"))


def t01_blink_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    return rounded(face.face_outcomes(frames, face_sessions(frames)).filter("ordinal = 8"))


def t01_blinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return face.blinks(_screened(spark, sf_dir))


def a26_bin_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(face.bin_values(_screened(spark, sf_dir)))


def a27_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(face.bins(_screened(spark, sf_dir)).select("session_id", "bin", "frames", "duration_ms", "span_ms", "size_ratio", "cadence_hz"))


def f06_visual_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames of a session have each reason."""
    f = face_frames(spark, sf_dir).groupBy("session_id", "quality_reasons", visual_mask().alias("mask")).agg(F.count("*").alias("n"))
    return f.select("session_id", "n", F.explode(reasons_of(F.col("mask"))).alias("reason")).groupBy("session_id", "reason").agg(F.sum("n").alias("frames"))


def p01_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = face_frames(spark, sf_dir).select(
        "session_id", "seq", face.mouth_width().alias("mouth_width"), face.corner_asymmetry().alias("corner_asymmetry"), face.eye_asymmetry().alias("eye_asymmetry"), face.size().alias("size"))
    return rounded(f)


def f07_usable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).groupBy("session_id").agg(F.count_if("usable").alias("usable"), F.count_if(~F.col("attributed")).alias("unattributed"), F.count("*").alias("frames"))


QUERIES = {
    "r07_face_outcomes": r07_face_outcomes,
    "t01_blink_rate": t01_blink_rate,
    "t01_blinks": t01_blinks,
    "a26_bin_values": a26_bin_values,
    "a27_bins": a27_bins,
    "f06_visual_reasons": f06_visual_reasons,
    "f07_usable_frames": f07_usable_frames,
    "p01_geometry": p01_geometry,
}

ORACLES = {
    "r07_face_outcomes": sql.FACE_METRICS,
    "a26_bin_values": "WITH " + sql.FACE_VALUES + " SELECT session_id, bin, k AS ordinal, round(v, 6) AS value FROM bin_values",
    "a27_bins": "WITH " + sql.FACE + """
        SELECT session_id, bin, n AS frames, round(dur, 6) AS duration_ms, span AS span_ms, round(p90 / p10, 6) AS size_ratio, round(n / (dur / 1000), 6) AS cadence_hz FROM bins""",
    "t01_blinks": sql.BLINKS,
    "t01_blink_rate": sql.BLINK_RATE,
    "f06_visual_reasons": "WITH " + sql.FACE + """,
        r AS (SELECT session_id, unnest(list_filter([CASE WHEN nocam THEN 'camera-unavailable' END, CASE WHEN sharp < 0.0008 THEN 'blur' END,
                     CASE WHEN seq % 400 = 399 AND 0.25 > 0.25 THEN 'too-many-skipped-frames' END], lambda x: x IS NOT NULL)) AS reason FROM face)
        SELECT session_id, reason, count(*) AS frames FROM r GROUP BY ALL""",
    "f07_usable_frames": "WITH " + sql.FACE + " SELECT session_id, count(*) FILTER (usable) AS usable, count(*) FILTER (faces <> 1) AS unattributed, count(*) AS frames FROM screened GROUP BY ALL",
    "p01_geometry": "WITH " + sql.FACE + """
        SELECT session_id, seq, round(sqrt((lx - rx) ** 2 + (ly - ry) ** 2), 6) AS mouth_width, round(sqrt((lx + rx) ** 2 + (ly - ry) ** 2), 6) AS corner_asymmetry,
               round(abs(el - er), 6) AS eye_asymmetry, round(sqrt(wpx * hpx), 6) AS size FROM face""",
}
