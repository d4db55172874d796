"""Queries over voice frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import voice
from framewright.plans import oracle_sql as sql
from framewright.sources.surrogates import voice_frames, voice_sessions


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, as the oracles have them."""
    names = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    return voice.segment_frames(frames, voice_sessions(frames))


def voice_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    return rounded(voice.voice_outcomes(frames, voice_sessions(frames)))


def w01_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = voice.segments(_framed(spark, sf_dir))
    return rounded(s.select("session_id", F.col("segment").alias("segment"), "frames", "duration_ms", "active_ms", "pitched_ms", "coverage", voice.window_ref().alias("window_ref")))


def w04_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = _framed(spark, sf_dir)
    return rounded(voice.runs(framed, voice.segments(framed)).select("session_id", "segment", "run", "active", "duration_ms", "pause"))


def a13_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_framed(spark, sf_dir).groupBy("session_id", "segment").agg(F.first("nominal").alias("nominal"), F.sum("weight").alias("weight"), F.count("*").alias("frames")))


QUERIES = {
    "r06_voice_outcomes": voice_outcomes,
    "w01_voice_segments": w01_segments,
    "w04_activity_runs": w04_runs,
    "a13_frame_weights": a13_weights,
}

ORACLES = {
    "r06_voice_outcomes": sql.VOICE_METRICS,
    "w01_voice_segments": "WITH " + sql.SEGMENTS + """
        SELECT session_id, seg::BIGINT AS segment, n AS frames, round(dur, 6) AS duration_ms, round(act, 6) AS active_ms, round(pit, 6) AS pitched_ms, round(cov, 6) AS coverage,
               'voice:1:' || track || ':' || t0::BIGINT || ':' || (t1 + nominal)::BIGINT AS window_ref
        FROM segs""",
    "w04_activity_runs": "WITH " + sql.RUNS + " SELECT session_id, seg::BIGINT AS segment, run::BIGINT AS run, active, round(dur, 6) AS duration_ms, pause FROM runs2",
    "a13_frame_weights": "WITH " + sql.SEGMENTS + " SELECT session_id, seg::BIGINT AS segment, any_value(nominal) AS nominal, round(sum(weight), 6) AS weight, count(*) AS frames FROM framed GROUP BY ALL",
}
