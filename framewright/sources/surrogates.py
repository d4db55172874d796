"""Sensor frames computed from the driver's tables by integer arithmetic, and the dimensions that go with them.

Column names are those of real frames, so every operator takes either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOICE_PER_SESSION, ORDERS_PER_SESSION, STEP_MS = 1000, 375, 40


def voice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One voice frame per event: 40 s sessions of 1000 frames, with gaps, clipping, noise and changes of track."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    session, seq = F.expr("event_id div 1000"), F.col("event_id") % VOICE_PER_SESSION
    e = e.select("event_id", "value", session.alias("session_id"), seq.alias("seq"))
    t = F.col("seq") * STEP_MS
    active = t % 2500 < 2000
    pick = lambda cond, yes, no: F.when(F.expr(cond), F.lit(yes)).otherwise(F.lit(no))
    return e.select(
        "session_id", "seq", t.cast("double").alias("t_ms"), F.lit(1).cast("long").alias("capture_epoch"), F.lit("ambient").alias("task_context"),
        active.alias("speech_active"), (F.col("event_id") % 17 != 0).alias("periodic"),
        pick("session_id % 7 = 5 and seq >= 500", "mic-2", "mic-1").alias("track_segment_id"),
        pick("session_id % 11 = 7 and seq >= 400", "proc-b", "proc-a").alias("processor_ref"),
        (F.col("value") / 5000).alias("rms"),
        F.when(F.expr("event_id % 17 != 0"), 140 + F.col("value") / 100).alias("f0_hz"),
        pick("event_id % 23 = 0", 0.5, 0.9).alias("f0_confidence"), F.lit(0.95).alias("estimator_agreement"),
        (active & (t % 480 == 0)).alias("syllabic_nucleus"),
        F.when(F.col("value") > 420, 0.02).otherwise(F.col("value") / 100000).alias("clipped_sample_fraction"),
        F.lit(0.001).alias("dc_offset"), F.when(active, (20 + F.col("event_id") % 9).cast("double")).otherwise(0.0).alias("snr_db"),
        F.lit(48000.0).alias("sample_rate_hz"), F.lit(40.0).alias("block_gap_ms"), ((F.col("event_id") % 5) / 200).alias("lost_block_fraction"),
        F.when(F.expr("event_id % 997 = 3"), F.array(F.lit("audio-frame-gap"))).when(F.expr("event_id % 101 = 7"), F.array(F.lit("noisy-room"))).otherwise(F.array().cast("array<string>")).alias("quality_reasons"),
        F.expr("session_id % 5 = 1").alias("echo_cancellation"))


def voice_sessions(frames: DataFrame) -> DataFrame:
    """Options of each session: start and length of the noise calibration."""
    ids = frames.select("session_id").distinct()
    return ids.select("session_id", F.lit(0.0).alias("session_started_at_ms"), F.when(F.expr("session_id % 13 = 3"), 1999.0).otherwise(2500.0).alias("noise_calibration_duration_ms"))


def face_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One face frame per line item: sessions of 375 orders, about 60 s and 1500 frames, with blinks, turns of the head and lost faces.

    A frame's number is its line's place among the lines of its session, so one
    exchange by session numbers all rows and serves the session windows that follow.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = line.select(*keys, F.expr(f"l_orderkey div {ORDERS_PER_SESSION}").alias("session_id"))
    rows = rows.select("session_id", "l_quantity", "l_discount", "l_tax", (F.row_number().over(Window.partitionBy("session_id").orderBy(*keys)) - 1).cast("long").alias("seq"))
    t = F.col("seq") * STEP_MS
    closed = t % 10000 < 120
    eye = lambda extra: F.when(closed, 0.1).otherwise(0.3 + extra)
    pick = lambda cond, yes, no: F.when(F.expr(cond), F.lit(yes)).otherwise(F.lit(no))
    return rows.select(
        "session_id", "seq", t.cast("double").alias("t_ms"), F.lit(1).cast("long").alias("capture_epoch"),
        pick("session_id % 9 = 4 and seq % 100 = 50", 2, 1).alias("face_count"),
        pick("session_id % 10 = 6 and seq >= 1000", "face-2", "face-1").alias("track_segment_id"), F.lit("proc-v").alias("processor_ref"),
        F.lit(True).alias("face_visible"),
        (384 + F.col("l_quantity") % 3).alias("box_width_px"), (360 + F.col("l_quantity") % 2).alias("box_height_px"), F.lit(0.1).alias("edge_margin"),
        pick("session_id % 6 = 5 and seq between 300 and 310", 7.001, 2.0).alias("yaw_deg"), (F.col("l_tax") * 50).alias("pitch_deg"), (F.col("l_discount") * 20).alias("roll_deg"),
        eye(F.col("l_discount") / 10).alias("eye_left"), eye(F.col("l_tax") / 10).alias("eye_right"),
        (-0.5 - F.col("l_tax") / 10).alias("mouth_left_x"), (F.col("l_discount") / 20).alias("mouth_left_y"), F.lit(0.5).alias("mouth_right_x"), F.lit(0.0).alias("mouth_right_y"),
        (F.col("l_quantity") / 100).alias("mouth_aperture"),
        F.when(F.expr("seq % 125 = 0"), 100.0).otherwise(F.col("l_quantity") / 1000).alias("movement_speed"),
        F.when(F.expr("seq > 0"), 40.0).alias("inter_result_gap_ms"), F.lit(0.5).alias("illumination_mean"), F.lit(0.01).alias("dark_clipping"), F.lit(0.01).alias("bright_clipping"),
        pick("session_id % 8 = 3 and seq >= 1200", 0.0001, 0.01).alias("sharpness"), F.lit(25.0).alias("frame_rate"), F.lit(0.3).alias("box_width"), F.lit(0.4).alias("box_height"), pick("seq % 400 = 399", 0.25, 0.1).alias("skipped_fraction"),
        F.when(F.expr("session_id % 15 = 2 and seq = 700"), F.array(F.lit("camera-unavailable"))).otherwise(F.array().cast("array<string>")).alias("quality_reasons"))


def face_sessions(frames: DataFrame) -> DataFrame:
    ids = frames.select("session_id").distinct()
    return ids.select(
        "session_id", F.lit(0.0).alias("session_started_at_ms"), F.when(F.expr("session_id % 12 = 11"), 1499.0).otherwise(2000.0).alias("calibration_duration_ms"),
        F.lit(384.0).alias("baseline_width_px"), F.lit(360.0).alias("baseline_height_px"))
