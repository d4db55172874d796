"""Synthetic frames for tests, as rows of the engine's schemas."""

from __future__ import annotations

import math

VOICE = (
    "session_id long, seq long, t_ms double, capture_epoch long, task_context string, speech_active boolean, periodic boolean, track_segment_id string, processor_ref string, rms double, f0_hz double, "
    "f0_confidence double, estimator_agreement double, syllabic_nucleus boolean, clipped_sample_fraction double, dc_offset double, snr_db double, sample_rate_hz double, block_gap_ms double, "
    "lost_block_fraction double, quality_reasons array<string>, echo_cancellation boolean"
)
FACE = (
    "session_id long, seq long, t_ms double, capture_epoch long, face_count int, track_segment_id string, processor_ref string, face_visible boolean, box_width_px double, box_height_px double, edge_margin double, "
    "yaw_deg double, pitch_deg double, roll_deg double, eye_left double, eye_right double, mouth_left_x double, mouth_left_y double, mouth_right_x double, mouth_right_y double, mouth_aperture double, "
    "movement_speed double, inter_result_gap_ms double, illumination_mean double, dark_clipping double, bright_clipping double, sharpness double, frame_rate double, box_width double, box_height double, "
    "skipped_fraction double, quality_reasons array<string>"
)


def voice(spark, session=1, duration=30_000, step=10.0, change=None, active=lambda t: t % 2500 < 2000):
    rows = []
    for i in range(int(duration / step)):
        t = i * step
        on = active(t)
        row = dict(
            session_id=session, seq=i, t_ms=t, capture_epoch=1, task_context="ambient", speech_active=on, periodic=True, track_segment_id="mic-1", processor_ref="p", rms=0.1 if on else 0.001,
            f0_hz=150 + 8 * math.sin(t / 400), f0_confidence=0.9, estimator_agreement=0.95, syllabic_nucleus=on and t % 400 == 0, clipped_sample_fraction=0.0, dc_offset=0.0, snr_db=26.0 if on else 0.0,
            sample_rate_hz=48_000.0, block_gap_ms=20.0, lost_block_fraction=0.0, quality_reasons=[], echo_cancellation=False)
        rows.append(tuple((row | (change(t) if change else {})).values()))
    return spark.createDataFrame(rows, VOICE)


def face(spark, session=1, duration=60_000, hz=30.0, change=None):
    rows = []
    n = round(duration * hz / 1000)
    for i in range(n):
        t = i * 1000 / hz
        shut = t % 10_000 < 100 and t > 0
        row = dict(
            session_id=session, seq=i, t_ms=t, capture_epoch=1, face_count=1, track_segment_id="face-1", processor_ref="p", face_visible=True, box_width_px=384.0, box_height_px=360.0, edge_margin=0.1,
            yaw_deg=1.0, pitch_deg=1.0, roll_deg=1.0, eye_left=0.1 if shut else 0.3, eye_right=0.1 if shut else 0.3, mouth_left_x=-0.5, mouth_left_y=0.0, mouth_right_x=0.5, mouth_right_y=0.0,
            mouth_aperture=0.2, movement_speed=0.02, inter_result_gap_ms=1000 / hz if i else None, illumination_mean=0.5, dark_clipping=0.0, bright_clipping=0.0, sharpness=0.01, frame_rate=hz,
            box_width=0.3, box_height=0.4, skipped_fraction=0.0, quality_reasons=[])
        rows.append(tuple((row | (change(t, i) if change else {})).values()))
    return spark.createDataFrame(rows, FACE)
