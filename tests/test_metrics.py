import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from frames import face, voice  # noqa: E402

from framewright.functions import gates, stats  # noqa: E402
from framewright.operators import face as face_ops  # noqa: E402
from framewright.operators import signals  # noqa: E402
from framewright.operators import voice as voice_ops  # noqa: E402


def voice_result(spark, frames, calibration=2500.0):
    sessions = spark.createDataFrame([(1, 0.0, calibration)], "session_id long, session_started_at_ms double, noise_calibration_duration_ms double")
    return {r.ordinal: r for r in voice_ops.voice_outcomes(frames, sessions).collect()}


def face_result(spark, frames, calibration=2000.0):
    sessions = spark.createDataFrame([(1, 0.0, calibration, 384.0, 360.0)], "session_id long, session_started_at_ms double, calibration_duration_ms double, baseline_width_px double, baseline_height_px double")
    return {r.ordinal: r for r in face_ops.face_outcomes(frames, sessions).collect()}


def test_regular_speech_measures_all_seven(spark):
    r = voice_result(spark, voice(spark))
    assert [r[i].status for i in range(7)] == ["measured"] * 7 and [r[i].code for i in range(7)] == [c for c, _ in voice_ops.METRICS]
    assert r[2].value == pytest.approx(0.8, abs=0.01) and r[2].pauses == 9
    assert r[4].value == pytest.approx(0.5, abs=0.02) and 140 < r[0].value < 160 and 0 <= r[0].quality_score <= 1


def test_speech_without_pauses_has_a_measured_zero_rate(spark):
    r = voice_result(spark, voice(spark, active=lambda t: True))
    assert (r[3].status, r[3].value) == ("measured", 0.0) and (r[4].status, r[4].reason) == ("withheld", "insufficient-events")


@pytest.mark.parametrize("change, step, calibration, want", [
    (lambda t: {"block_gap_ms": 40.01}, 40.0, 2500.0, ["no-usable-signal"] * 7),
    (None, 40.0, 1999.0, ["quality-threshold-failed"] * 7),
    (lambda t: {"track_segment_id": "mic-2" if t >= 20_000 else "mic-1"}, 40.0, 2500.0, ["quality-threshold-failed"] * 7),
    (lambda t: {"periodic": False}, 40.0, 2500.0, ["insufficient-pitched-speech"] * 2 + [None] * 5),
    (lambda t: {"block_gap_ms": 40.0, "lost_block_fraction": 0.05, "clipped_sample_fraction": 0.01, "dc_offset": 0.02, "snr_db": 15.0, "sample_rate_hz": 44_100.0}, 40.0, 2500.0, [None] * 7),
    (lambda t: {"snr_db": float("nan")}, 40.0, 2500.0, ["no-usable-signal"] * 7),
])
def test_voice_is_withheld_for_the_first_reason(spark, change, step, calibration, want):
    r = voice_result(spark, voice(spark, step=step, change=change), calibration)
    assert [r[i].reason for i in range(7)] == want


def test_a_session_without_frames_has_all_outcomes(spark):
    sessions = spark.createDataFrame([(1, 0.0, 2500.0), (2, 0.0, 2500.0)], "session_id long, session_started_at_ms double, noise_calibration_duration_ms double")
    out = voice_ops.voice_outcomes(voice(spark, step=40.0), sessions)
    assert out.count() == 14 and out.filter("session_id = 2 and reason = 'no-usable-signal'").count() == 7


def test_first_window_reference(spark):
    framed = voice_ops.segment_frames(voice(spark, duration=4000, active=lambda t: t < 2000, change=lambda t: {"dc_offset": 0.0 if t < 2000 else 1.0}),
                                      spark.createDataFrame([(1, 0.0, 2500.0)], "session_id long, session_started_at_ms double, noise_calibration_duration_ms double"))
    kept = voice_ops.segments(framed)
    assert [r[0] for r in kept.select(voice_ops.window_ref()).collect()] == ["voice:1:mic-1:0:2000"]


def test_sixty_seconds_of_face_measure_all_nine(spark):
    r = face_result(spark, face(spark))
    assert [r[i].status for i in range(9)] == ["measured"] * 9
    assert r[8].exposure_ms == pytest.approx(60_000, abs=1) and r[8].blinks == 6 and r[8].value == pytest.approx(6, abs=0.01)
    assert r[0].value == 0.3 and r[7].value == 0.02 and r[0].bins == 12


def test_half_a_minute_is_too_short_for_blinks(spark):
    r = face_result(spark, face(spark, duration=30_000))
    assert [r[i].status for i in range(8)] == ["measured"] * 8 and r[8].reason == "insufficient-exposure" and r[0].bins == 6


@pytest.mark.parametrize("hz, change, want", [
    (30.0, lambda t, i: {"face_count": 2}, ["multiple-faces"] * 9),
    (30.0, lambda t, i: {"yaw_deg": 7.001}, ["no-usable-signal"] * 9),
    (15.0, None, ["no-usable-signal"] * 9),
    (20.0, None, [None] * 8 + ["insufficient-frame-cadence"]),
    (25.0, lambda t, i: {"eye_left": 0.3, "eye_right": 0.3} | ({"movement_speed": 100.0} if i % 125 == 0 else {}), [None] * 9),
])
def test_face_is_withheld_for_the_first_reason(spark, hz, change, want):
    r = face_result(spark, face(spark, hz=hz, change=change))
    assert [r[i].reason for i in range(9)] == want
    if hz == 25.0:  # speeds at bin starts do not count
        assert r[7].value == 0.02 and (r[8].blinks, r[8].value) == (0, 0.0)


@pytest.mark.parametrize("change, want", [
    (lambda t, i: {"processor_ref": "p" if i % 3 else None}, [None] * 9),
    (lambda t, i: {"processor_ref": None}, ["no-usable-signal"] * 9),
    (lambda t, i: {"processor_ref": "q" if t % 5000 < 100 else "p"}, ["no-usable-signal"] * 9),
    (lambda t, i: {"processor_ref": "q" if t < 5000 else "p"}, ["quality-threshold-failed"] * 9),
    (lambda t, i: {"movement_speed": float("inf") if i % 2 else None}, [None] * 7 + ["insufficient-bins", None]),
])
def test_bins_have_one_processor_and_values_are_finite(spark, change, want):
    r = face_result(spark, face(spark, change=change).orderBy("mouth_aperture", "eye_left"))
    assert [r[i].reason for i in range(9)] == want


def test_long_closures_and_gaps_are_no_blinks(spark):
    shut = lambda t, i: {"eye_left": 0.1, "eye_right": 0.1} if 10_000 <= t < 12_000 else {"eye_left": 0.3, "eye_right": 0.3}
    assert face_result(spark, face(spark, change=shut))[8].blinks == 0


def test_time_weighted_percentile_of_uneven_samples(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0), (1, 10.0, 1.0), (1, 100.0, 9.0), (2, 0.0, 3.0)], "g int, t double, v double")
    got = {r.g: r.x for r in stats.timed_percentile(rows, ["g"], "t", "v", F.lit(0.9), F.lit(10.0), "x").collect()}
    assert got == {1: 5.0, 2: 3.0}
    assert {r.g: r.x for r in stats.timed_percentile(rows, ["g"], "t", "v", F.lit(0.95), F.lit(10.0), "x").collect()}[1] == 9.0


def test_statistics_keep_their_conventions(spark):
    one = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),)], "x double").filter("not isnan(x)")
    r = one.agg(stats.population_sd("x").alias("sd"), stats.nearest_rank(F.collect_list("x"), 0.95).alias("p"), stats.upper_median(F.collect_list("x")).alias("u"), F.median("x").alias("m")).first()
    assert r.sd == pytest.approx(1.2472191) and (r.p, r.u, r.m) == (4.0, 2.0, 2.0)
    assert one.limit(0).agg(stats.median_or_zero(F.col("x")).alias("m"), stats.population_sd("x").alias("s")).first() == (0.0, 0.0)
    assert [r[0] for r in spark.range(1).select(stats.js_round(F.lit(-2.5))).collect()] == [-2.0]


def test_voice_reasons_ignore_nan_and_visual_reasons_do_not(spark):
    v = voice(spark, duration=40, step=40.0, change=lambda t: {"snr_db": float("nan"), "rms": float("nan")})
    assert v.select(gates.voice_reasons(F.lit(False)).alias("r")).first().r == []
    f = face(spark, duration=40, hz=25.0, change=lambda t, i: {"sharpness": float("nan"), "quality_reasons": ["multiple-faces", "document-hidden"]})
    assert f.select(gates.visual_reasons().alias("r")).first().r == ["document-hidden", "blur"]


def test_monotonic_filter_and_live_history(spark):
    rows = spark.createDataFrame([(1, a, s, float(s)) for a, s in enumerate((1, 2, 5, 3, 4, 6))], "session_id int, arrival int, seq int, t_ms double")
    assert [r.seq for r in signals.monotonic(rows, "t_ms").orderBy("seq").collect()] == [1, 2, 5, 6]
    back = spark.createDataFrame([(1, i, t) for i, t in enumerate((0.0, 100.0, 50.0, 60.0))], "session_id int, seq int, t_ms double")
    assert [r.t_ms for r in signals.latest(back).orderBy("seq").collect()] == [50.0, 60.0]


def test_throttle_and_average_stream_over_sessions(spark):
    rows = [(s, i, float((i * 37 + s * 11) % 1000), float(i % 7)) for s in (1, 2, 3) for i in range(500)]
    f = spark.createDataFrame(rows, "session_id long, seq long, t_ms double, v double")
    accepted, averages = [], {}
    for s in (1, 2, 3):
        last = float("-inf")
        for t in sorted(r[2] for r in rows if r[0] == s):
            if t - last >= 40:
                accepted.append((s, t))
                last = t
        averages[s] = 0.5
        for r in rows:
            if r[0] == s:
                averages[s] = averages[s] * 0.9 + r[3] * 0.1
    fast, mean = signals.throttle(f, 25.0), signals.average(f, "v", 0.1, 0.5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert sorted((r.session_id, r.t_ms) for r in fast.collect()) == accepted
        assert {r.session_id: r.average for r in mean.collect()} == pytest.approx(averages)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not any("collect_list" in x._jdf.queryExecution().toString() for x in (fast, mean))
