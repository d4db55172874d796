"""The seven voice metrics: gated frames, continuity-safe segments, statistics, one outcome per session and metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions.stats import all_of, clamp01, finite, mad, plain_number
from framewright.functions.tables import settle

CAPTURE_MS, SEGMENT_MS, MAX_GAP_MS = 300_000.0, 10_000.0, 40.0
#: Reasons that make a voice frame unusable.
BLOCKING = (
    "microphone-unavailable", "audio-worklet-unavailable", "audio-frame-gap", "sample-rate-below-minimum",
    "audio-clipping", "dc-offset", "voice-worker-unavailable", "document-hidden",
)
#: The registry of voice metrics, in order, with their units.
METRICS = (
    ("ambient.voice.f0.median", "Hz"),
    ("ambient.voice.f0.variability", "semitone-SD"),
    ("ambient.voice.speech_activity_fraction", "ratio"),
    ("ambient.voice.pause_rate", "pauses/minute"),
    ("ambient.voice.pause_duration.median", "seconds"),
    ("ambient.voice.speech_run_duration.median", "seconds"),
    ("ambient.voice.acoustic_nucleus_rate", "nuclei/active-speech-second"),
)


def in_range(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames of the capture window, with their session's options."""
    f = frames.join(sessions, "session_id")
    return f.filter(finite("t_ms") & (F.col("t_ms") >= F.col("session_started_at_ms")) & (F.col("t_ms") < F.col("session_started_at_ms") + CAPTURE_MS))


def timing_usable() -> Column:
    f = F.col
    return all_of(
        f("task_context") == "ambient", f("speech_active").isNotNull(), f("periodic").isNotNull(), F.length("track_segment_id") > 0, finite("t_ms"),
        finite("sample_rate_hz") & (f("sample_rate_hz") >= 44_100), finite("block_gap_ms") & (f("block_gap_ms") <= MAX_GAP_MS),
        finite("lost_block_fraction") & (f("lost_block_fraction") <= 0.05), finite("clipped_sample_fraction") & (f("clipped_sample_fraction") <= 0.01),
        finite("dc_offset") & (F.abs("dc_offset") <= 0.02), ~f("speech_active") | (finite("snr_db") & (f("snr_db") >= 15)),
        ~F.arrays_overlap("quality_reasons", F.array(*(F.lit(r) for r in BLOCKING))))


def valid_pitch() -> Column:
    f = F.col
    return all_of(
        f("speech_active"), f("periodic"), finite("f0_hz") & f("f0_hz").between(50, 700),
        finite("f0_confidence") & (f("f0_confidence") >= 0.55), finite("estimator_agreement") & (f("estimator_agreement") >= 0.7))


def weigh(frames: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Adds the nominal step of each group (median of steps within the gap limit, else 10 ms) and each frame's weight."""
    order = Window.partitionBy(*keys).orderBy("seq")
    step = F.col("t_ms") - F.lag("t_ms").over(order)
    f = frames.withColumn("_step", F.when((step > 0) & (step <= MAX_GAP_MS), step)).withColumn("_next", F.lead("t_ms").over(order))
    f = f.withColumn(f"{prefix}nominal", F.coalesce(F.median("_step").over(Window.partitionBy(*keys)), F.lit(10.0)))
    rest = F.least(F.lit(MAX_GAP_MS), F.greatest(F.lit(0.0), F.col("_next") - F.col("t_ms")))
    return f.withColumn(f"{prefix}weight", F.when(F.col("_next").isNull(), F.col(f"{prefix}nominal")).otherwise(rest)).drop("_step", "_next")


def segment_frames(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Usable frames with their segment number and weight.

    Frames are taken in order of arrival (``seq``).  A segment ends before an
    unusable frame, a time that does not rise, a gap over 40 ms, a change of
    epoch, processor or track, and at every ten seconds of the session.
    """
    f = in_range(frames, sessions).withColumn("usable", timing_usable()).withColumn("pitched", valid_pitch())
    f = f.withColumn("bucket", F.floor((F.col("t_ms") - F.col("session_started_at_ms")) / SEGMENT_MS))
    order = Window.partitionBy("session_id").orderBy("seq")
    prior = lambda c: F.lag(c).over(order)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(prior(c)) for c in ("capture_epoch", "processor_ref", "track_segment_id", "bucket")))
    follows = all_of(prior("usable"), F.col("t_ms") > prior("t_ms"), F.col("t_ms") - prior("t_ms") <= MAX_GAP_MS, same)
    f = f.withColumn("segment", F.sum(F.when(F.col("usable") & follows, 0).otherwise(1)).over(order)).filter("usable")
    return weigh(f, ["session_id", "segment"])


def segments(frames: DataFrame) -> DataFrame:
    """Eligible segments of weighed frames: at least 2 s long, 1 s active, 90 % covered."""
    when = lambda c, x: F.sum(F.when(F.col(c), F.col(x)).otherwise(0.0))
    s = frames.groupBy("session_id", "segment").agg(
        F.count("*").alias("frames"), F.sum("weight").alias("duration_ms"), when("speech_active", "weight").alias("active_ms"), when("pitched", "weight").alias("pitched_ms"),
        F.min_by("t_ms", "seq").alias("start_ms"), F.max_by("t_ms", "seq").alias("last_ms"), F.first("nominal").alias("nominal"), F.max("lost_block_fraction").alias("lost"),
        F.max("clipped_sample_fraction").alias("clipped"), F.count_if(F.col("speech_active") & F.col("syllabic_nucleus")).alias("nuclei"),
        F.first("processor_ref").alias("processor_ref"), F.first("track_segment_id").alias("track_segment_id"), F.first("capture_epoch").alias("capture_epoch"))
    expected = F.floor((F.col("last_ms") - F.col("start_ms")) / F.col("nominal")) + 1
    s = s.withColumn("coverage", F.least(F.lit(1.0), F.col("frames") / expected, 1 - F.col("lost"))).withColumn("end_ms", F.col("last_ms") + F.col("nominal"))
    return s.filter("frames >= 2 and duration_ms >= 2000 and active_ms >= 1000 and coverage >= 0.9")


def window_ref(start: str = "start_ms", end: str = "end_ms", modality: str = "voice") -> Column:
    """``modality:epoch:track:start:end`` of a stretch of frames."""
    return F.concat_ws(":", F.lit(modality), F.col("capture_epoch").cast("string"), "track_segment_id", plain_number(F.col(start)), plain_number(F.col(end)))


def seen(observed: DataFrame, place: list[str]) -> DataFrame:
    """First and last time of each session's frames in range, in the order of ``place``, and their processors and tracks."""
    track = F.when(F.length("track_segment_id") > 0, F.col("track_segment_id"))
    unique = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    return observed.groupBy("session_id").agg(
        F.min_by("t_ms", F.struct(*place)).alias("observed_start_ms"), F.max_by("t_ms", F.struct(*place)).alias("observed_end_ms"), unique("processor_ref", "seen_processors"), unique(track, "seen_tracks"))


def gathered(sessions: DataFrame, observed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Evidence of each session's outcomes: ``observed_start_ms, observed_end_ms, sample_count, segment_count, processor_refs, track_segment_ids, source_window_refs``.

    ``observed`` has what is ``seen`` of each session's frames in range; ``pieces``
    are the segments or bins kept, with their ``frames, start_ms`` and ``ref``.
    Processors and tracks are those of the pieces, or of all frames where none
    was kept; references are in order of time.
    """
    unique = lambda c: F.array_sort(F.collect_set(c))
    observed = observed.select("session_id", "observed_start_ms", "observed_end_ms", F.col("seen_processors").alias("_p"), F.col("seen_tracks").alias("_t"))
    kept = pieces.groupBy("session_id").agg(
        F.sum("frames").alias("sample_count"), F.count_distinct("capture_epoch", "track_segment_id").alias("_tracks"), F.count(F.lit(1)).alias("_pieces"), unique("processor_ref").alias("processor_refs"),
        unique("track_segment_id").alias("track_segment_ids"), F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "ref"))), lambda x: x.ref).alias("source_window_refs"))
    e, none = sessions.select("session_id").join(observed, "session_id", "left").join(kept, "session_id", "left"), F.array().cast("array<string>")
    return e.select(
        "session_id", "observed_start_ms", "observed_end_ms", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sample_count", "_tracks", "_pieces")),
        F.coalesce("processor_refs", "_p", none).alias("processor_refs"), F.coalesce("track_segment_ids", "_t", none).alias("track_segment_ids"), F.coalesce("source_window_refs", none).alias("source_window_refs"))


def prepared(frames: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable frames and their eligible segments, computed once for outcomes and evidence."""
    framed = settle(segment_frames(frames, sessions))
    return framed, settle(segments(framed))


def evidence(frames: DataFrame, sessions: DataFrame, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What the voice outcomes of each session rest on; each segment is one window.  ``ready`` is what ``prepared`` made of the frames, if it is at hand."""
    kept = (ready[1] if ready else segments(segment_frames(frames, sessions))).withColumn("ref", window_ref())
    return gathered(sessions, seen(in_range(frames, sessions), ["seq"]), kept).withColumnRenamed("_pieces", "segment_count").drop("_tracks")


def runs(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Islands of equal activity within eligible segments: ``position`` from either end and ``duration_ms``."""
    f = frames.join(kept.select("session_id", "segment"), ["session_id", "segment"], "left_semi")
    order = Window.partitionBy("session_id", "segment").orderBy("seq")
    f = f.withColumn("_turn", F.coalesce((F.col("speech_active") != F.lag("speech_active").over(order)).cast("int"), F.lit(0)))
    f = f.withColumn("run", F.sum("_turn").over(order))
    r = f.groupBy("session_id", "segment", "run").agg(F.first("speech_active").alias("active"), F.sum("weight").alias("duration_ms"))
    r = r.withColumn("last_run", F.max("run").over(Window.partitionBy("session_id", "segment")))
    return r.withColumn("pause", ~F.col("active") & (F.col("run") > 0) & (F.col("run") < F.col("last_run")) & F.col("duration_ms").between(200, 1999))


def pitch_subwindows(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Median pitch of the valid 500 ms windows of pitch segments."""
    f = frames.join(kept.filter("pitched_ms >= 1000").select("session_id", "segment", "start_ms"), ["session_id", "segment"])
    f = f.withColumn("sub", F.floor((F.col("t_ms") - F.col("start_ms")) / 500))
    f = weigh(f, ["session_id", "segment", "sub"], "sub_")
    s = f.groupBy("session_id", "segment", "sub").agg(
        F.sum("sub_weight").alias("covered"), F.sum(F.when(F.col("pitched"), F.col("sub_weight")).otherwise(0.0)).alias("pitched_ms"),
        F.count_if("pitched").alias("values"), F.median(F.when(F.col("pitched"), F.col("f0_hz"))).alias("f0"))
    return s.filter("covered >= 400 and pitched_ms >= 300 and values >= 2")


def variability(sub: DataFrame) -> DataFrame:
    """Semitone spread of the windows of segments with at least four."""
    by = Window.partitionBy("session_id", "segment")
    s = sub.withColumn("centre", F.median("f0").over(by)).withColumn("semitones", 12 * F.log2(F.col("f0") / F.col("centre")))
    return s.groupBy("session_id", "segment").agg(F.count("*").alias("n"), F.stddev_pop("semitones").alias("spread")).filter("n >= 4")


def quality_score(frames: DataFrame, kept: DataFrame) -> DataFrame:
    active = frames.join(kept.select("session_id", "segment"), ["session_id", "segment"], "left_semi").filter("speech_active").groupBy("session_id").agg(F.median("snr_db").alias("snr"))
    s = kept.groupBy("session_id").agg(F.median("coverage").alias("coverage"), F.max("clipped").alias("clipped"), F.max("lost").alias("lost")).join(active, "session_id", "left")
    snr = F.coalesce(clamp01((F.col("snr") - 15) / 15), F.lit(0.0))
    score = 0.35 * F.col("coverage") + 0.3 * snr + 0.2 * (1 - clamp01(F.col("clipped") / 0.01)) + 0.15 * (1 - clamp01(F.col("lost") / 0.05))
    return s.select("session_id", clamp01(score).alias("quality_score"))


def voice_outcomes(frames: DataFrame, sessions: DataFrame, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Exactly one row per session and voice metric.

    Columns: ``session_id, ordinal, code, unit, status`` (measured or withheld),
    ``value, quality_score, dispersion`` (null unless measured), ``reason``
    (null unless withheld) and the counts that decided: ``segments,
    eligible_ms, active_ms, pitched_ms, pauses, speech_runs, nuclei``.  Sessions
    without frames in range are withheld too.  All windows and groups share the
    session as their shuffle key.
    """
    framed, kept = ready or prepared(frames, sessions)
    run = runs(framed, kept)
    per_run = run.groupBy("session_id", "segment").agg(
        F.count_if("pause").alias("pauses"), F.count_if("active").alias("speech_runs"),
        (F.median(F.when(F.col("pause"), F.col("duration_ms"))) / 1000).alias("pause_s"), (F.median(F.when(F.col("active"), F.col("duration_ms"))) / 1000).alias("run_s"))
    all_runs = run.groupBy("session_id").agg(
        (F.median(F.when(F.col("pause"), F.col("duration_ms"))) / 1000).alias("pause_all"), (F.median(F.when(F.col("active"), F.col("duration_ms"))) / 1000).alias("run_all"))
    pitch = framed.join(kept.filter("pitched_ms >= 1000").select("session_id", "segment"), ["session_id", "segment"], "left_semi").filter("pitched").groupBy("session_id", "segment").agg(F.median("f0_hz").alias("f0"))
    spread = variability(pitch_subwindows(framed, kept)).select("session_id", "segment", "spread")
    per = kept.join(per_run, ["session_id", "segment"], "left").join(pitch, ["session_id", "segment"], "left").join(spread, ["session_id", "segment"], "left")
    per = per.withColumn("ratio", F.col("active_ms") / F.col("duration_ms")).withColumn("rate", F.col("pauses") / (F.col("duration_ms") / 60000)).withColumn("nucleus_rate", F.col("nuclei") / (F.col("active_ms") / 1000))
    # one long table of per-segment values gives median, deviation and count of all metrics at once
    names = {"f0": 0, "spread": 1, "ratio": 2, "rate": 3, "pause_s": 4, "run_s": 5, "nucleus_rate": 6}
    long_ = per.select("session_id", F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.col(c).alias("v")) for c, i in names.items()))).alias("x")).select("session_id", "x.*").filter("v is not null")
    spread_of = mad(long_, ["session_id", "ordinal"], "v", "mid")
    total = kept.groupBy("session_id").agg(
        F.count("*").alias("segments"), F.sum("duration_ms").alias("eligible_ms"), F.sum("active_ms").alias("active_ms"), F.sum("pitched_ms").alias("pitched_ms"), F.sum("nuclei").alias("nuclei"),
        F.count_if(F.col("pitched_ms") >= 1000).alias("pitch_segments"), F.count_distinct("processor_ref").alias("processors"), F.count_distinct("capture_epoch", "track_segment_id").alias("tracks"))
    counts = per_run.groupBy("session_id").agg(F.sum("pauses").alias("pauses"), F.sum("speech_runs").alias("speech_runs"))
    s = sessions.join(total, "session_id", "left").join(counts, "session_id", "left").join(all_runs, "session_id", "left").join(quality_score(framed, kept), "session_id", "left")
    zero = ("segments", "eligible_ms", "active_ms", "pitched_ms", "nuclei", "pitch_segments", "pauses", "speech_runs")
    s = s.select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero else F.col(c) for c in s.columns))
    registry = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(code).alias("code"), F.lit(unit).alias("unit")) for i, (code, unit) in enumerate(METRICS)))
    s = s.withColumn("m", F.explode(registry)).select("*", "m.*").drop("m").join(spread_of, ["session_id", "ordinal"], "left")

    k, f = F.col("ordinal"), F.col
    common = (
        F.when(f("noise_calibration_duration_ms") < 2000, "quality-threshold-failed").when(f("segments") == 0, "no-usable-signal")
        .when((f("processors") > 1) | (f("tracks") > 1), "quality-threshold-failed").when(f("segments") < 3, "insufficient-segments")
        .when(f("eligible_ms") < 30_000, "insufficient-duration").when(f("active_ms") < 15_000, "insufficient-active-speech")
        .when((k < 2) & ((f("pitch_segments") < 3) | (f("pitched_ms") < 10_000) | (f("pitched_ms") < 0.6 * f("active_ms"))), "insufficient-pitched-speech")
        .when((k == 1) & (F.coalesce("mid_n", F.lit(0)) < 3), "insufficient-pitch-bins")
        .when(((k == 4) & (f("pauses") < 5)) | ((k == 5) & (f("speech_runs") < 5)), "insufficient-events").when((k == 6) & (f("nuclei") < 30), "insufficient-nuclei"))
    value = (
        F.when(k < 2, f("mid")).when(k == 2, f("active_ms") / f("eligible_ms")).when(k == 3, f("pauses") / (f("eligible_ms") / 60000))
        .when(k == 4, f("pause_all")).when(k == 5, f("run_all")).otherwise(f("nuclei") / (f("active_ms") / 1000)))
    s = s.withColumn("reason", common)
    ok = F.col("reason").isNull()
    return s.select(
        "session_id", "ordinal", "code", "unit", F.when(ok, "measured").otherwise("withheld").alias("status"), F.when(ok, value).alias("value"),
        F.when(ok, f("quality_score")).alias("quality_score"), F.when(ok, f("mid_mad")).alias("dispersion"), "reason",
        *(F.col(c) for c in ("segments", "eligible_ms", "active_ms", "pitched_ms", "pauses", "speech_runs", "nuclei")))
