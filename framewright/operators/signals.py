"""Rolling stream statistics, calibration and small state machines over frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions.gates import visually_sound
from framewright.functions.stats import finite, median_or_zero, nearest_rank


def rolling_cadence(frames: DataFrame, window_ms: int = 2000) -> DataFrame:
    """Frames per second over the last ``window_ms``: intervals over the span, at least 1 ms."""
    w = Window.partitionBy("session_id").orderBy(F.col("t_ms").cast("long")).rangeBetween(-window_ms, 0)
    n, span = F.count("*").over(w), F.col("t_ms") - F.min("t_ms").over(w)
    return frames.withColumn("cadence_hz", (n - 1) * 1000 / F.greatest(F.lit(1.0), span))


def rolling_fraction(frames: DataFrame, part: Column, whole: Column, out: str, window_ms: int = 2000) -> DataFrame:
    """Sum of ``part`` over the sum of ``whole`` in the last ``window_ms``; 0 when the whole is 0."""
    w = Window.partitionBy("session_id").orderBy(F.col("t_ms").cast("long")).rangeBetween(-window_ms, 0)
    return frames.withColumn(out, F.coalesce(F.try_divide(F.sum(part).over(w), F.sum(whole).over(w)), F.lit(0.0)))


def latest(frames: DataFrame, window_ms: int = 8000, rows: int = 800) -> DataFrame:
    """What a live history holds at the end: frames of the last ``window_ms``, at most the last ``rows``; a time that goes back starts over."""
    order = Window.partitionBy("session_id").orderBy("seq")
    back = F.coalesce((F.col("t_ms") < F.lag("t_ms").over(order)).cast("int"), F.lit(0))
    f = frames.withColumn("_back", back).withColumn("run", F.sum("_back").over(order)).drop("_back")
    everything = Window.partitionBy("session_id")
    f = f.withColumn("_last_run", F.max("run").over(everything)).filter("run = _last_run")
    f = f.withColumn("_end", F.max("t_ms").over(everything)).filter(F.col("t_ms") >= F.col("_end") - window_ms)
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return f.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= rows).drop("run", "_last_run", "_end", "_n")


def latency_p95(frames: DataFrame, latency: str, rows: int = 500) -> DataFrame:
    """Nearest-rank 95th percentile of each session's last ``rows`` latencies."""
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    f = frames.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= rows)
    return f.groupBy("session_id").agg(nearest_rank(F.collect_list(latency), 0.95).alias("p95"), F.count("*").alias("samples"))


def diagnostics(blocks: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Counters of each session's sound blocks in order of arrival.

    ``blocks (session_id, arrival, seq, t_ms, samples, sample_rate_hz)``: a block
    is late by what its time exceeds the last one's plus the block's own length;
    numbers skipped after a block with a positive number are lost blocks; a time
    before the last one is a regression.  The latency is a nearest rank of all
    latencies, 0 without any.
    """
    order = Window.partitionBy("session_id").orderBy("arrival")
    last_t, last_seq = F.lag("t_ms").over(order), F.lag("seq").over(order)
    lost = F.when(last_seq > 0, F.greatest(F.lit(0).cast("long"), F.col("seq") - last_seq - 1)).otherwise(0)
    gap = F.greatest(F.lit(0.0), F.col("t_ms") - last_t - F.col("samples") * 1000 / F.col("sample_rate_hz"))
    b = blocks.select("session_id", latency, lost.alias("lost"), F.coalesce(gap, F.lit(0.0)).alias("gap"), F.coalesce(F.col("t_ms") < last_t, F.lit(False)).alias("back"))
    ranked = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col(latency).asc_nulls_last()))
    known = F.count(latency).over(Window.partitionBy("session_id"))
    b = b.withColumn("_n", ranked).withColumn("_p95", F.least(known - 1, F.floor(known * 0.95)) + 1)
    d = b.groupBy("session_id").agg(
        F.count("*").alias("received"), F.sum("lost").alias("lost"), F.max("gap").alias("maximum_gap_ms"), F.count_if("back").alias("regressions"),
        F.coalesce(F.max(F.when(F.col("_n") == F.col("_p95"), F.col(latency))), F.lit(0.0)).alias("p95_latency_ms"))
    return d.withColumn("lost_fraction", F.col("lost") / F.greatest(F.lit(1), F.col("received") + F.col("lost")))


def monotonic(frames: DataFrame, time: str) -> DataFrame:
    """Drops a frame whose sequence or time does not exceed all before it in its capture epoch, in order of arrival; without that column a session is one epoch."""
    keys = ["session_id", *(c for c in ("capture_epoch",) if c in frames.columns)]
    before = Window.partitionBy(*keys).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce((F.col("seq") > F.max("seq").over(before)) & (F.col(time) > F.max(time).over(before)), F.lit(True))
    return frames.withColumn("_ok", ok).filter("_ok").drop("_ok")


def quiet_run(frames: DataFrame, least_ms: float = 2000.0) -> DataFrame:
    """The first quiet stretch of ``least_ms`` of each session, and its noise floor (median rms, at least 1e-4)."""
    order = Window.partitionBy("session_id").orderBy("seq")
    f = frames.withColumn("_ok", ~F.col("speech_active") & (F.col("block_gap_ms") <= 40) & (F.col("clipped_sample_fraction") <= 0.01) & (F.abs("dc_offset") <= 0.02))
    f = f.withColumn("_run", F.sum((~F.col("_ok")).cast("int")).over(order)).filter("_ok")
    start = F.min("t_ms").over(Window.partitionBy("session_id", "_run"))
    f = f.withColumn("_in", F.col("t_ms") - start)
    done = f.filter(F.col("_in") >= least_ms).groupBy("session_id", "_run").agg(F.min("t_ms").alias("end_ms"))
    first = done.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("end_ms"))).filter("_n = 1").drop("_n")
    r = f.join(first, ["session_id", "_run"]).filter("t_ms <= end_ms").groupBy("session_id").agg(F.min("t_ms").alias("start_ms"), F.first("end_ms").alias("end_ms"), F.median("rms").alias("rms"))
    return r.select("session_id", "start_ms", "end_ms", F.greatest(F.lit(1e-4), "rms").alias("noise_floor"))


def face_calibration(frames: DataFrame) -> DataFrame:
    """Duration, usable share, rate and baseline medians of the latest epoch of each session, and its grade."""
    f = frames.filter(finite("t_ms") & (F.col("t_ms") >= 0))
    f = f.withColumn("_epoch", F.max("capture_epoch").over(Window.partitionBy("session_id"))).filter("capture_epoch = _epoch")
    f = f.withColumn("_usable", visually_sound()).withColumn("_visible", F.col("face_visible") & F.col("box_width_px").isNotNull() & F.col("yaw_deg").isNotNull() & F.col("eye_left").isNotNull() & F.col("mouth_left_x").isNotNull())
    f = f.withColumn("_base", F.when(F.max("_usable").over(Window.partitionBy("session_id")), F.col("_usable")).otherwise(F.col("_visible")))
    base = lambda c: median_or_zero(F.when(F.col("_base"), F.col(c)))
    duration = F.when(F.count("*") < 2, 0.0).otherwise(F.max("t_ms") - F.min("t_ms"))
    c = f.groupBy("session_id").agg(
        duration.alias("duration_ms"), F.count("*").alias("frames"), F.count_if("_usable").alias("usable"), F.count_if("_base").alias("baseline"), median_or_zero(F.col("frame_rate")).alias("reported_rate"),
        base("box_width_px").alias("width_px"), base("box_height_px").alias("height_px"), base("illumination_mean").alias("illumination"), base("sharpness").alias("sharpness"))
    c = c.withColumn("rate", F.when((F.col("frames") >= 2) & (F.col("duration_ms") > 0), (F.col("frames") - 1) * 1000 / F.col("duration_ms")).otherwise(F.col("reported_rate")))
    c = c.withColumn("usable_fraction", F.col("usable") / F.col("frames"))
    strong = (F.col("duration_ms") >= 1500) & (F.col("usable_fraction") >= 0.8) & (F.col("rate") >= 20)
    return c.withColumn("grade", F.when(F.col("baseline") == 0, "unavailable").when(strong, "strong").otherwise("limited")).drop("reported_rate", "baseline")


def calibration_runs(frames: DataFrame) -> DataFrame:
    """Where the calibration of each session's face first becomes strong.

    A frame with none or several faces ends a run and is no part of one; a gap
    over 200 ms and a new capture epoch begin one.  Frames add up within a run
    until it lasts 1.5 s with 80 % of them usable at 20 a second.
    Returns ``session_id, resolved_ms, duration_ms, frames, usable_fraction, rate``.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    single = F.coalesce(F.col("face_count") == 1, F.lit(False))
    breaks = ~single | F.coalesce(F.col("t_ms") - F.lag("t_ms").over(order) > 200, F.lit(False)) | F.coalesce(F.col("capture_epoch") != F.lag("capture_epoch").over(order), F.lit(False))
    f = frames.select("session_id", "seq", "t_ms", single.alias("single"), breaks.alias("breaks"), visually_sound().alias("usable"))
    f = f.withColumn("run", F.count_if("breaks").over(order)).filter("single")
    so_far = Window.partitionBy("session_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    f = f.select("session_id", "t_ms", (F.col("t_ms") - F.min("t_ms").over(so_far)).alias("duration_ms"), F.count("*").over(so_far).alias("frames"), F.count_if("usable").over(so_far).alias("usable"))
    f = f.withColumn("usable_fraction", F.col("usable") / F.col("frames")).withColumn("rate", F.try_divide((F.col("frames") - 1) * 1000, "duration_ms"))
    strong = f.filter((F.col("duration_ms") >= 1500) & (F.col("usable_fraction") >= 0.8) & (F.col("rate") >= 20))
    return strong.groupBy("session_id").agg(F.min_by(F.struct("t_ms", "duration_ms", "frames", "usable_fraction", "rate"), "t_ms").alias("x")).select(
        "session_id", F.col("x.t_ms").alias("resolved_ms"), "x.duration_ms", "x.frames", "x.usable_fraction", "x.rate")


def audio_calibration(reliable: Column, energetic: Column) -> Column:
    return F.when(reliable >= 8, "strong").when(energetic > 0, "limited").otherwise("unavailable")


#: What to tell a person, by the first reason present.
GUIDANCE = (
    (("face-not-visible", "camera-unavailable", "worker-unavailable", "document-hidden"), "Move into view"), (("pose-out-of-range",), "Face the camera"), (("face-too-small",), "Move closer"),
    (("face-too-large",), "Move farther back"), (("face-edge-margin",), "Center your face"), (("illumination-out-of-range",), "Please turn on a light"), (("blur",), "Hold still"),
    (("frame-rate-below-minimum", "visual-frame-gap", "too-many-skipped-frames"), "Camera needs a moment"),
)


def guidance(reasons: Column) -> Column:
    """The advice for the first group of ``GUIDANCE`` that has one of the reasons."""
    group = lambda r: F.coalesce(*(F.when(r.isin(*names), i) for i, (names, _) in enumerate(GUIDANCE, 1)))
    first = F.array_min(F.transform(reasons, group))
    return F.coalesce(F.get(F.array(*(F.lit(text) for _, text in GUIDANCE)), first - 1), F.lit("Face ready"))


def _in_order(frames: DataFrame, order: list[str]) -> DataFrame:
    """Frames of a session next to each other and in order, for a pass over Arrow batches in bounded memory."""
    return frames.repartition("session_id").sortWithinPartitions("session_id", *order)


def throttle(frames: DataFrame, fps: float) -> DataFrame:
    """Frames accepted at most ``fps`` times a second, counted from the last accepted one, which is all that a pass remembers."""
    least = 1000.0 / fps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None  # nothing is accepted yet
        for batch in batches:
            kept = []
            for i, (session, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last is None or session != now or t - last >= least:
                    now, last = session, t
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    f = frames.select("session_id", F.col("t_ms").cast("double").alias("t_ms")).filter("t_ms is not null")
    return _in_order(f, ["t_ms"]).mapInArrow(run, f.schema)


def average(frames: DataFrame, value: str, alpha: float, start: float) -> DataFrame:
    """Exponential average of a series at its end; a pass remembers the running average."""
    f = frames.select("session_id", "seq", F.col(value).cast("double").alias("average"))
    out = f.drop("seq").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, now, acc = False, None, start
        for batch in batches:
            done = []
            for session, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if some and session != now:
                    done.append((now, acc))
                if not some or session != now:
                    some, now, acc = True, session, start
                acc = None if acc is None or v is None else acc * (1 - alpha) + v * alpha
            yield of(done, batch)
            last = batch.slice(0, 0)
        if some:
            yield of([(now, acc)], last)

    def of(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], like.schema.field(0).type), pa.array([a for _, a in done], pa.float64())], ["session_id", "average"])

    return _in_order(f, ["seq", "average"]).mapInArrow(run, out)


def decibels(rms: Column) -> Column:
    return F.when(~finite(rms) | (rms <= 0), -60.0).otherwise(F.least(F.lit(0.0), F.greatest(F.lit(-60.0), 20 * F.log10(rms))))


def signal_to_noise(rms: Column, floor: Column) -> Column:
    return F.when(rms <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 20 * F.log10(rms / F.greatest(F.lit(1e-4), floor))))


def live_state(active: Column, periodic: Column) -> Column:
    return F.when(active & periodic, "voiced").when(active, "speech-noise").otherwise("quiet")
