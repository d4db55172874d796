"""The nine face metrics: screened five-second bins, time-weighted percentiles, blinks, one outcome per session and metric."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions.gates import visually_sound
from framewright.functions.stats import all_of, clamp01, finite, within
from framewright.functions.tables import settle
from framewright.operators import voice

BIN_MS, MAX_GAP_MS = 5000.0, 200.0
#: The registry of face metrics, in order, with units, the bin value and its percentile.
METRICS = (
    ("ambient.face.eye_aperture.left", "eye-width-ratio"),
    ("ambient.face.eye_aperture.right", "eye-width-ratio"),
    ("ambient.face.eye_aperture.asymmetry", "eye-width-ratio"),
    ("ambient.face.mouth_width", "inter-eye-normalized-distance"),
    ("ambient.face.mouth_aperture.median", "mouth-width-ratio"),
    ("ambient.face.mouth_aperture.p90", "mouth-width-ratio"),
    ("ambient.face.mouth_corner_position.asymmetry", "inter-eye-normalized-distance"),
    ("ambient.face.landmark_speed.p90", "inter-eye-distances/second"),
    ("ambient.face.blink_rate.bilateral", "events/minute"),
)
PERCENTILES = (0.9, 0.9, 0.5, 0.5, 0.5, 0.9, 0.5, 0.9)


def mouth_width() -> Column:
    return F.hypot(F.col("mouth_left_x") - F.col("mouth_right_x"), F.col("mouth_left_y") - F.col("mouth_right_y"))


def corner_asymmetry() -> Column:
    """Distance of the left corner from the right one's mirror image."""
    return F.hypot(F.col("mouth_left_x") + F.col("mouth_right_x"), F.col("mouth_left_y") - F.col("mouth_right_y"))


def eye_asymmetry() -> Column:
    return F.abs(F.col("eye_left") - F.col("eye_right"))


def size() -> Column:
    return F.sqrt(F.col("box_width_px") * F.col("box_height_px"))


def size_usable() -> Column:
    """Box within a fifth of the calibrated one on both sides."""
    w, h = F.try_divide("box_width_px", "baseline_width_px"), F.try_divide("box_height_px", "baseline_height_px")
    return within(w, 0.8, 1.2) & within(h, 0.8, 1.2)


def complete_geometry() -> Column:
    positive = lambda c: within(c, 0.0)
    return all_of(positive("eye_left"), positive("eye_right"), finite("mouth_left_x"), finite("mouth_left_y"), finite("mouth_right_x"), finite("mouth_right_y"), positive("mouth_aperture"))


def usable() -> Column:
    near = lambda c, limit: within(c, -limit, limit)
    return all_of(
        F.col("face_count") == 1, F.length("track_segment_id") > 0, visually_sound(), near("yaw_deg", 7), near("pitch_deg", 10), near("roll_deg", 5),
        size_usable(), complete_geometry())


def screened(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames in range with their bin, gap within the bin and usability, ordered by time and sequence."""
    start = F.col("session_started_at_ms")
    f = frames.join(sessions, "session_id").filter(finite("t_ms") & (F.col("t_ms") >= start) & (F.col("t_ms") < start + 300_000))
    f = f.withColumn("bin", F.floor((F.col("t_ms") - start) / BIN_MS)).withColumn("usable", usable())
    f = f.withColumn("attributed", all_of(F.col("face_count") == 1, F.length("track_segment_id") > 0))
    order = Window.partitionBy("session_id", "bin").orderBy("t_ms", "seq")
    return f.withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(order)).withColumn("place", F.row_number().over(order)).withColumn("size", size())


def _stretches(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each stretch of equal values."""
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.empty(0, int)
    return begins, np.diff(np.append(begins, len(groups)))


def _step_percentiles(bins_: np.ndarray, values: np.ndarray, times: np.ndarray, steps: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Bins, and of each the first value, in ascending order, at which its samples' durations add up to ``p`` of all.

    Samples are sorted by bin and time; the last one of a bin lasts its ``step``.
    Each bin is a row of its own, so sums are those of the bin alone.
    """
    begins, sizes = _stretches(bins_)
    weights = np.maximum(np.append(times[1:], 0.0) - times, 0.0)
    weights[begins + sizes - 1] = steps[begins + sizes - 1]
    there = np.arange(sizes.max()) < sizes[:, None]
    by_value, lasts = np.full(there.shape, np.inf), np.zeros(there.shape)
    by_value[there], lasts[there] = values, weights
    order = np.argsort(by_value, axis=1, kind="stable")
    total = np.cumsum(np.take_along_axis(lasts, order, axis=1), axis=1)
    hit = (total >= total[:, -1:] * p).argmax(axis=1)
    rows = np.arange(len(sizes))
    return bins_[begins], by_value[rows, order[rows, hit]]


def _percentile(values: np.ndarray, p: float) -> float:
    """Between the two nearest ranks, weighed as Spark's ``percentile`` does."""
    v, place = np.sort(values), (len(values) - 1) * p
    low, high = int(np.floor(place)), int(np.ceil(place))
    return v[low] if v[low] == v[high] else (high - place) * v[low] + (place - low) * v[high]


def _quantiles(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, p: float) -> np.ndarray:
    """``_percentile`` of each stretch of values, which is sorted."""
    place = (sizes - 1) * p
    low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
    a, b = values[begins + low], values[begins + high]
    return np.where(a == b, a, (high - place) * a + (place - low) * b)


def _spread(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, median absolute deviation (of two values at least) and number of each column; NaN is no value."""
    there = np.count_nonzero(~np.isnan(values), axis=0)

    def middle(v: np.ndarray) -> np.ndarray:
        v = np.vstack((np.sort(v, axis=0), np.full(v.shape[1], np.nan)))  # NaN comes last; the row added is for columns without values
        return _quantiles(v.T.ravel(), np.arange(v.shape[1]) * len(v), np.maximum(there, 1), 0.5)

    mid = middle(values)
    return mid, np.where(there >= 2, middle(np.abs(values - mid)), np.nan), there


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's distinct values (-1 for null), and these values."""
    d = column.combine_chunks().dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False), d.dictionary


def _blink_bins(x: dict[str, np.ndarray]) -> list[int]:
    """The bin of each blink of a session's frames in order; frames at which nothing can begin are passed over."""
    t, bins_, left, right = x["t_ms"], x["bin"], x["eye_left"], x["eye_right"]
    l, r = _percentile(left, 0.9), _percentile(right, 0.9)
    closed, back = (left <= l * 0.6) & (right <= r * 0.6), (left >= l * 0.8) & (right >= r * 0.8)
    step = np.diff(bins_)
    broken = np.append(False, ((step != 0) & (step != 1)) | (np.diff(t) > 75))
    starts, hits, accepted, at = np.flatnonzero(closed), [], float("-inf"), 0
    while True:
        more = starts[np.searchsorted(starts, at):]
        more = more[t[more] - accepted >= 150]
        if not len(more):
            return hits
        opened, wait, at = t[more[0]], False, int(more[0]) + 1
        while at < len(t) and not broken[at]:
            elapsed, at = t[at] - opened, at + 1
            if wait or elapsed > 800:
                if wait and back[at - 1]:
                    break
                wait = True
            elif back[at - 1]:
                if elapsed >= 50:
                    accepted = t[at - 1]
                    hits.append(int(bins_[at - 1]))
                break


#: What a bin must have one of.
ONE = ("processor_ref", "track_segment_id", "capture_epoch")
#: Columns of a qualifying bin and of a session's row.
BIN = ("bin long, frames long, duration_ms double, span_ms double, step double, size_ratio double, cadence_hz double, start_ms double, blinks long, "
       "processor_ref string, track_segment_id string, capture_epoch {epoch}, values array<double>")
SUMMARY = (
    "session_id {session}, observed_start_ms double, observed_end_ms double, unattributed long, seen_processors array<string>, seen_tracks array<string>, bins long, exposure_ms double, frames long, blinks long, "
    "processors long, tracks long, span_ms double, gap_p95 double, cadence double, coverage double, steady double, pose double, mid array<double>, mid_mad array<double>, mid_n array<long>, kept array<struct<" + BIN.replace(" ", ": ").replace(",:", ",") + ">>")


#: Numbers of a frame, NaN for none; they go to Python as one array, since Spark measures a batch after each row, column by column.
NUMBERS = ("bin", "t_ms", "usable", "attributed", "started", "size", "pose", "left", "right", "width", "aperture", "corners", "moving")
BIN_COLUMNS, SUMMARY_COLUMNS = ([c.split()[0] for c in text.split("struct")[0].split(", ")] for text in (BIN, SUMMARY))


def _series() -> dict[str, Column]:
    """What bins have percentiles of; a speed counts if its frame follows another one of the bin, which the pass over the session knows."""
    gap, speed = F.col("inter_result_gap_ms"), F.col("movement_speed")
    moving = F.when((gap > 0) & (gap <= MAX_GAP_MS) & finite(speed) & (speed >= 0), speed)
    series = {"left": F.col("eye_left"), "right": F.col("eye_right"), "width": mouth_width(), "aperture": F.col("mouth_aperture"), "corners": corner_asymmetry(), "moving": moving}
    return {c: F.when(finite(x), x) for c, x in series.items()}


def _qualifying(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Qualifying bins of a session's frames in order, and the frames of these bins, with their gap within the bin."""
    x = x | {"gap": np.diff(x["t_ms"], prepend=np.nan)}
    begins, sizes = _stretches(x["bin"])
    x["gap"][begins] = np.nan
    ok = (sizes >= 80) & np.logical_and.reduceat(x["usable"], begins)
    for c in ONE:  # null beside one value is no second one
        ok &= np.minimum.reduceat(np.where(x[c] < 0, np.iinfo(x[c].dtype).max, x[c]), begins) == np.maximum.reduceat(x[c], begins)
    span = x["t_ms"][begins + sizes - 1] - x["t_ms"][begins]
    ok &= (np.fmin.reduceat(x["gap"], begins) > 0) & (np.fmax.reduceat(x["gap"], begins) <= MAX_GAP_MS) & (span >= 4800)
    own = {c: np.maximum.reduceat(x[c], begins)[ok] for c in ONE} | {"bin": x["bin"][begins][ok], "frames": sizes[ok], "span_ms": span[ok]}
    x = {c: v[np.repeat(ok, sizes)] for c, v in x.items()}
    begins, sizes = _stretches(x["bin"])
    if len(begins):
        gaps, of_size = (v[np.lexsort((v, x["bin"]))] for v in (x["gap"], x["size"]))
        own["step"] = _quantiles(gaps, begins, sizes - 1, 0.5)
        own["duration_ms"] = np.minimum(BIN_MS, np.floor((np.add.reduceat(np.nan_to_num(x["gap"]), begins) + own["step"]) * 1000 + 0.5) / 1000)
        low, high = _quantiles(of_size, begins, sizes, 0.1), _quantiles(of_size, begins, sizes, 0.9)
        own["size_ratio"] = np.divide(high, low, out=np.full(len(low), np.inf), where=low > 0)
        ok = (own["duration_ms"] >= 4000) & (own["size_ratio"] <= 1.15)
        own, x = {c: v[ok] for c, v in own.items()}, {c: v[np.repeat(ok, sizes)] for c, v in x.items()}
    return own, x


def _values(own: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> np.ndarray:
    """The time-weighted percentile of each qualifying bin and metric, NaN where no frame of the bin has the series."""
    _, sizes = _stretches(x["bin"])
    of, steps = np.repeat(np.arange(len(sizes)), sizes), np.repeat(own["step"], sizes)
    x = x | {"eyes": np.abs(x["left"] - x["right"]), "moving": np.where(np.isnan(x["gap"]), np.nan, x["moving"])}
    found = np.full((len(sizes), len(PERCENTILES)), np.nan)
    for i, (c, p) in enumerate(zip(("left", "right", "eyes", "width", "aperture", "aperture", "corners", "moving"), PERCENTILES, strict=True)):
        there = ~np.isnan(x[c])
        if there.any():
            bins_, value = _step_percentiles(of[there], x[c][there], x["t_ms"][there], steps[there], p)
            found[bins_, i] = value
    return found


def _summary(key: tuple, frames: pa.Table) -> pa.Table:
    """All that outcomes and evidence of a session take from its frames."""
    x = dict(zip(NUMBERS, np.ascontiguousarray(frames["numbers"].combine_chunks().flatten().to_numpy().reshape(frames.num_rows, -1).T), strict=True))
    x |= {"bin": x["bin"].astype("int64"), "usable": x["usable"] > 0, "attributed": x["attributed"] > 0}
    names = {}
    for c in ONE:
        x[c], names[c] = _numbered(frames[c])
    order = np.argsort(x["t_ms"], kind="stable")  # frames of equal times end their bin, in whatever order
    own, y = _qualifying({c: v[order] for c, v in x.items()})
    n = len(own["bin"])
    row = {
        "session_id": key[0], "observed_start_ms": x["t_ms"].min(), "observed_end_ms": x["t_ms"].max(), "unattributed": np.count_nonzero(~x["attributed"]),
        "seen_processors": sorted(v for v in names["processor_ref"].to_pylist() if v is not None), "seen_tracks": sorted(v for v in names["track_segment_id"].to_pylist() if v), "bins": n}
    many = {"mid": np.empty(0), "mid_mad": np.empty(0), "mid_n": np.empty(0, "int64")}
    if n:
        hits = np.asarray(_blink_bins({"t_ms": y["t_ms"], "bin": y["bin"], "eye_left": y["left"], "eye_right": y["right"]}), "int64")
        own |= {"cadence_hz": own["frames"] / (own["duration_ms"] / 1000), "start_ms": x["started"][0] + own["bin"] * BIN_MS, "blinks": np.bincount(np.searchsorted(own["bin"], hits), minlength=n)}
        values = _values(own, y)
        many = dict(zip(many, _spread(np.column_stack((values, own["blinks"] / (BIN_MS / 60_000)))), strict=True))
        row |= {
            "exposure_ms": own["duration_ms"].sum(), "frames": own["frames"].sum(), "blinks": len(hits), "processors": len(set(own["processor_ref"])), "tracks": len(set(zip(own["capture_epoch"], own["track_segment_id"], strict=True))),
            "span_ms": own["start_ms"][-1] + BIN_MS - own["start_ms"][0], "gap_p95": _percentile(y["gap"][~np.isnan(y["gap"])], 0.95), "cadence": _percentile(own["cadence_hz"], 0.5),
            "coverage": _percentile(own["duration_ms"] / BIN_MS, 0.5), "steady": _percentile(np.clip(1 - (own["size_ratio"] - 1) / (1.15 - 1), 0, 1), 0.5), "pose": _percentile(y["pose"], 0.5)}
    else:
        own |= dict.fromkeys(("step", "duration_ms", "size_ratio", "cadence_hz", "start_ms"), np.empty(0)) | {"blinks": np.empty(0, "int64")}
        values = np.empty((0, len(PERCENTILES)))
        row |= dict.fromkeys(("exposure_ms", "frames", "blinks", "processors", "tracks", "span_ms", "gap_p95", "cadence", "coverage", "steady", "pose"))
    lists = lambda v: pa.array(np.ravel(v), from_pandas=True)
    fields = {c: names[c].take(pa.array(own[c])) if c in ONE else pa.array(own[c]) for c in BIN_COLUMNS[:-1]}
    fields["values"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], "int32"), lists(values))
    whole = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], "int32"), lists(v)) for c, v in many.items()}
    whole["kept"] = pa.ListArray.from_arrays(pa.array([0, n], "int32"), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    kinds = {"unattributed": "int64", "bins": "int64", "frames": "int64", "blinks": "int64", "processors": "int64", "tracks": "int64", "seen_processors": pa.list_(pa.string()), "seen_tracks": pa.list_(pa.string())}
    return pa.table({c: pa.array([v.as_py()], v.type) if c == "session_id" else pa.array([v], kinds.get(c, "float64")) for c, v in row.items()} | whole).select(SUMMARY_COLUMNS)


def summaries(frames: DataFrame) -> DataFrame:
    """One row per session of screened frames: its qualifying bins (``kept``), and all that outcomes and evidence take from its frames.

    A bin qualifies with at least 80 frames, all usable, of one processor, track
    and epoch, no gap beyond 200 ms, 4.8 s long, steady in size.  Its ``values``
    are time-weighted percentiles; a sample lasts up to the next frame of the
    bin that has the series.  A session (at most 300 s of frames) is read once,
    by one task; only this row of it is shuffled and written afterwards.
    """
    pose = clamp01(1 - F.greatest(F.abs("yaw_deg") / 7, F.abs("pitch_deg") / 10, F.abs("roll_deg") / 5))
    columns = {c: F.col(c) for c in ("bin", "t_ms", "usable", "attributed")} | {"started": F.col("session_started_at_ms"), "size": size(), "pose": pose} | _series()
    f = frames.select("session_id", *ONE, F.array(*(F.coalesce(columns[c].cast("double"), F.lit(float("nan"))) for c in NUMBERS)).alias("numbers"))
    kinds = {"session": frames.schema["session_id"].dataType.simpleString(), "epoch": frames.schema["capture_epoch"].dataType.simpleString()}
    return f.groupBy("session_id").applyInArrow(_summary, SUMMARY.format(**kinds))


def _bins_of(ready: DataFrame) -> DataFrame:
    return ready.select("session_id", F.inline("kept"))


def bins(frames: DataFrame) -> DataFrame:
    """Qualifying bins of screened frames, with their values and blinks."""
    return _bins_of(summaries(frames))


def bin_values(frames: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """One row per qualifying bin and metric: its time-weighted percentile.  ``kept`` are the frames' ``bins``, if they are at hand."""
    values = (bins(frames) if kept is None else kept).select("session_id", "bin", F.posexplode("values").alias("ordinal", "value"))
    return values.filter("value is not null")


def blinks(frames: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Blinks of each qualifying bin, from a pass over a session's frames in order.

    References are the plain 90th percentiles of both apertures over all
    qualifying frames.  A closure begins when both eyes are at 60 % or below, at
    least 150 ms after the last blink, and is a blink if both are back at 80 %
    after 50 to 800 ms; a longer one counts for nothing until the eyes are back.
    A missing bin or a gap over 75 ms starts over.
    """
    return (bins(frames) if kept is None else kept).select("session_id", "bin", "blinks")


def prepared(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """``summaries`` of frames, computed once for outcomes and evidence."""
    return settle(summaries(screened(frames, sessions)))


def evidence(frames: DataFrame, sessions: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """What the face outcomes of each session rest on; each qualifying bin is one window.  ``ready`` is what ``prepared`` made of the frames, if it is at hand."""
    ready = prepared(frames, sessions) if ready is None else ready
    kept = _bins_of(ready).withColumn("bin_end_ms", F.col("start_ms") + BIN_MS).withColumn("ref", voice.window_ref("start_ms", "bin_end_ms", "face"))
    return voice.gathered(sessions, ready, kept).withColumnRenamed("_tracks", "segment_count").drop("_pieces")


def quality_score() -> Column:
    score = 0.3 * clamp01(F.col("cadence") / 30) + 0.3 * clamp01(F.col("coverage")) + 0.2 * F.col("steady") + 0.2 * F.col("pose")
    return clamp01(score)


def face_outcomes(frames: DataFrame, sessions: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """Exactly one row per session and face metric, like ``voice_outcomes``; counts: ``bins, exposure_ms, frames, blinks``."""
    s = sessions.join((prepared(frames, sessions) if ready is None else ready).drop("kept"), "session_id", "left")
    zero = ("bins", "exposure_ms", "frames", "blinks", "unattributed")
    s = s.select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero else F.col(c) for c in s.columns)).withColumn("quality_score", F.when(F.col("bins") > 0, quality_score()))
    registry = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(code).alias("code"), F.lit(unit).alias("unit")) for i, (code, unit) in enumerate(METRICS)))
    s = s.withColumn("m", F.explode(registry)).select("*", "m.*").drop("m").withColumns({c: F.get(c, F.col("ordinal")) for c in ("mid", "mid_mad", "mid_n")})
    f, blinking = F.col, F.col("ordinal") == 8
    positive = lambda c: finite(c) & (f(c) > 0)
    calibrated = all_of(f("calibration_duration_ms") >= 1500, positive("baseline_width_px"), positive("baseline_height_px"))
    reason = (
        F.when(~calibrated, "quality-threshold-failed").when((f("bins") == 0) & (f("unattributed") > 0), "multiple-faces").when(f("bins") == 0, "no-usable-signal")
        .when((f("processors") > 1) | (f("tracks") > 1), "quality-threshold-failed").when(f("bins") < 3, "insufficient-bins").when(f("span_ms") < 30_000, "insufficient-duration")
        .when(~blinking & (F.coalesce("mid_n", F.lit(0)) < 3), "insufficient-bins").when(blinking & (f("exposure_ms") < 60_000), "insufficient-exposure")
        .when(blinking & (f("frames") / (f("exposure_ms") / 1000) < 24), "insufficient-frame-cadence").when(blinking & (f("gap_p95") > 75), "quality-threshold-failed"))
    s = s.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    value = F.when(blinking, f("blinks") / (f("exposure_ms") / 60_000)).otherwise(f("mid"))
    return s.select(
        "session_id", "ordinal", "code", "unit", F.when(ok, "measured").otherwise("withheld").alias("status"), F.when(ok, value).alias("value"), F.when(ok, f("quality_score")).alias("quality_score"),
        F.when(ok, f("mid_mad")).alias("dispersion"), "reason", "bins", "exposure_ms", "frames", "blinks")
