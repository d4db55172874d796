"""Technical quality of single frames as reason lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.stats import LARGEST, finite, within

#: Visual reasons in the order in which they are reported; others are dropped.
VISUAL_ORDER = (
    "document-hidden", "camera-unavailable", "worker-unavailable", "face-not-visible", "face-too-small", "face-too-large", "face-edge-margin",
    "pose-out-of-range", "illumination-out-of-range", "blur", "frame-rate-below-minimum", "visual-frame-gap", "too-many-skipped-frames",
)
#: Limits of the visual policy.
VISUAL_POLICY = {
    "frame_rate": 20.0, "gap_ms": 200.0, "skipped": 0.25, "width_px": 180.0, "height_px": 220.0, "width": 0.7, "height": 0.9, "edge": 0.02,
    "yaw": 15.0, "pitch": 15.0, "roll": 10.0, "light_low": 0.12, "light_high": 0.9, "dark": 0.2, "bright": 0.2, "sharpness": 0.0008, "sharpness_share": 0.5,
}
#: Reasons that make audio unusable for timing, for general and for fine measurement.
TIMING_BLOCKERS = ("microphone-unavailable", "audio-worklet-unavailable", "audio-frame-gap", "signal-too-quiet", "audio-clipping", "voice-worker-unavailable")
GENERAL_BLOCKERS = (*TIMING_BLOCKERS, "snr-below-minimum", "dc-offset")
FINE_BLOCKERS = (*GENERAL_BLOCKERS, "sample-rate-below-minimum", "audio-processing-enabled")


def _reasons(given: Column, *derived: tuple[Column, str]) -> Column:
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in derived)))
    return F.array_union(F.coalesce(given, F.array().cast("array<string>")), found)


def _visual_flaws(baseline_sharpness: Column | None = None) -> dict[str, Column]:
    """Which reasons a face frame's values give; false rather than null."""
    f, p = F.col, VISUAL_POLICY
    floor = F.greatest(F.lit(p["sharpness"]), F.coalesce(baseline_sharpness * p["sharpness_share"], F.lit(0.0))) if baseline_sharpness is not None else F.lit(p["sharpness"])
    present = f("face_visible") & f("box_width_px").isNotNull() & f("yaw_deg").isNotNull() & f("eye_left").isNotNull() & f("mouth_left_x").isNotNull()
    below = lambda c, limit: ~within(c, limit, LARGEST)
    above = lambda c, limit: ~within(c, -LARGEST, limit)
    off = lambda c, limit: ~within(c, -limit, limit)
    derived = {
        "face-not-visible": ~F.coalesce(present, F.lit(False)), "face-too-small": present & (below("box_width_px", p["width_px"]) | below("box_height_px", p["height_px"])),
        "face-too-large": present & (above("box_width", p["width"]) | above("box_height", p["height"])), "face-edge-margin": present & below("edge_margin", p["edge"]),
        "pose-out-of-range": present & (off("yaw_deg", p["yaw"]) | off("pitch_deg", p["pitch"]) | off("roll_deg", p["roll"])),
        "illumination-out-of-range": below("illumination_mean", p["light_low"]) | above("illumination_mean", p["light_high"]) | above("dark_clipping", p["dark"]) | above("bright_clipping", p["bright"]),
        "blur": ~finite("sharpness") | (f("sharpness") < floor), "frame-rate-below-minimum": below("frame_rate", p["frame_rate"]),
        "visual-frame-gap": f("inter_result_gap_ms").isNotNull() & above("inter_result_gap_ms", p["gap_ms"]), "too-many-skipped-frames": above("skipped_fraction", p["skipped"])}
    return {r: F.coalesce(c, F.lit(False)) for r, c in derived.items()}


def visual_reasons(baseline_sharpness: Column | None = None) -> Column:
    """Reasons against a face frame, in reporting order; values that are not finite fail their limit."""
    flaws, given = _visual_flaws(baseline_sharpness), lambda r: F.coalesce(F.array_contains("quality_reasons", r), F.lit(False))
    return F.array_compact(F.array(*(F.when(flaws.get(r, F.lit(False)) | given(r), F.lit(r)) for r in VISUAL_ORDER)))


def visual_mask(baseline_sharpness: Column | None = None) -> Column:
    """What a frame's values alone give for ``visual_reasons``, a bit for each in reporting order: plain comparisons, so frames are counted before lists are made."""
    flaws = _visual_flaws(baseline_sharpness)
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(flaws[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(VISUAL_ORDER) if r in flaws))


def reasons_of(mask: Column) -> Column:
    """``visual_reasons`` of frames with this ``visual_mask`` and these ``quality_reasons``."""
    given = lambda r: F.coalesce(F.array_contains("quality_reasons", r), F.lit(False))
    return F.array_compact(F.array(*(F.when((mask.bitwiseAND(F.lit(1 << i)) != 0) | given(r), F.lit(r)) for i, r in enumerate(VISUAL_ORDER))))


def visually_sound() -> Column:
    """Whether ``visual_reasons`` is empty, without its list."""
    given = F.coalesce(F.arrays_overlap("quality_reasons", F.array(*map(F.lit, VISUAL_ORDER))), F.lit(False))
    return ~reduce(lambda a, b: a | b, _visual_flaws().values(), given)


def voice_reasons(processing: Column) -> Column:
    """Reasons against a voice frame; NaN adds none."""
    f = F.col
    over = lambda c, limit: ~F.isnan(c) & (f(c) > limit)
    under = lambda c, limit: ~F.isnan(c) & (f(c) < limit)
    return _reasons(
        f("quality_reasons"), (over("block_gap_ms", 40) | over("lost_block_fraction", 0.05), "audio-frame-gap"), (under("sample_rate_hz", 44_100), "sample-rate-below-minimum"),
        (processing, "audio-processing-enabled"), (under("snr_db", 15), "snr-below-minimum"), (under("rms", 0.003), "signal-too-quiet"),
        (over("clipped_sample_fraction", 0.01), "audio-clipping"), (~F.isnan("dc_offset") & (F.abs("dc_offset") > 0.02), "dc-offset"))


def free_of(reasons: Column, blockers: tuple[str, ...]) -> Column:
    return ~F.arrays_overlap(reasons, F.array(*(F.lit(b) for b in blockers)))
