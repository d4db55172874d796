"""Face geometry from landmark arrays: eye-based coordinates, apertures, and movement between frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.functions.gates import visual_reasons
from framewright.functions.stats import finite
from framewright.operators import kernels

#: Landmark numbers of the subject's left and right eye (corners, lid pairs), of the mouth, and of the points whose movement counts.
LEFT_EYE, RIGHT_EYE = ((362, 263), ((385, 380), (387, 373))), ((33, 133), ((160, 144), (158, 153)))
LEFT_CORNER, RIGHT_CORNER, UPPER_LIP, LOWER_LIP = 291, 61, 13, 14
MOVING = (33, 133, 362, 263, 61, 291, 13, 14, 70, 300)


def pixel(points: Column, number: int, width: Column | float, height: Column | float) -> Column:
    """A landmark in pixels; null if the array is too short or the point is not finite or lies outside the image (0 to 1)."""
    p = F.get(points, F.lit(number))
    return F.when(p.x.between(0, 1) & p.y.between(0, 1), F.struct((p.x * width).alias("x"), (p.y * height).alias("y")))


def _gap(a: Column, b: Column) -> Column:
    return F.hypot(a.x - b.x, a.y - b.y)


def _middle(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(((a.x + b.x) / 2).alias("x"), ((a.y + b.y) / 2).alias("y")))


def coordinates(points: Column, width: Column | float, height: Column | float) -> Column:
    """Middle, distance and angle between the centres of the eyes; null if a corner is missing or the eyes coincide."""
    left, right = (_middle(*(pixel(points, i, width, height) for i in eye[0])) for eye in (LEFT_EYE, RIGHT_EYE))
    centre = _middle(left, right)
    system = F.struct(centre.x.alias("x"), centre.y.alias("y"), _gap(left, right).alias("scale"), F.atan2(left.y - right.y, left.x - right.x).alias("angle"))
    return F.when(_gap(left, right) > 0, system)


def normalized(p: Column, system: Column) -> Column:
    """A pixel in eye coordinates: moved, turned back and scaled."""
    x, y, cos, sin = p.x - system.x, p.y - system.y, F.cos(system.angle), F.sin(system.angle)
    good = p.isNotNull() & system.isNotNull()
    return F.when(good, F.struct(((cos * x + sin * y) / system.scale).alias("x"), ((cos * y - sin * x) / system.scale).alias("y")))


def eye_aperture(points: Column, eye: tuple, width: Column | float, height: Column | float) -> Column:
    """Mean of the two lid gaps over the distance of the corners."""
    at = lambda i: pixel(points, i, width, height)
    corners, lids = eye
    across = _gap(*map(at, corners))
    return F.when(across > 0, sum(_gap(*map(at, pair)) for pair in lids) / 2 / across)


def mouth_aperture(points: Column, width: Column | float, height: Column | float) -> Column:
    """Gap of the inner lips over the distance of the corners."""
    at = lambda i: pixel(points, i, width, height)
    across = _gap(at(LEFT_CORNER), at(RIGHT_CORNER))
    return F.when(across > 0, _gap(at(UPPER_LIP), at(LOWER_LIP)) / across)


def motion_points(points: Column, system: Column, width: Column | float, height: Column | float) -> Column:
    """The points whose movement counts, in eye coordinates; null if one is missing."""
    every = F.array(*(normalized(pixel(points, i, width, height), system) for i in MOVING))
    return F.when(F.forall(every, lambda p: p.isNotNull()), every)


def features(frames: DataFrame, points: str, width: Column | float, height: Column | float) -> DataFrame:
    """Adds the geometry of each frame: ``system, eye_left, eye_right, mouth_aperture, mouth_left, mouth_right, motion``."""
    p = F.col(points)
    framed = frames.withColumn("system", coordinates(p, width, height))
    corner = lambda i: normalized(pixel(p, i, width, height), F.col("system"))
    return framed.select(
        "*", eye_aperture(p, LEFT_EYE, width, height).alias("eye_left"), eye_aperture(p, RIGHT_EYE, width, height).alias("eye_right"), mouth_aperture(p, width, height).alias("mouth_aperture"),
        corner(LEFT_CORNER).alias("mouth_left"), corner(RIGHT_CORNER).alias("mouth_right"), motion_points(p, F.col("system"), width, height).alias("motion"))


def movement_speed(frames: DataFrame, keys: list[str], order: str, eligible: Column) -> DataFrame:
    """Adds ``movement_speed``: mean way of the motion points since the frame before, in eye distances a second.

    The frame before counts only if it was ``eligible``; its motion points are all
    that is carried.  Null without it, or if time (``acquired_at_ms``) did not pass.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    kept = F.when(eligible, F.struct("motion", F.col("acquired_at_ms").alias("at")))
    f = frames.withColumn("_before", F.lag(kept).over(w))
    seconds = (F.col("acquired_at_ms") - F.col("_before.at")) / 1000
    ways = F.zip_with("motion", F.col("_before.motion"), lambda a, b: F.hypot(a.x - b.x, a.y - b.y))
    mean = F.aggregate(ways, F.lit(0.0), lambda t, x: t + x) / F.size(ways)
    return f.withColumn("movement_speed", F.when((seconds > 0) & F.col("motion").isNotNull() & F.col("_before.motion").isNotNull(), mean / seconds)).drop("_before")


def continuity_eligible(calibrated: Column) -> Column:
    """Whether a face frame may carry movement on: no reasons, pose and gap within limits, and a box near the calibrated one, if there is one."""
    f = F.col
    near = lambda size, base: F.abs(f(size) / f(base) - 1) <= 0.2
    held = (
        (F.size("quality_reasons") == 0) & finite("yaw_deg") & finite("box_width_px") & (F.abs("yaw_deg") <= 7) & (F.abs("pitch_deg") <= 10) & (F.abs("roll_deg") <= 5)
        & (f("inter_result_gap_ms").isNull() | (f("inter_result_gap_ms") <= 200)))
    sized = near("box_width_px", "baseline_width_px") & near("box_height_px", "baseline_height_px")
    return F.coalesce(held & (~calibrated | sized), F.lit(False))


def composed(frames: DataFrame, points: str, matrix: str, width: Column | float, height: Column | float) -> DataFrame:
    """The whole frame of each landmark result: box, pose, apertures, corners, motion, quality reasons and ``usable``.

    ``frames`` carry what the image and the pace say (``illumination_mean,
    dark_clipping, bright_clipping, sharpness, frame_rate, inter_result_gap_ms,
    skipped_fraction``).  No landmarks, or one outside the image, mean no face:
    all of its geometry is then null.  Eyes are given both or not at all, and so
    are the corners of the mouth.
    """
    f = F.col
    box = kernels.bounding_box(f(points), F.lit(width) if isinstance(width, float) else width, F.lit(height) if isinstance(height, float) else height)
    d = features(frames.withColumn("_box", box), points, width, height).withColumn("_pose", kernels.pose(f(matrix)))
    face = f("_box").isNotNull()
    both = lambda a, b, value: F.when(face & a.isNotNull() & b.isNotNull(), value)
    eyes, mouth = (f("eye_left"), f("eye_right")), (f("mouth_left"), f("mouth_right"))
    d = d.withColumns({
        "face_visible": face, **{c: f(f"_box.{b}") for c, b in {"box_width_px": "width_px", "box_height_px": "height_px", "box_width": "width", "box_height": "height", "edge_margin": "edge_margin"}.items()},
        **{c: F.when(face, f(f"_pose.{c}")) for c in ("yaw_deg", "pitch_deg", "roll_deg")}, "eye_left": both(*eyes, eyes[0]), "eye_right": both(*eyes, eyes[1]),
        **{f"mouth_{side}_{k}": both(*mouth, p[k]) for side, p in zip(("left", "right"), mouth, strict=True) for k in ("x", "y")},
        "mouth_aperture": F.when(face, f("mouth_aperture")), "motion": F.when(face, f("motion")), "quality_reasons": F.array().cast("array<string>")})
    d = d.withColumn("quality_reasons", visual_reasons())
    return d.withColumn("usable", F.size("quality_reasons") == 0).drop("_box", "_pose", "system", "mouth_left", "mouth_right")
