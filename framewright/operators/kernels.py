"""Array kernels for raw signals: sound windows, images and landmark sets, in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PITCH_RATE, LOW_HZ, HIGH_HZ, BANDS = 8000, 50, 700, 16
ANALYSIS = (
    "rms double, dc_offset double, clipped_sample_fraction double, acf_hz double, acf_confidence double, amdf_hz double, amdf_confidence double, "
    "zero_hz double, zero_confidence double, band_energies array<double>"
)


def downsample(x: np.ndarray, rate: float, target: float = PITCH_RATE) -> np.ndarray:
    """Means of consecutive blocks; unchanged when the rate is no higher than the target."""
    if rate <= target or not len(x):
        return x
    ratio = rate / target
    n = max(1, int(len(x) / ratio))
    start = np.floor(np.arange(n) * ratio).astype(int)
    end = np.minimum(len(x), np.maximum(start + 1, np.floor(np.arange(1, n + 1) * ratio).astype(int)))
    sums = np.concatenate(([0.0], np.cumsum(x, dtype=float)))
    return (sums[end] - sums[start]) / np.maximum(1, end - start)


def _first_good(values: np.ndarray, good: np.ndarray, fallback: int) -> int:
    """First place that is good and no worse than its neighbours; the last place does not count."""
    if len(values) < 2:
        return fallback
    rises = np.concatenate(([True], values[1:] >= values[:-1]))
    falls = np.concatenate((values[:-1] >= values[1:], [False]))
    at = np.flatnonzero(good & rises & falls)
    return int(at[0]) if len(at) else fallback


def lag_pitches(x: np.ndarray, rate: float = PITCH_RATE) -> tuple[tuple[float | None, float], tuple[float | None, float]]:
    """Pitch by normalised autocorrelation and by mean magnitude difference: the earliest local optimum near the best."""
    low, high = max(1, int(rate // HIGH_HZ)), min(len(x) - 2, math.ceil(rate / LOW_HZ))
    if high < low:
        return (None, 0.0), (None, 0.0)
    lags = np.arange(low, high + 1)
    squares = np.concatenate(([0.0], np.cumsum(x * x)))
    cross = np.array([x[:-k] @ x[k:] for k in lags])
    energy = np.sqrt(squares[len(x) - lags] * (squares[-1] - squares[lags]))
    acf = cross / np.maximum(1e-12, energy)
    best = acf.max()
    at = _first_good(acf, acf >= best * 0.92, int(acf.argmax()))
    strength = float(acf[at])
    by_acf = (None, max(0.0, strength)) if strength < 0.35 else (rate / lags[at], min(1.0, max(0.0, strength)))
    gap = np.array([np.abs(x[:-k] - x[k:]).mean() for k in lags])
    mean = gap.mean()
    at = _first_good(-gap, gap <= gap.min() + 0.08 * mean, int(gap.argmin()))
    trust = 0.0 if mean <= 1e-9 else max(0.0, 1 - gap[at] / mean)
    return by_acf, ((None if trust < 0.2 else rate / lags[at]), float(trust))


def zero_pitch(x: np.ndarray, rate: float = PITCH_RATE) -> tuple[float | None, float]:
    """Pitch by the upper median of periods between interpolated upward crossings."""
    at = np.flatnonzero((x[:-1] <= 0) & (x[1:] > 0))
    periods = np.diff(at - x[at] / (x[at + 1] - x[at]))
    periods = np.sort(periods[periods > 0])
    if not len(periods):
        return None, 0.0
    hz, trust = rate / periods[len(periods) // 2], max(0.0, 1 - periods.std() / max(1.0, periods.mean()))
    return (hz if 48 <= hz <= 720 and trust >= 0.6 else None), float(trust)


def band_energies(x: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Energy at single frequencies spread evenly below half the rate."""
    angle = np.outer((np.arange(bands) + 1) / (bands + 1) * np.pi, np.arange(len(x)))
    return ((np.cos(angle) @ x) ** 2 + (np.sin(angle) @ x) ** 2) / max(1, len(x))


def analyse(samples: np.ndarray, rate: float) -> tuple:
    mean = float(samples.mean()) if len(samples) else 0.0
    centred = samples - mean
    x = downsample(centred, rate)
    acf, amdf = lag_pitches(x) if len(x) else ((None, 0.0), (None, 0.0))
    zero = zero_pitch(x) if len(x) > 1 else (None, 0.0)
    rms = float(np.sqrt((centred**2).mean())) if len(samples) else 0.0
    return (rms, mean, float((np.abs(samples) >= 0.98).mean()) if len(samples) else 0.0, *acf, *amdf, *zero, band_energies(x).tolist())


def windows(df: DataFrame, samples: str, rate: float) -> DataFrame:
    """Analyses an array column of samples; adds ``ANALYSIS`` and the resolved pitch. A null array is empty."""
    names = [f.split()[0] for f in ANALYSIS.split(", ")]

    @F.pandas_udf(T.StructType.fromDDL(ANALYSIS))
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [analyse(np.zeros(0) if a is None else np.asarray(a, float), rate) for a in s]
            yield pd.DataFrame(rows, columns=names).astype({c: "float64" for c in names[:-1]})

    out = df.withColumn("_k", kernel(samples)).select("*", "_k.*").drop("_k")
    nan_to_null = {c: F.when(~F.isnan(c), F.col(c)) for c in ("acf_hz", "amdf_hz", "zero_hz")}
    return resolve(out.withColumns(nan_to_null))


def resolve(df: DataFrame) -> DataFrame:
    """``f0_hz, f0_confidence, estimator_agreement`` from the three estimates, in columns.

    Two estimates an octave apart are settled by the crossing estimate if it is
    near exactly one of them; otherwise they must lie within 12 %.
    """
    a, m, z = F.col("acf_hz"), F.col("amdf_hz"), F.col("zero_hz")
    low = F.least("acf_confidence", "amdf_confidence")
    ratio = F.greatest(a, m) / F.least(a, m)
    octave = (F.abs(ratio - 2) <= 0.12) | (F.abs(ratio - 0.5) <= 0.06)
    far = F.abs(a - m) / F.greatest(a, m)
    near = lambda x: F.abs(x - z) / F.greatest(x, z) <= 0.12
    one = octave & z.isNotNull() & (near(a) != near(m))
    chosen, trust = F.when(near(a), a).otherwise(m), F.when(near(a), F.col("acf_confidence")).otherwise(F.col("amdf_confidence"))
    missing, bad = a.isNull() | m.isNull(), (far > 0.12) | octave
    return df.withColumns({
        "f0_hz": F.when(missing, F.lit(None).cast("double")).when(one, (chosen + z) / 2).when(~bad, (a + m) / 2),
        "f0_confidence": F.when(~missing & one, F.least(trust, F.col("zero_confidence"))).otherwise(low),
        "estimator_agreement": F.when(missing, 0.0).when(one, 0.8).when(bad, F.greatest(F.lit(0.0), 1 - far)).otherwise(F.greatest(F.lit(0.0), 1 - far / 0.3))})


def spectral_flux(bands: Column, prior: Column) -> Column:
    """Root mean square of the rises of log energies; 0 without a prior window."""
    rise = F.zip_with(bands, prior, lambda x, y: F.pow(F.greatest(F.lit(0.0), F.log1p(x) - F.log1p(y)), F.lit(2.0)))
    return F.when(prior.isNull(), 0.0).otherwise(F.sqrt(F.aggregate(rise, F.lit(0.0), lambda s, x: s + x) / F.size(bands)))


def sliding(samples: Column, size: int, hop: int) -> Column:
    """Overlapping windows of an array, as an array of arrays; shorter arrays have none."""
    starts = F.when(F.size(samples) >= size, F.sequence(F.lit(1), F.size(samples) - size + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(samples, i, F.lit(size)))


def _fnv(texts: list[str | None], utf16: bool) -> list[str | None]:
    """Hashes of many texts at once: all first units, then all second ones, and so on."""
    code, kind = ("utf-16-le", "<u2") if utf16 else ("utf-8", np.uint8)
    units = [np.frombuffer((t or "").encode(code), kind) for t in texts]
    size = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-size, kind="stable")
    whole, begin = np.concatenate([*units, np.zeros(0, kind)]), (np.cumsum(size) - size)[order]
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)))  # texts that have a unit at each place
    h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    for k, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ whole[begin[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(texts), np.uint64)
    out[order] = h
    return [None if t is None else f"{x:016x}" for t, x in zip(texts, out.tolist(), strict=True)]


def fnv1a(text: Column, utf16: bool = False) -> Column:
    """FNV-1a of 64 bits in hex, over UTF-8 bytes or UTF-16 units; null stays null."""

    @F.pandas_udf(T.StringType())
    def kernel(s: pd.Series) -> pd.Series:
        return pd.Series(_fnv([None if v is None else v for v in s], utf16), dtype=object)

    return kernel(text)


def fnv1a_each(texts: Column) -> Column:
    """The hash of each string of an array; null arrays and entries stay null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def kernel(s: pd.Series) -> pd.Series:
        flat = iter(_fnv([v for row in s if row is not None for v in row], False))
        return pd.Series([None if row is None else [next(flat) for _ in row] for row in s], dtype=object)

    return kernel(texts)


def identity(*parts: Column) -> Column:
    """Length-prefixed parts joined by bars, so that no two lists of parts read alike."""
    return F.concat_ws("|", *(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))


QUALITY = "illumination_mean double, dark_clipping double, bright_clipping double, sharpness double"
#: Side of the square to which a region is drawn before it is judged.
REGION_SIDE = 64


def _quality(rgb: np.ndarray) -> tuple[float, float, float, float]:
    y = rgb @ np.array([0.2126, 0.7152, 0.0722]) / 255
    edge = 4 * y[1:-1, 1:-1] - y[:-2, 1:-1] - y[2:, 1:-1] - y[1:-1, :-2] - y[1:-1, 2:]
    return y.mean(), (y <= 0.02).mean(), (y >= 0.98).mean(), edge.var() if edge.size else 0.0


def drawn(rgb: np.ndarray, x: float, y: float, width: float, height: float, side: int = REGION_SIDE) -> np.ndarray:
    """A region of an image, in pixels, drawn to a square: between the centres of its pixels in proportion, rounded to whole numbers."""
    def places(start: float, size: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(start + (np.arange(side) + 0.5) * size / side - 0.5, max(0.0, start), min(most - 1.0, start + size - 1))
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, most - 1), at - low

    (top, below, down), (left, right, across) = places(y, height, rgb.shape[0]), places(x, width, rgb.shape[1])
    rows = rgb[top].astype(float) * (1 - down)[:, None, None] + rgb[below] * down[:, None, None]
    return np.floor(rows[:, left] * (1 - across)[None, :, None] + rows[:, right] * across[None, :, None] + 0.5)


def region_quality(pixels: Column, width: Column, height: Column, box: Column) -> Column:
    """Quality of the part of an RGBA image in ``box`` (``x, y, width, height`` as shares of the image), or of all of it without one, drawn to 64 by 64.

    Without pixels (null or empty) everything is dark: 0, 1, 0, 0.
    """

    @F.pandas_udf(T.StructType([T.StructField(f.split()[0], T.DoubleType()) for f in QUALITY.split(", ")]))
    def kernel(p: pd.Series, w: pd.Series, h: pd.Series, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw, cols, rows, *part in zip(p, w, h, b["x"], b["y"], b["width"], b["height"], strict=True):
            if not raw:
                out.append((0.0, 1.0, 0.0, 0.0))
                continue
            x, y, dx, dy = (0.0, 0.0, 1.0, 1.0) if np.isnan(np.array(part, float)).any() else part
            x, y = max(0.0, x * cols), max(0.0, y * rows)
            region = x, y, max(1.0, min(cols - x, dx * cols)), max(1.0, min(rows - y, dy * rows))
            out.append(_quality(drawn(np.frombuffer(raw, np.uint8).reshape(rows, cols, 4)[:, :, :3], *region)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in QUALITY.split(", ")], dtype=float)

    whole = F.struct(*(F.coalesce(box[c], F.lit(float("nan"))).alias(c) for c in ("x", "y", "width", "height")))
    return kernel(pixels, width, height, whole)


def image_quality(pixels: Column, width: Column, height: Column) -> Column:
    """Mean luma, dark and bright shares and sharpness (variance of the interior Laplacian) of RGBA bytes."""

    @F.pandas_udf(T.StructType([T.StructField(f.split()[0], T.DoubleType()) for f in QUALITY.split(", ")]))
    def kernel(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = [_quality(np.frombuffer(raw, np.uint8).reshape(rows, cols, 4)[:, :, :3]) for raw, cols, rows in zip(p, w, h, strict=True)]
        return pd.DataFrame(out, columns=[f.split()[0] for f in QUALITY.split(", ")], dtype=float)

    return kernel(pixels, width, height)


def bounding_box(points: Column, width_px: Column, height_px: Column) -> Column:
    """Box of normalised landmarks; null if any is outside [0, 1] or there are none."""
    valid = (F.size(points) > 0) & F.forall(points, lambda p: p.x.between(0, 1) & p.y.between(0, 1))
    lo, hi = (lambda c: F.array_min(F.transform(points, lambda p: p[c]))), (lambda c: F.array_max(F.transform(points, lambda p: p[c])))
    box = F.struct(
        lo("x").alias("x"), lo("y").alias("y"), (hi("x") - lo("x")).alias("width"), (hi("y") - lo("y")).alias("height"), ((hi("x") - lo("x")) * width_px).alias("width_px"),
        ((hi("y") - lo("y")) * height_px).alias("height_px"), F.least(lo("x"), lo("y"), 1 - hi("x"), 1 - hi("y")).alias("edge_margin"))
    return F.when(valid, box)


def pose(matrix: Column) -> Column:
    """Yaw, pitch and roll in degrees of a column-major 4 by 4 transform; null if a column has no length."""
    at = lambda r, c: F.element_at(matrix, c * 4 + r + 1)
    norm = [F.sqrt(at(0, c) ** 2 + at(1, c) ** 2 + at(2, c) ** 2) for c in range(3)]
    unit = lambda r, c: F.try_divide(at(r, c), norm[c])
    yaw = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -unit(2, 0))))
    locked = F.abs(F.cos(yaw)) < 1e-6
    pitch = F.when(locked, 0.0).otherwise(F.atan2(unit(2, 1), unit(2, 2)))
    roll = F.when(locked, F.atan2(-unit(0, 1), unit(1, 1))).otherwise(F.atan2(unit(1, 0), unit(0, 0)))
    good = (norm[0] > 0) & (norm[1] > 0) & (norm[2] > 0)
    return F.when(good, F.struct(F.degrees(yaw).alias("yaw_deg"), F.degrees(pitch).alias("pitch_deg"), F.degrees(roll).alias("roll_deg")))


def pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean and population deviation of each dimension over a group's vectors."""
    long_ = df.select(*keys, F.posexplode(vector).alias("dimension", "v")).withColumn("v", F.col("v").cast("double"))
    return long_.groupBy(*keys, "dimension").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
