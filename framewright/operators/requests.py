"""Checks of requests that carry sound as base64 text, and digests of JSON documents."""

from __future__ import annotations

import json
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.stats import all_of

#: The literals that a request must carry.
RATE_HZ, LAYERS, PEAK, LONGEST_TEXT = 16000, (6, 12, 18, 24), 1.5, 2_560_000
TASKS = ("sustained-vowel-1", "sustained-vowel-2", "standardized-reading", "rapid-syllables", "spontaneous-response")


def sound(payload: Column) -> Column:
    """``finite, peak`` of little-endian 32-bit samples; bytes beyond whole samples are left out, null stays null."""

    @F.pandas_udf(T.StructType.fromDDL("finite boolean, peak double"))
    def kernel(s: pd.Series) -> pd.DataFrame:
        out = []
        for raw in s:
            x = np.abs(np.frombuffer(raw or b"", "<f4", len(raw or b"") // 4))
            out.append((bool(np.isfinite(x).all()), float(x.max(initial=0.0))))
        return pd.DataFrame(out, columns=["finite", "peak"])

    return F.when(payload.isNotNull(), kernel(payload))


def request_errors(df: DataFrame, version: str, least: int = 24_000, most: int = 480_000, extra: str = "extra") -> DataFrame:
    """Adds ``errors``: names of the fields that break the schema, in its order, or else the first fault of the sound.

    ``version`` is the schema version that a request must name.  A column
    ``extra``, if there is one, lists the fields that a request has beyond the
    schema; each is an error, by its name, after the others.

    Sound is judged only where all fields are right: its text must be strict
    base64, its bytes four a sample, its samples finite and within 1.5.
    """
    short = lambda c: F.length(c).between(1, 120)
    c = F.col
    fields = {
        "schemaVersion": c("schema_version") == version, "requestRef": short("request_ref"), "captureEpoch": c("capture_epoch") >= 0, "windowRef": short("window_ref"), "taskContext": c("task_context").isin(*TASKS),
        "sampleRateHz": c("sample_rate_hz") == RATE_HZ, "channelCount": c("channel_count") == 1, "durationSamples": c("duration_samples").between(least, most), "requestedLayers": c("requested_layers") == F.array(*map(F.lit, LAYERS)),
        "pcmFloat32Base64": F.length("pcm_base64").between(1, LONGEST_TEXT)}
    wrong = F.array_compact(F.array(*(F.when(~all_of(ok), F.lit(name)) for name, ok in fields.items())))
    if extra in df.columns:
        wrong = F.concat(wrong, F.coalesce(F.array_sort(extra), F.array().cast("array<string>")))
    strict = c("pcm_base64").rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length("pcm_base64") % 4 == 0)
    d = df.withColumn("_wrong", wrong).withColumn("_raw", F.when((F.size("_wrong") == 0) & strict, F.try_to_binary("pcm_base64", F.lit("base64"))))
    d = d.withColumn("_sound", sound(F.col("_raw")))
    fault = (
        F.when(c("_raw").isNull(), "pcm-invalid").when(F.octet_length("_raw") != c("duration_samples") * 4, "pcm-length").when(~c("_sound.finite"), "pcm-nonfinite").when(c("_sound.peak") > PEAK, "pcm-out-of-range"))
    return d.withColumn("errors", F.when(F.size("_wrong") > 0, c("_wrong")).otherwise(F.array_compact(F.array(fault)))).drop("_wrong", "_raw", "_sound")


class _Number:
    """A number of a document, as the text to be written."""

    def __init__(self, text: str) -> None:
        self.text = _number(text)


def _number(text: str) -> str:
    """A number as scripts of the web write it: the shortest digits, with an exponent only below 1e-6 and from 1e21."""
    x = float(text)
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 1e21:
        plain = format(Decimal(repr(x)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    digits, _, power = format(Decimal(repr(x)).normalize(), "e").partition("e")
    return f"{digits}e{int(power):+d}"


def _canonical(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    return value.text if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def canonical_json(text: Column, without: str | None = None) -> Column:
    """The document with sorted keys and no blanks, less one key of its top level; null where it is no JSON."""

    @F.pandas_udf(T.StringType())
    def kernel(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                value = json.loads(t, parse_int=_Number, parse_float=_Number)
            except (TypeError, ValueError):
                return None
            return _canonical({k: v for k, v in value.items() if k != without} if isinstance(value, dict) else value)

        return s.map(one)

    return kernel(text)


def digests(df: DataFrame, text: str, claimed: str = "contentSha256") -> DataFrame:
    """Adds ``digest`` (SHA-256 of the document without its claim) and ``verified``; false where there is no claim."""
    out = df.withColumn("digest", F.sha2(canonical_json(F.col(text), claimed), 256))
    return out.withColumn("verified", all_of(F.get_json_object(text, f"$.{claimed}") == F.col("digest")))
