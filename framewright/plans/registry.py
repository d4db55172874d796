"""Query registry of the measurement engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.plans import array_queries, face_queries, history_queries, loop_queries, observation_queries, provenance_queries, record_queries, report_queries, request_queries, signal_queries, voice_queries

_MODULES = (voice_queries, face_queries, history_queries, signal_queries, array_queries, report_queries, record_queries, provenance_queries, request_queries, observation_queries, loop_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice_queries.voice_outcomes(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
