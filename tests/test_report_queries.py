import duckdb
import pytest

from framewright.operators import face, report, voice
from framewright.plans import oracle_sql as sql
from framewright.plans import report_queries
from framewright.sources.surrogates import face_frames, face_sessions

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outcomes(spark):
    """Voice and eight face metrics by SQL; blinks, which SQL cannot say, by their own operator."""
    db = duckdb.connect()
    for t in ("events", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = []
    for query, modality, first in ((sql.VOICE_METRICS, "voice", 0), (sql.FACE_METRICS, "face", len(voice.METRICS))):
        got = db.execute(query)
        names = [c[0] for c in got.description]
        rows += [dict(zip(names, r, strict=True)) | {"modality": modality, "order": first + r[1]} for r in got.fetchall()]
    frames = face_frames(spark, SF)
    blinks = face.face_outcomes(frames, face_sessions(frames)).filter("ordinal = 8").collect()
    rows += [r.asDict() | {"modality": "face", "order": len(voice.METRICS) + 8} for r in blinks]
    return rows


def facts(r):
    if r["modality"] == "voice":
        events = max(r["pauses"], r["speech_runs"], r["nuclei"])
        return {"minimumSegments": r["segments"], "minimumPitchedDurationMs": r["pitched_ms"], "minimumPitchCoverage": r["pitched_ms"] / r["active_ms"], "minimumF0Hz": r["value"], "maximumF0Hz": r["value"],
                "minimumEligibleSpanMs": r["exposed"], "minimumActiveSpeechMs": r["active_ms"], "minimumEventsForMedian": events, "minimumNuclei": events}
    return {"minimumBins": r["bins"], "minimumObservationSpanMs": r["exposed"], "minimumExposureMs": r["exposed"], "minimumCadenceHz": r["frames"] / (r["exposed"] / 1000)}


def test_evidence_errors_of_both_modalities(spark, outcomes):
    want = {}
    for r in outcomes:
        if r["status"] == "measured":
            r = r | {"exposed": float(r["eligible_ms"] if r["modality"] == "voice" else r["exposure_ms"]) / 2}
            for name, threshold in report.REQUIREMENTS[r["order"]].items():
                actual = float(facts(r)[name])
                if (actual > threshold) if name.startswith("maximum") else (actual < threshold):
                    want[r["session_id"], r["code"], name] = actual
    got = {(r.session_id, r.code, r.requirement): r.actual for r in report_queries.r15_evidence(spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert any(".face." in code for _, code, _ in got)


def test_lanes_of_both_modalities(spark, outcomes):
    want = {}
    for r in outcomes:
        lane = want.setdefault((r["session_id"], r["modality"]), [[], [], set()])
        lane[0].append(r["eligible_ms"] if r["modality"] == "voice" else r["exposure_ms"] or 0.0)
        lane[1] += [float(r["quality_score"]) for _ in "m" if r["status"] == "measured"]
        lane[2] |= {r["reason"]} - {None}
    got = {(r.session_id, r.modality): r for r in report_queries.a34_lanes(spark, SF).collect()}
    assert got.keys() == want.keys() and {m for _, m in got} == {"voice", "face"}
    for key, (eligible, quality, reasons) in want.items():
        r = got[key]
        assert (r.state, r.reasons) == ("ready" if quality else "withheld", ",".join(sorted(reasons)))
        assert r.eligible_ms == pytest.approx(float(max(eligible)), abs=2e-6)
        assert r.quality_score == (pytest.approx(sum(quality) / len(quality), abs=2e-6) if quality else None)


def test_registry_violations_of_both_modalities(spark, outcomes):
    have = {(r["session_id"], r["code"]) for r in outcomes if not (r["session_id"] % 3 == 1 and r["order"] in (2, 4))}
    want = {(s, code, "missing") for s in {r["session_id"] for r in outcomes} for code, _ in report.METRICS if (s, code) not in have}
    got = [tuple(r) for r in report_queries.j03_incomplete(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not any(".face." in code for _, code, _ in got)
