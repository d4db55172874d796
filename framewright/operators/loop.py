"""Operators that carry state along a session: one step function serves tables and streams.

A step takes a session's state (a tuple, or None at its start) and its next rows
in order, as a pandas table, and gives the new state and the rows to emit.
However the rows are cut into tables, the emitted rows are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.operators import kernels

State = tuple | None
Step = Callable[[State, pd.DataFrame], tuple[tuple, pd.DataFrame]]

#: Rows of one session that a step takes at once.
STEP_ROWS = 5000


def _tail(schema: str, keys: list[str]) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")][len(keys) :]


def over_sessions(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """The step over whole tables: sessions are sorted and pass by in pieces, so that only a state is held between them."""
    names = _tail(schema, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            begins = np.flatnonzero((batch[keys] != batch[keys].shift()).any(axis=1).to_numpy())
            for a, b in zip(begins, [*begins[1:], len(batch)], strict=True):
                own = tuple(batch[keys].iloc[a].tolist())
                if own != key:
                    key, state = own, None
                for c in range(a, b, STEP_ROWS):
                    state, out = step(state, batch.iloc[c : min(b, c + STEP_ROWS)])
                    for at, name in enumerate(keys):
                        out.insert(at, name, key[at])
                    yield out[[*keys, *names]]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def over_stream(stream: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, state_schema: str) -> DataFrame:
    """The step over a stream: rows of a micro-batch go in order, and the state is kept by session in the state store."""
    names = _tail(schema, keys)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        kept, out = step(state.get if state.exists else None, rows)
        state.update(kept)
        for at, name in enumerate(keys):
            out.insert(at, name, key[at])
        yield out[[*keys, *names]]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


# --- order of arrival

ARRIVED = "session_id long, capture_epoch long, seq long, t_ms double, verdict string"
ARRIVED_STATE = "epoch long, seq long, t_ms double"


def judge_arrival(state: State, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Each row with its verdict: ``kept``, or why it is left out.

    ``stale-epoch`` comes after a newer capture epoch; ``sequence`` and ``time`` do
    not exceed the largest of all rows before in their epoch, kept or not.
    """
    epoch, seq, t = state or (-1, -1, -math.inf)
    e, s, m = (rows[c].to_numpy() for c in ("capture_epoch", "seq", "t_ms"))
    newest = np.maximum.accumulate(np.concatenate(([epoch], e)))
    verdict = np.where(e < newest[:-1], "stale-epoch", "").astype(object)
    for one in np.unique(e[verdict == ""]):
        at = np.flatnonzero((e == one) & (verdict == ""))
        first = (seq, t) if one == epoch else (-1, -math.inf)
        top_s, top_t = (np.maximum.accumulate(np.concatenate(([x], v[at]))) for x, v in zip(first, (s, m), strict=True))
        verdict[at] = np.where(s[at] <= top_s[:-1], "sequence", np.where(m[at] <= top_t[:-1], "time", "kept"))
        if one == newest[-1]:
            seq, t = top_s[-1], top_t[-1]
    return (int(newest[-1]), int(seq), float(t)), rows[["capture_epoch", "seq", "t_ms"]].assign(verdict=verdict)


# --- onsets

ONSETS = "session_id long, seq long, t_ms double, score double, nucleus boolean"
ONSET_STATE = "score double, last_ms double"
#: Least time between onsets, least score, how far it must exceed the smoothed one, and the smoothing.
REFRACTORY_MS, LEAST_SCORE, RISE, KEPT = 100.0, 0.012, 1.15, 0.7


def onset(score: float, last_ms: float, t_ms: float, active: bool, rms: float, flux: float) -> tuple[bool, float, float, float]:
    """Whether a frame is an onset, its score, the smoothed score and the time of the last onset after it."""
    now = rms * (1 + min(2.0, flux * 20))
    hit = bool(active) and t_ms - last_ms >= REFRACTORY_MS and now > max(LEAST_SCORE, score * RISE)
    return hit, now, KEPT * score + (1 - KEPT) * now, t_ms if hit else last_ms


def find_onsets(state: State, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Syllable onsets among analysed frames ``t_ms, speech_active, rms, spectral_flux``."""
    score, last = state or (0.0, -math.inf)
    hits, scores = [], []
    for t, active, rms, flux in zip(*(rows[c].tolist() for c in ("t_ms", "speech_active", "rms", "spectral_flux")), strict=True):
        hit, now, score, last = onset(score, last, t, active, rms, flux)
        hits.append(hit)
        scores.append(now)
    return (score, last), rows[["seq", "t_ms"]].assign(score=scores, nucleus=hits)


# --- voice features from blocks of sound

VOICE = (
    "session_id long, capture_epoch long, seq long, t_ms double, acquired_at_ms double, absolute_sample_index long, speech_active boolean, periodic boolean, rms double, f0_hz double, f0_confidence double, "
    "estimator_agreement double, spectral_flux double, syllabic_nucleus boolean, clipped_sample_fraction double, dc_offset double, snr_db double, sample_rate_hz double, block_gap_ms double, lost_block_fraction double"
)
VOICE_STATE = (
    "last_seq long, last_index long, last_at double, next long, tail array<double>, recent_at array<double>, recent_lost array<long>, bands array<double>, frames long, regressions long, score double, last_ms double"
)
WINDOW_S, HOP_S, RECENT_MS, MAX_GAP_MS, RING_S = 0.04, 0.01, 2000.0, 40.0, 2.0


def resolved(acf_hz: float | None, acf: float, amdf_hz: float | None, amdf: float, zero_hz: float | None, zero: float) -> tuple[float | None, float, float]:
    """Pitch, confidence and agreement of three estimates, for one window; see ``kernels.resolve``."""
    if acf_hz is None or amdf_hz is None:
        return None, min(acf, amdf), 0.0
    ratio, far = max(acf_hz, amdf_hz) / min(acf_hz, amdf_hz), abs(acf_hz - amdf_hz) / max(acf_hz, amdf_hz)
    octave = abs(ratio - 2) <= 0.12 or abs(ratio - 0.5) <= 0.06
    near = lambda x: zero_hz is not None and abs(x - zero_hz) / max(x, zero_hz) <= 0.12
    if octave and near(acf_hz) != near(amdf_hz):
        chosen, trust = (acf_hz, acf) if near(acf_hz) else (amdf_hz, amdf)
        return (chosen + zero_hz) / 2, min(trust, zero), 0.8
    if far > 0.12 or octave:
        return None, min(acf, amdf), max(0.0, 1 - far)
    return (acf_hz + amdf_hz) / 2, min(acf, amdf), max(0.0, 1 - far / 0.3)


def voice_features(noise_floor: float = 0.002) -> Step:
    """Frames every 10 ms over the last 40 ms of sound, from blocks ``seq, absolute_sample_index, acquired_at_ms, sample_rate_hz, samples``.

    Windows cross the borders of blocks.  A block whose number or place goes back
    is left out.  A lost block, a gap in the samples or one of over 40 ms starts
    windows and flux anew; onsets go on.  Of the sound at most 2 s is kept.
    """

    def step(state: State, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last_seq, last_index, last_at, upcoming, tail, recent_at, recent_lost, bands, frames, regressions, score, last_ms = state or (0, 0, None, 0, [], [], [], None, 0, 0, 0.0, -math.inf)
        tail, recent_at, recent_lost, out = np.asarray(tail, float), [*recent_at], [*recent_lost], []
        columns = (rows[c].tolist() for c in ("seq", "absolute_sample_index", "acquired_at_ms", "sample_rate_hz", "samples"))
        for seq, index, at, rate, samples in zip(*columns, strict=True):
            samples = np.zeros(0) if samples is None else np.asarray(samples, float)
            if (last_seq > 0 and seq <= last_seq) or (last_index > 0 and index < last_index):
                regressions += 1
                continue
            regressions += last_at is not None and at < last_at
            lost = max(0, seq - last_seq - 1) if last_seq > 0 else 0
            gap = 0.0 if last_at is None else max(0.0, at - last_at - len(samples) / rate * 1000)
            if lost or (last_index > 0 and index != last_index) or gap > MAX_GAP_MS:
                tail, upcoming, bands = np.zeros(0), 0, None
            recent_at.append(at)
            recent_lost.append(lost)
            last_seq, last_index, last_at = seq, index + len(samples), at
            tail = np.concatenate((tail, samples))[-int(rate * RING_S) :]
            window, hop, end = round(rate * WINDOW_S), round(rate * HOP_S), index + len(samples)
            upcoming = upcoming or index + window
            while end >= upcoming and len(tail) - (end - upcoming) >= window:
                stop = len(tail) - (end - upcoming)
                rms, dc, clipped, *pitch, energies = kernels.analyse(tail[stop - window : stop], rate)
                hz, trust, agreement = resolved(*pitch)
                flux = 0.0 if bands is None else float(np.sqrt((np.maximum(0.0, np.log1p(energies) - np.log1p(bands)) ** 2).mean()))
                while recent_at[0] < at - RECENT_MS:
                    del recent_at[0], recent_lost[0]
                share = sum(recent_lost) / max(1, len(recent_at) + sum(recent_lost))
                snr = 0.0 if rms <= 0 else max(0.0, 20 * math.log10(rms / max(0.0001, noise_floor)))
                periodic = hz is not None and trust >= 0.55 and agreement >= 0.7
                active = rms >= max(0.003, noise_floor * 2.8) and (periodic or (flux > 0.02 and rms >= noise_floor * 4))
                t = (upcoming - window) / rate * 1000
                hit, _, score, last_ms = onset(score, last_ms, t, active, rms, flux)
                bands, frames = energies, frames + 1
                out.append((frames, t, at - (end - upcoming) / rate * 1000, upcoming - window, active, periodic, rms, hz, trust, agreement, flux, hit, clipped, dc, snr, rate, gap, share))
                upcoming += hop
        keep = max(0, round(rate * WINDOW_S) + round(rate * HOP_S)) if len(rows) else len(tail)
        state = (last_seq, last_index, last_at, upcoming, tail[-keep:].tolist() if keep else [], recent_at, recent_lost, bands, frames, regressions, score, last_ms)
        return state, pd.DataFrame(out, columns=_tail(VOICE, ["session_id", "capture_epoch"])).astype({"f0_hz": float})

    return step
