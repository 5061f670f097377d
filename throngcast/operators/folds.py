"""State machines over ordered rows: smoothing, severity, reroute cool-down, throttling, falls."""

from __future__ import annotations

import numpy as np

from .. import constants as K
from ..config import AltRiskConfig, FallConfig, RiskStateConfig
from .ordered import Fold


class Ewma(Fold):
    """``keep * previous + (1 - keep) * value``. NULL carries the average on.

    ``start``: 'first' passes the first value through, 'zero' blends it with 0, a number is the start value.
    """

    def __init__(self, value: str, name: str, keep: float = K.EWMA_KEEP, start="first"):
        self.inputs, self.output = [value], {name: "double"}
        self.name, self.keep, self.start = name, keep, start

    def run(self, state, columns):
        average = state[0] if state else {"first": None, "zero": 0.0}.get(self.start, self.start)
        keep, take = self.keep, 1.0 - self.keep
        out = np.empty(len(columns[self.inputs[0]]))
        for i, value in enumerate(columns[self.inputs[0]].astype(float).tolist()):
            if value == value:
                average = value if average is None else keep * average + take * value
            out[i] = np.nan if average is None else average
        return (average,), {self.name: out}


class RiskState(Fold):
    """Risk average, slope, trend and severity with hold times and a minimum dwell.

    A NULL risk carries the average on; before the first risk it is 0. The state keeps no time beyond what a hold or the dwell
    asks for, so a zone that stays as it is has the same state however long it did.
    """

    output = {"risk_ema": "double", "slope_per_sec": "double", "trend": "string", "severity": "string",
              "changed": "boolean"}

    def __init__(self, ts: str = "ts", risk: str = "risk_raw", cfg: RiskStateConfig = RiskStateConfig()):
        self.inputs, self.ts, self.risk, self.cfg = [ts, risk], ts, risk, cfg

    def run(self, state, columns):
        cfg = self.cfg
        take, keep = cfg.ema_alpha, 1 - cfg.ema_alpha
        warn_up, critical_up, warn_down, critical_down = cfg.warn_up, cfg.critical_up, cfg.warn_down, cfg.critical_down
        risks = columns[self.risk].astype(float)
        if cfg.clamp_to_unit:
            risks = np.clip(risks, 0.0, 1.0)
        times, risks = columns[self.ts].tolist(), risks.tolist()
        averages, slopes, severities, changes = [], [], [], []
        if state is None:
            ema, since, last = risks[0] if risks[0] == risks[0] else 0.0, times[0], times[0]
            severity = "critical" if ema >= critical_up else "warn" if ema >= warn_up else "info"
            # held times: above warn, above critical, below warn, below critical
            slope, above_w, above_c, below_w, below_c = 0.0, 0, 0, 0, 0
            averages.append(ema)
            slopes.append(slope)
            severities.append(severity)
            times, risks = times[1:], risks[1:]
        else:
            ema, slope, severity, since, last, above_w, above_c, below_w, below_c = state
        begun = len(averages)
        for i, (ts, risk) in enumerate(zip(times, risks), begun):
            dt = ts - last if ts > last else 0
            average = take * risk + keep * ema if risk == risk else ema
            if dt:
                slope = (average - ema) / (dt / 1000)
            ema, last = average, ts
            above_w = above_w + dt if ema >= warn_up else 0
            above_c = above_c + dt if ema >= critical_up else 0
            below_w = below_w + dt if ema <= warn_down else 0
            below_c = below_c + dt if ema <= critical_down else 0
            if ts - since >= cfg.min_change_interval_ms:
                target = self._next(severity, above_w, above_c, below_w, below_c)
                if target != severity:
                    severity, since = target, ts
                    changes.append(i)
            averages.append(ema)
            slopes.append(slope)
            severities.append(severity)
        slope_array = np.array(slopes)
        changed = np.zeros(len(averages), dtype=bool)
        changed[changes] = True
        trend = np.where(slope_array > cfg.slope_eps, "rising", np.where(slope_array < -cfg.slope_eps, "falling", "flat"))
        if state is None:
            trend[0] = "flat"
        state = (ema, slope, severity, max(since, last - cfg.min_change_interval_ms), last,
                 min(above_w, cfg.to_warn_hold_ms), min(above_c, cfg.to_critical_hold_ms),
                 min(below_w, cfg.to_info_hold_ms), min(below_c, cfg.to_warn_from_critical_hold_ms))
        return state, {
            "risk_ema": np.array(averages), "slope_per_sec": slope_array, "trend": trend.astype(object),
            "severity": _object(severities), "changed": changed}

    def variants(self, state, settled):
        moved = (*settled[:3], settled[3] + state[4] - settled[4], state[4], *settled[5:])
        return [(*s[:2], level, *s[3:]) for s in (state, moved) for level in ("info", "warn", "critical")]

    def _next(self, severity, above_warn, above_critical, below_warn, below_critical):
        cfg = self.cfg
        if severity == "info" and above_warn >= cfg.to_warn_hold_ms:
            return "warn"
        if severity == "warn" and above_critical >= cfg.to_critical_hold_ms:
            return "critical"
        if severity == "warn" and below_warn >= cfg.to_info_hold_ms:
            return "info"
        if severity == "critical" and below_critical >= cfg.to_warn_from_critical_hold_ms:
            return "warn"
        return severity


class AltRisk(Fold):
    """Confidence-aware smoothing from 0 and hysteresis without hold times."""

    output = {"alt_risk": "double", "alt_state": "string"}

    def __init__(self, density: str = "density", anomaly: str = "anomaly", conf: str = "conf",
                 cfg: AltRiskConfig = AltRiskConfig()):
        self.inputs, self.cfg = [density, anomaly, conf], cfg

    def run(self, state, columns):
        cfg = self.cfg
        risk, level = state or (0.0, "normal")
        density, anomaly, conf = (columns[n].astype(float) for n in self.inputs)
        raw = np.clip(cfg.density_weight * np.clip(density, 0, 1) + cfg.anomaly_weight * np.clip(anomaly, 0, 1), 0, 1)
        weight = cfg.smoothing * (0.25 + 0.75 * np.clip(np.where(np.isnan(conf), 1.0, conf), 0, 1))
        risks, levels = [], []
        for value, share in zip(raw.tolist(), weight.tolist()):
            risk = min(1.0, max(0.0, share * value + (1 - share) * risk))
            level = self._next(level, risk)
            risks.append(risk)
            levels.append(level)
        return (risk, level), {"alt_risk": np.array(risks), "alt_state": _object(levels)}

    def variants(self, state, settled):
        return [(s[0], level) for s in (state, settled) for level in ("normal", "warn", "critical")]

    def _next(self, level, risk):
        cfg = self.cfg
        if level == "critical" and risk > cfg.critical_off:
            return "critical"
        if level != "critical" and risk >= cfg.critical_on:
            return "critical"
        if level == "normal":
            return "warn" if risk >= cfg.warn_on else "normal"
        return "normal" if risk <= cfg.warn_off else "warn"


class Cooldown(Fold):
    """Grant a wish only when at least ``gap_ms`` passed since the last grant; with ``wanted`` None every row wishes."""

    output = {"granted": "boolean"}

    def __init__(self, ts: str, wanted: str | None, gap_ms: int, last: str | None = None):
        self.inputs = [ts] + [c for c in (wanted, last) if c]
        self.ts, self.wanted, self.gap_ms, self.last = ts, wanted, gap_ms, last

    def run(self, state, columns):
        times = columns[self.ts].tolist()
        last = state[0] if state else None
        if last is None and self.last is not None:
            first = columns[self.last][0]
            last = None if first is None or first != first else int(first)
        wanted = columns[self.wanted].tolist() if self.wanted else [True] * len(times)
        out = []
        for ts, want in zip(times, wanted):
            grant = bool(want) and (last is None or ts - last >= self.gap_ms)
            if grant:
                last = ts
            out.append(grant)
        # a grant (or none) longer ago than the gap is as good as one just that long ago
        last = times[-1] - self.gap_ms if last is None else max(last, times[-1] - self.gap_ms)
        return (last,), {"granted": np.array(out, dtype=bool)}


class StaleMetric(Fold):
    """A polled metric with a cache: 'cache' within ``ttl_ms`` of the last good fetch or when the fetch
    failed, 'live' on a new good fetch, 'unavailable' before the first one."""

    output = {"last_value": "double", "updated_at": "bigint", "source": "string"}

    def __init__(self, ts: str = "ts_ms", value: str = "value", ttl_ms: int = K.CAMERA_TTL_MS):
        self.inputs, self.ts, self.value, self.ttl_ms = [ts, value], ts, value, ttl_ms

    def run(self, state, columns):
        fetched, last = state or (None, None)
        rows = []
        for ts, value in zip(columns[self.ts].tolist(), columns[self.value].astype(float).tolist()):
            source = "cache" if fetched is not None else "unavailable"
            if (fetched is None or ts - fetched > self.ttl_ms) and value == value:
                fetched, last, source = ts, value, "live"
            rows.append((last, fetched, source))
        return (fetched, last), {n: _object(r[i] for r in rows) for i, n in enumerate(self.output)}


class FallDetector(Fold):
    """Free fall, impact, immobility; 'prompt' when a fall is suspected, 'emergency' when it stays unanswered.

    While a prompt is open, samples are ignored. A row with ``answered`` true closes the prompt.
    """

    output = {"phase": "string", "fall_event": "string"}

    def __init__(self, ts: str = "ts", magnitude: str = "magnitude", answered: str | None = None,
                 cfg: FallConfig = FallConfig()):
        self.inputs = [ts, magnitude] + ([answered] if answered else [])
        self.ts, self.magnitude, self.answered, self.cfg = ts, magnitude, answered, cfg

    def run(self, state, columns):
        cfg = self.cfg
        times, forces = columns[self.ts].tolist(), columns[self.magnitude].astype(float).tolist()
        answers = columns[self.answered].tolist() if self.answered else [False] * len(times)
        phase, fell, hit, moved, before, prompted = state or ("idle", 0, 0, times[0], 1.0, None)
        phases, events = [], []
        for ts, force, answer in zip(times, forces, answers):
            event = None
            if phase == "prompt":
                if answer:
                    phase, event = "idle", "answered"
                elif ts - prompted >= cfg.prompt_timeout_ms:
                    phase, event = "idle", "emergency"
                phases.append(phase)
                events.append(event)
                continue
            if abs(force - before) > cfg.movement_g or abs(force - 1) > cfg.movement_g:
                moved = ts
            before = force
            if phase == "idle":
                if force < cfg.freefall_g:
                    phase, fell = "freefall", ts
            elif phase == "freefall":
                if ts - fell > cfg.impact_window_ms:
                    phase = "idle"
                elif force > cfg.impact_g:
                    phase, hit, moved = "impact", ts, ts
            elif ts - hit >= cfg.immobile_ms and ts - moved >= cfg.immobile_ms:
                phase, event, prompted = "prompt", "prompt", ts
            elif ts - hit > cfg.give_up_ms:
                phase = "idle"
            phases.append(phase)
            events.append(event)
        # a phase remembers only the times it asks for
        state = (phase, fell if phase == "freefall" else 0, hit if phase == "impact" else 0, moved if phase == "impact" else 0, before,
                 prompted if phase == "prompt" else None)
        return state, {"phase": _object(phases), "fall_event": _object(events)}


def _object(values) -> np.ndarray:
    values = list(values)
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out

