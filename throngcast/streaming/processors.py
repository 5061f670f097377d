"""Keyed stateful processors. Each reuses the state machine of the batch operator, so both give the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..config import FallConfig
from ..operators.folds import FallDetector, RiskState, _object
from ..operators.ordered import Fold


class RiskStateWithChange(RiskState):
    """Risk state plus ``meaningful``: the severity changed or the average moved by at least 0.08."""

    output = {**RiskState.output, "meaningful": "boolean"}

    def run(self, state, columns):
        after, out = super().run(state, columns)
        ema = np.array(out["risk_ema"], dtype=float)
        before = np.concatenate([[state[0] if state else ema[0]], ema[:-1]])
        moved = np.abs(ema - before) >= K.MEANINGFUL_EMA_CHANGE
        return after, {**out, "meaningful": np.array(out["changed"], dtype=bool) | moved}


class TtlCache(Fold):
    """Serve the stored value until it expires, else store the fresh one: ``cached_value``, ``hit``."""

    output = {"cached_value": "double", "hit": "boolean"}

    def __init__(self, ts: str = "ts", fresh: str = "value", ttl_ms: int = K.CAMERA_TTL_MS):
        self.inputs, self.ts, self.fresh, self.ttl_ms = [ts, fresh], ts, fresh, max(K.CAMERA_TTL_FLOOR_MS, ttl_ms)

    def run(self, state, columns):
        expires, value = state or (None, None)
        values, hits = [], []
        for ts, fresh in zip(columns[self.ts].tolist(), columns[self.fresh].astype(float).tolist()):
            hit = expires is not None and expires > ts
            if not hit:
                expires, value = ts + self.ttl_ms, fresh
            values.append(value)
            hits.append(hit)
        return (expires, value), {"cached_value": _object(values), "hit": np.array(hits, dtype=bool)}


def _ordered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key in this micro-batch, whose size the source's trigger limits bound."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


#: A state machine takes, and gives back, so many rows at a time.
ROWS_AT_ONCE = 20_000


def _slices(rows: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one key in this micro-batch in order, as frames of ROWS_AT_ONCE; until then only their columns are held, without objects."""
    held: dict[str, list] = {c: [] for c in columns}
    for part in rows:
        for c in columns:
            values = part[c]
            held[c].append(pa.array(values, from_pandas=True) if values.dtype == object else values.to_numpy())
    whole = {}
    for c in columns:
        parts = held.pop(c)
        if any(isinstance(x, pa.Array) for x in parts):
            parts = [x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in parts]
            kind = next((x.type for x in parts if not pa.types.is_null(x.type)), pa.null())
            whole[c] = pa.chunked_array([x.cast(kind) for x in parts], kind)
        else:
            whole[c] = np.concatenate(parts)
    if all(isinstance(whole[c], np.ndarray) for c in order):
        place = np.lexsort([whole[c] for c in reversed(order)])
    else:
        place = pd.DataFrame({c: whole[c] if isinstance(whole[c], np.ndarray) else whole[c].to_pandas() for c in order}).sort_values(order, kind="stable").index.to_numpy()
    for at in range(0, len(place), ROWS_AT_ONCE):
        some = place[at:at + ROWS_AT_ONCE]
        yield pd.DataFrame({c: v[some] if isinstance(v, np.ndarray) else v.take(pa.array(some)).to_pandas() for c, v in whole.items()})


class FoldProcessor(StatefulProcessor):
    """Run a batch state machine over a stream, its state kept per key between micro-batches."""

    def __init__(self, fold: Fold, order: list[str], kept: list[str]):
        self.fold, self.order, self.kept = fold, order, kept

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def load(self):
        saved = self.state.get() if self.state.exists() else None
        return tuple(json.loads(saved[0])) if saved else None

    def handleInputRows(self, key, rows, timerValues):
        state = self.load()
        for part in _slices(rows, self.order, list(dict.fromkeys([*self.kept, *self.order, *self.fold.inputs]))):
            state, out = self.fold.run(state, {n: part[n].to_numpy() for n in self.fold.inputs})
            yield part[self.kept].assign(**out)
        self.state.update((json.dumps(state),))
        self.after(key, state)

    def after(self, key, state):
        pass

    def close(self):
        pass


class FallProcessor(FoldProcessor):
    """Fall detection; an unanswered prompt becomes an emergency by an event-time timer, even without new samples."""

    def __init__(self, order: list[str], kept: list[str], cfg: FallConfig = FallConfig(), answered: str | None = None):
        super().__init__(FallDetector(order[0], answered=answered, cfg=cfg), order, kept)
        self.cfg = cfg

    def after(self, key, state):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[0] == "prompt":
            self.handle.registerTimer(int(state[5]) + self.cfg.prompt_timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.load()
        if state and state[0] == "prompt":
            self.state.update((json.dumps(("idle", *state[1:])),))
            row = dict.fromkeys(self.kept)
            row[self.order[0]] = expiredTimerInfo.getExpiryTimeInMs()
            yield pd.DataFrame([{**row, "phase": "idle", "fall_event": "emergency"}])


class PresenceProcessor(StatefulProcessor):
    """Latest position per user. An offline event clears it, and so does 30 s of event time without an update."""

    output = "user_id string, arrival bigint, lat double, lng double, ts_ms bigint, status string"

    def __init__(self, max_age_ms: int = K.PRESENCE_MAX_AGE_MS):
        self.max_age_ms = max_age_ms

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("position", "arrival bigint, lat double, lng double, ts_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        last = None
        for part in rows:
            for row in zip(*[part[c].tolist() for c in ("arrival", "lat", "lng", "ts_ms", "offline")]):
                if last is None or last[0] != last[0] or row[0] >= last[0]:
                    last = row
        known = self.state.get()
        if known and known[0] > last[0]:
            return
        if known:                                        # who is not known has no timer
            self.handle.deleteTimer(known[3] + self.max_age_ms)
        row = (int(last[0]), float(last[1]), float(last[2]), int(last[3]))
        if not last[4]:
            self.state.update(row)
            self.handle.registerTimer(row[3] + self.max_age_ms)
        elif known:
            self.state.clear()
        yield self._row(key, row, "offline" if last[4] else "active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        row = self.state.get()
        if row:
            self.state.clear()
            yield self._row(key, tuple(row), "expired")

    def _row(self, key, row, status):
        return pd.DataFrame([(key[0], *row, status)], columns=["user_id", "arrival", "lat", "lng", "ts_ms", "status"])

    def close(self):
        pass


class IncidentProcessor(StatefulProcessor):
    """Signed changes of zone deltas per incident event: what the incident added before is taken back first.

    Keyed by incident, so even one map with all incidents spreads over the cluster; sums per zone follow.
    """

    output = "incident_id string, arrival bigint, zone_id string, change double"

    def init(self, handle):
        self.state = handle.getValueState("incident", "json string")

    def handleInputRows(self, key, rows, timerValues):
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"zones": [], "penalty": 0.0}
        out = []
        for event in _ordered(rows, ["arrival"]).itertuples():
            out += [(key[0], event.arrival, z, -held["penalty"]) for z in held["zones"]]
            if event.op == "clear":
                held = {"zones": [], "penalty": 0.0}
            else:
                zones = event.affected_zone_ids
                penalty = event.hazard_penalty
                held = {"zones": [event.zone_id] if zones is None else list(zones),
                        "penalty": K.INCIDENT_PENALTY_DEFAULT if penalty is None or penalty != penalty else float(penalty)}
            out += [(key[0], event.arrival, z, held["penalty"]) for z in held["zones"]]
        if held["zones"]:
            self.state.update((json.dumps(held),))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["incident_id", "arrival", "zone_id", "change"])

    def close(self):
        pass


class CountWindowProcessor(StatefulProcessor):
    """Means and extremes of every ``size`` consecutive frames, keyed by video and a block of consecutive windows.

    A window waits in the state, at most ``size`` values, until all its frames are there; the order in which they arrive does not matter.
    Frames count from 0 without gaps; a repeated frame replaces the earlier one; a window that stays short gives nothing.
    A block has WINDOWS windows: one call, one state and one frame of results serve them all.
    """

    WINDOWS = 256
    output = "video string, window_index bigint, motion_mean double, motion_std double, motion_max double, jerk_mean double"

    def __init__(self, size: int):
        self.size = size

    def init(self, handle):
        self.state = handle.getValueState("pending", "json string")

    def handleInputRows(self, key, rows, timerValues):
        saved = self.state.get()
        known = {int(w): {int(i): v for i, v in frames.items()} for w, frames in json.loads(saved[0]).items()} if saved else {}
        for pdf in rows:
            for i, v in zip(pdf["frame_idx"].tolist(), pdf["motion"].tolist()):
                if i == i and i is not None:             # a frame without a number is in no window
                    known.setdefault(int(i) // self.size, {})[int(i)] = float(v)
        whole = [w for w, frames in known.items() if len(frames) >= self.size]
        if whole:
            motion = np.array([[v for _, v in sorted(known.pop(w).items())] for w in whole])
            yield pd.DataFrame({"video": [key[0]] * len(whole), "window_index": whole, "motion_mean": motion.mean(1), "motion_std": motion.std(1),
                                "motion_max": motion.max(1), "jerk_mean": np.abs(np.diff(motion, axis=1)).mean(1)})
        if known:
            self.state.update((json.dumps(known),))
        elif saved:
            self.state.clear()

    def close(self):
        pass


def run_fold(stream: DataFrame, key: str, fold: Fold, order: list[str], kept: list[str],
             processor: FoldProcessor | None = None, time_mode: str = "None") -> DataFrame:
    fields = [stream.schema[c] for c in kept]
    schema = T.StructType(fields + [T.StructField(n, T.DataType.fromDDL(t)) for n, t in fold.output.items()])
    return stream.groupBy(key).transformWithStateInPandas(
        processor or FoldProcessor(fold, order, kept), schema, "Append", time_mode)
