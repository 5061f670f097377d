"""What keeps time and memory in proportion to the rows: each test fails on code that repeats work or holds a key whole."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from throngcast.functions import geometry as G
from throngcast.operators import graph, motion
from throngcast.operators.folds import StaleMetric
from throngcast.streaming import processors as P


class Kept:
    """A state value, and a handle whose timers are counted."""

    def __init__(self, value=None):
        self.value, self.timers, self.listed = value, set(), 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        self.listed += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_steps_of_a_large_graph_meet_only_what_improved(spark, monkeypatch):
    rng = random.Random(5)
    arcs = list({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}"): 0 for _ in range(150)})
    edges = spark.createDataFrame([(f"{a}-{b}", a, b, float(rng.randrange(1, 4))) for a, b in arcs], "edge_id string, src string, dst string, cost double")
    starts = spark.createDataFrame([("n0",), ("n7",)], "node string")
    want = {reverse: sorted(map(tuple, graph.cheapest_routes(edges, starts, reverse).collect())) for reverse in (False, True)}
    two = sorted(map(tuple, graph.cheapest_costs(edges, starts, True, 2).collect()))
    seen = []
    plain = graph._relax_few
    monkeypatch.setattr(graph, "_relax_few", lambda *a: seen.append(1) or plain(*a))
    for limit in (2, 40):                                # steps are large; with 40 what improved is small at first
        monkeypatch.setattr(graph, "BROADCAST_ROWS", limit)
        for reverse in want:
            assert sorted(map(tuple, graph.cheapest_routes(edges, starts, reverse).collect())) == want[reverse]
        assert sorted(map(tuple, graph.cheapest_costs(edges, starts, True, 2).collect())) == two
    assert len(seen) == 6


def test_a_key_runs_in_slices(monkeypatch):
    monkeypatch.setattr(P, "ROWS_AT_ONCE", 100)
    rng = np.random.default_rng(3)
    n = 950
    rows = pd.DataFrame({"metric": ["m"] * n, "ts_ms": rng.integers(0, 400_000, n), "arrival": np.arange(n), "value": np.where(rng.random(n) < .3, np.nan, rng.random(n))})
    p = P.FoldProcessor(StaleMetric(), ["ts_ms", "arrival"], ["metric", "ts_ms", "arrival"])
    p.state = Kept()
    got = list(p.handleInputRows(("m",), iter([rows[:400], rows[400:]]), None))
    assert len(got) == 10 and max(map(len, got)) == 100
    ordered = rows.sort_values(["ts_ms", "arrival"], ignore_index=True)
    _, want = StaleMetric().run(None, {c: ordered[c].to_numpy() for c in ("ts_ms", "value")})
    got = pd.concat(got, ignore_index=True)
    pd.testing.assert_frame_equal(got[["metric", "ts_ms", "arrival"]], ordered[["metric", "ts_ms", "arrival"]])
    assert all([None if x != x else x for x in got[c]] == list(want[c]) for c in want)


def test_slices_take_nulls_and_texts(monkeypatch):
    monkeypatch.setattr(P, "ROWS_AT_ONCE", 2)
    parts = [pd.DataFrame({"k": [None, None], "t": [2, 1], "x": ["a", None]}), pd.DataFrame({"k": ["v", "v"], "t": [np.nan, 0.0], "x": [None, None]})]
    got = pd.concat(P._slices(iter(parts), ["t"], ["k", "t", "x"]), ignore_index=True)
    assert got["t"].tolist()[:3] == [0.0, 1.0, 2.0] and got["x"].tolist() == [None, None, "a", None] and got["k"].tolist() == ["v", None, None, "v"]


def test_one_call_serves_a_block_of_windows():
    p = P.CountWindowProcessor(10)
    p.state = Kept()
    frames = pd.DataFrame({"video": "v", "window_block": 0, "frame_idx": np.arange(p.WINDOWS * 10 - 1), "motion": np.arange(p.WINDOWS * 10 - 1) % 7 / 3.0}).sample(frac=1, random_state=1)
    got = list(p.handleInputRows(("v", 0), iter([frames[:700], frames[700:]]), None))
    assert len(got) == 1 and sorted(got[0]["window_index"]) == list(range(p.WINDOWS - 1)) and p.state.exists()
    last = list(p.handleInputRows(("v", 0), iter([pd.DataFrame({"frame_idx": [p.WINDOWS * 10 - 1], "motion": [9.0]})]), None))
    assert last[0]["window_index"].tolist() == [p.WINDOWS - 1] and last[0]["motion_max"].tolist() == [9.0] and not p.state.exists()


def test_presence_lists_no_timers():
    p = P.PresenceProcessor(30_000)
    p.handle = p.state = Kept()
    rows = lambda *r: iter([pd.DataFrame(list(r), columns=["arrival", "lat", "lng", "ts_ms", "offline"])])
    got = [f.to_dict("records") for f in p.handleInputRows(("u",), rows((2, 1.0, 2.0, 900, False), (1, 0.0, 0.0, 100, True)), None)]
    assert got == [[{"user_id": "u", "arrival": 2, "lat": 1.0, "lng": 2.0, "ts_ms": 900, "status": "active"}]]
    assert p.handle.timers == {30_900}
    assert not list(p.handleInputRows(("u",), rows((1, 1.0, 2.0, 950, True)), None))
    assert [f["status"].tolist() for f in p.handleInputRows(("u",), rows((3, 1.0, 2.0, 5000, False)), None)] == [["active"]]
    assert p.handle.timers == {35_000}
    assert [f["status"].tolist() for f in p.handleExpiredTimer(("u",), None, None)] == [["expired"]] and not p.state.exists()
    assert p.handle.listed == 0


def test_polygon_text_is_parsed_once(spark):
    df = spark.createDataFrame([("0,0; 4,0;4,3;0,3;",), ("0,0;1,1;2,2",), ("0,0;1;2,2;3,3",), (None,)], "said string")
    points = df.select("said", G.roi_points(F.col("said")).alias("p"))
    assert points._jdf.queryExecution().analyzed().toString().count("trim(said") == 1
    assert [r.area for r in points.select(G.polygon_area(F.col("p")).alias("area")).collect()] == [12.0, None, None, None]


def test_small_frames_are_dealt_once(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["A", "B", None]), rng.uniform(-3, 3), rng.uniform(-3, 3), rng.random(), rng.random()) for _ in range(400)]
    flow = spark.createDataFrame(rows, "frame_id long, zone_id string, u double, v double, divergence double, turbulence double")
    found = motion.zone_features(flow)
    got = {(r.frame_id, r.zone_id): tuple(r)[2:] for r in found.collect()}
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(motion, "SMALL_FRAME", 1)
    want = {(r.frame_id, r.zone_id): tuple(r)[2:] for r in motion.zone_features(flow).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) == 6


def test_dear_steps_that_improve_nothing_meet_no_entry(spark, monkeypatch):
    rng = random.Random(7)
    arcs = sorted({(f"n{a}", f"n{rng.randrange(20)}") for a in range(20) for _ in range(14)})
    rows = [(f"{a}-{b}", a, b, float(rng.randrange(1, 30)) if a != "n9" else None) for a, b in arcs] + [("n0-m", "n0", "m", 90.0), ("m-n3", "m", "n3", 0.0)]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, cost double")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(0, 18, 2)] + [("m",)], "node string")
    found = lambda e: sorted(map(tuple, graph.cheapest_costs(e, starts).collect()), key=str)
    given = (edges.where("cost IS NOT NULL"), edges)
    want = [found(e) for e in given]
    met, tight, plain, way = [], [], graph._few_rounds, graph._tight_steps
    monkeypatch.setattr(graph, "_few_rounds", lambda steps, *a: met.append(steps.count()) or plain(steps, *a))
    monkeypatch.setattr(graph, "_tight_steps", lambda *a: tight.append(1) or way(*a))
    monkeypatch.setattr(graph, "LIGHT_STEPS", 3)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 2)
    assert [found(e) for e in given] == want
    assert len(met) == 3 and met[0] < met[1] / 2         # with costs missing all steps go at once
    assert len(tight) == 2
