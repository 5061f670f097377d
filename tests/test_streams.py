"""Streams over files: equal to batch, across micro-batches and restarts; expiry and timers."""

import json

import pytest
from pyspark.sql import functions as F

from throngcast.operators import crash, decision, folds, presence
from throngcast.operators.ordered import ordered_fold
from throngcast.sources import readers
from throngcast.streaming import streams
from throngcast.streaming.processors import TtlCache


def feed(spark, folder, schema, **options):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.json(str(folder))


def add(folder, name, rows, columns):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(dict(zip(columns, r))) for r in rows]
    part = folder / f".{name}"
    part.write_text("\n".join(lines))
    part.rename(folder / f"{name}.json")


RISK = "zone_id string, ts bigint, arrival bigint, risk_raw double"


def test_risk_stream_restart_equals_batch(spark, tmp_path):
    cols = ["zone_id", "ts", "arrival", "risk_raw"]
    rows = [(f"z{i % 2}", i * 300, i, [.1, .6, .95, .5][(i // 20) % 4]) for i in range(160)]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for n in range(4):          # each part is a new run from the same checkpoint
        add(tmp_path / "in", f"p{n}", rows[n * 40:(n + 1) * 40], cols)
        got = streams.run_to_table(streams.risk_stream(feed(spark, tmp_path / "in", RISK)), "risk", check, out)
    batch = ordered_fold(spark.createDataFrame(rows, RISK), ["zone_id"], ["ts", "arrival"], folds.RiskState())
    pick = ["arrival", "risk_ema", "slope_per_sec", "trend", "severity", "changed"]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, batch.select(*pick).collect()))
    assert got.filter("changed").count() >= 6 and got.filter("meaningful").count() > got.filter("changed").count()


def test_perception_frames_to_samples(spark, tmp_path):
    add(tmp_path, "f", [(7, [{"zoneId": "A", "density": 1.0, "anomaly": 1.0, "conf": .5}, {"zoneId": "B", "density": 1.0, "anomaly": 1.0}])], ["ts", "zones"])
    frames = readers.perception_frames(spark, str(tmp_path), streaming=True)
    got = streams.run_to_table(streams.perception_risk(frames), "samples").collect()
    assert sorted((r.zone_id, r.ts, r.risk_raw) for r in got) == [("A", 7, .5), ("B", 7, 0.0)]


PRESENCE = "user_id string, arrival bigint, lat double, lng double, ts_ms bigint, offline boolean"


def test_presence_stream(spark, tmp_path):
    cols = ["user_id", "arrival", "lat", "lng", "ts_ms", "offline"]
    add(tmp_path, "a", [("u", 1, 1.0, 2.0, 1000, False), ("v", 2, 1.0, 2.0, 1000, False)], cols)
    add(tmp_path, "b", [("v", 3, 1.5, 2.5, 200000, True), ("w", 4, 1.0, 2.0, 200000, False)], cols)
    add(tmp_path, "c", [("w", 5, 1.0, 2.0, 400000, False), ("v", 6, 3.0, 3.0, 390000, False)], cols)
    got = streams.run_to_table(streams.presence_stream(feed(spark, tmp_path, PRESENCE)), "presence")
    seen = {}
    for r in got.orderBy("arrival").collect():
        seen.setdefault(r.user_id, []).append((r.arrival, r.status))
    assert set(seen["u"]) == {(1, "active"), (1, "expired")}
    assert (3, "offline") in seen["v"] and (6, "active") in seen["v"] and (3, "expired") not in seen["v"]
    assert (4, "active") in seen["w"] and (5, "active") in seen["w"] and (5, "expired") not in seen["w"]


def test_presence_grid_stream(spark, tmp_path):
    cols = ["user_id", "arrival", "lat", "lng", "ts_ms", "offline"]
    rows = [(f"u{i % 9}", i, 1.3 + .0001 * (i % 3), 103.8, i * 700, False) for i in range(120)]
    for n in range(3):
        add(tmp_path, f"p{n}", rows[n * 40:(n + 1) * 40], cols)
    got = streams.run_to_table(streams.presence_grid_stream(feed(spark, tmp_path, PRESENCE)), "grid")
    timed = spark.createDataFrame(rows, PRESENCE).withColumn("w", F.window(F.timestamp_millis("ts_ms"), "30 seconds", "3 seconds"))
    key = lambda df: {(r.w.start, r.lat_cell, r.lng_cell): r.users for r in df.collect()}
    stream, batch = key(got), key(presence.presence_grid(timed, ["w"]))
    assert stream and all(batch[k] == n for k, n in stream.items())       # windows closed by the watermark


def test_incident_stream(spark, tmp_path):
    cols = ["incident_id", "arrival", "op", "zone_id", "hazard_penalty", "affected_zone_ids"]
    schema = "incident_id string, arrival bigint, op string, zone_id string, hazard_penalty double, affected_zone_ids array<string>"
    add(tmp_path, "a", [("i", 1, "add", "Z1", None, None), ("j", 2, "add", "Z1", 10.0, ["Z1", "Z2"]), ("k", 3, "add", "Z3", 5.0, [])], cols)
    add(tmp_path, "b", [("j", 4, "add", "Z1", 7.0, ["Z2"])], cols)
    add(tmp_path, "c", [("i", 5, "clear", "Z1", None, None)], cols)
    changes = streams.run_to_table(streams.incident_stream(feed(spark, tmp_path, schema)), "incidents")
    assert {r.zone_id: r.local_delta for r in streams.zone_totals(changes).collect()} == {"Z1": 0.0, "Z2": 7.0}


def test_fall_timer_without_new_samples(spark, tmp_path):
    cols, schema = ["device", "ts", "arrival", "magnitude"], "device string, ts bigint, arrival bigint, magnitude double"
    fall = [("d", 0, 0, 1.0), ("d", 100, 1, .2), ("d", 300, 2, 3.0)] + [("d", 300 + 500 * i, 2 + i, 1.0) for i in range(1, 30)]
    add(tmp_path, "a", fall, cols)
    add(tmp_path, "b", [("other", 200000, 0, 1.0)], cols)       # moves the watermark past the prompt's timeout
    got = streams.run_to_table(streams.fall_stream(feed(spark, tmp_path, schema)), "falls")
    events = [r.fall_event for r in got.filter("device = 'd' OR device IS NULL").filter("fall_event IS NOT NULL").orderBy("ts").collect()]
    assert events == ["prompt", "emergency"]


@pytest.mark.parametrize("backwards", [False, True])
def test_count_windows_across_batches(spark, tmp_path, backwards):
    cols, schema = ["video", "frame_idx", "motion"], "video string, frame_idx bigint, motion double"
    rows = [("v", i, float((i * 37) % 11)) for i in range(47)]
    parts = [(0, 13), (13, 16), (16, 47)]
    for n, (a, b) in enumerate(parts[::-1] if backwards else parts):
        add(tmp_path, f"p{n}", rows[a:b], cols)
    got = streams.run_to_table(streams.count_window_stream(feed(spark, tmp_path, schema)), "windows").orderBy("window_index").collect()
    full = spark.createDataFrame(rows, schema).withColumns({"brightness": F.lit(0.0), "edge": F.lit(0.0)})
    want = crash.crash_windows(full).orderBy("window_index").collect()
    assert len(got) == len(want) == 4
    for g, w in zip(got, want):
        assert (g.motion_mean, g.motion_std, g.motion_max, g.jerk_mean) == pytest.approx((w.motion_mean, w.motion_std, w.motion_max, w.jerk_mean))


def test_cache_and_metric_streams(spark, tmp_path):
    add(tmp_path / "c", "a", [("k", 0, 0, 1.0), ("k", 44999, 1, 2.0)], ["cache_key", "ts", "arrival", "value"])
    add(tmp_path / "c", "b", [("k", 45000, 2, 3.0)], ["cache_key", "ts", "arrival", "value"])
    got = streams.run_to_table(streams.inference_cache_stream(feed(spark, tmp_path / "c", "cache_key string, ts bigint, arrival bigint, value double")), "cache")
    assert [(r.cached_value, r.hit) for r in got.orderBy("arrival").collect()] == [(1.0, False), (1.0, True), (3.0, False)]
    assert TtlCache(ttl_ms=5).ttl_ms == 1000
    add(tmp_path / "m", "a", [("m", 0, 0, 4.0), ("m", 5, 1, None)], ["metric", "ts_ms", "arrival", "value"])
    got = streams.run_to_table(streams.stale_metric_stream(feed(spark, tmp_path / "m", "metric string, ts_ms bigint, arrival bigint, value double")), "metric")
    assert [r.source for r in got.orderBy("arrival").collect()] == ["live", "cache"]


def test_reroute_sink(spark, tmp_path):
    edges = spark.createDataFrame([("ab", "A", "B", 10.0, "Z1", False), ("ax", "A", "X", 20.0, "Z2", False), ("bx", "B", "X", 1.0, "Z3", False)],
                                  "edge_id string, src string, dst string, length double, zone_id string, one_way boolean")
    tables = {
        "mode": lambda: spark.createDataFrame([("evacuation",)], "mode string"),
        "routes": lambda: spark.createDataFrame([("u1", ["Z1", "Z3"], "A", "B", 0), ("u2", ["Z2"], "B", "A", 0)],
                                                "user_id string, zone_path array<string>, current_node string, destination string, last_reroute_ms bigint"),
        "zone_risk": lambda: spark.createDataFrame([("Z1", .9)], "zone_id string, risk double"),
        "incidents": lambda: spark.createDataFrame([], "zone_id string"),
        "edges": lambda: edges, "exits": lambda: spark.createDataFrame([("X", 0)], "exit_id string, exit_ord int")}
    add(tmp_path / "in", "a", [("Z1", 0, 0, .9)], ["zone_id", "ts", "arrival", "risk_raw"])
    sink = streams.RerouteSink(tables, str(tmp_path / "out"), lambda: 10 ** 6)
    changed = streams.risk_stream(feed(spark, tmp_path / "in", RISK))
    changed.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "batch=*")).collect()
    assert [(r.user_id, r.target, r.reason) for r in got] == [("u1", "X", "GLOBAL_MODE_ESCALATION")]
    assert decision.reroute_reason("normal") is not None
