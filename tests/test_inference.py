"""Joins that align sources, and inference chains on small made videos."""

import random

import pytest
from pyspark.sql import functions as F

from throngcast.config import FusionConfig, VideoConfig
from throngcast.operators import inference as N, metrics
from throngcast.operators.align import as_of, interval_join
from throngcast.sources import readers, sinks


@pytest.mark.parametrize("chunk", [4_000_000, 40])
@pytest.mark.parametrize("within", [None, 5])
def test_as_of_equals_brute_force(spark, chunk, within):
    rng = random.Random(7)
    left = [(rng.choice("AAAB"), rng.randint(0, 200), i) for i in range(300)] + [("C", 5, 300), ("A", 3, 301), ("A", 3, 302)]
    right = [(rng.choice("AB"), rng.randint(0, 200)) for _ in range(40)] + [("A", 3), ("A", 3), ("B", None)]
    got = as_of(spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, t long"), ["k"], "t", "stamp", within, chunk)
    assert got.columns == ["k", "t", "id", "stamp"]
    found = {r.id: r.stamp for r in got.collect()}
    for k, t, i in left:
        stamps = [s for q, s in right if q == k and s is not None and s <= t and (within is None or t - s <= within)]
        assert found[i] == max(stamps, default=None)
    assert as_of(spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame([], "k string, t long"), ["k"], "t", "stamp").where("stamp IS NOT NULL").count() == 0


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(8)
    points = [(rng.choice("AB"), rng.randint(-40, 200), i) for i in range(200)]
    spans = [(rng.choice("AB"), s := rng.randint(-30, 180), s + rng.randint(-1, 40), i) for i in range(40)]
    got = interval_join(spark.createDataFrame(points, "k string, t long, p int"), spark.createDataFrame(spans, "k string, lo long, hi long, s int"), ["k"], "t", "lo", "hi", 16)
    assert got.columns == ["k", "t", "p", "lo", "hi", "s"]
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for k, t, p in points for q, lo, hi, s in spans if k == q and lo <= t < hi)


def made(spark):
    frames = spark.range(40).select(F.lit("v").alias("video"), F.col("id").alias("frame_idx"), F.lit("d").alias("dataset"), F.lit("train").alias("split"))
    boxes = [("v", 0, [10.0, 10.0, 20.0, 20.0], 0.8, "person"), ("v", 0, [10.0, 10.0, 24.0, 24.0], 0.6, "person"), ("v", 4, [10.0, 10.0, 20.0, 20.0], 0.9, "person"),
             ("v", 12, [200.0, 200.0, 220.0, 220.0], 0.5, "person"), ("v", 12, [10.0, 10.0, 20.0, 20.0], 0.5, "vehicle")]
    detections = spark.createDataFrame(boxes, "video string, frame_idx long, bbox array<double>, conf double, label string")
    flow = spark.createDataFrame([("v", 7, "AZ1", 1.0 + i, 0.5, 0.1, 0.2) for i in range(6)], "video string, frame_idx long, zone_id string, u double, v double, divergence double, turbulence double")
    return frames, detections, flow


def test_detections_are_carried_and_motion_is_the_latest(spark):
    frames, detections, flow = made(spark)
    cfg = VideoConfig(source_fps=8, target_fps=2, detect_every=3, flow_within=10)
    shots = {r.frame_idx: (r.det_frame, r.flow_frame, r.elapsed_ms) for r in N.sampled_shots(frames, flow, cfg).collect()}
    assert shots == {i: (i // 12 * 12, 7 if 7 <= i <= 17 else None, i * 125) for i in range(0, 40, 4)}
    rows = {(r.frame_idx, r.zone_id): r for r in N.baseline(frames, detections, flow, cfg).collect()}
    assert len(rows) == 60 and rows[8, "AZ1"].people_count == 2 and rows[8, "AZ1"].conf == pytest.approx(0.7)      # frame 4 was not looked at
    assert rows[12, "AZ1"].people_count == 0 and rows[20, "AZ5"].people_count + rows[20, "AZ6"].people_count == 1
    none = N.baseline(frames, detections, flow, VideoConfig(source_fps=8, target_fps=2, detector_available=False))
    assert none.where("people_count > 0 OR conf <> 0.6").count() == 0


def test_clips_that_are_not_whole_are_dropped(spark):
    frames, detections, flow = made(spark)
    clips = spark.createDataFrame([("v", 0, 0, [0.1] * 6 + [0.4] + [0.0] * 4), ("v", 1, 16, [1.0] + [0.0] * 10), ("v", 2, 32, [1.0] + [0.0] * 10)], "video string, clip_index long, start_frame long, probs array<double>")
    cfg = VideoConfig(source_fps=8)
    behaviour = {r.clip_index: r for r in N.behaviour(frames, detections, clips, cfg).where("zone_id = 'AZ1'").collect()}
    assert sorted(behaviour) == [0, 1] and behaviour[0].frame_idx == 8 and behaviour[0].pred_label == "gas_jammed" and behaviour[0].pred_conf == pytest.approx(0.4)
    hybrid = N.fused(frames, detections, flow, clips, cfg)
    mil = N.fused(frames, detections, flow, clips.withColumn("mil_score", F.lit(0.5)), cfg, FusionConfig(paper_weight=0.55), mil_score="mil_score")
    assert hybrid.count() == mil.count() == 12 and mil.where("abs(paper_mix + mil_mix + base_mix - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        VideoConfig(source_fps=0)


def test_feature_extraction_replaces_its_own_partition_only(spark, tmp_path):
    frames, detections, flow = made(spark)
    path = str(tmp_path / "features")
    rows = N.extract_features(frames, detections, flow, VideoConfig(source_fps=8, target_fps=2))
    sinks.replace_features(rows.unionByName(rows.withColumn("split", F.lit("test"))), path)
    sinks.replace_features(rows.withColumn("density", F.lit(9.0)), path)
    sinks.replace_features(rows.withColumn("density", F.lit(9.0)), path)
    back = readers.feature_tables(spark, [path])
    assert {(r.split, r["count"]) for r in back.groupBy("split").count().collect()} == {("train", 60), ("test", 60)}
    assert back.where("split = 'train' AND density <> 9").count() == 0 and back.where("split = 'test' AND density = 9").count() == 0


def test_bags_of_both_kinds(spark):
    a = spark.createDataFrame([("n", i, 0.1) for i in range(3)], "video string, clip_idx int, score double")
    b = spark.createDataFrame([(0.9, 0, "x"), (0.8, 1, "x")], "score double, clip_idx int, video string")
    both = metrics.labelled_bags(a, b, max_clips=2)
    assert sorted((r.bag_label, r.video, r.clip_idx) for r in both.collect()) == [(0, "n", 0), (0, "n", 1), (1, "x", 0), (1, "x", 1)]
    with pytest.raises(ValueError, match="normal"):
        metrics.labelled_bags(a.where("false"), b)
