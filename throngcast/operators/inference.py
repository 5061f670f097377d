"""Inference over whole videos: detections, motion and clip scores meet on frames and become anomaly per zone.

Inputs, each at its own rate: ``frames`` (video, frame_idx) as decoded, ``detections`` (video, frame_idx, bbox, conf, label) where the
detector ran, ``flow`` samples (video, frame_idx, zone_id, u, v, divergence, turbulence), and ``clips`` (video, clip_index, start_frame, probs, ...) of
consecutive decoded frames. Detections outside the frames a chain looks at are dropped before they are placed in zones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..config import FusionConfig, VideoConfig
from ..functions import scalars as S
from ..session import cut_lineage, stored
from . import crash, fusion, ml, motion, spatial, zones as Z
from .align import as_of, interval_join
from .ordered import with_row_index

MOTION = ["speed_mean", "speed_var", "dir_entropy", "divergence", "turbulence"]
_SHOT = ["video", "frame_idx"]


def sampled_shots(frames: DataFrame, flow: DataFrame | None, cfg: VideoConfig = VideoConfig()) -> DataFrame:
    """Frames at the target rate with source_index, processed_index, elapsed_ms, and the frames whose detections (det_frame, carried
    between detector runs) and motion (flow_frame, the latest field not older than ``flow_within`` frames) apply to them."""
    shots = crash.sampled(frames.select(*_SHOT), ["video"], ["frame_idx"], cfg.source_fps, cfg.target_fps)
    return _with_sources(shots, flow, cfg, cfg.detect_every, True)


def clip_shots(frames: DataFrame, clips: DataFrame, flow: DataFrame | None, cfg: VideoConfig = VideoConfig(), detect_every: int = 1,
               carry: bool = True) -> DataFrame:
    """Clips with their middle frame as the shot. A clip covers ``clip_len`` decoded frames from its start_frame; one that is not whole is dropped."""
    n = cfg.clip_len
    indexed = with_row_index(frames.select(*_SHOT), ["video"], ["frame_idx"], "source_index")
    spans = clips.select("video", "clip_index", "start_frame", (F.col("start_frame") + n).alias("end_frame"))
    inside = interval_join(indexed, spans, ["video"], "source_index", "start_frame", "end_frame", n)
    middle = F.col("source_index") == F.col("start_frame") + n // 2
    whole = inside.groupBy("video", "clip_index").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(middle, F.struct("source_index", "frame_idx"))).alias("_m")) \
        .where(F.col("_n") == n).select("video", "clip_index", "_m.*")
    return _with_sources(whole.join(clips.drop("start_frame"), ["video", "clip_index"]), flow, cfg, detect_every, carry)


def _with_sources(shots: DataFrame, flow: DataFrame | None, cfg: VideoConfig, every: int, carry: bool) -> DataFrame:
    shots = crash.detection_frame(shots, ["video"], ["frame_idx"], every, carry)
    shots = shots.withColumn("elapsed_ms", F.floor(F.col("source_index") * 1000 / F.lit(cfg.source_fps)).cast("long"))
    return cut_lineage(shots if flow is None else as_of(shots, flow, ["video"], "frame_idx", "flow_frame", cfg.flow_within))


def _counted(shots: DataFrame, detections: DataFrame, cfg: VideoConfig, count) -> DataFrame:
    """``count`` of the detections that apply to each shot, per zone, keyed by ``_shot``; a detector run is counted once however many shots it serves."""
    runs = shots.where("det_frame IS NOT NULL").select("video", "det_frame").distinct()
    seen = detections.withColumnRenamed("frame_idx", "det_frame").join(runs, ["video", "det_frame"], "left_semi")
    counts = count(seen.withColumn("_det", F.struct("video", "det_frame")))
    counts = counts.select("_det.*", *[c for c in counts.columns if c != "_det"])
    return shots.select(*_SHOT, "det_frame").join(counts, ["video", "det_frame"]).drop("det_frame").withColumn("_shot", F.struct(*_SHOT)).drop(*_SHOT)


def densities(shots: DataFrame, detections: DataFrame, cfg: VideoConfig = VideoConfig(), zone_rows=None, zones=None) -> DataFrame:
    """(video, frame_idx, zone_id, density, conf, people_count) of every shot and zone."""
    labels = list(cfg.labels) if cfg.labels else None
    seen = _counted(shots, detections, cfg, lambda d: Z.detections_by_zone(d, "_det", labels, zones, cfg.width, cfg.height))
    dense = Z.zone_density(seen, shots.select(F.struct(*_SHOT).alias("_shot")), zone_rows, "_shot", cfg.detector_available)
    return dense.select("_shot.*", "zone_id", "density", "conf", "people_count")


def feature_rows(shots: DataFrame, detections: DataFrame, flow: DataFrame, cfg: VideoConfig = VideoConfig(), zone_rows=None, zones=None) -> DataFrame:
    """Density, motion and first differences of every shot and zone; a shot without a motion field has no motion."""
    fields = shots.where("flow_frame IS NOT NULL").select("video", "flow_frame").distinct()
    used = flow.withColumnRenamed("frame_idx", "flow_frame").join(fields, ["video", "flow_frame"], "left_semi")
    moved = motion.zone_features(used.withColumn("_field", F.struct("video", "flow_frame")), "_field").select("_field.*", "zone_id", *MOTION, "occupancy")
    rows = densities(shots, detections, cfg, zone_rows, zones).join(shots, _SHOT).join(moved, ["video", "flow_frame", "zone_id"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in [*MOTION, "occupancy"]})
    rows = rows.withColumns({"ts": F.lit(cfg.start_ts_ms) + F.col("elapsed_ms"), "zone_pos": _zone_pos(), "_moment": F.struct(*_SHOT)})
    # differences and averages count their rows first: without a table each count would run the whole chain again
    return motion.feature_rows(stored(rows, "features"), ["video", "zone_id"], ["frame_idx"])


def _zone_pos() -> Column:
    return S.lookup(F.col("zone_id"), {z: i for i, (z, *_) in enumerate(K.ZONES)}, F.lit(len(K.ZONES)))


def _payload(rows: DataFrame, anomaly: str, *more: str) -> DataFrame:
    frame_id = F.concat_ws("/", "video", F.col("frame_idx").cast("string"))
    return rows.select("video", "frame_idx", frame_id.alias("frame_id"), "ts", "zone_id", "zone_pos", S.clamp(F.col("density")).alias("density"),
                       S.clamp(F.col(anomaly)).alias("anomaly"), S.clamp(F.col("conf")).alias("conf"), "people_count", *more)


def baseline(frames: DataFrame, detections: DataFrame, flow: DataFrame, cfg: VideoConfig = VideoConfig(), model: tuple | None = None) -> DataFrame:
    """Perception rows at the target rate: carried detections and motion to features, model or fallback anomaly, smoothed per zone."""
    rows = feature_rows(sampled_shots(frames, flow, cfg), detections, flow, cfg)
    return _payload(ml.anomaly_scores(rows, ["video", "zone_id"], ["frame_idx"], model, "_moment"), "anomaly")


def extract_features(frames: DataFrame, detections: DataFrame, flow: DataFrame, cfg: VideoConfig = VideoConfig()) -> DataFrame:
    """The feature table of videos: dataset and split come with the frames."""
    rows = feature_rows(sampled_shots(frames, flow, cfg), detections, flow, cfg)
    named = frames.select("video", "dataset", "split").distinct()
    return rows.join(named, "video").select(
        "dataset", "split", "video", F.col("source_index").alias("sourceFrameIndex"), F.col("processed_index").alias("processedFrameIndex"),
        F.col("elapsed_ms").alias("ts"), F.col("zone_id").alias("zoneId"), "conf", F.col("people_count").alias("peopleCount"), *K.FEATURE_COLUMNS)


def with_prediction(clips: DataFrame, probs: str = "probs", class_names: list[str] = tuple(K.CLASS_NAMES)) -> DataFrame:
    """Clips with pred_class_id, pred_label, pred_conf, label_risk and expected_risk from their class probabilities."""
    best = S.first_argmax(F.col(probs))
    name = lambda i: F.coalesce(F.get(F.array(*[F.lit(c) for c in class_names]), i), F.concat(F.lit("class_"), i.cast("string")))
    return clips.withColumn("pred_class_id", best).withColumns({
        "pred_label": name(F.col("pred_class_id")), "pred_conf": F.get(F.col(probs), F.col("pred_class_id")).cast("double"),
        "expected_risk": S.clamp(S.expected_class_risk(F.col(probs), class_names))}) \
        .withColumn("label_risk", S.clamp(S.lookup(F.col("pred_label"), K.CLASS_RISK, F.lit(K.UNKNOWN_CLASS_RISK))))


def behaviour(frames: DataFrame, detections: DataFrame, clips: DataFrame, cfg: VideoConfig = VideoConfig(), detect_every_clips: int = 1) -> DataFrame:
    """Risk of the clip's class blended with each zone's density, smoothed per zone; clips the detector skips count no one."""
    shots = clip_shots(frames, with_prediction(clips), None, cfg, detect_every_clips, carry=False)
    rows = densities(shots, detections, cfg).join(shots, _SHOT).withColumns({"ts": F.lit(cfg.start_ts_ms) + F.col("elapsed_ms"), "zone_pos": _zone_pos()})
    rows = rows.withColumn("_risk", fusion.behaviour_blend(F.col("label_risk"), F.col("density")))
    return _payload(fusion.smoothed(rows, ["video", "zone_id"], ["frame_idx"], "_risk"), "anomaly", "clip_index", "pred_label", "pred_class_id", "pred_conf", "label_risk")


def fused(frames: DataFrame, detections: DataFrame, flow: DataFrame, clips: DataFrame, cfg: VideoConfig = VideoConfig(), fusion_cfg: FusionConfig = FusionConfig(),
          detect_every_clips: int = 1, mil_score: str | None = None, model: tuple | None = None) -> DataFrame:
    """Hybrid inference: the baseline anomaly of each clip's middle frame and the clip's expected risk, spread over zones by activity.

    With ``mil_score`` (a column of the clips) the ensemble of three: baseline, class risk and segment score. The mixes are in the result.
    """
    shots = clip_shots(frames, with_prediction(clips), flow, cfg, detect_every_clips)
    base = ml.anomaly_scores(feature_rows(shots, detections, flow, cfg), ["video", "zone_id"], ["frame_idx"], model, "_moment").withColumnRenamed("anomaly", "_base")
    rows = fusion.activity_weights(base, "_moment", fusion_cfg)
    spread = lambda score: fusion.spatialised(F.col(score), F.col("weight"), F.col("zones_at_ts"))
    if mil_score is None:
        value, more = fusion.two_way(F.col("_base"), spread("expected_risk"), F.col("pred_conf"), fusion_cfg), []
    else:
        value = fusion.three_way(F.col("_base"), spread("expected_risk"), spread(mil_score), F.col("pred_conf"), fusion_cfg)
        mix = S.clamp(fusion_cfg.paper_weight * F.col("pred_conf"))
        rows = rows.withColumns({"paper_mix": mix, "mil_mix": F.lit(fusion_cfg.mil_weight), "base_mix": F.greatest(F.lit(0.0), 1 - mix - fusion_cfg.mil_weight)})
        more = [mil_score, "paper_mix", "mil_mix", "base_mix"]
    rows = fusion.smoothed(rows.withColumn("_fused", value), ["video", "zone_id"], ["frame_idx"], "_fused", keep=fusion_cfg.alpha_prev)
    return _payload(rows, "anomaly", "clip_index", "pred_label", "pred_class_id", "pred_conf", "expected_risk", *more)


def head_vehicle_counts(frames: DataFrame, detections: DataFrame, cfg: VideoConfig = VideoConfig(), roi=None, zone_rows=None, zones=None) -> DataFrame:
    """People, vehicles and heads per sampled frame and zone with density and confidence of each; with a RoiDensityConfig also the
    people per square metre inside the region (``roi_density``, ``roi_level``), once per frame."""
    shots = sampled_shots(frames, None, cfg)
    labels = {"people": "person", "vehicle": "vehicle", "head": "head"}
    tally = lambda d: Z._per_zone(d, zones, "_det", cfg.width, cfg.height, *[a for n, label in labels.items() for a in (
        F.count_if(F.col("label") == label).alias(f"n_{n}"), F.sum(F.when(F.col("label") == label, F.coalesce("conf", F.lit(0.0)))).alias(f"c_{n}"))])
    seen = _counted(shots, detections, cfg, tally)
    known = [(z, c) for z, _, c, _ in K.ZONES] if zone_rows is None else zone_rows
    dense = Z.frame_zone_skeleton(shots.select("*", F.struct(*_SHOT).alias("_shot")), known).join(seen, ["_shot", "zone_id"], "left")
    out = [F.lit(cfg.start_ts_ms) + F.col("elapsed_ms")]
    for n in labels:
        count = F.coalesce(f"n_{n}", F.lit(0)).cast("bigint")
        out += [count.alias(f"{n}_count"), S.clamp(count / F.greatest(F.col("capacity"), F.lit(1.0))).alias(f"{n}_density"),
                F.when(count > 0, F.col(f"c_{n}") / count).otherwise(F.lit(K.FALLBACK_CONF)).alias(f"{n}_conf")]
    rows = dense.select(*_SHOT, "zone_id", out[0].alias("ts"), *out[1:])
    if roi is None:
        return rows
    runs = detections.withColumnRenamed("frame_idx", "det_frame")
    served = shots.select(*_SHOT, "det_frame").join(runs, ["video", "det_frame"], "left").drop("det_frame")
    inside = spatial.roi_density(served, roi, ["video"], "frame_idx").select(*_SHOT, F.col("heads").alias("roi_heads"), F.col("density").alias("roi_density"), F.col("level").alias("roi_level"))
    return rows.join(inside, _SHOT, "left")
