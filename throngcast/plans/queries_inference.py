"""Whole inference chains, from frames, detections, motion and clip vectors to records, each against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..config import FusionConfig, RoiDensityConfig, VideoConfig
from ..operators import inference as N, ml
from ..session import cut_lineage, run_folder
from ..sources import readers, sinks
from .catalog import query, rounded
from .queries_models import _weights
from .queries_zones import ROI

CFG = VideoConfig(source_fps=12.0, target_fps=3.0, detect_every=3, flow_within=9)

# Motion fields of the videos take the place of the monthly ones; a field's number holds its video.
_FLOW = {"flow_samples": """
    SELECT (l_orderkey // 4 // 8 * 8 + 3) * 4 + l_orderkey % 4 AS frame_id, 'AZ' || (l_suppkey % 6 + 1) AS zone_id, (l_quantity - 25) / 10 + l_extendedprice / 1e7 AS u,
           (100 * l_discount - 5) / 5 AS v, l_tax AS divergence, l_tax * l_quantity / 10 AS turbulence FROM lineitem"""}
_FRAMES = {"decoded": """
    SELECT o_orderkey % 4 AS video, o_orderkey // 4 AS frame_idx, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS source_index FROM orders"""}
_SAMPLED = {"chosen": "SELECT *, source_index // 4 AS processed, (source_index // 4) % 3 = 0 AS runs FROM decoded WHERE source_index % 4 = 0"}
# clips whose sixteen frames are all there, with their middle frame; every detect_every-th runs the detector
_CLIPS = {"spans": """
        SELECT clip_idx % 4 AS video, clip_idx // 4 AS clip_index, clip_idx // 4 * 16 + CASE WHEN (clip_idx // 4) % 3 = 0 THEN 4 ELSE 0 END AS start_frame, probs, embedding FROM clip_vectors""",
          "chosen": """
        SELECT c.video, clip_index, m.frame_idx, m.source_index, probs, embedding, (row_number() OVER (PARTITION BY c.video ORDER BY m.frame_idx) - 1) % {every} = 0 AS runs,
               list_position(probs, list_max(probs)) - 1 AS best, list_max(probs) AS pred_conf
        FROM spans c JOIN decoded m ON m.video = c.video AND m.source_index = start_frame + 8
        WHERE (SELECT count(*) FROM decoded f WHERE f.video = c.video AND f.source_index >= start_frame AND f.source_index < start_frame + 16) = 16"""}
_ALIGNED = {
    "fields": "SELECT DISTINCT ts % 4 AS video, ts // 4 AS flow_frame FROM features",
    "shots": """SELECT c.*, CAST(floor(source_index * 1000 / 12e0) AS BIGINT) AS ms, CASE WHEN frame_idx - flow_frame <= 9 THEN flow_frame END AS field,
           {det} AS det_frame FROM chosen c ASOF LEFT JOIN fields f ON c.video = f.video AND c.frame_idx >= f.flow_frame""",
    "counted": "SELECT frame_id % 4 AS video, frame_id // 4 AS det_frame, zone_id, count(*) AS n, sum(conf) AS c FROM located WHERE zone_id IS NOT NULL AND label = 'person' GROUP BY ALL",
    "dense": """SELECT s.* EXCLUDE (field, runs), z.zone_id, z.zone_ord, least(1e0, coalesce(n, 0) / 25e0) AS density, coalesce(c / n, 0.6e0) AS conf, coalesce(n, 0) AS people_count,
           coalesce(m.speed_mean, 0e0) AS speed_mean, coalesce(m.speed_var, 0e0) AS speed_var, coalesce(m.dir_entropy, 0e0) AS dir_entropy, coalesce(m.divergence, 0e0) AS divergence,
           coalesce(m.turbulence, 0e0) AS turbulence
        FROM shots s CROSS JOIN zones z LEFT JOIN counted d ON d.video = s.video AND d.det_frame = s.det_frame AND d.zone_id = z.zone_id
        LEFT JOIN features m ON m.ts = s.field * 4 + s.video AND m.zone_id = z.zone_id"""}
_CARRIED = "last_value(CASE WHEN runs THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY c.video ORDER BY frame_idx)"
# pressure, speed and turbulence between their 5th and 95th percentile of the moment
_NORMED = {
    "pressed": "SELECT *, density * (speed_mean + 0.5e0 * turbulence) AS pressure FROM dense",
    "spans_of": """SELECT video, frame_idx, quantile_cont(speed_mean, 0.05) AS s5, quantile_cont(speed_mean, 0.95) AS s95, quantile_cont(turbulence, 0.05) AS t5,
           quantile_cont(turbulence, 0.95) AS t95, quantile_cont(pressure, 0.05) AS p5, quantile_cont(pressure, 0.95) AS p95 FROM pressed GROUP BY ALL""",
    "scaled": """SELECT d.*, CASE WHEN s95 <= s5 THEN 0e0 ELSE greatest(0e0, least(1e0, (speed_mean - s5) / (s95 - s5))) END AS sn,
           CASE WHEN t95 <= t5 THEN 0e0 ELSE greatest(0e0, least(1e0, (turbulence - t5) / (t95 - t5))) END AS tn,
           CASE WHEN p95 <= p5 THEN 0e0 ELSE greatest(0e0, least(1e0, (pressure - p5) / (p95 - p5))) END AS pn FROM pressed d JOIN spans_of USING (video, frame_idx)""",
    "raw": "SELECT *, greatest(0e0, least(1e0, 0.45e0 * dir_entropy + 0.35e0 * tn + 0.2e0 * pn)) AS value FROM scaled"}


def _smooth(source: str, name: str) -> dict:
    """0.7 of the value before and 0.3 of the own, per video and zone."""
    return {f"{name}_order": f"SELECT *, row_number() OVER (PARTITION BY video, zone_id ORDER BY frame_idx) AS rn FROM {source}",
            name: f"""SELECT *, value AS anomaly FROM {name}_order WHERE rn = 1
        UNION ALL SELECT o.*, 0.7e0 * f.anomaly + (1 - 0.7e0) * o.value FROM {name} f JOIN {name}_order o ON o.video = f.video AND o.zone_id = f.zone_id AND o.rn = f.rn + 1"""}


def _views(every: int | None, det: str, *more: dict) -> dict:
    chosen = _SAMPLED if every is None else {k: v.format(every=every) for k, v in _CLIPS.items()}
    aligned = {k: v.format(det=det) for k, v in _ALIGNED.items()}
    out: dict = {}
    for part in (_FLOW, _FRAMES, chosen, aligned, *more):
        out |= part
    return out


_RECORD = """SELECT 'V' || video || '/' || frame_idx AS frame_id, ms AS ts, zone_id, CAST(zone_ord AS INT) AS zone_pos, round(density, 6) AS density,
    round({anomaly}, 6) AS anomaly, round(conf, 6) AS conf, CAST(people_count AS INT) AS people_count"""
_COLUMNS = ["frame_id", "ts", "zone_id", "zone_pos", "density", "anomaly", "conf", "people_count"]


def _written(t, rows, name: str):
    """Records as perception lines and back."""
    path = run_folder(t.spark, name)
    sinks.write_lines(sinks.frame_lines(rows), path)
    back = readers.perception_rows(readers.perception_frames(t.spark, path))
    return rounded(back.select(*[F.col(c).cast("int").alias(c) if c in ("zone_pos", "people_count") else F.col(c) for c in _COLUMNS]), 6)


@query("baseline_video", "X01 S15 W16 W17 A02 M04", _RECORD.format(anomaly="anomaly") + " FROM base", recursive=True, views=_views(None, _CARRIED, _NORMED, _smooth("raw", "base")))
def _(t):
    return _written(t, N.baseline(t.video_frames, t.video_detections, t.video_flow, CFG), "baseline")


@query("feature_extraction", "X06 S03 W06", """
    SELECT 'd' || video % 2 AS dataset, CASE WHEN video < 2 THEN 'train' ELSE 'test' END AS split, 'V' || video AS video, source_index AS "sourceFrameIndex", processed AS "processedFrameIndex",
           ms AS ts, zone_id AS "zoneId", round(conf, 6) AS conf, people_count AS "peopleCount", round(density, 6) AS density, round(speed_mean, 6) AS speed_mean, round(speed_var, 6) AS speed_var,
           round(dir_entropy, 6) AS dir_entropy, round(divergence, 6) AS divergence, round(turbulence, 6) AS turbulence, round(speed_mean - lag(speed_mean, 1, 0e0) OVER w, 6) AS delta_speed_mean,
           round(dir_entropy - lag(dir_entropy, 1, 0e0) OVER w, 6) AS delta_dir_entropy, round(density - lag(density, 1, 0e0) OVER w, 6) AS delta_density
    FROM dense WINDOW w AS (PARTITION BY video, zone_id ORDER BY frame_idx)""", views=_views(None, _CARRIED))
def _(t):
    """The table is written for one dataset and split after another; a second run of one replaces that one and leaves the others."""
    path = run_folder(t.spark, "extracted")
    rows = N.extract_features(t.video_frames, t.video_detections, t.video_flow, CFG)
    wrong = rows.where("dataset = 'd1' AND split = 'test'").withColumn("density", F.lit(-1.0))
    sinks.replace_features(rows.where("NOT (dataset = 'd1' AND split = 'test')").unionByName(wrong), path)
    sinks.replace_features(rows.where("dataset = 'd1' AND split = 'test'"), path)
    back = readers.feature_tables(t.spark, [path]).drop("source_file")
    return rounded(back, 6)


_RISK_LIST = "[" + ", ".join(f"{K.CLASS_RISK[c]}e0" for c in K.CLASS_NAMES) + "]"
_NAME_LIST = "[" + ", ".join(f"'{c}'" for c in K.CLASS_NAMES) + "]"
_EXPECTED = f"greatest(0e0, least(1e0, list_reduce(list_transform(range(1, 12), lambda i: probs[i] * ({_RISK_LIST})[i]), lambda a, x: a + x, 0e0)))"
_PREDICTION = f", clip_index, ({_NAME_LIST})[best + 1] AS pred_label, round(pred_conf, 6) AS pred_conf"


@query("behaviour_video", "X02 S15 W18 W19 P25 P26", _RECORD.format(anomaly="anomaly") + _PREDICTION + " FROM blend", recursive=True, views=_views(
    2, "CASE WHEN runs THEN frame_idx END", {"blended": f"SELECT *, least(1e0, 0.7e0 * ({_RISK_LIST})[best + 1] + 0.3e0 * density) AS value FROM dense"}, _smooth("blended", "blend")))
def _(t):
    """Perception and behaviour records of clips; every second clip runs the detector and the others count no one."""
    rows = cut_lineage(N.behaviour(t.video_frames, t.video_detections, t.video_clips, CFG, detect_every_clips=2))
    path = run_folder(t.spark, "behaviour")
    sinks.write_lines(sinks.behaviour_lines(rows), path)
    said = readers.behaviour_rows(t.spark, path).select("frame_id", "clip_index", "pred_label", "pred_conf")
    return rounded(_written(t, rows, "perception").join(said, "frame_id"), 6)


_SPREAD = {"activity_of": """SELECT *, least(1e0, 0.6e0 * least(1e0, density) + 0.4e0 * least(1e0, 0.4e0 * sn + 0.4e0 * tn + 0.2e0 * dir_entropy)) AS active FROM base""",
           "weighed": f"""SELECT *, count(*) OVER w * CASE WHEN sum(active) OVER w <= 1e-6 THEN 1e0 / count(*) OVER w ELSE active / sum(active) OVER w END AS share,
               {_EXPECTED} AS expected FROM activity_of WINDOW w AS (PARTITION BY video, frame_idx)"""}
_UNIT = "greatest(0e0, least(1e0, {}))"


@query("hybrid_video", "X03 S15 W12 P24", _RECORD.format(anomaly="anomaly") + _PREDICTION + ", round(expected, 6) AS expected_risk FROM hybrid", recursive=True, views=_views(
    2, _CARRIED, _NORMED, _smooth("raw", "base"), _SPREAD, {"mixed": f"""SELECT * EXCLUDE (value, anomaly, rn), {_UNIT.format(f"(1 - mix) * anomaly + mix * {_UNIT.format('expected * share')}")} AS value
        FROM (SELECT *, least(1e0, 0.65e0 * pred_conf) AS mix FROM weighed)"""}, _smooth("mixed", "hybrid")))
def _(t):
    rows = cut_lineage(N.fused(t.video_frames, t.video_detections, t.video_flow, t.video_clips, CFG, detect_every_clips=2))
    path = run_folder(t.spark, "behaviour")
    sinks.write_lines(sinks.behaviour_lines(rows, "expected_risk"), path)
    said = readers.behaviour_rows(t.spark, path).select("frame_id", "clip_index", "pred_label", "pred_conf", "expected_risk")
    return rounded(_written(t, rows, "perception").join(said, "frame_id"), 6)


_MIL = """1 / (1 + exp(-(list_reduce(list_transform(range(8), lambda h: ((h % 3 - 1) / 2e0 + 0.25e0) * greatest(0e0,
    list_sum(list_transform(range(64), lambda j: CAST(embedding[j + 1] AS DOUBLE) * (((h * 7 + j * 3) % 11 - 5) / 10e0))) + h / 10e0 - 0.3e0)), lambda a, x: a + x, 0e0) - 0.1e0)))"""


@query("ensemble_video", "X04 S15 W13 P24 M07", _RECORD.format(anomaly="anomaly") + _PREDICTION + """, round(expected, 6) AS expected_risk, round(mil, 6) AS mil_score,
    round(mix, 6) AS paper_mix, 0.25e0 AS mil_mix, round(greatest(0e0, 0.75e0 - mix), 6) AS base_mix FROM ensemble""", recursive=True, views=_views(
    2, _CARRIED, _NORMED, _smooth("raw", "base"), _SPREAD, {"mixed": f"""SELECT * EXCLUDE (value, anomaly, rn),
        {_UNIT.format(f"b / total * anomaly + mix / total * {_UNIT.format('expected * share')} + 0.25e0 / total * {_UNIT.format('mil * share')}")} AS value
        FROM (SELECT *, greatest(0e0, 0.75e0 - mix) AS b, greatest(0e0, 0.75e0 - mix) + mix + 0.25e0 AS total FROM (SELECT *, least(1e0, 0.55e0 * pred_conf) AS mix, {_MIL} AS mil FROM weighed))"""},
    _smooth("mixed", "ensemble")))
def _(t):
    clips = ml.segment_scores(t.video_clips, *_weights(), name="mil_score")
    rows = cut_lineage(N.fused(t.video_frames, t.video_detections, t.video_flow, clips, CFG, FusionConfig(paper_weight=0.55), detect_every_clips=2, mil_score="mil_score"))
    path = run_folder(t.spark, "debug")
    sinks.write_lines(sinks.debug_lines(rows), path)
    said = readers.debug_rows(t.spark, path).select("frame_id", "clip_index", "pred_label", "pred_conf", "expected_risk", "mil_score", "paper_mix", "mil_mix", "base_mix")
    return rounded(_written(t, rows, "perception").join(said, "frame_id"), 6)


_KINDS = {"people": "person", "vehicle": "vehicle", "head": "head"}


@query("head_vehicle_video", "X05 A03 A26 W17", """, region AS (
    SELECT video, frame_idx, rn, heads, value, value AS scale FROM region_order WHERE rn = 1
    UNION ALL SELECT o.video, o.frame_idx, o.rn, o.heads, o.value, CASE WHEN o.value IS NULL THEN f.scale WHEN f.scale IS NULL THEN o.value ELSE 0.2e0 * o.value + (1 - 0.2e0) * f.scale END
    FROM region f JOIN region_order o ON o.video = f.video AND o.rn = f.rn + 1)
    SELECT 'V' || s.video AS video, s.frame_idx, CAST(floor(source_index * 1000 / 12e0) AS BIGINT) AS ts, z.zone_id, """ + ", ".join(
        f"coalesce(n_{n}, 0) AS {n}_count, round(least(1e0, coalesce(n_{n}, 0) / 25e0), 6) AS {n}_density, round(coalesce(c_{n} / n_{n}, 0.6e0), 6) AS {n}_conf" for n in _KINDS) + """,
        r.heads AS roi_heads, round(CASE WHEN r.scale > 1e-6 THEN r.heads / greatest(1e-6, 45600e0 / (r.scale * r.scale)) ELSE 0e0 END, 6) AS roi_density
    FROM served s CROSS JOIN zones z LEFT JOIN per_zone d ON d.video = s.video AND d.det_frame = s.det_frame AND d.zone_id = z.zone_id JOIN region r ON r.video = s.video AND r.frame_idx = s.frame_idx""",
       recursive=True, views=_FRAMES | _SAMPLED | {
    "served": f"SELECT *, {_CARRIED} AS det_frame FROM chosen c",
    "per_zone": "SELECT frame_id % 4 AS video, frame_id // 4 AS det_frame, zone_id, " + ", ".join(
        f"nullif(count(*) FILTER (label = '{label}'), 0) AS n_{n}, sum(conf) FILTER (label = '{label}') AS c_{n}" for n, label in _KINDS.items()) + " FROM located WHERE zone_id IS NOT NULL GROUP BY ALL",
    "inside": "SELECT frame_id % 4 AS video, frame_id // 4 AS det_frame, label, y2 - y1 AS h FROM detections WHERE 0.5e0 * (x1 + x2) BETWEEN 40 AND 280 AND 0.5e0 * (y1 + y2) BETWEEN 30 AND 220",
    "tall": """SELECT video, det_frame, CASE label WHEN 'person' THEN h ELSE 7 * h END AS h FROM inside i WHERE label = 'person'
        OR (label = 'head' AND NOT EXISTS (SELECT 1 FROM inside p WHERE p.video = i.video AND p.det_frame = i.det_frame AND p.label = 'person'))""",
    "middle": "SELECT video, det_frame, CASE WHEN count(*) >= 3 THEN quantile_cont(h, 0.5) / 1.7e0 END AS value FROM tall WHERE h BETWEEN 35 AND 520 GROUP BY ALL",
    "region_order": """SELECT s.video, s.frame_idx, coalesce(heads, 0) AS heads, value, row_number() OVER (PARTITION BY s.video ORDER BY s.frame_idx) AS rn FROM served s
        LEFT JOIN (SELECT video, det_frame, count(*) FILTER (label = 'head') AS heads FROM inside GROUP BY ALL) h USING (video, det_frame) LEFT JOIN middle USING (video, det_frame)"""})
def _(t):
    rows = N.head_vehicle_counts(t.video_frames, t.video_detections, CFG, RoiDensityConfig(roi=tuple(ROI)))
    return rounded(rows.drop("roi_level"), 6)
