"""Detections, motion, fusion and polygons per zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..config import RoiDensityConfig
from ..functions import geometry as G, scalars as S
from ..operators import crash, fusion, motion, spatial, zones as Z
from .catalog import query, rounded


@query("detections_by_zone", "P10 J03 A01 P34", """
    SELECT frame_id, zone_id, count(*) AS n, round(sum(conf), 9) AS conf_sum FROM located WHERE zone_id IS NOT NULL GROUP BY ALL""")
def _(t):
    return rounded(Z.detections_by_zone(t.detections))


@query("detections_of_people", "P34 A01", """
    SELECT zone_id, count(*) AS n FROM located WHERE zone_id IS NOT NULL AND label = 'person' GROUP BY ALL""")
def _(t):
    return Z.detections_by_zone(t.detections, labels=["person"]).groupBy("zone_id").agg(F.sum("n").alias("n"))


@query("zone_density", "A02 J13 P38", """
    SELECT f.frame_id, z.zone_id, least(1e0, coalesce(n, 0) / 25e0) AS density, round(coalesce(c / n, 0.6e0), 9) AS conf, coalesce(n, 0) AS people_count
    FROM (SELECT DISTINCT frame_id FROM detections) f CROSS JOIN zones z LEFT JOIN (
        SELECT frame_id, zone_id, count(*) AS n, sum(conf) AS c FROM located GROUP BY ALL) l ON l.frame_id = f.frame_id AND l.zone_id = z.zone_id""")
def _(t):
    frames = t.detections.select("frame_id").distinct()
    return rounded(Z.zone_density(Z.detections_by_zone(t.detections), frames))


@query("head_vehicle_pivot", "A03 A34", """
    SELECT frame_id, zone_id, count(*) FILTER (label = 'person') AS people, count(*) FILTER (label = 'vehicle') AS vehicles,
           count(*) FILTER (label = 'head') AS heads, round(least(1e0, count(*) FILTER (label <> 'head') / 25e0), 9) AS activity
    FROM located WHERE zone_id IS NOT NULL GROUP BY ALL""")
def _(t):
    return rounded(Z.label_counts(t.detections))


@query("located_by_grid", "J03", """
    SELECT zone_id, count(*) AS n FROM located GROUP BY zone_id""")
def _(t):
    cx, cy = G.box_centre(F.col("bbox"))
    points = t.detections.select(F.struct("frame_id", "line", "l_partkey", "l_suppkey", "bbox").alias("point_id"), cx.alias("x"), cy.alias("y"))
    return Z.locate_in_grid(points, Z.default_zones(t.spark)).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


@query("head_proxy_boxes", "P11", """
    SELECT frame_id, line, l_partkey, l_suppkey, round(greatest(0e0, mid - w / 2), 9) AS hx1, y1 AS hy1, round(least(319e0, mid + w / 2), 9) AS hx2,
           round(least(239e0, y1 + h), 9) AS hy2 FROM (
        SELECT *, 0.5e0 * (x1 + x2) AS mid, greatest(4e0, greatest(1e0, x2 - x1) * 0.6e0) AS w, greatest(4e0, greatest(1e0, y2 - y1) * 0.35e0) AS h
        FROM detections WHERE label = 'person')""")
def _(t):
    d = t.detections.withColumns({"classId": F.lit(0), "className": F.lit("person")})
    heads = Z.with_head_proxies(d).filter("className = 'head_proxy'")
    return rounded(heads.select("frame_id", "line", "l_partkey", "l_suppkey", F.col("bbox")[0].alias("hx1"), F.col("bbox")[1].alias("hy1"),
                                F.col("bbox")[2].alias("hx2"), F.col("bbox")[3].alias("hy2")))


@query("bbox_normalise", "P12 P33", """
    SELECT frame_id, line, l_partkey, l_suppkey, round(greatest(0e0, least(100e0, x1 / 320 * 100)), 6) AS left_pct,
           round(greatest(0e0, least(100e0, y1 / 240 * 100)), 6) AS top_pct, round(greatest(0.8e0, least(100e0, (x2 - x1) / 320 * 100)), 6) AS width_pct,
           round(greatest(0.8e0, least(100e0, (y2 - y1) / 240 * 100)), 6) AS height_pct FROM detections WHERE label = 'vehicle'""")
def _(t):
    d = t.detections.filter((F.col("label") == "vehicle") & G.valid_box(F.col("bbox")))
    pct = G.percent_box(F.col("bbox"), K.FRAME_WIDTH, K.FRAME_HEIGHT)
    return rounded(d.select("frame_id", "line", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in pct.items()]), 6)


@query("zone_motion_features", "A08 A09 A11", """
    SELECT ts, zone_id, round(speed_mean, 9) AS speed_mean, round(speed_var, 9) AS speed_var, round(dir_entropy, 9) AS dir_entropy,
           round(divergence, 9) AS divergence, round(turbulence, 9) AS turbulence FROM features""")
def _(t):
    return rounded(t.features.select("ts", "zone_id", "speed_mean", "speed_var", "dir_entropy", "divergence", "turbulence"))


@query("motion_occupancy", "A10", """
    SELECT ts, zone_id, samples, active_samples, round(density, 9) AS occupancy FROM features""")
def _(t):
    return rounded(t.features.select("ts", "zone_id", "samples", "active_samples", "occupancy"))


@query("feature_deltas", "W06", """
    SELECT ts, zone_id, round(speed_mean - coalesce(lag(speed_mean) OVER w, 0e0), 9) AS delta_speed_mean,
           round(dir_entropy - coalesce(lag(dir_entropy) OVER w, 0e0), 9) AS delta_dir_entropy,
           round(density - coalesce(lag(density) OVER w, 0e0), 9) AS delta_density FROM features WINDOW w AS (PARTITION BY zone_id ORDER BY ts)""")
def _(t):
    rows = motion.feature_rows(t.features, ["zone_id"], ["ts"])
    return rounded(rows.select("ts", "zone_id", "delta_speed_mean", "delta_dir_entropy", "delta_density"))


@query("fallback_anomaly", "W09 W14", "SELECT ts, zone_id, round(anomaly_raw, 9) AS anomaly_raw FROM fallback")
def _(t):
    return rounded(fusion.fallback_anomaly(t.features).select("ts", "zone_id", "anomaly_raw"))


@query("activity_weights", "W10", "SELECT ts, zone_id, round(weight, 9) AS weight FROM activity")
def _(t):
    return rounded(fusion.activity_weights(t.features).select("ts", "zone_id", "weight"))


# global score and confidence of a frame, derived from its number, stand in for a behaviour model's output
_GLOBAL = "(ts % 10) / 10e0"
_CONF = "(ts % 7) / 7e0"


@query("spatialised_risk", "W11", f"""
    SELECT ts, zone_id, round(greatest(0e0, least(1e0, {_GLOBAL} * weight * zones_at_ts)), 9) AS zone_risk FROM activity""")
def _(t):
    a = fusion.activity_weights(t.features)
    risk = fusion.spatialised((F.col("ts") % 10) / 10.0, F.col("weight"), F.col("zones_at_ts"))
    return rounded(a.select("ts", "zone_id", risk.alias("zone_risk")))


def _fused(t, three_way):
    rows = fusion.activity_weights(fusion.fallback_anomaly(t.features))
    behaviour = fusion.spatialised((F.col("ts") % 10) / 10.0, F.col("weight"), F.col("zones_at_ts"))
    conf = (F.col("ts") % 7) / 7.0
    if three_way:
        mil = fusion.spatialised((F.col("ts") % 4) / 4.0, F.col("weight"), F.col("zones_at_ts"))
        value = fusion.three_way(F.col("anomaly_raw"), behaviour, mil, conf)
    else:
        value = fusion.two_way(F.col("anomaly_raw"), behaviour, conf)
    rows = rows.select("ts", "zone_id", value.alias("fused"))
    return rounded(fusion.smoothed(rows, ["zone_id"], ["ts"], "fused").select("ts", "zone_id", "fused", "anomaly"))


_FUSE_FOLD = """, fold AS (
    SELECT zone_id, ts, rn, fused, fused AS anomaly FROM ordered WHERE rn = 1
    UNION ALL SELECT o.zone_id, o.ts, o.rn, o.fused, 0.7e0 * f.anomaly + (1 - 0.7e0) * o.fused
    FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1)
    SELECT ts, zone_id, round(fused, 9) AS fused, round(anomaly, 9) AS anomaly FROM fold"""
_SPREAD = "greatest(0e0, least(1e0, {} * weight * zones_at_ts))"


@query("hybrid_fusion", "W12", _FUSE_FOLD, recursive=True, views={"ordered": f"""
    SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY ts) AS rn FROM (
        SELECT ts, zone_id, greatest(0e0, least(1e0, (1 - mix) * anomaly_raw + mix * spread)) AS fused FROM (
            SELECT *, least(1e0, 0.65e0 * {_CONF}) AS mix, {_SPREAD.format(_GLOBAL)} AS spread FROM activity JOIN fallback USING (ts, zone_id)))"""})
def _(t):
    return _fused(t, False)


@query("ensemble_fusion", "W13", _FUSE_FOLD, recursive=True, views={"ordered": f"""
    SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY ts) AS rn FROM (
        SELECT ts, zone_id, greatest(0e0, least(1e0, b / total * anomaly_raw + mix / total * spread + 0.25e0 / total * mil)) AS fused FROM (
            SELECT *, greatest(0e0, 1 - mix - 0.25e0) AS b, greatest(0e0, 1 - mix - 0.25e0) + mix + 0.25e0 AS total FROM (
                SELECT *, least(1e0, 0.65e0 * {_CONF}) AS mix, {_SPREAD.format(_GLOBAL)} AS spread, {_SPREAD.format('(ts % 4) / 4e0')} AS mil
                FROM activity JOIN fallback USING (ts, zone_id))))"""})
def _(t):
    return _fused(t, True)


@query("baseline_inference", "M04", """, fold AS (
    SELECT zone_id, ts, rn, anomaly_raw AS anomaly FROM ordered WHERE rn = 1
    UNION ALL SELECT o.zone_id, o.ts, o.rn, 0.7e0 * f.anomaly + (1 - 0.7e0) * o.anomaly_raw FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1)
    SELECT ts, zone_id, round(anomaly, 9) AS anomaly FROM fold""", recursive=True, views={
        "ordered": "SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY ts) AS rn FROM fallback"})
def _(t):
    from ..operators.ml import anomaly_scores
    return rounded(anomaly_scores(t.features, ["zone_id"], ["ts"]).select("ts", "zone_id", "anomaly"))


@query("behaviour_blend", "P26 W18", """, fold AS (
    SELECT zone_id, ts, rn, r AS risk FROM ordered WHERE rn = 1
    UNION ALL SELECT o.zone_id, o.ts, o.rn, 0.7e0 * f.risk + (1 - 0.7e0) * o.r FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1)
    SELECT ts, zone_id, round(risk, 9) AS risk FROM fold""", recursive=True, views={"ordered": f"""
    SELECT ts, zone_id, least(1e0, 0.7e0 * {_GLOBAL} + 0.3e0 * density) AS r, row_number() OVER (PARTITION BY zone_id ORDER BY ts) AS rn FROM features"""})
def _(t):
    rows = t.features.withColumn("blend", fusion.behaviour_blend((F.col("ts") % 10) / 10.0, F.col("density")))
    return rounded(fusion.smoothed(rows, ["zone_id"], ["ts"], "blend", "risk").select("ts", "zone_id", "risk"))


@query("zone_adjacency", "J08 A27", """
    SELECT src, dst, round(sqrt((ax - bx) ** 2 + (ay - cy) ** 2), 9) AS base_cost FROM (
        SELECT a.zone_id AS src, b.zone_id AS dst, (a.zx0 + a.zx1) / 2e0 AS ax, (a.zy0 + a.zy1) / 2e0 AS ay, (b.zx0 + b.zx1) / 2e0 AS bx, (b.zy0 + b.zy1) / 2e0 AS cy
        FROM zones a JOIN zones b ON a.zone_id <> b.zone_id AND (
            ((a.zx1 = b.zx0 OR b.zx1 = a.zx0) AND least(a.zy1, b.zy1) > greatest(a.zy0, b.zy0))
            OR ((a.zy1 = b.zy0 OR b.zy1 = a.zy0) AND least(a.zx1, b.zx1) > greatest(a.zx0, b.zx0)))), (SELECT count(*) FROM events)""")
def _(t):
    """Adjacency of the zones that events were seen in."""
    seen = t.perception.select("zone_id").distinct()
    return rounded(Z.zone_adjacency(Z.default_zones(t.spark).join(seen, "zone_id", "left_semi")))


@query("polygon_metrics", "A27", """
    SELECT frame_id, line, l_partkey, l_suppkey, round((x2 - x1) * (y2 - y1), 6) AS area, round(0.5e0 * (x1 + x2), 6) AS cx, round(0.5e0 * (y1 + y2), 6) AS cy,
           round(x1, 6) AS x0, round(y2, 6) AS y1 FROM detections""")
def _(t):
    b = F.col("bbox")
    corner = lambda i, j: F.struct(b[i].alias("x"), b[j].alias("y"))
    polygon = F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3))
    d = t.detections.withColumn("polygon", polygon)
    mx, my = G.vertex_mean(F.col("polygon"))
    box = G.bounding_box(F.col("polygon"))
    return rounded(d.select("frame_id", "line", "l_partkey", "l_suppkey", G.polygon_area(F.col("polygon")).alias("area"), mx.alias("cx"),
                            my.alias("cy"), box["x0"].alias("x0"), box["y1"].alias("y1")), 6)


ROI = [(40, 30), (280, 30), (280, 220), (40, 220)]


@query("roi_density", "A26 W03 J04 P07", """, fold AS (
    SELECT camera, frame_id, rn, heads, raw AS scale FROM ordered WHERE rn = 1
    UNION ALL SELECT o.camera, o.frame_id, o.rn, o.heads, CASE WHEN o.raw IS NULL THEN f.scale WHEN f.scale IS NULL THEN o.raw ELSE 0.2e0 * o.raw + (1 - 0.2e0) * f.scale END
    FROM fold f JOIN ordered o ON o.camera = f.camera AND o.rn = f.rn + 1)
    SELECT camera, frame_id, heads, round(scale, 9) AS scale, round(coalesce(heads / (45600e0 / (scale * scale)), 0e0), 9) AS density,
           CASE WHEN scale IS NULL THEN 'unknown' WHEN heads / (45600e0 / (scale * scale)) > 6 THEN 'extreme' WHEN heads / (45600e0 / (scale * scale)) > 4 THEN 'high_risk'
                WHEN heads / (45600e0 / (scale * scale)) >= 2 THEN 'crowded' ELSE 'safe' END AS level FROM fold""", recursive=True, views={
        "inside": """SELECT frame_id % 50 AS camera, frame_id, label, y2 - y1 AS h FROM detections
                     WHERE 0.5e0 * (x1 + x2) BETWEEN 40 AND 280 AND 0.5e0 * (y1 + y2) BETWEEN 30 AND 220""",
        "heights": """SELECT frame_id, CASE label WHEN 'person' THEN h ELSE 7 * h END AS h FROM inside i WHERE label = 'person'
                      OR (label = 'head' AND NOT EXISTS (SELECT 1 FROM inside p WHERE p.frame_id = i.frame_id AND p.label = 'person'))""",
        "medians": """SELECT frame_id, CASE WHEN count(*) >= 3 THEN quantile_cont(h, 0.5) / 1.7e0 END AS raw FROM heights WHERE h BETWEEN 35 AND 520 GROUP BY frame_id""",
        "ordered": """SELECT frame_id % 50 AS camera, frame_id, coalesce(heads, 0) AS heads, raw, row_number() OVER (PARTITION BY frame_id % 50 ORDER BY frame_id) AS rn
                      FROM (SELECT DISTINCT frame_id FROM detections) LEFT JOIN (SELECT frame_id, count(*) FILTER (label = 'head') AS heads FROM inside GROUP BY frame_id) USING (frame_id)
                      LEFT JOIN medians USING (frame_id)"""})
def _(t):
    d = t.detections.withColumn("camera", F.col("frame_id") % 50)
    out = spatial.roi_density(d, RoiDensityConfig(roi=tuple(ROI)))
    return rounded(out.select("camera", "frame_id", "heads", "scale", "density", "level"))


@query("head_spacing", "J07", """
    SELECT frame_id, x, y, round(min(sqrt((x - ox) ** 2 + (y - oy) ** 2)), 6) AS spacing FROM (
        SELECT a.frame_id, a.x, a.y, b.x AS ox, b.y AS oy FROM spots a JOIN spots b ON a.frame_id = b.frame_id AND (a.x <> b.x OR a.y <> b.y) WHERE a.n = 1)
    GROUP BY ALL""", views={"spots": """
        SELECT frame_id % 100 AS frame_id, round(0.5e0 * (x1 + x2), 6) AS x, round(0.5e0 * (y1 + y2), 6) AS y, count(*) AS n FROM detections WHERE label = 'head' GROUP BY ALL"""})
def _(t):
    cx, cy = G.box_centre(F.col("bbox"))
    points = t.detections.filter("label = 'head'").select((F.col("frame_id") % 100).alias("frame_id"), F.round(cx, 6).alias("x"), F.round(cy, 6).alias("y"))
    return rounded(spatial.nearest_spacing(points), 6)


@query("density_map_roi", "A28", """
    SELECT frame_id, round(sum(v), 6) AS total, round(coalesce(sum(v) FILTER (x BETWEEN 10 AND 70 AND y BETWEEN 8 AND 55), 0e0), 6) AS in_roi FROM (
        SELECT year(l_shipdate) * 12 + month(l_shipdate) AS frame_id, l_partkey % 80 AS x, l_suppkey % 60 AS y, l_discount AS v FROM lineitem) GROUP BY frame_id""")
def _(t):
    ship = F.col("l_shipdate").cast("timestamp")
    cells = t.read("lineitem").select((F.year(ship) * 12 + F.month(ship)).cast("bigint").alias("frame_id"), (F.col("l_partkey") % 80).alias("x"),
                                      (F.col("l_suppkey") % 60).alias("y"), F.col("l_discount").alias("v"))
    return rounded(Z.density_map_counts(cells, ROI, (320, 240), (80, 60)), 6)


@query("affine_fit", "A25", """
    SELECT n, round(a_lat, 6) AS a_lat, round(b_lat, 6) AS b_lat, round(ml - a_lat * mx - b_lat * my, 6) AS c_lat FROM (
        SELECT *, (sxl * syy - syl * sxy) / (sxx * syy - sxy * sxy) AS a_lat, (syl * sxx - sxl * sxy) / (sxx * syy - sxy * sxy) AS b_lat FROM (
            SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS ml, var_pop(l_quantity) AS sxx, var_pop(l_discount) AS syy,
                   covar_pop(l_quantity, l_discount) AS sxy, covar_pop(l_quantity, l_extendedprice) AS sxl, covar_pop(l_discount, l_extendedprice) AS syl FROM lineitem))""")
def _(t):
    anchors = t.read("lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("lat"),
                                        F.col("l_tax").alias("lng"))
    return rounded(spatial.affine_fit(anchors).select("n", "a_lat", "b_lat", "c_lat"), 6)


@query("projected_points", "J14 A25", """
    SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'anchor' ELSE 'fitted' END AS source, round(1.2e0 + 0.001e0 * (s_suppkey % 37) + 0.002e0 * s_nationkey, 6) AS lat
    FROM supplier""")
def _(t):
    """Suppliers on a plan; every third is an anchor on a known plane, which the fit recovers."""
    n = t.read("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 37).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    anchors = n.filter("id % 3 = 0").select("id", "x", "y", (1.2 + 0.001 * F.col("x") + 0.002 * F.col("y")).alias("lat"),
                                             (103.6 + 0.003 * F.col("x") - 0.001 * F.col("y")).alias("lng"))
    fit = spatial.affine_fit(anchors).first()
    return rounded(spatial.project(n, fit, anchors).select("id", "source", "lat"), 6)


@query("frame_anomaly", "A33", "SELECT ts, round(avg(anomaly_raw), 9) AS mean_anomaly FROM fallback GROUP BY ts")
def _(t):
    return rounded(fusion.fallback_anomaly(t.features).groupBy("ts").agg(F.avg("anomaly_raw").alias("mean_anomaly")))


@query("label_lines", "A37 P12 P23", """
    SELECT frame_id AS image, l_partkey, l_suppkey, line AS line_no, format('{} {:.6f} {:.6f} {:.6f} {:.6f}', l_suppkey % 5, (x1 + (x2 - x1) * 0.5e0) / 320,
           (y1 + (y2 - y1) * 0.5e0) / 240, (x2 - x1) / 320, (y2 - y1) / 240) AS line FROM detections d
    WHERE label = 'vehicle' AND (SELECT count(*) FROM detections o WHERE o.frame_id = d.frame_id AND o.label = 'vehicle') >= 2""")
def _(t):
    from ..operators.metrics import kept_images
    lines = t.detections.filter("label = 'vehicle'").select(
        F.col("frame_id").alias("image"), "l_partkey", "l_suppkey", F.col("line").alias("line_no"),
        G.label_line(F.col("l_suppkey") % 5, F.col("bbox"), K.FRAME_WIDTH, K.FRAME_HEIGHT).alias("line"))
    return kept_images(lines, min_boxes=2)


@query("detections_in_many_zones", "J03 A01 A03", """
    SELECT 'Z' || CAST(py // 30 * 64 + px // 30 AS VARCHAR) AS zone_id, count(*) AS n
    FROM (SELECT CAST(round_even(0.5e0 * (6e0 * x1 + 6e0 * x2), 0) AS BIGINT) AS px, CAST(round_even(0.5e0 * (4.5e0 * y1 + 4.5e0 * y2), 0) AS BIGINT) AS py
        FROM detections)
    WHERE px >= 0 AND px < 1920 AND py >= 0 AND py < 1080 AND px % 30 <> 0 AND py % 30 <> 0
        AND (py // 30 * 64 + px // 30) < (SELECT count(*) FROM part) GROUP BY 1""")
def detections_in_many_zones(t):
    """Zones from a table, over 64 of them, on a frame of 1920 x 1080; boxes on a border between zones are left out on both sides."""
    parts = t.spark.read.parquet(f"{t.folder}/part.parquet")
    n = parts.count()
    ord_ = F.col("id")
    x, y = (ord_ % 64 * 30).cast("double"), (F.floor(ord_ / 64) * 30).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    zones = t.spark.range(n).select(F.concat(F.lit("Z"), ord_.cast("string")).alias("zone_id"), ord_.cast("int").alias("zone_ord"), F.lit(10.0).alias("capacity"),
                                    F.array(corner(0, 0), corner(30, 0), corner(30, 30), corner(0, 30)).alias("polygon"))
    scale = F.array(*[F.lit(v) for v in (6.0, 4.5, 6.0, 4.5)])
    boxes = t.detections.where(F.size("bbox") == 4).withColumn("bbox", F.zip_with("bbox", scale, lambda a, b: a * b))
    px, py = (S.round_half_even((F.col("bbox")[i] + F.col("bbox")[i + 2]) / 2) for i in (0, 1))
    inner = boxes.where((px % 30 != 0) & (py % 30 != 0))
    return Z.detections_by_zone(inner, zones=zones, width=1920, height=1080).groupBy("zone_id").agg(F.sum("n").cast("bigint").alias("n"))
