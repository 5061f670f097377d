"""Tables written in the external formats to the shared folder and read back through the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decision, metrics as M, sampling
from ..session import run_folder
from ..sources import catalogs, readers, sinks
from .catalog import query, rounded


@query("perception_lines", "S01 S15", """
    SELECT zone_id, count(*) AS n, count(conf) AS with_conf, round(sum(density), 6) AS density, round(sum(anomaly), 6) AS anomaly FROM perception GROUP BY zone_id""")
def _(t):
    """All perception rows as JSON lines and back."""
    path = run_folder(t.spark, "perception")
    rows = t.perception.withColumns({"zone_pos": F.lit(0), "people_count": F.lit(None).cast("int"), "ts": F.col("arrival")})
    sinks.write_lines(sinks.frame_lines(rows), path)
    back = readers.perception_rows(readers.perception_frames(t.spark, path))
    return rounded(back.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.count("conf").alias("with_conf"), F.sum("density").alias("density"),
                                               F.sum("anomaly").alias("anomaly")), 6)


@query("feature_files", "S02 S03 U01 U05 J22", """
    SELECT 'm' || (ts % 3) AS dataset, CASE WHEN ts % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n, round(sum(speed_mean), 6) AS speed
    FROM features WHERE ts % 3 <> 1 GROUP BY ALL""")
def _(t):
    """Zone features as partitioned files; one dataset is excluded when reading."""
    path = run_folder(t.spark, "features")
    rows = t.features.withColumns({"dataset": F.concat(F.lit("m"), (F.col("ts") % 3).cast("string")),
                                   "split": F.when(F.col("ts") % 2 == 0, "train").otherwise("test")})
    sinks.write_features(rows, path)
    back = readers.feature_tables(t.spark, [path], ["speed_mean", "density"])
    kept = readers.filter_datasets(back, exclude=[" M1 "])
    return rounded(kept.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("speed_mean").alias("speed")), 6)


@query("eval_log_ranking", "S17 A36", """
    SELECT CAST(row_number() OVER (ORDER BY avg(d) DESC) AS INT) AS rank, 'log' AS run, round(avg(d), 6) AS score, count(*) AS compared_pairs FROM (
        SELECT max(m) FILTER (split = 'abnormal') - max(m) FILTER (split = 'normal') + 0.5e0 * (max(p) FILTER (split = 'abnormal') - max(p) FILTER (split = 'normal')) AS d FROM (
            SELECT dataset, split, round(avg(anomaly), 9) AS m, round(quantile_cont(anomaly, 0.95), 9) AS p FROM eval_rows GROUP BY ALL) GROUP BY dataset)""")
def _(t):
    """Evaluation summary as log text, read back, scored and ranked."""
    path = f"{run_folder(t.spark, 'eval')}/log"
    s = rounded(M.eval_summary(t.eval_rows))
    line = F.concat_ws(", ", "dataset", "split", F.col("mean_anomaly").cast("string"), F.col("p95_anomaly").cast("string"))
    s.select(line.alias("value")).union(t.spark.createDataFrame([("dataset, split, mean_anomaly, p95_anomaly",)], "value string")).write.text(path)
    regions = [r.r_name for r in t.read("region").collect()]      # the five dataset names
    return rounded(M.run_scores(readers.eval_log(t.spark, path), [(r, "normal", "abnormal") for r in regions]).select("rank", "run", "score", "compared_pairs"), 6)


@query("clip_selection", "S09 O06 J17 P23", """
    SELECT dataset, video_name, start_frame, class_name FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, video_name ORDER BY start_frame, end_frame, scene, crop) AS rn FROM specs WHERE has_video) WHERE rn <= 3""", views={"specs": """
        SELECT 'alpha' AS dataset, 'v' || (o_custkey % 200) || '.mp4' AS video_name, o_orderkey AS start_frame, o_orderkey + 16 AS end_frame, 's' || (o_orderkey % 5) AS scene, '1' AS crop,
               CASE o_orderkey % 12 WHEN 0 THEN 'laminar_flow' WHEN 1 THEN 'turbulent_flow' WHEN 2 THEN 'crossing_flows' WHEN 3 THEN 'merging_flow' WHEN 4 THEN 'diverging_flow'
                   WHEN 5 THEN 'gas_free' WHEN 6 THEN 'gas_jammed' WHEN 7 THEN 'static_calm' WHEN 8 THEN 'static_agitated' WHEN 9 THEN 'interacting_crowd' WHEN 10 THEN 'no_crowd' ELSE 'class_11' END AS class_name,
               o_custkey % 200 % 7 <> 0 AS has_video FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderstatus <> 'P'"""})
def _(t):
    """Clip specifications from the orders as semicolon text with broken rows; three clips per existing video."""
    path = run_folder(t.spark, "specs")
    key = F.col("o_orderkey")
    video = F.concat(F.lit("v"), (F.col("o_custkey") % 200).cast("string"), F.lit(".mp4"))
    label = F.when(key % 9 == 0, "x").otherwise((key % 12).cast("string"))
    line = F.concat_ws(";", video, label, F.concat(key.cast("string"), F.lit(".0")), (key + 16).cast("string"), F.lit("0;0;10;10"),
                       F.when(F.col("o_orderstatus") == "P", "other").otherwise(" Alpha "), F.concat(F.lit("s"), (key % 5).cast("string")), F.lit("1.0"))
    t.read("orders").select(line.alias("value")).write.text(path)
    specs = readers.clip_specs(t.spark, path, ["alpha"])
    videos = t.read("orders").select(F.lit("alpha").alias("dataset"), video.alias("video_name"), (F.col("o_custkey") % 200 % 7 != 0).alias("has")).filter("has").distinct()
    found, _ = catalogs.with_source_video(specs, videos)
    return sampling.clip_selection(found, 3).select("dataset", "video_name", F.col("start_frame").cast("bigint").alias("start_frame"), "class_name")


@query("route_requests", "P32 P20", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'N' || user_id WHEN event_id % 3 = 1 THEN 'F' || user_id END AS current_node FROM events""")
def _(t):
    node = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    raw = t.read("events").select("event_id", F.when(F.col("event_id") % 3 == 0, node("N")).otherwise(" ").alias("currentNodeId"),
                                  F.when(F.col("event_id") % 3 != 2, node("F")).alias("fromNodeId"))
    return decision.route_requests(raw)


@query("model_labels", "U04", """
    SELECT s_nationkey, count(*) AS suppliers, bool_or(s_nationkey % 2 = 0) AS vehicle_model FROM supplier GROUP BY s_nationkey""")
def _(t):
    names = F.when(F.col("s_nationkey") % 2 == 0, F.array(*[F.lit(n) for n in ("Truck", "bus ", "car", "bicycle", "motorcycle")])) \
        .otherwise(F.array(F.lit("car"), F.lit("bus"), F.lit("car"), F.lit("truck"), F.lit("bicycle")))
    rows = t.read("supplier").withColumn("vehicle_model", catalogs.same_labels(names))
    return rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.bool_or("vehicle_model").alias("vehicle_model"))
