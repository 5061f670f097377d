"""Class probabilities, evaluation, calibration, sampling and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import constants as K
from ..config import ForestConfig
from ..functions import scalars as S
from ..operators import fusion, metrics as M, ml, sampling
from .catalog import query, rounded

_RISKS = "[0.20e0, 0.78e0, 0.55e0, 0.62e0, 0.35e0, 0.15e0, 0.90e0, 0.08e0, 0.68e0, 0.95e0, 0.00e0]"


@query("expected_risk", "P24 P23", f"""
    SELECT clip_idx, round(list_sum(list_transform(range(1, 12), lambda i: probs[i] * ({_RISKS})[i])), 9) AS expected_risk FROM clip_vectors""")
def _(t):
    return rounded(t.clip_vectors.select("clip_idx", S.expected_class_risk(F.col("probs")).alias("expected_risk")))


_NAMES = "['" + "', '".join(K.CLASS_NAMES) + "']"


@query("argmax_class", "P25 J20 P23", f"""
    SELECT clip_idx, pred, ({_NAMES})[pred + 1] AS class_name, round(list_max(probs), 9) AS conf FROM (
        SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred FROM clip_vectors)""")
def _(t):
    best = S.first_argmax(F.col("probs"))
    name = S.lookup(best, dict(enumerate(K.CLASS_NAMES)), best.cast("string"))
    return rounded(t.clip_vectors.select("clip_idx", best.alias("pred"), name.alias("class_name"), F.array_max("probs").alias("conf")))


@query("video_vote", "A21", """
    SELECT video, CAST(arg_max(c, (p, -c)) AS INT) AS pred, round(max(p), 9) AS pred_prob FROM (
        SELECT video, c, avg(p) AS p FROM (
            SELECT video, unnest(range(0, 11)) AS c, unnest(probs) AS p FROM (
                SELECT *, row_number() OVER (PARTITION BY video ORDER BY clip_idx) AS rn FROM clip_vectors) WHERE rn <= 10) GROUP BY video, c) GROUP BY video""")
def _(t):
    return rounded(M.video_votes(t.clip_vectors))


_BAGS = """
    SELECT video, n AS clips, s AS sparsity, topk_mean, coalesce(smooth, 0e0) AS smoothness FROM (
        SELECT video, count(*) AS n, avg(score) AS s, avg((score - prev) ** 2) AS smooth FROM (
            SELECT *, lag(score) OVER (PARTITION BY video ORDER BY clip_idx) AS prev FROM scored) GROUP BY video)
    JOIN (SELECT video, avg(score) AS topk_mean FROM (
        SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, clip_idx) AS rn, count(*) OVER (PARTITION BY video) AS n FROM scored)
        WHERE rn <= greatest(1, round_even(0.1e0 * n, 0)) GROUP BY video) USING (video)"""
_SCORED = {"scored": "SELECT video, clip_idx, list_max(probs) AS score FROM clip_vectors", "bags": _BAGS}


def _bags(t):
    return M.bag_stats(t.clip_vectors.select("video", "clip_idx", F.array_max("probs").alias("score")))


@query("mil_bag_stats", "A24", """
    SELECT video, clips, round(sparsity, 9) AS sparsity, round(topk_mean, 9) AS topk_mean, round(smoothness, 9) AS smoothness FROM bags""", views=_SCORED)
def _(t):
    return rounded(_bags(t))


@query("labelled_bags", "U03", """
    SELECT bag_label, video, count(*) AS clips, round(sum(score), 9) AS score FROM (
        SELECT CAST(video % 3 = 0 AS INT) AS bag_label, video, list_max(probs) AS score, row_number() OVER (PARTITION BY video ORDER BY clip_idx) AS n FROM clip_vectors) WHERE n <= 12 GROUP BY ALL""")
def _(t):
    """Bags of both kinds, each cut to its first twelve clips."""
    clips = t.clip_vectors.select("video", "clip_idx", F.array_max("probs").alias("score"))
    bags = M.labelled_bags(clips.where("video % 3 <> 0"), clips.where("video % 3 = 0").select("score", "clip_idx", "video"), max_clips=12)
    return rounded(bags.groupBy("bag_label", "video").agg(F.count(F.lit(1)).alias("clips"), F.sum("score").alias("score")))


@query("mil_pair_loss", "A24", """
    SELECT a.video // 2 AS pair_id, round(greatest(0e0, 1 - (a.topk_mean - b.topk_mean)), 9) AS ranking,
           round(greatest(0e0, 1 - (a.topk_mean - b.topk_mean)) + 8e-5 * a.sparsity + 8e-5 * a.smoothness, 9) AS total
    FROM bags a JOIN bags b ON b.video = a.video + 1 WHERE a.video % 2 = 0""", views=_SCORED)
def _(t):
    bags = _bags(t).withColumn("pair_id", F.floor(F.col("video") / 2))
    return rounded(M.bag_pair_loss(bags.filter("video % 2 = 0"), bags.filter("video % 2 = 1")).select("pair_id", "ranking", "total"))


@query("classification_metrics", "A22", """
    SELECT round(avg(CAST((score >= 0.5e0) = (label = 1) AS INT)), 9) AS accuracy,
           round(2e0 * count(*) FILTER (score >= 0.5e0 AND label = 1) / (2 * count(*) FILTER (score >= 0.5e0 AND label = 1)
                 + count(*) FILTER (score >= 0.5e0 AND label = 0) + count(*) FILTER (score < 0.5e0 AND label = 1)), 9) AS f1,
           round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2e0)
                 / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc
    FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM (
        SELECT anomaly AS score, CAST(density >= 0.5e0 AS INT) AS label FROM perception))""")
def _(t):
    rows = t.perception.select(F.col("anomaly").alias("score"), (F.col("density") >= 0.5).cast("int").alias("label"))
    return rounded(M.classification_metrics(rows))


@query("running_accuracy", "A23", """
    SELECT zone_id, round(sum(density * n) / sum(n), 9) AS loss, round(sum(anomaly * n) / sum(n), 9) AS accuracy FROM (SELECT *, arrival % 8 + 1 AS n FROM perception) GROUP BY zone_id""")
def _(t):
    rows = t.perception.select("zone_id", F.col("density").alias("loss"), F.col("anomaly").alias("accuracy"), (F.col("arrival") % 8 + 1).alias("n"))
    return rounded(M.weighted_mean(rows, ["zone_id"], ["loss", "accuracy"], "n"))


@query("eval_summary", "A13", """
    SELECT dataset, split, round(avg(anomaly), 9) AS mean_anomaly, count(*) AS rows, round(quantile_cont(anomaly, 0.95), 9) AS p95_anomaly FROM eval_rows GROUP BY ALL""")
def _(t):
    return rounded(M.eval_summary(t.eval_rows))


def _runs(t):
    """One evaluation per order priority, standing in for tuning runs."""
    rows = t.eval_rows.join(t.read("orders").select("o_orderkey", F.col("o_orderpriority").alias("run")), "o_orderkey")
    return M.eval_summary(rows, ["run", "dataset", "split"])


@query("run_ranking", "A36 J15 O07", """
    SELECT run, round(score, 9) AS score, compared_pairs, CAST(row_number() OVER (ORDER BY score DESC, run) AS INT) AS rank FROM (
        SELECT run, coalesce(avg(a.m - n.m + 0.5e0 * (a.p - n.p)), -999e0) AS score, count(*) AS compared_pairs FROM (
            SELECT * FROM sums WHERE split = 'normal') n JOIN (SELECT * FROM sums WHERE split = 'abnormal') a USING (run, dataset) GROUP BY run)""", views={"sums": """
        SELECT o_orderpriority AS run, dataset, split, avg(anomaly) AS m, quantile_cont(anomaly, 0.95) AS p FROM eval_rows JOIN orders USING (o_orderkey) GROUP BY ALL"""})
def _(t):
    regions = [r.r_name for r in t.read("region").orderBy("r_regionkey").collect()]      # the five dataset names
    return rounded(M.run_scores(_runs(t), [(r, "normal", "abnormal") for r in regions]))


@query("best_run", "O10", "SELECT CAST(arg_max(depth, (acc, -depth)) AS INT) AS best_depth FROM (SELECT o_orderstatus, ascii(o_orderstatus) AS depth, avg(o_totalprice) AS acc FROM orders GROUP BY 1)")
def _(t):
    runs = t.read("orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("best_val_acc")).withColumn("depth", F.ascii("o_orderstatus"))
    return M.best_run(runs)


@query("calibration", "A12", """
    SELECT round(quantile_cont(raw, 0.01), 9) AS p1, round(quantile_cont(raw, 0.5), 9) AS p50, round(quantile_cont(raw, 0.99), 9) AS p99 FROM (SELECT -anomaly AS raw FROM eval_rows)""")
def _(t):
    return rounded(M.calibration(t.eval_rows.select((-F.col("anomaly")).alias("raw"))))


@query("calibrated_anomaly", "W15 P38", """
    SELECT o_orderkey, round(greatest(0e0, least(1e0, (p50 - raw) / (p50 - p1))), 9) AS anomaly FROM (SELECT o_orderkey, -anomaly AS raw FROM eval_rows),
        (SELECT quantile_cont(-anomaly, 0.01) AS p1, quantile_cont(-anomaly, 0.5) AS p50 FROM eval_rows)""")
def _(t):
    raw = t.eval_rows.select("o_orderkey", (-F.col("anomaly")).alias("raw"))
    c = M.calibration(raw).first()
    return rounded(raw.select("o_orderkey", fusion.calibrated(F.col("raw"), c.p1, c.p50).alias("anomaly")))


@query("dataset_counts", "A14", """
    SELECT sum(n)::BIGINT AS num_rows, count(*) AS datasets, string_agg(dataset || '=' || n, ',' ORDER BY dataset) AS by_dataset FROM (SELECT dataset, count(*) AS n FROM eval_rows GROUP BY 1)""")
def _(t):
    c = M.dataset_counts(t.eval_rows)
    text = F.array_join(F.transform(F.map_entries("rows_by_dataset"), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return c.select("num_rows", "datasets", text.alias("by_dataset"))


@query("status_tally", "A31", """
    SELECT l_shipmode AS source, count(*) FILTER (s = 'F') AS ok, count(*) FILTER (s = 'O') AS skip, CAST(0 AS BIGINT) AS fail FROM (SELECT l_returnflag AS l_shipmode, l_linestatus AS s FROM lineitem) GROUP BY 1""")
def _(t):
    rows = t.read("lineitem").select(F.col("l_returnflag").alias("source"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("skip").alias("status"))
    return M.status_tally(rows)


@query("balanced_sample", "W21", "SELECT dataset, least(count(*), 1000) AS kept FROM eval_rows GROUP BY dataset")
def _(t):
    """Rows kept per dataset by a capped sample over all rows."""
    s = sampling.balanced_sample(t.eval_rows, "dataset", ["o_orderkey"], 1000)
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("kept"))


@query("class_split", "W23 A32", """
    SELECT dataset, split, n FROM (SELECT dataset, count(*) AS t, CAST(round_even(count(*) * 0.8e0, 0) AS BIGINT) AS a, CAST(round_even(count(*) * 0.1e0, 0) AS BIGINT) AS b FROM eval_rows GROUP BY 1)
    , LATERAL (VALUES ('train', a), ('val', b), ('test', t - a - b)) v(split, n)""")
def _(t):
    parts = sampling.ratio_split(t.eval_rows.drop("split"), "dataset", ["o_orderkey"])
    return parts.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))


@query("holdout_split", "W23", """
    SELECT split, n FROM (SELECT count(*) AS t, CAST(greatest(1, round_even(count(*) * 0.1e0, 0)) AS BIGINT) AS v FROM orders), LATERAL (VALUES ('val', v), ('train', t - v)) x(split, n)""")
def _(t):
    return sampling.holdout_split(t.read("orders").select("o_orderkey"), ["o_orderkey"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _training_rows(t):
    """Zone features with their differences: one row per month and zone."""
    from ..operators.motion import feature_rows
    return feature_rows(t.features, ["zone_id"], ["ts"]).withColumn("dataset", F.concat(F.lit("d"), (F.col("ts") % 3).cast("string")))


@query("robust_scaling", "M01", """
    SELECT ts, zone_id, round((speed_mean - m1) / CASE WHEN r1 = 0 THEN 1e0 ELSE r1 END, 6) AS speed, round((turbulence - m2) / CASE WHEN r2 = 0 THEN 1e0 ELSE r2 END, 6) AS turb FROM features, (
        SELECT quantile_cont(speed_mean, 0.5) AS m1, quantile_cont(speed_mean, 0.75) - quantile_cont(speed_mean, 0.25) AS r1,
               quantile_cont(turbulence, 0.5) AS m2, quantile_cont(turbulence, 0.75) - quantile_cont(turbulence, 0.25) AS r2 FROM features)""")
def _(t):
    scaler = ml.robust_scaler(t.features, ["speed_mean", "turbulence"])
    v = ml.scaled_vector(scaler)
    return rounded(t.features.select("ts", "zone_id", v[0].alias("speed"), v[1].alias("turb")), 6)


@query("iforest_scores", "M01 M02 M03 M04 X07 W15", None)
def _(t):
    rows = _training_rows(t)
    model = ml.train_forest(rows, ["ts", "zone_id"], ForestConfig(trees=300))
    return rounded(ml.anomaly_scores(rows, ["zone_id"], ["ts"], model).select("ts", "zone_id", "anomaly"), 6)


@query("tuning_runs", "M08 A36", None)
def _(t):
    rows = _training_rows(t).withColumn("split", F.when(F.col("ts") % 2 == 0, "normal").otherwise("abnormal"))
    runs = ml.tuning_grid(rows, ["ts", "zone_id"], rows, ["auto", 0.05], ForestConfig(trees=50))
    return rounded(M.run_scores(runs, [(f"d{i}", "normal", "abnormal") for i in range(3)]), 6)


def _weights(n: int = 64, hidden: int = 8):
    """Fixed example weights of the segment scorer, from a rule."""
    w1 = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(n)] for i in range(hidden)])
    return w1, np.arange(hidden) / 10 - 0.3, np.array([(i % 3 - 1) / 2 + 0.25 for i in range(hidden)]), -0.1


@query("mil_head_scores", "M07", """
    SELECT clip_idx, round(1 / (1 + exp(-(sum((h % 3 - 1) / 2e0 * r + 0.25e0 * r) - 0.1e0))), 6) AS score FROM (
        SELECT clip_idx, h, greatest(0e0, list_sum(list_transform(range(64), lambda j: CAST(embedding[j + 1] AS DOUBLE) * (((h * 7 + j * 3) % 11 - 5) / 10e0))) + h / 10e0 - 0.3e0) AS r
        FROM (SELECT clip_idx, embedding, unnest(range(8)) AS h FROM clip_vectors)) GROUP BY clip_idx""")
def _(t):
    return rounded(ml.segment_scores(t.clip_vectors, *_weights()).select("clip_idx", "score"), 6)


@query("svm_clips", "M05", None)
def _(t):
    model = ml.clip_classifier(t.clip_vectors)
    return ml.classify_clips(model, t.clip_vectors).select("clip_idx", "label", F.col("prediction").cast("int").alias("prediction"))


@query("class_probabilities", "M05 A21", None)
def _(t):
    from pyspark.ml.functions import vector_to_array
    model = ml.clip_classifier(t.clip_vectors, probabilities=True)
    out = ml.classify_clips(model, t.clip_vectors).withColumn("probs", vector_to_array("probability"))
    return rounded(M.video_votes(out), 6)
