"""Frame windows, clips and crash scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crash as C
from ..operators.ordered import with_row_index
from .catalog import query, rounded

_WINDOW_COLS = ["motion_mean", "motion_std", "motion_max", "motion_p90", "jerk_mean", "jerk_max", "bright_mean", "bright_std", "edge_mean",
                "edge_std", "start_sec", "end_sec"]


@query("crash_windows", "A17 W20", "SELECT video, window_index, " + ", ".join(f"round({c}, 9) AS {c}" for c in _WINDOW_COLS) + " FROM windows")
def _(t):
    return rounded(C.crash_windows(t.frame_scores))


@query("accident_windows", "A18 P37", """
    SELECT video, window_index, max(score) AS accident_prob, count(*) AS frames, window_index * 12 / 6e0 AS start_sec, (max(frame_idx) + 1) / 6e0 AS end_sec,
           max(score) >= 0.5 AS is_candidate FROM (
        SELECT video, frame_idx, frame_idx // 12 AS window_index, last_value(seen IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame_idx) AS score FROM (
            SELECT *, CASE WHEN frame_idx % 3 = 0 THEN brightness / 100 END AS seen FROM frame_scores)) GROUP BY ALL""")
def _(t):
    frames = t.frame_scores.withColumn("score", F.col("brightness") / 100)
    return C.accident_windows(frames, 12, 6.0, detect_every=3)


@query("weak_labels", "A20", """
    SELECT video, window_index, round(weak_score, 9) AS weak_score, CASE WHEN weak_score >= hi THEN 1 ELSE 0 END AS label
    FROM weak, (SELECT quantile_cont(weak_score, 0.4) AS lo, quantile_cont(weak_score, 0.7) AS hi FROM weak) WHERE weak_score >= hi OR weak_score <= lo""")
def _(t):
    return rounded(C.weak_labels(C.crash_windows(t.frame_scores)).select("video", "window_index", "weak_score", "label"))


def _scored(t):
    return C.crash_windows(t.frame_scores).withColumn("crash_prob", F.least(F.lit(1.0), F.col("motion_p90") / 300))


@query("top_windows", "O01 A19", """
    SELECT video, window_index, round(least(1e0, motion_p90 / 300), 9) AS crash_prob FROM windows ORDER BY least(1e0, motion_p90 / 300) DESC, video, window_index LIMIT 5""")
def _(t):
    return rounded(C.top_windows(_scored(t)).select("video", "window_index", "crash_prob"))


@query("crash_summary", "A19 P37", """
    SELECT video, count(*) AS windows, count(*) FILTER (p >= 0.5e0) AS candidates, round(avg(p), 9) AS mean_prob, round(max(p), 9) AS max_prob
    FROM (SELECT video, least(1e0, motion_p90 / 300) AS p FROM windows) GROUP BY video""")
def _(t):
    return rounded(C.crash_summary(_scored(t), ["video"]))


@query("frame_sampling", "W16", """
    SELECT video, frame_idx, frame_idx // 8 AS processed_index FROM frame_scores WHERE frame_idx % 8 = 0""")
def _(t):
    return C.sampled(t.frame_scores, ["video"], ["frame_idx"], 25.0, 3.0).select("video", "frame_idx", "processed_index")


@query("detection_carry", "W17 W18", """
    SELECT video, frame_idx, frame_idx // 3 * 3 AS det_frame FROM frame_scores""")
def _(t):
    return C.detection_frame(t.frame_scores, ["video"], ["frame_idx"], 3).select("video", "frame_idx", "det_frame")


@query("clip_centres", "W19", """
    SELECT video, frame_idx // 16 AS clip_index, frame_idx, motion FROM frame_scores f JOIN (SELECT video, count(*) AS n FROM frame_scores GROUP BY video) USING (video)
    WHERE frame_idx % 16 = 8 AND (frame_idx // 16 + 1) * 16 <= n""")
def _(t):
    return C.clip_centres(t.frame_scores, ["video"], ["frame_idx"]).select("video", "clip_index", "frame_idx", "motion")


@query("clip_expand", "A35", """
    SELECT user_id AS video, unnest(range(least(CAST(frames // 16 AS INT), 10))) AS clip_index FROM (SELECT user_id, count(*) AS frames FROM events GROUP BY user_id)""")
def _(t):
    videos = t.read("events").groupBy(F.col("user_id").alias("video")).agg(F.count(F.lit(1)).alias("frames"))
    return C.clip_rows(videos, max_clips=10).select("video", F.col("clip_index").cast("bigint").alias("clip_index"))


@query("clip_bag", "W22", """
    SELECT video, least(n, 20) AS clips FROM (SELECT event_type AS video, count(*) AS n FROM events GROUP BY 1)""")
def _(t):
    """Size of a contiguous bag per video, and that its clips are consecutive (checked by the span)."""
    from ..operators.sampling import contiguous_bag
    bag = contiguous_bag(t.frame_scores, "video", "frame_idx", 20)
    span = bag.groupBy("video").agg(F.count(F.lit(1)).alias("n"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("span"))
    return span.select("video", F.when(F.col("n") == F.col("span"), F.col("n")).alias("clips"))


@query("gbt_crash", "M06", None)
def _(t):
    """Boosted trees on weakly labelled windows, scored over all windows."""
    from ..operators.ml import crash_classifier, crash_probability
    from ..session import cut_lineage
    windows = cut_lineage(C.crash_windows(t.frame_scores))
    model = crash_classifier(C.weak_labels(windows), C.CRASH_FEATURES)
    return rounded(crash_probability(model, windows, C.CRASH_FEATURES).select("video", "window_index", "crash_prob"), 6)
