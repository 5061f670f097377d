"""Fixed-count frame windows, clips and weak labels for crash and accident scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..config import CrashConfig
from .ordered import ROWS_PER_CHUNK, exact_percentiles, with_last_known, with_row_index

CRASH_FEATURES = ["motion_mean", "motion_std", "motion_max", "motion_p90", "jerk_mean", "jerk_max",
                  "bright_mean", "bright_std", "edge_mean", "edge_std"]


def sampled(frames: DataFrame, keys: list[str], order: list[str], source_fps: float, target_fps: float,
            rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Every n-th row per key, n = max(1, source rate / target rate rounded half-even)."""
    stride = max(1, round(source_fps / target_fps)) if target_fps > 0 else 1
    rows = with_row_index(frames, keys, order, "source_index", rows_per_chunk)
    return rows.filter(F.col("source_index") % stride == 0) \
        .withColumn("processed_index", F.floor(F.col("source_index") / stride))


def count_windows(frames: DataFrame, keys: list[str], order: list[str], size: int,
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``row_index``, ``window_index`` and ``window_pos`` of consecutive windows of ``size`` rows."""
    rows = with_row_index(frames, keys, order, "row_index", rows_per_chunk)
    return rows.withColumns({"window_index": F.floor(F.col("row_index") / size), "window_pos": F.col("row_index") % size})


def crash_windows(frames: DataFrame, keys: list[str] = ("video",), order: list[str] = ("frame_idx",),
                  cfg: CrashConfig = CrashConfig(), rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Ten motion, brightness and edge statistics per full window; a short last window is dropped."""
    size, keys = cfg.frames_per_window, list(keys)
    rows = count_windows(frames, keys, list(order), size, rows_per_chunk)
    inside = Window.partitionBy(*keys, "window_index").orderBy("window_pos")      # at most ``size`` rows
    jerk = F.abs(F.col("motion") - F.lag("motion").over(inside))
    return rows.withColumn("jerk", jerk).groupBy(*keys, "window_index").agg(
        F.avg("motion").alias("motion_mean"), F.stddev_pop("motion").alias("motion_std"),
        F.max("motion").alias("motion_max"), F.percentile("motion", F.lit(0.9)).alias("motion_p90"),
        F.coalesce(F.avg("jerk"), F.lit(0.0)).alias("jerk_mean"), F.coalesce(F.max("jerk"), F.lit(0.0)).alias("jerk_max"),
        F.avg("brightness").alias("bright_mean"), F.stddev_pop("brightness").alias("bright_std"),
        F.avg("edge").alias("edge_mean"), F.stddev_pop("edge").alias("edge_std"), F.count(F.lit(1)).alias("_rows")) \
        .filter(F.col("_rows") == size).drop("_rows") \
        .withColumns({"start_sec": F.col("window_index") * size / F.lit(cfg.sample_fps),
                      "end_sec": (F.col("window_index") + 1) * size / F.lit(cfg.sample_fps)})


def accident_windows(frames: DataFrame, size: int, fps: float, keys: list[str] = ("video",), order: list[str] = ("frame_idx",),
                     detect_every: int = 1, threshold: float = 0.5, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Highest frame score per window, the short last one kept; between detections the last score is carried."""
    keys = list(keys)
    rows = count_windows(frames, keys, list(order), size, rows_per_chunk)
    rows = rows.withColumn("_seen", F.when(F.col("row_index") % detect_every == 0, F.coalesce("score", F.lit(0.0))))
    if detect_every > 1:
        rows = with_last_known(rows, keys, ["row_index"], "_seen", "_score", rows_per_chunk=rows_per_chunk)
    else:
        rows = rows.withColumn("_score", F.col("_seen"))
    return rows.groupBy(*keys, "window_index").agg(F.max("_score").alias("accident_prob"), F.count(F.lit(1)).alias("frames"),
                                                   F.max("row_index").alias("_end")) \
        .withColumns({"start_sec": F.col("window_index") * size / F.lit(fps), "end_sec": (F.col("_end") + 1) / F.lit(fps),
                      "is_candidate": F.col("accident_prob") >= threshold}).drop("_end")


def weak_labels(windows: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Score from z values of peak, jerk and spread; top 30 % labelled 1, bottom 40 % labelled 0, the rest dropped."""
    z_of = {"motion_max": 0.50, "jerk_mean": 0.25, "motion_std": 0.25}
    stats = windows.agg(*[f(c).alias(f"{n}_{c}") for c in z_of for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = lambda c: (F.col(c) - stats[f"m_{c}"]) / max(stats[f"s_{c}"] or 0.0, 1e-6)
    scored = windows.withColumn("weak_score", sum((w * z(c) for c, w in z_of.items()), F.lit(0.0)))
    cut = exact_percentiles(scored, [], {"lo": ("weak_score", 0.40), "hi": ("weak_score", 0.70)}, rows_per_chunk).first()
    label = F.when(F.col("weak_score") >= cut.hi, 1).when(F.col("weak_score") <= cut.lo, 0)
    return scored.withColumn("label", label).filter("label IS NOT NULL")


def top_windows(scored: DataFrame, n: int = 5, score: str = "crash_prob", tie: tuple = ("video", "window_index")) -> DataFrame:
    return scored.orderBy(F.col(score).desc(), *tie).limit(n)


def crash_summary(scored: DataFrame, keys: list[str] = (), score: str = "crash_prob", threshold: float = 0.5) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col(score) >= threshold).alias("candidates"),
        F.avg(score).alias("mean_prob"), F.max(score).alias("max_prob"))


def clip_rows(videos: DataFrame, frames: str = "frames", clip_len: int = 16, max_clips: int = 0) -> DataFrame:
    """One row per clip of each video: floor(frames / length), optionally capped; short videos drop out."""
    n = F.floor(F.col(frames) / clip_len).cast("int")
    n = F.least(n, F.lit(max_clips)) if max_clips > 0 else n
    return videos.withColumn("_n", n).filter("_n > 0").withColumn("clip_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))) \
        .withColumn("start_frame", F.col("clip_index") * clip_len).drop("_n")


def clip_centres(frames: DataFrame, keys: list[str], order: list[str], clip_len: int = 16,
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The representative (middle) row of each full clip."""
    rows = count_windows(frames, keys, order, clip_len, rows_per_chunk)
    rest = [c for c in frames.columns if c not in keys]
    middle = F.max_by(F.struct(*rest), (F.col("window_pos") == clip_len // 2).cast("int"))
    return rows.groupBy(*keys, F.col("window_index").alias("clip_index")).agg(F.count(F.lit(1)).alias("_rows"), middle.alias("_m")) \
        .filter(F.col("_rows") == clip_len).select(*keys, "clip_index", "_m.*")


def detection_frame(frames: DataFrame, keys: list[str], order: list[str], every: int, carry: bool = True,
                    rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Frame whose detections apply (``det_frame``): the latest detected one, or NULL between without carry."""
    rows = with_row_index(frames, keys, order, "row_index", rows_per_chunk)
    first = F.col("row_index") % max(1, every) == 0
    rows = rows.withColumn("det_frame", F.when(first, F.col(order[0])))
    if carry:
        rows = with_last_known(rows.withColumnRenamed("det_frame", "_f"), keys, ["row_index"], "_f", "det_frame",
                               rows_per_chunk=rows_per_chunk).drop("_f")
    return rows
