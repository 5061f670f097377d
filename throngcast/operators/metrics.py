"""Evaluation tables: summaries, classification metrics, bag statistics, run ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..config import MilConfig
from ..functions import scalars as S
from .ordered import ROWS_PER_CHUNK, exact_percentiles, with_previous, single_row, with_running_sum, with_row_index
from .zones import small_side


def eval_summary(rows: DataFrame, keys: list[str] = ("dataset", "split"), value: str = "anomaly",
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    keys = list(keys)
    return exact_percentiles(rows, keys, {"p95_anomaly": (value, 0.95)}, rows_per_chunk,
                             [F.avg(value).alias("mean_anomaly"), F.count(F.lit(1)).alias("rows")])


def calibration(rows: DataFrame, raw: str = "raw", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    return exact_percentiles(rows, [], {"p1": (raw, 0.01), "p50": (raw, 0.50), "p99": (raw, 0.99)}, rows_per_chunk)


def dataset_counts(rows: DataFrame, key: str = "dataset") -> DataFrame:
    """Total rows, number of datasets and a map of rows per dataset, as one row."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("num_rows"), F.count(key).alias("datasets"),
                   F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias("rows_by_dataset"))


def run_scores(summaries: DataFrame, pairs: list[tuple[str, str, str]] = tuple(K.SPLIT_PAIRS)) -> DataFrame:
    """Score per run: mean over dataset pairs of the rise in mean plus half the rise in p95; ranked, ties by name."""
    side = lambda column: F.map_from_arrays(F.array(*[F.lit(p[0]) for p in pairs]), F.array(*[F.lit(p[column]) for p in pairs]))
    wanted = summaries.withColumns({"_normal": side(1)[F.col("dataset")], "_abnormal": side(2)[F.col("dataset")]})
    at = lambda which, value: F.max(F.when(F.col("split") == F.col(which), F.col(value)))
    per = wanted.groupBy("run", "dataset").agg(
        (at("_abnormal", "mean_anomaly") - at("_normal", "mean_anomaly")).alias("rise"),
        (at("_abnormal", "p95_anomaly") - at("_normal", "p95_anomaly")).alias("rise95"))
    score = per.groupBy("run").agg(F.coalesce(F.avg(F.col("rise") + 0.5 * F.col("rise95")), F.lit(K.NO_PAIRS_SCORE)).alias("score"),
                                   F.count("rise").alias("compared_pairs"))
    # one row per tuning run
    return score.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "run")))


def best_run(runs: DataFrame) -> DataFrame:
    """Depth with the best validation accuracy, the smallest on ties; missing accuracies do not count."""
    best = runs.filter("best_val_acc IS NOT NULL AND best_val_acc > -1").agg(
        F.max_by("depth", F.struct("best_val_acc", -F.col("depth"))).alias("best_depth"))
    return best.select(F.when(F.col("best_depth").isNotNull(), F.col("best_depth"))
                       .otherwise(F.raise_error(F.lit("no search run found")).cast("int")).alias("best_depth"))


def classification_metrics(rows: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
                           rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Accuracy, F1 and ROC-AUC (ties count half), from counts per distinct score."""
    flag = (F.col(score) >= threshold).cast("int")
    hit = lambda p, y: F.sum(((flag == p) & (F.col(label) == y)).cast("bigint"))
    parts = rows.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    per = rows.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = with_running_sum(per, [], [score], F.col("neg"), "neg_upto", rows_per_chunk)
    wins = ranked.agg((F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    f1_base = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return single_row(parts, wins).select(((F.col("tp") + F.col("tn")) / total).alias("accuracy"),
                                   F.when(f1_base > 0, 2 * F.col("tp") / f1_base).otherwise(0.0).alias("f1"), "auc")


def weighted_mean(rows: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values])


def labelled_bags(normal: DataFrame, abnormal: DataFrame, key: str = "video", max_clips: int = 0, order: str = "clip_idx", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Clips of normal and abnormal videos as one table, columns by name, with ``bag_label`` 0 or 1; at most ``max_clips`` first clips of
    a video (0: all). A video without clips has no rows and so no bag. Both sides need clips."""
    sides = {0: normal, 1: abnormal}
    missing = [name for name, side in (("normal", normal), ("abnormal", abnormal)) if side.isEmpty()]
    if missing:
        raise ValueError(f"no clips of {' and '.join(missing)} videos")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [side.withColumn("bag_label", F.lit(label)) for label, side in sides.items()])
    if not max_clips:
        return both
    return with_row_index(both, ["bag_label", key], [order], "_place", rows_per_chunk).where(F.col("_place") < max_clips).drop("_place")


def bag_stats(scores: DataFrame, key: str = "video", order: str = "clip_idx", cfg: MilConfig = MilConfig(),
              rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per bag: size, mean of the top tenth (at least one, rounded half-even), mean, mean squared step."""
    n = scores.groupBy(key).agg(F.count(F.lit(1)).alias("clips"), F.avg("score").alias("sparsity"))
    k = F.greatest(F.lit(1), S.round_half_even(F.lit(cfg.topk_ratio) * F.col("clips")).cast("int"))
    down = with_row_index(scores.withColumn("_down", -F.col("score")), [key], ["_down", order], "_rank", rows_per_chunk)
    top = down.join(small_side(n.select(key, k.alias("_k"))), key).filter("_rank < _k").groupBy(key).agg(F.avg("score").alias("topk_mean"))
    steps = with_previous(scores, [key], [order], {"_before": "score"}, rows_per_chunk)
    rough = steps.groupBy(key).agg(F.coalesce(F.avg(F.pow(F.col("score") - F.col("_before"), 2)), F.lit(0.0)).alias("smoothness"))
    return n.join(top, key).join(rough, key)


def bag_pair_loss(abnormal: DataFrame, normal: DataFrame, cfg: MilConfig = MilConfig()) -> DataFrame:
    """Hinge loss of paired bags (``pair_id``) with sparsity and smoothness of the abnormal one."""
    a = abnormal.select("pair_id", F.col("topk_mean").alias("abn_topk"), "sparsity", "smoothness")
    b = normal.select("pair_id", F.col("topk_mean").alias("nor_topk"))
    ranking = F.greatest(F.lit(0.0), cfg.margin - (F.col("abn_topk") - F.col("nor_topk")))
    return a.join(b, "pair_id").withColumn("ranking", ranking).withColumn(
        "total", F.col("ranking") + cfg.lambda_sparsity * F.col("sparsity") + cfg.lambda_smoothness * F.col("smoothness"))


def video_votes(clips: DataFrame, key: str = "video", order: str = "clip_idx", probs: str = "probs", max_clips: int = 10,
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Mean class probabilities over the first clips of a video and the best class (first on ties)."""
    rows = with_row_index(clips, [key], [order], "_i", rows_per_chunk).filter(F.col("_i") < max_clips)
    per = rows.select(key, F.posexplode(probs).alias("class_id", "p")).groupBy(key, "class_id").agg(F.avg("p").alias("p"))
    return per.groupBy(key).agg(F.max_by("class_id", F.struct("p", -F.col("class_id"))).alias("pred"), F.max("p").alias("pred_prob"))


def status_tally(rows: DataFrame, key: str = "source", status: str = "status",
                 values: list[str] = ("ok", "skip", "fail")) -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def kept_images(boxes: DataFrame, image: str = "image", min_boxes: int = 1) -> DataFrame:
    """Label lines of the images with enough boxes, as rows: an image with very many boxes is never gathered."""
    enough = boxes.groupBy(image).agg(F.count(F.lit(1)).alias("boxes")).filter(F.col("boxes") >= min_boxes)
    return boxes.join(enough.select(image), image, "left_semi")
