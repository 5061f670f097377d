"""Traffic cameras: feed rows, cached inferences, enrichment, system metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import scalars as S
from .folds import StaleMetric
from .ordered import ROWS_PER_CHUNK, ordered_fold, single_row, with_last_known


def valid_camera() -> Column:
    return S.clean_text(F.col("camera_id")).isNotNull() & S.clean_text(F.col("image_url")).isNotNull() \
        & S.finite(F.col("lat")) & S.finite(F.col("lng"))


def first_cameras(feed: DataFrame, n: int | None = None, position: str = "feed_pos") -> DataFrame:
    """First n feed rows (1..30, 8 by default), taken before invalid rows are dropped."""
    n = max(1, min(K.CAMERAS_MAX, n or K.CAMERAS_DEFAULT))
    return feed.orderBy(position).limit(n).filter(valid_camera())


def cached_inference(inferences: DataFrame, now_ms: int, ttl_ms: int = K.CAMERA_TTL_MS,
                     keys: list[str] = ("camera_id", "captured_at")) -> DataFrame:
    """Latest inference per camera and picture that is still valid."""
    ttl = max(K.CAMERA_TTL_FLOOR_MS, ttl_ms)
    live = inferences.filter((F.col("inferred_ms") <= now_ms) & (F.col("inferred_ms") + ttl > now_ms))
    rest = [c for c in inferences.columns if c not in keys]
    return live.groupBy(*keys).agg(F.max_by(F.struct(*rest), "inferred_ms").alias("i")).select(*keys, "i.*")


def enrich(cameras: DataFrame, inferences: DataFrame | None, keys: list[str] = ("camera_id",)) -> DataFrame:
    """Status ok / error / skipped per camera. Without an inference table all are skipped."""
    if inferences is None:
        return cameras.withColumns({"status": F.lit("skipped"), "reason": F.lit("withInfer=0"),
                                    "vehicle_count": F.lit(None).cast("bigint")})
    table = inferences.withColumn("_hit", F.lit(True))
    joined = cameras.join(table, list(keys), "left")
    failed = F.col("error").isNotNull() if "error" in inferences.columns else F.lit(False)
    missing = F.col("_hit").isNull()
    return joined.withColumns({
        "status": F.when(missing | failed, "error").otherwise("ok"),
        "reason": F.when(missing, "no inference").when(failed, F.col("error")) if "error" in inferences.columns
        else F.when(missing, "no inference")}).drop("_hit")


def asof_inference(snapshots: DataFrame, inferences: DataFrame, key: str = "camera_id", ttl_ms: int = K.CAMERA_TTL_MS,
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Latest inference at or before each snapshot, if younger than the TTL.

    Both tables are merged into one ordered sequence per camera, so no pairs are built and a busy camera is cut.
    ``snapshots``: snapshot_id, key, ts_ms; ``inferences``: key, inferred_ms and payload columns.
    """
    payload = [c for c in inferences.columns if c != key]
    left = snapshots.select(key, "ts_ms", F.lit(1).alias("_side"), "snapshot_id",
                            F.lit(None).cast(inferences.select(F.struct(*payload)).schema[0].dataType).alias("_i"))
    right = inferences.select(key, F.col("inferred_ms").alias("ts_ms"), F.lit(0).alias("_side"),
                              F.lit(None).cast(snapshots.schema["snapshot_id"].dataType).alias("snapshot_id"),
                              F.struct(*payload).alias("_i"))
    known = with_last_known(left.unionByName(right), [key], ["ts_ms", "_side"], "_i", "_known", rows_per_chunk=rows_per_chunk)
    fresh = F.when(F.col("ts_ms") - F.col("_known.inferred_ms") < max(K.CAMERA_TTL_FLOOR_MS, ttl_ms), F.col("_known"))
    return known.filter("_side = 1").select("snapshot_id", key, "ts_ms", fresh.alias("_k")).select(
        "snapshot_id", key, "ts_ms", *[F.col(f"_k.{c}").alias(c) for c in payload])


def system_metrics(cameras: DataFrame, latest: DataFrame, now_ms: int) -> DataFrame:
    """Working cameras and users seen within 30 s, as one row."""
    working = cameras.agg(F.count_if(valid_camera()).alias("working_cameras"))
    users = latest.agg(F.count_if(F.lit(now_ms) - F.col("ts_ms") <= K.PRESENCE_MAX_AGE_MS).alias("total_users"))
    return single_row(working, users).withColumn("generated_at", F.lit(now_ms).cast("bigint"))


def metric_with_staleness(samples: DataFrame, keys: list[str], order: list[str] = ("ts_ms",),
                          ttl_ms: int = K.CAMERA_TTL_MS, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Value, fetch time and source (live, cache, unavailable) of a polled metric; NULL is a failed poll."""
    return ordered_fold(samples, keys, list(order), StaleMetric(order[0], "value", ttl_ms), rows_per_chunk)
