"""Seeded sampling and splits by hash order: the same rows for the same seed, on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from .ordered import ROWS_PER_CHUNK, join_keys, with_row_index
from .zones import small_side

_BUCKET_BITS = 12


def with_hash(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    return df.withColumn("_hash", F.xxhash64(*ids, F.lit(seed)))


def capped_sample(df: DataFrame, keys: list[str], ids: list[str], cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per key, exactly the ones of lowest hash.

    Counts per key and hash bucket tell which bucket holds the cut: buckets below are kept without any
    sorting, only that bucket is ranked. A key with a third of the table still spreads over 4096 buckets.
    """
    h = with_hash(df, ids, seed).withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - _BUCKET_BITS).cast("int"))
    sizes = h.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_bucket")
                            .rowsBetween(Window.unboundedPreceding, 0))
    room = sizes.withColumn("_room", F.lit(cap) - (upto - F.col("_n"))).filter("_room > 0")
    marked = join_keys(h, small_side(room.select(*keys, "_bucket", "_n", "_room")), keys + ["_bucket"], "inner", ["_n", "_room"])
    whole = marked.filter("_n <= _room")
    # NULL-safe grouping: Window treats NULL keys as one partition
    cut = marked.filter("_n > _room").withColumn("_rank", F.row_number().over(
        Window.partitionBy(*keys, "_bucket").orderBy("_hash", *ids))).filter("_rank <= _room").drop("_rank")
    return whole.unionByName(cut).drop("_hash", "_bucket", "_n", "_room")


def balanced_sample(df: DataFrame, key: str, ids: list[str], cap_per_key: int, cap_total: int = 0, seed: int = 42) -> DataFrame:
    """Cap per dataset, then overall; 0 sets no cap."""
    rows = capped_sample(df, [key], ids, cap_per_key, seed) if cap_per_key > 0 else df
    return capped_sample(rows, [], ids, cap_total, seed) if cap_total > 0 else rows


def ratio_split(df: DataFrame, key: str, ids: list[str], train: float = 0.8, val: float = 0.1, seed: int = 42,
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``split`` (train, val, test) per class in hash order; sizes are rounded half-even."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n_train = S.round_half_even(F.col("_n") * train)
    n_val = F.least(S.round_half_even(F.col("_n") * val), F.greatest(F.lit(0.0), F.col("_n") - n_train))
    ranked = with_row_index(with_hash(df, ids, seed), [key], ["_hash", *ids], "_i", rows_per_chunk)
    return ranked.join(small_side(n), key).withColumn(
        "split", F.when(F.col("_i") < n_train, "train").when(F.col("_i") < n_train + n_val, "val").otherwise("test")) \
        .drop("_i", "_n", "_hash")


def holdout_split(df: DataFrame, ids: list[str], val_ratio: float = 0.1, seed: int = 42, min_rows: int = 10,
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Validation share limited to 0.01..0.4, at least one row; too few rows are an error."""
    n = df.count()
    if n < min_rows:
        raise ValueError(f"too few labelled samples: {n}")
    n_val = max(1, round(n * max(0.01, min(0.4, val_ratio))))
    ranked = with_row_index(with_hash(df, ids, seed), [], ["_hash", *ids], "_i", rows_per_chunk)
    return ranked.withColumn("split", F.when(F.col("_i") < n_val, "val").otherwise("train")).drop("_i", "_hash")


def contiguous_bag(df: DataFrame, key: str, order: str, size: int, seed: int = 42,
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """A run of ``size`` consecutive rows per key from a seeded start; shorter keys are kept whole."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    start = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.lit(1), F.col("_n") - size + 1))
    ranked = with_row_index(df, [key], [order], "_i", rows_per_chunk)
    return ranked.join(small_side(n.select(key, start.alias("_start"))), key) \
        .filter((F.col("_i") >= F.col("_start")) & (F.col("_i") < F.col("_start") + size)).drop("_i", "_start")


def newest_per_key(df: DataFrame, keys: list[str], order: str, n: int, tie: str,
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The n newest rows per key, newest first in ``newest_rank``."""
    rows = with_row_index(df.withColumn("_down", -F.col(order)), keys, ["_down", tie], "newest_rank", rows_per_chunk)
    return rows.filter(F.col("newest_rank") < n).drop("_down")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], n: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    rows = with_row_index(df, keys, order, "_i", rows_per_chunk)
    return rows.filter(F.col("_i") < n).drop("_i")


def clip_selection(specs: DataFrame, max_per_video: int = 0, max_total: int = 0,
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Clip specs in order of start, end, scene, crop; capped per video, then overall in video order."""
    order = ["start_frame", "end_frame", "scene_number", "crop_number"]
    rows = specs
    if max_per_video > 0:
        rows = first_per_key(rows, ["dataset", "video_name"], order, max_per_video, rows_per_chunk)
    return rows.orderBy("dataset", "video_name", *order).limit(max_total) if max_total > 0 else rows
