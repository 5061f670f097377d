"""Motion features per frame and zone, and their differences to the frame before."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..functions import scalars as S
from .ordered import ROWS_PER_CHUNK, exact_percentiles, fits, with_previous


#: Frames of up to so many samples are one group of a window; larger ones are pre-aggregated.
SMALL_FRAME = 100_000


def compensate_global_motion(flow: DataFrame, frame: str = "frame_id", rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """Subtract the median motion of the frame, then add magnitude and direction in [0, 2 pi)."""
    mid = exact_percentiles(flow, [frame], {"mid_u": ("u", 0.5), "mid_v": ("v", 0.5)}, rows_per_chunk)
    return _compensated(flow.join(mid, frame))


def _compensated(flow: DataFrame) -> DataFrame:
    moved = flow.withColumns({"u": F.col("u") - F.col("mid_u"), "v": F.col("v") - F.col("mid_v")})
    turn = F.atan2("v", "u")
    return moved.drop("mid_u", "mid_v").withColumns({
        "magnitude": F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")),
        "direction": F.when(turn < 0, turn + 2 * math.pi).otherwise(turn)})


def zone_features(flow: DataFrame, frame: str = "frame_id", zone: str = "zone_id", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Compensated motion features; one size check of the frames decides for both percentile steps.

    Samples of small frames are dealt by frame once: medians, quartiles and totals are taken where they then are.
    """
    if fits(flow, [frame], min(SMALL_FRAME, rows_per_chunk)):
        whole, part = Window.partitionBy(frame), Window.partitionBy(frame, zone)
        mid = lambda c: F.percentile(c, F.lit(0.5)).over(whole)
        moved = _compensated(flow.where(F.col(frame).isNotNull()).withColumns({"mid_u": mid("u"), "mid_v": mid("v")}))
        quart = moved.where(F.col(zone).isNotNull()).withColumn("_q", F.percentile("magnitude", F.lit(K.MOTION_QUANTILE)).over(part))
        return _features(quart, [frame, zone])
    limit = None if fits(flow, [frame], rows_per_chunk) else rows_per_chunk
    return motion_features(compensate_global_motion(flow, frame, limit), frame, zone, limit)


def direction_bin(direction):
    """Equal bins over [0, 2 pi]; the upper edge belongs to the last bin."""
    return F.least(F.lit(K.DIRECTION_BINS - 1), F.floor(direction / (2 * math.pi / K.DIRECTION_BINS)))


def motion_features(samples: DataFrame, frame: str = "frame_id", zone: str = "zone_id",
                    rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """Mean and variance of speed, direction entropy, divergence, turbulence and occupancy of active samples.

    Active means at or above max(0.2, 75th percentile) of the zone; where fewer than 16 samples are, at or
    above 0.2. Both readings are aggregated in the same pass and the right one is taken afterwards.
    """
    keys = [frame, zone]
    quart = exact_percentiles(samples, keys, {"_q": ("magnitude", K.MOTION_QUANTILE)}, rows_per_chunk)
    return _features(samples.join(quart, keys), keys)


def _features(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Features of samples with the quartile ``_q`` of their zone."""
    tests = {"s": F.col("magnitude") >= F.greatest(F.lit(K.MIN_MOTION), F.col("_q")), "w": F.col("magnitude") >= K.MIN_MOTION}
    rows = samples.withColumns({f"_on_{t}": test for t, test in tests.items()}) \
        .withColumn("_bin", direction_bin(F.col("direction")))
    totals = [F.count(F.lit(1)).alias("samples")]
    for t in tests:
        on = lambda c, flag=f"_on_{t}": F.when(F.col(flag), F.col(c))
        totals += [F.count_if(f"_on_{t}").alias(f"{t}_n"), F.avg(on("magnitude")).alias(f"{t}_speed_mean"),
                   F.var_pop(on("magnitude")).alias(f"{t}_speed_var"), F.avg(on("divergence")).alias(f"{t}_divergence"),
                   F.avg(on("turbulence")).alias(f"{t}_turbulence")]
        totals += [F.count_if((on("_bin") == b)).alias(f"{t}_b{b}") for b in range(K.DIRECTION_BINS)]
    wide = rows.groupBy(*keys).agg(*totals)
    few = F.col("s_n") < K.MIN_ACTIVE_SAMPLES
    pick = lambda name: F.when(few, F.col(f"w_{name}")).otherwise(F.col(f"s_{name}"))
    names = ["n", "speed_mean", "speed_var", "divergence", "turbulence", *[f"b{b}" for b in range(K.DIRECTION_BINS)]]
    taken = wide.select(*keys, "samples", *[pick(n).alias(n) for n in names])
    share = lambda b: F.col(f"b{b}") / F.col("n")
    terms = [F.when(F.col(f"b{b}") > 0, -share(b) * F.log(share(b))).otherwise(0.0) for b in range(K.DIRECTION_BINS)]
    entropy = sum(terms[1:], terms[0]) / math.log(K.DIRECTION_BINS)
    or_zero = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    return taken.select(
        *keys, "samples", F.col("n").alias("active_samples"), or_zero("speed_mean"), or_zero("speed_var"),
        F.when(F.col("n") > 0, entropy).otherwise(0.0).alias("dir_entropy"), or_zero("divergence"), or_zero("turbulence"),
        S.clamp(F.col("n") / F.col("samples")).alias("occupancy"))


def feature_rows(features: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add first differences of speed, entropy and density per key (one key per video and zone); the first row minus 0."""
    watched = ["speed_mean", "dir_entropy", "density"]
    before = with_previous(features, keys, order, {f"_p_{c}": c for c in watched}, rows_per_chunk)
    return before.withColumns({f"delta_{c}": F.col(c) - F.coalesce(F.col(f"_p_{c}"), F.lit(0.0)) for c in watched}) \
        .drop(*[f"_p_{c}" for c in watched])
