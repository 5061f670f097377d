"""Anomaly scores per timestep: robust normalisation, activity weights, fallback, calibration, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..config import FusionConfig
from ..functions import scalars as S
from .ordered import ROWS_PER_CHUNK, exact_percentiles, with_average


def robust_normalise(df: DataFrame, ts: str, columns: list[str], rows_per_chunk: int | None = None) -> DataFrame:
    """Add ``<column>_n``: position between the 5th and 95th percentile of the timestep; 0 when they coincide.

    A timestep has one row per zone, so its group is bounded and percentiles are windows over it, all on one partitioning; pass
    ``rows_per_chunk`` where that does not hold.
    """
    ranks = {f"_{end}_{c}": (c, q) for c in columns for end, q in (("lo", 0.05), ("hi", 0.95))}
    if rows_per_chunk is None:
        moment = Window.partitionBy(ts)
        ranged = df.withColumns({name: F.percentile(c, F.lit(q)).over(moment) for name, (c, q) in ranks.items()})
    else:
        ranged = df.join(exact_percentiles(df, [ts], ranks, rows_per_chunk), ts)
    scaled = {}
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled[f"{c}_n"] = F.when(hi <= lo, F.lit(0.0)).otherwise(S.clamp((F.col(c) - lo) / (hi - lo)))
    return ranged.withColumns(scaled).drop(*ranks)


def fallback_anomaly(features: DataFrame, ts: str = "ts", rows_per_chunk: int | None = None) -> DataFrame:
    pressure = F.col("density") * (F.col("speed_mean") + 0.5 * F.col("turbulence"))
    n = robust_normalise(features.withColumn("pressure", pressure), ts, ["turbulence", "pressure"], rows_per_chunk)
    score = 0.45 * F.col("dir_entropy") + 0.35 * F.col("turbulence_n") + 0.20 * F.col("pressure_n")
    return n.withColumn("anomaly_raw", S.clamp(score)).drop("pressure", "turbulence_n", "pressure_n")


def calibrated(raw: Column, p1: float, p50: float) -> Column:
    gap = p50 - p1
    return S.clamp((F.lit(p50) - raw) / F.lit(1e-8 if abs(gap) < 1e-8 else gap))


def activity_weights(features: DataFrame, ts: str = "ts", cfg: FusionConfig = FusionConfig(),
                     rows_per_chunk: int | None = None) -> DataFrame:
    """Each zone's share of the activity of its timestep (``weight``) and the number of zones (``zones_at_ts``)."""
    n = robust_normalise(features, ts, ["speed_mean", "turbulence"], rows_per_chunk)
    motion = S.clamp(cfg.speed_weight * F.col("speed_mean_n") + cfg.turbulence_weight * F.col("turbulence_n")
                     + cfg.entropy_weight * S.clamp(F.col("dir_entropy")))
    active = S.clamp(cfg.density_weight * S.clamp(F.col("density")) + cfg.motion_weight * motion)
    scored = n.withColumn("activity", active).drop("speed_mean_n", "turbulence_n")
    totals = {"_total": F.sum("activity"), "zones_at_ts": F.count(F.lit(1))}
    if rows_per_chunk is None:
        summed = scored.withColumns({name: total.over(Window.partitionBy(ts)) for name, total in totals.items()})
    else:
        summed = scored.join(scored.groupBy(ts).agg(*[total.alias(name) for name, total in totals.items()]), ts)
    weight = F.when(F.col("_total") <= 1e-6, 1.0 / F.col("zones_at_ts")).otherwise(F.col("activity") / F.col("_total"))
    return summed.withColumn("weight", weight).drop("_total")


def spatialised(global_risk: Column, weight: Column, zones: Column) -> Column:
    """A global score spread over zones by weight, scaled so that its mean stays near the global score."""
    return S.clamp(S.clamp(global_risk) * weight * zones)


def two_way(base: Column, behaviour: Column, conf: Column, cfg: FusionConfig = FusionConfig()) -> Column:
    mix = S.clamp(cfg.paper_weight * S.clamp(conf))
    return S.clamp((1 - mix) * base + mix * behaviour)


def three_way(base: Column, behaviour: Column, mil: Column, conf: Column, cfg: FusionConfig = FusionConfig()) -> Column:
    paper_mix, mil_mix = S.clamp(cfg.paper_weight * conf), F.lit(cfg.mil_weight)
    base_mix = F.greatest(F.lit(0.0), 1 - paper_mix - mil_mix)
    total = base_mix + paper_mix + mil_mix
    total = F.when(total <= 1e-6, 1.0).otherwise(total)
    return S.clamp(base_mix / total * base + paper_mix / total * behaviour + mil_mix / total * mil)


def behaviour_blend(risk: Column, density: Column, risk_weight: float = 0.7, density_weight: float = 0.3) -> Column:
    return S.clamp(risk_weight * risk + density_weight * density)


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "anomaly",
             keep: float = K.EWMA_KEEP, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    return with_average(df, keys, order, value, name, keep, rows_per_chunk=rows_per_chunk)
