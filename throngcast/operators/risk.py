"""Risk engine: fusion, state, change flags, expansion over time, advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..config import PolicyConfig, RiskStateConfig
from ..functions import scalars as S
from .folds import RiskState
from .ordered import ROWS_PER_CHUNK, ordered_fold, with_last_known, with_previous
from .zones import every_pair, small_side


def fuse(perception: DataFrame) -> DataFrame:
    risk = S.fused_risk(F.col("density"), F.col("anomaly"), F.col("conf"))
    return perception.withColumn("risk", risk).withColumn("severity", S.severity_band(F.col("risk")))


def risk_states(samples: DataFrame, order: list[str] = ("ts", "arrival"), key: str = "zone_id",
                cfg: RiskStateConfig = RiskStateConfig(), rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    return ordered_fold(samples, [key], list(order), RiskState(order[0], "risk_raw", cfg), rows_per_chunk)


def with_change_flag(states: DataFrame, order: list[str] = ("ts", "arrival"), key: str = "zone_id",
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``meaningful``: the severity changed or the average moved by at least 0.08 (the first row never moves)."""
    before = with_previous(states, [key], list(order), {"_before": "risk_ema"}, rows_per_chunk)
    moved = F.abs(F.col("risk_ema") - F.coalesce("_before", "risk_ema"))
    return before.withColumn("ema_delta", moved) \
        .withColumn("meaningful", F.col("changed") | (moved >= K.MEANINGFUL_EMA_CHANGE)).drop("_before")


def routing_zone_history(states: DataFrame, routing_zones: DataFrame, refresh: str = "all", ts: str = "ts",
                         rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Routing-zone risk after every frame and whether it moved by at least 0.08.

    ``states`` carries one ``frame_id`` per frame (rising with time), ``zone_id``, ``risk_ema``, ``meaningful``.
    refresh='all' takes every parent's current value; 'changed' refreshes only children of changed parents
    whenever a frame changed some parent, and fills zones never set before.
    """
    frames = states.groupBy("frame_id").agg(F.max(ts).alias(ts), F.max("meaningful").alias("any_changed"))
    per_parent = states.groupBy("frame_id", F.col("zone_id").alias("parent_id")) \
        .agg(F.max_by("risk_ema", ts).alias("ema"), F.max("meaningful").alias("parent_changed"))
    first_frame = frames.agg(F.min("frame_id")).first()[0]
    rows = every_pair(frames, routing_zones.select("routing_zone_id", "parent_id")).join(per_parent, ["frame_id", "parent_id"], "left")
    key, order = ["routing_zone_id"], ["frame_id"]
    rows = with_last_known(rows, key, order, "ema", "current", rows_per_chunk=rows_per_chunk)
    rows = rows.withColumn("current", F.coalesce("current", F.lit(0.0)))
    rows = rows.withColumn("_is_first", F.col("frame_id") == F.lit(first_frame))
    take = F.lit(True) if refresh == "all" else (
        ~F.col("any_changed") | F.coalesce("parent_changed", F.lit(False)) | F.col("_is_first"))
    rows = rows.withColumn("_set", F.when(take, F.col("current")))
    rows = with_last_known(rows, key, order, "_set", "risk", rows_per_chunk=rows_per_chunk)
    rows = with_previous(rows, key, order, {"_before": "risk"}, rows_per_chunk)
    filled = F.col("_is_first") & F.col("any_changed") & ~F.coalesce("parent_changed", F.lit(False)) \
        if refresh == "changed" else F.lit(False)
    moved = F.abs(F.col("risk") - F.coalesce("_before", F.lit(0.0))) >= K.MEANINGFUL_EMA_CHANGE
    return rows.select("frame_id", ts, "routing_zone_id", "parent_id", "risk", (filled | moved).alias("moved"))


def advisories(states: DataFrame, context: DataFrame | None = None, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """One advisory per state row: action, routing mode, messages, reroute hint and directives."""
    rows = states
    if context is not None:
        rows = states.join(small_side(context.select("zone_id", "label", "is_entry", "is_exit")), "zone_id", "left")
    else:
        rows = states.withColumns({"label": F.lit(None).cast("string"), "is_entry": F.lit(False), "is_exit": F.lit(False)})
    name = F.coalesce("label", F.concat(F.lit(cfg.zone_name_prefix), "zone_id"))
    rising, slope = F.col("trend") == "rising", F.col("slope_per_sec")
    warn, critical = F.col("severity") == "warn", F.col("severity") == "critical"
    case = (F.when(critical & rising & (slope >= cfg.rising_critical_slope), "DISPERSE").when(critical, "DIVERT")
            .when(warn & rising & (slope >= cfg.rising_warn_slope), "PREPARE_DIVERT").when(warn, "SLOW_DOWN")
            .when(rising, "MONITOR").otherwise("NONE"))
    rows = rows.withColumn("action", case)
    # --- Fixed values: advisory messages by action ---
    short = {"DISPERSE": "Critical congestion in {}. Disperse immediately.",
             "DIVERT": "Critical risk in {}. Rerouting to safer paths.",
             "PREPARE_DIVERT": "Crowd building in {}. Prepare to divert.",
             "SLOW_DOWN": "Caution in {}. Slow down and keep moving.",
             "MONITOR": "Monitoring {} (risk rising).",
             "NONE": "Normal conditions in {}."}
    long = {"DISPERSE": "High risk and worsening conditions in {}. Initiate crowd dispersal, open alternative exits, "
                        "and close incoming entries.",
            "DIVERT": "Severe congestion detected in {}. Avoid this area and follow evacuation routing.",
            "PREPARE_DIVERT": "Risk is rising in {}. Redirect flow early to reduce congestion and avoid counter-flow.",
            "SLOW_DOWN": "Moderate risk detected in {}. Reduce speed, avoid stopping, and follow guidance."}
    none = F.lit(None).cast("string")
    fill = lambda table: F.replace(S.lookup(F.col("action"), table, none), F.lit("{}"), name)
    only_if = lambda flag: F.when(F.coalesce(flag, F.lit(False)), F.array("zone_id"))
    directives = F.when(critical, F.struct(
        F.array(F.lit("security"), F.lit("ops")).alias("notify_roles"),
        only_if(F.col("is_entry")).alias("close_entries"), only_if(F.col("is_exit")).alias("open_exits")))
    return rows.withColumns({
        "routing_mode": F.when(critical, "evacuation").when(warn, "heightened").otherwise("normal"),
        "message_short": fill(short), "message_long": fill(long),
        "penalty_multiplier": F.when(critical, cfg.penalty_critical).when(warn, cfg.penalty_warn).otherwise(cfg.penalty_info),
        "suggested_reroute": F.when(critical, cfg.reroute_on_critical).when(warn, cfg.reroute_on_warn).otherwise(False),
        "directives": directives,
    })


def client_mode(severity: Column) -> Column:
    """Mode a client switches to on a guidance severity; NULL keeps its mode."""
    return F.when(severity == "critical", "evacuation").when(severity == "high", "alert")


def risk_summary(risks: DataFrame) -> DataFrame:
    return risks.agg(F.max("risk").alias("max_risk"), F.avg("risk").alias("avg_risk"), F.count(F.lit(1)).alias("zones"))


def global_max(states: DataFrame, column: str = "risk_ema") -> DataFrame:
    return states.agg(F.greatest(F.lit(0.0), F.coalesce(F.max(column), F.lit(0.0))).alias("global_max_risk"))


def most_risky_zone(risks: DataFrame, zone: str = "routing_zone_id", position: str = "zone_pos") -> DataFrame:
    """Zone of highest risk (first in order on ties), a default when there is none."""
    best = F.min_by(zone, F.struct(-F.col("risk"), F.col(position)))
    return risks.agg(F.coalesce(best, F.lit(K.DEFAULT_RISKY_ZONE)).alias("zone_id"))


def manual_changes(overrides: DataFrame, current: DataFrame) -> DataFrame:
    """Risks set by hand (zone_id, risk): always emitted, clamped, and ``changed`` when they differ from the zone's current risk by 0.01 or more.

    A zone without a current risk counts as 0.
    """
    known = current.select("zone_id", F.col("risk").alias("previous"))
    rows = overrides.withColumn("risk", S.clamp(F.col("risk"))).join(known, "zone_id", "left")
    return rows.withColumn("changed", F.abs(F.col("risk") - F.coalesce("previous", F.lit(0.0))) >= K.MANUAL_RISK_CHANGE)
