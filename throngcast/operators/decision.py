"""Reroute decisions: assess the way ahead, decide, choose a target, explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import scalars as S
from .folds import Cooldown
from .ordered import ROWS_PER_CHUNK, ordered_fold
from .zones import small_side


def assess_routes(routes: DataFrame, zone_risk: DataFrame, incidents: DataFrame, load: DataFrame | None = None) -> DataFrame:
    """State of the first six zones of each active route.

    ``routes``: user_id, zone_path. A zone appears in ``violating_zones`` once per rule it breaks.
    """
    ahead = routes.filter("zone_path IS NOT NULL") \
        .select("user_id", F.posexplode(F.slice("zone_path", 1, K.LOOKAHEAD_ZONES)).alias("pos", "zone_id"))
    rows = ahead.join(small_side(zone_risk.select("zone_id", "risk")), "zone_id", "left") \
        .join(small_side(incidents.select("zone_id", F.lit(True).alias("incident")).distinct()), "zone_id", "left")
    if load is not None:
        rows = rows.join(small_side(load.select("zone_id", "load_ratio")), "zone_id", "left")
    else:
        rows = rows.withColumn("load_ratio", F.lit(1.0))
    incident = F.coalesce("incident", F.lit(False))
    risky = F.coalesce("risk", F.lit(0.0)) >= K.HIGH_RISK
    crowded = F.coalesce("load_ratio", F.lit(1.0)) >= K.LOAD_LIMIT
    hit = lambda flag: F.when(flag, F.array("zone_id")).otherwise(F.array().cast("array<string>"))
    # at most six rows per user are collected
    broken = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(
        "pos", F.concat(hit(incident), hit(risky), hit(crowded)).alias("zones")))), lambda r: r.zones))
    found = rows.groupBy("user_id").agg(
        F.greatest(F.lit(0.0), F.max(F.coalesce("risk", F.lit(0.0)))).alias("max_risk"), F.bool_or(incident).alias("has_incident"),
        F.bool_or(risky).alias("enters_high_risk"), F.bool_or(crowded).alias("congestion"),
        broken.alias("violating_zones"))
    flags = ["has_incident", "enters_high_risk", "congestion"]
    return routes.filter("zone_path IS NOT NULL").select("user_id").join(found, "user_id", "left").select(
        "user_id", F.coalesce("max_risk", F.lit(0.0)).alias("max_risk"),
        *[F.coalesce(f, F.lit(False)).alias(f) for f in flags],
        F.coalesce("violating_zones", F.array().cast("array<string>")).alias("violating_zones"))


def reroute_reason(mode: Column | str) -> Column:
    """Highest-priority reason to reroute, NULL when there is none (without the cool-down)."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (F.when(F.col("has_incident"), "ROUTE_BLOCKED_BY_INCIDENT")
            .when(mode == "evacuation", "GLOBAL_MODE_ESCALATION")
            .when(F.col("enters_high_risk"), "ROUTE_ENTERING_HIGH_RISK")
            .when(F.col("congestion"), "CONGESTION_OVER_CAPACITY"))


def decide(assessed: DataFrame, mode: str, now_ms: Column, last_reroute_ms: Column) -> DataFrame:
    """One decision per user now; within the cool-down nothing happens."""
    cooling = now_ms - F.coalesce(last_reroute_ms, F.lit(0)) < K.REROUTE_COOLDOWN_MS
    reason = F.when(~cooling, reroute_reason(mode))
    return assessed.withColumn("reason", reason) \
        .withColumn("action", F.when(F.col("reason").isNull(), "NOOP").otherwise("REROUTE"))


def decide_over_time(history: DataFrame, mode: str | Column, key: str = "user_id", order: list[str] = ("ts", "arrival"),
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Decisions along each user's history, where every granted reroute starts the next cool-down."""
    rows = history.withColumn("_reason", reroute_reason(mode)).withColumn("_want", F.col("_reason").isNotNull())
    out = ordered_fold(rows, [key], list(order), Cooldown(order[0], "_want", K.REROUTE_COOLDOWN_MS), rows_per_chunk)
    return out.withColumn("reason", F.when(F.col("granted"), F.col("_reason"))) \
        .withColumn("action", F.when(F.col("granted"), "REROUTE").otherwise("NOOP")).drop("_reason", "_want", "granted")


def guidance(decisions: DataFrame, target: str = "target") -> DataFrame:
    """Title, message and severity for each reroute."""
    reason = F.col("reason")
    pick = lambda i: S.lookup(reason, {g[0]: g[i] for g in K.GUIDANCE}, F.lit(K.GUIDANCE_DEFAULT[i - 1]))
    rows = decisions.filter(reason.isNotNull())
    return rows.withColumns({
        "title": pick(1), "message": F.replace(pick(2), F.lit("{target}"), F.coalesce(F.col(target), F.lit(""))),
        "guidance_severity": pick(3)})


def route_requests(raw: DataFrame) -> DataFrame:
    """Start node of a route request, from the current or the older field name."""
    start = F.coalesce(S.clean_text(F.col("currentNodeId")), S.clean_text(F.col("fromNodeId")))
    return raw.withColumn("current_node", start).drop("currentNodeId", "fromNodeId")


def targets(decisions: DataFrame, exits_by_node: DataFrame, mode: str) -> DataFrame:
    """Where to send rerouted users: the best exit in an evacuation, else their own destination; none drops them."""
    rows = decisions.filter("action = 'REROUTE'")
    if mode == "evacuation":
        exits = exits_by_node.select(F.col("node").alias("current_node"), F.col("exit_id").alias("target"))
        rows = rows.join(exits, "current_node", "left")
    else:
        rows = rows.withColumn("target", F.col("destination"))
    return rows.filter("target IS NOT NULL")
