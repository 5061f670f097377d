"""Hazard deltas of open incidents and the blocked zones that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K


def local_deltas(incidents: DataFrame, honor_is_blocking: bool = False) -> DataFrame:
    """Sum of penalties per affected zone.

    A missing list means the incident's own zone; an empty list affects nothing. The blocking flag of an
    incident counts only on request: by default only the penalty sum blocks.
    """
    penalty = F.coalesce("hazard_penalty", F.lit(K.INCIDENT_PENALTY_DEFAULT))
    if honor_is_blocking:
        penalty = F.when(F.col("is_blocking"), F.greatest(penalty, F.lit(K.BLOCKING_PENALTY))).otherwise(penalty)
    zones = F.coalesce("affected_zone_ids", F.array("zone_id"))
    return incidents.select(F.explode(zones).alias("zone_id"), penalty.alias("penalty")) \
        .groupBy("zone_id").agg(F.sum("penalty").alias("local_delta"), F.count(F.lit(1)).alias("incidents"))


def with_blocked(deltas: DataFrame) -> DataFrame:
    return deltas.withColumn("blocked", F.col("local_delta") >= K.BLOCKING_PENALTY)


def open_incidents(changes: DataFrame) -> DataFrame:
    """State after add / replace / clear events: the latest event per incident, when it is no clear."""
    latest = changes.groupBy("incident_id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "incident_id"]),
                                                         F.struct("ts", "arrival")).alias("e"))
    return latest.select("incident_id", "e.*").filter(F.col("op") != "clear")


def affected_zones(incidents: DataFrame) -> DataFrame:
    return local_deltas(incidents).select("zone_id")
