"""Risk, incidents, advisories: fusion, states, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..config import PolicyConfig
from ..functions import scalars as S
from ..operators import decision, folds, incidents as I, risk as R, zones as Z
from ..operators.ordered import ordered_fold, with_average, with_last_known, with_previous
from .catalog import query, rounded

_SEV = "CASE WHEN {0} >= 0.8 THEN 'critical' WHEN {0} >= 0.5 THEN 'warn' ELSE 'info' END"

# Walks one key in order inside the comparison engine.
_ORDERED = """SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY ts, arrival) AS rn FROM risk_cycle"""

_STATE = """
    SELECT zone_id, rn, ts, arrival, risk_raw, risk_raw AS risk_ema, 0e0 AS slope, false AS changed,
           CASE WHEN risk_raw >= 0.8e0 THEN 'critical' WHEN risk_raw >= 0.55e0 THEN 'warn' ELSE 'info' END AS severity,
           ts AS since, 0 AS aw, 0 AS ac, 0 AS bw, 0 AS bc
    FROM steps WHERE rn = 1
    UNION ALL
    SELECT zone_id, rn, ts, arrival, risk_raw, e, slope, next <> severity, next, CASE WHEN next <> severity THEN ts ELSE since END,
           aw, ac, bw, bc FROM (
        SELECT *, CASE WHEN ts - since < 1200 THEN severity
                WHEN severity = 'info' AND aw >= 1200 THEN 'warn'
                WHEN severity = 'warn' AND ac >= 900 THEN 'critical'
                WHEN severity = 'warn' AND bw >= 2000 THEN 'info'
                WHEN severity = 'critical' AND bc >= 1500 THEN 'warn' ELSE severity END AS next FROM (
            SELECT zone_id, rn, ts, arrival, risk_raw, e, severity, since,
                   CASE WHEN dt > 0 THEN (e - risk_ema) / (dt / 1000e0) ELSE slope END AS slope,
                   CASE WHEN e >= 0.55e0 THEN aw + dt ELSE 0 END AS aw, CASE WHEN e >= 0.8e0 THEN ac + dt ELSE 0 END AS ac,
                   CASE WHEN e <= 0.45e0 THEN bw + dt ELSE 0 END AS bw, CASE WHEN e <= 0.65e0 THEN bc + dt ELSE 0 END AS bc FROM (
                SELECT s.zone_id, s.rn, s.ts, s.arrival, s.risk_raw, f.risk_ema, f.severity, f.since, f.slope, f.aw, f.ac, f.bw, f.bc,
                       0.35e0 * s.risk_raw + (1 - 0.35e0) * f.risk_ema AS e, greatest(0, s.ts - f.ts) AS dt
                FROM states f JOIN steps s ON s.zone_id = f.zone_id AND s.rn = f.rn + 1)))"""
_TREND = "CASE WHEN slope > 0.05 THEN 'rising' WHEN slope < -0.05 THEN 'falling' ELSE 'flat' END"
STATE_VIEWS = {"steps": _ORDERED, "states": _STATE}


def _states(t):
    return R.risk_states(t.risk_cycle)


def _zone_risk(t):
    return R.fuse(t.perception).groupBy("zone_id").agg(F.avg("risk").alias("risk"))


@query("risk_fusion", "P01 P02 P04 S01", f"SELECT arrival, round(risk, 9) AS risk, {_SEV.format('risk')} AS severity FROM fused")
def _(t):
    return rounded(R.fuse(t.perception).select("arrival", "risk", "severity"))


@query("severity_counts", "P04 A07", f"""
    SELECT zone_id, count(*) FILTER (s = 'info') AS info, count(*) FILTER (s = 'warn') AS warn, count(*) FILTER (s = 'critical') AS critical
    FROM (SELECT zone_id, {_SEV.format('risk')} AS s FROM fused) GROUP BY zone_id""")
def _(t):
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return R.fuse(t.perception).groupBy("zone_id").agg(n("info"), n("warn"), n("critical"))


@query("client_fusion", "P03", """
    SELECT arrival, round(greatest(0e0, least(1e0, 0.6e0 * density + 0.4e0 * anomaly)), 9) AS risk FROM perception""")
def _(t):
    return rounded(t.perception.select("arrival", S.fused_risk(F.col("density"), F.col("anomaly")).alias("risk")))


@query("expand_routing_zones", "J01", f"""
    SELECT routing_zone_id, parent_id, round(coalesce(risk, 0e0), 9) AS risk, {_SEV.format('coalesce(risk, 0e0)')} AS severity
    FROM routing_zones LEFT JOIN zone_avg ON zone_id = parent_id""")
def _(t):
    return rounded(Z.expand_to_routing_zones(t.routing_zones, _zone_risk(t)))


@query("risk_summary", "J01 A07 X08", """
    SELECT round(max(risk), 9) AS max_risk, round(avg(risk), 9) AS avg_risk, count(*) AS zones FROM zone_risk""")
def _(t):
    return rounded(R.risk_summary(Z.expand_to_routing_zones(t.routing_zones, _zone_risk(t))))


@query("most_risky_zone", "O02", "SELECT coalesce(min_by(zone_id, (-risk, CAST(substr(zone_id, 2) AS INT))), 'Z_ATRIUM') AS zone_id FROM zone_risk")
def _(t):
    rz = Z.expand_to_routing_zones(t.routing_zones, _zone_risk(t))
    return R.most_risky_zone(rz.withColumn("zone_pos", F.substring("routing_zone_id", 2, 9).cast("int")))


@query("local_deltas", "A04", "SELECT zone_id, round(local_delta, 4) AS local_delta, incidents FROM deltas")
def _(t):
    return rounded(I.local_deltas(t.incidents), 4)


@query("blocked_zones", "A05", "SELECT zone_id, local_delta >= 9999 AS blocked FROM deltas")
def _(t):
    return I.with_blocked(I.local_deltas(t.incidents)).select("zone_id", "blocked")


@query("expand_with_delta", "J02 A04", f"""
    SELECT routing_zone_id, round(z.risk, 9) AS risk, {_SEV.format('z.risk')} AS severity, round(nullif(d.local_delta, 0), 4) AS local_delta
    FROM (SELECT zone_id AS routing_zone_id, risk FROM zone_risk) z LEFT JOIN deltas d ON d.zone_id = routing_zone_id""")
def _(t):
    out = Z.expand_with_delta(t.routing_zones, _zone_risk(t), I.local_deltas(t.incidents))
    return out.select("routing_zone_id", F.round("risk", 9).alias("risk"), "severity", F.round("local_delta", 4).alias("local_delta"))


@query("ewma_anomaly", "W01", """, fold AS (
    SELECT zone_id, rn, arrival, anomaly AS ewma FROM ordered WHERE rn = 1
    UNION ALL SELECT o.zone_id, o.rn, o.arrival, 0.7e0 * f.ewma + (1 - 0.7e0) * o.anomaly
    FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1)
    SELECT arrival, round(ewma, 9) AS ewma FROM fold""", recursive=True, views={
        "ordered": "SELECT zone_id, arrival, anomaly, row_number() OVER (PARTITION BY zone_id ORDER BY ts, arrival) AS rn FROM perception"})
def _(t):
    return rounded(with_average(t.perception, ["zone_id"], ["ts", "arrival"], "anomaly", "ewma", K.EWMA_KEEP).select("arrival", "ewma"))


@query("risk_ema_trend", "W02 P06", f"SELECT arrival, round(risk_ema, 9) AS risk_ema, round(slope, 7) AS slope_per_sec, {_TREND} AS trend FROM states",
       recursive=True, views=STATE_VIEWS)
def _(t):
    return _states(t).select("arrival", F.round("risk_ema", 9).alias("risk_ema"), F.round("slope_per_sec", 7).alias("slope_per_sec"), "trend")


@query("severity_hysteresis", "W04 P05 T01", "SELECT arrival, zone_id, severity, changed FROM states", recursive=True, views=STATE_VIEWS)
def _(t):
    return _states(t).select("arrival", "zone_id", "severity", "changed")


@query("alt_hysteresis", "W05", """, fold AS (
    SELECT zone_id, rn, arrival, lam * raw AS risk, CASE WHEN lam * raw >= 0.78 THEN 'critical' WHEN lam * raw >= 0.55 THEN 'warn' ELSE 'normal' END AS state
    FROM ordered WHERE rn = 1
    UNION ALL SELECT zone_id, rn, arrival, r, CASE
        WHEN state = 'critical' AND r > 0.68 THEN 'critical' WHEN r >= 0.78 THEN 'critical'
        WHEN state = 'normal' THEN CASE WHEN r >= 0.55 THEN 'warn' ELSE 'normal' END
        WHEN r <= 0.45 THEN 'normal' ELSE 'warn' END FROM (
        SELECT o.zone_id, o.rn, o.arrival, f.state, least(1e0, greatest(0e0, lam * raw + (1 - lam) * f.risk)) AS r
        FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1))
    SELECT arrival, round(risk, 9) AS alt_risk, state AS alt_state FROM fold""", recursive=True, views={"ordered": """
        SELECT zone_id, arrival, least(1e0, greatest(0e0, 0.65e0 * density + 0.35e0 * anomaly)) AS raw,
               0.7e0 * (0.25e0 + 0.75e0 * coalesce(conf, 1e0)) AS lam,
               row_number() OVER (PARTITION BY zone_id ORDER BY ts, arrival) AS rn FROM perception"""})
def _(t):
    return rounded(ordered_fold(t.perception, ["zone_id"], ["ts", "arrival"], folds.AltRisk()).select("arrival", "alt_risk", "alt_state"))


_FLAGGED = """SELECT *, abs(risk_ema - coalesce(lag(risk_ema) OVER (PARTITION BY zone_id ORDER BY rn), risk_ema)) AS ema_delta FROM states"""


@query("risk_change_flags", "W07 T05", """
    SELECT arrival, round(ema_delta, 9) AS ema_delta, changed OR ema_delta >= 0.08e0 AS meaningful FROM flagged""",
       recursive=True, views={**STATE_VIEWS, "flagged": _FLAGGED})
def _(t):
    return rounded(R.with_change_flag(_states(t)).select("arrival", "ema_delta", "meaningful"))


@query("routing_zone_diff", "W08 X08", """
    SELECT frame_id, routing_zone_id, round(risk, 9) AS risk,
           CASE WHEN frame_id = first_frame THEN (any_changed AND NOT parent_changed) OR abs(risk) >= 0.08e0
                ELSE abs(risk - lag(risk) OVER (PARTITION BY routing_zone_id ORDER BY frame_id)) >= 0.08e0 END AS moved FROM (
        SELECT *, last_value(taken IGNORE NULLS) OVER (PARTITION BY routing_zone_id ORDER BY frame_id) AS risk FROM (
            SELECT *, CASE WHEN NOT any_changed OR parent_changed OR frame_id = first_frame THEN current END AS taken FROM (
                SELECT g.frame_id, g.routing_zone_id, g.any_changed, g.first_frame, coalesce(p.parent_changed, false) AS parent_changed,
                       coalesce(last_value(p.ema IGNORE NULLS) OVER (PARTITION BY g.routing_zone_id ORDER BY g.frame_id), 0e0) AS current
                FROM grid g LEFT JOIN parents p ON p.frame_id = g.frame_id AND p.zone_id = g.parent_id)))""", recursive=True, views={
        **STATE_VIEWS, "flagged": _FLAGGED,
        "framed": "SELECT *, ts // 5000 AS frame_id, changed OR ema_delta >= 0.08e0 AS meaningful FROM flagged",
        "parents": """SELECT frame_id, zone_id, max_by(risk_ema, rn) AS ema, bool_or(meaningful) AS parent_changed
                      FROM framed GROUP BY frame_id, zone_id""",
        "grid": """SELECT f.*, routing_zone_id, parent_id FROM (SELECT frame_id, bool_or(meaningful) AS any_changed,
                   min(frame_id) OVER () AS first_frame FROM framed GROUP BY frame_id) f, routing_zones"""})
def _(t):
    flagged = R.with_change_flag(_states(t)).withColumn("frame_id", F.floor(F.col("ts") / 5000))
    out = R.routing_zone_history(flagged, t.routing_zones, "changed")
    return rounded(out.select("frame_id", "routing_zone_id", "risk", "moved"))


@query("heartbeat_throttle", "W28", """, fold AS (
    SELECT zone_id, rn, arrival, ts AS last, true AS granted FROM ordered WHERE rn = 1
    UNION ALL SELECT o.zone_id, o.rn, o.arrival, CASE WHEN o.ts - f.last >= 9500 THEN o.ts ELSE f.last END, o.ts - f.last >= 9500
    FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1)
    SELECT arrival, granted FROM fold""", recursive=True, views={
        "ordered": "SELECT zone_id, arrival, ts, row_number() OVER (PARTITION BY zone_id ORDER BY ts, arrival) AS rn FROM perception"})
def _(t):
    return ordered_fold(t.perception, ["zone_id"], ["ts", "arrival"], folds.Cooldown("ts", None, K.HEARTBEAT_MS)).select("arrival", "granted")


@query("advisories", "P29 P30 J11", """
    SELECT arrival, action, CASE severity WHEN 'critical' THEN 'evacuation' WHEN 'warn' THEN 'heightened' ELSE 'normal' END AS routing_mode,
           CASE severity WHEN 'critical' THEN 3e0 WHEN 'warn' THEN 1.8e0 ELSE 1e0 END AS penalty_multiplier, severity <> 'info' AS suggested_reroute,
           CASE action WHEN 'DISPERSE' THEN 'Critical congestion in ' || name || '. Disperse immediately.'
               WHEN 'DIVERT' THEN 'Critical risk in ' || name || '. Rerouting to safer paths.'
               WHEN 'PREPARE_DIVERT' THEN 'Crowd building in ' || name || '. Prepare to divert.'
               WHEN 'SLOW_DOWN' THEN 'Caution in ' || name || '. Slow down and keep moving.'
               WHEN 'MONITOR' THEN 'Monitoring ' || name || ' (risk rising).' ELSE 'Normal conditions in ' || name || '.' END AS message_short,
           severity = 'critical' AND zone_id IN ('AZ1', 'AZ3') AS closes_entry FROM (
        SELECT *, CASE zone_id WHEN 'AZ1' THEN 'North hall' WHEN 'AZ3' THEN 'Atrium' ELSE 'Zone ' || zone_id END AS name,
               CASE WHEN severity = 'critical' AND slope > 0.05e0 AND slope >= 0.15e0 THEN 'DISPERSE' WHEN severity = 'critical' THEN 'DIVERT'
                    WHEN severity = 'warn' AND slope > 0.05e0 AND slope >= 0.1e0 THEN 'PREPARE_DIVERT' WHEN severity = 'warn' THEN 'SLOW_DOWN'
                    WHEN slope > 0.05e0 THEN 'MONITOR' ELSE 'NONE' END AS action FROM states)""", recursive=True, views=STATE_VIEWS)
def _(t):
    context = t.spark.createDataFrame([("AZ1", "North hall", True, False), ("AZ3", "Atrium", True, True)],
                                      "zone_id string, label string, is_entry boolean, is_exit boolean")
    return R.advisories(_states(t), context).select(
        "arrival", "action", "routing_mode", "penalty_multiplier", "suggested_reroute", "message_short",
        F.coalesce(F.size("directives.close_entries") > 0, F.lit(False)).alias("closes_entry"))


@query("policy_advisories", "F05 P29", """
    SELECT arrival, action, CASE severity WHEN 'critical' THEN 5e0 WHEN 'warn' THEN 2.5e0 ELSE 0.5e0 END AS penalty_multiplier, severity = 'critical' AS suggested_reroute,
           CASE action WHEN 'DISPERSE' THEN 'Critical congestion in ' || name || '. Disperse immediately.' WHEN 'DIVERT' THEN 'Critical risk in ' || name || '. Rerouting to safer paths.'
               WHEN 'PREPARE_DIVERT' THEN 'Crowd building in ' || name || '. Prepare to divert.' WHEN 'SLOW_DOWN' THEN 'Caution in ' || name || '. Slow down and keep moving.'
               WHEN 'MONITOR' THEN 'Monitoring ' || name || ' (risk rising).' ELSE 'Normal conditions in ' || name || '.' END AS message_short FROM (
        SELECT *, 'Area ' || zone_id AS name, CASE WHEN severity = 'critical' AND slope > 0.05e0 AND slope >= 0.06e0 THEN 'DISPERSE' WHEN severity = 'critical' THEN 'DIVERT'
                    WHEN severity = 'warn' AND slope > 0.05e0 AND slope >= 0.055e0 THEN 'PREPARE_DIVERT' WHEN severity = 'warn' THEN 'SLOW_DOWN'
                    WHEN slope > 0.05e0 THEN 'MONITOR' ELSE 'NONE' END AS action FROM states)""", recursive=True, views=STATE_VIEWS)
def _(t):
    """Advisories under a policy of the caller's own."""
    policy = PolicyConfig(rising_warn_slope=0.055, rising_critical_slope=0.06, penalty_info=0.5, penalty_warn=2.5, penalty_critical=5.0, reroute_on_warn=False, zone_name_prefix="Area ")
    return R.advisories(_states(t), None, policy).select("arrival", "action", "penalty_multiplier", "suggested_reroute", "message_short")


@query("global_max_risk", "A06", "SELECT round(greatest(0e0, max(risk_ema)), 9) AS global_max_risk FROM states", recursive=True, views=STATE_VIEWS)
def _(t):
    return rounded(R.global_max(_states(t)))


_FALL = """
    SELECT device, 0 AS rn, CAST(NULL AS BIGINT) AS arrival, 'idle' AS phase, CAST(NULL AS VARCHAR) AS event, 0 AS fell, 0 AS hit, ts AS moved, 1e0 AS before, 0 AS prompted
    FROM samples WHERE rn = 1
    UNION ALL
    SELECT device, rn, arrival, next, CASE WHEN phase = 'prompt' AND next = 'idle' THEN 'emergency' WHEN phase = 'impact' AND next = 'prompt' THEN 'prompt' END,
           CASE WHEN phase = 'idle' AND next = 'freefall' THEN ts ELSE fell END, CASE WHEN phase = 'freefall' AND next = 'impact' THEN ts ELSE hit END,
           CASE WHEN phase = 'freefall' AND next = 'impact' THEN ts ELSE moved END, CASE WHEN phase = 'prompt' THEN before ELSE m END,
           CASE WHEN phase = 'impact' AND next = 'prompt' THEN ts ELSE prompted END FROM (
        SELECT *, CASE phase WHEN 'prompt' THEN CASE WHEN ts - prompted >= 15000 THEN 'idle' ELSE 'prompt' END
                WHEN 'idle' THEN CASE WHEN m < 0.45e0 THEN 'freefall' ELSE 'idle' END
                WHEN 'freefall' THEN CASE WHEN ts - fell > 2200 THEN 'idle' WHEN m > 2.2e0 THEN 'impact' ELSE 'freefall' END
                ELSE CASE WHEN ts - hit >= 10000 AND ts - moved >= 10000 THEN 'prompt' WHEN ts - hit > 16000 THEN 'idle' ELSE 'impact' END END AS next FROM (
            SELECT s.device, s.rn, s.arrival, s.ts, s.m, f.phase, f.fell, f.hit, f.before, f.prompted,
                   CASE WHEN f.phase <> 'prompt' AND (abs(s.m - f.before) > 0.16e0 OR abs(s.m - 1) > 0.16e0) THEN s.ts ELSE f.moved END AS moved
            FROM falls f JOIN samples s ON s.device = f.device AND s.rn = f.rn + 1))"""


FALL_VIEWS = {
    "samples": """SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, arrival) AS rn FROM (
        SELECT event_id AS arrival, user_id % 10 AS device, (epoch_us(ts) // 1000) // 2000 AS ts, CASE WHEN value < 20 THEN 0.2e0 WHEN value > 60 THEN 3e0 ELSE 1e0 END AS m FROM events)""",
    "falls": _FALL}


def fall_samples(events):
    """Accelerometer magnitudes derived from the events: calm, free fall and impact phases per user."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(F.col("event_id").alias("arrival"), (F.col("user_id") % 10).alias("device"), F.floor(ms / 2000).alias("ts"),
                         F.when(F.col("value") < 20, 0.2).when(F.col("value") > 60, 3.0).otherwise(1.0).alias("magnitude"))


@query("fall_events", "W26", "SELECT arrival, phase, event AS fall_event FROM falls WHERE rn > 0", recursive=True, views=FALL_VIEWS)
def _(t):
    return ordered_fold(fall_samples(t.read("events")), ["device"], ["ts", "arrival"], folds.FallDetector()).select("arrival", "phase", "fall_event")


@query("newest_incidents", "W25", """
    SELECT zone_id, incident_id, newest_rank FROM (
        SELECT zone_id, incident_id, row_number() OVER (PARTITION BY zone_id ORDER BY ts DESC, incident_id) - 1 AS newest_rank FROM incidents)
    WHERE newest_rank < 60""")
def _(t):
    from ..operators.sampling import newest_per_key
    return newest_per_key(t.incidents, ["zone_id"], "ts", 60, "incident_id").select("zone_id", "incident_id", "newest_rank")


@query("open_incidents", "T04", """
    SELECT zone_id, CAST(count(*) AS BIGINT) AS open, round(sum(coalesce(value, 0e0)), 4) AS value FROM (
        SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS value, 'Z' || (user_id % 25) AS zone_id
        FROM events GROUP BY user_id) WHERE op <> 'signup' GROUP BY zone_id""")
def _(t):
    changes = t.read("events").select(
        F.col("user_id").alias("incident_id"), F.col("event_id").alias("ts"), F.col("event_id").alias("arrival"),
        F.when(F.col("event_type") == "signup", "clear").otherwise("add").alias("op"),
        F.concat(F.lit("Z"), (F.col("user_id") % 25).cast("string")).alias("zone_id"), "value")
    return rounded(I.open_incidents(changes).groupBy("zone_id").agg(F.count(F.lit(1)).alias("open"), F.sum("value").alias("value")), 4)
