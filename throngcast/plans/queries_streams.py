"""Streams over the events table, read as a stream of files; results equal their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import run_folder
from ..streaming import streams
from . import queries_routes as R
from .catalog import query, rounded
from .queries_presence import _CELL, METRIC_FOLD, METRIC_VIEWS
from .queries_risk import FALL_VIEWS, STATE_VIEWS, fall_samples
from .views import Tables


class StreamTables(Tables):
    """The same views with every table read as a stream."""

    def read(self, name):
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def _stream(t):
    return StreamTables(t.spark, t.folder)


@query("stream_risk", "T01 T05", "SELECT arrival, severity, changed, changed OR ema_delta >= 0.08e0 AS meaningful FROM flagged", recursive=True, views={
    **STATE_VIEWS, "flagged": "SELECT *, abs(risk_ema - coalesce(lag(risk_ema) OVER (PARTITION BY zone_id ORDER BY rn), risk_ema)) AS ema_delta FROM states"})
def _(t):
    return streams.run_to_table(streams.risk_stream(_stream(t).risk_cycle), "stream_risk").select("arrival", "severity", "changed", "meaningful")


@query("stream_presence", "T02 T03", "SELECT user_id, arrival, ts_ms FROM latest")
def _(t):
    changes = streams.run_to_table(streams.presence_stream(_stream(t).presence), "stream_presence")
    last = changes.filter("status <> 'expired'").groupBy("user_id").agg(F.max_by(F.struct("arrival", "ts_ms", "status"), "arrival").alias("e"))
    return last.select("user_id", "e.*").filter("status = 'active'").drop("status")


@query("stream_incidents", "T04", """
    SELECT zone_id, round(sum(penalty), 4) AS local_delta FROM (
        SELECT CASE WHEN value > 200 THEN 9999e0 WHEN value > 50 THEN value ELSE 40e0 END AS penalty,
               unnest(CASE WHEN event_id % 3 = 0 THEN ['Z' || ((user_id + 1) % 25), 'Z' || ((user_id + 2) % 25)] ELSE ['Z' || (user_id % 25)] END) AS zone_id
        FROM (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS op FROM events GROUP BY user_id)
        WHERE op <> 'signup') GROUP BY zone_id""")
def _(t):
    u, e = F.col("user_id"), F.col("event_id")
    zone = lambda shift: F.concat(F.lit("Z"), ((u + shift) % 25).cast("string"))
    changes = _stream(t).read("events").select(
        u.cast("string").alias("incident_id"), e.alias("arrival"), F.when(F.col("event_type") == "signup", "clear").otherwise("add").alias("op"),
        zone(0).alias("zone_id"), F.when(F.col("value") > 200, 9999.0).when(F.col("value") > 50, F.col("value")).alias("hazard_penalty"),
        F.when(e % 3 == 0, F.array(zone(1), zone(2))).alias("affected_zone_ids"))
    totals = streams.zone_totals(streams.run_to_table(streams.incident_stream(changes), "stream_incidents"))
    return rounded(totals.filter(F.abs("local_delta") > 1e-6), 4)


@query("stream_cache", "T09", """, fold AS (
    SELECT zone_id, rn, arrival, ts + 45000 AS expires, density AS cached_value, false AS hit FROM ordered WHERE rn = 1
    UNION ALL SELECT o.zone_id, o.rn, o.arrival, CASE WHEN f.expires > o.ts THEN f.expires ELSE o.ts + 45000 END,
        CASE WHEN f.expires > o.ts THEN f.cached_value ELSE o.density END, f.expires > o.ts FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1)
    SELECT arrival, round(cached_value, 9) AS cached_value, hit FROM fold""", recursive=True, views={
        "ordered": "SELECT zone_id, arrival, ts, density, row_number() OVER (PARTITION BY zone_id ORDER BY ts, arrival) AS rn FROM perception"})
def _(t):
    requests = _stream(t).perception.select(F.col("zone_id").alias("cache_key"), "ts", "arrival", F.col("density").alias("value"))
    return rounded(streams.run_to_table(streams.inference_cache_stream(requests), "stream_cache").select("arrival", "cached_value", "hit"))


@query("stream_falls", "T08", "SELECT arrival, phase, event AS fall_event FROM falls WHERE rn > 0", recursive=True, views=FALL_VIEWS)
def _(t):
    """The timer's own rows (no sample behind them) are left to the tests."""
    samples = fall_samples(_stream(t).read("events"))
    return streams.run_to_table(streams.fall_stream(samples), "stream_falls").filter("arrival IS NOT NULL").select("arrival", "phase", "fall_event")


@query("stream_metric", "T10", METRIC_FOLD, recursive=True, views=METRIC_VIEWS)
def _(t):
    polls = _stream(t).perception.select("arrival", F.col("zone_id").alias("metric"), F.col("ts").alias("ts_ms"), F.when(F.col("conf").isNotNull(), F.col("density")).alias("value"))
    return streams.run_to_table(streams.stale_metric_stream(polls), "stream_metric").select("arrival", "last_value", "updated_at", "source")


@query("stream_windows", "T11", """
    SELECT video, window_index, round(avg(motion), 6) AS motion_mean, max(motion) AS motion_max, round(avg(jerk), 6) AS jerk_mean FROM (
        SELECT *, abs(motion - lag(motion) OVER (PARTITION BY video, window_index ORDER BY frame_idx)) AS jerk FROM (
            SELECT 'c' || (event_id % 8) AS video, event_id // 8 AS frame_idx, event_id // 8 // 10 AS window_index, value AS motion FROM events))
    GROUP BY video, window_index HAVING count(*) = 10""")
def _(t):
    e = F.col("event_id")
    frames = _stream(t).read("events").select(F.concat(F.lit("c"), (e % 8).cast("string")).alias("video"), F.floor(e / 8).alias("frame_idx"), F.col("value").alias("motion"))
    return rounded(streams.run_to_table(streams.count_window_stream(frames), "stream_windows").select("video", "window_index", "motion_mean", "motion_max", "jerk_mean"), 6)


# three micro-batches: normal mode; evacuation; evacuation with incidents in every fifth zone
_REROUTE_VIEWS = {
    **R._ROUTE_VIEWS,
    "stages": "SELECT * FROM (VALUES (0, 1e0, 'normal'), (1, 1.4e0, 'evacuation'), (2, 1.4e0, 'evacuation')) t(batch, factor, mode)",
    "hot_zones": "SELECT zone_id, local_delta FROM small_deltas WHERE CAST(substr(zone_id, 2) AS INT) % 5 = 0",
    "stage_costs": """SELECT batch, src, dst, one_way, greatest(0e0, length * factor * (1 + 2 * greatest(0e0, coalesce(l.load_ratio, 1e0) - 1)) + 80 * least(1e0, 2 * coalesce(r.risk, 0e0))
            + coalesce(d.local_delta, 0e0)) AS cost, coalesce(d.local_delta, 0e0) AS delta
        FROM edges e CROSS JOIN stages s LEFT JOIN zone_risk r USING (zone_id) LEFT JOIN hot_zones d ON d.zone_id = e.zone_id AND s.batch = 2 LEFT JOIN zone_load l ON l.zone_id = e.zone_id""",
    "stage_arcs": """SELECT batch, src, dst, cost FROM stage_costs WHERE delta < 9999 UNION ALL SELECT batch, dst, src, cost FROM stage_costs WHERE delta < 9999 AND NOT one_way""",
    "stage_users": """SELECT s.batch, s.mode, a.user_id, bool_or(s.batch = 2 AND h.zone_id IS NOT NULL) AS has_incident, bool_or(risk >= 0.75e0) AS enters_high_risk,
            bool_or(coalesce(load_ratio, 1e0) >= 1.15e0) AS congestion FROM stages s CROSS JOIN ahead a LEFT JOIN hot_zones h ON h.zone_id = a.zone_id
        WHERE s.batch < 2 OR EXISTS (SELECT 1 FROM (SELECT user_id, unnest(zone_path) AS z FROM user_routes) u JOIN hot_zones ON zone_id = z WHERE u.user_id = a.user_id) GROUP BY ALL"""}


@query("stream_reroute", "T06 T07 T13 X09", """, dist(batch, source, node, cost) USING KEY (batch, source, node) AS (
        SELECT batch, e, e, 0e0 FROM stages, (VALUES ('0'), ('24')) v(e)
        UNION SELECT batch, source, src, min(c) FROM (
            SELECT d.batch, d.source, a.src, d.cost + a.cost AS c, r.cost AS known FROM dist d JOIN stage_arcs a ON a.batch = d.batch AND a.dst = d.node
            LEFT JOIN recurring.dist r ON r.batch = d.batch AND r.source = d.source AND r.node = a.src) WHERE known IS NULL OR c < known GROUP BY batch, source, src),
    nearest AS (SELECT batch, node, source, cost, row_number() OVER (PARTITION BY batch, node ORDER BY cost, CAST(source AS INT)) AS r FROM dist)
    SELECT u.batch, user_id, reason, CASE WHEN u.mode = 'evacuation' THEN source ELSE CAST(user_id * 7 % 25 AS VARCHAR) END AS target, round(cost, 6) AS exit_cost FROM (
        SELECT *, CASE WHEN has_incident THEN 'ROUTE_BLOCKED_BY_INCIDENT' WHEN mode = 'evacuation' THEN 'GLOBAL_MODE_ESCALATION' WHEN enters_high_risk THEN 'ROUTE_ENTERING_HIGH_RISK'
            WHEN congestion THEN 'CONGESTION_OVER_CAPACITY' END AS reason FROM stage_users) u
    JOIN nearest n ON n.batch = u.batch AND n.r = 1 AND n.node = CAST(user_id % 25 AS VARCHAR) WHERE reason IS NOT NULL""", recursive=True, views=_REROUTE_VIEWS)
def stream_reroute(t):
    """Changed zones arrive in three micro-batches; before each, the control tables are written anew, and the sink reads them."""
    base = run_folder(t.spark, "reroute")
    spark, place = t.spark, lambda name: f"{base}/{name}"
    parity = F.substring("zone_id", 2, 9).cast("int") % 5 == 0
    hot = R.small_deltas(t).where(parity)
    none = hot.where("false")
    R.user_routes(t).write.parquet(place("routes"))
    R.doubled_risk(t).write.parquet(place("zone_risk"))
    R.zone_load(t).write.parquet(place("load"))
    read = lambda name: lambda: spark.read.parquet(place(name))
    tables = {name: read(name) for name in ("mode", "routes", "zone_risk", "load", "deltas")}
    tables |= {"incidents": lambda: spark.read.parquet(place("deltas")).select("zone_id"), "edges": lambda: t.edges, "exits": lambda: t.exits}
    sink = streams.RerouteSink(tables, place("sent"), lambda: 10 ** 6, place("kept"))
    zones = t.routing_zones.select(F.col("routing_zone_id").alias("zone_id"))
    schema = zones.schema
    for mode, deltas, changed in (("normal", none, zones), ("evacuation", none, zones.limit(0)), ("evacuation", hot, hot.select("zone_id"))):
        t.read("region").limit(1).select(F.lit(mode).alias("mode")).write.mode("overwrite").parquet(place("mode"))
        deltas.write.mode("overwrite").parquet(place("deltas"))
        changed.coalesce(1).write.mode("append").parquet(place("changed"))
        stream = spark.readStream.schema(schema).parquet(place("changed"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", place("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.parquet(place("sent"))
    return rounded(sent.select("batch", "user_id", "reason", "target", "exit_cost"), 6)


@query("stream_presence_windows", "T12 A15", f"""
    SELECT start_ms, lat_cell, lng_cell, count(*) AS users, true AS late_rows_counted FROM (
        SELECT *, unnest(range(0, 10)) AS back FROM (SELECT t_ms, {_CELL} FROM (SELECT lat, lng, (ts_ms - 1704067200000) // 10000 AS t_ms FROM presence)))
    , LATERAL (SELECT (t_ms // 3000 - back) * 3000 AS start_ms) GROUP BY ALL HAVING count(*) >= 2""")
def stream_presence_windows(t):
    """The batch query presence_windows as a stream of three micro-batches: the earlier half of the time, the later one, and rows repeated too late."""
    base = run_folder(t.spark, "presence")
    rows = t.presence.withColumn("ts_ms", F.floor((F.col("ts_ms") - 1704067200000) / 10000))
    span = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    middle = (span[0] + span[1]) // 2
    for part in (rows.where(F.col("ts_ms") < middle), rows.where(F.col("ts_ms") >= middle), rows.where(F.col("ts_ms") < span[0] + (middle - span[0]) // 8)):
        part.coalesce(1).write.mode("append").parquet(base)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(base)
    cells, late = streams.presence_grid_table(stream)
    return cells.select("start_ms", "lat_cell", "lng_cell", "users", F.lit(late > 0).alias("late_rows_counted"))


@query("stream_presence_expiry", "T02 T03", """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival DESC) AS rn FROM presence) WHERE rn = 1),
    clock AS (SELECT max(ts_ms) - 30000 AS watermark FROM presence)
    SELECT user_id, arrival, ts_ms, CASE WHEN offline THEN 'offline' ELSE 'active' END AS status FROM newest
    UNION ALL SELECT user_id, arrival, ts_ms, 'expired' FROM newest, clock WHERE NOT offline AND ts_ms + 30000 <= watermark""")
def stream_presence_expiry(t):
    """Every change of a user's state, the expiry by timer included: whoever was not heard of for 30 s of event time when the watermark passed."""
    return streams.run_to_table(streams.presence_stream(_stream(t).presence), "stream_presence").select("user_id", "arrival", "ts_ms", "status")
