"""Edge costs, routes, exits and reroute decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import decision as D, graph, incidents as I, zones as Z
from .catalog import query, rounded
from .queries_risk import _zone_risk


def zone_risk(t):
    return Z.expand_to_routing_zones(t.routing_zones, _zone_risk(t)).select(F.col("routing_zone_id").alias("zone_id"), "risk")


def small_deltas(t):
    return I.local_deltas(t.incidents).select("zone_id", (F.col("local_delta") / F.col("incidents") * 25).alias("local_delta"))


def zone_load(t):
    users = t.read("events").groupBy((F.col("user_id") % 25).alias("n")).agg((F.count_distinct("user_id") * 15.0).alias("users"))
    zones = t.routing_zones.select(F.col("routing_zone_id").alias("zone_id"), "capacity")
    return users.withColumn("zone_id", F.concat(F.lit("Z"), F.col("n").cast("string"))).join(F.broadcast(zones), "zone_id") \
        .select("zone_id", (F.col("users") / F.col("capacity")).alias("load_ratio"))


def costs(t, mode="alert"):
    return graph.edge_costs(t.edges, zone_risk(t), small_deltas(t), zone_load(t), mode)


@query("edge_costs", "G01 J05 U06", "SELECT edge_id, src, dst, zone_id, length, round(cost, 6) AS cost FROM arcs")
def _(t):
    return rounded(costs(t), 6)


# every simple path, the cheapest is picked afterwards
_WALKS = """
    SELECT n AS source, n AS node, 0e0 AS cost, [n] AS nodes, CAST([] AS VARCHAR[]) AS edge_ids FROM (VALUES ('0'), ('24')) v(n)
    UNION ALL SELECT source, dst, w.cost + a.cost, list_append(nodes, dst), list_append(edge_ids, edge_id)
    FROM walks w JOIN arcs a ON a.src = w.node WHERE NOT list_contains(nodes, dst)"""
_BACKWARD = """
    SELECT n AS source, n AS node, 0e0 AS cost, [n] AS nodes, CAST([] AS VARCHAR[]) AS edge_ids FROM (VALUES ('0'), ('24')) v(n)
    UNION ALL SELECT source, src, w.cost + a.cost, list_prepend(src, nodes), list_prepend(edge_id, edge_ids)
    FROM walks w JOIN arcs a ON a.dst = w.node WHERE NOT list_contains(nodes, src)"""
_BEST = "SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY cost, len(nodes), nodes) AS rn FROM walks"


def routes(t):
    return graph.cheapest_routes(costs(t), t.exits.select(F.col("exit_id").alias("node")))


@query("shortest_paths", "G02 G05", """
    SELECT source, node, round(cost, 6) AS cost, CAST(len(nodes) - 1 AS INT) AS hops, array_to_string(nodes, '>') AS route FROM best WHERE rn = 1""",
       recursive=True, views={"walks": _WALKS, "best": _BEST})
def _(t):
    return rounded(routes(t).select("source", "node", "cost", "hops", F.array_join("nodes", ">").alias("route")), 6)


@query("route_zone_paths", "G03 J06", """
    SELECT source, node, array_to_string(list_transform(edge_ids, lambda e: 'Z' || split_part(e, '-', 1)), '>') AS zones FROM best WHERE rn = 1""",
       recursive=True, views={"walks": _WALKS, "best": _BEST})
def _(t):
    return graph.with_zone_path(routes(t), t.edges).select("source", "node", F.array_join("zone_path", ">").alias("zones"))


_EXIT = """SELECT node, source AS exit_id, cost, nodes, row_number() OVER (PARTITION BY node ORDER BY cost, CASE source WHEN '0' THEN 0 ELSE 1 END) AS r
           FROM best WHERE rn = 1"""


@query("best_exit", "G07 G08 J12 F02", "SELECT node, exit_id, round(cost, 6) AS cost, array_to_string(nodes, '>') AS route FROM exit_of WHERE r = 1",
       recursive=True, views={"walks": _BACKWARD, "best": _BEST, "exit_of": _EXIT})
def _(t):
    return rounded(graph.best_exit(costs(t), t.exits).select("node", "exit_id", "cost", F.array_join("nodes", ">").alias("route")), 6)


@query("low_risk_path", "G04 G05 J08", """
    SELECT r.source, r.node, round(cost, 6) AS cost, coalesce(array_to_string(nodes, '>'), '') AS route
    FROM (SELECT 'AZ1' AS source, zone_id AS node FROM zone_avg UNION ALL SELECT 'AZ1', 'AZ9') r
    LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON b.source = r.source AND b.node = r.node""", recursive=True, views={
        "touching": """SELECT a.zone_id AS src, b.zone_id AS dst, sqrt(((a.zx0 + a.zx1 - b.zx0 - b.zx1) / 2e0) ** 2 + ((a.zy0 + a.zy1 - b.zy0 - b.zy1) / 2e0) ** 2) AS base
            FROM zones a JOIN zones b ON a.zone_id <> b.zone_id AND (
                ((a.zx1 = b.zx0 OR b.zx1 = a.zx0) AND least(a.zy1, b.zy1) > greatest(a.zy0, b.zy0))
                OR ((a.zy1 = b.zy0 OR b.zy1 = a.zy0) AND least(a.zx1, b.zx1) > greatest(a.zx0, b.zx0)))""",
        "condition": "SELECT zone_id, least(1e0, 2 * avg(risk)) AS risk, avg(density) AS density FROM fused GROUP BY zone_id",
        "hops": """SELECT src, dst, base * (1 + 3e0 * 0.5e0 * (a.risk + b.risk) + 1.5e0 * 0.5e0 * (a.density + b.density))
                   + CASE WHEN b.risk >= 0.92e0 THEN 1000 * base ELSE 0e0 END AS cost FROM touching JOIN condition a ON a.zone_id = src JOIN condition b ON b.zone_id = dst""",
        "walks": """SELECT 'AZ1' AS source, 'AZ1' AS node, 0e0 AS cost, ['AZ1'] AS nodes
            UNION ALL SELECT source, dst, w.cost + h.cost, list_append(nodes, dst) FROM walks w JOIN hops h ON h.src = w.node WHERE NOT list_contains(nodes, dst)""",
        "best": _BEST})
def _(t):
    from ..operators import risk as R
    state = R.fuse(t.perception).groupBy("zone_id").agg(F.least(F.lit(1.0), 2 * F.avg("risk")).alias("risk"), F.avg("density").alias("density"))
    arcs = graph.zone_graph_costs(Z.zone_adjacency(Z.default_zones(t.spark)), state)
    start = t.spark.createDataFrame([("AZ1",)], "node string")
    wanted = t.perception.select(F.lit("AZ1").alias("source"), F.col("zone_id").alias("node")).distinct() \
        .unionByName(t.spark.createDataFrame([("AZ1", "AZ9")], "source string, node string"))
    found = graph.requested_routes(graph.cheapest_routes(arcs, start), wanted)
    return rounded(found.select("source", "node", "cost", F.array_join("nodes", ">").alias("route")), 6)


@query("path_costs", "F03 G04", """
    SELECT src, dst, round(base * (2e0 - least(1e0, b.density)) + CASE WHEN a.risk > b.risk THEN 5e0 ELSE 0e0 END, 6) AS cost FROM touching JOIN condition a ON a.zone_id = src JOIN condition b ON b.zone_id = dst""", views={
        "touching": """SELECT a.zone_id AS src, b.zone_id AS dst, sqrt(((a.zx0 + a.zx1 - b.zx0 - b.zx1) / 2e0) ** 2 + ((a.zy0 + a.zy1 - b.zy0 - b.zy1) / 2e0) ** 2) AS base
            FROM zones a JOIN zones b ON a.zone_id <> b.zone_id AND (
                ((a.zx1 = b.zx0 OR b.zx1 = a.zx0) AND least(a.zy1, b.zy1) > greatest(a.zy0, b.zy0))
                OR ((a.zy1 = b.zy0 OR b.zy1 = a.zy0) AND least(a.zx1, b.zx1) > greatest(a.zx0, b.zx0)))""",
        "condition": "SELECT zone_id, least(1e0, 2 * avg(risk)) AS risk, avg(density) AS density FROM fused GROUP BY zone_id"})
def _(t):
    """Zone graph under a cost function of the caller's own: crowded targets are cheap, steps to less risk cost extra."""
    from ..operators import risk as R
    state = R.fuse(t.perception).groupBy("zone_id").agg(F.least(F.lit(1.0), 2 * F.avg("risk")).alias("risk"), F.avg("density").alias("density"))
    own = lambda base, risk_from, risk_to, _, density_to: base * (2 - density_to) + F.when(risk_from > risk_to, 5.0).otherwise(0.0)
    arcs = graph.zone_graph_costs(Z.zone_adjacency(Z.default_zones(t.spark)), state, own)
    return rounded(arcs.select("src", "dst", "cost"), 6)


def user_routes(t):
    """One active route of eight zones per user seen in the events."""
    u = F.col("user_id")
    return t.read("events").select("user_id").distinct().select(
        u, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("Z"), ((u * 3 + i * i) % 25).cast("string"))).alias("zone_path"),
        (u % 25).cast("string").alias("current_node"), ((u * 7) % 25).cast("string").alias("destination"), (u % 5 * 1000).alias("last_reroute_ms"))


def doubled_risk(t):
    return zone_risk(t).withColumn("risk", F.least(F.lit(1.0), F.col("risk") * 2))


def incident_zones(t):
    return I.local_deltas(t.incidents).filter("incidents % 3 = 0").select("zone_id")


_ROUTE_VIEWS = {
    "user_routes": """SELECT user_id, list_transform(range(8), lambda i: 'Z' || ((user_id * 3 + i * i) % 25)) AS zone_path FROM (SELECT DISTINCT user_id FROM events)""",
    "ahead": """SELECT user_id, pos, z.zone_id, least(1e0, 2 * risk) AS risk, d.incidents % 3 = 0 AS incident, load_ratio
        FROM (SELECT user_id, unnest(range(6)) AS pos, unnest(zone_path[1:6]) AS zone_id FROM user_routes) z
        LEFT JOIN zone_risk USING (zone_id) LEFT JOIN deltas d USING (zone_id) LEFT JOIN zone_load USING (zone_id)""",
    "assessed": """SELECT user_id, max(risk) AS max_risk, bool_or(coalesce(incident, false)) AS has_incident, bool_or(risk >= 0.75e0) AS enters_high_risk,
        bool_or(coalesce(load_ratio, 1e0) >= 1.15e0) AS congestion,
        string_agg(repeat(zone_id || ' ', CAST(coalesce(incident, false) AS INT) + CAST(risk >= 0.75e0 AS INT) + CAST(coalesce(load_ratio, 1e0) >= 1.15e0 AS INT)), '' ORDER BY pos) AS bad
        FROM ahead GROUP BY user_id"""}


@query("route_assessment", "A29 J21 F01", """
    SELECT user_id, round(max_risk, 9) AS max_risk, has_incident, enters_high_risk, congestion, trim(bad) AS violating FROM assessed""", views=_ROUTE_VIEWS)
def _(t):
    a = D.assess_routes(user_routes(t), doubled_risk(t), incident_zones(t), zone_load(t))
    return rounded(a.select("user_id", "max_risk", "has_incident", "enters_high_risk", "congestion", F.array_join("violating_zones", " ").alias("violating")))


@query("reroute_decision", "W27", """
    SELECT user_id, reason, CASE WHEN reason IS NULL THEN 'NOOP' ELSE 'REROUTE' END AS action FROM (
        SELECT user_id, CASE WHEN 4000 - user_id % 5 * 1000 < 3000 THEN NULL WHEN has_incident THEN 'ROUTE_BLOCKED_BY_INCIDENT'
            WHEN enters_high_risk THEN 'ROUTE_ENTERING_HIGH_RISK' WHEN congestion THEN 'CONGESTION_OVER_CAPACITY' END AS reason FROM assessed)""", views=_ROUTE_VIEWS)
def _(t):
    a = D.assess_routes(user_routes(t), doubled_risk(t), incident_zones(t), zone_load(t))
    a = a.withColumn("last_reroute_ms", F.col("user_id") % 5 * 1000)
    return D.decide(a, "alert", F.lit(4000), F.col("last_reroute_ms")).select("user_id", "reason", "action")


@query("decision_loop", "X09 T07 P31 G07", """
    SELECT user_id, reason, exit_id AS target, round(cost, 6) AS cost, array_to_string(nodes, '>') AS route,
           CASE reason WHEN 'ROUTE_BLOCKED_BY_INCIDENT' THEN 'An incident was detected ahead. You are being redirected.'
                ELSE 'Please proceed immediately to Exit ' || exit_id || '.' END AS message FROM (
        SELECT user_id, CASE WHEN has_incident THEN 'ROUTE_BLOCKED_BY_INCIDENT' ELSE 'GLOBAL_MODE_ESCALATION' END AS reason FROM assessed)
    JOIN exit_of ON node = CAST(user_id % 25 AS VARCHAR) AND r = 1""", recursive=True, views={**_ROUTE_VIEWS, "walks": _BACKWARD, "best": _BEST, "exit_of": _EXIT})
def _(t):
    users = user_routes(t)
    decided = D.decide(D.assess_routes(users, doubled_risk(t), incident_zones(t), zone_load(t)), "evacuation", F.lit(10 ** 6), F.lit(0))
    exits = graph.best_exit(costs(t), t.exits)
    sent = D.targets(decided.join(users.select("user_id", "current_node", "destination"), "user_id"), exits, "evacuation")
    told = D.guidance(sent).join(exits.select(F.col("node").alias("current_node"), "cost", F.array_join("nodes", ">").alias("route")), "current_node")
    return rounded(told.select("user_id", "reason", "target", "cost", "route", "message"), 6)


@query("reroute_cooldown", "W27 F04", """, fold AS (
    SELECT zone_id, rn, arrival, reason, CASE WHEN reason IS NOT NULL THEN ts END AS last, reason IS NOT NULL AS granted FROM ordered WHERE rn = 1
    UNION ALL SELECT zone_id, rn, arrival, reason, CASE WHEN ok THEN ts ELSE last END, ok FROM (
        SELECT o.*, f.last, o.reason IS NOT NULL AND (f.last IS NULL OR o.ts - f.last >= 3000) AS ok
        FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1))
    SELECT arrival, CASE WHEN granted THEN reason END AS reason, CASE WHEN granted THEN 'REROUTE' ELSE 'NOOP' END AS action FROM fold""", recursive=True, views={"ordered": """
        SELECT zone_id, arrival, ts, CASE WHEN density >= 0.9e0 THEN 'ROUTE_BLOCKED_BY_INCIDENT' WHEN anomaly >= 0.8e0 THEN 'ROUTE_ENTERING_HIGH_RISK'
            WHEN anomaly < 0.2e0 THEN 'CONGESTION_OVER_CAPACITY' END AS reason, row_number() OVER (PARTITION BY zone_id ORDER BY ts, arrival) AS rn FROM perception"""})
def _(t):
    history = t.perception.select("arrival", "ts", "zone_id", (F.col("density") >= 0.9).alias("has_incident"),
                                  (F.col("anomaly") >= 0.8).alias("enters_high_risk"), (F.col("anomaly") < 0.2).alias("congestion"))
    return D.decide_over_time(history, "normal", "zone_id").select("arrival", "reason", "action")


@query("guidance", "P31 T14", """
    SELECT reason, n, CASE reason WHEN 'ROUTE_ENTERING_HIGH_RISK' THEN 'High Risk Ahead' ELSE 'Congestion Detected' END AS title,
           CASE reason WHEN 'ROUTE_ENTERING_HIGH_RISK' THEN 'high' ELSE 'medium' END AS guidance_severity,
           CASE reason WHEN 'ROUTE_ENTERING_HIGH_RISK' THEN 'alert' END AS client_mode FROM (
        SELECT CASE WHEN anomaly >= 0.8e0 THEN 'ROUTE_ENTERING_HIGH_RISK' ELSE 'CONGESTION_OVER_CAPACITY' END AS reason, count(*) AS n
        FROM perception WHERE anomaly >= 0.8e0 OR anomaly < 0.2e0 GROUP BY 1)""")
def _(t):
    from ..operators.risk import client_mode
    rows = t.perception.select(F.when(F.col("anomaly") >= 0.8, "ROUTE_ENTERING_HIGH_RISK").when(F.col("anomaly") < 0.2, "CONGESTION_OVER_CAPACITY").alias("reason"),
                               F.lit(None).cast("string").alias("target"))
    told = D.guidance(rows).withColumn("client_mode", client_mode(F.col("guidance_severity")))
    return told.groupBy("reason", "title", "guidance_severity", "client_mode").agg(F.count(F.lit(1)).alias("n"))


@query("emergency_route", "X10 O02 A04", """
    SELECT node, exit_id, round(cost, 6) AS cost FROM (
        SELECT node, source AS exit_id, cost, row_number() OVER (PARTITION BY node ORDER BY cost, CASE source WHEN '0' THEN 0 ELSE 1 END) AS r FROM walks) WHERE r = 1""",
       recursive=True, views={
           "worst": "SELECT min_by(zone_id, (-risk, CAST(substr(zone_id, 2) AS INT))) AS zone_id FROM zone_risk",
           "hazard": """SELECT edge_id, src, dst, one_way, length * 1.4e0 + 80 * risk + CASE WHEN e.zone_id = w.zone_id THEN 0.35e0 ELSE 0e0 END AS cost
                        FROM edges e JOIN zone_risk USING (zone_id), worst w""",
           "ways": "SELECT src, dst, cost FROM hazard UNION ALL SELECT dst, src, cost FROM hazard WHERE NOT one_way",
           "walks": """SELECT n AS source, n AS node, 0e0 AS cost, [n] AS nodes FROM (VALUES ('0'), ('24')) v(n)
               UNION ALL SELECT source, src, w.cost + a.cost, list_prepend(src, nodes) FROM walks w JOIN ways a ON a.dst = w.node WHERE NOT list_contains(nodes, src)"""})
def _(t):
    """Least-risk exit of every node once the riskiest zone carries an emergency incident."""
    from ..operators import risk as R
    risk = zone_risk(t)
    worst = R.most_risky_zone(risk.withColumn("zone_pos", F.substring("zone_id", 2, 9).cast("int")), "zone_id")
    incident = worst.select("zone_id", F.lit(K.EMERGENCY_PENALTY).alias("hazard_penalty"), F.array("zone_id").alias("affected_zone_ids"))
    arcs = graph.edge_costs(t.edges, risk, I.local_deltas(incident), mode="evacuation")
    return rounded(graph.best_exit(arcs, t.exits).select("node", "exit_id", "cost"), 6)


@query("supply_edges", "G01 U06", """
    SELECT src, dst, round(avg(q), 6) AS length, count(*) AS n FROM (
        SELECT l_suppkey AS src, lead(l_suppkey) OVER w AS dst, l_quantity AS q FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst""")
def _(t):
    return rounded(supply_edges(t).select("src", "dst", "length", "n"), 6)


def supply_edges(t, key="bigint"):
    """Larger graph: consecutive suppliers inside an order (an order has a handful of lines). ``key``: the type of src and dst."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = t.read("lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"), "l_quantity").filter("dst IS NOT NULL AND src <> dst")
    return rows.groupBy(F.col("src").cast(key).alias("src"), F.col("dst").cast(key).alias("dst")) \
        .agg(F.avg("l_quantity").alias("length"), F.count(F.lit(1)).alias("n"))


@query("supply_distances", "G02 G05", """, dist(source, node, cost) USING KEY (source, node) AS (
    SELECT node, node, 0e0 FROM starts
    UNION SELECT source, dst, min(c) FROM (
        SELECT d.source, e.dst, d.cost + e.length AS c, r.cost AS known FROM dist d JOIN supply e ON e.src = d.node
        LEFT JOIN recurring.dist r ON r.source = d.source AND r.node = e.dst) WHERE known IS NULL OR c < known GROUP BY source, dst)
    SELECT source, node, round(cost, 6) AS cost FROM dist""", recursive=True, views={
        "starts": "SELECT CAST(min(s_suppkey) AS VARCHAR) AS node FROM supplier GROUP BY s_nationkey",
        "supply": """SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, avg(q) AS length FROM (
            SELECT l_suppkey AS src, lead(l_suppkey) OVER w AS dst, l_quantity AS q FROM lineitem
            WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL"""})
def _(t):
    """Cheapest distance from each nation's first supplier to every supplier, over the larger graph."""
    # grouped by the texts the routes go by, so that their steps are not dealt out once more
    arcs = supply_edges(t, "string").select(F.concat_ws("-", "src", "dst").alias("edge_id"), "src", "dst", F.col("length").alias("cost"))
    starts = t.read("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("node")).select("node")
    return rounded(graph.cheapest_routes(arcs, starts).select("source", "node", "cost"), 6)
