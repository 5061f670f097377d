"""Small fixtures worked out by hand, and brute force on random input."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from throngcast import constants as K
from throngcast.config import AltRiskConfig, ForestConfig, PolicyConfig, RiskStateConfig, RoiDensityConfig
from throngcast.functions import geometry as G, scalars as S
from throngcast.operators import cameras, decision, fusion, graph, incidents, metrics, ml, motion, presence, risk, sampling, spatial, zones


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first().out


def test_fusion_and_clamp_edges(spark):
    fuse = S.fused_risk(F.col("d"), F.col("a"), F.col("c"))
    assert one(spark, fuse, d=.82, a=.26, c=.88) == pytest.approx((.6 * .82 + .4 * .26) * .88)
    assert one(spark, fuse, d=.5, a=.5, c=float("nan")) == 0
    assert one(spark, S.fused_risk(F.col("d"), F.col("a"), F.lit(None).cast("double")), d=.5, a=.5) == 0
    assert one(spark, fuse, d=9.0, a=.5, c=2.0) == 1
    assert one(spark, S.clamp(F.col("x")), x=float("nan")) == 0
    assert math.isnan(one(spark, S.clamp(F.col("x"), nan="keep"), x=float("nan")))
    assert one(spark, S.severity_band(F.col("x")), x=.8) == "critical"
    assert one(spark, S.trend_class(F.col("x")), x=.05) == "flat"


@pytest.mark.parametrize("value", [0.8578125, 0.1000005, 0.5000015, 2.5000005, 103.8318005, -0.0000005, 0.1234565, 1e-7])
def test_six_decimals_like_printf(spark, value):
    assert one(spark, S.fixed6(F.col("x")), x=value).lstrip("-") == f"{abs(value):.6f}"


def test_rounding_families(spark):
    assert [one(spark, S.round_half_up(F.col("x")), x=v) for v in (-2.5, 2.5)] == [-2, 3]
    assert [one(spark, S.round_half_even(F.col("x")), x=v) for v in (105.5, 106.5)] == [106, 106]


def test_file_stem(spark):
    stem = lambda text: one(spark, S.file_stem(F.col("t"), F.lit("7")), t=text)
    assert stem("2024-05-01T08:09:10+08:00") == "20240501_080910_7"
    assert stem("2024-05-01T08:09Z") == "20240501_080900_7"
    assert stem("1-2:3Tx") == "123_x_7"


def test_class_risk(spark):
    probs = lambda p: one(spark, S.expected_class_risk(F.col("p")), p=F.lit(0))
    df = spark.createDataFrame([([],), ([1.0],), ([0.0] * 11 + [1.0],), (None,)], "p array<double>")
    got = [r.out for r in df.select(S.expected_class_risk(F.col("p")).alias("out")).collect()]
    assert got == pytest.approx([.5, .2, .5, .5])
    assert one(spark, S.first_argmax(F.array(F.lit(.4), F.lit(.4), F.lit(.2)))) == 0


def test_data_url(spark):
    assert one(spark, S.data_url_bytes(F.col("t")), t="data:image/png;base64,aGk=") == b"hi"
    assert one(spark, S.data_url_bytes(F.col("t")), t="data:x;base64,***") is None


def inside(px, py, poly):
    odd = False
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
        cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
        if cross == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return True
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("poly", [[(0, 0), (8, 2), (6, 9), (3, 4), (1, 9)], [(0, 0), (8, 0), (8, 6), (0, 6)], [(0, 0), (8, 6), (8, 0), (0, 6)]])
def test_point_in_polygon(spark, poly):
    points = spark.createDataFrame([(float(x), float(y)) for x in range(-1, 10) for y in range(-1, 10)], "x double, y double")
    column = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in poly])
    got = points.select("x", "y", G.in_polygon(F.col("x"), F.col("y"), poly).alias("a"), G.in_polygon_column(F.col("x"), F.col("y"), column).alias("b")).collect()
    for r in got:
        assert r.a == r.b == inside(r.x, r.y, poly), r


def test_grid_location_equals_literal_location(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.uniform(-9, 330), rng.uniform(-9, 250)) for i in range(400)], "point_id int, x double, y double")
    by_grid = {r.point_id: r.zone_id for r in zones.locate_in_grid(points, zones.default_zones(spark), 50.0).collect()}
    boxed = points.withColumn("bbox", F.array("x", "y", "x", "y"))
    assert by_grid == {r.point_id: r.zone_id for r in zones.with_zone(boxed).collect()}


def test_incident_deltas(spark):
    rows = [("i1", "Z1", None, None, False), ("i2", "Z1", 5000.0, ["Z2", "Z3"], False), ("i3", "Z9", 4999.0, ["Z2"], False),
            ("i4", "Z4", 7.0, [], False), ("i5", "Z5", .35, None, True)]
    d = spark.createDataFrame(rows, "incident_id string, zone_id string, hazard_penalty double, affected_zone_ids array<string>, is_blocking boolean")
    got = {r.zone_id: (r.local_delta, r.blocked) for r in incidents.with_blocked(incidents.local_deltas(d)).collect()}
    assert got == {"Z1": (40.0, False), "Z2": (9999.0, True), "Z3": (5000.0, False), "Z5": (.35, False)}
    strict = {r.zone_id: r.local_delta for r in incidents.local_deltas(d, honor_is_blocking=True).collect()}
    assert strict["Z5"] == 9999.0


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "edge_id string, src string, dst string, length double, zone_id string, one_way boolean")


def test_edge_costs_and_detour(spark):
    edges = edge_table(spark, [("ab", "A", "B", 10.0, "Z1", False), ("bc", "B", "C", 10.0, "Z2", True), ("ac", "A", "C", 50.0, None, False)])
    table = lambda column, rows: spark.createDataFrame(rows, f"zone_id string, {column} double")
    costs = {(r.src, r.dst): r.cost for r in graph.edge_costs(edges, table("risk", [("Z1", .5)]), table("local_delta", [("Z2", -500.0)]),
                                                              table("load_ratio", [("Z1", 1.5)]), "evacuation").collect()}
    assert costs == {("A", "B"): 10 * 1.4 * 2 + 40, ("B", "A"): 10 * 1.4 * 2 + 40, ("B", "C"): 0.0, ("A", "C"): 70.0, ("C", "A"): 70.0}
    start = spark.createDataFrame([("A",)], "node string")
    free = graph.edge_costs(edges)
    best = {r.node: (r.cost, r.nodes, r.edge_ids) for r in graph.cheapest_routes(free, start).collect()}
    assert best["C"] == (20.0, ["A", "B", "C"], ["ab", "bc"]) and best["A"] == (0.0, ["A"], [])
    shut = graph.edge_costs(edges, deltas=table("local_delta", [("Z2", 9999.0)]))
    routes = graph.cheapest_routes(shut, start)
    assert {r.node: r.cost for r in routes.collect()}["C"] == 50.0
    asked = spark.createDataFrame([("A", "C"), ("A", "nowhere"), ("A", "A")], "source string, node string")
    found = {r.node: (r.cost, r.nodes) for r in graph.requested_routes(routes, asked).collect()}
    assert found["nowhere"] == (None, []) and found["A"] == (0.0, ["A"])
    path = graph.with_zone_path(graph.cheapest_routes(free, start), edges).filter("node = 'C'").first()
    assert path.zone_path == ["Z1", "Z2"]


def test_routes_equal_brute_force(spark):
    rng = random.Random(11)
    nodes = "ABCDEFG"
    rows = [(f"{a}{b}", a, b, float(rng.randint(1, 6)), "Z", rng.random() < .4) for a, b in itertools.combinations(nodes, 2) if rng.random() < .5]
    arcs = graph.edge_costs(edge_table(spark, rows))
    cost = {(r.src, r.dst): r.cost for r in arcs.collect()}
    got = {(r.source, r.node): (r.cost, r.hops, r.nodes) for r in graph.cheapest_routes(arcs, spark.createDataFrame([("A",), ("D",)], "node string")).collect()}
    back = {(r.source, r.node): r.cost for r in graph.cheapest_routes(arcs, spark.createDataFrame([("A",)], "node string"), reverse=True).collect()}

    def best(a, b):
        ways = []
        for n in range(len(nodes)):
            for mid in itertools.permutations([x for x in nodes if x not in (a, b)], n):
                way = [a, *mid, b] if a != b else [a]
                if all(step in cost for step in zip(way, way[1:])):
                    ways.append((sum(cost[s] for s in zip(way, way[1:])), len(way) - 1, way))
                if a == b:
                    break
        return min(ways) if ways else None
    for a, b in itertools.product("AD", nodes):
        assert got.get((a, b)) == best(a, b)
    for b in nodes:
        assert back.get(("A", b)) == (best(b, "A") or [None])[0]


def test_equal_exits_take_the_first_listed(spark):
    edges = edge_table(spark, [("mx", "M", "X", 5.0, "Z", False), ("my", "M", "Y", 5.0, "Z", False)])
    exits = spark.createDataFrame([("Y", 0), ("X", 1)], "exit_id string, exit_ord int")
    assert {r.node: r.exit_id for r in graph.best_exit(graph.edge_costs(edges), exits).collect()}["M"] == "Y"


def test_route_assessment_and_decision(spark):
    users = spark.createDataFrame([("u", [f"Z{i}" for i in range(8)], "N", "D", 0), ("none", None, "N", "D", 0)],
                                  "user_id string, zone_path array<string>, current_node string, destination string, last_reroute_ms long")
    table = lambda column, rows: spark.createDataFrame(rows, f"zone_id string, {column} double")
    hit = spark.createDataFrame([("Z6",)], "zone_id string")
    a = decision.assess_routes(users, table("risk", [("Z5", .75), ("Z1", .2)]), hit, table("load_ratio", [("Z5", 1.15)]))
    r = a.collect()[0]
    assert a.count() == 1 and r.violating_zones == ["Z5", "Z5"] and not r.has_incident and r.max_risk == .75
    at = lambda now, mode="normal": decision.decide(a, mode, F.lit(now), F.lit(0)).first()
    assert at(2999).action == "NOOP" and at(3000).reason == "ROUTE_ENTERING_HIGH_RISK" and at(3000, "evacuation").reason == "GLOBAL_MODE_ESCALATION"
    told = decision.guidance(spark.createDataFrame([("GLOBAL_MODE_ESCALATION", "E1"), ("other", "E2")], "reason string, target string"))
    assert sorted(r.message for r in told.collect()) == ["Please proceed immediately to Exit E1.", "Your route has been updated."]


def test_advisories(spark):
    rows = [("Z1", "critical", "rising", .15), ("Z2", "critical", "rising", .149), ("Z3", "warn", "rising", .10), ("Z4", "info", "rising", .06)]
    states = spark.createDataFrame(rows, "zone_id string, severity string, trend string, slope_per_sec double")
    context = spark.createDataFrame([("Z1", "Gate", True, False)], "zone_id string, label string, is_entry boolean, is_exit boolean")
    got = {r.zone_id: r for r in risk.advisories(states, context).collect()}
    assert [got[z].action for z in ("Z1", "Z2", "Z3", "Z4")] == ["DISPERSE", "DIVERT", "PREPARE_DIVERT", "MONITOR"]
    assert got["Z1"].directives.close_entries == ["Z1"] and got["Z1"].directives.open_exits is None and got["Z3"].directives is None
    assert got["Z2"].message_short == "Critical risk in Zone Z2. Rerouting to safer paths." and got["Z4"].message_long is None


def brute_spacing(points):
    out = {}
    for i, p in enumerate(points):
        d = min((math.dist(p, q) for j, q in enumerate(points) if j != i), default=0)
        if d > 0:
            out[p] = d
    return out


def test_nearest_spacing(spark):
    rng = random.Random(9)
    points = [(round(rng.gauss(50, 2), 3), round(rng.gauss(50, 2), 3)) for _ in range(120)] + [(900.0, 900.0), (5.0, 5.0), (5.0, 5.0), (400.0, 20.0)]
    df = spark.createDataFrame([(1, *p) for p in points] + [(2, 1.0, 1.0)], "frame_id int, x double, y double")
    got = {(r.x, r.y): r.spacing for r in spatial.nearest_spacing(df).collect()}
    want = brute_spacing(points)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_roi_density_sources_and_smoothing(spark):
    box = lambda frame, label, x, h: (1, frame, label, [x, 50.0, x + 10, 50.0 + h])
    rows = [box(1, "person", 60.0 + i, 100.0 + i) for i in range(3)] + [box(1, "head", 60.0, 20.0)] \
        + [box(2, "head", 60.0 + i, 20.0) for i in range(4)] + [box(3, "head", 60.0, 20.0)] + [box(4, "head", 60.0 + 20 * i, 0.0) for i in range(4)]
    d = spark.createDataFrame(rows, "camera int, frame_id int, label string, bbox array<double>")
    cfg = RoiDensityConfig(roi=((0, 0), (300, 0), (300, 200), (0, 200)))
    got = {r.frame_id: r for r in spatial.roi_density(d, cfg).collect()}
    s1 = 101 / 1.7
    s2 = .2 * 140 / 1.7 + .8 * s1
    s4 = .2 * 56 / 1.7 + .8 * s2
    assert got[1].scale == pytest.approx(s1) and got[2].scale == pytest.approx(s2) and got[3].scale == pytest.approx(s2)
    assert got[4].scale == pytest.approx(s4) and got[2].density == pytest.approx(4 / (60000 / s2 ** 2)) and got[3].h_samples == 1
    alone = spatial.roi_density(d.filter("frame_id = 3"), cfg).first()
    assert alone.level == "unknown" and alone.density == 0


def test_motion_features(spark):
    still = [(1, "A", .01 * i, 0.0, .1, .2) for i in range(30)]
    spread = [(1, "B", 3 * math.cos(math.pi / 8 + i * math.pi / 4), 3 * math.sin(math.pi / 8 + i * math.pi / 4), .5, .5) for i in range(64)]
    df = spark.createDataFrame(still + spread, "frame_id int, zone_id string, u double, v double, divergence double, turbulence double")
    moved = df.withColumns({"magnitude": F.round(F.hypot("u", "v"), 9), "direction": F.pmod(F.atan2("v", "u"), F.lit(2 * math.pi))})
    for limit in (None, 20):
        got = {r.zone_id: r for r in motion.motion_features(moved, rows_per_chunk=limit).collect()}
        assert got["A"].active_samples == 10 and got["A"].dir_entropy == 0 and got["B"].dir_entropy == pytest.approx(1) and got["B"].speed_var == pytest.approx(0)
    assert one(spark, motion.direction_bin(F.lit(2 * math.pi))) == 7


def test_robust_normalise_flat_and_weights(spark):
    rows = [(1, z, .0, .0, .0, .0) for z in "ab"] + [(2, z, .5, float(i), 1.0, .5) for i, z in enumerate("abc")]
    df = spark.createDataFrame(rows, "ts int, zone_id string, density double, speed_mean double, turbulence double, dir_entropy double")
    got = fusion.activity_weights(df).collect()
    assert [r.weight for r in got if r.ts == 1] == [.5, .5] and sum(r.weight for r in got if r.ts == 2) == pytest.approx(1)


def test_affine(spark):
    anchors = lambda rows: spark.createDataFrame(rows, "id string, x double, y double, lat double, lng double")
    plane = [(str(i), float(x), float(y), 1 + 2.0 * x - y, 100 + x + 3.0 * y) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (5, 7)])]
    fit = spatial.affine_fit(anchors(plane)).first()
    assert (fit.a_lat, fit.b_lat, fit.c_lat, fit.b_lng) == pytest.approx((2, -1, 1, 3))
    assert spatial.affine_fit(anchors(plane[:2])).first().a_lat is None
    assert spatial.affine_fit(anchors([(str(i), float(i), float(i), 1.0, 1.0) for i in range(4)])).first().a_lat is None


def test_presence_expiry_and_grid(spark):
    rows = [(1, "a", 1.3, 103.8, 1000, False), (2, "a", 1.3, 103.8, 500, False), (3, "b", 1.3, 103.8, 900, False), (4, "c", 1.3, 103.8, 999, False), (5, "c", None, None, 999, True)]
    latest = presence.latest_presence(spark.createDataFrame(rows, "arrival int, user_id string, lat double, lng double, ts_ms long, offline boolean"))
    assert {r.user_id: r.ts_ms for r in latest.collect()} == {"a": 500, "b": 900}        # last arrival, not newest time
    assert presence.not_expired(latest, 30900, 30000).count() == 1 and presence.not_expired(latest, 30901, 30000).count() == 0
    assert presence.presence_grid(latest).first().users == 2


def test_camera_asof_on_a_hot_camera(spark):
    rng = random.Random(2)
    inf = sorted({rng.randrange(10 ** 6) for _ in range(300)})
    snaps = [(i, "c", rng.randrange(10 ** 6)) for i in range(300)]
    got = cameras.asof_inference(spark.createDataFrame(snaps, "snapshot_id int, camera_id string, ts_ms long"),
                                 spark.createDataFrame([("c", t, t % 97) for t in inf], "camera_id string, inferred_ms long, vehicle_count long"), ttl_ms=5000, rows_per_chunk=50)
    want = {}
    for i, _, ts in snaps:
        before = [t for t in inf if t <= ts]
        want[i] = before[-1] % 97 if before and ts - before[-1] < 5000 else None
    assert {r.snapshot_id: r.vehicle_count for r in got.collect()} == want


def test_metric_staleness(spark):
    polls = spark.createDataFrame([("m", 0, None), ("m", 1, 5.0), ("m", 45001, 6.0), ("m", 45002, 7.0), ("m", 99999, None)], "metric string, ts_ms long, value double")
    got = cameras.metric_with_staleness(polls, ["metric"]).orderBy("ts_ms").collect()
    assert [(r.last_value, r.source) for r in got] == [(None, "unavailable"), (5.0, "live"), (5.0, "cache"), (7.0, "live"), (7.0, "cache")]


def test_capped_sample(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"))
    one_ = sampling.capped_sample(rows, ["k"], ["id"], 90, 7)
    n = {r.k: r.n for r in one_.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = {r.k: r.n for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {k: min(90, v) for k, v in full.items()}
    again = sampling.capped_sample(rows.repartition(3), ["k"], ["id"], 90, 7)
    assert sorted(r.id for r in one_.collect()) == sorted(r.id for r in again.collect())
    assert sampling.capped_sample(rows, [], ["id"], 123).count() == 123


def test_top_tenth_rounds_half_even(spark):
    bag = spark.createDataFrame([("v", i, float(i)) for i in range(25)] + [("w", 0, .5)], "video string, clip_idx int, score double")
    got = {r.video: r for r in metrics.bag_stats(bag).collect()}
    assert got["v"].topk_mean == 23.5 and got["w"].topk_mean == .5 and got["w"].smoothness == 0 and got["v"].smoothness == 1


def test_forest_ranks_outliers(spark):
    rng = np.random.default_rng(1)
    data = np.vstack([rng.normal(size=(600, 3)), rng.normal(8, .3, size=(12, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id int, a double, b double, c double")
    scaler = ml.robust_scaler(df, ["a", "b", "c"])
    forest = ml.fit_forest(df, ["id"], scaler, ForestConfig(trees=60))
    low = ml.score_forest(df, forest, scaler).orderBy("raw").limit(12).collect()
    assert {r.id for r in low} == set(range(600, 612))
    assert forest.groupBy("tree").count().count() == 60
    assert ml.robust_scaler(df.withColumn("k", F.lit(2.0)), ["k"]) == {"k": (2.0, 1.0)}


def test_crash_classifier_guard(spark):
    few = spark.createDataFrame([(1.0, 1), (2.0, 0)], "x double, label int")
    with pytest.raises(ValueError):
        ml.crash_classifier(few, ["x"])


@pytest.mark.parametrize("build", [lambda: RiskStateConfig(ema_alpha=0), lambda: RiskStateConfig(warn_down=.6), lambda: RiskStateConfig(critical_down=.9),
                                   lambda: ForestConfig(contamination=.6), lambda: RoiDensityConfig(roi=((0, 0), (1, 1), (2, 2)))])
def test_parameter_checks(build):
    with pytest.raises(ValueError):
        build()


def test_partial_configs_keep_defaults():
    assert PolicyConfig(rising_warn_slope=.2).penalty_critical == 3.0 and AltRiskConfig().critical_off == .68
    assert K.MODE_MULTIPLIER["alert"] == 1.15


def test_no_size_limits_on_zones_hotspots_and_routing_zones(spark):
    from throngcast.operators import presence, risk
    many = [(f"Z{i}", [(i * 10, 0), (i * 10 + 9, 0), (i * 10 + 9, 9), (i * 10, 9)]) for i in range(190)]
    boxes = spark.createDataFrame([(1, [i * 10.0, 0.0, i * 10.0 + 8, 8.0], 0.5, "person") for i in range(190)] + [(1, [5000.0, 0.0, 5008.0, 8.0], 0.5, "person"), (1, [1.0], 0.5, "person")],
                                  "frame_id long, bbox array<double>, conf double, label string")
    got = zones.detections_by_zone(boxes, zones=many, width=1920, height=1080).collect()
    assert sorted((r.zone_id, r.n) for r in got) == sorted((z, 1) for z, _ in many)
    table = zones.zone_table(spark, many).withColumn("capacity", F.lit(4.0))
    assert {r.activity for r in zones.label_counts(boxes, zones=table, width=1920, height=1080).collect()} == {0.25}
    few = zones.with_zone(boxes, zones=many[:3], width=1920, height=1080).where("zone_id is not null").count()
    assert few == zones.with_zone(boxes, zones=zones.zone_table(spark, many[:3]), width=1920, height=1080).where("zone_id is not null").count() == 3
    areas = spark.createDataFrame([("a", 1.3, 103.8), ("b", None, 103.8)], "area_name string, lat double, lng double")
    spots = spark.createDataFrame([(1.3 + i * 1e-4, 103.8, 0.001) for i in range(201)], "lat double, lng double, intensity double")
    whole, split = (sorted((r.area_name, round(r.score, 9)) for r in presence.area_scores(areas, spots, per_block=n).collect()) for n in (2000, 50))
    assert whole == split and whole[1] == ("b", 0.08)
    routing = spark.range(10_001).select(F.concat(F.lit("R"), "id").alias("routing_zone_id"), F.lit("A").alias("parent_id"))
    assert zones.every_pair(spark.range(3).withColumnRenamed("id", "frame_id"), routing).distinct().count() == 30_003


def grid(spark, side, seed, changes=()):
    """A square grid with costs from a hash, both ways; changes (src, dst, cost) replace edges, a NULL cost removes one."""
    n = spark.range(side * side).withColumn("x", F.col("id") % side)
    right = n.where(F.col("x") < side - 1).select("id", (F.col("id") + 1).alias("to"))
    down = n.where(F.col("id") < side * (side - 1)).select("id", (F.col("id") + side).alias("to"))
    both = right.unionAll(down)
    both = both.unionAll(both.select(F.col("to").alias("id"), F.col("id").alias("to")))
    edges = both.select(F.col("id").cast("string").alias("src"), F.col("to").cast("string").alias("dst"), (1 + F.pmod(F.xxhash64("id", "to", F.lit(seed)), F.lit(1000)) / 997.0).alias("cost"))
    if changes:
        new = spark.createDataFrame(changes, "src string, dst string, new double").withColumn("hit", F.lit(True))
        edges = edges.join(new, ["src", "dst"], "left").where("hit IS NULL OR new IS NOT NULL").withColumn("cost", F.coalesce("new", "cost")).drop("new", "hit")
    return edges.withColumn("edge_id", F.concat_ws("-", "src", "dst"))


def dijkstra(edges, exits):
    """node -> (cost, rank, hops, next node) of the cheapest exit."""
    import heapq
    back = {}
    for r in edges:
        back.setdefault(r.dst, []).append((r.src, r.cost))
    best, heap = {}, [(0.0, rank, 0, "", e) for e, rank in exits]
    heapq.heapify(heap)
    while heap:
        cost, rank, hops, parent, node = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (cost, rank, hops, parent or None)
        for src, c in back.get(node, []):
            heapq.heappush(heap, (cost + c, rank, hops + 1, node, src))
    return best


def test_repaired_ways_equal_a_full_run(spark):
    side, exits = 12, [("0", 0), ("143", 1)]
    doors = spark.createDataFrame(exits, "exit_id string, exit_ord int")
    changes = [("1", "0", None), ("0", "1", None), ("13", "1", 9.0), ("65", "66", 0.01), ("143", "142", 0.5), ("70", "71", 30.0), ("12", "0", 7.5)]
    before, after = grid(spark, side, 3), grid(spark, side, 3, changes)
    old = graph.exit_costs(before, doors)
    new, touched = graph.repaired_exit_costs(old, before, after, doors)
    want = dijkstra(after.collect(), exits)
    got = {r.node: (r.cost, r.rank, r.hops, r.parent) for r in new.collect()}
    assert got.keys() == want.keys() and all(got[n][1:] == w[1:] and got[n][0] == pytest.approx(w[0]) for n, w in want.items())
    assert {r.node: (r.cost, r.hops, r.parent) for r in graph.exit_costs(after, doors).collect()} == {n: (c, h, p) for n, (c, _, h, p) in got.items()}
    assert 0 < touched < side * side
    cut_off = graph.repaired_exit_costs(old, before, after.where("dst NOT IN ('0', '143')"), doors)
    assert {r.node for r in cut_off[0].collect()} == {"0", "143"} and cut_off[1] == side * side - 2
    same, none = graph.repaired_exit_costs(old, before, before, doors)
    assert none == 0 and same.count() == side * side


def test_ways_on_a_large_grid(spark):
    """100 000 nodes: entries stay small, and only the paths asked for are built."""
    edges = grid(spark, 317, 1).where("CAST(src AS INT) < 100000 AND CAST(dst AS INT) < 100000")
    lifts = spark.range(1, 100000).select(F.col("id").cast("string").alias("src"), F.floor(F.col("id") / 10).cast("string").alias("dst"),
                                          (1 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 991.0).alias("cost"), F.concat(F.lit("s"), F.col("id")).alias("edge_id"))
    edges = edges.unionByName(lifts)
    doors = spark.createDataFrame([("0", 0)], "exit_id string, exit_ord int")
    asked = spark.createDataFrame([("99999",), ("50000",)], "node string")
    ways = graph.exit_costs(edges, doors)
    assert ways.columns == ["node", "cost", "rank", "hops", "parent", "edge_id"] and ways.count() == 100000
    paths = {r.node: r for r in graph.exit_paths(ways, asked).collect()}
    cost = {r.edge_id: r.cost for r in edges.collect()}
    want = dijkstra(edges.collect(), [("0", 0)])
    for node, r in paths.items():
        assert r.exit_id == "0" and r.nodes[0] == node and len(r.nodes) == r.hops + 1 == want[node][2] + 1
        assert sum(cost[e] for e in r.edge_ids) == pytest.approx(r.cost) == want[node][0]


def test_equal_ways_go_by_their_first_difference(spark):
    """Forwards, nodes count from the source on: B before C decides, though the last step would choose otherwise."""
    rows = [("A", "B"), ("A", "C"), ("B", "Y"), ("C", "X"), ("X", "Z"), ("Y", "Z"), ("Z", "W")]
    edges = spark.createDataFrame([(s, d, 1.0, f"{s}{d}") for s, d in rows], "src string, dst string, cost double, edge_id string")
    start = spark.createDataFrame([("A",)], "node string")
    found = {r.node: (r.nodes, r.edge_ids) for r in graph.cheapest_routes(edges, start).collect()}
    assert found["W"] == (list("ABYZW"), ["AB", "BY", "YZ", "ZW"]) and found["X"] == (list("ACX"), ["AC", "CX"])
    back = {r.node: r.nodes for r in graph.cheapest_routes(edges, spark.createDataFrame([("W",)], "node string"), reverse=True).collect()}
    assert back["A"] == list("ABYZW") and back["C"] == list("CXZW")


def test_clip_classifier_fits_in_few_tasks(spark, monkeypatch):
    """A fit is hundreds of passes: its rows come in few partitions and classes are fitted side by side, with the same predictions as one after another."""
    rows = [(i, float(i % 3), [float(i % 3 == k) + (i * 7 % 11) / 50 for k in range(4)]) for i in range(300)]
    clips = spark.createDataFrame(rows, "clip_idx long, label double, embedding array<double>").repartition(64)
    given, fit = [], ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: (given.append((rows.rdd.getNumPartitions(), rows.count(), self.getStages()[1].getParallelism())), fit(self, rows))[1])
    side = {r.clip_idx: r.prediction for r in ml.classify_clips(ml.clip_classifier(clips), clips).collect()}
    monkeypatch.setattr(ml, "FITS", 1)
    one = {r.clip_idx: r.prediction for r in ml.classify_clips(ml.clip_classifier(clips), clips).collect()}
    assert [n for n, _, _ in given] == [min(64, spark.sparkContext.defaultParallelism)] * 2 and [p for _, _, p in given] == [4, 1] and given[0][1] == 300
    assert side == one == {i: label for i, label, _ in rows}
