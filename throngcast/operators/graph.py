"""Edge costs and cheapest routes on building graphs, for many starts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..session import cut_lineage, stored
from .zones import BROADCAST_ROWS, small_side


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed edges: every edge forwards, and backwards unless it is one-way."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.filter(~F.coalesce("one_way", F.lit(False))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select("src", "dst", *rest).unionByName(back)


def edge_costs(edges: DataFrame, zone_risk: DataFrame | None = None, deltas: DataFrame | None = None,
               load: DataFrame | None = None, mode: str = "normal") -> DataFrame:
    """Directed edges with their cost; blocked ones are left out.

    ``edges``: edge_id, src, dst, length, zone_id, one_way, optional blocked. Zone tables: zone_id plus
    risk / local_delta / load_ratio; a zone missing there counts as 0 / 0 / 1. Negative costs become 0.
    """
    rows = edges
    for table, column, default in ((zone_risk, "risk", 0.0), (deltas, "local_delta", 0.0), (load, "load_ratio", 1.0)):
        if table is None:
            rows = rows.withColumn(column, F.lit(default))
        else:
            rows = rows.join(small_side(table.select("zone_id", column)), "zone_id", "left") \
                .withColumn(column, F.coalesce(column, F.lit(default)))
    if "blocked" in edges.columns:
        rows = rows.filter(~F.coalesce("blocked", F.lit(False)))
    crowding = 1 + K.CONGESTION_SCALE * F.greatest(F.lit(0.0), F.col("load_ratio") - 1)
    cost = F.col("length") * K.MODE_MULTIPLIER.get(mode, 1.0) * crowding + K.RISK_PENALTY_SCALE * F.col("risk") \
        + F.col("local_delta")
    open_edges = rows.filter(F.col("local_delta") < K.BLOCKING_PENALTY)
    return both_ways(open_edges.withColumn("cost", F.greatest(F.lit(0.0), cost))) \
        .select("edge_id", "src", "dst", "zone_id", "length", "cost")


ROUNDS_PER_CHECKPOINT = 3
_ROUTE = ["cost", "rank", "hops", "parent", "edge_id", "fresh"]


def _steps(edges: DataFrame, reverse: bool) -> DataFrame:
    """The cheapest edge per direction: _here, _there, _cost, _edge. With ``reverse`` a step goes against its edge."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    least = F.min(F.struct("cost", F.col("edge_id").cast("string").alias("edge_id"))).alias("_step")
    return edges.groupBy(F.col(here).cast("string").alias("_here"), F.col(there).cast("string").alias("_there")).agg(least).select("_here", "_there", F.col("_step.cost").alias("_cost"), F.col("_step.edge_id").alias("_edge"))


def _relaxed(best: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """One round: what improved in the last one is extended by a step; the least entry per key stays."""
    own = F.struct("node", *[F.col(c) if c != "fresh" else F.lit(False).alias(c) for c in _ROUTE])
    longer = F.struct(F.col("_there").alias("node"), (F.col("cost") + F.col("_cost")).alias("cost"), "rank", (F.col("hops") + 1).alias("hops"),
                      F.col("node").alias("parent"), F.col("_edge").alias("edge_id"), F.lit(True).alias("fresh"))
    others = [k for k in keys if k != "node"]
    rows = best.join(steps, (F.col("node") == F.col("_here")) & F.col("fresh"), "left") \
        .select(*others, F.explode(F.filter(F.array(own, F.when(F.col("_there").isNotNull(), longer)), lambda r: r.isNotNull())).alias("r")).select(*others, "r.*")
    return rows.groupBy(*keys).agg(F.min(F.struct(*_ROUTE)).alias("r")).select(*keys, "r.*")


def _relax_all(steps: DataFrame, best: DataFrame, keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """Rounds until nothing improves. ``best``: keys (``node`` among them) and cost, rank (which settles equal costs), hops, the parent
    the entry came from, the edge between them, and fresh. Entries are as small after a thousand rounds as after one."""
    if steps.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _relax_few(steps, best, keys, max_rounds)
    steps, rounds = F.broadcast(steps), 0
    while max_rounds is None or rounds < max_rounds:
        for _ in range(ROUNDS_PER_CHECKPOINT if max_rounds is None else min(ROUNDS_PER_CHECKPOINT, max_rounds - rounds)):
            best = _relaxed(best, steps, keys)
            rounds += 1
        best = cut_lineage(best)
        if best.filter("fresh").isEmpty():
            break
    return best


def _relax_few(steps: DataFrame, best: DataFrame, keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """The rounds of _relax_all on a large graph: only what improved in the last round meets the steps.

    Cheap steps go first, as far as they lead. Most dear ones can then improve nothing, which the bounds of their two ends tell.
    """
    best = best.select(*keys, *_ROUTE, F.col("fresh").alias("due"))
    best = stored(best.groupBy(*keys).agg(F.min(F.struct(*_ROUTE, "due")).alias("r")).select(*keys, "r.*"), "ways")
    steps = steps.where("_there IS NOT NULL")
    cheap = _cheap(steps) if max_rounds is None else None
    if cheap is not None:
        light = stored(steps.where(F.col("_cost") <= cheap), "light")
        best = _few_rounds(light, best, keys).withColumn("fresh", F.col("due"))
    return _few_rounds(steps, best, keys, max_rounds).drop("due")


LIGHT_STEPS = 16


def _cheap(steps: DataFrame) -> float | None:
    """The cost up to which a node has some LIGHT_STEPS steps on average; None if it has no more anyway, or if costs are missing: what lies
    behind an empty cost depends on the order of rounds."""
    n, known, nodes = steps.agg(F.count(F.lit(1)), F.count("_cost"), F.approx_count_distinct("_here")).first()
    if known < n or n <= 2 * LIGHT_STEPS * nodes:
        return None
    return steps.agg(F.percentile_approx("_cost", LIGHT_STEPS * nodes / n, 1000)).first()[0]


def _few_rounds(steps: DataFrame, best: DataFrame, keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """Rounds until nothing improves: what is fresh meets the steps that can improve something. ``due`` stays true for all that ever was fresh.

    A step leads from an entry to a cost of at least the least one of its first node's fresh entries; where every group has an entry at the second
    node, more than the greatest cost there is no use. Empty costs come first in all comparisons, so they are always kept.
    """
    others, rounds, route = [k for k in keys if k != "node"], 0, [*_ROUTE, "due"]
    groups = best.select(*others).distinct().count() if others else 1
    while max_rounds is None or rounds < max_rounds:
        fresh = best.where("fresh")
        few = fresh.limit(BROADCAST_ROWS + 1).count()
        if not few:
            break
        low = fresh.groupBy(F.col("node").alias("_here")).agg(F.when(F.count("cost") == F.count(F.lit(1)), F.min("cost")).alias("_low"))
        high = best.groupBy(F.col("node").alias("_there")).agg(F.count(F.lit(1)).alias("_n"), F.max("cost").alias("_high")).where(F.col("_n") == groups).drop("_n")
        near = F.broadcast(fresh) if few <= BROADCAST_ROWS else fresh
        useful = lambda cost: F.coalesce(cost <= F.col("_high"), F.lit(True))
        open_steps = steps.join(small_side(low), "_here").join(small_side(high), "_there", "left").where(useful(F.col("_low") + F.col("_cost")))
        longer = open_steps.join(near, F.col("node") == F.col("_here")).where(useful(F.col("cost") + F.col("_cost"))).select(
            *others, F.col("_there").alias("_to"), (F.col("cost") + F.col("_cost")).alias("cost"), "rank", (F.col("hops") + 1).alias("hops"),
            F.col("node").alias("parent"), F.col("_edge").alias("edge_id"), F.lit(True).alias("fresh"), F.lit(True).alias("due")).withColumnRenamed("_to", "node")
        rows = best.withColumn("fresh", F.lit(False)).select(*keys, *route).unionByName(longer.select(*keys, *route))
        # not a checkpoint: that hands on what the optimizer knows of a plan, which doubles with every round
        best = stored(rows.groupBy(*keys).agg(F.min(F.struct(*route)).alias("r")).select(*keys, "r.*"), "ways")
        rounds += 1
    return best


def _roots(starts: DataFrame, keys: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    return starts.select(*keys, F.lit(0.0).alias("cost"), "rank", F.lit(0).alias("hops"), none.alias("parent"), none.alias("edge_id"), F.lit(True).alias("fresh"))


SOURCES_PER_ROW = 8


def _tight_steps(best: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps that cheapest routes may take, of many entries: source, node, hops, parent, edge_id.

    A row has the costs and hops of a node from a block of sources, so a step meets its two ends once per block, not once per source.
    """
    ends = small_side(best.groupBy("node").agg(F.min("cost").alias("_low"), F.max("cost").alias("_high")))
    near = steps.join(ends.select(F.col("node").alias("_here"), "_low"), "_here").join(ends.select(F.col("node").alias("_there"), "_high"), "_there") \
        .where("_low + _cost <= _high").select("_here", "_there", "_cost", "_edge")
    counted = best.select("source").distinct().repartitionByRange("source").sortWithinPartitions("source").rdd.map(lambda r: r[0]).zipWithIndex()
    number = small_side(best.sparkSession.createDataFrame(counted.map(lambda r: (r[0], r[1] // SOURCES_PER_ROW, r[1] % SOURCES_PER_ROW)), "source string, _block long, _at long"))
    at = lambda name, i: F.max(F.when(F.col("_at") == i, F.col(name)))
    places = range(SOURCES_PER_ROW)
    table = cut_lineage(best.join(number, "source").groupBy("node", "_block").agg(*[at("cost", i).alias(f"c{i}") for i in places], *[at("hops", i).alias(f"h{i}") for i in places]))
    here = table.select(F.col("node").alias("_here"), "_block", *[F.col(f"{x}{i}").alias(f"_{x}{i}") for x in "ch" for i in places])
    there = table.withColumnRenamed("node", "_there")
    fits = lambda i: (F.col(f"_c{i}") + F.col("_cost") == F.col(f"c{i}")) & (F.col(f"_h{i}") + 1 == F.col(f"h{i}"))
    found = F.filter(F.array(*[F.when(fits(i), F.struct(F.lit(i).cast("long").alias("_at"), F.col(f"h{i}").alias("hops"))) for i in places]), lambda x: x.isNotNull())
    tight = near.join(here, "_here").join(there, ["_there", "_block"]).select("_here", "_there", "_edge", "_block", F.inline(found))
    return tight.join(number, ["_block", "_at"]).select("source", F.col("_there").alias("node"), "hops", F.col("_here").alias("parent"), F.col("_edge").alias("edge_id"))


def _settle_ties(best: DataFrame, steps: DataFrame, first_level: int = 1) -> DataFrame:
    """Of routes of equal cost and hops the one whose nodes, read from the source, come first.

    Parents that differ are compared by their own routes: nodes of one depth get numbers in the order of their routes. Only the depths between
    the first and the last tie are gone through, and none when nothing is tied, as costs that are not round numbers have it.
    """
    if best.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        ways = _tight_steps(best, steps)
    else:
        few = F.broadcast(best)
        known = few.select("source", F.col("node").alias("_here"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
        ways = few.where("hops > 0").select("source", "node", "cost", "hops").join(steps, F.col("node") == F.col("_there")).join(known, ["source", "_here"]) \
            .where((F.col("_c") + F.col("_cost") == F.col("cost")) & (F.col("_h") + 1 == F.col("hops"))).select("source", "node", "hops", F.col("_here").alias("parent"), F.col("_edge").alias("edge_id"))
    ways = cut_lineage(ways)
    tied = ways.groupBy("source", "node", "hops").count().where("count > 1").agg(F.max("hops")).first()[0]
    if tied is None:
        return best
    order = best.where("hops = 0").select("source", "node", F.lit(0).cast("long").alias("_at"))
    chosen = None
    for level in range(first_level, tied + 1):
        here = ways.where(F.col("hops") == level).join(order.withColumnRenamed("node", "parent"), ["source", "parent"])
        least = here.groupBy("source", "node").agg(F.min(F.struct("_at", "parent", "edge_id")).alias("w")).select("source", "node", "w.*")
        numbered = cut_lineage(least.repartitionByRange("source", "_at", "node").sortWithinPartitions("source", "_at", "node").withColumn("_no", F.monotonically_increasing_id()))
        order = numbered.select("source", "node", F.col("_no").alias("_at"))
        part = numbered.select("source", "node", F.col("parent").alias("_p"), F.col("edge_id").alias("_e"))
        chosen = part if chosen is None else chosen.unionByName(part)
        if level % 16 == 0:
            chosen = cut_lineage(chosen)
    return cut_lineage(best.join(chosen, ["source", "node"], "left").withColumns({"parent": F.coalesce("_p", "parent"), "edge_id": F.coalesce("_e", "edge_id")}).drop("_p", "_e"))


def cheapest_costs(edges: DataFrame, starts: DataFrame, reverse: bool = False, max_rounds: int | None = None) -> DataFrame:
    """Cheapest way from every start to every node it reaches: source, node, cost, hops, parent (the node before), edge_id (between them).

    All starts relax together, one join and one pre-aggregated minimum per round; a round extends only what improved in the round before,
    and a few rounds run as one plan. Ties: fewest hops, then node order from the first node on. With ``reverse`` ways lead from the node to
    the source, and parent is the next node.
    """
    steps = stored(_steps(edges, reverse), "steps")
    first = _roots(starts.select(F.col("node").cast("string").alias("source"), F.col("node").cast("string"), F.lit(0).alias("rank")).distinct(), ["source", "node"])
    best = _relax_all(steps, first, ["source", "node"], max_rounds)
    # backwards the least next node gives the least route; forwards the first difference decides, which no single step sees
    best = best if reverse else _settle_ties(best, steps)
    return best.select("source", "node", "cost", "hops", "parent", "edge_id")


def with_paths(ways: DataFrame, keys: list[str], asked: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """Add the nodes and edge_ids of the asked ways (of all without ``asked``, which has the keys).

    Pointer jumping: parents at distance 1, 2, 4, ... are joined from each other, and the node at any distance is found by the binary
    digits of the distance, so a path takes as many joins as its length has digits, and paths nobody asked for are not built.
    """
    others = [k for k in keys if k != "node"]
    rows = ways if asked is None else ways.join(asked.select(*keys).distinct(), keys, "left_semi")
    longest = rows.agg(F.max("hops")).first()[0] or 0
    spots = rows.select(*keys, "hops", F.explode(F.sequence(F.lit(0), F.col("hops"))).alias("_d")).withColumn("_at", F.col("node"))
    jump = ways.where("parent IS NOT NULL").select(*others, F.col("node").alias("_from"), F.col("parent").alias("_to"))
    for digit in range(longest.bit_length()):
        jump = small_side(jump)
        far = jump.select(*others, F.col("_from").alias("_at"), F.col("_to").alias("_next"))
        spots = spots.join(far, [*others, "_at"], "left") \
            .withColumn("_at", F.when(F.col("_d").bitwiseAND(1 << digit) != 0, F.col("_next")).otherwise(F.col("_at"))).drop("_next")
        jump = jump.join(jump.select(*others, F.col("_from").alias("_to"), F.col("_to").alias("_end")), [*others, "_to"]).select(*others, "_from", F.col("_end").alias("_to"))
    named = spots.join(ways.select(*others, F.col("node").alias("_at"), F.col("edge_id").alias("_e")), [*others, "_at"])
    place = F.col("_d") if reverse else F.col("hops") - F.col("_d")
    # as long as the path, never longer than the number of nodes
    lists = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col("_at").alias("n"), F.col("_e").alias("e")))).alias("_l"))
    edges = F.filter(F.transform("_l", lambda x: x.e), lambda e: e.isNotNull())
    return rows.join(lists, keys).withColumns({"nodes": F.transform("_l", lambda x: x.n), "edge_ids": edges}).drop("_l")


def cheapest_routes(edges: DataFrame, starts: DataFrame, reverse: bool = False, max_rounds: int | None = None) -> DataFrame:
    """cheapest_costs with the path of every pair: source, node, cost, hops, nodes, edge_ids. With ``reverse`` routes run from the node to
    the source."""
    ways = cheapest_costs(edges, starts, reverse, max_rounds)
    return with_paths(ways, ["source", "node"], reverse=reverse).select("source", "node", "cost", "hops", "nodes", "edge_ids")


def requested_routes(routes: DataFrame, requests: DataFrame) -> DataFrame:
    """Routes for (source, node) requests; an unknown or unreachable pair gets empty arrays and no cost.

    ``routes`` from cheapest_routes, or from cheapest_costs: then only the paths of the requests are built.
    """
    if "nodes" not in routes.columns:
        routes = with_paths(routes, ["source", "node"], requests).drop("parent", "edge_id")
    empty = F.array().cast("array<string>")
    found = requests.join(routes, ["source", "node"], "left")
    return found.withColumns({"nodes": F.coalesce(F.col("nodes").cast("array<string>"), empty),
                              "edge_ids": F.coalesce("edge_ids", empty)})


def with_zone_path(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add the ordered zones of the route's edges, UNKNOWN where an edge has none."""
    zones = edges.select(F.col("edge_id").cast("string").alias("_edge"), "zone_id").dropDuplicates(["_edge"])
    keys = ["source", "node"]
    steps = routes.select(*keys, F.posexplode("edge_ids").alias("_pos", "_edge"))
    # an array per route is as long as the route, never longer than the number of nodes
    paths = steps.join(small_side(zones), "_edge", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("_pos", F.coalesce(F.col("zone_id").cast("string"), F.lit("UNKNOWN")).alias("zone")))).alias("_z"))
    return routes.join(paths, keys, "left").withColumn(
        "zone_path", F.coalesce(F.transform("_z", lambda z: z.zone), F.array().cast("array<string>"))).drop("_z")


def exit_costs(edges: DataFrame, exits: DataFrame) -> DataFrame:
    """Cheapest exit of every node that reaches one: node, cost, rank of the exit, hops, parent (the next node), edge_id; equal costs go
    to the exit listed first (``exit_ord``). All exits relax backwards in one pass that keeps one entry per node."""
    first = exits.groupBy(F.col("exit_id").cast("string").alias("node")).agg(F.min("exit_ord").alias("rank"))
    return _relax_all(stored(_steps(edges, True), "steps"), _roots(first, ["node"]), ["node"]).drop("fresh")


def repaired_exit_costs(ways: DataFrame, before: DataFrame, after: DataFrame, exits: DataFrame) -> tuple[DataFrame, int]:
    """exit_costs(after, exits) from ``ways`` = exit_costs(before, exits), and how many nodes were looked at again.

    Dearer or missing edges void the ways that cross them: marks spread from the broken edges to all ways behind by pointer jumping. Voided nodes
    and cheaper or new edges are then relaxed from the ways that still hold; all others stay as they are. Costs keep the exact sums a full
    run has, so both agree to the last digit and in their ties. The exits have to be the same.
    """
    old, new = stored(_steps(before, True), "steps"), stored(_steps(after, True), "steps")
    both = old.withColumnsRenamed({"_cost": "_was", "_edge": "_edge_was"}).join(new, ["_here", "_there"], "full_outer")
    changed = cut_lineage(both.where(~F.col("_was").eqNullSafe(F.col("_cost")) | ~F.col("_edge_was").eqNullSafe(F.col("_edge"))))
    better = changed.where(F.col("_cost").isNotNull() & (F.col("_was").isNull() | (F.col("_cost") <= F.col("_was"))))
    broken = changed.where(F.col("_was").isNotNull()).select(F.col("_here").alias("parent"), F.col("_there").alias("node"), F.lit(True).alias("_broken"))
    marks = ways.select("node", "parent").join(broken, ["parent", "node"], "left").select("node", "parent", F.coalesce("_broken", F.lit(False)).alias("void"))
    for _ in range((ways.agg(F.max("hops")).first()[0] or 0).bit_length()):
        above = marks.select(F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("void").alias("_void"))
        marks = cut_lineage(marks.join(above, "parent", "left").select("node", F.col("_up").alias("parent"), (F.col("void") | F.coalesce("_void", F.lit(False))).alias("void")))
    void = marks.where("void").select("node")
    kept = ways.join(void, "node", "left_anti")
    # ways that border on a voided node or on a cheaper edge start the rounds
    wake = new.join(void.withColumnRenamed("node", "_there"), "_there", "left_semi").select(F.col("_here").alias("node")) \
        .unionByName(better.select(F.col("_here").alias("node"))).distinct().withColumn("fresh", F.lit(True))
    start = cut_lineage(kept.join(wake, "node", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))).select("node", *_ROUTE))
    out = _relax_all(new, start, ["node"]).drop("fresh")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _ROUTE if c != "fresh"])
    settled = out.join(kept.select("node", *[F.col(c).alias(f"_{c}") for c in _ROUTE if c != "fresh"], F.lit(True).alias("_kept")), "node", "left")
    touched = settled.where(F.col("_kept").isNull() | ~same).count() + void.join(out, "node", "left_anti").count()
    return out, touched


def exit_paths(ways: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Ways to the exits with their paths and the exit at the end: node, exit_id, cost, hops, nodes, edge_ids."""
    found = with_paths(ways, ["node"], asked, reverse=True)
    return found.select("node", F.element_at("nodes", -1).alias("exit_id"), "cost", "hops", "nodes", "edge_ids")


def best_exit(edges: DataFrame, exits: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Cheapest exit of every node that reaches one (of the ``asked`` nodes only, if given), with the path to it."""
    return exit_paths(exit_costs(edges, exits), asked)


def low_risk_cost(base: Column, risk_from: Column, risk_to: Column, density_from: Column, density_to: Column,
                  risk_weight: float = 3.0, density_weight: float = 1.5, block_threshold: float = 0.92,
                  block_penalty: float = 1000.0) -> Column:
    """Distance weighted by mean risk and density of both ends; very risky targets cost a large penalty."""
    cost = base * (1 + risk_weight * 0.5 * (risk_from + risk_to) + density_weight * 0.5 * (density_from + density_to))
    return cost + F.when(risk_to >= block_threshold, block_penalty * base).otherwise(0.0)


def zone_graph_costs(adjacency: DataFrame, zone_state: DataFrame, cost=low_risk_cost) -> DataFrame:
    """Cost per direction of a zone adjacency; ``zone_state``: zone_id, risk, density (missing = 0, clamped)."""
    from ..functions.scalars import clamp
    side = lambda suffix, key: small_side(zone_state.select(
        F.col("zone_id").alias(key), F.col("risk").alias(f"risk_{suffix}"), F.col("density").alias(f"density_{suffix}")))
    rows = adjacency.join(side("from", "src"), "src", "left").join(side("to", "dst"), "dst", "left")
    c = lambda name: clamp(F.coalesce(name, F.lit(0.0)))
    return rows.select("src", "dst", F.concat_ws("-", "src", "dst").alias("edge_id"),
                       cost(F.col("base_cost"), c("risk_from"), c("risk_to"), c("density_from"), c("density_to")).alias("cost"))


def routing_density(density: Column, occupancy: Column, scale: float = 1.5) -> Column:
    """Density raised to the motion occupancy where detectors undercount."""
    from ..functions.scalars import clamp
    return clamp(F.greatest(density, scale * F.coalesce(occupancy, F.lit(0.0))))
