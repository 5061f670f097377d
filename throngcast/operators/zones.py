"""Zones: point location, counts and densities per zone, adjacency, expansion of coarse to fine zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import geometry as G, scalars as S
from ..session import cut_lineage

LITERAL_ZONES = 64      # up to here a zone set is compiled into one CASE expression
BROADCAST_ROWS = 100_000


def default_zones(spark: SparkSession) -> DataFrame:
    rows = [(z, i, n, c, [(float(x), float(y)) for x, y in p]) for i, (z, n, c, p) in enumerate(K.ZONES)]
    return spark.createDataFrame(
        rows, f"zone_id string, zone_ord int, name string, capacity double, polygon array<{G.POINT}>")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A dimension of few, narrow rows for a join: computed once, and broadcast only if it really is small.

    Such sides are often aggregates over the big table. They are checkpointed, so the size check and the
    join read the result instead of computing it twice; above the limit the optimizer picks the join.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept


def _zone_list(zones=None) -> list[tuple[str, list]]:
    return [(z, p) for z, _, _, p in K.ZONES] if zones is None else list(zones)


def _compiled(zones) -> bool:
    """Whether a zone set becomes one expression: a short list does, a table or a long list is joined on grid cells."""
    return not isinstance(zones, DataFrame) and len(_zone_list(zones)) <= LITERAL_ZONES


def zone_table(spark: SparkSession, zones) -> DataFrame:
    """A zone set (None, a list of id and polygon, or a table already) as a table with zone_id, zone_ord, capacity, polygon."""
    if isinstance(zones, DataFrame):
        return zones if "capacity" in zones.columns else zones.withColumn("capacity", F.lit(K.DEFAULT_CAPACITY))
    caps = {z: c for z, _, c, _ in K.ZONES}
    rows = [(z, i, caps.get(z, K.DEFAULT_CAPACITY), [(float(x), float(y)) for x, y in p]) for i, (z, p) in enumerate(_zone_list(zones))]
    return spark.createDataFrame(rows, f"zone_id string, zone_ord int, capacity double, polygon array<{G.POINT}>")


def zone_number(px: Column, py: Column, zones=None, width: int = K.FRAME_WIDTH, height: int = K.FRAME_HEIGHT) -> Column:
    """Position (from 0) of the first zone holding the whole-pixel point, borders included; NULL outside the frame.

    One expression inside codegen: no join, no shuffle. Pass columns, every zone refers to the point several times.
    """
    out = F.when(~((px >= 0) & (px < width) & (py >= 0) & (py < height)), None)
    for i, (_, polygon) in enumerate(_zone_list(zones)):
        out = out.when(G.in_polygon(px, py, polygon), F.lit(i))
    return out


def zone_name(number: Column, zones=None) -> Column:
    return F.get(F.array(*[F.lit(z) for z, _ in _zone_list(zones)]), number)


def locate_in_grid(points: DataFrame, zones: DataFrame, cell: float = 64.0,
                   width: int = K.FRAME_WIDTH, height: int = K.FRAME_HEIGHT) -> DataFrame:
    """The same for many polygons: equi join on grid cells, then the exact test, first zone by order.

    ``points`` needs ``point_id``, ``x``, ``y``; adds ``zone_id``. Points spread over cells; what a point
    joins to are the few zones that touch its cell.
    """
    box = G.bounding_box(F.col("polygon"))
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    cells = (zones.select("zone_id", "zone_ord", "polygon", F.explode(span(box["x0"], box["x1"])).alias("cx"),
                          span(box["y0"], box["y1"]).alias("rows"))
             .select("zone_id", "zone_ord", "polygon", "cx", F.explode("rows").alias("cy")))
    placed = points.select("point_id", S.round_half_even(F.col("x")).alias("px"),
                           S.round_half_even(F.col("y")).alias("py")) \
        .filter((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)) \
        .withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    hits = placed.join(small_side(cells), ["cx", "cy"]) \
        .filter(G.in_polygon_column(F.col("px"), F.col("py"), F.col("polygon"))) \
        .groupBy("point_id").agg(F.min_by("zone_id", "zone_ord").alias("zone_id"))
    return points.join(hits, "point_id", "left")


def _pixels(detections: DataFrame) -> DataFrame:
    cx, cy = G.box_centre(F.col("bbox"))
    return detections.withColumns({"_px": S.round_half_even(cx), "_py": S.round_half_even(cy)})


def _numbered(detections: DataFrame, zones=None, width: int = K.FRAME_WIDTH, height: int = K.FRAME_HEIGHT) -> DataFrame:
    number = F.when(G.valid_box(F.col("bbox")), zone_number(F.col("_px"), F.col("_py"), zones, width, height))
    return _pixels(detections).withColumn("_zone", number).drop("_px", "_py")


def _in_cells(detections: DataFrame, zones, width: int, height: int, cell: float = 64.0) -> DataFrame:
    """Adds zone_id through a join on grid cells, for any number of zones.

    The zone side has one row per cell with the zones that touch it in order, so a box joins once and no row identity is needed.
    """
    box = G.bounding_box(F.col("polygon"))
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    touched = zone_table(detections.sparkSession, zones).withColumn("_cx", F.explode(span(box["x0"], box["x1"]))) \
        .withColumn("_cy", F.explode(span(box["y0"], box["y1"])))
    cells = touched.groupBy("_cx", "_cy").agg(F.array_sort(F.collect_list(F.struct(
        "zone_ord", "zone_id", "polygon", *[v.alias(k) for k, v in box.items()]))).alias("_near"))
    px, py = F.col("_px"), F.col("_py")
    inside = G.valid_box(F.col("bbox")) & (px >= 0) & (px < width) & (py >= 0) & (py < height)
    placed = _pixels(detections).withColumns({"_cx": F.when(inside, F.floor(px / cell)), "_cy": F.when(inside, F.floor(py / cell))})
    # the box test is cheap and spares most polygons
    hit = F.filter("_near", lambda z: (px >= z["x0"]) & (px <= z["x1"]) & (py >= z["y0"]) & (py <= z["y1"]) & G.in_polygon_column(px, py, z["polygon"]))
    return placed.join(small_side(cells), ["_cx", "_cy"], "left").withColumn("zone_id", F.get(hit, F.lit(0))["zone_id"]) \
        .drop("_cx", "_cy", "_px", "_py", "_near")


def with_zone(detections: DataFrame, zones=None, width: int = K.FRAME_WIDTH, height: int = K.FRAME_HEIGHT) -> DataFrame:
    """Add the zone of the box centre, rounded half-even to a pixel; NULL without a valid box or outside.

    ``zones`` is a table (zone_id, zone_ord, polygon, capacity), a list of id and polygon, or None for the built-in ones.
    """
    if not _compiled(zones):
        return _in_cells(detections, zones, width, height)
    return _numbered(detections, zones, width, height).withColumn("zone_id", zone_name(F.col("_zone"), zones)).drop("_zone")


def _per_zone(detections: DataFrame, zones, frame: str, width: int, height: int, *totals: Column) -> DataFrame:
    """Totals per frame and zone, without the boxes outside all zones.

    The zone that is filtered and joined on later is an aggregate (the maximum of equal numbers), not the
    grouping column: a predicate on that would be pushed below the projection and repeat the whole zone test,
    box arithmetic included, in one huge filter.
    """
    if not _compiled(zones):
        return _in_cells(detections, zones, width, height).groupBy(frame, "zone_id").agg(*totals).filter("zone_id IS NOT NULL")
    per = _numbered(detections, zones, width, height).groupBy(frame, "_zone").agg(F.max("_zone").alias("_no"), *totals)
    named = per.filter("_no IS NOT NULL").withColumn("zone_id", zone_name(F.col("_no"), zones))
    return named.select(frame, "zone_id", *per.columns[3:])


def with_blocks(rows: DataFrame, packed: DataFrame, blocks: int, salts: int = 64) -> DataFrame:
    """Each row with each of ``blocks`` packed rows (``_block``, arrays of bounded length).

    One block is broadcast, its length being bounded. More are dealt by (block, salt), so that rows spread over many tasks.
    """
    if blocks == 1:
        return rows.withColumn("_block", F.lit(0).cast("long")).join(F.broadcast(packed), "_block", "left").drop("_block")
    last = F.lit(blocks - 1).cast("long")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    copies = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, ["_block", "_salt"]).drop("_block", "_salt")


def every_pair(rows: DataFrame, dimension: DataFrame, per_row: int = 4096) -> DataFrame:
    """Each row with each entry of a dimension, as dense results need it: entries travel as arrays of about ``per_row``."""
    counted = cut_lineage(dimension)
    blocks = max(1, -(-counted.count() // per_row))
    packed = counted.groupBy(F.pmod(F.xxhash64(*dimension.columns), F.lit(blocks)).alias("_block")) \
        .agg(F.collect_list(F.struct(*dimension.columns)).alias("_entries"))
    return with_blocks(rows, packed, blocks).select("*", F.inline("_entries")).drop("_entries")


def detections_by_zone(detections: DataFrame, frame: str = "frame_id", labels: list[str] | None = None,
                       zones=None, width: int = K.FRAME_WIDTH, height: int = K.FRAME_HEIGHT) -> DataFrame:
    """Count and confidence sum per frame and zone; boxes outside all zones are dropped."""
    rows = detections if labels is None else detections.filter(F.col("label").isin(labels))
    return _per_zone(rows, zones, frame, width, height, F.count(F.lit(1)).alias("n"),
                     F.sum(F.coalesce("conf", F.lit(0.0))).alias("conf_sum"))


def frame_zone_skeleton(frames: DataFrame, zone_rows: list[tuple[str, float]]) -> DataFrame:
    """Every zone for every frame. The zone set is a literal array in the row, so nothing is joined."""
    zones = F.array(*[F.struct(F.lit(z).alias("zone_id"), F.lit(c).alias("capacity")) for z, c in zone_rows])
    return frames.select("*", F.inline(zones))


def zone_density(counts: DataFrame, frames: DataFrame, zone_rows: list[tuple[str, float]] | DataFrame | None = None,
                 frame: str = "frame_id", detector_available: bool = True) -> DataFrame:
    """Density, confidence and people for every frame and zone, also where nothing was seen. ``zone_rows``: id and capacity."""
    zone_rows = [(z, c) for z, _, c, _ in K.ZONES] if zone_rows is None else zone_rows
    if isinstance(zone_rows, DataFrame):
        dense = every_pair(frames.select(frame), zone_rows.select("zone_id", F.coalesce("capacity", F.lit(K.DEFAULT_CAPACITY)).alias("capacity")))
    else:
        dense = frame_zone_skeleton(frames.select(frame), zone_rows)
    if not detector_available:
        return dense.select(frame, "zone_id", F.lit(0.0).alias("density"), F.lit(K.FALLBACK_CONF).alias("conf"),
                            F.lit(0).cast("bigint").alias("people_count"))
    n = F.coalesce("n", F.lit(0))
    return dense.join(counts, [frame, "zone_id"], "left").select(
        frame, "zone_id", S.clamp(n / F.greatest(F.col("capacity"), F.lit(1.0))).alias("density"),
        F.when(n > 0, F.col("conf_sum") / n).otherwise(F.lit(K.FALLBACK_CONF)).alias("conf"),
        n.cast("bigint").alias("people_count"))


def label_counts(detections: DataFrame, frame: str = "frame_id", zones=None, width: int = K.FRAME_WIDTH,
                 height: int = K.FRAME_HEIGHT) -> DataFrame:
    """People, vehicles and heads per frame and zone, with the combined activity share of the zone's own capacity."""
    tally = lambda label: F.count_if(F.col("label") == label)
    counts = _per_zone(detections, zones, frame, width, height, tally("person").alias("people"), tally("vehicle").alias("vehicles"),
                       tally("head").alias("heads"))
    if _compiled(zones):
        capacity = S.lookup(F.col("zone_id"), {z: c for z, _, c, _ in K.ZONES}, F.lit(K.DEFAULT_CAPACITY))
        return counts.withColumn("activity", S.clamp((F.col("people") + F.col("vehicles")) / F.greatest(capacity, F.lit(1.0))))
    own = small_side(zone_table(detections.sparkSession, zones).select("zone_id", F.col("capacity").alias("_cap")))
    capacity = F.greatest(F.coalesce("_cap", F.lit(K.DEFAULT_CAPACITY)), F.lit(1.0))
    return counts.join(own, "zone_id", "left").withColumn("activity", S.clamp((F.col("people") + F.col("vehicles")) / capacity)) \
        .select(*counts.columns, "activity")


def with_head_proxies(detections: DataFrame, width: int = K.FRAME_WIDTH, height: int = K.FRAME_HEIGHT) -> DataFrame:
    """Each person box also gives a head row, clipped to the frame."""
    own = F.struct("bbox", "conf", "label", "classId", "className")
    head = F.struct(G.head_box(F.col("bbox"), width, height).alias("bbox"), F.col("conf"), F.lit("head").alias("label"),
                    F.lit(-1).alias("classId"), F.lit("head_proxy").alias("className"))
    rest = [c for c in detections.columns if c not in ("bbox", "conf", "label", "classId", "className")]
    both = F.when(F.col("label") == "person", F.array(own, head)).otherwise(F.array(own))
    return detections.select(*rest, F.inline(both))


def zone_adjacency(zones: DataFrame, touch_tol: float = 0.0, cell: float = 64.0) -> DataFrame:
    """Both directions of zone pairs whose bounding boxes touch along a shared stretch, with centroid distance.

    Boxes (grown by the tolerance) meet only inside common grid cells, so the pairing is an equi join
    on cells, not a comparison of all zones with all zones.
    """
    box = G.bounding_box(F.col("polygon"))
    mx, my = G.vertex_mean(F.col("polygon"))
    flat = zones.select("zone_id", mx.alias("mx"), my.alias("my"), *[F.floor(v).alias(k) for k, v in box.items()])
    span = lambda a, b: F.sequence(F.floor((F.col(a) - touch_tol) / cell), F.floor((F.col(b) + touch_tol) / cell))
    cells = flat.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    a, b = cells.alias("a"), cells.alias("b")
    near = lambda p, q: F.abs(F.col(p) - F.col(q)) <= touch_tol
    overlap = lambda lo, hi: F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}")) > F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}"))
    touches = ((near("a.x1", "b.x0") | near("b.x1", "a.x0")) & overlap("y0", "y1")) | \
              ((near("a.y1", "b.y0") | near("b.y1", "a.y0")) & overlap("x0", "x1"))
    distance = F.hypot(F.col("a.mx") - F.col("b.mx"), F.col("a.my") - F.col("b.my"))
    pairs = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
                   & (F.col("a.zone_id") < F.col("b.zone_id")) & touches) \
        .select(F.col("a.zone_id").alias("src"), F.col("b.zone_id").alias("dst"),
                F.when(distance > 0, distance).otherwise(1.0).alias("base_cost")).distinct()
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "base_cost"))


def expand_to_routing_zones(routing_zones: DataFrame, analysis_risk: DataFrame) -> DataFrame:
    """Each routing zone takes its parent's risk; an unknown parent gives 0."""
    risk = F.coalesce("risk", F.lit(0.0))
    return routing_zones.join(small_side(analysis_risk.select(F.col("zone_id").alias("parent_id"), "risk")),
                              "parent_id", "left") \
        .select("routing_zone_id", "parent_id", risk.alias("risk"), S.severity_band(risk).alias("severity"))


def expand_with_delta(routing_zones: DataFrame, analysis_risk: DataFrame, deltas: DataFrame) -> DataFrame:
    """As above plus the local hazard delta of the zone, NULL when it is 0."""
    out = expand_to_routing_zones(routing_zones, analysis_risk)
    return out.join(small_side(deltas.select(F.col("zone_id").alias("routing_zone_id"), "local_delta")),
                    "routing_zone_id", "left").withColumn("local_delta", F.nullif(F.col("local_delta"), F.lit(0.0)))


def density_map_counts(cells: DataFrame, roi: list[tuple[int, int]], frame_size: tuple[int, int],
                       grid_size: tuple[int, int], frame: str = "frame_id") -> DataFrame:
    """Sum of a density map, whole and inside a region given in frame pixels (scaled to the grid, half-even)."""
    sx, sy = grid_size[0] / max(frame_size[0], 1), grid_size[1] / max(frame_size[1], 1)
    scaled = [(round(x * sx), round(y * sy)) for x, y in roi]
    inside = G.in_polygon(F.col("x"), F.col("y"), scaled)
    return cells.groupBy(frame).agg(F.sum("v").alias("total"), F.coalesce(F.sum(F.when(inside, F.col("v"))), F.lit(0.0))
                                    .alias("in_roi"))


def vehicles(detections: DataFrame, class_id: str = "class_id", bbox: str = "bbox") -> DataFrame:
    """Detections of vehicles with a whole box, and their ``custom_id``."""
    return detections.withColumn("custom_id", S.custom_class(F.col(class_id))).filter(F.col("custom_id").isNotNull() & G.valid_box(F.col(bbox)))
