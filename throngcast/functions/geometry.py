"""Polygons, boxes and geometry text as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import constants as K
from .scalars import fixed6

POINT = "struct<x:double,y:double>"


def corner(bbox: Column, i: int) -> Column:
    """Box coordinate, NULL where the box is too short."""
    return F.get(bbox, F.lit(i))


def box_centre(bbox: Column) -> tuple[Column, Column]:
    return F.lit(0.5) * (corner(bbox, 0) + corner(bbox, 2)), F.lit(0.5) * (corner(bbox, 1) + corner(bbox, 3))


def valid_box(bbox: Column) -> Column:
    return F.coalesce(F.size(bbox) == 4, F.lit(False))


def head_box(bbox: Column, width: int = K.FRAME_WIDTH, height: int = K.FRAME_HEIGHT) -> Column:
    """Head area at the top of a person box, clipped to the frame."""
    cx = F.lit(0.5) * (bbox[0] + bbox[2])
    w = F.greatest(F.lit(K.HEAD_MIN_PX), F.greatest(F.lit(1.0), bbox[2] - bbox[0]) * K.HEAD_WIDTH_RATIO)
    h = F.greatest(F.lit(K.HEAD_MIN_PX), F.greatest(F.lit(1.0), bbox[3] - bbox[1]) * K.HEAD_HEIGHT_RATIO)
    return F.array(
        F.greatest(F.lit(0.0), cx - F.lit(0.5) * w),
        F.greatest(F.lit(0.0), bbox[1]),
        F.least(F.lit(float(width - 1)), cx + F.lit(0.5) * w),
        F.least(F.lit(float(height - 1)), bbox[1] + h),
    )


def percent_box(bbox: Column, width: float, height: float) -> dict[str, Column]:
    """Overlay box in percent of the image: origin clamped to 0..100, size at least 0.8."""
    pct = lambda v, whole: v / F.lit(float(whole)) * 100
    return {
        "left_pct": F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct(bbox[0], width))),
        "top_pct": F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct(bbox[1], height))),
        "width_pct": F.greatest(F.lit(0.8), F.least(F.lit(100.0), pct(bbox[2] - bbox[0], width))),
        "height_pct": F.greatest(F.lit(0.8), F.least(F.lit(100.0), pct(bbox[3] - bbox[1], height))),
    }


def label_line(class_id: Column, bbox: Column, width: float, height: float) -> Column:
    """Training label text: class, centre and size as image ratios with six decimals."""
    w = F.greatest(F.lit(1.0), bbox[2] - bbox[0])
    h = F.greatest(F.lit(1.0), bbox[3] - bbox[1])
    cx, cy = bbox[0] + w * 0.5, bbox[1] + h * 0.5
    ratios = [cx / F.lit(float(width)), cy / F.lit(float(height)), w / F.lit(float(width)), h / F.lit(float(height))]
    return F.concat_ws(" ", class_id.cast("string"), *[fixed6(r) for r in ratios])


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Boundary-inclusive test against a fixed polygon, all literals, inside codegen."""
    xs, ys = [float(p[0]) for p in polygon], [float(p[1]) for p in polygon]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    if _is_rectangle(polygon):
        return box
    crossings, on_edge = [], []
    for i in range(len(polygon)):
        x1, y1, x2, y2 = xs[i - 1], ys[i - 1], xs[i], ys[i]
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge.append((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings.append((straddles & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int"))
    inside = reduce(lambda a, b: a + b, crossings) % 2 == 1
    return box & (inside | reduce(lambda a, b: a | b, on_edge))


def _is_rectangle(polygon) -> bool:
    xs, ys = {p[0] for p in polygon}, {p[1] for p in polygon}
    corners = {(px, py) for px in xs for py in ys}
    turns = all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(polygon, list(polygon[1:]) + list(polygon[:1])))
    return len(polygon) == 4 and len(xs) == 2 and len(ys) == 2 and set(polygon) == corners and turns


def in_polygon_column(x: Column, y: Column, polygon: Column) -> Column:
    """The same test when the polygon is an array of (x, y) structs in the row."""
    n = F.size(polygon)

    def edge(i: Column) -> Column:
        a, b = polygon[i], polygon[(i + 1) % n]
        cross = (x - a.x) * (b.y - a.y) - (y - a.y) * (b.x - a.x)
        on_edge = (cross == 0) & x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) \
            & y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))
        hit = ((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * (y - a.y) / F.nullif(b.y - a.y, F.lit(0.0)) + a.x)
        return F.struct(on_edge.alias("on_edge"), F.coalesce(hit, F.lit(False)).cast("int").alias("hit"))

    edges = F.transform(F.sequence(F.lit(0), n - 1), edge)
    crossed = F.aggregate(edges, F.lit(0), lambda acc, e: acc + e.hit)
    return F.exists(edges, lambda e: e.on_edge) | (crossed % 2 == 1)


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for an expression that ``use`` refers to several times: inside it the value is a variable, not the expression again."""
    return F.transform(F.array(value), use)[0]


def polygon_area(polygon: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    def area(p):
        n = F.size(p)
        terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: p[i].x * p[(i + 1) % n].y - p[(i + 1) % n].x * p[i].y)
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2
    return computed_once(polygon, area)


def vertex_mean(polygon: Column) -> tuple[Column, Column]:
    total = lambda field: F.aggregate(F.transform(polygon, lambda p: p[field]), F.lit(0.0), lambda acc, v: acc + v)
    return total("x") / F.size(polygon), total("y") / F.size(polygon)


def bounding_box(polygon: Column) -> dict[str, Column]:
    xs, ys = F.transform(polygon, lambda p: p.x), F.transform(polygon, lambda p: p.y)
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def roi_points(text: Column, whole_pixels: bool = False) -> Column:
    """'x,y;x,y' to points. NULL when a token is malformed or there are too few points (4, or 3 in whole pixels)."""
    tokens = F.filter(F.transform(F.split(F.trim(text), ";"), lambda t: F.trim(t)), lambda t: t != "")
    number = lambda s: F.trim(s).try_cast("double")
    if whole_pixels:
        number = lambda s: F.trim(s).try_cast("double").cast("int").cast("double")
    points = F.transform(F.transform(tokens, lambda t: F.split(t, ",")), lambda s: F.when(
        F.size(s) == 2, F.struct(number(s[0]).alias("x"), number(s[1]).alias("y"))))

    def checked(p):
        good = F.forall(p, lambda q: q.isNotNull() & q.x.isNotNull() & q.y.isNotNull())
        return F.when(good & (F.size(p) >= (3 if whole_pixels else 4)), p)
    return computed_once(points, checked)


# --- Fixed value: two numbers separated by blanks --------------------------------------
WKT_PAIR = r"(-?\d+(\.\d+)?\s+-?\d+(\.\d+)?)"


def _rings_to_paths(rings: Column) -> Column:
    """GeoJSON rings ([lng, lat] pairs) to (lat, lng) paths of at least three points."""
    def path(ring):
        points = F.transform(ring, lambda p: F.when(
            p[0].isNotNull() & p[1].isNotNull(), F.struct(p[1].alias("lat"), p[0].alias("lng"))))
        return F.filter(points, lambda p: p.isNotNull())
    return F.filter(F.transform(rings, path), lambda p: F.size(p) >= 3)


def geojson_paths(text: Column) -> Column:
    """Paths of a GeoJSON Polygon or MultiPolygon, bare or wrapped in a Feature."""
    inner = F.get_json_object(text, "$.geometry")
    geometry = F.coalesce(inner, text)
    kind = F.lower(F.get_json_object(geometry, "$.type"))
    coords = F.get_json_object(geometry, "$.coordinates")
    polygon = F.from_json(coords, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coords, "array<array<array<array<double>>>>"))
    return F.when(kind == "polygon", _rings_to_paths(polygon)).when(kind == "multipolygon", _rings_to_paths(multi))


def pipe_paths(text: Column) -> Column:
    """Number pairs separated by pipes; the second number of a pair is the latitude."""
    def point(pair):
        parts = F.split(pair, ",")
        lng, lat = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
        return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))
    points = F.filter(F.transform(F.split(text, r"\|"), point), lambda p: p.isNotNull())
    return F.when((F.instr(text, "|") > 0) & (F.size(points) >= 3), F.array(points))


def wkt_paths(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(WKT_PAIR), F.lit(1))
    points = F.transform(pairs, lambda p: F.struct(
        F.split(p, r"\s+")[1].cast("double").alias("lat"), F.split(p, r"\s+")[0].cast("double").alias("lng")))
    return F.when(F.size(points) >= 3, F.array(points))


def record_paths(geojson: Column, shape_text: Column) -> Column:
    """First usable form: GeoJSON, pipe list, WKT; an empty array when none is."""
    has = lambda paths: F.when(F.size(paths) > 0, paths)
    none = F.array().cast("array<array<struct<lat:double,lng:double>>>")
    return F.coalesce(has(geojson_paths(geojson)), has(pipe_paths(shape_text)), has(wkt_paths(shape_text)), none)
