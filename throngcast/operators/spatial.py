"""Nearest spacing, density in a region of interest, and the affine map from plan to geographic coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import RoiDensityConfig
from ..functions import geometry as G, scalars as S
from ..session import cut_lineage
from .ordered import ROWS_PER_CHUNK, exact_percentiles, with_average


def nearest_spacing(points: DataFrame, frame: str = "frame_id", first_cell: float = 4.0, growth: float = 4.0) -> DataFrame:
    """Distance from each point to its nearest other point of the frame (points that share a position have none).

    Points look only into their own and the eight surrounding grid cells. A neighbour within one cell width is
    certain to be the nearest; points without one go to the next round with larger cells. Dense spots are
    settled while cells are small, so no frame is ever compared all with all.
    """
    spots = cut_lineage(points.groupBy(frame, "x", "y").agg(F.count(F.lit(1)).alias("_n")))
    extent = spots.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0]
    open_, found, cell = spots.filter("_n = 1").select(frame, "x", "y"), None, first_cell
    while True:
        last = extent is None or cell > extent
        at = lambda c: F.floor(F.col(c) / cell)
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        probe = open_.select(frame, F.col("x").alias("px"), F.col("y").alias("py"), F.inline(around)) \
            .select(frame, "px", "py", (F.floor(F.col("px") / cell) + F.col("i")).alias("cx"),
                    (F.floor(F.col("py") / cell) + F.col("j")).alias("cy"))
        others = spots.select(frame, "x", "y", at("x").alias("cx"), at("y").alias("cy"))
        near = probe.join(others, [frame, "cx", "cy"]).filter((F.col("x") != F.col("px")) | (F.col("y") != F.col("py"))) \
            .groupBy(frame, "px", "py").agg(F.min(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).alias("spacing")) \
            .withColumnsRenamed({"px": "x", "py": "y"})
        settled = cut_lineage(near if last else near.filter(F.col("spacing") <= cell))
        found = settled if found is None else found.unionByName(settled)
        if last:
            return found
        open_ = cut_lineage(open_.join(settled, [frame, "x", "y"], "left_anti"))
        if open_.isEmpty():
            return found
        cell *= growth


def roi_density(detections: DataFrame, cfg: RoiDensityConfig, keys: list[str] = ("camera",), frame: str = "frame_id",
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """People per square metre inside a region, per frame.

    The scale comes from the median body height in pixels: person boxes, else head boxes, else the spacing of
    heads; it is smoothed over frames and carried where a frame has too few samples. ``keys`` name the camera.
    """
    keys, roi = list(keys), [tuple(p) for p in cfg.roi]
    cx, cy = G.box_centre(F.col("bbox"))
    at = [*keys, frame]
    x, y = F.col("_x"), F.col("_y")
    rows = detections.withColumns({"_x": cx, "_y": cy, "_h": G.corner(F.col("bbox"), 3) - G.corner(F.col("bbox"), 1)}) \
        .withColumn("_in", F.coalesce(G.valid_box(F.col("bbox")) & G.in_polygon(x, y, roi), F.lit(False)))
    is_a = lambda label: F.col("_in") & (F.col("label") == label)
    body = {"person": F.col("_h"), "head": F.col("_h") * cfg.head_to_body_ratio}
    sized = {label: F.when(is_a(label) & (F.col("_h") > 0), h) for label, h in body.items()}
    usable = lambda h: h.between(cfg.min_h_px, cfg.max_h_px)
    rows = rows.withColumns({f"_{label}": h for label, h in sized.items()})
    rows = rows.withColumns({f"_{label}_ok": F.when(usable(F.col(f"_{label}")), F.col(f"_{label}")) for label in sized})
    totals = [F.count_if(is_a("head")).alias("heads"), F.count_if(is_a("head") & (F.col("_h") <= 0)).alias("_flat")]
    totals += [F.count(f"_{label}{ok}").alias(f"n_{label}{ok}") for label in sized for ok in ("", "_ok")]
    per = exact_percentiles(rows, at, {f"med_{label}": (f"_{label}_ok", 0.5) for label in sized}, rows_per_chunk, totals)
    by_person = F.col("n_person") > 0
    rows = per.select(*at, "heads", F.when(by_person, F.col("n_person_ok")).otherwise(F.col("n_head_ok")).alias("h_samples"),
                      F.when(by_person, F.col("med_person")).otherwise(F.col("med_head")).alias("h_med_px"),
                      ((F.col("n_person") + F.col("n_head") == 0) & (F.col("_flat") > 0)).alias("_by_spacing"))
    rows = _with_spacing(rows, detections, at, roi, cfg, rows_per_chunk)
    raw = F.when(F.col("h_samples") >= cfg.min_samples, F.col("h_med_px") / cfg.avg_height_m)
    rows = rows.withColumn("scale_raw", F.when(raw > 1e-6, raw))
    start = "first" if cfg.init_scale_px_per_m is None else cfg.init_scale_px_per_m
    rows = with_average(rows, keys, [frame], "scale_raw", "scale", 1 - cfg.ema_alpha, start, rows_per_chunk)
    area_px = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(roi, roi[1:] + roi[:1]))) / 2
    known = F.col("scale").isNotNull() & (F.col("scale") > 1e-6)
    area = F.when(known, F.greatest(F.lit(1e-6), area_px / (F.col("scale") * F.col("scale")))).otherwise(0.0)
    rows = rows.withColumn("area_m2", area).withColumn(
        "density", F.when(known, F.col("heads") / F.col("area_m2")).otherwise(0.0))
    return rows.withColumn("level", F.when(known, S.people_per_m2_band(F.col("density"))).otherwise("unknown"))


def _with_spacing(rows: DataFrame, detections: DataFrame, at: list[str], roi, cfg: RoiDensityConfig, rows_per_chunk: int) -> DataFrame:
    """Frames that have heads but no body sizes take the height from the spacing of heads."""
    wanted = rows.filter("_by_spacing").select(*at)
    if wanted.isEmpty():
        return rows.drop("_by_spacing")
    cx, cy = G.box_centre(F.col("bbox"))
    heads = detections.filter(G.valid_box(F.col("bbox")) & (F.col("label") == "head")).join(wanted, at, "left_semi") \
        .select(F.struct(*at).alias("_at"), cx.alias("x"), cy.alias("y")).filter(G.in_polygon(F.col("x"), F.col("y"), roi))
    spaced = nearest_spacing(heads, "_at").select("_at.*", (F.col("spacing") * cfg.head_spacing_to_body_ratio).alias("h"))
    found = exact_percentiles(spaced.filter(F.col("h").between(cfg.min_h_px, cfg.max_h_px)), at, {"_med": ("h", 0.5)}, rows_per_chunk,
                              [F.count(F.lit(1)).alias("_n")])
    joined = rows.join(found, at, "left")
    return joined.withColumns({"h_samples": F.when(F.col("_by_spacing"), F.coalesce("_n", F.lit(0))).otherwise(F.col("h_samples")),
                               "h_med_px": F.when(F.col("_by_spacing"), F.col("_med")).otherwise(F.col("h_med_px"))}) \
        .drop("_by_spacing", "_n", "_med")


def affine_fit(anchors: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Least-squares plane for lat and lng over plan x, y: a_lat, b_lat, c_lat, a_lng, b_lng, c_lng.

    NULL coefficients with fewer than three anchors or anchors on one line. Sums are centred, which keeps
    the closed form stable.
    """
    mean = anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("x", "y", "lat", "lng")],
                                      *[f(p, q).alias(f"s_{p}_{q}") for f, p, q in
                                        [(F.covar_pop, p, q) for p, q in (("x", "x"), ("y", "y"), ("x", "y"), ("x", "lat"),
                                                                          ("y", "lat"), ("x", "lng"), ("y", "lng"))]])
    sxx, syy, sxy = F.col("s_x_x"), F.col("s_y_y"), F.col("s_x_y")
    det = sxx * syy - sxy * sxy
    usable = (F.col("n") >= 3) & (F.abs(det) > 1e-10 * F.greatest(F.lit(1e-12), sxx * syy))
    out = {}
    for g in ("lat", "lng"):
        a = (F.col(f"s_x_{g}") * syy - F.col(f"s_y_{g}") * sxy) / det
        b = (F.col(f"s_y_{g}") * sxx - F.col(f"s_x_{g}") * sxy) / det
        out[f"a_{g}"], out[f"b_{g}"] = F.when(usable, a), F.when(usable, b)
        out[f"c_{g}"] = F.when(usable, F.col(f"m_{g}") - a * F.col("m_x") - b * F.col("m_y"))
    return mean.select(*keys, "n", *[c.alias(name) for name, c in out.items()])


def project(nodes: DataFrame, fit, anchors: DataFrame) -> DataFrame:
    """Coordinates of nodes: their own anchor, else the fitted plane (``fit``: one row of ``affine_fit``)."""
    own = anchors.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    rows = nodes.join(own, "id", "left")
    if fit is None or fit.a_lat is None or fit.a_lng is None:
        rows = rows.withColumns({"lat": F.col("_lat"), "lng": F.col("_lng")})
    else:
        plane = lambda g: fit[f"a_{g}"] * F.col("x") + fit[f"b_{g}"] * F.col("y") + fit[f"c_{g}"]
        rows = rows.withColumns({"lat": F.coalesce("_lat", plane("lat")), "lng": F.coalesce("_lng", plane("lng"))})
    source = F.when(F.col("_lat").isNotNull(), "anchor").when(F.col("lat").isNotNull(), "fitted").otherwise("none")
    return rows.withColumn("source", source).drop("_lat", "_lng")
