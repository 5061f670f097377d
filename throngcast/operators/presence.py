"""User presence: validation, latest position, expiry, grid cells, area scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import geometry as G, scalars as S
from ..session import cut_lineage
from .zones import small_side, with_blocks

HOTSPOTS_PER_BLOCK = 2000


def checked_updates(raw: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Typed presence updates with ``rejected``: the reason, or NULL when valid. ``raw`` columns are text.

    Blank or missing coordinates are rejected; a missing or zero time becomes the time of arrival.
    """
    user, lat, lng = S.clean_text(F.col("userId")), S.to_number(F.col("lat")), S.to_number(F.col("lng"))
    ts = S.to_number(F.col("ts"))
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    reason = F.when(user.isNull(), "userId is required") \
        .when(~(S.finite(lat) & S.finite(lng)), "lat/lng must be finite numbers")
    return raw.select(
        user.alias("user_id"), lat.alias("lat"), lng.alias("lng"),
        F.when(S.finite(ts) & (ts != 0), ts.cast("bigint")).otherwise(now).alias("ts"),
        S.clean_text(F.col("source")).alias("source"), reason.alias("rejected"),
        *[c for c in raw.columns if c not in ("userId", "lat", "lng", "ts", "source")])


def latest_presence(events: DataFrame, order: str = "arrival") -> DataFrame:
    """Last event per user by arrival, users whose last event is an offline one removed."""
    rest = [c for c in events.columns if c != "user_id"]
    latest = events.groupBy("user_id").agg(F.max_by(F.struct(*rest), order).alias("e"))
    return latest.select("user_id", "e.*").filter(~F.coalesce("offline", F.lit(False)))


def not_expired(latest: DataFrame, now_ms: int, max_age_ms: int = K.PRESENCE_MAX_AGE_MS) -> DataFrame:
    return latest.filter(F.lit(now_ms) - F.col("ts_ms") <= max(K.PRESENCE_MIN_AGE_MS, max_age_ms))


def newest(latest: DataFrame, n: int = K.PRESENCE_MAX_ENTRIES, tie: str = "user_id") -> DataFrame:
    """The n newest rows (a top-k, never a full sort)."""
    return latest.orderBy(F.col("ts_ms").desc(), tie).limit(n)


def presence_grid(latest: DataFrame, keys: list[str] = (), cell_m: float = K.GRID_CELL_M,
                  min_users: int = K.GRID_MIN_USERS) -> DataFrame:
    """Cells of about 180 m with at least two users; the longitude step depends on the user's own latitude."""
    lat_cell = S.round_half_up(F.col("lat") / S.metres_to_lat(F.lit(cell_m)))
    lng_cell = S.round_half_up(F.col("lng") / S.metres_to_lng(F.lit(cell_m), F.col("lat")))
    cells = latest.filter(S.finite(F.col("lat")) & S.finite(F.col("lng"))) \
        .groupBy(*keys, lat_cell.alias("lat_cell"), lng_cell.alias("lng_cell")) \
        .agg(F.count(F.lit(1)).alias("users"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
             F.max("ts_ms").alias("latest_ts"))
    return cells.filter(F.col("users") >= min_users).withColumn("intensity", S.presence_intensity(F.col("users"))) \
        .withColumn("band", S.heat_band(F.col("intensity"), K.PRESENCE_HEAT_BANDS))


def area_alerts(hotspots: DataFrame) -> DataFrame:
    return hotspots.groupBy(F.upper("planning_area").alias("planning_area")) \
        .agg(S.clamp(F.max("intensity")).alias("score"))


def area_scores(areas: DataFrame, hotspots: DataFrame, explicit: DataFrame | None = None, per_block: int = HOTSPOTS_PER_BLOCK) -> DataFrame:
    """Score of each area: its own alert, else the Gaussian influence of all hotspots on its centre.

    Hotspots come as arrays of about ``per_block`` points; each area meets each array once and adds up its part, so
    any number of them is served without pairing rows with rows.
    """
    # positions as points of the unit sphere: trigonometry once per point, only chords per pair
    sphere = {"_ux": F.cos(F.radians("lat")) * F.cos(F.radians("lng")), "_uy": F.cos(F.radians("lat")) * F.sin(F.radians("lng")), "_uz": F.sin(F.radians("lat"))}
    spots = cut_lineage(hotspots.select("lat", "lng", "intensity"))
    n = spots.count()
    blocks = max(1, -(-n // per_block))
    packed = spots.withColumns(sphere).groupBy(F.pmod(F.xxhash64("lat", "lng", "intensity"), F.lit(blocks)).alias("_block")) \
        .agg(F.collect_list(F.struct("_ux", "_uy", "_uz", "intensity")).alias("_spots"))

    def pulled(total: Column, s: Column) -> Column:
        dx, dy, dz = F.col("_ux") - s["_ux"], F.col("_uy") - s["_uy"], F.col("_uz") - s["_uz"]
        d = 2 * K.EARTH_RADIUS_M * F.asin(F.sqrt(dx * dx + dy * dy + dz * dz) / 2)
        return total + s["intensity"] * F.exp(-(d * d) / (2 * K.HOTSPOT_SIGMA_M ** 2))

    rows = areas.withColumns(sphere)
    part = F.aggregate("_spots", F.lit(0.0), pulled)
    if blocks == 1:
        rows = with_blocks(rows, packed, blocks).withColumn("_pull", part).drop("_spots")
    else:
        rows = cut_lineage(rows.withColumn("_area", F.monotonically_increasing_id()))
        sums = with_blocks(rows.select("_area", "_ux", "_uy", "_uz"), packed, blocks).groupBy("_area").agg(F.sum(part).alias("_pull"))
        rows = rows.join(sums, "_area", "left").drop("_area")
    pull = F.coalesce("_pull", F.lit(0.0))
    no_centre = F.col("lat").isNull() | F.col("lng").isNull() | F.lit(n == 0)
    rows = rows.withColumn("estimate", F.when(no_centre, K.NO_HOTSPOT_SCORE).otherwise(S.clamp(pull))).drop("_ux", "_uy", "_uz", "_pull")
    if explicit is None:
        return rows.withColumn("score", F.col("estimate"))
    named = explicit.select(S.area_key(F.col("planning_area")).alias("_key"), F.col("score").alias("_score"))
    return rows.withColumn("_key", S.area_key(F.col("area_name"))).join(small_side(named), "_key", "left") \
        .withColumn("score", F.coalesce("_score", "estimate")).drop("_key", "_score")


def first_by_coordinates(records: DataFrame, position: str) -> DataFrame:
    """First record (by position) per coordinate rounded to six decimals; records without coordinates drop out."""
    rows = records.filter(S.finite(F.col("lat")) & S.finite(F.col("lng"))) \
        .withColumn("_key", S.coordinate_key(F.col("lat"), F.col("lng")))
    return rows.groupBy("_key").agg(F.min_by(F.struct(*records.columns), position).alias("r")).select("r.*")


def in_viewport(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def boundary_areas(records: DataFrame) -> DataFrame:
    """One row per path of each area record, with its centre: area_name, path_no, path, lat, lng."""
    paths = records.select(F.coalesce("area_name", F.lit("Planning Area")).alias("area_name"),
                           F.posexplode(G.record_paths(F.col("geojson"), F.col("shape_text"))).alias("path_no", "path"))
    mean = lambda field: F.aggregate(F.transform("path", lambda p: p[field]), F.lit(0.0), lambda a, v: a + v) / F.size("path")
    return paths.withColumns({"lat": mean("lat"), "lng": mean("lng")})
