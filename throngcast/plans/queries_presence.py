"""Presence, cameras, areas and text-shaped inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G, scalars as S
from ..operators import cameras as C, presence as P
from .catalog import query, rounded
from .views import k_value, millis

HALF_DAY = 12 * 3600 * 1000


def _now(t) -> int:
    return t.presence.agg(F.max("ts_ms")).first()[0]


@query("presence_latest", "O09 J23 T02 T03", "SELECT user_id, arrival, round(lat, 9) AS lat, round(lng, 9) AS lng, ts_ms FROM latest")
def _(t):
    return rounded(P.latest_presence(t.presence).select("user_id", "arrival", "lat", "lng", "ts_ms"))


@query("presence_active", "T02 A30", f"""
    SELECT user_id, ts_ms FROM latest WHERE (SELECT max(ts_ms) FROM presence) - ts_ms <= {HALF_DAY}""")
def _(t):
    return P.not_expired(P.latest_presence(t.presence), _now(t), HALF_DAY).select("user_id", "ts_ms")


@query("presence_evict", "O05", "SELECT user_id, ts_ms FROM latest ORDER BY ts_ms DESC, user_id LIMIT 100")
def _(t):
    return P.newest(P.latest_presence(t.presence), 100).select("user_id", "ts_ms")


_INTENSITY = "CASE WHEN users >= 14 THEN 1e0 WHEN users >= 10 THEN 0.85e0 WHEN users >= 7 THEN 0.72e0 WHEN users >= 5 THEN 0.56e0 WHEN users >= 3 THEN 0.4e0 ELSE 0.28e0 END"
_CELL = """CAST(floor(lat / (180e0 / 111320) + 0.5e0) AS BIGINT) AS lat_cell,
    CAST(floor(lng / (180e0 / (111320 * cos(radians(lat)))) + 0.5e0) AS BIGINT) AS lng_cell"""


@query("presence_grid", "A15 P08 P09 P15", f"""
    SELECT lat_cell, lng_cell, users, round(lat, 9) AS lat, round(lng, 9) AS lng, latest_ts, intensity, CASE WHEN intensity >= 0.9 THEN 5
        WHEN intensity >= 0.75 THEN 4 WHEN intensity >= 0.6 THEN 3 WHEN intensity >= 0.45 THEN 2 WHEN intensity >= 0.3 THEN 1 ELSE 0 END AS band FROM (
        SELECT *, {_INTENSITY} AS intensity FROM (
            SELECT lat_cell, lng_cell, count(*) AS users, avg(lat) AS lat, avg(lng) AS lng, max(ts_ms) AS latest_ts FROM (
                SELECT *, {_CELL} FROM latest) GROUP BY ALL) WHERE users >= 2)""")
def _(t):
    return rounded(P.presence_grid(P.latest_presence(t.presence)))


@query("presence_windows", "A15", f"""
    SELECT start_ms, lat_cell, lng_cell, count(*) AS users FROM (
        SELECT *, unnest(range(0, 10)) AS back FROM (SELECT t_ms, {_CELL} FROM (SELECT lat, lng, (ts_ms - 1704067200000) // 10000 AS t_ms FROM presence)))
    , LATERAL (SELECT (t_ms // 3000 - back) * 3000 AS start_ms) GROUP BY ALL HAVING count(*) >= 2""")
def _(t):
    """Cells of sliding 30 s windows every 3 s, over time compressed 10000-fold."""
    rows = t.presence.withColumn("ts_ms", F.floor((F.col("ts_ms") - 1704067200000) / 10000))
    w = rows.withColumn("w", F.window(F.timestamp_millis(F.col("ts_ms")), "30 seconds", "3 seconds")) \
        .withColumn("start_ms", F.unix_millis("w.start"))
    return P.presence_grid(w, ["start_ms"]).select("start_ms", "lat_cell", "lng_cell", "users")


@query("presence_validation", "P17", """
    SELECT CASE WHEN event_id % 11 = 0 THEN 'userId is required' WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN 'lat/lng must be finite numbers' END AS rejected,
           count(*) AS n, sum(CASE WHEN event_id % 5 = 0 THEN 99 ELSE event_id END)::BIGINT AS ts_sum FROM events GROUP BY 1""")
def _(t):
    e = F.col("event_id")
    raw = t.read("events").select(
        F.when(e % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("userId"),
        F.when(e % 7 == 0, "").when(e % 13 == 0, "abc").otherwise("1.3").alias("lat"), F.lit(" 103.8 ").alias("lng"),
        F.when(e % 5 == 0, "0").otherwise(e.cast("string")).alias("ts"), F.lit("gps").alias("source"))
    checked = P.checked_updates(raw, F.lit(99).cast("bigint"))
    return checked.groupBy("rejected").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("ts_sum"))


@query("dedupe_first", "W24 P19", """
    SELECT arrival, round(lat, 9) AS lat, round(lng, 9) AS lng FROM (SELECT *, row_number() OVER (PARTITION BY round(lat, 6), round(lng, 6) ORDER BY arrival) AS rn FROM presence) WHERE rn = 1""")
def _(t):
    return rounded(P.first_by_coordinates(t.presence.select("arrival", "lat", "lng"), "arrival"))


@query("viewport", "P36", """
    SELECT lat BETWEEN 1.302e0 AND 1.306e0 AND lng BETWEEN 103.802e0 AND 103.807e0 AS inside, count(*) AS n FROM presence GROUP BY 1""")
def _(t):
    return t.presence.groupBy(P.in_viewport(F.col("lat"), F.col("lng"), 1.302, 103.802, 1.306, 103.807).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


@query("distances", "P16", """
    SELECT arrival, round(2 * 6371000e0 * asin(sqrt(sin(radians(1.3043e0 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(1.3043e0)) * sin(radians(103.8318e0 - lng) / 2) ** 2)), 3) AS great_circle,
           round(sqrt(((1.3043e0 - lat) * 111320) ** 2 + ((103.8318e0 - lng) * 111320 * cos(radians((lat + 1.3043e0) / 2))) ** 2), 3) AS flat FROM presence""")
def _(t):
    here = (F.col("lat"), F.col("lng"), F.lit(1.3043), F.lit(103.8318))
    return t.presence.select("arrival", F.round(S.great_circle_m(*here), 3).alias("great_circle"), F.round(S.equirectangular_m(*here), 3).alias("flat"))


_SPOTS = """SELECT n_nationkey AS id, 1.25e0 + 0.008e0 * n_nationkey AS lat, 103.7e0 + 0.01e0 * n_nationkey AS lng, lower(r_name) AS planning_area,
            (n_nationkey % 10) / 10e0 AS intensity FROM nation JOIN region ON n_regionkey = r_regionkey"""


def hotspots(t):
    n = F.col("n_nationkey")
    return t.read("nation").join(F.broadcast(t.read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        n.alias("id"), (1.25 + 0.008 * n).alias("lat"), (103.7 + 0.01 * n).alias("lng"), F.lower("r_name").alias("planning_area"), ((n % 10) / 10.0).alias("intensity"))


@query("area_alerts", "A16 O03 P18", "SELECT upper(planning_area) AS planning_area, max(intensity) AS score FROM spots GROUP BY 1", views={"spots": _SPOTS})
def _(t):
    return P.area_alerts(hotspots(t)).orderBy(F.col("score").desc())


@query("area_influence", "J09 J10 P16 P09", """
    SELECT c_custkey, CASE WHEN band IS NOT NULL THEN band ELSE 0 END AS band, round(score, 9) AS score FROM (
        SELECT *, CASE WHEN score >= 0.85 THEN 5 WHEN score >= 0.7 THEN 4 WHEN score >= 0.55 THEN 3 WHEN score >= 0.4 THEN 2 WHEN score >= 0.25 THEN 1 ELSE 0 END AS band FROM (
            SELECT c.c_custkey, coalesce(max(a.score), greatest(0e0, least(1e0, sum(intensity * exp(-(d * d) / (2 * 2200e0 * 2200e0)))))) AS score FROM (
                SELECT c_custkey, name, intensity, 2 * 6371000e0 * asin(sqrt(sin(radians(s.lat - c.lat) / 2) ** 2
                       + cos(radians(c.lat)) * cos(radians(s.lat)) * sin(radians(s.lng - c.lng) / 2) ** 2)) AS d FROM centres c, spots s) c
            LEFT JOIN (SELECT upper(planning_area) AS name, max(intensity) AS score FROM spots GROUP BY 1) a ON a.name = c.name GROUP BY c.c_custkey))""", views={
        "spots": _SPOTS,
        "centres": """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'ASIA' ELSE 'AREA ' || c_nationkey END AS name, 1.25e0 + 0.0002e0 * (c_custkey % 1000) AS lat, 103.7e0 + 0.00025e0 * (c_custkey % 1000) AS lng FROM customer"""})
def _(t):
    k = F.col("c_custkey")
    areas = t.read("customer").select("c_custkey", F.when(k % 9 == 0, " asia ").otherwise(F.concat(F.lit("area "), F.col("c_nationkey").cast("string"))).alias("area_name"),
                                      (1.25 + 0.0002 * (k % 1000)).alias("lat"), (103.7 + 0.00025 * (k % 1000)).alias("lng"))
    scored = P.area_scores(areas, hotspots(t), P.area_alerts(hotspots(t)))
    return rounded(scored.select("c_custkey", S.heat_band(F.col("score"), K.CROWD_HEAT_BANDS).alias("band"), "score"))


@query("camera_first_n", "O04 P35", """
    SELECT camera_id, round(lat, 9) AS lat FROM (SELECT * FROM cameras ORDER BY feed_pos LIMIT 30) WHERE lat IS NOT NULL AND image_url IS NOT NULL""")
def _(t):
    return rounded(C.first_cameras(t.cameras, 30).select("camera_id", "lat"))


@query("camera_enriched", "J19 J18", f"""
    SELECT camera_id, CASE WHEN i.inferred_ms IS NULL THEN 'error' ELSE 'ok' END AS status, vehicle_count, inferred_ms
    FROM (SELECT * FROM cameras WHERE lat IS NOT NULL AND image_url IS NOT NULL) c LEFT JOIN (
        SELECT camera_id, arg_max(vehicle_count, inferred_ms) AS vehicle_count, max(inferred_ms) AS inferred_ms FROM inferences
        WHERE inferred_ms + {HALF_DAY} > (SELECT max(inferred_ms) FROM inferences) GROUP BY camera_id) i USING (camera_id)""")
def _(t):
    live = C.cached_inference(t.inferences, t.inferences.agg(F.max("inferred_ms")).first()[0], HALF_DAY, ["camera_id"])
    return C.enrich(t.cameras.filter(C.valid_camera()), live).select("camera_id", "status", "vehicle_count", "inferred_ms")


@query("camera_asof_inference", "J18 T09", f"""
    SELECT event_id AS snapshot_id, CASE WHEN ms - inferred_ms < {HALF_DAY} THEN vehicle_count END AS vehicle_count FROM (
        SELECT event_id, CAST(user_id % 100 + 1 AS VARCHAR) AS camera_id, (epoch_us(ts) // 1000) - 60000 AS ms FROM events) s
    ASOF LEFT JOIN inferences i ON s.camera_id = i.camera_id AND s.ms >= i.inferred_ms""")
def _(t):
    snaps = t.read("events").select(F.col("event_id").alias("snapshot_id"), (F.col("user_id") % 100 + 1).cast("string").alias("camera_id"),
                                    (millis("ts") - 60000).alias("ts_ms"))
    return C.asof_inference(snaps, t.inferences, ttl_ms=HALF_DAY).select("snapshot_id", "vehicle_count")


@query("system_metrics", "A30", f"""
    SELECT (SELECT count(*) FROM cameras WHERE lat IS NOT NULL AND image_url IS NOT NULL) AS working_cameras,
           (SELECT count(*) FROM latest WHERE (SELECT max(ts_ms) FROM presence) - ts_ms <= 30000) AS total_users, (SELECT max(ts_ms) FROM presence) AS generated_at""")
def _(t):
    return C.system_metrics(t.cameras, P.latest_presence(t.presence), _now(t))


METRIC_FOLD = """, fold AS (
    SELECT zone_id, rn, arrival, CASE WHEN value IS NOT NULL THEN ts END AS fetched, value AS last, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'live' END AS source
    FROM ordered WHERE rn = 1
    UNION ALL SELECT zone_id, rn, arrival, CASE WHEN good THEN ts ELSE fetched END, CASE WHEN good THEN value ELSE last END,
        CASE WHEN good THEN 'live' WHEN fetched IS NULL THEN 'unavailable' ELSE 'cache' END FROM (
        SELECT o.*, f.fetched, f.last, (f.fetched IS NULL OR o.ts - f.fetched > 45000) AND o.value IS NOT NULL AS good
        FROM fold f JOIN ordered o ON o.zone_id = f.zone_id AND o.rn = f.rn + 1))
    SELECT arrival, last AS last_value, fetched AS updated_at, source FROM fold"""
METRIC_VIEWS = {"ordered": """
        SELECT zone_id, arrival, ts, CASE WHEN conf IS NOT NULL THEN density END AS value, row_number() OVER (PARTITION BY zone_id ORDER BY ts, arrival) AS rn FROM perception"""}


@query("metric_staleness", "", METRIC_FOLD, recursive=True, views=METRIC_VIEWS)
def _(t):
    polls = t.perception.select("arrival", "zone_id", F.col("ts").alias("ts_ms"), F.when(F.col("conf").isNotNull(), F.col("density")).alias("value"))
    return C.metric_with_staleness(polls, ["zone_id"], ["ts_ms", "arrival"]).select("arrival", "last_value", "updated_at", "source")


@query("activity_profile", "P27 P28", """
    SELECT event_id, day, CASE WHEN day = 'weekday' THEN CASE WHEN h BETWEEN 7 AND 9 THEN 'morning-commute' WHEN h BETWEEN 17 AND 20 THEN 'evening-commute'
               WHEN h BETWEEN 12 AND 14 THEN 'lunch-peak' ELSE 'off-peak' END
           WHEN h BETWEEN 13 AND 21 THEN 'weekend-leisure-peak' ELSE 'weekend-off-peak' END AS profile,
           CASE event_type
             WHEN 'click' THEN CASE WHEN day = 'weekday' AND (h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 20) THEN 1.34e0 WHEN day = 'weekday' AND h BETWEEN 12 AND 14 THEN 1.07e0 ELSE 0.84e0 END
             WHEN 'view' THEN CASE WHEN day = 'weekend' AND h BETWEEN 13 AND 22 THEN 1.3e0 WHEN h BETWEEN 10 AND 22 THEN 1.12e0 ELSE 0.78e0 END
             WHEN 'purchase' THEN CASE WHEN h BETWEEN 12 AND 21 THEN CASE WHEN day = 'weekend' THEN 1.28e0 ELSE 1.16e0 END ELSE 0.74e0 END
             WHEN 'error' THEN CASE WHEN h BETWEEN 7 AND 10 THEN 1.2e0 WHEN h BETWEEN 17 AND 21 THEN 1.18e0 ELSE 0.9e0 END
             ELSE CASE WHEN h BETWEEN 18 AND 22 THEN 1.13e0 WHEN day = 'weekend' AND h BETWEEN 11 AND 20 THEN 1.12e0 ELSE 0.88e0 END END AS multiplier
    FROM (SELECT *, hour(ts) AS h, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day FROM events)""")
def _(t):
    kind = S.lookup(F.col("event_type"), {"click": "commute", "view": "tourism", "purchase": "shopping", "error": "transit"}, F.lit("residential"))
    return t.read("events").select("event_id", S.day_type(F.col("ts")).alias("day"), S.day_profile(F.col("ts")).alias("profile"),
                                   S.activity_multiplier(kind, F.col("ts")).alias("multiplier"))


@query("file_stems", "P21", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y%m%d_%H%M%S') WHEN 1 THEN strftime(ts, '%Y%m%d_%H%M%S') ELSE strftime(ts, '%Y%m%d_%H%M') || 'x' END || '_' || user_id AS stem FROM events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")) \
        .when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+08:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm'x'"))
    return t.read("events").select("event_id", S.file_stem(text, F.col("user_id").cast("string")).alias("stem"))


@query("data_url_bytes", "P22", "SELECT doc_id, octet_length(encode(text)) AS bytes, md5(text) AS digest FROM documents")
def _(t):
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    data = S.data_url_bytes(url)
    return t.read("documents").select("doc_id", F.octet_length(data).cast("bigint").alias("bytes"), F.md5(data).alias("digest"))


@query("geometry_paths", "P13 A27", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE 1 END AS paths, round(CASE WHEN s_suppkey % 4 <> 3 THEN s_nationkey + 0.5e0 END, 6) AS lat,
           round(CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey + 1e0 END, 6) AS lng FROM supplier""")
def _(t):
    """Squares around each supplier as GeoJSON, pipe list and WKT; the fourth form is broken on purpose."""
    x, y = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    x2, y2 = (F.col("s_suppkey") + 2).cast("string"), (F.col("s_nationkey") + 1).cast("string")
    corners = [(x, y), (x2, y), (x2, y2), (x, y2)]
    join = lambda form, sep: F.concat_ws(sep, *[F.format_string(form, a, b) for a, b in corners])
    kind = F.col("s_suppkey") % 4
    geojson = F.when(kind == 0, F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), join("[%s,%s]", ","), F.lit("]]}}"))) \
        .when(kind == 3, F.lit('{"type":"Polygon","coordinates":[[[1,2],[3'))
    shape = F.when(kind == 1, join("%s,%s", "|")).when(kind == 2, F.concat(F.lit("POLYGON (("), join("%s %s", ", "), F.lit("))")))
    records = t.read("supplier").select("s_suppkey", geojson.alias("geojson"), shape.alias("shape_text"))
    areas = P.boundary_areas(records.withColumn("area_name", F.col("s_suppkey").cast("string")))
    per = areas.groupBy(F.col("area_name").cast("bigint").alias("s_suppkey")).agg(F.count(F.lit(1)).cast("int").alias("paths"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    return rounded(records.select("s_suppkey").join(per, "s_suppkey", "left").withColumn("paths", F.coalesce("paths", F.lit(0))), 6)


@query("roi_text", "P14", """
    SELECT frame_id, line, l_partkey, l_suppkey, CASE WHEN line <> 3 THEN round((x2 - x1) * (y2 - y1), 4) END AS area FROM detections""")
def _(t):
    b = F.col("bbox")
    pair = lambda i, j: F.concat_ws(",", b[i].cast("string"), b[j].cast("string"))
    text = F.when(F.col("line") == 3, F.concat_ws(";", pair(0, 1), pair(2, 1), pair(2, 3))) \
        .otherwise(F.concat(pair(0, 1), F.lit("; "), pair(2, 1), F.lit(";"), pair(2, 3), F.lit(";"), pair(0, 3), F.lit(";")))
    d = t.detections.withColumn("polygon", G.roi_points(text))
    return d.select("frame_id", "line", "l_partkey", "l_suppkey", F.round(G.polygon_area(F.col("polygon")), 4).alias("area"))


@query("skip_existing", "S19", """
    SELECT substr(sha1('event-' || event_id), 1, 12) AS cache_key, event_id FROM events e WHERE NOT EXISTS (
        SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderstatus = 'O')""")
def _(t):
    from ..sources.catalogs import cache_key, not_yet_done
    rows = t.read("events").select("event_id", cache_key(F.concat(F.lit("event-"), F.col("event_id").cast("string"))).alias("cache_key"))
    finished = t.read("orders").filter("o_orderstatus = 'O'")
    return not_yet_done(rows, finished.select(cache_key(F.concat(F.lit("event-"), F.col("o_orderkey").cast("string"))).alias("cache_key")), "cache_key")
