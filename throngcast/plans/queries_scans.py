"""The remaining scans and sinks: given tables written in each external format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import graph, incidents as I, presence as P, risk as R, sampling, zones as Z
from ..session import run_folder
from ..sources import catalogs, readers, sinks
from ..streaming import streams
from .catalog import query, rounded


def _supplier() -> tuple[Column, Column]:
    return F.col("s_suppkey"), F.col("s_nationkey")


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _documents(t, name: str, rows: DataFrame, key: str, **parts: Column) -> str:
    """Folder with one JSON document per key, whose parts are aggregates of the key's rows."""
    path = run_folder(t.spark, name)
    made = rows.groupBy(key).agg(*[c.alias(n) for n, c in parts.items()])
    made.select(key, F.to_json(F.struct(*parts)).alias("value")).write.partitionBy(key).text(path)
    return path


def _all(**fields: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()])))


@query("zone_config_files", "S04", """
    SELECT 'S' || s_suppkey AS zone_id, CASE WHEN s_suppkey % 3 <> 0 THEN 10e0 + s_suppkey % 50 WHEN s_nationkey % 2 = 0 THEN 40e0 ELSE 25e0 END AS capacity,
           CASE WHEN s_nationkey % 2 = 0 THEN 1920 ELSE 320 END AS width, CASE WHEN s_nationkey % 2 = 0 THEN 1080 ELSE 240 END AS height, s_acctbal AS left_edge, s_acctbal + 10 AS right_edge
    FROM supplier""")
def _(t):
    """One zone file per nation, a zone per supplier; odd nations rely on the file's defaults, odd suppliers on the older id field."""
    number, nation = _supplier()
    even, x = nation % 2 == 0, F.col("s_acctbal").cast("double")
    corner = lambda a, b: F.array(a, F.lit(float(b)))
    name = _named("S", number)
    zones = _all(zoneId=F.when(number % 2 == 0, name), id=F.when(number % 2 == 1, name), capacity=F.when(number % 3 != 0, number % 50 + 10.0),
                 polygon=F.array(corner(x, 0), corner(x + 10, 0), corner(x + 10, 10)))
    path = _documents(t, "zones", t.read("supplier"), "s_nationkey", width=F.first(F.when(even, 1920)), height=F.first(F.when(even, 1080)),
                      defaultCapacity=F.first(F.when(even, 40.0)), zones=zones)
    xs = F.transform("polygon", lambda p: p["x"])
    return readers.zone_config(t.spark, path).select("zone_id", "capacity", "width", "height", F.array_min(xs).alias("left_edge"), F.array_max(xs).alias("right_edge"))


@query("zone_mapping_files", "S05", """
    SELECT m AS mapping, k AS key, v AS value FROM supplier, LATERAL (VALUES
        ('children', 'AZ' || (s_suppkey % 7), 'RZ' || s_suppkey), ('parents', 'RZ' || s_suppkey, 'AZ' || (s_suppkey % 7)), ('nodes', 'N' || s_suppkey, 'RZ' || s_suppkey),
        ('edges', 'E' || s_suppkey, 'RZ' || s_suppkey), ('capacities', 'RZ' || s_suppkey, CAST(10 + s_suppkey % 40 AS VARCHAR))) x(m, k, v)""")
def _(t):
    """One mapping file per nation."""
    number, nation = _supplier()
    zone, parent = _named("RZ", number), _named("AZ", number % 7)
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    rows = t.read("supplier").select("s_nationkey", "s_suppkey", zone.alias("zone"), parent.alias("parent"))
    rows = rows.groupBy("s_nationkey", "parent").agg(F.collect_list("zone").alias("zones"), F.collect_list("s_suppkey").alias("keys"))
    every = lambda make: F.map_from_entries(F.flatten(F.collect_list(F.transform("keys", make))))
    entry = lambda prefix, value: every(lambda k: F.struct(_named(prefix, k), value(k)))
    path = _documents(t, "mapping", rows, "s_nationkey", analysisToRouting=pairs(F.col("parent"), F.col("zones")), routingToAnalysis=entry("RZ", lambda k: _named("AZ", k % 7)),
                      nodeToRoutingZone=entry("N", lambda k: _named("RZ", k)), edgeToRoutingZone=entry("E", lambda k: _named("RZ", k)),
                      routingZoneCapacities=entry("RZ", lambda k: (k % 40 + 10).cast("int")))
    out = None
    for name, table in readers.zone_mapping(t.spark, path).items():
        key, value = table.columns
        part = table.select(F.lit(name).alias("mapping"), F.col(key).alias("key"), F.col(value).cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("map_files", "S06 G08", """
    SELECT 'edge' AS kind, 'E' || s_suppkey AS id, 'N' || s_suppkey AS a, 'N' || (s_suppkey + 25) AS b, s_acctbal AS value, s_suppkey % 3 = 0 AS one_way, s_suppkey % 5 = 0 AS blocked FROM supplier
    UNION ALL SELECT 'node', 'N' || s_suppkey, s_name, 'hall', s_acctbal, NULL, NULL FROM supplier
    UNION ALL SELECT 'exit', 'N' || min(s_suppkey), NULL, NULL, 0e0, NULL, NULL FROM supplier GROUP BY s_nationkey""")
def _(t):
    """One map per nation: suppliers as nodes, an edge from each, the first one as exit. Missing flags are false."""
    number, nation = _supplier()
    name, there, x = _named("N", number), _named("N", number + 25), F.col("s_acctbal").cast("double")
    nodes = _all(id=name, pos=F.struct(x.alias("x"), number.cast("double").alias("y")), label=F.col("s_name"), kind=F.lit("hall"))
    meta = F.struct(F.when(number % 3 == 0, True).alias("isOneWay"), F.when(number % 5 == 0, True).alias("isBlocking"))
    edges = F.collect_list(F.struct(_named("E", number).alias("id"), name.alias("from"), there.alias("to"), x.alias("length"), _named("Z", nation).alias("routingZoneId"), meta.alias("meta")))
    path = _documents(t, "maps", t.read("supplier"), "s_nationkey", mapId=F.first(_named("m", nation)), graph=F.struct(nodes.alias("nodes"), edges.alias("edges")),
                      exits=F.array(_named("N", F.min(number))))
    g = readers.map_graph(t.spark, path)
    none, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    shape = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[x.alias(n) for n, x in zip(("id", "a", "b", "value", "one_way", "blocked"), c)])
    return shape(g["edges"], "edge", *map(F.col, ("edge_id", "src", "dst", "length", "one_way", "blocked"))) \
        .unionByName(shape(g["nodes"], "node", *map(F.col, ("id", "label", "kind", "x")), flag, flag)) \
        .unionByName(shape(g["exits"], "exit", F.col("exit_id"), none, none, F.col("exit_ord").cast("double"), flag, flag))


_TAKEN = "'2024-01-01T00:00:' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0')"


def _feeds(t) -> str:
    """A camera feed per nation: a newest and an older item, or for every third nation the flat envelope."""
    number, nation = _supplier()
    taken = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((number % 60).cast("string"), 2, "0"))
    image = F.when(number % 13 == 0, " ").otherwise(_named(" http://cam/", number))
    flat = nation % 3 == 0
    camera = F.collect_list(F.when(~flat, F.struct(_named(" ", number).alias("camera_id"), image.alias("image"), F.when(number % 4 == 0, "").otherwise(taken).alias("timestamp"),
                                                   F.struct((number / 100).alias("latitude"), (number / 50).alias("longitude")).alias("location"))))
    item = lambda ts: F.struct(F.lit(ts).alias("timestamp"), camera.alias("cameras"))
    value = F.collect_list(F.when(flat, F.struct(number.cast("string").alias("CameraID"), image.alias("ImageLink"), taken.alias("Timestamp"))))
    return _documents(t, "feeds", t.read("supplier"), "s_nationkey", items=F.when(F.first(~flat), F.array(item("new"), item("old"))), value=F.when(F.first(flat), value))


@query("camera_feed_files", "S07", f"""
    SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE 'http://cam/' || s_suppkey END AS image_url,
           CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE {_TAKEN} END AS captured_at, round(s_suppkey / 100e0, 6) AS lat, round(s_suppkey / 50e0, 6) AS lng FROM supplier WHERE s_nationkey % 3 <> 0""")
def _(t):
    return rounded(readers.camera_feed(t.spark, _feeds(t)).select("camera_id", "image_url", "captured_at", "lat", "lng"), 6)


@query("camera_pictures", "S08 U02", f"""
    SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, 'http://cam/' || s_suppkey AS image_url, unnest(CASE WHEN s_nationkey % 3 = 0 THEN [{_TAKEN}] ELSE ['new', 'old'] END) AS captured_at
    FROM supplier WHERE s_suppkey % 13 <> 0""")
def _(t):
    return readers.camera_images(t.spark, _feeds(t)).select("camera_id", "image_url", "captured_at")


@query("url_files", "S10", """
    SELECT CASE o_orderkey % 3 WHEN 0 THEN 'alpha' ELSE 'beta' END AS source, 'http://v/' || o_orderkey AS url, o_clerk AS name FROM (
        SELECT o_orderkey, 'n' || o_custkey AS o_clerk FROM orders) WHERE o_orderkey % 3 <> 2 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def _(t):
    """A URL list of all orders with other sources, other schemes and blank names."""
    path, key = run_folder(t.spark, "urls"), F.col("o_orderkey")
    t.read("orders").select(
        F.when(key % 3 == 0, " Alpha ").when(key % 3 == 1, "beta").otherwise("gamma"),
        F.concat(F.when(key % 7 == 0, "ftp://v/").otherwise("http://v/"), key.cast("string")),
        F.when(key % 11 == 0, "  ").otherwise(_named("n", F.col("o_custkey")))).write.csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.url_list(t.spark, path, ["alpha", " Beta"]).select("source", "url", "name")


@query("search_page_files", "S12 U02", """
    SELECT (s_suppkey // 10) % 14 + 1 AS page, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'road' ELSE '' END AS address,
           CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey / 8e0 END AS lat, s_suppkey / 4e0 AS lng FROM supplier WHERE (s_suppkey // 10) % 14 + 1 <= 12""")
def _(t):
    """Result pages of ten suppliers; the announced last page is 13, the reader stops at 12."""
    number, nation = _supplier()
    rows = t.read("supplier").withColumn("page", F.floor(number / 10))
    text = lambda c: c.cast("string")
    results = _all(BUILDING=F.when(number % 3 == 0, F.col("s_name")), SEARCHVAL=F.col("s_name"), ROAD_NAME=F.when(number % 2 == 0, "road"),
                   LATITUDE=F.when(number % 9 == 0, "n/a").otherwise(text(number / 8)), LONGITUDE=F.when(number % 5 == 0, text(number / 4)), LONGTITUDE=text(number / 4))
    path = _documents(t, "search", rows, "page", pageNum=(F.first("page") % 14 + 1).cast("int"), totalNumPages=F.lit(13), results=results)
    return readers.search_pages(t.spark, path).select(F.col("position.pageNum").cast("bigint").alias("page"), "name", "address", "lat", "lng")


@query("boundary_files", "S13", """
    SELECT s_name AS area_name, CASE WHEN s_suppkey % 2 = 0 THEN '{"type":"Polygon","n":' || s_suppkey || '}' END AS geojson,
           CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || ',1|2,3|4,5' ELSE 'POLYGON ((' || s_suppkey || ' 1))' END AS shape_text FROM supplier""")
def _(t):
    number, nation = _supplier()
    shape = F.when(number % 3 == 0, F.concat(number.cast("string"), F.lit(",1|2,3|4,5")))
    records = _all(pln_area_n=F.col("s_name"), geojson=F.when(number % 2 == 0, F.format_string('{"type":"Polygon","n":%s}', number.cast("string"))),
                   LAT_LNG=shape, SHAPE=F.lit(" "), POLYGON=F.format_string("POLYGON ((%s 1))", number.cast("string")))
    return readers.boundary_records(t.spark, _documents(t, "areas", t.read("supplier"), "s_nationkey", SearchResults=records))


@query("presence_files", "S11", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_id AS ts, value AS lat FROM events WHERE event_id % 7 <> 0 AND event_id > 0""")
def _(t):
    """All events as presence updates in JSON lines, read as a stream and validated; every seventh has no usable coordinate."""
    path, e = run_folder(t.spark, "updates"), F.col("event_id")
    t.read("events").filter(e > 0).select(F.col("user_id").cast("string").alias("userId"), F.when(e % 7 == 0, "?").otherwise(F.col("value").cast("string")).alias("lat"),
                                          F.lit("103.8").alias("lng"), e.cast("string").alias("ts"), F.lit("gps").alias("source")).write.json(path)
    valid = P.checked_updates(readers.presence_updates(t.spark, path)).filter("rejected IS NULL").select("user_id", "ts", "lat")
    return streams.run_to_table(valid, "presence_files")


@query("labelled_images", "J16", "SELECT '/img/' || event_type || '/' || event_id || '.jpg' AS path FROM events WHERE event_id % 3 <> 0")
def _(t):
    e = F.col("event_id").cast("string")
    images = t.read("events").select(F.concat(F.lit("/img/"), "event_type", F.lit("/"), e, F.lit(".jpg")).alias("path"))
    labels = t.read("events").filter("event_id % 3 <> 0").select(F.concat(F.lit("/labels/"), e, F.lit(".txt")).alias("path"))
    return catalogs.labelled_images(images, labels).select("path")


@query("artifacts", "S14 O11", """
    SELECT 'last' AS what, max('/runs/' || (event_id % 50) || '/best' || event_id || '.pt') AS path FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT 'split', min('/data/v' || user_id % 5 || '/' || CASE user_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'training' ELSE 'my_train_set' END) FROM events WHERE user_id % 5 <= 2 GROUP BY user_id % 5""")
def _(t):
    """Newest artifact by path, and the train folder of three datasets: by name, by alias, by part of the name."""
    e, u = F.col("event_id").cast("string"), F.col("user_id") % 5
    runs = t.read("events").select(F.concat(F.lit("/runs/"), (F.col("event_id") % 50).cast("string"), F.lit("/best"), e,
                                            F.when(F.col("event_id") % 2 == 0, ".pt").otherwise(".log")).alias("path"))
    folder = F.when(u == 0, "train").when(u == 1, "training").otherwise("my_train_set")
    videos = t.read("events").select(F.concat(F.lit("/data/v"), u.cast("string"), F.lit("/"), folder, F.lit("/c"), e, F.lit(".mp4")).alias("path"))
    out = catalogs.last_artifact(runs, ".pt").select(F.lit("last").alias("what"), "path")
    for dataset in ("v0", "v1", "v2"):
        out = out.unionByName(catalogs.resolve_split(videos, "/data/", dataset, "train").select(F.lit("split").alias("what"), "path"))
    return out


@query("first_videos", "O08", """
    SELECT split, video FROM (SELECT split, video, row_number() OVER (PARTITION BY split ORDER BY n) AS rn FROM (
        SELECT DISTINCT o_orderstatus AS split, o_custkey AS n, 'v' || o_custkey AS video FROM orders)) WHERE rn <= 20""")
def _(t):
    videos = t.read("orders").select(F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("n"), _named("v", F.col("o_custkey")).alias("video")).distinct()
    return sampling.first_per_key(videos, ["split"], ["n"], 20).select("split", "video")


@query("changed_zones", "A38", "SELECT zone_id FROM deltas")
def _(t):
    return I.affected_zones(t.incidents)


@query("routing_density", "G06", "SELECT ts, zone_id, round(least(1e0, greatest(0e0, greatest(least(1e0, speed_mean), 1.5e0 * density))), 9) AS density FROM features")
def _(t):
    """Mean speed, cut at one, against motion occupancy."""
    density = graph.routing_density(F.least(F.lit(1.0), F.col("speed_mean")), F.col("occupancy"))
    return rounded(t.features.select("ts", "zone_id", density.alias("density")))


@query("run_files", "S16 S18 O07", """
    SELECT CAST(row_number() OVER (ORDER BY avg(value) DESC) AS INT) AS rank, event_type AS run, round(avg(value), 6) AS score, count(*) AS compared_pairs, (SELECT count(*) FROM events) AS rows
    FROM events GROUP BY event_type""")
def _(t):
    """The ranking as CSV and the run's record as JSON, both read back."""
    path, events = run_folder(t.spark, "runs"), t.read("events")
    mean = events.groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("compared_pairs"))
    sinks.write_ranking(mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score")))), f"{path}/ranking")    # one row per run
    sinks.write_record(t.spark, {"rows": events.count()}, f"{path}/record")
    record = t.spark.read.schema("rows BIGINT").json(f"{path}/record")
    back = t.spark.read.csv(f"{path}/ranking", header=True, schema="rank INT, run STRING, score DOUBLE, compared_pairs BIGINT")
    return rounded(back.crossJoin(F.broadcast(record)), 6)          # one record


@query("vehicle_detections", "P23 P33", """
    SELECT l_orderkey AS frame_id, l_linenumber AS line, l_partkey, CASE l_partkey % 9 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 4 END AS custom_id
    FROM lineitem WHERE l_partkey % 9 IN (1, 2, 3, 5, 7) AND l_suppkey % 4 <> 0""")
def _(t):
    """Detector classes from the part; every fourth supplier's boxes lack a corner."""
    box = F.when(F.col("l_suppkey") % 4 == 0, F.slice("bbox", 1, 3)).otherwise(F.col("bbox"))
    rows = t.detections.withColumns({"bbox": box, "class_id": F.col("l_partkey") % 9})
    return Z.vehicles(rows).select("frame_id", "line", "l_partkey", "custom_id")


@query("manual_overrides", "T05", """
    SELECT event_id, round(least(1e0, value / 100), 9) AS risk, abs(least(1e0, value / 100) - coalesce(z.risk, 0)) >= 0.01e0 AS changed
    FROM events e LEFT JOIN zone_avg z ON z.zone_id = 'AZ' || (e.user_id % 8 + 1)""")
def _(t):
    """Each event sets its zone's risk by hand; two zones have no current one."""
    current = R.fuse(t.perception).groupBy("zone_id").agg(F.avg("risk").alias("risk"))
    wanted = t.read("events").select("event_id", _named("AZ", F.col("user_id") % 8 + 1).alias("zone_id"), (F.col("value") / 100).alias("risk"))
    return rounded(R.manual_changes(wanted, current).select("event_id", "risk", "changed"))
