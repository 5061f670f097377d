"""Scans of the input formats into the tables the operators take."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..functions.geometry import POINT
from .schemas import schema


def perception_frames(spark: SparkSession, path: str, streaming: bool = False, max_files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines, one perception frame each; the same for a batch or a stream of files."""
    if streaming:
        return spark.readStream.schema(schema("PERCEPTION_FRAME")).option("maxFilesPerTrigger", max_files_per_trigger).json(path)
    return spark.read.schema(schema("PERCEPTION_FRAME")).json(path)


def perception_rows(frames: DataFrame) -> DataFrame:
    """One row per frame and zone."""
    return frames.select("ts", F.col("frameId").alias("frame_id"), F.posexplode("zones").alias("zone_pos", "z")).select(
        "ts", "frame_id", "zone_pos", F.col("z.zoneId").alias("zone_id"), "z.density", "z.anomaly", "z.conf",
        F.col("z.peopleCount").alias("people_count"))


_PREDICTION = "ts long, frameId string, clipIndex long, predClassId int, "


def behaviour_rows(spark: SparkSession, path: str) -> DataFrame:
    """Behaviour lines, one per clip; label_risk or expected_risk is NULL where the line has the other."""
    lines = spark.read.schema(_PREDICTION + "predLabel string, predConf double, risk double, expectedRisk double").json(path)
    return lines.select("ts", F.col("frameId").alias("frame_id"), F.col("clipIndex").alias("clip_index"), F.col("predClassId").alias("pred_class_id"), F.col("predLabel").alias("pred_label"),
                        F.col("predConf").alias("pred_conf"), F.col("risk").alias("label_risk"), F.col("expectedRisk").alias("expected_risk"))


def debug_rows(spark: SparkSession, path: str) -> DataFrame:
    """Debug lines of an ensemble, one per clip."""
    lines = spark.read.schema(_PREDICTION + "behaviorLabel string, behaviorConf double, expectedRisk double, milScore double, paperMix double, milMix double, baseMix double").json(path)
    return lines.select("ts", F.col("frameId").alias("frame_id"), F.col("clipIndex").alias("clip_index"), F.col("predClassId").alias("pred_class_id"), F.col("behaviorLabel").alias("pred_label"),
                        F.col("behaviorConf").alias("pred_conf"), F.col("expectedRisk").alias("expected_risk"), F.col("milScore").alias("mil_score"), F.col("paperMix").alias("paper_mix"),
                        F.col("milMix").alias("mil_mix"), F.col("baseMix").alias("base_mix"))


def require_columns(df: DataFrame, required: list[str], what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def feature_tables(spark: SparkSession, paths: list[str], required: list[str] = K.FEATURE_COLUMNS) -> DataFrame:
    """Feature files as one table, columns matched by name; a file without ``dataset`` is named after itself."""
    parts = []
    for path in paths:
        df = require_columns(spark.read.parquet(path), required, path)
        if "dataset" not in df.columns:
            df = df.withColumn("dataset", F.lit(PurePosixPath(path).stem))
        parts.append(df.withColumn("source_file", F.lit(path)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def filter_datasets(rows: DataFrame, include: list[str] = (), exclude: list[str] = (), whole_files: bool = False) -> DataFrame:
    """Keep rows by dataset name (trimmed, any case), or whole files by whether any of their datasets matches."""
    name = F.lower(F.trim("dataset"))
    listed = lambda names: F.coalesce(name.isin([n.strip().lower() for n in names if n.strip()]), F.lit(False))
    if not whole_files:
        rows = rows.filter(listed(include)) if include else rows
        return rows.filter(~listed(exclude)) if exclude else rows
    files = rows.groupBy("source_file").agg(
        F.bool_or(listed(include) if include else F.lit(True)).alias("wanted"),
        F.bool_or(listed(exclude) if exclude else F.lit(False)).alias("unwanted")).filter("wanted AND NOT unwanted")
    return rows.join(F.broadcast(files.select("source_file")), "source_file", "left_semi")     # one row per file


def zone_config(spark: SparkSession, path: str) -> DataFrame:
    """Zones with order, capacity (own, file default, 25) and polygon; fewer than three points or no id is an error."""
    raw = spark.read.schema(schema("ZONE_CONFIG")).json(path, multiLine=True)
    rows = raw.select(F.coalesce("width", F.lit(K.FRAME_WIDTH)).alias("width"), F.coalesce("height", F.lit(K.FRAME_HEIGHT)).alias("height"),
                      "defaultCapacity", F.posexplode("zones").alias("zone_ord", "z"))
    zone = F.coalesce(F.nullif("z.zoneId", F.lit("")), F.nullif("z.id", F.lit("")))
    polygon = F.transform("z.polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    checked = lambda ok, value, text: F.when(ok, value).otherwise(F.raise_error(F.lit(text)).cast("string"))
    return rows.select(
        checked(zone.isNotNull(), zone, "zone entry without zoneId").alias("zone_id"), "zone_ord", F.col("z.name").alias("name"),
        F.coalesce("z.capacity", "defaultCapacity", F.lit(K.DEFAULT_CAPACITY)).alias("capacity"),
        F.when(F.size("z.polygon") >= 3, polygon)
        .otherwise(F.raise_error(F.lit("zone polygon needs at least 3 points")).cast(f"array<{POINT}>")).alias("polygon"), "width", "height")


def zone_mapping(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five maps as two-column tables."""
    raw = spark.read.schema(schema("ZONE_MAPPING")).json(path, multiLine=True)
    two = lambda column, key, value: raw.select(F.explode(column).alias(key, value))
    return {
        "children": two("analysisToRouting", "parent_id", "zones").select("parent_id", F.explode("zones").alias("routing_zone_id")),
        "parents": two("routingToAnalysis", "routing_zone_id", "parent_id"),
        "nodes": two("nodeToRoutingZone", "node", "routing_zone_id"),
        "edges": two("edgeToRoutingZone", "edge_id", "routing_zone_id"),
        "capacities": two("routingZoneCapacities", "routing_zone_id", "capacity"),
    }


def map_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    raw = spark.read.schema(schema("MAP_GRAPH")).json(path, multiLine=True)
    nodes = raw.select(F.inline("graph.nodes")).select("id", "pos.x", "pos.y", "label", "kind")
    edges = raw.select(F.explode("graph.edges").alias("e")).select(
        F.col("e.id").alias("edge_id"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.length",
        F.col("e.routingZoneId").alias("zone_id"), F.coalesce("e.meta.isOneWay", F.lit(False)).alias("one_way"),
        F.coalesce("e.meta.isBlocking", F.lit(False)).alias("blocked"))
    return {"nodes": nodes, "edges": edges, "exits": raw.select(F.posexplode("exits").alias("exit_ord", "exit_id"))}


def incidents(rows: DataFrame) -> DataFrame:
    """Nested incident records to the flat columns of the incident operators."""
    return rows.select(F.col("incidentId").alias("incident_id"), "ts", F.col("loc.zoneId").alias("zone_id"),
                       F.col("routingImpact.hazardPenalty").alias("hazard_penalty"), F.col("routingImpact.isBlocking").alias("is_blocking"),
                       F.col("routingImpact.affectedRoutingZoneIds").alias("affected_zone_ids"), "type", "severity", "status")


def camera_feed(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of the latest item (the first) of a feed, in feed order."""
    raw = spark.read.schema(schema("CAMERA_FEED")).json(path, multiLine=True)
    item = F.get("items", F.lit(0))
    return raw.select(item.alias("item")).select(F.col("item.timestamp").alias("item_ts"), F.posexplode("item.cameras").alias("feed_pos", "c")).select(
        F.trim("c.camera_id").alias("camera_id"), F.trim("c.image").alias("image_url"),
        F.coalesce(F.nullif("c.timestamp", F.lit("")), "item_ts").alias("captured_at"),
        F.col("c.location.latitude").alias("lat"), F.col("c.location.longitude").alias("lng"), "feed_pos")


def camera_images(spark: SparkSession, path: str) -> DataFrame:
    """Camera, picture and time of both feed envelopes, all items; blank ids or pictures are left out."""
    raw = spark.read.schema(schema("CAMERA_FEED")).json(path, multiLine=True)
    flat = raw.select(F.explode("value").alias("v")).select(
        F.trim("v.CameraID").alias("camera_id"), F.trim("v.ImageLink").alias("image_url"), F.trim("v.Timestamp").alias("captured_at"))
    nested = raw.filter("value IS NULL").select(F.explode("items").alias("i")).select(F.trim("i.timestamp").alias("captured_at"), F.explode("i.cameras").alias("c")) \
        .select(F.trim("c.camera_id").alias("camera_id"), F.trim("c.image").alias("image_url"), "captured_at")
    return flat.unionByName(nested).filter("camera_id <> '' AND image_url <> ''")


def clip_specs(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """Clip specifications, semicolon separated; rows that are short or do not parse drop out."""
    raw = spark.read.csv(path, sep=";", schema=", ".join(f"c{i} STRING" for i in range(11)))
    text = lambda i: F.trim(f"c{i}")
    real = lambda i: text(i).try_cast("double")
    whole = lambda i: F.when(S.finite(real(i)), F.expr(f"try_cast(try_cast(trim(c{i}) AS DOUBLE) AS INT)"))
    rows = raw.select(
        text(0).alias("video_name"), text(1).try_cast("int").alias("label"), whole(2).alias("start_frame"), whole(3).alias("end_frame"),
        real(4).alias("left_distance"), real(5).alias("top_distance"), real(6).alias("width"), real(7).alias("height"),
        F.lower(text(8)).alias("dataset"), text(9).alias("scene_number"), whole(10).alias("crop"))
    needed = ["label", "start_frame", "end_frame", "left_distance", "top_distance", "width", "height", "crop"]
    named = S.lookup(F.col("label"), dict(enumerate(K.CLASS_NAMES)), F.concat(F.lit("class_"), F.col("label").cast("string")))
    return rows.dropna(subset=needed).filter(F.col("dataset").isin([a.strip().lower() for a in allowed])) \
        .withColumn("crop_number", F.col("crop").cast("string")).withColumn("class_name", named).drop("crop")


def url_list(spark: SparkSession, path: str, allowed: list[str], first: int = 0) -> DataFrame:
    """source, url, name rows of an allow-list in file order; optionally only the first n."""
    raw = spark.read.csv(path, schema="source STRING, url STRING, name STRING")
    rows = raw.select(F.monotonically_increasing_id().alias("position"), F.lower(F.trim("source")).alias("source"), F.trim("url").alias("url"),
                      S.clean_text(F.col("name")).alias("name"))
    kept = rows.filter(F.col("source").isin([a.strip().lower() for a in allowed]) & F.col("url").startswith("http") & F.col("name").isNotNull())
    return kept.orderBy("position").limit(first) if first > 0 else kept


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Result pages up to the announced last page (at most 12), with position and usable coordinates."""
    raw = spark.read.schema(schema("SEARCH_PAGE")).json(path, multiLine=True)
    pages = raw.filter(F.col("pageNum") <= F.least(F.lit(K.PAGE_LIMIT), F.greatest(F.lit(1), F.coalesce("totalNumPages", F.lit(0)))))
    rows = pages.select("pageNum", F.posexplode("results").alias("pos", "r"))
    return rows.select(
        F.struct("pageNum", "pos").alias("position"), S.to_number(F.col("r.LATITUDE")).alias("lat"),
        S.to_number(S.first_filled(F.col("r.LONGITUDE"), F.col("r.LONGTITUDE"))).alias("lng"),
        F.coalesce(S.first_filled(F.col("r.BUILDING"), F.col("r.SEARCHVAL"), F.col("r.NAME"), F.col("r.POSTAL")), F.lit("Unknown location")).alias("name"),
        F.coalesce(S.first_filled(F.col("r.ADDRESS"), F.col("r.ROAD_NAME")), F.lit("")).alias("address"))


def boundary_records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schema("BOUNDARIES")).json(path, multiLine=True)
    return raw.select(F.inline("SearchResults")).select(
        F.col("pln_area_n").alias("area_name"), "geojson", S.first_filled(F.col("LAT_LNG"), F.col("SHAPE"), F.col("POLYGON")).alias("shape_text"))


def presence_updates(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema("PRESENCE_UPDATE")).option("maxFilesPerTrigger", max_files_per_trigger).json(path)


def eval_log(spark: SparkSession, path: str) -> DataFrame:
    """dataset, split, mean, p95 lines; header and other lines are skipped, the last of equal keys wins."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), F.split("value", ",").alias("p"),
                                         F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("run")).filter("size(p) = 4")
    rows = lines.select("position", "run", F.trim(F.col("p")[0]).alias("dataset"), F.trim(F.col("p")[1]).alias("split"),
                        F.trim(F.col("p")[2]).try_cast("double").alias("mean_anomaly"), F.trim(F.col("p")[3]).try_cast("double").alias("p95_anomaly"))
    last = rows.dropna(subset=["mean_anomaly", "p95_anomaly"]).groupBy("run", "dataset", "split") \
        .agg(F.max_by(F.struct("mean_anomaly", "p95_anomaly"), "position").alias("e"))
    return last.select("run", "dataset", "split", "e.*")
