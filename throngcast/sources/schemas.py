"""Explicit schemas of all inputs; nothing is inferred from data."""

from pyspark.sql.types import DataType

_DDL = {
    "PERCEPTION_FRAME": """ts BIGINT, frameId STRING, zones ARRAY<STRUCT<zoneId: STRING, density: DOUBLE, anomaly: DOUBLE,
        conf: DOUBLE, peopleCount: INT>>""",
    "ZONE_CONFIG": """width INT, height INT, defaultCapacity DOUBLE, zones ARRAY<STRUCT<zoneId: STRING, id: STRING, name: STRING,
        capacity: DOUBLE, polygon: ARRAY<ARRAY<DOUBLE>>>>""",
    "ZONE_MAPPING": """analysisToRouting MAP<STRING, ARRAY<STRING>>, routingToAnalysis MAP<STRING, STRING>,
        nodeToRoutingZone MAP<STRING, STRING>, edgeToRoutingZone MAP<STRING, STRING>, routingZoneCapacities MAP<STRING, INT>""",
    "MAP_GRAPH": """mapId STRING, graph STRUCT<nodes: ARRAY<STRUCT<id: STRING, pos: STRUCT<x: DOUBLE, y: DOUBLE>, label: STRING, kind: STRING>>,
        edges: ARRAY<STRUCT<id: STRING, `from`: STRING, `to`: STRING, length: DOUBLE, routingZoneId: STRING,
            meta: STRUCT<width: DOUBLE, isAccessible: BOOLEAN, isOneWay: BOOLEAN, isBlocking: BOOLEAN>>>>, exits ARRAY<STRING>""",
    "CAMERA_FEED": """items ARRAY<STRUCT<timestamp: STRING, cameras: ARRAY<STRUCT<camera_id: STRING, image: STRING, timestamp: STRING,
        location: STRUCT<latitude: DOUBLE, longitude: DOUBLE>>>>>, value ARRAY<STRUCT<CameraID: STRING, ImageLink: STRING, Timestamp: STRING>>""",
    "SEARCH_PAGE": """pageNum INT, totalNumPages INT, results ARRAY<STRUCT<SEARCHVAL: STRING, BUILDING: STRING, NAME: STRING, ADDRESS: STRING,
        ROAD_NAME: STRING, POSTAL: STRING, LATITUDE: STRING, LONGITUDE: STRING, LONGTITUDE: STRING>>""",
    "BOUNDARIES": "SearchResults ARRAY<STRUCT<pln_area_n: STRING, geojson: STRING, LAT_LNG: STRING, SHAPE: STRING, POLYGON: STRING>>",
    "PRESENCE_UPDATE": "userId STRING, lat STRING, lng STRING, ts STRING, source STRING, kind STRING",
    "DETECTION": "frame_id BIGINT, det_id INT, bbox ARRAY<DOUBLE>, conf DOUBLE, label STRING, classId INT, className STRING",
    "INCIDENT": """incidentId STRING, ts BIGINT, mapId STRING, type STRING, severity STRING, loc STRUCT<zoneId: STRING>,
        routingImpact STRUCT<radius: DOUBLE, hazardPenalty: DOUBLE, isBlocking: BOOLEAN, affectedRoutingZoneIds: ARRAY<STRING>>, status STRING""",
}


def schema(name: str):
    return DataType.fromDDL(" ".join(_DDL[name].split()))
