"""Scans and sinks over small files."""

import json

import pytest
from pyspark.sql import functions as F

from throngcast import constants as K
from throngcast.operators import metrics, presence, sampling, zones
from throngcast.sources import catalogs, readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_perception_round_trip(spark, tmp_path):
    frame = {"ts": 5, "zones": [{"zoneId": "AZ_N", "density": .28, "anomaly": .11, "conf": .9, "peopleCount": 3},
                                {"zoneId": "AZ_S", "density": .82, "anomaly": .26}]}
    put(tmp_path / "in" / "a.jsonl", json.dumps(frame) + "\n" + json.dumps({"ts": 6, "zones": []}))
    rows = readers.perception_rows(readers.perception_frames(spark, str(tmp_path / "in")))
    assert [(r.zone_id, r.conf) for r in rows.orderBy("zone_pos").collect()] == [("AZ_N", .9), ("AZ_S", None)]
    sinks.write_lines(sinks.frame_lines(rows), str(tmp_path / "out"))
    again = readers.perception_rows(readers.perception_frames(spark, str(tmp_path / "out")))
    assert again.drop("frame_id").collect() == rows.drop("frame_id").collect()


def test_feature_tables(spark, tmp_path):
    cols = ", ".join(f"CAST(1 AS DOUBLE) AS {c}" for c in K.FEATURE_COLUMNS)
    spark.sql(f"SELECT {cols}").write.parquet(str(tmp_path / "alpha.parquet"))
    spark.sql(f"SELECT {cols}, 'Beta ' AS dataset, 'train' AS split").write.parquet(str(tmp_path / "b.parquet"))
    both = readers.feature_tables(spark, [str(tmp_path / "alpha.parquet"), str(tmp_path / "b.parquet")])
    assert sorted(r.dataset for r in both.collect()) == ["Beta ", "alpha"]
    assert readers.filter_datasets(both, include=["beta"]).count() == 1
    assert readers.filter_datasets(both, exclude=["BETA"], whole_files=True).first().dataset == "alpha"
    spark.sql("SELECT 1 AS density").write.parquet(str(tmp_path / "c.parquet"))
    with pytest.raises(ValueError, match="speed_mean"):
        readers.feature_tables(spark, [str(tmp_path / "c.parquet")])
    sinks.write_features(both.withColumn("split", F.coalesce("split", F.lit("all"))), str(tmp_path / "out"))
    assert (tmp_path / "out" / "dataset=alpha" / "split=all").exists()


def test_zone_config(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4]]
    path = put(tmp_path / "z.json", {"zones": [{"id": "A", "polygon": square}, {"zoneId": "B", "capacity": 7, "polygon": square}]})
    got = readers.zone_config(spark, path).collect()
    assert [(z.zone_id, z.zone_ord, z.capacity, z.width) for z in got] == [("A", 0, 25.0, 320), ("B", 1, 7.0, 320)]
    bad = put(tmp_path / "bad.json", {"zones": [{"id": "A", "polygon": square[:2]}]})
    with pytest.raises(Exception, match="3 points"):
        readers.zone_config(spark, bad).collect()


def test_mapping_and_graph(spark, tmp_path):
    path = put(tmp_path / "m.json", {"analysisToRouting": {"AZ": ["Z1", "Z2"]}, "routingToAnalysis": {"Z1": "AZ", "Z2": "AZ"},
                                     "nodeToRoutingZone": {"N1": "Z1"}, "edgeToRoutingZone": {"E1": "Z2"}, "routingZoneCapacities": {"Z1": 60}})
    m = readers.zone_mapping(spark, path)
    assert {k: v.count() for k, v in m.items()} == {"children": 2, "parents": 2, "nodes": 1, "edges": 1, "capacities": 1}
    path = put(tmp_path / "g.json", {"graph": {"nodes": [{"id": "N1", "pos": {"x": 1, "y": 2}}], "edges": [
        {"id": "E1", "from": "N1", "to": "X", "length": 5, "routingZoneId": "Z1", "meta": {"isOneWay": True}}]}, "exits": ["X", "Y"]})
    g = readers.map_graph(spark, path)
    assert g["edges"].first().asDict() == {"edge_id": "E1", "src": "N1", "dst": "X", "length": 5.0, "zone_id": "Z1", "one_way": True, "blocked": False}
    assert [r.exit_id for r in g["exits"].orderBy("exit_ord").collect()] == ["X", "Y"]


def test_camera_feeds(spark, tmp_path):
    loc = {"latitude": 1.3, "longitude": 103.8}
    feed = {"items": [{"timestamp": "T0", "cameras": [{"camera_id": "1", "image": "http://a", "location": loc}, {"camera_id": "2", "image": " ", "timestamp": "T1"}]},
                      {"timestamp": "T9", "cameras": [{"camera_id": "3", "image": "http://c"}]}]}
    path = put(tmp_path / "f.json", feed)
    assert [(r.camera_id, r.captured_at) for r in readers.camera_feed(spark, path).orderBy("feed_pos").collect()] == [("1", "T0"), ("2", "T1")]
    assert sorted(r.camera_id for r in readers.camera_images(spark, path).collect()) == ["1", "3"]
    flat = put(tmp_path / "v.json", {"value": [{"CameraID": "9", "ImageLink": "http://z", "Timestamp": "T"}, {"CameraID": "", "ImageLink": "x"}]})
    assert [r.camera_id for r in readers.camera_images(spark, flat).collect()] == ["9"]


def test_clip_specs(spark, tmp_path):
    rows = ["v1.mp4;1;12.0;40;0;0;10;10;Alpha;s1;2.0", "v1.mp4;x;1;2;0;0;1;1;alpha;s1;1", "v1.mp4;1;1", "v1.mp4;11;0;5;0;0;1;1;alpha;s1;1", "w;1;0;5;0;0;1;1;other;s;1"]
    got = readers.clip_specs(spark, put(tmp_path / "c.csv", "\n".join(rows)), ["ALPHA"])
    assert sorted((r.start_frame, r.crop_number, r.class_name) for r in got.collect()) == [(0, "1", "class_11"), (12, "2", "turbulent_flow")]
    assert sampling.clip_selection(got, 1).first().start_frame == 0
    found, missing = catalogs.with_source_video(got, spark.createDataFrame([("alpha", "other.mp4")], "dataset string, video_name string"))
    assert found.count() == 0 and missing.first().missing == 2


def test_url_list_and_eval_log(spark, tmp_path):
    path = put(tmp_path / "u.csv", "a,http://1,n1\nb,http://2,n2\nA,ftp://3,n3\na,http://4, \na,https://5,n5\n")
    assert [r.name for r in readers.url_list(spark, path, ["a"]).orderBy("position").collect()] == ["n1", "n5"]
    assert [r.name for r in readers.url_list(spark, path, ["a"], 1).collect()] == ["n1"]
    log = "dataset, split, mean_anomaly, p95_anomaly\nmall, normal, 0.1, 0.2\nmall, crowded, 0.5, 0.9\nmall, normal, 0.2, 0.3\nnoise\na, b, c\n"
    put(tmp_path / "runs" / "contamination_1" / "eval.log", log)
    got = readers.eval_log(spark, str(tmp_path / "runs" / "*" / "eval.log"))
    assert sorted((r.run, r.split, r.mean_anomaly) for r in got.collect()) == [("contamination_1", "crowded", .5), ("contamination_1", "normal", .2)]
    ranked = metrics.run_scores(got)
    assert ranked.first().score == pytest.approx(.3 + .5 * .6)
    sinks.write_ranking(ranked, str(tmp_path / "rank"))
    assert spark.read.csv(str(tmp_path / "rank"), header=True).first().score == "0.600000"


def test_search_pages_and_boundaries(spark, tmp_path):
    for n in (1, 2, 3):
        put(tmp_path / "pages" / f"{n}.json", {"pageNum": n, "totalNumPages": 2, "results": [
            {"LATITUDE": "1.3000001", "LONGTITUDE": "103.8", "SEARCHVAL": f"p{n}", "ROAD_NAME": "R"}, {"LATITUDE": "x"}]})
    pages = readers.search_pages(spark, str(tmp_path / "pages"))
    assert pages.count() == 4
    first = presence.first_by_coordinates(pages, "position").collect()
    assert [(r.name, r.address) for r in first] == [("p1", "R")]
    geo = json.dumps({"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 2], [3, 4]], [[0, 0], [1, 1]]]]})
    path = put(tmp_path / "b.json", {"SearchResults": [{"pln_area_n": "A", "geojson": geo}, {"geojson": "{broken", "SHAPE": "1,2|3,4"},
                                                       {"LAT_LNG": "103.1,1.1|103.2,1.2|103.3,1.3"}]})
    areas = presence.boundary_areas(readers.boundary_records(spark, path)).orderBy("area_name").collect()
    assert [(a.area_name, len(a.path)) for a in areas] == [("A", 3), ("Planning Area", 3)]
    assert areas[1].lat == pytest.approx(1.2)


@pytest.mark.parametrize("split,want", [("train", "ds/Train"), ("fight", "ds/violence"), ("weird", "ds/deep/weird_b"), ("none", None)])
def test_split_resolution(spark, split, want):
    paths = ["/d/ds/Train/a.mp4", "/d/ds/violence/x.avi", "/d/ds/weird_a/readme.txt", "/d/ds/deep/weird_b/v.mp4", "/d/other/none/v.mp4"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = catalogs.resolve_split(files, "/d", "ds", split).first()
    assert (got and got.path) == (want and f"/d/{want}")


def test_pairs_and_artifacts(spark):
    images = spark.createDataFrame([(f"/i/{n}.jpg",) for n in range(12)], "path string")
    labels = spark.createDataFrame([(f"/l/{n}.txt",) for n in range(11)], "path string")
    assert catalogs.labelled_images(images, labels).count() == 11
    with pytest.raises(ValueError):
        catalogs.labelled_images(images, labels.limit(3))
    assert catalogs.last_artifact(images, ".jpg").first().path == "/i/9.jpg"


def test_default_zone_lookup(spark):
    boxes = [[106, 60], [105.5, 60], [106.5, 60], [320, 10], [-1, 5], [213, 120], [0, 239]]
    rows = [(i, [x, y, x, y]) for i, (x, y) in enumerate(map(lambda b: map(float, b), boxes))] + [(7, [1.0, 2.0, 3.0]), (8, None)]
    d = spark.createDataFrame(rows, "i int, bbox array<double>")
    got = {r.i: r.zone_id for r in zones.with_zone(d).collect()}
    assert [got[i] for i in range(9)] == ["AZ1", "AZ1", "AZ1", None, None, "AZ2", "AZ4", None, None]
