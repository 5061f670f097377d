"""The domain tables derived from the given tables: once as DataFrames, once as SQL for the comparison engine."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

EPOCH_MS = 1704067200000


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def k_value() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("double")


class Tables:
    """The given parquet tables and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def perception(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("arrival"), F.floor((millis("ts") - EPOCH_MS) / 1000).cast("bigint").alias("ts"),
            F.concat(F.lit("AZ"), (F.col("user_id") % 6 + 1).cast("string")).alias("zone_id"),
            F.least(F.lit(1.0), F.col("value") / 100).alias("density"), (k_value() / 100).alias("anomaly"),
            F.when(F.col("event_type") == "signup", None).when(F.col("event_type") == "error", 0.6)
            .when(F.col("event_type") == "view", 0.8).otherwise(0.95).alias("conf"), "user_id")

    @cached_property
    def risk_cycle(self) -> DataFrame:
        phase = F.floor(F.col("ts") / 20000) % 4
        level = F.when(phase == 0, 0.15).when(phase == 2, 0.95).otherwise(0.5)
        risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), level + 0.2 * (F.col("density") - 0.43)))
        return self.perception.select("arrival", "ts", "zone_id", risk.alias("risk_raw"))

    @cached_property
    def routing_zones(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.read("nation").select(
            F.concat(F.lit("Z"), n.cast("string")).alias("routing_zone_id"),
            F.concat(F.lit("AZ"), (n % 7 + 1).cast("string")).alias("parent_id"), (50 + 5 * n).alias("capacity"))

    @cached_property
    def incidents(self) -> DataFrame:
        zone = lambda shift: F.concat(F.lit("Z"), ((F.col("user_id") + shift) % 25).cast("string"))
        e = F.col("event_id")
        return self.read("events").filter("event_type = 'error'").select(
            e.alias("incident_id"), millis("ts").alias("ts"), zone(0).alias("zone_id"),
            F.when(F.col("value") > 200, 9999.0).when(F.col("value") > 50, F.col("value")).alias("hazard_penalty"),
            F.when(e % 3 == 0, F.array(zone(1), zone(2)))
            .when((e % 3 == 1) & (e % 5 == 0), F.array().cast("array<string>")).alias("affected_zone_ids"))

    @cached_property
    def edges(self) -> DataFrame:
        """5x5 grid over the nations."""
        a = F.col("n_nationkey").cast("int")
        n = self.read("nation").select(a.alias("a"), F.filter(F.array(
            F.when(a % 5 < 4, a + 1), F.when(a < 20, a + 5)), lambda b: b.isNotNull()).alias("next"))
        return n.select("a", F.explode("next").alias("b")).select(
            F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("edge_id"),
            F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"),
            (100.0 + 10 * (F.col("a") % 3)).alias("length"), F.concat(F.lit("Z"), F.col("a").cast("string")).alias("zone_id"),
            ((7 * F.col("a") + F.col("b")) % 11 == 0).alias("one_way"))

    @cached_property
    def exits(self) -> DataFrame:
        return self.spark.createDataFrame([("0", 0), ("24", 1)], "exit_id string, exit_ord int")

    @cached_property
    def detections(self) -> DataFrame:
        x1, y1 = F.col("l_extendedprice") % 300, 4.3 * F.col("l_quantity")
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey",
            F.array(x1, y1, x1 + 10 + F.col("l_partkey") % 30, y1 + 20 + F.col("l_suppkey") % 25).alias("bbox"),
            (0.5 + 5 * F.col("l_discount")).alias("conf"),
            F.when(F.col("l_returnflag") == "A", "person").when(F.col("l_returnflag") == "N", "vehicle")
            .otherwise("head").alias("label"))

    @cached_property
    def flow_samples(self) -> DataFrame:
        ship = F.col("l_shipdate").cast("timestamp")
        return self.read("lineitem").select(
            (F.year(ship) * 12 + F.month(ship)).cast("bigint").alias("frame_id"),
            F.concat(F.lit("AZ"), (F.col("l_suppkey") % 6 + 1).cast("string")).alias("zone_id"),
            ((F.col("l_quantity") - 25) / 10 + F.col("l_extendedprice") / 1e7).alias("u"), ((100 * F.col("l_discount") - 5) / 5).alias("v"),
            F.col("l_tax").alias("divergence"), (F.col("l_tax") * F.col("l_quantity") / 10).alias("turbulence"))

    @cached_property
    def presence(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("arrival"), F.col("user_id").cast("string").alias("user_id"),
            (1.30 + 0.0009 * (F.col("user_id") % 12)).alias("lat"),
            (103.80 + 0.0011 * (F.col("user_id") % 10) + 0.00001 * k_value()).alias("lng"),
            millis("ts").alias("ts_ms"), (F.col("event_type") == "signup").alias("offline"))

    @cached_property
    def cameras(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            key.cast("string").alias("camera_id"), key.alias("feed_pos"),
            F.when(key % 17 != 0, 1.25 + 0.001 * key).alias("lat"), (103.6 + 0.002 * key).alias("lng"),
            F.when(key % 13 != 0, F.concat(F.lit("http://cam/"), key.cast("string"))).alias("image_url"))

    @cached_property
    def inferences(self) -> DataFrame:
        return self.read("events").select(
            (F.col("user_id") % 100 + 1).cast("string").alias("camera_id"), millis("ts").alias("inferred_ms"),
            F.floor("value").cast("bigint").alias("vehicle_count"))

    @cached_property
    def frame_scores(self) -> DataFrame:
        from ..operators.ordered import with_row_index
        rows = self.read("events").select(
            F.col("event_type").alias("video"), millis("ts").alias("ms"), "event_id", F.col("value").alias("motion"),
            k_value().alias("brightness"), (F.col("value") - F.floor("value")).alias("edge"))
        return with_row_index(rows, ["video"], ["ms", "event_id"], "frame_idx").drop("ms", "event_id")

    @cached_property
    def eval_rows(self) -> DataFrame:
        o = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")) \
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return o.select("o_orderkey", F.col("r_name").alias("dataset"),
                        F.when(F.col("o_orderstatus") == "F", "normal").otherwise("abnormal").alias("split"),
                        F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("anomaly"))

    @cached_property
    def clip_vectors(self) -> DataFrame:
        """Class probabilities: all components, their sizes summed by position modulo the number of classes."""
        size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
        of_class = lambda k: F.filter(size, lambda _, i: i % 11 == k)
        dims = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.aggregate(of_class(k), F.lit(0.0), lambda acc, x: acc + x))
        total = F.aggregate(dims, F.lit(0.0), lambda acc, x: acc + x)
        return self.read("embeddings").select(
            F.floor(F.col("vec_id") / 16).alias("video"), F.col("vec_id").alias("clip_idx"), "label", "embedding",
            F.transform(dims, lambda x: x / total).alias("probs"))

    @cached_property
    def video_frames(self) -> DataFrame:
        """Decoded frames of four videos."""
        o = F.col("o_orderkey")
        return self.read("orders").select(F.concat(F.lit("V"), (o % 4).cast("string")).alias("video"), F.floor(o / 4).cast("bigint").alias("frame_idx"),
                                          F.concat(F.lit("d"), (o % 2).cast("string")).alias("dataset"), F.when(o % 4 < 2, "train").otherwise("test").alias("split"))

    @cached_property
    def video_detections(self) -> DataFrame:
        f = F.col("frame_id")
        return self.detections.select(F.concat(F.lit("V"), (f % 4).cast("string")).alias("video"), F.floor(f / 4).cast("bigint").alias("frame_idx"), "bbox", "conf", "label")

    @cached_property
    def video_flow(self) -> DataFrame:
        """Motion fields every eighth frame, three frames late, so fewer than the frames looked at and between them."""
        k = F.col("l_orderkey")
        return self.read("lineitem").select(
            F.concat(F.lit("V"), (k % 4).cast("string")).alias("video"), (F.floor(F.floor(k / 4) / 8) * 8 + 3).cast("bigint").alias("frame_idx"),
            F.concat(F.lit("AZ"), (F.col("l_suppkey") % 6 + 1).cast("string")).alias("zone_id"),
            ((F.col("l_quantity") - 25) / 10 + F.col("l_extendedprice") / 1e7).alias("u"), ((100 * F.col("l_discount") - 5) / 5).alias("v"),
            F.col("l_tax").alias("divergence"), (F.col("l_tax") * F.col("l_quantity") / 10).alias("turbulence"))

    @cached_property
    def video_clips(self) -> DataFrame:
        """Clip vectors dealt to the videos; every third starts four frames late, so clips overlap the next one's first frames."""
        c = F.col("clip_idx")
        return self.clip_vectors.select(F.concat(F.lit("V"), (c % 4).cast("string")).alias("video"), F.floor(c / 4).cast("bigint").alias("clip_index"),
                                        (F.floor(c / 4) * 16 + F.when(F.floor(c / 4) % 3 == 0, 4).otherwise(0)).cast("bigint").alias("start_frame"), "probs", "embedding")

    @cached_property
    def features(self) -> DataFrame:
        """Zone features per monthly frame, as one video."""
        from ..operators import motion
        f = motion.zone_features(self.flow_samples)
        # extracted once, then used as a stored table, as the feature files are
        return cut_lineage(f.withColumnRenamed("frame_id", "ts").withColumn("density", F.col("occupancy")))


# The same views as SQL. Doubles carry an exponent, since bare decimals would be DECIMAL.
SQL = {
    "perception": """
        SELECT event_id AS arrival, CAST(floor(((epoch_us(ts) // 1000) - 1704067200000) / 1000e0) AS BIGINT) AS ts,
               'AZ' || (user_id % 6 + 1) AS zone_id, least(1e0, value / 100) AS density,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS anomaly,
               CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 0.6e0 WHEN 'view' THEN 0.8e0 ELSE 0.95e0 END AS conf,
               user_id
        FROM events""",
    "risk_cycle": """
        SELECT arrival, ts, zone_id,
               greatest(0e0, least(1e0, CASE (ts // 20000) % 4 WHEN 0 THEN 0.15e0 WHEN 2 THEN 0.95e0 ELSE 0.5e0 END
                                        + 0.2e0 * (density - 0.43e0))) AS risk_raw
        FROM perception""",
    "fused": """
        SELECT *, CASE WHEN conf IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0,
               (0.6e0 * density + 0.4e0 * anomaly) * greatest(0e0, least(1e0, conf)))) END AS risk FROM perception""",
    "zone_avg": "SELECT zone_id, avg(risk) AS risk FROM fused GROUP BY zone_id",
    "routing_zones": """
        SELECT 'Z' || n_nationkey AS routing_zone_id, 'AZ' || (n_nationkey % 7 + 1) AS parent_id,
               50 + 5 * n_nationkey AS capacity FROM nation""",
    "incidents": """
        SELECT event_id AS incident_id, (epoch_us(ts) // 1000) AS ts, 'Z' || (user_id % 25) AS zone_id,
               CASE WHEN value > 200 THEN 9999e0 WHEN value > 50 THEN value END AS hazard_penalty,
               CASE WHEN event_id % 3 = 0 THEN ['Z' || ((user_id + 1) % 25), 'Z' || ((user_id + 2) % 25)]
                    WHEN event_id % 3 = 1 AND event_id % 5 = 0 THEN CAST([] AS VARCHAR[]) END AS affected
        FROM events WHERE event_type = 'error'""",
    "deltas": """
        SELECT zone_id, sum(penalty) AS local_delta, count(*) AS incidents FROM (
            SELECT unnest(coalesce(affected, [zone_id])) AS zone_id, coalesce(hazard_penalty, 40e0) AS penalty FROM incidents)
        GROUP BY zone_id""",
    "edges": """
        SELECT a || '-' || b AS edge_id, CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst,
               100e0 + 10 * (a % 3) AS length, 'Z' || a AS zone_id, (7 * a + b) % 11 = 0 AS one_way
        FROM (SELECT n_nationkey AS a, unnest([n_nationkey + 1, n_nationkey + 5]) AS b, n_nationkey % 5 AS col FROM nation)
        WHERE (b = a + 1 AND col < 4) OR (b = a + 5 AND a < 20)""",
    "costed": """
        SELECT edge_id, src, dst, length, zone_id, cost FROM (
            SELECT e.*, greatest(0e0, length * 1.15e0 * (1 + 2 * greatest(0e0, coalesce(l.load_ratio, 1e0) - 1))
                   + 80 * coalesce(r.risk, 0e0) + coalesce(d.local_delta, 0e0)) AS cost, coalesce(d.local_delta, 0e0) AS delta
            FROM edges e LEFT JOIN zone_risk r USING (zone_id) LEFT JOIN small_deltas d USING (zone_id)
            LEFT JOIN zone_load l USING (zone_id)) WHERE delta < 9999""",
    "arcs": """
        SELECT edge_id, src, dst, zone_id, length, cost FROM costed
        UNION ALL SELECT c.edge_id, c.dst, c.src, c.zone_id, c.length, c.cost FROM costed c JOIN edges e USING (edge_id)
        WHERE NOT e.one_way""",
    "zone_risk": """
        SELECT routing_zone_id AS zone_id, coalesce(a.risk, 0e0) AS risk FROM routing_zones z
        LEFT JOIN zone_avg a ON a.zone_id = z.parent_id""",
    "small_deltas": "SELECT zone_id, local_delta / incidents * 25 AS local_delta FROM deltas",
    "zone_load": """
        SELECT 'Z' || n AS zone_id, users / capacity AS load_ratio FROM (
            SELECT user_id % 25 AS n, count(DISTINCT user_id) * 15e0 AS users FROM events GROUP BY 1)
        JOIN routing_zones ON routing_zone_id = 'Z' || n""",
    "detections": """
        SELECT *, CAST(round_even(0.5e0 * (x1 + x2), 0) AS BIGINT) AS cx, CAST(round_even(0.5e0 * (y1 + y2), 0) AS BIGINT) AS cy
        FROM (SELECT *, x1 + 10 + l_partkey % 30 AS x2, y1 + 20 + l_suppkey % 25 AS y2 FROM (
            SELECT l_orderkey AS frame_id, l_linenumber AS line, l_partkey, l_suppkey,
                   l_extendedprice % 300 AS x1, 4.3e0 * l_quantity AS y1, 0.5e0 + 5 * l_discount AS conf,
                   CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'vehicle' ELSE 'head' END AS label FROM lineitem))""",
    "zones": """
        SELECT * FROM (VALUES ('AZ1', 0, 0, 0, 106, 120), ('AZ2', 1, 106, 0, 213, 120), ('AZ3', 2, 213, 0, 320, 120),
            ('AZ4', 3, 0, 120, 106, 240), ('AZ5', 4, 106, 120, 213, 240), ('AZ6', 5, 213, 120, 320, 240))
            t(zone_id, zone_ord, zx0, zy0, zx1, zy1)""",
    "located": """
        SELECT d.*, (SELECT min_by(z.zone_id, z.zone_ord) FROM zones z WHERE d.cx BETWEEN z.zx0 AND z.zx1
            AND d.cy BETWEEN z.zy0 AND z.zy1 AND d.cx >= 0 AND d.cx < 320 AND d.cy >= 0 AND d.cy < 240) AS zone_id
        FROM detections d""",
    "flow_samples": """
        SELECT year(l_shipdate) * 12 + month(l_shipdate) AS frame_id, 'AZ' || (l_suppkey % 6 + 1) AS zone_id,
               (l_quantity - 25) / 10 + l_extendedprice / 1e7 AS u, (100 * l_discount - 5) / 5 AS v, l_tax AS divergence,
               l_tax * l_quantity / 10 AS turbulence FROM lineitem""",
    "moving": """
        SELECT frame_id, zone_id, divergence, turbulence, sqrt(u * u + v * v) AS magnitude,
               CASE WHEN atan2(v, u) < 0 THEN atan2(v, u) + 2 * pi() ELSE atan2(v, u) END AS direction FROM (
            SELECT f.frame_id, zone_id, divergence, turbulence, u - mu AS u, v - mv AS v FROM flow_samples f JOIN (
                SELECT frame_id, quantile_cont(u, 0.5) AS mu, quantile_cont(v, 0.5) AS mv FROM flow_samples GROUP BY frame_id) m
            ON f.frame_id = m.frame_id)""",
    "active_samples": """
        SELECT * EXCLUDE (strong, n_strong), CASE WHEN n_strong < 16 THEN magnitude >= 0.2e0 ELSE strong END AS active FROM (
            SELECT *, count(*) FILTER (strong) OVER (PARTITION BY frame_id, zone_id) AS n_strong FROM (
                SELECT m.*, magnitude >= greatest(0.2e0, q) AS strong FROM moving m JOIN (
                    SELECT frame_id, zone_id, quantile_cont(magnitude, 0.75) AS q FROM moving GROUP BY ALL) USING (frame_id, zone_id)))""",
    "features": """
        SELECT frame_id AS ts, zone_id, samples, active_samples, speed_mean, speed_var, coalesce(entropy, 0e0) + 0e0 AS dir_entropy,
               divergence, turbulence, active_samples / CAST(samples AS DOUBLE) AS density FROM (
            SELECT frame_id, zone_id, count(*) AS samples, count(*) FILTER (active) AS active_samples,
                   coalesce(avg(magnitude) FILTER (active), 0e0) AS speed_mean,
                   coalesce(var_pop(magnitude) FILTER (active), 0e0) AS speed_var,
                   coalesce(avg(divergence) FILTER (active), 0e0) AS divergence,
                   coalesce(avg(turbulence) FILTER (active), 0e0) AS turbulence
            FROM active_samples GROUP BY ALL) LEFT JOIN (
            SELECT frame_id, zone_id, -sum(n / total * ln(n / total)) / ln(8e0) AS entropy FROM (
                SELECT *, sum(n) OVER (PARTITION BY frame_id, zone_id) AS total FROM (
                    SELECT frame_id, zone_id, least(7, floor(direction / (2 * pi() / 8))) AS bin, CAST(count(*) AS DOUBLE) AS n
                    FROM active_samples WHERE active GROUP BY ALL)) GROUP BY ALL) USING (frame_id, zone_id)""",
    "norms": """
        SELECT f.*, speed_mean AS s, turbulence AS t, density * (speed_mean + 0.5e0 * turbulence) AS p,
               quantile_cont(speed_mean, 0.05) OVER w AS s5, quantile_cont(speed_mean, 0.95) OVER w AS s95,
               quantile_cont(turbulence, 0.05) OVER w AS t5, quantile_cont(turbulence, 0.95) OVER w AS t95,
               quantile_cont(density * (speed_mean + 0.5e0 * turbulence), 0.05) OVER w AS p5,
               quantile_cont(density * (speed_mean + 0.5e0 * turbulence), 0.95) OVER w AS p95
        FROM features f WINDOW w AS (PARTITION BY ts)""",
    "normed": """
        SELECT ts, zone_id, density, dir_entropy,
               CASE WHEN s95 <= s5 THEN 0e0 ELSE greatest(0e0, least(1e0, (s - s5) / (s95 - s5))) END AS sn,
               CASE WHEN t95 <= t5 THEN 0e0 ELSE greatest(0e0, least(1e0, (t - t5) / (t95 - t5))) END AS tn,
               CASE WHEN p95 <= p5 THEN 0e0 ELSE greatest(0e0, least(1e0, (p - p5) / (p95 - p5))) END AS pn FROM norms""",
    "fallback": """
        SELECT ts, zone_id, greatest(0e0, least(1e0, 0.45e0 * dir_entropy + 0.35e0 * tn + 0.2e0 * pn)) AS anomaly_raw FROM normed""",
    "activity": """
        SELECT ts, zone_id, CAST(count(*) OVER (PARTITION BY ts) AS DOUBLE) AS zones_at_ts,
               CASE WHEN sum(a) OVER (PARTITION BY ts) <= 1e-6 THEN 1e0 / count(*) OVER (PARTITION BY ts)
                    ELSE a / sum(a) OVER (PARTITION BY ts) END AS weight FROM (
            SELECT ts, zone_id, least(1e0, 0.6e0 * least(1e0, density)
                   + 0.4e0 * least(1e0, 0.4e0 * sn + 0.4e0 * tn + 0.2e0 * dir_entropy)) AS a FROM normed)""",
    "presence": """
        SELECT event_id AS arrival, CAST(user_id AS VARCHAR) AS user_id, 1.30e0 + 0.0009e0 * (user_id % 12) AS lat,
               103.80e0 + 0.0011e0 * (user_id % 10) + 0.00001e0 * CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS lng,
               (epoch_us(ts) // 1000) AS ts_ms, event_type = 'signup' AS offline FROM events""",
    "latest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival DESC) AS rn FROM presence)
        WHERE rn = 1 AND NOT offline""",
    "cameras": """
        SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, s_suppkey AS feed_pos,
               CASE WHEN s_suppkey % 17 <> 0 THEN 1.25e0 + 0.001e0 * s_suppkey END AS lat, 103.6e0 + 0.002e0 * s_suppkey AS lng,
               CASE WHEN s_suppkey % 13 <> 0 THEN 'http://cam/' || s_suppkey END AS image_url FROM supplier""",
    "inferences": """
        SELECT CAST(user_id % 100 + 1 AS VARCHAR) AS camera_id, (epoch_us(ts) // 1000) AS inferred_ms,
               CAST(floor(value) AS BIGINT) AS vehicle_count FROM events""",
    "frame_scores": """
        SELECT event_type AS video, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) - 1 AS frame_idx,
               value AS motion, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS brightness,
               value - floor(value) AS edge FROM events""",
    "windows": """
        SELECT video, window_index, avg(motion) AS motion_mean, stddev_pop(motion) AS motion_std, max(motion) AS motion_max,
               quantile_cont(motion, 0.9) AS motion_p90, avg(jerk) AS jerk_mean, max(jerk) AS jerk_max,
               avg(brightness) AS bright_mean, stddev_pop(brightness) AS bright_std, avg(edge) AS edge_mean,
               stddev_pop(edge) AS edge_std, window_index * 10 / 5e0 AS start_sec, (window_index + 1) * 10 / 5e0 AS end_sec FROM (
            SELECT *, frame_idx // 10 AS window_index,
                   abs(motion - lag(motion) OVER (PARTITION BY video, frame_idx // 10 ORDER BY frame_idx)) AS jerk FROM frame_scores)
        GROUP BY video, window_index HAVING count(*) = 10""",
    "weak": """
        SELECT w.*, 0.5e0 * (motion_max - m1) / s1 + 0.25e0 * (jerk_mean - m2) / s2 + 0.25e0 * (motion_std - m3) / s3 AS weak_score
        FROM windows w, (SELECT avg(motion_max) AS m1, greatest(stddev_pop(motion_max), 1e-6) AS s1, avg(jerk_mean) AS m2,
            greatest(stddev_pop(jerk_mean), 1e-6) AS s2, avg(motion_std) AS m3, greatest(stddev_pop(motion_std), 1e-6) AS s3 FROM windows)""",
    "eval_rows": """
        SELECT o_orderkey, r_name AS dataset, CASE o_orderstatus WHEN 'F' THEN 'normal' ELSE 'abnormal' END AS split,
               least(1e0, o_totalprice / 500000) AS anomaly
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "clip_vectors": """
        SELECT vec_id // 16 AS video, vec_id AS clip_idx, label, embedding,
               list_transform(dims, lambda x: x / total) AS probs FROM (
            SELECT *, list_reduce(dims, lambda a, x: a + x, 0e0) AS total FROM (
                SELECT *, list_transform(range(11), lambda k: list_reduce(list_filter(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))), lambda y, i: (i - 1) % 11 = k),
                    lambda a, x: a + x, 0e0)) AS dims FROM embeddings))""",
}


def with_views(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix a statement with the views it names, in dependency order."""
    pool = {**SQL, **(extra or {})}
    order: list[str] = []

    def visit(text: str, seen: tuple = ()):
        for name in pool:
            if name not in seen and name not in order and re.search(rf"\b{name}\b", text):
                visit(pool[name], (*seen, name))
                order.append(name)
    visit(body)
    if not order:
        return body
    views = ",\n".join(f"{n} AS MATERIALIZED ({pool[n].strip()})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{body}"
