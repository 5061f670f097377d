"""Streaming forms of the risk engine, presence, incidents, camera cache and reroute loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..config import CrashConfig, FallConfig, RiskStateConfig
from ..functions import scalars as S
from ..operators import decision, graph, presence
from ..operators.folds import FallDetector, StaleMetric
from ..session import run_folder
from . import processors as P

WATERMARK = "30 seconds"


def with_event_time(stream: DataFrame, ms: str, name: str = "event_time") -> DataFrame:
    """Event time from epoch milliseconds, with the 30 s watermark (later rows are dropped and counted by Spark)."""
    return stream.withColumn(name, F.timestamp_millis(F.col(ms))).withWatermark(name, WATERMARK)


def risk_stream(samples: DataFrame, cfg: RiskStateConfig = RiskStateConfig(), meaningful_only: bool = False) -> DataFrame:
    """zone_id, ts, arrival, risk_raw to risk states; optionally only rows that matter downstream."""
    out = P.run_fold(samples, "zone_id", P.RiskStateWithChange(cfg=cfg), ["ts", "arrival"], ["zone_id", "ts", "arrival", "risk_raw"])
    return out.filter("meaningful") if meaningful_only else out


def perception_risk(frames: DataFrame) -> DataFrame:
    """Perception frames (ts, zones array) to fused samples for ``risk_stream``."""
    zones = frames.select("ts", F.inline("zones"))
    return zones.select(F.col("zoneId").alias("zone_id"), "ts", F.col("ts").alias("arrival"),
                        S.fused_risk(F.col("density"), F.col("anomaly"), F.col("conf")).alias("risk_raw"))


def presence_stream(events: DataFrame, max_age_ms: int = K.PRESENCE_MAX_AGE_MS) -> DataFrame:
    """user_id, arrival, lat, lng, ts_ms, offline to position changes: active, offline, expired."""
    return with_event_time(events, "ts_ms").groupBy("user_id").transformWithStateInPandas(
        P.PresenceProcessor(max_age_ms), P.PresenceProcessor.output, "Append", "EventTime")


def presence_grid_stream(events: DataFrame, window: str = "30 seconds", slide: str = "3 seconds") -> DataFrame:
    """Crowd cells over sliding windows; each window is final once the watermark passed it."""
    timed = with_event_time(events, "ts_ms").withColumn("w", F.window("event_time", window, slide))
    return presence.presence_grid(timed, ["w"])


def presence_grid_table(events: DataFrame, name: str = "presence_grid", window: str = "30 seconds", slide: str = "3 seconds") -> tuple[DataFrame, int]:
    """Crowd cells of sliding windows as they stand, also of windows still open, and how many late rows were left out.

    The stream runs in update mode: each micro-batch writes the cells it changed under its id (a repeated batch overwrites itself), and
    the last state of a cell counts. Rows behind the watermark change nothing; Spark's own count of them is returned.
    """
    spark: SparkSession = events.sparkSession
    base = run_folder(spark, name)
    cells = presence_grid_stream(events, window, slide).select(F.unix_millis("w.start").alias("start_ms"), "lat_cell", "lng_cell", "users", "lat", "lng", "latest_ts")
    query = cells.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint") \
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/table/batch={batch}")).start()
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
    table = spark.read.parquet(f"{base}/table")
    last = table.groupBy("start_ms", "lat_cell", "lng_cell").agg(F.max_by(F.struct("users", "lat", "lng", "latest_ts"), "batch").alias("c"))
    return last.select("start_ms", "lat_cell", "lng_cell", "c.*"), late


def incident_stream(changes: DataFrame) -> DataFrame:
    """incident_id, arrival, op, zone_id, hazard_penalty, affected_zone_ids to signed zone changes."""
    return changes.groupBy("incident_id").transformWithStateInPandas(
        P.IncidentProcessor(), P.IncidentProcessor.output, "Append", "None")


def zone_totals(changes: DataFrame) -> DataFrame:
    """Current delta per zone from the signed changes, over the written table or as a second stream."""
    return changes.groupBy("zone_id").agg(F.sum("change").alias("local_delta"))


def fall_stream(samples: DataFrame, cfg: FallConfig = FallConfig()) -> DataFrame:
    """device, ts, arrival, magnitude to phases and fall events."""
    order, kept = ["ts", "arrival"], ["device", "ts", "arrival"]
    fold = FallDetector(cfg=cfg)
    return P.run_fold(with_event_time(samples, "ts"), "device", fold, order, kept, P.FallProcessor(order, kept, cfg), "EventTime")


def inference_cache_stream(requests: DataFrame, ttl_ms: int = K.CAMERA_TTL_MS) -> DataFrame:
    """cache_key, ts, arrival, value: serve stored inferences for their time to live."""
    fold = P.TtlCache(ttl_ms=ttl_ms)
    return P.run_fold(requests, "cache_key", fold, ["ts", "arrival"], ["cache_key", "ts", "arrival"])


def stale_metric_stream(polls: DataFrame) -> DataFrame:
    return P.run_fold(polls, "metric", StaleMetric(), ["ts_ms", "arrival"], ["metric", "ts_ms", "arrival"])


def count_window_stream(frames: DataFrame, cfg: CrashConfig = CrashConfig()) -> DataFrame:
    block = F.floor(F.col("frame_idx") / (cfg.frames_per_window * P.CountWindowProcessor.WINDOWS)).cast("bigint")
    return frames.withColumn("window_block", block).groupBy("video", "window_block").transformWithStateInPandas(
        P.CountWindowProcessor(cfg.frames_per_window), P.CountWindowProcessor.output, "Append", "None")


class RerouteSink:
    """``foreachBatch`` body: re-evaluate users whose routes touch zones changed in this micro-batch, all of them after a mode switch.

    Zone risk, incidents, load, active routes, edges and the mode are tables read anew per batch, so a mode
    switch or a new incident takes effect with the next one. Results are written per batch id, which makes a
    repeated batch overwrite itself.

    The ways to the exits are kept per batch as well: a batch takes those of the batch before and repairs what its changed edge
    costs touch. ``repairs`` records mode and nodes touched. Without ``keep_ways`` every batch computes all ways.
    """

    def __init__(self, tables: dict, out_folder: str, now_ms, keep_ways: str | None = None):
        self.tables, self.out_folder, self.now_ms, self.keep_ways = tables, out_folder, now_ms, keep_ways

    def __call__(self, changed: DataFrame, batch_id: int) -> None:
        read = {name: load() for name, load in self.tables.items()}
        mode = read["mode"].first()["mode"]                     # control table of one row
        before = self._before(changed.sparkSession, batch_id)
        users = read["routes"]
        if before is None or before["mode"] == mode:
            touched = changed.select("zone_id").distinct()
            users = users.withColumn("_z", F.explode("zone_path")).join(touched.withColumnRenamed("zone_id", "_z"), "_z").drop("_z").dropDuplicates(["user_id"])
        ways = self._ways(read, mode, before, batch_id) if self.keep_ways else None
        self.evaluate(users, read, mode, ways).write.mode("overwrite").parquet(f"{self.out_folder}/batch={batch_id}")

    def _before(self, spark: SparkSession, batch_id: int) -> dict | None:
        """What the batch before left; batches come one by one, so it is there from the second on."""
        if not self.keep_ways or batch_id == 0:
            return None
        table = lambda name: spark.read.parquet(f"{self.keep_ways}/{name}/batch={batch_id - 1}")
        return {"ways": table("ways"), "costs": table("costs"), "mode": table("repairs").first()["mode"]}

    def _ways(self, read: dict, mode: str, before: dict | None, batch_id: int) -> DataFrame:
        spark = read["edges"].sparkSession
        place = lambda name: f"{self.keep_ways}/{name}/batch={batch_id}"
        graph.edge_costs(read["edges"], read["zone_risk"], read.get("deltas"), read.get("load"), mode).write.mode("overwrite").parquet(place("costs"))
        costs = spark.read.parquet(place("costs"))
        if before is None:
            ways, touched = graph.exit_costs(costs, read["exits"]), None
        else:
            ways, touched = graph.repaired_exit_costs(before["ways"], before["costs"], costs, read["exits"])
        ways.write.mode("overwrite").parquet(place("ways"))
        kept = spark.read.parquet(place("ways"))
        record = [(mode, touched if touched is not None else kept.count())]
        spark.createDataFrame(record, "mode string, touched long").coalesce(1).write.mode("overwrite").parquet(place("repairs"))
        return kept

    def evaluate(self, users: DataFrame, read: dict, mode: str, ways: DataFrame | None = None) -> DataFrame:
        assessed = decision.assess_routes(users, read["zone_risk"], read["incidents"], read.get("load"))
        decided = decision.decide(assessed.join(users.select("user_id", "last_reroute_ms", "current_node", "destination"), "user_id"),
                                  mode, F.lit(self.now_ms()), F.col("last_reroute_ms"))
        if ways is None:
            ways = graph.exit_costs(graph.edge_costs(read["edges"], read["zone_risk"], read.get("deltas"), read.get("load"), mode), read["exits"])
        # exits are looked up where users stand; only an evacuation sends them there
        asked = users.select(F.col("current_node").cast("string").alias("node")).distinct()
        exits = graph.exit_paths(ways, asked) if mode == "evacuation" else ways.select("node", F.lit(None).cast("string").alias("exit_id"), "cost")
        sent = decision.targets(decided, exits, mode)
        told = decision.guidance(sent).join(exits.select(F.col("node").alias("current_node"), F.col("cost").alias("exit_cost")), "current_node", "left")
        return told.select("user_id", "reason", "target", "exit_cost", "title", "message", "guidance_severity")


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process what is available into a parquet table and return that table."""
    spark: SparkSession = stream.sparkSession
    base = run_folder(spark, name)
    out, checkpoint = out or f"{base}/table", checkpoint or f"{base}/checkpoint"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
