"""Written outputs: perception lines, feature tables, rankings, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def frame_lines(rows: DataFrame) -> DataFrame:
    """Rows per frame and zone to one perception record per frame; a frame holds one entry per zone.

    Frames are told apart by ``frame_id`` where there is one, so videos that share a time stay apart.
    """
    keys = [F.col("ts"), *[F.col("frame_id").alias("frameId") for c in rows.columns if c == "frame_id"]]
    zone = F.struct("zone_pos", F.struct(F.col("zone_id").alias("zoneId"), "density", "anomaly", "conf", F.col("people_count").alias("peopleCount")).alias("z"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(zone)), lambda e: e.z).alias("zones"))


def _prediction(rows: DataFrame, *more) -> DataFrame:
    """One entry per clip: its rows differ in the zone only."""
    said = F.struct("ts", F.col("frame_id").alias("frameId"), F.col("clip_index").alias("clipIndex"), F.col("pred_class_id").alias("predClassId"), *more)
    return rows.groupBy("frame_id").agg(F.any_value(said).alias("r")).select("r.*")


def behaviour_lines(rows: DataFrame, risk: str = "label_risk") -> DataFrame:
    """The class of each clip and its risk: that of the label, or the expected one."""
    key = "risk" if risk == "label_risk" else "expectedRisk"
    return _prediction(rows, F.col("pred_label").alias("predLabel"), F.col("pred_conf").alias("predConf"), F.col(risk).alias(key))


def debug_lines(rows: DataFrame) -> DataFrame:
    """Class, scores and mixes of each clip of an ensemble."""
    return _prediction(rows, F.col("pred_label").alias("behaviorLabel"), F.col("pred_conf").alias("behaviorConf"), F.col("expected_risk").alias("expectedRisk"), F.col("mil_score").alias("milScore"),
                       F.col("paper_mix").alias("paperMix"), F.col("mil_mix").alias("milMix"), F.col("base_mix").alias("baseMix"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_features(rows: DataFrame, path: str) -> None:
    """Feature table partitioned by dataset and split, so later reads prune."""
    rows.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


def replace_features(rows: DataFrame, path: str) -> None:
    """As write_features, but only the datasets and splits among the rows are replaced; the others stay as they are.

    A run that is repeated leaves the table as one run does, so an extraction may be resumed split by split.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "split").parquet(path)


def write_ranking(ranked: DataFrame, path: str) -> None:
    ranked.select("rank", "run", F.format_string("%.6f", "score").alias("score"), "compared_pairs").orderBy("rank") \
        .coalesce(1).write.mode("overwrite").csv(path, header=True)        # one row per run


def write_record(spark, record: dict, path: str) -> None:
    """One small record (run settings, calibration) as JSON."""
    spark.createDataFrame([tuple(record.values())], list(record)).coalesce(1).write.mode("overwrite").json(path)
