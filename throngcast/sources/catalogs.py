"""File catalogs: split folders, incremental runs, image-label pairs, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K


def cache_key(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def not_yet_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return rows.join(done.select(key), key, "left_anti")


def file_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all files below a folder, without reading their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder) \
        .select(F.regexp_replace("path", "^file:", "").alias("path"), "length")


def resolve_split(files: DataFrame, root: str, dataset: str, split: str) -> DataFrame:
    """Folder of a dataset's split: the direct name, else the first alias that exists, else a folder whose name
    contains the split, preferring folders with videos and then short paths. One row, or none."""
    base = f"{root.rstrip('/')}/{dataset}/"
    inside = files.filter(F.col("path").startswith(base)).select(F.substring("path", len(base) + 1, 4096).alias("rest"))
    is_video = F.lower(F.element_at(F.split("rest", r"\."), -1)).isin(K.VIDEO_SUFFIXES)
    parts = F.slice(F.split("rest", "/"), 1, F.size(F.split("rest", "/")) - 1)
    folders = inside.withColumn("video", is_video).withColumn("parts", parts).filter("size(parts) > 0") \
        .select("video", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("folder")) \
        .groupBy("folder").agg(F.max("video").alias("has_video"))
    names = [split, *K.SPLIT_ALIASES.get(split, [split])]
    name = F.element_at(F.split("folder", "/"), -1)
    loose = F.lower(name).contains(split.lower()) & ~F.contains(name, F.lit("."))
    rank = F.when(F.lit(False), 0)
    for i, alias in enumerate(names):
        rank = rank.when(F.col("folder") == alias, i)
    rank = rank.when(loose & F.col("has_video"), 1000).when(loose, 1001)
    return folders.withColumn("rank", rank).filter("rank IS NOT NULL") \
        .orderBy("rank", F.length("folder"), "folder").limit(1).select(F.concat(F.lit(base), "folder").alias("path"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def labelled_images(images: DataFrame, labels: DataFrame, path: str = "path", at_least: int = 10) -> DataFrame:
    """Images that have a label file of the same stem; too few are an error."""
    pairs = images.withColumn("stem", stem(F.col(path))).join(labels.select(stem(F.col(path)).alias("stem")).distinct(), "stem", "left_semi")
    n = pairs.count()
    if n < at_least:
        raise ValueError(f"too few labelled samples: {n}")
    return pairs


def with_source_video(specs: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clip specs whose video exists, and the number of missing ones per dataset."""
    keys = ["dataset", "video_name"]
    known = videos.select(*keys)
    missing = specs.join(known, keys, "left_anti").groupBy("dataset").agg(F.count(F.lit(1)).alias("missing"))
    return specs.join(known, keys, "left_semi"), missing


def same_labels(names: Column, wanted: list[str] = tuple(K.COCO_VEHICLES.values())) -> Column:
    """Whether a model's class names are exactly the wanted set (any order, case and blanks aside)."""
    clean = F.transform(names, lambda n: F.lower(F.trim(n)))
    target = F.array(*[F.lit(w) for w in wanted])
    return (F.size(names) == len(wanted)) & (F.size(F.array_except(clean, target)) == 0) & (F.size(F.array_except(target, clean)) == 0)


def last_artifact(files: DataFrame, suffix: str) -> DataFrame:
    return files.filter(F.col("path").endswith(suffix)).agg(F.max("path").alias("path"))
