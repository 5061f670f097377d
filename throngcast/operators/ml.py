"""Models on tables: robust scaling, isolation forest, clip classifiers, crash classifier, segment scorer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..config import ForestConfig
from ..session import cut_lineage, shared_folder
from . import fusion
from .metrics import calibration
from .ordered import ROWS_PER_CHUNK, exact_percentiles
from .sampling import capped_sample

TREE_SCHEMA = "tree int, node int, feature int, cut double, left_node int, right_node int, path double, sample_size int"


def robust_scaler(rows: DataFrame, features: list[str] = K.FEATURE_COLUMNS, rows_per_chunk: int = ROWS_PER_CHUNK) -> dict:
    """Median and interquartile range per feature; a zero range divides by one."""
    ranks = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    q = exact_percentiles(rows, [], {f"{f}_{n}": (f, r) for f in features for n, r in ranks.items()}, rows_per_chunk).first()
    spread = {f: q[f"{f}_q3"] - q[f"{f}_q1"] for f in features}
    return {f: (q[f"{f}_q2"], spread[f] or 1.0) for f in features}


def scaled_vector(scaler: dict):
    return F.array(*[((F.col(f) - m) / s).cast("double") for f, (m, s) in scaler.items()])


def mean_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def fit_forest(rows: DataFrame, ids: list[str], scaler: dict, cfg: ForestConfig = ForestConfig()) -> DataFrame:
    """Isolation trees as a table of nodes (at most 2 * sample_rows per tree).

    Every tree sees ``sample_rows`` rows chosen by hash. Enough rows for disjoint samples are drawn once; a
    smaller table is reshuffled as often as needed. Trees are built in parallel, each from one bounded group.
    """
    wanted = cfg.trees * cfg.sample_rows
    pool = capped_sample(rows.select(*ids, scaled_vector(scaler).alias("v")), [], ids, wanted, cfg.seed)
    n = pool.count()
    if n == 0:
        raise ValueError("no rows to fit a forest to")
    size = min(cfg.sample_rows, n)
    copies = -(-cfg.trees * size // n)
    dealt = pool.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) \
        .withColumn("_hash", F.xxhash64(*ids, "_copy", F.lit(cfg.seed)))
    place = F.row_number().over(Window.partitionBy("_copy").orderBy("_hash", *ids)) - 1 + F.col("_copy") * n
    dealt = dealt.withColumn("tree", F.floor(place / size).cast("int")).filter(F.col("tree") < cfg.trees)
    return dealt.select("tree", "v").groupBy("tree").applyInPandas(_tree_builder(cfg.seed), TREE_SCHEMA)


def _tree_builder(seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        data = np.stack(pdf["v"].to_list())
        data = data[np.lexsort(data.T)]            # independent of arrival order
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(data), 2))))
        nodes, work = [], [(0, data, 0)]
        used = 1
        while work:
            node, part, depth = work.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(open_features):
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(mean_path(len(part))), len(data)))
                continue
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            side = part[:, f] <= cut
            nodes.append((tree, node, f, cut, used, used + 1, 0.0, len(data)))
            work += [(used, part[side], depth + 1), (used + 1, part[~side], depth + 1)]
            used += 2
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in TREE_SCHEMA.split(", ")])
    return build


def score_forest(rows: DataFrame, forest: DataFrame, scaler: dict, name: str = "raw") -> DataFrame:
    """Add the isolation score in [-1, 0]: the lower, the more anomalous. Trees carry the size of the sample they were fitted to."""
    table = forest.toPandas()          # bounded by trees * 2 * sample_rows nodes
    trees = []
    for _, t in table.groupby("tree"):
        t = t.sort_values("node")
        trees.append(tuple(t[c].to_numpy() for c in ("feature", "cut", "left_node", "right_node", "path")))
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    norm = max(float(mean_path(table["sample_size"].max() if len(table) else 2)), 1e-12)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forest_ = shared.value
        for v in batches:
            x = np.stack(v.to_list()) if len(v) else np.zeros((0, 1))
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, cut, left, right, path in forest_:
                node = np.zeros(len(x), dtype=np.int64)
                active = feature[node] >= 0
                while active.any():
                    at = node[active]
                    go_left = x[every[active], feature[at]] <= cut[at]
                    node[active] = np.where(go_left, left[at], right[at])
                    active = feature[node] >= 0
                total += path[node]
            yield pd.Series(-np.power(2.0, -total / len(forest_) / norm))
    return rows.withColumn(name, score(scaled_vector(scaler)))


def anomaly_scores(features: DataFrame, keys: list[str], order: list[str], model: tuple | None = None, ts: str = "ts",
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Calibrated forest score when a model (forest, scaler, calibration row) is there, else the fallback; smoothed."""
    if model is None:
        raw = fusion.fallback_anomaly(features, ts)
    else:
        forest, scaler, calib = model
        raw = score_forest(features, forest, scaler).withColumn(
            "anomaly_raw", fusion.calibrated(F.col("raw"), calib.p1, calib.p50)).drop("raw")
    return fusion.smoothed(raw, keys, order, "anomaly_raw", "anomaly", rows_per_chunk=rows_per_chunk)


def train_forest(features: DataFrame, ids: list[str], cfg: ForestConfig = ForestConfig(), dataset: str = "dataset",
                 rows_per_chunk: int = ROWS_PER_CHUNK):
    """Balanced sample, scaler, forest and calibration; returns (forest, scaler, calibration row)."""
    from .sampling import balanced_sample
    train = balanced_sample(features, dataset, ids, cfg.max_rows_per_dataset, cfg.max_total_rows, cfg.seed)
    scaler = robust_scaler(train, rows_per_chunk=rows_per_chunk)
    forest = fit_forest(train, ids, scaler, cfg)
    calib = calibration(score_forest(train, forest, scaler), rows_per_chunk=rows_per_chunk).first()
    return forest, scaler, calib


def tuning_grid(features: DataFrame, ids: list[str], evaluation: DataFrame, contaminations: list, cfg: ForestConfig = ForestConfig()):
    """Evaluation summary per contamination setting, as input of ``run_scores``."""
    from dataclasses import replace
    from .metrics import eval_summary
    for c in contaminations:
        replace(cfg, contamination=c)                    # validates the setting
    # contamination moves the decision offset alone, scores and calibration do not depend on it: one fit serves all settings
    forest, scaler, calib = train_forest(features, ids, cfg)
    scored = score_forest(evaluation, forest, scaler).withColumn("anomaly", fusion.calibrated(F.col("raw"), calib.p1, calib.p50))
    summary = cut_lineage(eval_summary(scored))
    return reduce(DataFrame.unionByName, [summary.withColumn("run", F.lit(f"contamination_{c}")) for c in contaminations])


#: Clip vectors in one task of a fit at least, where there are tasks enough for all cores; classes fitted at once.
CLIPS_PER_TASK, FITS = 1 << 14, 4


def _in_few_tasks(rows: DataFrame) -> DataFrame:
    """The rows in no more partitions than their number asks for: a fit is hundreds of short passes, and each starts a task per partition."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // CLIPS_PER_TASK)))


def clip_classifier(train: DataFrame, features: str = "embedding", label: str = "label", probabilities: bool = False):
    """Standardised linear classifier over clip vectors: one-vs-rest SVM, or multinomial logistic for probabilities.

    Each class of the SVM is a fit of its own with its own cached rows; FITS of them run side by side."""
    shared_folder(train.sparkSession)
    rows = _in_few_tasks(train.select(label, array_to_vector(features).alias("_x")))
    scale = StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True)
    if probabilities:
        model = LogisticRegression(featuresCol="_scaled", labelCol=label, maxIter=50, regParam=0.01)
    else:
        model = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), featuresCol="_scaled", labelCol=label, parallelism=FITS)
    return Pipeline(stages=[scale, model]).fit(rows)


def classify_clips(model, clips: DataFrame, features: str = "embedding") -> DataFrame:
    return model.transform(clips.withColumn("_x", array_to_vector(features))).drop("_x", "_scaled", "rawPrediction")


def crash_classifier(labelled: DataFrame, features: list[str], rounds: int = 240, depth: int = 4, rate: float = 0.06, seed: int = 42):
    """Boosted trees on window features; needs both classes and at least 20 rows."""
    n, classes = labelled.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n < 20 or classes < 2:
        raise ValueError("need at least 20 labelled windows of both classes")
    shared_folder(labelled.sparkSession)
    gbt = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=depth, stepSize=rate, maxIter=rounds, seed=seed)
    return gbt.fit(labelled.withColumn("_x", array_to_vector(F.array(*features))))


def crash_probability(model, windows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(windows.withColumn("_x", array_to_vector(F.array(*features))))
    return scored.withColumn("crash_prob", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def segment_scores(clips: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float, features: str = "embedding",
                   name: str = "score") -> DataFrame:
    """sigmoid(w2 . relu(w1 x + b1) + b2) per clip, one matrix product per Arrow batch."""
    weights = clips.sparkSession.sparkContext.broadcast((w1, b1, w2, b2))

    @F.pandas_udf("double")
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m1, c1, m2, c2 = weights.value
        for v in batches:
            x = np.stack(v.to_list()).astype(float) if len(v) else np.zeros((0, m1.shape[1]))
            yield pd.Series(1.0 / (1.0 + np.exp(-(np.maximum(x @ m1.T + c1, 0.0) @ m2 + c2))))
    return clips.withColumn(name, head(F.col(features)))
