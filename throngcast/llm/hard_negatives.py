"""Hard negatives among clip features: clips of another class that score almost as an anchor's positives do."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written
from .vectors import floored, matrix, signature, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Negative scores lie between these per cent of the positive's score.
WINDOW = (80, 100)
#: Anchors of a tree, anchors and clips of one unit of work, clips scored at once.
TREE, ANCHORS, CLIPS, STEP = 512, 16_384, 65_536, 4096


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows by distance: (order, parents, edges). `order` lists rows so that a parent comes before its
    children; parents (-1 for the root) and edge lengths follow that order, a parent being a place in it."""
    n = len(vectors)
    squares = (vectors * vectors).sum(1)
    far, parent = np.full(n, np.inf), np.full(n, -1)
    order, place, edges = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    at = 0
    for step in range(n):
        order[step], place[at] = at, step
        edges[step] = math.sqrt(max(far[at], 0.0)) if step else 0.0
        apart = squares + squares[at] - 2 * (vectors @ vectors[at])
        closer = (place < 0) & (apart < far)
        far[closer], parent[closer] = apart[closer], at
        at = int(np.where(place < 0, far, np.inf).argmin())
    parents = np.where(parent[order] >= 0, place[parent[order]], -1)
    exact = np.sqrt(((vectors[order] - vectors[order[parents]]) ** 2).sum(1))  # the running form above loses digits
    return order, parents, np.where(parents >= 0, exact, 0.0)


def _trees(table: pa.Table) -> pa.Table:
    """Anchors of one tree in its order, with place, parent and edge."""
    table = table.combine_chunks()
    order, parents, edges = spanning_tree(matrix(table["v"]))
    table = table.take(pa.array(order))
    for name, values in (("place", np.arange(len(order))), ("parent", parents), ("edge", edges)):
        table = table.append_column(name, pa.array(values))
    return table


class _Best:
    """The first k clips of a score list: higher scores first, then earlier rows. Rows come in ascending order of id."""

    def __init__(self, k: int):
        self.k, self.scores, self.rows = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        scores, rows = np.concatenate((self.scores, scores)), np.concatenate((self.rows, rows))
        first = np.lexsort((rows, -scores))[:self.k]
        self.scores, self.rows = scores[first], rows[first]


def _scored(anchors: pa.Table, clips: pa.Table, wanted) -> None:
    """Scores clips against anchors along their trees; `wanted(anchor, rows, low, high)` says which rows may matter given bounds of
    their scores and returns (mask, receiver of exact scores).

    A child's score differs from its parent's by no more than the edge times the clip's norm, so a clip keeps an interval per anchor: a point
    where it was scored, the parent's interval widened by that where it was not.
    """
    heads, rows = matrix(anchors["v"], np.int64), matrix(clips["v"], np.int64)
    largest = max(abs(int(x)) for part in (heads, rows) for x in (part.min(initial=0), part.max(initial=0)))
    if rows.shape[1] * largest * largest * WINDOW[1] >= 1 << 62:
        raise ValueError("components are too large for scores of 64 bits")
    kind = np.float64 if rows.shape[1] * largest * largest < 1 << 52 else np.int64      # both exact; doubles are faster
    exact_heads, tree = heads.astype(kind), anchors["tree"].to_numpy()
    parents, edges = anchors["parent"].to_numpy(), anchors["edge"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    for at in range(0, len(rows), STEP):
        some = rows[at:at + STEP].astype(kind)
        norms = np.sqrt((some.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        for first, last in zip(starts, np.append(starts[1:], len(heads))):
            low, high = np.empty((last - first, len(some))), np.empty((last - first, len(some)))
            for a in range(last - first):
                if parents[first + a] < 0:
                    low[a], high[a] = -np.inf, np.inf
                else:
                    slack = norms * (edges[first + a] * (1 + 1e-9)) + 1e-3
                    low[a], high[a] = low[parents[first + a]] - slack, high[parents[first + a]] + slack
                mask, receive = wanted(first + a, slice(at, at + len(some)), low[a], high[a])
                if parents[first + a] < 0:
                    mask = np.ones(len(some), bool)                                     # the root bounds all others
                if not mask.any():
                    continue
                chosen = np.flatnonzero(mask)
                scores = (some if len(chosen) == len(some) else some[chosen]) @ exact_heads[first + a]
                low[a, chosen] = high[a, chosen] = scores
                receive(chosen, scores.astype(np.int64))


def _prepared(anchors: pa.Table, clips: pa.Table):
    """Anchors in tree order, clips by id, and label numbers of both."""
    anchors = anchors.sort_by([("tree", "ascending"), ("place", "ascending")]).combine_chunks()
    clips = clips.take(pc.sort_indices(clips["id"], null_placement="at_end")).combine_chunks()
    names = pc.unique(pa.chunked_array([*anchors["label"].chunks, *clips["label"].chunks]))
    return anchors, clips, pc.index_in(anchors["label"], names).to_numpy(), pc.index_in(clips["label"], names).to_numpy()


def _listed(anchors: pa.Table, clips: pa.Table, best: list[tuple[int, int, _Best]], schema: pa.Schema) -> pa.Table:
    sizes = [len(b.rows) for *_, b in best]
    whose = np.repeat(np.array([a for a, _, _ in best], np.int64), sizes)
    rows = np.concatenate([np.empty(0, np.int64), *[b.rows for *_, b in best]])
    columns = {"number": anchors["number"].take(pa.array(whose)), "window": pa.array(np.repeat(np.array([w for _, w, _ in best], np.int64), sizes)),
               "id": clips["id"].take(pa.array(rows)), "score": pa.array(np.concatenate([np.empty(0, np.int64), *[b.scores for *_, b in best]]))}
    return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns)).cast(schema)


def _schema(clips: pa.Table) -> pa.Schema:
    return pa.schema([("number", pa.int64()), ("window", pa.int64()), ("id", clips.schema.field("id").type), ("score", pa.int64())])


def _positives(k: int):
    def run(anchors: pa.Table, clips: pa.Table) -> pa.Table:
        if not len(anchors) or not len(clips):
            return _schema(clips).empty_table()
        anchors, clips, mine, theirs = _prepared(anchors, clips)
        best = [_Best(k) for _ in range(len(anchors))]
        ids, own = clips["id"], anchors["id"]
        selves = [set(x) for x in _same(own, ids)]

        def wanted(a, rows, low, high):
            alike = theirs[rows] == mine[a]
            for row in selves[a]:
                if rows.start <= row < rows.stop:
                    alike[row - rows.start] = False

            def receive(chosen, scores):
                good = alike[chosen] & (scores >= best[a].least)
                if good.any():
                    best[a].add(scores[good], chosen[good] + rows.start)
            return alike & (high >= best[a].least), receive
        _scored(anchors, clips, wanted)
        return _listed(anchors, clips, [(a, 0, b) for a, b in enumerate(best)], _schema(clips))
    return run


def _same(own, ids) -> list[list[int]]:
    """For each anchor the rows that have its id."""
    places: dict = {}
    hits = pc.is_in(ids, value_set=own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(hits).tolist():
        places.setdefault(ids[row].as_py(), []).append(row)
    return [places.get(i, []) for i in own.to_pylist()]


def _negatives(k: int, window: tuple[int, int]):
    share, whole = window

    def run(anchors: pa.Table, clips: pa.Table) -> pa.Table:
        if not len(anchors) or not len(clips):
            return _schema(clips).empty_table()
        anchors, clips, mine, theirs = _prepared(anchors, clips)
        tops = [np.array(x, np.int64) for x in anchors["positives"].to_pylist()]
        best = [[_Best(k) for _ in top] for top in tops]

        def wanted(a, rows, low, high):
            other = theirs[rows] != mine[a]
            near = np.zeros(len(other), bool)
            for top, b in zip(tops[a].tolist(), best[a]):
                near |= (high >= max(-(-share * top // whole), b.least)) & (low <= top)

            def receive(chosen, scores):
                scores, chosen = scores[other[chosen]], chosen[other[chosen]] + rows.start
                for top, b in zip(tops[a].tolist(), best[a]):
                    good = (share * top <= whole * scores) & (scores <= top) & (scores >= b.least)
                    if good.any():
                        b.add(scores[good], chosen[good])
            return other & near, receive
        _scored(anchors, clips, wanted)
        return _listed(anchors, clips, [(a, w, b) for a, some in enumerate(best) for w, b in enumerate(some)], _schema(clips))
    return run


def mine_hard_negatives(clips: DataFrame, is_anchor: Column, clip_id: str = "clip_id", label: str = "label", features: str = "features",
                        scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the clips that `is_anchor` is true for.

    Components become floor(scale * x), a score is the integer inner product with the anchor; higher scores come first, then smaller ids.
    An anchor's positives are its first `positives` clips of the same label, its own id excepted; to each the first `negatives`
    clips of other labels are returned whose score lies between window[0] and window[1] per cent of the positive's, rank from 1.
    Clips with a NULL label, a NULL or empty vector or a component that is NULL, NaN or infinite take no part; clips meet only anchors with
    vectors of their length. Repeated clips count each, repeated anchors each give their rows; anchors with a NULL id count. A clip
    with a NULL id comes last among equal scores. Other columns play no part. Scores over 64 bits are an error.

    Anchors with like signatures share a minimum spanning tree of at most some TREE anchors. Anchors and clips meet in units of
    bounded size on both sides, so nothing grows in a task; a unit leaves the few best per anchor, which windows over the anchor merge.
    """
    spark = clips.sparkSession
    rows = written(clips.where(F.col(label).isNotNull() & usable(features)).select(
        F.col(clip_id).alias("id"), F.col(label).cast("string").alias("label"), floored(features, scale).alias("v"),
        F.size(features).alias("length"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "clips")
    chosen = written(rows.where("anchor").select(F.monotonically_increasing_id().alias("number"), "id", "label", "v", "length"), "anchors")
    n_rows, n_anchors = rows.count(), chosen.count()
    planes = max(0, math.ceil(math.log2(max(n_anchors, 1) / (TREE // 2))))
    signed = chosen.withColumn("side", F.arrow_udf(signature(planes), "array<bigint>")("v")[0] if planes else F.lit(0).cast("long"))
    crowd = signed.groupBy("length", "side").agg(F.ceil(F.count("*") / TREE).alias("parts"))
    grown = signed.join(crowd, ["length", "side"]).withColumn("tree", F.xxhash64("length", "side", F.pmod(F.xxhash64("number"), "parts")))
    trees = written(grown.select("number", "id", "label", "v", "length", "tree").groupBy("tree", "length").applyInArrow(
        _trees, f"number long, id {_type(rows, 'id')}, label string, v array<bigint>, length int, tree long, place long, parent long, edge double"), "trees")

    tiles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / CLIPS))
    blocks = math.ceil(n_anchors / ANCHORS) or 1
    block = F.pmod(F.xxhash64("tree"), F.lit(blocks)).alias("block")
    keys = ["length", "tile", "block"]
    sides = rows.select("id", "label", "v", "length", F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).alias("tile"), _each(blocks).alias("block"))

    def met(heads: DataFrame, run) -> DataFrame:
        placed = heads.select("*", _each(tiles).alias("tile"), block)
        return placed.groupBy(keys).cogroup(sides.groupBy(keys)).applyInArrow(run, f"number long, window long, id {_type(rows, 'id')}, score long")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("number", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(ranked(met(trees, _positives(positives)), positives).select(
        "number", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = first.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    last = ranked(met(trees.join(tops, "number"), _negatives(negatives, window)), negatives)
    named = chosen.select("number", F.col("id").alias("anchor_id"))
    return last.join(first, ["number", "window"]).join(named, "number").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _each(n: int) -> Column:
    """A row for each of n numbers."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
