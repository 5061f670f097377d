"""Near copies among clip features: a neighbour graph refined by NN-descent, and the components of its close edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, written
from .components import connected
from .vectors import by_length, matrix, signature, usable

SIMILARITY = 0.93
#: Neighbours a list starts with, and by how many times it grows when all of them are close.
NEIGHBOURS, GROWTH = 8, 4
#: Signature tables of the first graph, and members of a bucket or neighbourhood that are compared at once.
TABLES, TOGETHER = 6, 128
#: Points of an audit, the recall it asks for, rounds at most between audits and at most at all.
AUDIT, RECALL, ROUNDS, MOST = 1024, 0.99, 4, 40
#: Angles of half-precision vectors are known this well (radians).
BLUR = 0.01
#: Rounds of covering crowds by balls, and centres tried in one crowded bucket.
COVERS, CENTRES = 6, 4
SURE = 1e-9


def _unit(vectors: pa.Array) -> pa.Array:
    """The vectors divided by their lengths."""
    out: list = [None] * len(vectors)
    for at, rows in by_length(vectors):
        rows = rows / np.abs(rows).max(1, keepdims=True)
        for i, row in zip(at.tolist(), rows / np.sqrt((rows * rows).sum(1, keepdims=True))):
            out[i] = row
    return pa.array(out, pa.list_(pa.float64()))


def _angles(left: pa.Array, right: pa.Array) -> pa.Array:
    """Angles between unit vectors of two columns, NULL beside a NULL."""
    out = np.full(len(left), np.nan)
    both = np.flatnonzero(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
    for at, rows in by_length(left.take(pa.array(both))):
        cosines = (rows * matrix(right.take(pa.array(both[at])))).sum(1)
        out[both[at]] = np.arccos(np.clip(cosines, -1, 1))
    return pa.array(out, pa.float64(), mask=np.isnan(out))


def _cosines(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosines of the given vectors themselves."""
    out = np.zeros(len(left))
    for at, rows in by_length(left):
        a, b = rows, matrix(right.take(pa.array(at)))
        a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
        out[at] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return pa.array(out)


def _best_centre(units: pa.Array, centres: pa.Array) -> pa.Array:
    """(node, angle) of the nearest of each row's centres (structs node, u)."""
    nodes, angles = [], []
    for unit, some in zip(units, centres):
        u, all_ = np.array(unit.as_py()), some.as_py()
        cosines = np.array([c["u"] for c in all_]) @ u
        best = int(cosines.argmax())
        nodes.append(all_[best]["node"])
        angles.append(float(np.arccos(min(1.0, max(-1.0, cosines[best])))))
    return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(angles, pa.float64())], names=["node", "angle"])


def _planes(n: int) -> int:
    """So many signature bits that scattered points fall into buckets of some TOGETHER / 2."""
    return max(1, math.ceil(math.log2(max(n, 1) / (TOGETHER / 2))))


def cover(nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Balls over the crowds of nodes (node, class, u): (ball, class, c, r) and members (node, ball, angle).

    Members lie within half of `reach` of the ball's centre, so any two of them within `reach`. In each round buckets of one signature with more
    than TOGETHER nodes take a few nodes as seeds; nodes near a seed move its centre to their mean, and those near enough to that become a
    ball. Nodes of no ball wait for the next round's signatures; what is left after the last round stands alone.
    """
    balls, members = None, None
    left, rounds = nodes, 0
    while rounds < COVERS:
        signed = left.withColumn("b", F.arrow_udf(signature(_planes(left.count()), 1, 100 + rounds), "array<bigint>")("u")[0])
        crowd = signed.groupBy("class", "b").count().where(F.col("count") > TOGETHER).select("class", "b")
        hot = written(signed.join(crowd, ["class", "b"]), "crowds")
        if hot.isEmpty():
            break
        order = Window.partitionBy("class", "b").orderBy(F.xxhash64("node", F.lit(rounds)))
        seeds = hot.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CENTRES) \
            .groupBy("class", "b").agg(F.collect_list(F.struct("node", "u")).alias("seeds"))
        near = hot.join(seeds, ["class", "b"]).withColumn("seed", F.arrow_udf(_best_centre, "struct<node:bigint,angle:double>")("u", "seeds"))
        near = written(near.where(F.col("seed.angle") <= reach).select("node", "class", "u", F.col("seed.node").alias("ball")), "near")
        means = near.groupBy("ball", "class").agg(vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("c"), F.count("*").alias("n")).where("n > 1")
        means = means.where(F.exists("c", lambda x: x != 0)).select("ball", "class", F.arrow_udf(_unit, "array<double>")("c").alias("c"))
        within = near.join(means.select("ball", "c"), "ball").withColumn("angle", F.arrow_udf(_angles, "double")("u", "c"))
        within = written(within.where(F.col("angle") <= reach / 2 - SURE).select("node", "ball", "angle"), "members")
        found = within.groupBy("ball").agg(F.max("angle").alias("r"), F.count("*").alias("n"))
        new = means.join(found, "ball").select("ball", "class", "c", "r")
        balls, members = (new, within) if balls is None else (balls.unionByName(new), members.unionByName(within))
        if within.isEmpty():
            break
        left, rounds = written(left.join(within.select("node"), "node", "left_anti"), "alone"), rounds + 1
    alone = left.select(F.col("node").alias("ball"), "class", F.col("u").alias("c"), F.lit(0.0).alias("r"))
    singles = left.select("node", F.col("node").alias("ball"), F.lit(0.0).alias("angle"))
    return (alone, singles) if balls is None else (balls.unionByName(alone), members.unionByName(singles))


def _packed(vectors: pa.Array) -> pa.Array:
    out: list = [None] * len(vectors)
    for at, rows in by_length(vectors):
        for i, row in zip(at.tolist(), rows.astype(np.float16)):
            out[i] = row.tobytes()
    return pa.array(out, pa.binary())


def _local_join(batches):
    """Improving pairs (a, b, gap) inside runs of rows (g, part, x, fresh, r, k, worst, q) that share g and part.

    A pair with a fresh member counts for a row when its gap is below the row's worst; each row keeps its k best of a run. Runs are
    cut at TOGETHER rows, so memory does not depend on them.
    """
    held = None

    def pairs(table: pa.Table):
        table = table.combine_chunks()
        g, part, x, fresh_, r, k, worst = (table[c].to_numpy() for c in ("g", "part", "x", "fresh", "r", "k", "worst"))
        q = table["q"].chunk(0)
        at = np.frombuffer(q.buffers()[1], np.int32)[q.offset:q.offset + len(q) + 1]
        data = np.frombuffer(q.buffers()[2], np.uint8)
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (part[1:] != part[:-1])) + 1
        out = []
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(g))):
            for lo in range(i, j, TOGETHER):
                hi = min(j, lo + TOGETHER)
                if hi - lo < 2:
                    continue
                rows = data[at[lo]:at[hi]].view(np.float16).reshape(hi - lo, -1).astype(np.float32)
                gap = np.arccos(np.clip(rows @ rows.T, -1, 1)) - r[lo:hi, None] - r[None, lo:hi]
                new, ids = fresh_[lo:hi], x[lo:hi]
                good = (new[:, None] | new[None, :]) & (gap < worst[lo:hi, None]) & (ids[:, None] != ids[None, :])
                if not good.any():
                    continue
                gap = np.where(good, gap, np.inf)
                order = np.argsort(gap, axis=1, kind="stable")[:, :k[lo:hi].max()]
                best = np.take_along_axis(gap, order, 1)
                a, place = np.nonzero((best < np.inf) & (np.arange(order.shape[1]) < k[lo:hi, None]))
                out.append((ids[a], ids[order[a, place]], best[a, place]))
        if out:
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.float64))], names=["a", "b", "gap"])

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        g, part = held["g"].to_numpy(), held["part"].to_numpy()
        last = int(np.flatnonzero((g != g[-1]) | (part != part[-1])).max(initial=-1)) + 1     # the last run may go on
        if len(g) - last >= TOGETHER:
            last += (len(g) - last) // TOGETHER * TOGETHER
        if last:
            yield from pairs(held.slice(0, last))
            held = held.slice(last)
    if held is not None and len(held):
        yield from pairs(held)


FOUND = "a long, b long, gap double"


def first_graph(points: DataFrame) -> DataFrame:
    """Pairs inside buckets of equal signatures, several tables of them; a crowded bucket is cut by hash."""
    n = points.count()
    signed = points.select("*", F.posexplode(F.arrow_udf(signature(_planes(n), TABLES, 7), "array<bigint>")("c")).alias("t", "s"))
    rows = signed.withColumn("g", F.xxhash64("class", "t", "s"))
    crowd = rows.groupBy("g").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    rows = rows.join(crowd, "g").select("g", F.pmod(F.xxhash64("ball", "t"), "parts").alias("part"), F.col("ball").alias("x"), F.lit(True).alias("fresh"), "r",
                                        F.lit(NEIGHBOURS).alias("k"), F.lit(float("inf")).alias("worst"), "q")
    return rows.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(_local_join, FOUND)


def joined_neighbours(points: DataFrame, lists: DataFrame, state: DataFrame, turn: int) -> DataFrame:
    """Pairs among the neighbours, either way, of every point. Neighbourhoods that many lists point to are cut by hash."""
    crowd = lists.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).where("parts > 1").withColumnRenamed("b", "g")
    back = lists.select(F.col("b").alias("g"), F.col("a").alias("x"), "fresh").join(crowd, "g", "left") \
        .select("g", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("x", F.lit(turn)), "parts")).cast("long").alias("part"), "x", "fresh")
    there = lists.select(F.col("a").alias("g"), F.lit(0).cast("long").alias("part"), F.col("b").alias("x"), "fresh")
    selves = lists.select(F.col("a").alias("g"), F.lit(0).cast("long").alias("part"), F.col("a").alias("x"), F.lit(False).alias("fresh")).distinct()
    rows = back.unionByName(there).unionByName(selves)
    info = points.select(F.col("ball").alias("x"), "r", "q").join(state.withColumnRenamed("a", "x"), "x", "left") \
        .select("x", "r", "q", F.coalesce("k", F.lit(NEIGHBOURS)).alias("k"), F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    rows = rows.join(info, "x").select("g", "part", "x", "fresh", "r", "k", "worst", "q", F.xxhash64("x", F.lit(turn)).alias("o"))
    return rows.repartition("g", "part").sortWithinPartitions("g", "part", "o").drop("o").mapInArrow(_local_join, FOUND)


def audited(points: DataFrame, lists: DataFrame, reach: float) -> tuple[int, int]:
    """(close pairs that the lists hold, close pairs there are) of the AUDIT points of lowest hash, compared with all points."""
    chosen = points.orderBy(F.xxhash64("ball", F.lit("audit"))).limit(AUDIT).select("ball", F.xxhash64("class").alias("class"), "c", "r").collect()
    sample = {}
    for ball, kind, c, r in chosen:
        sample.setdefault((kind, len(c)), []).append((ball, c, r))
    sample = {key: (np.array([b for b, _, _ in some]), np.array([c for _, c, _ in some]), np.array([r for _, _, r in some])) for key, some in sample.items()}

    def near(batches):
        for batch in batches:
            ball, kind, r = (batch.column(c).to_numpy() for c in (0, 1, 3))
            for at, rows in by_length(batch.column(2)):
                for one in np.unique(kind[at]):
                    if (int(one), rows.shape[1]) in sample:
                        ids, centres, radii = sample[int(one), rows.shape[1]]
                        own = at[kind[at] == one]
                        gap = np.arccos(np.clip(centres @ rows[kind[at] == one].T, -1, 1)) - radii[:, None] - r[own][None, :]
                        a, b = np.nonzero((gap <= reach) & (ids[:, None] != ball[own][None, :]))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ball[own][b])], names=["a", "b"])
    true = written(points.select("ball", F.xxhash64("class").alias("class"), "c", "r").mapInArrow(near, "a long, b long"), "audit")
    both = lists.select("a", "b").unionByName(lists.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return true.join(both, ["a", "b"], "left_semi").count(), true.count()


def neighbour_graph(points: DataFrame, reach: float) -> DataFrame:
    """Close pairs (a, b), a < b, of points (ball, class, c, r, q): balls whose gap, angle less both radii, is within `reach`.

    Lists of the NEIGHBOURS least gaps start inside signature buckets. In each round points that share a neighbour are compared where one of them
    is new to the neighbourhood (neighbours of neighbours); better ones enter the lists. A list whose entries are all close may hide more of
    them, so it grows GROWTH times and its neighbourhood counts as new. Rounds end when they bring no close pair and no list grows; then
    an audit against exact comparison of a sample decides whether longer lists for all points are tried.
    """
    wide, length, turn, since = reach + BLUR, NEIGHBOURS, 0, 0
    found, lists, state = first_graph(points).withColumn("fresh", F.lit(True)), None, None
    while True:
        merged = (found if lists is None else found.unionByName(lists)).groupBy("a", "b").agg(F.min("gap").alias("gap"), F.min("fresh").alias("fresh"))
        merged = merged.withColumn("k", F.lit(length)) if state is None else \
            merged.join(state.select("a", "k"), "a", "left").withColumn("k", F.coalesce("k", F.lit(length)))
        order = Window.partitionBy("a").orderBy("gap", "b")
        lists = written(merged.withColumn("n", F.row_number().over(order)).where("n <= k"), "lists")
        full, close = F.col("n") >= F.col("k"), F.col("worst") <= wide
        state = written(lists.groupBy("a").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.max("gap").alias("worst")).select(
            "a", F.when(full & close, F.col("k") * GROWTH).otherwise(F.col("k")).cast("int").alias("k"),
            F.when(full & ~close, F.col("worst")).otherwise(float("inf")).alias("worst"), (full & close).alias("grown")), "state")
        lists, grown = lists.select("a", "b", "gap", "fresh"), not state.where("grown").isEmpty()
        turn, since = turn + 1, since + 1
        if not grown and (since > ROUNDS or lists.where(F.col("fresh") & (F.col("gap") <= wide)).isEmpty()) or turn >= MOST:
            close = lists.where(F.col("gap") <= wide).select("a", "b")
            held, true = audited(points, close, reach)
            if held >= RECALL * true or turn >= MOST:
                return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            length, since = length * 2, 0
            state = state.select("a", F.greatest("k", F.lit(length)).alias("k"), F.lit(float("inf")).alias("worst"), F.lit(True).alias("grown"))
        again = lists.join(state.select("a", "grown"), "a").select("a", "b", (F.col("fresh") | F.col("grown")).alias("fresh"))
        found = joined_neighbours(points, again, state.select("a", "k", "worst"), turn).withColumn("fresh", F.lit(True))
        lists = lists.withColumn("fresh", F.lit(False))


def close_vectors(clips: DataFrame, clip_id: str = "clip_id", label: str = "label", features: str = "features", similarity: float = SIMILARITY) -> DataFrame:
    """Clips with `n_links`, how many other clips of the same label have a cosine of `similarity` or more with it, `component_id`, the
    smallest clip_id reachable by such links, itself included, and `kept`, whether that is its own.

    Cosines are taken in double precision. A clip with a NULL label, a NULL or empty vector, only zeros, or a component that is NULL, NaN or infinite
    links with nothing; vectors of different lengths do not link. Equal vectors of a label are one node that stands for all of them. A NULL
    id is never the smallest one; a component of NULL ids alone has a NULL id and is kept. Repeated clips link with each other like
    any copies. No clips give no rows. Other columns stay; columns of the three names are replaced.

    Pairs are searched by NN-descent between balls that cover crowds (see cover and neighbour_graph): within a ball all clips link, and for two
    balls the angle of their centres and their radii mostly tell whether all clips link or none. Only for the rest are clips compared, so
    a group of copies takes work in proportion to its size. Every link that counts was either computed or follows from the triangle
    inequality; links may be missing as far as the audited recall says.
    """
    angle = math.acos(similarity)
    clips = clips.drop("n_links", "component_id", "kept")
    good = F.col(label).isNotNull() & usable(features) & F.coalesce(F.exists(features, lambda x: x != 0), F.lit(False))
    groups = clips.where(good).groupBy(F.col(label).alias("label"), F.col(features).alias("v")).agg(F.min(clip_id).alias("least"), F.count("*").alias("m"))
    nodes = written(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    units = written(nodes.select("node", F.struct("label", F.size("v").alias("d")).alias("class"), F.arrow_udf(_unit, "array<double>")("v").alias("u")), "units")
    balls, members = cover(units, angle)
    members = written(members.join(nodes.select("node", "m", "v"), "node").join(units.select("node", "u"), "node"), "members")
    sizes = members.groupBy("ball").agg(F.sum("m").alias("size"), F.count("*").alias("nodes"))
    points = written(balls.join(sizes, "ball").withColumn("q", F.arrow_udf(_packed, "binary")("c")), "points")
    pairs = neighbour_graph(points.drop("size", "nodes"), angle)

    # what the balls tell by themselves
    for side in ("a", "b"):
        pairs = pairs.join(points.select(F.col("ball").alias(side), F.col("c").alias(f"c{side}"), F.col("r").alias(f"r{side}"), F.col("size").alias(f"size{side}")), side)
    pairs = written(pairs.withColumn("angle", F.arrow_udf(_angles, "double")("ca", "cb")).where(F.col("angle") - F.col("ra") - F.col("rb") <= angle + SURE), "pairs")
    all_link = F.col("angle") + F.col("ra") + F.col("rb") <= angle - SURE
    whole = pairs.where(all_link).select("a", "b", "sizea", "sizeb")
    # members of the first ball against the centre of the second
    halves = pairs.where(~all_link).select(F.col("a").alias("ball"), "b", "cb", "rb", "sizeb").join(members, "ball") \
        .withColumn("far", F.arrow_udf(_angles, "double")("u", "cb")).where(F.col("far") - F.col("rb") <= angle + SURE)
    halves = written(halves.select("ball", "b", "node", "m", "v", "u", "sizeb", (F.col("far") + F.col("rb") <= angle - SURE).alias("all")), "halves")
    whole_half = halves.where("all")
    rest = halves.where("NOT all").select(F.col("ball").alias("a"), "b", F.col("node").alias("x"), F.col("m").alias("mx"), F.col("v").alias("vx"))
    checked = rest.join(members.select(F.col("ball").alias("b"), F.col("node").alias("y"), F.col("m").alias("my"), F.col("v").alias("vy")), "b")
    checked = written(checked.where(F.arrow_udf(_cosines, "double")("vx", "vy") >= similarity).select("a", "b", "x", "mx", "y", "my"), "checked")

    per_ball = whole.select(F.col("a").alias("ball"), F.col("sizeb").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("sizea").alias("n"))) \
        .unionByName(whole_half.select(F.col("b").alias("ball"), F.col("m").alias("n"))).groupBy("ball").agg(F.sum("n").alias("around"))
    per_node = whole_half.select("node", F.col("sizeb").alias("n")).unionByName(checked.select(F.col("x").alias("node"), F.col("my").alias("n"))) \
        .unionByName(checked.select(F.col("y").alias("node"), F.col("mx").alias("n"))).groupBy("node").agg(F.sum("n").alias("own"))
    edges = whole.select("a", "b").unionByName(whole_half.select(F.col("ball").alias("a"), "b")).unionByName(checked.select("a", "b"))
    roots = connected(edges)
    placed = members.select("node", "ball").join(points.select("ball", "size"), "ball").join(per_ball, "ball", "left").join(per_node, "node", "left") \
        .join(roots.withColumnsRenamed({"node": "ball", "root": "top"}), "ball", "left")
    placed = placed.select("node", F.coalesce("top", "ball").alias("root"), (F.col("size") - 1 + F.coalesce("around", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links"))
    placed = written(placed.join(nodes, "node").select("label", "v", "least", "root", "n_links"), "placed")
    lows = placed.groupBy("root").agg(F.min("least").alias("low"))
    l, v, n, low = (fresh(clips, x) for x in ("label", "v", "links", "low"))
    looked_up = placed.join(lows, "root").select(F.col("label").alias(l), F.col("v").alias(v), F.col("n_links").alias(n), F.col("low").alias(low), F.lit(True).alias(fresh(clips, "met")))
    out = clips.join(looked_up, good & (F.col(label) == F.col(l)) & (F.col(features) == F.col(v)), "left")
    own = F.when(F.col(fresh(clips, "met")), F.col(low)).otherwise(F.col(clip_id))
    return out.select(*clips.columns, F.coalesce(n, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col(clip_id)).alias("kept"))
