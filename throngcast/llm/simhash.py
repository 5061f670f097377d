"""Near-duplicate incident texts by SimHash fingerprints in a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import content, small_batches, written
from .components import connected

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Six blocks of the 64 bits; of any four differing bits, at least two blocks are free.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
FANOUT = 16


def fingerprint(text: str) -> int:
    """Bits set in over half of the shingles' XXH64, as a signed 64-bit number; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()      # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes, as a signed 64-bit number; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):            # bounded memory for very long texts
        counts += np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray, out: list) -> np.ndarray:
    """Labels after uniting the sets of a[i] and b[i]; appends one pair of positions for each union made."""
    pairs = np.stack([label[a], label[b]], 1)
    different = pairs[:, 0] != pairs[:, 1]
    if not different.any():
        return label
    pairs, at = np.unique(np.sort(pairs[different], 1), axis=0, return_index=True)
    a, b = a[different][at], b[different][at]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for (x, y), i, j in zip(pairs.tolist(), a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((i, j))
    parent = np.arange(len(label))
    for x in up:
        parent[x] = top(x)
    return _roots(parent)[label]


def gray_links(prints: np.ndarray, group: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Positions of linked fingerprints that join all of each group's components: at most one link less than members.

    `prints` (uint64) are sorted by Gray rank inside contiguous groups. Neighbours are linked first. Then leaves of FANOUT
    consecutive fingerprints factor out the bit patterns they share (mask and pattern), nodes of FANOUT leaves do so for theirs, and so on. From
    the top, a pair of nodes is dropped when the bits that both have fixed already differ in more than max_bits places, or when
    everything in it is one component; the pairs of leaves that remain are compared bit by bit. Memory: one entry per pair alive.
    """
    n, links = len(prints), []
    label = np.arange(n)
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(prints[1:] ^ prints[:-1]) <= max_bits))
    label = _union(label, near, near + 1, links)
    # level 0: the fingerprints themselves; node arrays (first child, number of children, common ones, common zeros, group)
    levels = [(np.arange(n), np.ones(n, int), prints, ~prints, group)]
    while True:
        _, _, ones, zeros, owner = levels[-1]
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        rank = np.arange(len(owner)) - np.repeat(cuts, np.diff(np.append(cuts, len(owner))))
        first = np.flatnonzero(rank % FANOUT == 0)
        sizes = np.diff(np.append(first, len(owner)))
        levels.append((first, sizes, np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first), owner[first]))
        if len(first) == len(cuts):
            break

    def label_span(level: int) -> tuple[np.ndarray, np.ndarray]:
        low = high = label
        for first, *_ in levels[1:level + 1]:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        return low, high

    def alive(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, _, ones, zeros, _ = levels[level]
        low, high = label_span(level)
        fixed = np.bitwise_count((ones[a] & zeros[b]) | (zeros[a] & ones[b]))
        whole = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        return (fixed <= max_bits) & ~whole

    top = len(levels) - 1
    stack = [(top, np.arange(len(levels[top][0])), np.arange(len(levels[top][0])))]
    while stack:                                         # depth first in pieces: few pairs are alive at a time
        level, a, b = stack.pop()
        if len(a) > 4096:
            stack += [(level, a[i:i + 4096], b[i:i + 4096]) for i in range(0, len(a), 4096)]
            continue
        keep = alive(level, a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            label = _union(label, a, b, links)
            continue
        first, sizes, *_ = levels[level]
        na, nb = sizes[a], sizes[b]
        of = np.repeat(np.arange(len(a)), na * nb)
        k = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        left, right = first[a][of] + k // nb[of], first[b][of] + k % nb[of]
        once = left <= right if level > 1 else left < right
        once |= (a != b)[of]
        stack.append((level - 1, left[once], right[once]))
    return links


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets (equal b, k) of rows that arrive sorted by bucket and Gray rank."""
    held: list[tuple] = []

    def linked(parts: list[tuple]) -> pa.RecordBatch:
        b, k, p = (np.concatenate(x) for x in zip(*parts))
        group = np.cumsum(np.concatenate(([0], (b[1:] != b[:-1]) | (k[1:] != k[:-1]))))
        many = np.bincount(group)[group] > 1
        p, group = p[many], group[many]
        pairs = np.array(gray_links(p.view(np.uint64), group) if len(p) else [], int).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(p[pairs[:, 0]]), pa.array(p[pairs[:, 1]])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        b, k, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        last = np.flatnonzero((b != b[-1]) | (k != k[-1]))
        cut = last[-1] + 1 if len(last) else 0           # the last bucket may go on in the next batch
        if cut:
            yield linked([*held, (b[:cut], k[:cut], p[:cut])])
            held = []
        held.append((b[cut:], k[cut:], p[cut:]))
    if held:
        yield linked(held)


def fingerprint_links(prints: DataFrame, fingerprint: str = "fingerprint", hot: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints at MAX_BITS or fewer differing bits that join all components they form.

    Every pair of blocks is a bucket key: fingerprints that differ in four bits agree in two of six blocks, so no link is lost.
    A bucket of over `hot` fingerprints is cut again: its members differ only in the other 44 bits, at most in four, so they agree in one of
    five sub-blocks of those; keys get that sub-block in addition, and still no link is lost.
    """
    p = F.col(fingerprint)
    bits = lambda at, n: F.shiftrightunsigned(p, at).bitwiseAND(F.lit((1 << n) - 1))
    pairs = list(combinations(range(len(BLOCKS)), 2))
    key = lambda i, j: bits(*BLOCKS[i]) * (1 << 11) + bits(*BLOCKS[j])
    entries = prints.select(p.alias("p"), F.explode(F.array(*[F.struct(F.lit(n).alias("b"), key(i, j).alias("k")) for n, (i, j) in enumerate(pairs)])).alias("e")).select("e.b", "e.k", "p")
    counts = entries.groupBy("b", "k").count()
    crowded = written(counts.where(F.col("count") > 1).select("b", "k", (F.col("count") > hot).alias("cut")), "buckets")
    entries = entries.join(crowded, ["b", "k"])
    fine = []
    for n, (i, j) in enumerate(pairs):
        free = [x for m, (at, size) in enumerate(BLOCKS) if m not in (i, j) for x in range(at, at + size)]
        parts = [free[s * len(free) // 5:(s + 1) * len(free) // 5] for s in range(5)]
        masks = [sum(1 << x for x in part) for part in parts]
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        fine.append((n, masks))
    mask = F.get(F.array(*[F.array(*[F.lit(m) for m in masks]) for _, masks in fine]), F.col("b"))
    sub = F.when(F.col("cut"), F.transform(mask, lambda m, s: F.struct(
        (F.col("b") * 8 + s + 1).alias("b"), F.xxhash64("k", F.col("p").bitwiseAND(m)).alias("k")))) \
        .otherwise(F.array(F.struct((F.col("b") * 8).alias("b"), F.col("k").alias("k"))))
    split = entries.select(F.explode(sub).alias("e"), "p").select("e.b", "e.k", "p")
    gray = F.col("p")
    for shift in (1, 2, 4, 8, 16, 32):                   # rank of a Gray code: every bit is the parity of the bits from it upwards
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))
    placed = split.repartition("b", "k").withColumn("g", gray).sortWithinPartitions("b", "k", "g")
    return placed.select(F.col("b").cast("long"), "k", "p").mapInArrow(_link_buckets, "a long, b long").distinct()


def near_duplicates(incidents: DataFrame, description: str = "description", incident_id: str = "incident_id") -> DataFrame:
    """Incidents with `fingerprint` (long), `component_id`, the smallest incident_id among all texts reachable by links, and
    `component_root`, the fingerprint that stands for the component.

    Texts link at MAX_BITS or fewer differing bits of their fingerprints. NULL texts count as empty; texts without words have
    fingerprint 0 and link like any other; repeated rows and equal texts share a component. NULL ids are never the smallest,
    a component of NULL ids alone has a NULL id. Every row and column stays; columns of these names are replaced.

    Equal fingerprints meet in one pre-aggregated row, so large groups of copies cost nothing further on; joins back to the
    rows have one row per fingerprint on the other side, and adaptive execution splits a fingerprint with many rows.
    """
    marked = written(small_batches(incidents).withColumn("fingerprint", F.arrow_udf(_fingerprints, "bigint")(content(description))), "prints")
    smallest = written(marked.groupBy("fingerprint").agg(F.min(incident_id).alias("least_id")), "prints")
    classes = written(placed(smallest, connected(fingerprint_links(smallest))).select("fingerprint", "component_root", "component_id"), "classes")
    return marked.drop("component_id", "component_root").join(classes, "fingerprint", "left")


def placed(smallest: DataFrame, root: DataFrame | None) -> DataFrame:
    """(fingerprint, least_id) with component_root and component_id by the roots (node, root) of linked fingerprints; None: none is linked."""
    rooted = smallest.withColumn("root", F.col("fingerprint")) if root is None else \
        smallest.join(root.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    low = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(low, "root").withColumnRenamed("root", "component_root")


def one_per_component(marked: DataFrame, incident_id: str = "incident_id") -> DataFrame:
    """Of each component the incident with the smallest id; where several rows have that id (or all are NULL), one of them."""
    return marked.where(F.col(incident_id).eqNullSafe(F.col("component_id"))).dropDuplicates(["component_root"])
