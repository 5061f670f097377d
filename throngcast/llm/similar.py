"""Near copies of incident texts: pairs whose word shingles have a Jaccard similarity of `similarity` or more, and their components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import content, fresh, small_batches, written
from .components import connected
from .decontaminate import gram_hashes, word_hashes
from .simhash import fingerprint_links, majority, placed

WORDS, SIMILARITY = 5, 0.8
#: Buckets below this are compared whole at once.
SMALL = 16
#: The order of shingles puts those last that are frequent; so many of them are told apart by their frequency at most. The order is free,
#: so this bounds what tasks are sent and not what is found.
FREQUENT = 1 << 18
#: Texts, or sets, in one batch.
FEW = 200
#: Least bits that stand for a set when pairs are ruled out, as many as shingles in larger ones; runs of entries up to this length are searched for pairs at once.
BITS, SHORT = 1024, 64
#: Rows of a frequent shingle are dealt to so many places.
SALTS = 64
#: Bits for each fingerprint in the filter of texts that are wanted, and the power of two its size ends at (8 MB).
FILTER_ROOM, FILTER_MOST = 16, 26
#: A task reports shingles that so many of its texts share; hashes it holds at once.
LOCAL, HELD = 3, 1 << 20


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words (of all words when there are fewer); words as in fingerprint()."""
    said = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(gram_hashes(word_hashes(said), min(words, len(said)))) if said else np.empty(0, np.uint64)


def _print(hashes: list[np.ndarray]) -> pa.Array:
    return pa.array(word_hashes([x.tobytes() for x in hashes]).view(np.int64), pa.int64())


def _sketches(words: int):
    """(p, n, f, bits) of each text: the hash of its set, the number of shingles, their SimHash, and bits that tell on which places an odd
    number of them falls, a power of two and at least as many as shingles."""
    def odd(hashes: np.ndarray) -> bytes:
        size = max(BITS, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else BITS
        return np.packbits(np.bincount(((hashes >> np.uint64(20)) % np.uint64(size)).astype(np.int64), minlength=size) & 1 == 1).tobytes()

    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t, words) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([_print(sets), pa.array([len(s) for s in sets], pa.int32()), pa.array([majority(s) for s in sets], pa.int64()), pa.array([odd(s) for s in sets], pa.binary())], names=["p", "n", "f", "bits"])
    return run


def _sets(words: int):
    return lambda texts: pa.array([shingles(t, words).tobytes() for t in texts.to_pylist()], pa.binary())


def _apart(left: bytes, right: bytes) -> int:
    """Places where the bits of two sets differ; those of the larger one are folded to as many as the other has."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _may_be_similar(similarity: float):
    """Whether bits leave room for similarity: where two sets differ in a bit, one has a shingle that the other lacks."""
    def run(left: pa.Array, right: pa.Array, sizes: pa.Array) -> pa.Array:
        apart = np.fromiter(map(_apart, left.to_pylist(), right.to_pylist()), np.int64, len(left))
        return pa.array(apart <= sizes.to_numpy() * ((1 - similarity) / (1 + similarity)) + 1e-9, pa.bool_())
    return run


def _crowds(words: int):
    """(shingle, texts) for the shingles that LOCAL or more texts share, over HELD hashes at a time."""
    def counted(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["w", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, words))
                size += len(held[-1])
                if size >= HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)
    return run


def frequent(texts: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most FREQUENT, sorted, and roughly how many of the texts (one column) have them."""
    counts = written(small_batches(texts, FEW).mapInArrow(_crowds(words), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "crowds")
    level = F.floor(F.log2("n")).cast("int")
    left, least = FREQUENT, 64
    for one, n in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):      # at most 63 rows
        if n > left:
            break
        left, least = left - n, one
    rows = counts.where(level >= least).toArrow()
    values, often = (rows[c].to_numpy() for c in ("w", "n"))
    order = np.argsort(values.view(np.uint64))
    return values.view(np.uint64)[order], often[order]


def first_shingles(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of which two similar sets share at least one: the first ones, rare before frequent, then by hash."""
    n = len(hashes)
    values, often = common
    weight = np.zeros(n, np.int64)
    if len(values) and n:
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        weight = np.where(values[at] == hashes, often[at], 0)
    return hashes[np.lexsort((hashes, weight))[:n - math.ceil(similarity * n - 1e-9) + 1]]


def _entries(words: int, similarity: float, common):
    """(p, n, firsts) of each text: the hash of its set, its number of shingles, and its first shingles with place, and whether they are among the frequent ones."""
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t, words) for t in texts.to_pylist()]
        firsts = [first_shingles(s, common.value, similarity) for s in sets]
        ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
        flat = np.concatenate([np.empty(0, np.uint64), *firsts])
        values = common.value[0]
        often = np.zeros(len(flat), bool)
        if len(values):
            often = values[np.minimum(np.searchsorted(values, flat), len(values) - 1)] == flat
        places = np.arange(len(flat), dtype=np.int32) - np.repeat(ends[:-1], np.diff(ends))
        entries = pa.StructArray.from_arrays([pa.array(places), pa.array(flat.view(np.int64)), pa.array(often)], names=["i", "k", "often"])
        return pa.StructArray.from_arrays([_print(sets), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=["p", "n", "firsts"])
    return run


def _partnered(starts: np.ndarray, ends: np.ndarray, n: np.ndarray, i: np.ndarray, similarity: float) -> np.ndarray:
    """Which entries of the short runs [start, end) have a partner in their run whose size and place allow similarity."""
    sizes = ends - starts
    left = np.repeat(np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)] or [np.empty(0, int)]), np.repeat(sizes, sizes))
    first = np.repeat(np.repeat(starts, sizes), np.repeat(sizes, sizes))
    step = np.arange(len(left)) - np.repeat(np.cumsum(np.concatenate(([0], np.repeat(sizes, sizes)[:-1]))) if len(left) else np.empty(0, int), np.repeat(sizes, sizes))
    right = first + step
    a, b = n[left].astype(float), n[right].astype(float)
    room = np.minimum(a - i[left], b - i[right]) >= np.ceil((a + b) * (similarity / (1 + similarity)) - 1e-9)
    found = np.zeros(len(n), bool)
    found[left[(left != right) & room & (np.minimum(a, b) >= np.maximum(a, b) * similarity - 1e-9)]] = True
    return found


def _shared_entries(similarity: float):
    return lambda batches: _shared(batches, similarity)


def _shared(batches, similarity: float):
    """Of rows (k, salt, p, n, i, often) sorted by k, salt and p: those of shingles that several texts have, each text once.

    Frequent shingles are known to be shared, so their salts need no counting, and a run that is known to be shared is passed on as it comes.
    Of short runs only entries with a possible partner are passed on.
    """
    held, open_ = None, False
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate((a, b)) for a, b in zip(held, rows)]
        k, salt, p, often = rows[0], rows[1], rows[2], rows[5]
        run = np.concatenate(([True], (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])))
        single = run | np.concatenate(([True], p[1:] != p[:-1]))
        starts = np.flatnonzero(run)
        shared = (np.add.reduceat(single.astype(np.int64), starts) > 1) | often[starts]
        shared[0] |= open_
        ends = np.append(starts[1:], len(k))
        out = single & np.repeat(shared, ends - starts)
        whole = np.arange(len(starts)) < len(starts) - 1            # the last run may go on
        whole[0] &= not open_
        few = whole & shared & ~often[starts] & (ends - starts <= SHORT)
        out &= ~np.repeat(few, ends - starts) | _partnered(starts[few], ends[few], rows[3], rows[4], similarity)
        if open_:
            out[0] = False                               # passed on with the batch before
        open_ = bool(shared[-1]) and (open_ and len(starts) == 1 or len(k) - starts[-1] > SHORT or bool(often[starts[-1]]))
        keep = len(k) - 1 if open_ else starts[-1]
        if not open_:
            out[keep:] = False
        held = [c[keep:] for c in rows]
        if out.any():
            yield _passed(rows, out)
    if held is not None and not open_:                   # the last run of all
        rows, single = held, np.concatenate(([True], held[2][1:] != held[2][:-1]))
        if single.sum() > 1 or rows[5][0]:
            out = single if rows[5][0] or len(single) > SHORT else single & _partnered(np.array([0]), np.array([len(single)]), rows[3], rows[4], similarity)
            yield _passed(rows, out)


def _passed(rows: list[np.ndarray], out: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c][out]) for c in (0, 2, 3, 4)], names=["k", "p", "n", "i"])


def _similar(similarity: float):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.sort(np.concatenate((x, y)))
            shared = int((both[1:] == both[:-1]).sum())
            out.append(shared / (len(both) - shared) >= similarity)
        return pa.array(out, pa.bool_())
    return run


def _needed(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that sets of n and m share when they are similar."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def _wanted(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """The texts (t, said) whose hash t is among prints (t, p), each once with p. A filter of bounded size leaves most others where they are."""
    power = min(FILTER_MOST, max(16, math.ceil(math.log2(FILTER_ROOM * prints.count() + 1))))
    at = F.pmod("t", F.lit(1 << power))
    held = prints.groupBy(F.floor(at / 32).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << (power - 5), np.uint32)
    bits[held["at"].to_numpy()] = held["bits"].to_numpy().astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may_be(hashes: pa.Array) -> pa.Array:
        places = hashes.to_numpy() & ((1 << power) - 1)
        return pa.array((shared.value[places >> 5] >> (places & 31).astype(np.uint32)) & 1 == 1, pa.bool_())
    return texts.where(may_be("t")).join(prints, "t").dropDuplicates(["t"]).select("p", "said")


def _index_pairs(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints the index of op6 links (see fingerprint_links); sets of one fingerprint meet one of them."""
    prints = sketches.where("n > 0").select("f", "p")
    heads = written(prints.groupBy("f").agg(F.min("p").alias("head")), "heads")
    far = fingerprint_links(heads, "f")
    for side, end in (("a", "x"), ("b", "y")):
        far = far.join(heads.select(F.col("f").alias(side), F.col("head").alias(end)), side)
    pairs = far.select("x", "y").unionAll(prints.join(heads, "f").where("p != head").select("head", "p"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _checked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar: sizes and bits rule out most others, whole sets decide."""
    similar, room = F.arrow_udf(_similar(similarity), "boolean"), F.arrow_udf(_may_be_similar(similarity), "boolean")
    whole = F.arrow_udf(_sets(words), "binary")
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("p").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    n, m = F.col("n_a"), F.col("n_b")
    fit = small_batches(pairs).where(F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9).where(room("bits_a", "bits_b", n + m))
    pairs = written(fit.select("a", "b"), "pairs")
    needed = written(sketches.select("p", "t").join(pairs.select(F.explode(F.array("a", "b")).alias("p")).distinct(), "p", "left_semi").select("t", "p"), "needed")
    said = written(_wanted(texts, needed), "texts")
    for side in ("a", "b"):
        pairs = pairs.join(said.select(F.col("p").alias(side), F.col("said").alias(f"said_{side}")), side)
    return written(small_batches(pairs, FEW).where(similar(whole("said_a"), whole("said_b"))).select("a", "b"), "links")


def _linked(members: DataFrame, sketches: DataFrame, check, similarity: float) -> DataFrame | None:
    """(node, root) of the components that similar pairs of sets form; None without a link. check(pairs, sketches) leaves the similar pairs.

    First the pairs that op6's index finds are checked, and link what they can. The rest is found exactly, in buckets (k, p, n, i):
    k is a shingle that the set p of n has at place i of its order. A pair whose sizes, or places of the shared shingle, leave too little in
    common is not compared: where it is similar after all, it shares an earlier shingle. In each round some members of a bucket, its centres,
    meet all members of other components, and leave the bucket; buckets of one component are done. Small buckets have all members as
    centres, large ones two at first and four times as many from round to round, so a group of copies is one component after few
    comparisons, and yet every pair of a bucket is looked at unless links join it already.
    """
    links = check(_index_pairs(sketches), sketches)
    root, centres = None if links.isEmpty() else connected(links), 2
    while True:
        if root is None:
            now = members.withColumn("c", F.col("p"))
        else:
            now = members.join(root.withColumnRenamed("node", "p"), "p", "left").select("k", "p", "n", "i", F.coalesce("root", "p").alias("c"))
        rank = F.xxhash64("p")
        state = now.groupBy("k").agg(F.count("*").alias("size"), F.min(rank).alias("first"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        share = F.shiftrightunsigned(rank, 11) / F.lit(float(1 << 53)) * F.col("size") < centres
        split = written(now.join(state.select("k", "size", "first"), "k")
                        .select("k", "p", "n", "i", "c", ((F.col("size") < SMALL) | (rank == F.col("first")) | share).alias("centre")), "buckets")
        one = split.where("centre").select("k", F.col("p").alias("q"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
        if one.isEmpty():
            return root
        n, m = F.col("n"), F.col("m")
        apart = F.least(n - F.col("i"), m - F.col("j")) >= _needed(n, m, similarity)
        sizes = (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9) & apart
        pairs = split.join(one, "k").where("c != d").where(sizes).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        # only sets that are still in a bucket move from here on
        sketches = written(sketches.join(split.select("p").distinct(), "p", "left_semi"), "sketches")
        found = check(pairs, sketches)
        links = links.unionAll(found)
        if not found.isEmpty():
            root = connected(links)
        members, centres = split.where("NOT centre").select("k", "p", "n", "i"), centres * 4


def _components(incidents: DataFrame, description: str, incident_id: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(fingerprint, first, component_root, component_id) for each set, and (t, fingerprint) for each text of hash t. `first` is (no_id, id, t) of the
    set's row with the smallest id."""
    texts = incidents.select(F.col(incident_id).alias("id"), F.xxhash64(content(description)).alias("t"), content(description).alias("said"))
    sketch = F.arrow_udf(_sketches(words), "struct<p:bigint,n:int,f:bigint,bits:binary>")
    marked = written(small_batches(texts, FEW).select("id", "t", sketch("said").alias("s")).select("id", "t", "s.*"), "marked")
    sketches = written(marked.groupBy("p").agg(F.min("t").alias("t"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "t")).alias("first"), F.min("n").alias("n"), F.min("f").alias("f"), F.first("bits").alias("bits")), "sketches")
    common = marked.sparkSession.sparkContext.broadcast(frequent(texts.select("said"), words))
    entry = F.arrow_udf(_entries(words, similarity, common), "struct<p:bigint,n:int,firsts:array<struct<i:int,k:bigint,often:boolean>>>")
    listed = small_batches(texts, FEW).select(entry("said").alias("e")).select("e.p", "e.n", F.inline("e.firsts"))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("p"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")).alias("salt")
    dealt = listed.select("k", salt, "p", "n", "i", "often").repartition("k", "salt").sortWithinPartitions("k", "salt", "p")
    shared = written(dealt.mapInArrow(_shared_entries(similarity), "k long, p long, n int, i int"), "entries")
    # a pair needs a member that has the shingle early enough for a partner of its own size
    early = F.min(F.when(F.col("n") - F.col("i") >= _needed(F.col("n"), F.col("n"), similarity), 1))
    crowded = shared.groupBy("k").agg(F.count("*").alias("size"), early.alias("early")).where("size > 1 AND early = 1").select("k")
    members = shared.join(crowded, "k").select("k", "p", "n", "i")
    check = lambda pairs, of: _checked(pairs, of, texts.select("t", "said"), words, similarity)
    root = _linked(members, sketches.select("p", "t", "n", "f", "bits"), check, similarity)
    classes = placed(sketches.select(F.col("p").alias("fingerprint"), F.col("first.id").alias("least_id"), "first"), root).drop("least_id")
    return written(classes, "classes"), marked.select("t", F.col("p").alias("fingerprint")).distinct()


def near_copies(incidents: DataFrame, description: str = "description", incident_id: str = "incident_id", words: int = WORDS,
                similarity: float = SIMILARITY) -> DataFrame:
    """Incidents with `fingerprint` (a hash of the shingle set), `component_id` and `component_root`, as near_duplicates has them.

    Texts link when the Jaccard similarity of their sets of `words`-word shingles is `similarity` or more; no link is lost (but for equal 64-bit
    hashes). SimHash fingerprints of the sets go through the Gray-ordered index of op6, whose links are checked by whole sets; few bits
    are too few for this similarity, so what else is similar is found in an order with frequent shingles last, where similar sets share one
    of their first shingles (prefix filter): those make the buckets, so a passage that many texts share makes none unless there is little else
    in them. Sizes and places rule out most pairs of a bucket, and whole sets decide the others. Texts stay where they are but for those of
    pairs to decide. NULL texts count as empty, and texts without words share a component; repeated rows share one as well, NULL
    ids are never the smallest. Columns of the three names are replaced. The incidents are read several times: store what is slow to build.
    """
    classes, prints = _components(incidents, description, incident_id, words, similarity)
    key = fresh(incidents, "text_hash")
    named = prints.join(classes, "fingerprint").select(F.col("t").alias(key), "fingerprint", "component_root", "component_id")
    left = incidents.drop("fingerprint", "component_root", "component_id").withColumn(key, F.xxhash64(content(description)))
    return left.join(named, key, "left").drop(key)


def one_of_near_copies(incidents: DataFrame, description: str = "description", incident_id: str = "incident_id", words: int = WORDS,
                       similarity: float = SIMILARITY) -> DataFrame:
    """Of each component of near_copies the incident with the smallest id; where several rows have that id (or all are NULL), one of them.

    Same rows as one_per_component(near_copies()), but they move once: text and id of the row that stays are known beforehand.
    """
    classes, _ = _components(incidents, description, incident_id, words, similarity)
    names = [fresh(incidents, x) for x in ("text_hash", "id_text", "no_id")]
    key = lambda of, t: (t, F.coalesce(of.cast("string"), F.lit("")), of.isNull())
    first = classes.groupBy("component_root").agg(F.min("first").alias("first")).select(*[c.alias(x) for c, x in zip(key(F.col("first.id"), F.col("first.t")), names)])
    keyed = incidents.select("*", *[c.alias(x) for c, x in zip(key(F.col(incident_id), F.xxhash64(content(description))), names)])
    return keyed.join(first, names).dropDuplicates(names).select(*incidents.columns)
