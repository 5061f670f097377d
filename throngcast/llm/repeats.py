"""Repeated byte strings across incident texts, by the common-prefix interval tree of an enhanced suffix array.

Every string of LENGTH bytes is a window. The least hash among a window's grams (leftmost of equals) is its anchor, which depends on the
window's bytes alone, so equal windows of any texts have equal anchors. Consecutive windows with one anchor travel together as a
segment to the bucket of the anchor's hash; segments of anchors that a single text has never travel. In each bucket, an
enhanced suffix array over the segments yields the maximal repeat groups with all their occurrences.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .common import content, fresh, small_batches, written

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1                                 # grams in a window
WIDTH = 2 * LENGTH - GRAM                                # bytes of the longest segment
_MUL, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_POSITION = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 20
NEVER = np.iinfo(np.int64).max                           # order of a NULL id: after all others


def _table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    return x ^ (x >> np.uint64(27))


_BYTE = _table()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by doubling."""
    out, width = _BYTE[data], 1
    while width < GRAM:
        out = out[:-width] * np.uint64(pow(_MUL, width, 2**64)) + out[width:]
        width *= 2
    out = (out ^ (out >> np.uint64(31))) * _MIX1
    return out ^ (out >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, n, size = values, len(values) - width + 1, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[:n], out[width - size:width - size + n])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows, text number) of the segments of texts data[starts[i]:ends[i]]."""
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), _CHUNK):          # a segment cut by a chunk's end is two segments
        piece = data[at:at + _CHUNK + LENGTH - 1]
        hashes = _gram_hashes(piece)
        least = _sliding_min((hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64), SPAN)
        anchor = (least & _POSITION).astype(np.int64)
        place = np.arange(at, at + len(anchor))
        text = np.searchsorted(ends, place, side="right")
        valid = place + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
        place, anchor, text = place[valid], anchor[valid], text[valid]
        if len(place):
            first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (np.diff(place) != 1))))
            parts.append((hashes[anchor[first]], place[first], np.diff(np.append(first, len(place))), text[first]))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends[:-1])), ends


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are minima, so their hashes are small numbers; they are mixed once more to spread evenly."""
    return (((hashes * _MIX2) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(**columns: np.ndarray | bytes) -> bytes:
    return zstandard.compress(pickle.dumps(columns, protocol=5), 3)


def _unpacked(blob: bytes) -> dict:
    return pickle.loads(zstandard.decompress(blob))


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the positions that have it."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(order) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(order)) if len(order) else []):
        yield int(keys[order[a]]), order[a:b]


def _rows(pairs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([p for p, _ in pairs], pa.int64()), "blob": pa.array([b for _, b in pairs], pa.binary())})


_BLOBS = "part bigint, blob binary"


def _hash_words(rows: np.ndarray) -> np.ndarray:
    """64 bits for each row of bytes (a multiple of eight wide)."""
    out = np.zeros(len(rows), np.uint64)
    for word in rows.view(np.uint64).reshape(len(rows), rows.shape[1] // 8).T:
        out = (out ^ word) * _MIX2
        out ^= out >> np.uint64(32)
    return out


def _segment_bytes(data: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Rows of 88 bytes: each segment, zeros after its end."""
    wide = -(-WIDTH // 8) * 8
    padded = np.concatenate((data, np.zeros(wide, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[first]
    rows[np.arange(wide) >= (windows + LENGTH - 1)[:, None]] = 0
    return rows


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(from, to, length): intervals order[from:to + 1] of suffixes that share `length` >= least bytes and cannot be extended.

    lcp[i] is the common prefix of suffixes order[i - 1] and order[i]. One scan with a stack visits the common-prefix interval
    tree: an interval opens where the common prefix grows and closes where it falls. An interval whose suffixes all follow the same
    byte is part of a longer repeat and is left out; left[i] is the byte before suffix order[i], or below 0 at a segment's start.
    """
    differs = np.concatenate(([0], (left[1:] != left[:-1]) | (left[1:] < 0))).cumsum()
    n, stack = len(order), []                            # (length, from)
    values = [*lcp.tolist(), 0]
    for i in range(1, n + 1):
        start, now = i - 1, values[i]
        while stack and stack[-1][0] > now:
            length, start = stack.pop()
            if length >= least and (differs[i - 1] > differs[start] or left[start] < 0):
                yield start, i - 1, length
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, start))


def least_orders(rows: np.ndarray, windows: np.ndarray, order_of: np.ndarray) -> np.ndarray:
    """For distinct segments, the smallest order among all that hold each window: one value per window, segment after segment.

    The suffixes of the segments at which a window starts are sorted; neighbours' common prefixes, cut at segment ends, complete the
    enhanced array. Each maximal repeat group gives all windows inside it the smallest order of its segments.
    """
    of = np.repeat(np.arange(len(rows)), windows)
    base = np.cumsum(windows) - windows
    at = np.arange(len(of)) - base[of]
    wide = np.concatenate((rows, np.zeros((len(rows), 8), np.uint8)), 1)
    flat, stride = wide.ravel(), wide.shape[1]
    begin = of * stride + at
    words = [np.zeros(len(of), np.uint64) for _ in range(7)]
    for b in range(LENGTH):
        words[b // 8] = (words[b // 8] << np.uint64(8)) | flat[begin + b]
    order = np.lexsort(words[::-1])
    same = np.ones(len(order) - 1, bool)
    for w in words:
        same &= w[order[1:]] == w[order[:-1]]
    # suffixes that share a whole window are put in order by what follows, up to their segments' ends
    run = np.concatenate(([0], np.cumsum(~same)))
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    if len(tied):
        where, tail = order[tied], [np.zeros(len(tied), np.uint64) for _ in range(5)]
        end = (of[where] + 1) * stride - 1               # a zero, as are all bytes after a segment
        for b in range(WIDTH - LENGTH):
            tail[b // 8] = (tail[b // 8] << np.uint64(8)) | flat[np.minimum(begin[where] + LENGTH + b, end)]
        order[tied] = where[np.lexsort((*tail[::-1], run[tied]))]
    lcp = np.zeros(len(order), np.int64)
    near = np.flatnonzero(same)
    a, b = order[near], order[near + 1]
    rest = np.minimum(windows[of[a]] - at[a], windows[of[b]] - at[b]) - 1          # bytes beyond the first window
    more, going = np.zeros(len(near), np.int64), np.ones(len(near), bool)
    for i in range(LENGTH - GRAM):
        going &= (rest > i) & (flat[np.minimum(begin[a] + LENGTH + i, len(flat) - 1)] == flat[np.minimum(begin[b] + LENGTH + i, len(flat) - 1)])
        if not going.any():
            break
        more += going
    lcp[near + 1] = LENGTH + more
    left = np.where(at[order] > 0, flat[np.maximum(begin[order] - 1, 0)].astype(np.int64), -1)
    least = order_of[of].copy()
    rank_order = order_of[of[order]]
    alive = np.flatnonzero(np.concatenate((lcp[1:] >= LENGTH, [False])) | (lcp >= LENGTH))
    lcp_, left_, orders_, order_ = lcp[alive], left[alive], rank_order[alive], order[alive]
    for start, end, length in maximal_repeats(order_, lcp_, left_):
        low = orders_[start:end + 1].min()
        where = order_[start:end + 1]
        for shift in range(length - LENGTH + 1):
            least[where + shift] = np.minimum(least[where + shift], low)
    return least


def _anchor_blobs(buckets: int, groups: int, unit: int):
    """First pass: anchor hashes of whole units of texts, each with the text groups that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []

        def emit() -> pa.RecordBatch:
            data, starts, ends = _buffer([t for _, t in held])
            hashes, _, _, text = segments(data, starts, ends)
            group = np.array([g for g, _ in held], np.int64)[text] if len(text) else text
            order = np.lexsort((text, hashes))
            hashes, text, group = hashes[order], text[order], group[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, bool)
            run_ = np.cumsum(new) - 1
            firsts = np.flatnonzero(new)
            shared = np.maximum.reduceat(text, firsts) != np.minimum.reduceat(text, firsts) if len(firsts) else np.empty(0, bool)
            out = []
            # an anchor of several texts here is shared whatever others have: its groups need no bucket, one mark does
            for bucket, at in _by(_bucket(hashes[firsts], buckets)):
                one = firsts[at]
                out.append((bucket, _packed(h=hashes[one], g=np.where(shared[at], -1, group[one]).astype(np.int32))))
            known = np.flatnonzero(shared[run_]) if len(run_) else np.empty(0, int)
            if len(known):
                pairs = np.unique(np.stack((group[known].astype(np.uint64), hashes[known]), 1), axis=0)
                out.append((-1 - int(pairs[0, 1] % np.uint64(buckets)), _packed(h=pairs[:, 1], g=pairs[:, 0].astype(np.int32))))
            held.clear()
            return _rows(out).to_batches()[0] if out else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["part", "blob"])

        size = 0
        for batch in batches:
            for g, z in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist()):
                held.append((g, z))
                size += len(z)
                if size >= unit:
                    yield emit()
                    size = 0
        if held:
            yield emit()
    return run


def _shared_anchors(blobs: pa.Table) -> pa.Table:
    """Per text group, the anchors of one bucket that more than one text has."""
    parts = [_unpacked(b) for b in blobs.column("blob").to_pylist()]
    hashes, group = np.concatenate([p["h"] for p in parts]), np.concatenate([p["g"] for p in parts])
    if blobs.column("part")[0].as_py() >= 0:
        order = np.argsort(hashes, kind="stable")
        hashes, group = hashes[order], group[order]
        firsts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        sizes = np.diff(np.append(firsts, len(hashes)))
        shared = (sizes > 1) | (np.minimum.reduceat(group, firsts) < 0)
        keep = np.repeat(shared, sizes) & (group >= 0)
        hashes, group = hashes[keep], group[keep]
    return _rows([(g, _packed(h=np.unique(hashes[at]))) for g, at in _by(group)])


def _texts(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    texts = [zstandard.decompress(z) for z in docs.column("z").to_pylist()]
    return *_buffer(texts), docs.column("place").to_numpy(), texts


def _marked_segments(docs: pa.Table, known: np.ndarray):
    """Segments of the texts whose anchor is in `known` (sorted): (hash, first, windows, text, rows, key)."""
    data, starts, ends, place, texts = _texts(docs)
    hashes, first, windows, text = segments(data, starts, ends)
    if len(known) and len(hashes):
        hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
    else:
        hit = np.zeros(len(hashes), bool)
    hashes, first, windows, text = (x[hit] for x in (hashes, first, windows, text))
    rows = _segment_bytes(data, first, windows) if len(first) else np.empty((0, -(-WIDTH // 8) * 8), np.uint8)
    key = _hash_words(rows) + windows.astype(np.uint64)
    return data, starts, ends, place, hashes, first, windows, text, rows, key


def _known(returned: pa.Table) -> np.ndarray:
    parts = [_unpacked(b)["h"] for b in returned.column("blob").to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _segment_blobs(buckets: int):
    """Second pass: the distinct segments of a text group with shared anchors, with the smallest and largest order of their texts."""
    def run(docs: pa.Table, returned: pa.Table) -> pa.Table:
        known = _known(returned)
        if not docs.num_rows or not len(known):
            return _rows([])
        _, _, _, place, hashes, _, windows, text, rows, key = _marked_segments(docs, known)
        group, order = docs.column("group")[0].as_py(), np.lexsort((key, hashes))
        if not len(order):
            return _rows([])
        firsts = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))))
        one, orders = order[firsts], place[text[order]]
        low, high = np.minimum.reduceat(orders, firsts), np.maximum.reduceat(orders, firsts)
        out = []
        for bucket, at in _by(_bucket(hashes[one], buckets)):
            pick = one[at]
            inside = np.arange(rows.shape[1]) < (windows[pick] + LENGTH - 1)[:, None]
            out.append((bucket, _packed(group=group, h=hashes[pick], key=key[pick], n=windows[pick].astype(np.uint8), low=low[at], high=high[at], said=rows[pick][inside].tobytes())))
        return _rows(out)
    return run


def _group_orders(blobs: pa.Table) -> pa.Table:
    """Per text group, runs of windows in its segments that a text of smaller order holds, with that order."""
    parts = [_unpacked(b) for b in blobs.column("blob").to_pylist()]
    hashes, key, n, low, high = (np.concatenate([p[c] for p in parts]) for c in ("h", "key", "n", "low", "high"))
    group = np.repeat([p["group"] for p in parts], [len(p["h"]) for p in parts])
    n = n.astype(np.int64)
    data = np.frombuffer(b"".join(p["said"] for p in parts), np.uint8)
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    order = np.lexsort((key, hashes))
    firsts = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(order))))
    one, least = order[firsts], np.minimum.reduceat(low[order], firsts)
    h = hashes[one]
    alone = np.concatenate(([True], h[1:] != h[:-1])) & np.concatenate((h[1:] != h[:-1], [True]))
    windows = n[one]
    base = np.cumsum(windows) - windows
    orders = np.repeat(least, windows)                   # an anchor with one segment: that segment's own texts
    mixed = np.flatnonzero(~alone)
    step = max(1, (1 << 19) // (LENGTH - GRAM))
    cuts = [0]
    while cuts[-1] < len(mixed):                         # whole anchors at a time, in bounded memory
        end = min(len(mixed), cuts[-1] + step)
        while end < len(mixed) and h[mixed[end]] == h[mixed[end - 1]]:
            end += 1
        cuts.append(end)
    for a, b in zip(cuts, cuts[1:]):
        pick = mixed[a:b]
        found = least_orders(_segment_bytes(data, begin[one[pick]], windows[pick]), windows[pick], least[pick])
        into = np.repeat(base[pick] - np.cumsum(windows[pick]) + windows[pick], windows[pick]) + np.arange(len(found))
        orders[into] = found
    # runs of equal order inside each distinct segment
    of = np.repeat(np.arange(len(one)), windows)
    start = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (orders[1:] != orders[:-1]))))
    length, run_of = np.diff(np.append(start, len(of))), of[start]
    run_first = np.searchsorted(run_of, np.arange(len(one)))
    run_count = np.bincount(run_of, minlength=len(one))
    total = run_count[entry]
    source = np.repeat(np.arange(len(entry)), total)
    run_ = run_first[entry][source] + np.arange(len(source)) - np.repeat(np.cumsum(total) - total, total)
    useful = orders[start[run_]] < high[source]
    source, run_ = source[useful], run_[useful]
    out = []
    for g, at in _by(group[source]):
        s, r = source[at], run_[at]
        out.append((g, _packed(h=hashes[s], key=key[s], at=(start[r] - base[run_of[r]]).astype(np.uint8), n=length[r].astype(np.uint8), order=orders[start[r]])))
    return _rows(out)


def _removal(columns: list[str]):
    """Third pass: the texts of a group without the bytes that windows of smaller texts cover."""
    def run(docs: pa.Table, results: pa.Table) -> pa.Table:
        parts = [_unpacked(b) for b in results.column("blob").to_pylist()]
        known = np.unique(np.concatenate([p["h"] for p in parts])) if parts else np.empty(0, np.uint64)
        data, starts, ends, place, hashes, first, _, text, _, key = _marked_segments(docs, known)
        covered = np.zeros(len(data) + 1, np.int32)
        if len(first) and parts:
            rk, rh, at, n, low = (np.concatenate([p[c] for p in parts]) for c in ("key", "h", "at", "n", "order"))
            order = np.lexsort((rh, rk))
            rk, rh, at, n, low = rk[order], rh[order], at[order].astype(np.int64), n[order].astype(np.int64), low[order]
            a, b = np.searchsorted(rk, key, "left"), np.searchsorted(rk, key, "right")
            count = b - a
            of = np.repeat(np.arange(len(key)), count)
            r = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            hit = (rh[r] == hashes[of]) & (low[r] < place[text[of]])
            of, r = of[hit], r[hit]
            np.add.at(covered, first[of] + at[r], 1)
            np.add.at(covered, first[of] + at[r] + n[r] + LENGTH - 1, -1)
        gone = covered[:-1].cumsum() > 0
        edge = gone & ~np.concatenate(([False], gone[:-1]))
        edge[starts[starts < len(data)]] |= gone[starts[starts < len(data)]]
        removed = np.concatenate(([0], np.cumsum(gone)))
        spans = np.concatenate(([0], np.cumsum(edge)))
        kept = [data[s:e][~gone[s:e]].tobytes() if removed[e] > removed[s] else data[s:e].tobytes() for s, e in zip(starts, ends)]
        return pa.table({"uid": docs.column("uid"), "n_bytes": pa.array(ends - starts), "n_removed": pa.array(removed[ends] - removed[starts], pa.int64()),
                         "n_spans": pa.array(spans[ends] - spans[starts], pa.int64()), "kept": pa.array(kept, pa.binary())})
    return run


def _compress(texts: pa.Array) -> pa.Array:
    return pa.array([zstandard.compress(t, 3) for t in texts.to_pylist()], pa.binary())


def remove_repeats(incidents: DataFrame, description: str = "description", incident_id: str = "incident_id", part_bytes: int = 6 << 20,
                   unit_bytes: int = 8 << 20) -> DataFrame:
    """(incident_id, n_bytes, n_removed, n_spans, kept) for every incident.

    Removes each byte covered by a string of LENGTH bytes that also starts in a description with a smaller incident_id (ids of any type, in its order). Strings
    are judged on the input; matches never cross texts; n_spans counts maximal removed runs; kept holds the remaining UTF-8
    bytes (binary, as a cut may split a character). NULL texts are empty. A NULL id is larger than all others; of rows with one id,
    none is smaller, so repeats among them alone stay. Other columns are ignored, an empty table gives an empty result.

    Texts are dealt to groups by id, anchors and segments to buckets by hash, about part_bytes each. Copies inside a group or unit of texts
    travel once, so a bucket gets at most one row per group and distinct segment however many texts share a passage, and results go back to
    groups, which find their segments again. No list of documents, anchors or repeats reaches the driver.
    """
    rows = incidents.select(F.col(incident_id).alias("uid"), F.encode(content(description), "UTF-8").alias("text"))
    if isinstance(rows.schema["uid"].dataType, IntegralType):
        rows = rows.withColumn("place", F.coalesce(F.col("uid").cast("long"), F.lit(NEVER)))
    else:                                                 # ids of other types are compared by their place in their own order
        ordered = rows.select("uid").where(F.col("uid").isNotNull()).distinct().repartitionByRange("uid").sortWithinPartitions("uid")
        places = written(ordered.withColumn("place", F.monotonically_increasing_id()), "places")
        rows = rows.join(places, "uid", "left").withColumn("place", F.coalesce("place", F.lit(NEVER)))
    rows = rows.select("uid", "place", "text")
    total, n, distinct = rows.agg(F.sum(F.octet_length("text")), F.count("*"), F.count_distinct("uid")).first()
    repeated = n != distinct
    if repeated:                                          # ids alone do not tell rows apart: number them, once
        rows = written(rows.withColumnRenamed("uid", "own").withColumn("uid", F.monotonically_increasing_id()), "rows")
    parts = max(8, -(-(total or 0) // part_bytes))
    rows = small_batches(rows).withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    anchors = rows.select("group", "text").mapInArrow(_anchor_blobs(parts, parts, unit_bytes), _BLOBS)
    shared = anchors.groupBy("part").applyInArrow(_shared_anchors, _BLOBS)
    docs = rows.select("group", "uid", "place", F.arrow_udf(_compress, "binary")("text").alias("z"))
    sent = docs.groupBy("group").cogroup(shared.groupBy("part")).applyInArrow(_segment_blobs(parts), _BLOBS)
    results = sent.groupBy("part").applyInArrow(_group_orders, _BLOBS)
    kind = dict(rows.dtypes)["uid"]
    cut = docs.groupBy("group").cogroup(results.groupBy("part")).applyInArrow(
        _removal(rows.columns), f"uid {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    if repeated:
        cut = cut.join(rows.select("uid", "own"), "uid").drop("uid").withColumnRenamed("own", "uid")
    return cut.select(F.col("uid").alias("incident_id"), "n_bytes", "n_removed", "n_spans", "kept")
