"""Incident texts that hold passages of benchmark items, found by winnowing.

The project keeps no benchmark, so items are a general table (item_id, text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import content, fresh, small_batches, written

WINDOW, GRAM = 10, 5
#: Bits of the filter that tells which fingerprints items have. Its size is fixed: 2**24 bits are 2 MB for any number of items.
FILTER_BITS = 24
_WORDS = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, at its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(_MULTIPLIER) + hashes[i:i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(_MULTIPLIER)


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the grams that are the minimum of some window of WINDOW words; equal minima all count.

    Any WINDOW words hold WINDOW - GRAM + 1 grams, and the least of them is kept wherever they stand: no shared span of that
    length goes unseen.
    """
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        return np.empty(0, int)
    low = np.lib.stride_tricks.sliding_window_view(grams, span).min(1)
    full = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(full, span).max(1) == grams)


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places in the filter; grams of different sizes have places of their own hash."""
    return ((hashes ^ np.uint64(size * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(_MULTIPLIER)) >> np.uint64(64 - FILTER_BITS)


def item_windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, size, span): each distinct window of every item, its words joined by spaces. Items without words have none."""
    @F.arrow_udf("array<struct<size:int,span:binary>>")
    def windows(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            w = words_of(t)
            size = min(WINDOW, len(w))
            rows.append([{"size": size, "span": s} for s in sorted({b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)})] if w else [])
        return pa.array(rows, pa.list_(pa.struct([("size", pa.int32()), ("span", pa.binary())])))
    return small_batches(items).select(F.col(item_id).alias("item_id"), F.explode(windows(content(text))).alias("w")).select("item_id", "w.size", "w.span").distinct()


def _fingerprint_filter(windows: DataFrame) -> tuple[bytes, list[int]]:
    """The bits of all window fingerprints, and the sizes of windows shorter than WINDOW. At most 2**FILTER_BITS bits and nine sizes."""
    @F.arrow_udf("array<int>")
    def slots(sizes: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for size, span in zip(sizes.to_pylist(), spans.to_pylist()):
            h = word_hashes(span.split(b" "))
            g = gram_hashes(h, GRAM if size == WINDOW else size)
            rows.append(_slot(g[winnowed(g)] if size == WINDOW else g, GRAM if size == WINDOW else 100 + size).astype(np.int32).tolist())
        return pa.array(rows, pa.list_(pa.int32()))
    # one row of 64-bit words per distinct word of the filter: its size is bounded whatever the items
    bit = windows.select(F.explode(slots("size", "span")).alias("s")).select(F.shiftright("s", 3).alias("byte"), F.expr("shiftleft(1, s & 7)").alias("bit"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in bit.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[row["byte"]] = row["bits"]
    sizes = sorted(r["size"] for r in windows.where(F.col("size") < WINDOW).select("size").distinct().collect())
    return bits.tobytes(), sizes


def candidate_windows(words: list[bytes], bits: np.ndarray, sizes: list[int]) -> list[tuple[int, int]]:
    """(start, size) of all windows around fingerprints that the filter has."""
    hashes, found = word_hashes(words), []

    def known(at: np.ndarray, grams: np.ndarray, size: int) -> np.ndarray:
        slot = _slot(grams[at], size)
        return at[(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]

    if len(words) >= WINDOW:
        grams = gram_hashes(hashes, GRAM)
        hits = known(winnowed(grams), grams, GRAM)
        if len(hits):
            starts = np.unique((hits[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            found += [(int(s), WINDOW) for s in starts[(starts >= 0) & (starts <= len(words) - WINDOW)]]
    for size in sizes:
        grams = gram_hashes(hashes, size)
        found += [(int(s), size) for s in known(np.arange(len(grams)), grams, 100 + size)]
    return found


def passages(incidents: DataFrame, items: DataFrame, description: str = "description", item_text: str = "text", item_id: str = "item_id"
             ) -> tuple[DataFrame, DataFrame]:
    """(incidents with n_words, t1, t2; hits): hits are (t1, t2, n_hit, item_ids) per distinct text with benchmark passages.

    t1 and t2 hash the text. Windows around fingerprints that pass the filter are compared word for word by a join on the
    window itself, so that neither the filter nor a hash decides. The join's item side has one row per window; a passage that a large
    share of the texts holds is a skewed key of the other side, which adaptive execution splits or broadcasts against.
    """
    windows = written(item_windows(items, item_text, item_id), "windows")
    bits, sizes = _fingerprint_filter(windows)
    shared = incidents.sparkSession.sparkContext.broadcast(bits)         # FILTER_BITS bound its size

    @F.arrow_udf("struct<n_words:bigint,at:array<struct<start:int,size:int,span:binary>>>")
    def look(texts: pa.Array) -> pa.Array:
        table = np.frombuffer(shared.value, np.uint8)
        counts, rows = [], []
        for t in texts.to_pylist():
            words = words_of(t)
            found = candidate_windows(words, table, sizes)
            counts.append(len(words))
            rows.append([{"start": s, "size": k, "span": b" ".join(words[s:s + k])} for s, k in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("span", pa.binary())]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(rows, kind)], names=["n_words", "at"])

    text, name = content(description), fresh(incidents, "seen")
    looked = small_batches(incidents).withColumn(name, look(text))
    candidates = looked.where(F.size(F.col(name)["at"]) > 0) \
        .select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"), F.col(name)["at"].alias("at"))
    candidates = written(candidates.select("t1", "t2", F.explode("at").alias("w")).select("t1", "t2", "w.*"), "candidates")
    by_span = windows.groupBy("size", "span").agg(F.collect_set("item_id").alias("items"))
    matched = written(candidates.join(by_span, ["size", "span"]), "matched")
    # words hit: runs of windows in order of their start, per text; copies of a text count once
    spans = matched.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("w"))
    covered = F.aggregate("w", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, w: F.struct(
        (a["n"] + F.greatest(F.lit(0), w["start"] + w["size"] - F.greatest(a["end"], w["start"]))).alias("n"),
        F.greatest(a["end"], w["start"] + w["size"]).alias("end")), lambda a: a["n"])
    named = matched.select("t1", "t2", F.explode("items").alias("item_id")).distinct().groupBy("t1", "t2").agg(F.collect_set("item_id").alias("item_ids"))
    hits = spans.select("t1", "t2", covered.cast("long").alias("n_hit")).join(named, ["t1", "t2"], "left")
    return looked, hits


def contamination(incidents: DataFrame, items: DataFrame, description: str = "description", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Incidents with n_words, n_hit, item_ids and contaminated (columns of these names are replaced); no row is dropped.

    A window is WINDOW consecutive words of an item, or all words of a shorter one; a word of a description is hit when it lies in
    an occurrence of a window; `item_ids` are the items with such windows. NULL and empty texts have no words and are clean;
    NULL item ids are not listed, but their windows hit; repeated rows and items change nothing.
    """
    text = content(description)
    k1, k2 = fresh(incidents, "k1"), fresh(incidents, "k2")
    looked, hits = passages(incidents, items, description, item_text, item_id)
    seen = looked.columns[-1]
    hits = written(hits, "hits").withColumnsRenamed({"t1": k1, "t2": k2, "n_hit": f"{k1}_n", "item_ids": f"{k1}_items"})
    out = looked.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("text"), text), "n_words": F.col(seen)["n_words"]}).drop(seen)
    out = out.join(hits, [k1, k2], "left")
    return out.withColumns({"n_hit": F.coalesce(f"{k1}_n", F.lit(0)).cast("long"), "item_ids": F.coalesce(F.col(f"{k1}_items"), F.array().cast(dict(hits.dtypes)[f"{k1}_items"])),
                            "contaminated": F.col(f"{k1}_n").isNotNull()}).drop(k1, k2, f"{k1}_n", f"{k1}_items")


def clean_only(incidents: DataFrame, items: DataFrame, description: str = "description", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The incidents that hold no window of an item, with their own columns only."""
    text = content(description)
    k1, k2 = fresh(incidents, "k1"), fresh(incidents, "k2")
    _, hits = passages(incidents, items, description, item_text, item_id)
    hits = written(hits.select(F.col("t1").alias(k1), F.col("t2").alias(k2)), "hits")
    return incidents.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("text"), text)}).join(hits, [k1, k2], "left_anti").drop(k1, k2)
