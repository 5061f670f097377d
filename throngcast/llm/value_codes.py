"""Compressed clip features: product codes whose distances come from value dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, written
from .vectors import floored, matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are added up at once.
STEP = 1024


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each (rows, parts), of integer vectors against books (parts, entries, width).

    Every dimension has a dictionary of its distinct integers and a table of their squared differences to all entries;
    the distance of a part is one table row per dimension, found by dictionary code, and added. Ties take the lower entry.
    """
    parts, entries, width = books.shape
    widest = int(max(abs(int(x)) for x in (vectors.min(initial=0), vectors.max(initial=0), books.min(), books.max())))
    if 4 * widest * widest * width * parts >= 1 << 63:
        raise ValueError("components are too large for squared distances of 64 bits")
    kind = np.int32 if 4 * widest * widest * width < 1 << 31 else np.int64
    codes, least = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
    for p, book in enumerate(books):
        tables, places = [], []
        for j in range(width):
            values, at = np.unique(vectors[:, p * width + j], return_inverse=True)
            tables.append(((values[:, None] - book[None, :, j]) ** 2).astype(kind))
            places.append(at)
        for at in range(0, len(vectors), STEP):
            rows = slice(at, at + STEP)
            total = tables[0][places[0][rows]]
            for table, place in zip(tables[1:], places[1:]):
                total += table[place[rows]]
            codes[rows, p] = best = total.argmin(1)
            least[rows, p] = total[np.arange(len(total)), best]
    return codes, least


def _sums(books: np.ndarray):
    """Per partition: how many parts each entry has, and the sum of their components."""
    parts, entries, width = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), np.int64)
            if len(vectors):
                codes, _ = nearest(vectors, books)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], vectors[:, p * width:(p + 1) * width])
        used = np.flatnonzero(count.ravel())
        if len(used):
            each = np.repeat(used, width)
            columns = [each, np.tile(np.arange(width), len(used)), total.reshape(-1, width)[used].ravel(), count.ravel()[each]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["entry", "place", "total", "n"])
    return run


def _coded(books: np.ndarray):
    def run(vectors: pa.Array) -> pa.Array:
        codes, least = nearest(matrix(vectors, np.int64), books) if len(vectors) else (np.empty((0, len(books)), np.int64), np.empty((0, 1), np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(books)), pa.array(codes.ravel().astype(np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(least.sum(1), pa.int64())], names=["code", "error"])
    return run


def compress(clips: DataFrame, clip_id: str = "clip_id", label: str = "label", features: str = "features", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Clips with `code` (one entry number per part), `error` (squared distance to the coded vector) and `label_error` (errors
    summed over clips of the label, NULL labels together), and the codebooks (parts, entries, width) of integers.

    Components become floor(scale * x); a vector is cut into `parts` equal parts. Codebooks start with the parts of the `entries`
    smallest clip ids (fewer, if there are fewer clips; NULL ids come last, ties go by vector) and move to the floored mean of their
    parts `rounds` times; an entry without parts stays. Clips with a NULL or empty vector or a component that is NULL, NaN or infinite are
    left out, and so are vectors of another length than that of the smallest id, or of one that `parts` does not divide.
    Repeated clips count each. No clips give no rows and books without entries. Components whose squared distances exceed 64 bits
    are an error. Other columns stay; columns named code, error or label_error are replaced.

    Only codebooks, entries x length numbers, reach the driver; every task sends its sums per entry.
    """
    v = fresh(clips, "v")
    rows = clips.drop("code", "error", "label_error").where(usable(features)).withColumn(v, floored(features, scale))
    start = rows.where(F.size(v) % parts == 0).orderBy(F.col(clip_id).asc_nulls_last(), v).select(v)
    first = start.first()
    width = len(first[0]) // parts if first else 0
    kept = written(rows.where(F.size(v) == width * parts), "vectors")
    chosen = kept.orderBy(F.col(clip_id).asc_nulls_last(), v).limit(entries).select(v).collect()
    books = np.array([r[0] for r in chosen], np.int64).reshape(len(chosen), parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds if chosen else 0):
        sums = kept.select(v).mapInArrow(_sums(books), "entry long, place long, total long, n long").groupBy("entry", "place").agg(F.sum("total"), F.sum("n"))
        flat = books.reshape(-1, width)
        for entry, place, total, n in sums.collect():
            flat[entry, place] = total // n
        books = flat.reshape(books.shape)
    if not chosen:
        empty = [F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error")]
        return kept.drop(v).select("*", *empty), books
    found = fresh(kept, "found")
    coded = written(kept.withColumn(found, F.arrow_udf(_coded(books), "struct<code:array<int>,error:bigint>")(v))
                    .select(*[c for c in kept.columns if c != v], f"{found}.code", f"{found}.error"), "codes")
    key = fresh(coded, "label")
    sums = coded.groupBy(F.col(label).alias(key)).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col(key))).drop(key), books
