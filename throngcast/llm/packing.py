"""Packs tokenized incident texts into sequences by length patterns fitted with non-negative least squares."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import content, small_batches, written

CAPACITY, END_ID = 1024, 2
#: The pre-tokenizer's pattern of the byte-level vocabulary and its one special token.
SPECIAL = {"<|endoftext|>": 50256}


def load_encoding(ranks_file: str, pattern: str):
    """A byte-level BPE encoding from a rank file (base64 token, rank); ids equal those of the vocabulary's other forms."""
    import tiktoken
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def vocabulary_ids(vocabulary_file: str):
    """Encodes by the vocabulary's other form, which is slower and takes texts of any shape."""
    from tokenizers import Tokenizer
    vocabulary = Tokenizer.from_file(vocabulary_file)
    return lambda text: vocabulary.encode(text, add_special_tokens=False).ids


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def tokenized_pieces(incidents: DataFrame, ranks_file: str, pattern: str, vocabulary_file: str, description: str = "description", incident_id: str = "incident_id",
                     capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """(incident_id, piece, start, length, ids_crc32[, ids]) of every incident; NULL texts are empty: the end id alone.

    Repeated rows and NULL ids give pieces of their own. ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    cache: dict = {}
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + keep_ids * [("ids", pa.list_(pa.int32()))]
    ddl = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<int>" * keep_ids

    @F.arrow_udf(f"array<struct<{ddl}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        if "encoding" not in cache:
            cache["encoding"] = load_encoding(ranks_file, pattern)
        encoding = cache["encoding"]
        columns, offsets = [[] for _ in fields], [0]
        for text in texts.to_pylist():
            try:
                ids = encoding.encode(text, allowed_special="all")
            except ValueError:                           # its pattern gives up on very long runs of white space
                if "vocabulary" not in cache:
                    cache["vocabulary"] = vocabulary_ids(vocabulary_file)
                ids = cache["vocabulary"](text)
            ids = np.array([*ids, END_ID], np.uint32)
            for i, (start, length) in enumerate(cut(len(ids), capacity)):
                part = ids[start:start + length]
                row = (i, start, length, zlib.crc32(part.astype("<u4").tobytes()), part.astype(np.int32))
                for column, value in zip(columns, row):
                    column.append(value)
            offsets.append(len(columns[0]))
        flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    rows = small_batches(incidents).select(F.col(incident_id).alias("incident_id"), F.explode(pieces(content(description))).alias("p"))
    return rows.select("incident_id", "p.*")


def fit_patterns(histogram: np.ndarray, capacity: int = CAPACITY, steps: int = 300) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how often to use each, from counts by length (index 0 to capacity).

    Enumerates full patterns of one to three pieces of lengths that occur: all pairs, and the triples that repeat a length or
    whose shortest lengths lie on a grid (all triples would spread the counts so thin that rounding leaves nothing). Repeat counts minimise the squared distance
    to the histogram under non-negativity, by accelerated projected gradient, and are rounded down; what remains is packed best fit, longest
    first, many equal sequences at a time. The work depends on `capacity` alone, never on the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    have = np.flatnonzero(left)
    plan: Counter = Counter()
    if left[capacity]:
        plan[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    a, b = np.meshgrid(have, have, indexing="ij")
    c = capacity - a - b
    grid = capacity // 32
    shape = (a == b) | (b == c) | ((a % grid == 0) & (b % grid == 0))
    ok = (a <= b) & ((c == 0) | ((c >= b) & shape & (left[np.clip(c, 0, capacity)] > 0)))
    patterns = np.stack([a[ok], b[ok], np.maximum(c[ok], 0)], 1)          # a missing third piece has length 0
    if len(patterns):
        target = left.astype(float)
        scale = target.max()
        target /= scale
        use = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), capacity + 1) * (np.arange(capacity + 1) > 0)
        # the step: one over a bound of the largest eigenvalue (rows times columns of the pattern matrix)
        rate = 1.0 / max(1.0, 3.0 * use(np.ones(len(patterns))).max())
        x = np.zeros(len(patterns))
        y, momentum = x, 1.0
        for _ in range(steps):
            residual = use(y) - target
            residual[0] = 0
            new = np.maximum(0.0, y - rate * residual[patterns].sum(1))
            faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            y, x, momentum = new + (momentum - 1) / faster * (new - x), new, faster
        x *= scale
        for i in np.argsort(-x, kind="stable"):
            need = Counter(int(v) for v in patterns[i] if v)
            times = min(int(x[i]), *(int(left[v]) // n for v, n in need.items()))
            if times > 0:
                plan[tuple(sorted(need.elements(), reverse=True))] += times
                for v, n in need.items():
                    left[v] -= times * n
    return [*plan.items(), *_best_fit(left, capacity)]


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences of equal content are one entry (room -> {content: how many})."""
    rooms: dict[int, Counter] = {}
    for length in range(capacity, 0, -1):
        todo = int(counts[length])
        while todo:
            room = next((r for r in range(length, capacity) if rooms.get(r)), None)
            if room is None:
                each = capacity // length
                full, rest = divmod(todo, each)
                for n, times in ((each, full), (rest, 1)):
                    if n and times:
                        rooms.setdefault(capacity - n * length, Counter())[(length,) * n] += times
                break
            content_, times = next(iter(rooms[room].items()))
            each = room // length                         # a sequence with room for several takes them at once
            taken = min(times, todo // each) if todo >= each else 0
            n = each if taken else todo
            taken = taken or 1
            rooms[room][content_] -= taken
            if not rooms[room][content_]:
                del rooms[room][content_]
            rooms.setdefault(room - n * length, Counter())[content_ + (length,) * n] += taken
            todo -= n * taken
    return [(c, n) for sets in rooms.values() for c, n in sets.items()]


def places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of the first rank, offset): where the pieces of a length go, in order of their rank.

    Ranks from one row's first to the next one's go to consecutive sequences at one offset. Sorted by length and rank.
    """
    rows, used, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds part (of the running stage) and rank, a piece's number among those of its length in its part."""
    from pyspark import TaskContext

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            order = np.argsort(lengths, kind="stable")
            sorted_ = lengths[order]
            first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            sizes = np.diff(np.append(first, len(sorted_)))
            seen = np.concatenate((seen, np.zeros(max(0, int(sorted_[-1]) + 1 - len(seen)), np.int64)))
            rank = np.empty(len(lengths), np.int64)
            rank[order] = np.arange(len(sorted_)) - np.repeat(first, sizes) + seen[sorted_]
            seen[sorted_[first]] += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), part), pa.int64()), pa.array(rank)],
                                             names=[*batch.schema.names, "part", "rank"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(number, f"{kept}, part bigint, rank bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset: few sequences of at most `capacity` tokens, each filled without gaps from 0.

    Takes rows with a `length` from 1 to capacity; columns named part, rank, sequence_id or offset are replaced. Only the histogram of
    lengths (capacity counts) reaches the driver, which plans patterns, not pieces. A piece's rank among those of its length is
    its rank in its own part plus the counts of earlier parts, so a length that most pieces have is numbered by all tasks.
    Ranks are written with the pieces, once, so that a lost executor cannot change them. An empty table gives an empty result;
    equal and repeated pieces are interchangeable.
    """
    pieces = written(_numbered(pieces.drop("part", "rank", "sequence_id", "offset")), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():       # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    table = places(fit_patterns(histogram, capacity))                               # bounded by capacity, not by the pieces
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        rows, lengths, ranks = shared.value, lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        wide = max(int(rows[:, 1].max(initial=0)), int(ranks.max(initial=0))) + 1
        at = np.searchsorted(rows[:, 0] * wide + rows[:, 1], lengths * wide + ranks, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(rows[at, 2] + ranks - rows[at, 1]), pa.array(rows[at, 3])], names=["sequence_id", "offset"])

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")   # one row per part and length
    known = pieces.join(counts.select("part", "length", earlier.alias("earlier")), ["part", "length"])
    placed = known.withColumn("at", place(F.col("length"), F.col("rank") + F.col("earlier")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "rank")], "at.sequence_id", "at.offset")
