"""Ordered work per key that stays parallel when one key holds much of the data.

A window over ``partitionBy(key)`` puts a whole key into one task. Here the rows of a key with
more than ``rows_per_chunk`` rows are cut into consecutive ranges of the ordering column
(approximate quantiles of that key). Windows and folds then run per (key, chunk), and what one
chunk must know of the earlier ones (last row, count, sum, state) travels in a carry table with
one row per chunk of a large key. Since the chunk size grows with the table, that table never
holds more than a few thousand rows, which is why it may be broadcast or held by the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage

ROWS_PER_CHUNK = 4_000_000
MAX_CHUNKS = 2048       # over all keys, before rounding up per key
CUTS_PER_KEY = 1024
_BLOCK = 32             # cuts are searched in two steps: block, then inside the block


@dataclass
class Chunked:
    """Rows with a ``_chunk`` number; ``split`` tells whether any key was cut."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool
    hot: DataFrame | None = None   # the keys that were cut

    def window(self) -> Window:
        return Window.partitionBy(*self._group()).orderBy(*self.order)

    def _group(self) -> list[Column]:
        # without keys and chunks the table is known to be at most one chunk long
        return [F.col(k) for k in self.keys] + ([F.col("_chunk")] if self.split else []) or [F.lit(0)]

    def carry(self, summary: dict[str, Column], over_chunks: dict[str, callable]) -> DataFrame | None:
        """Per chunk of a cut key: summaries of the chunk, then window expressions over the chunks before it."""
        if not self.split:
            return None
        rows = self.df.filter("_hot").groupBy(*self.keys, "_chunk").agg(*[c.alias(n) for n, c in summary.items()])
        w = Window.partitionBy(*[F.col(k) for k in self.keys] or [F.lit(0)]).orderBy("_chunk")
        return rows.select(*self.keys, "_chunk", *[make(w).alias(n) for n, make in over_chunks.items()])

    def with_carry(self, carry: DataFrame, names: list[str]) -> DataFrame:
        return join_keys(self.df, F.broadcast(carry), self.keys + ["_chunk"], "left", names)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str, keep: list[str] = ()) -> DataFrame:
    """Join on keys where NULL matches NULL; ``keep`` are the columns taken from the right."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *keep)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def chunked(df: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> Chunked:
    """Number the chunks of every key by ranges of ``order[0]`` (numeric, not NULL)."""
    one = F.count(F.lit(1)).alias("_n")
    counts = df.groupBy(*keys).agg(one) if keys else df.agg(one)
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(rows_per_chunk, -(-(total or 0) // MAX_CHUNKS))
    if (largest or 0) <= limit:
        return Chunked(df, keys, order, False)

    hot = counts.filter(F.col("_n") > limit)                 # at most total / limit keys
    grid = int(min(CUTS_PER_KEY, -(-largest // limit)))
    ranks = [i / grid for i in range(1, grid)]
    rows = join_keys(df, F.broadcast(hot), keys, "inner", ["_n"]) if keys else df.withColumn("_n", F.lit(largest))
    found = rows.groupBy(*keys).agg(
        F.percentile_approx(F.col(order[0]).cast("double"), ranks, 20 * grid).alias("cuts"), F.max("_n").alias("_n"))
    # a key just above the limit needs fewer cuts than the largest one
    step = F.greatest(F.lit(1), F.floor(F.lit(grid) * F.lit(limit) / F.col("_n")).cast("int"))
    cuts = found.select(*keys, F.filter("cuts", lambda c, i: (i % step) == 0).alias("cuts"))
    fixed = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)     # bounded by MAX_CHUNKS
    fixed = fixed.withColumn("blocks", F.filter("cuts", lambda c, i: (i + 1) % _BLOCK == 0))

    if keys:
        placed = join_keys(df, F.broadcast(fixed), keys, "left", ["cuts", "blocks"])
    else:
        only = fixed.first()
        placed = df.withColumn("cuts", F.array(*map(F.lit, only.cuts))) \
            .withColumn("blocks", F.array(*map(F.lit, only.blocks)).cast("array<double>"))
    at = F.col(order[0]).cast("double")
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= at))
    start = below(F.col("blocks")) * _BLOCK
    chunk = start + below(F.slice("cuts", start + 1, _BLOCK))
    placed = placed.withColumn("_chunk", F.when(F.col("cuts").isNotNull(), chunk).otherwise(0)) \
        .withColumn("_hot", F.col("cuts").isNotNull()).drop("cuts", "blocks")
    return Chunked(placed, keys, order, True, fixed.select(*keys) if keys else None)


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("_chunk", "_hot", "_carry", "_first", "_here")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add columns holding the value of the row before within the key (NULL on the first row)."""
    c = chunked(df, keys, order, rows_per_chunk)
    if not c.split:
        return df.withColumns({new: F.lag(old).over(c.window()) for new, old in columns.items()})
    packed = F.struct(*columns.values())
    carry = c.carry({"_last": F.max_by(packed, F.struct(*order))}, {"_carry": lambda w: F.lag("_last").over(w)})
    out = c.with_carry(carry, ["_carry"]).withColumn("_here", F.lag(packed).over(c.window()))
    known = F.coalesce("_here", "_carry")
    return _clean(out.withColumns({new: known[old] for new, old in columns.items()}))


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add the sum of ``value`` from the first row of the key up to this row."""
    c = chunked(df, keys, order, rows_per_chunk)
    local = F.sum(value).over(c.window().rowsBetween(Window.unboundedPreceding, 0))
    if not c.split:
        return df.withColumn(name, local)
    before = lambda w: F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))
    carry = c.carry({"_sum": F.sum(value)}, {"_carry": before})
    return _clean(c.with_carry(carry, ["_carry"]).withColumn(name, local + F.coalesce("_carry", F.lit(0))))


def with_row_index(df: DataFrame, keys: list[str], order: list[str], name: str = "row_index",
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add the zero-based position of the row within its key."""
    c = chunked(df, keys, order, rows_per_chunk)
    local = F.row_number().over(c.window()) - 1
    if not c.split:
        return df.withColumn(name, local.cast("bigint"))
    before = lambda w: F.sum("_count").over(w.rowsBetween(Window.unboundedPreceding, -1))
    carry = c.carry({"_count": F.count(F.lit(1))}, {"_carry": before})
    out = c.with_carry(carry, ["_carry"])
    return _clean(out.withColumn(name, (local + F.coalesce("_carry", F.lit(0))).cast("bigint")))


def with_last_known(df: DataFrame, keys: list[str], order: list[str], column: str, name: str,
                    include_current: bool = True, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add the latest non-NULL value of ``column`` up to this row (or up to the row before)."""
    c = chunked(df, keys, order, rows_per_chunk)
    end = 0 if include_current else -1
    local = F.last(column, ignorenulls=True).over(c.window().rowsBetween(Window.unboundedPreceding, end))
    if not c.split:
        return df.withColumn(name, local)
    latest = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order)))
    before = lambda w: F.last("_latest", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carry = c.carry({"_latest": latest}, {"_carry": before})
    return _clean(c.with_carry(carry, ["_carry"]).withColumn(name, F.coalesce(local, "_carry")))


def _decayed(df: DataFrame, part: list[Column], order: list[str], value: str, decay: float, name: str) -> DataFrame:
    """Add ``name``: the sum of the non-NULL values so far, each times ``decay`` to the number of later ones.

    The recurrence y = decay * y + value is affine, so runs of values compose. Inside a block of values the weights are powers of decay, which a
    running sum takes; blocks are short enough for these powers to stay in range. What the blocks before contribute is the same recurrence over
    their ends with decay to the block's length; once that is below rounding, two ends are all that counts.
    """
    size = max(1, min(512, int(250 / -math.log10(decay))))
    n, block, at, local, end = (f"{name}_{c}" for c in ("n", "b", "at", "l", "e"))
    past = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda e: F.pow(F.lit(decay), e)
    out = df.withColumn(n, F.count(value).over(past)).withColumn(block, F.floor((F.col(n) - 1) / size)).withColumn(at, F.col(n) - 1 - F.col(block) * size)
    out = out.withColumn(local, power(F.col(at)) * F.coalesce(F.sum(F.col(value) * power(-F.col(at))).over(inside), F.lit(0.0)))
    out = out.withColumn(end, F.when(F.col(value).isNotNull() & (F.col(at) == size - 1), F.col(local)))
    if decay ** size < 1e-25:
        earlier = F.coalesce(F.last(end, ignorenulls=True).over(before), F.lit(0.0))
        out = out.withColumn(end, F.col(end) + decay ** size * earlier)
        start = F.last(end, ignorenulls=True).over(before)
    else:
        out = _decayed(out, part, order, end, decay ** size, f"{name}_s")
        start = F.lag(f"{name}_s").over(Window.partitionBy(*part).orderBy(*order))
    # a block's start is read at its first value; NULLs after its last one belong to it as well
    out = out.withColumn(end, F.when(F.col(value).isNotNull() & (F.col(at) == 0), F.coalesce(start, F.lit(0.0)))).withColumn(end, F.last(end, ignorenulls=True).over(past))
    return out.withColumn(name, F.col(local) + power(F.col(at) + 1) * F.coalesce(end, F.lit(0.0))).drop(n, block, at, local, end, f"{name}_s")


def with_average(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, keep: float, start="first",
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``keep * previous + (1 - keep) * value`` along each key; a NULL value carries the average on.

    ``start``: 'first' passes the first value through (NULL before it), 'zero' blends it with 0, a number is the start value. No row
    waits for the one before: chunks, and blocks inside them, are scanned at once and composed afterwards. The result agrees with
    the row-by-row recurrence up to rounding.
    """
    c = chunked(df, keys, order, rows_per_chunk)
    part, sum_, place = c._group(), "_decayed", ["_seen", "_null"]
    rows = c.df.withColumn("_v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))).withColumn("_null", F.col("_v").isNull())
    # values are numbered once, and later windows go by the numbers, so rows of equal order keep one place
    rows = rows.withColumn("_seen", F.count("_v").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    past = Window.partitionBy(*part).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    if 0 < keep < 1:
        rows = _decayed(rows, part, place, "_v", keep, sum_)
    else:
        rows = rows.withColumn(sum_, F.coalesce(F.last("_v", ignorenulls=True).over(past), F.lit(0.0)) if keep <= 0 else F.lit(0.0))
    rows = rows.withColumn("_first", F.first("_v", ignorenulls=True).over(past))
    keep_ = min(1.0, max(0.0, keep))
    given = None if start == "first" else 0.0 if start == "zero" else float(start)
    begin, earlier = F.lit(given), F.lit(0)
    if c.split:
        steps = F.struct(F.pow(F.lit(keep_), F.col("_count")).alias("a"), ((1 - keep_) * F.col("_sum")).alias("b"))
        held = lambda w: F.collect_list(steps).over(w.rowsBetween(Window.unboundedPreceding, -1))        # one entry per chunk, at most MAX_CHUNKS
        summary = Chunked(rows, c.keys, c.order, True).carry(
            {"_count": F.count("_v"), "_sum": F.max_by(sum_, "_seen"), "_one": F.min_by("_v", F.when(~F.col("_null"), F.col("_seen")))},
            {"_steps": held, "_lead": lambda w: F.first("_one", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
             "_count_before": lambda w: F.coalesce(F.sum("_count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        origin = F.coalesce("_lead", F.lit(0.0)) if given is None else F.lit(given)
        carry = summary.select(*keys, "_chunk", F.aggregate("_steps", origin, lambda y, x: x.a * y + x.b).alias("_carry"), "_lead", "_count_before")
        rows = Chunked(rows, c.keys, c.order, True).with_carry(carry, ["_carry", "_lead", "_count_before"])
        earlier = F.coalesce("_count_before", F.lit(0))
        first = F.when(earlier > 0, F.col("_lead")).otherwise(F.col("_first"))
        begin = F.when(earlier > 0, F.col("_carry")).otherwise(first if given is None else F.lit(given))
        begin = F.when(F.col("_hot"), begin).otherwise(F.col("_first") if given is None else F.lit(given))
    elif given is None:
        begin = F.col("_first")
    average = (1 - keep_) * F.col(sum_) + F.pow(F.lit(keep_), F.col("_seen")) * begin
    if given is None:                                    # the first value itself, to its last digit
        average = F.when(earlier + F.col("_seen") == 1, F.coalesce("_first", "_lead") if c.split else F.col("_first")).otherwise(average)
    return _clean(rows.withColumn(name, average).drop("_v", sum_, "_seen", "_null", "_lead", "_count_before"))


def single_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row tables side by side, without a join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for f in frames for c in f.columns])


def fits(df: DataFrame, keys: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> bool:
    """Whether no key holds more rows than a chunk: one pre-aggregated count over the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > rows_per_chunk).isEmpty()


def exact_percentiles(df: DataFrame, keys: list[str], ranks: dict[str, tuple[str, float]],
                      rows_per_chunk: int | None = ROWS_PER_CHUNK, also: list[Column] = ()) -> DataFrame:
    """Linear-interpolation percentiles per key: one column per entry of ``ranks``, name -> (column, rank).

    ``also``: further aggregates wanted of the same groups.

    Small keys use the built-in aggregate, in one pass. The values of a key with more rows than a chunk are
    ranked by running sums over their counts, so no task ever holds all of them. Pass None for
    ``rows_per_chunk`` when groups are bounded by nature (say, one row per zone): that saves the count.
    """
    direct = [F.percentile(value, F.lit(q)).alias(n) for n, (value, q) in ranks.items()]
    light = lambda rows: rows.groupBy(*keys).agg(*direct, *also) if keys else rows.agg(*direct, *also)
    if rows_per_chunk is None:
        return light(df)
    one = F.count(F.lit(1)).alias("_rows")
    counts = df.groupBy(*keys).agg(one) if keys else df.agg(one)
    total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    limit = max(rows_per_chunk, -(-(total or 0) // MAX_CHUNKS))
    if (largest or 0) <= limit:
        return light(df)

    hot = counts.filter(F.col("_rows") > limit).select(*keys)
    large = join_keys(df, F.broadcast(hot), keys, "left_semi") if keys else df
    parts = [_ranked_percentiles(large, keys, value, {n: q for n, (v, q) in ranks.items() if v == value}, rows_per_chunk)
             for value in dict.fromkeys(v for v, _ in ranks.values())]
    if also:
        parts.append(large.groupBy(*keys).agg(*also) if keys else large.agg(*also))
    if not keys:
        return single_row(*parts)
    result = reduce(lambda a, b: join_keys(a, b, keys, "left", b.columns[len(keys):]),
                    parts, hot)
    small = light(join_keys(df, F.broadcast(hot), keys, "left_anti"))
    return small.unionByName(result)


def _ranked_percentiles(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, float], rows_per_chunk: int) -> DataFrame:
    weights = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    if keys:        # one row per large key
        total = weights.groupBy(*keys).agg(F.sum("_w").alias("_rows"))
        weights = join_keys(weights, F.broadcast(total), keys, "inner", ["_rows"])
    else:
        weights = weights.withColumn("_rows", F.lit(weights.agg(F.sum("_w")).first()[0]))
    ranked = with_running_sum(weights, keys, [value], F.col("_w"), "_upto", rows_per_chunk)
    picks = []
    for name, q in ranks.items():
        at = F.lit(q) * (F.col("_rows") - 1)
        covers = lambda pos: (F.col("_upto") - F.col("_w") <= pos) & (pos < F.col("_upto"))
        low = F.max(F.when(covers(F.floor(at)), F.col(value)))
        high = F.max(F.when(covers(F.ceil(at)), F.col(value)))
        picks.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return ranked.groupBy(*keys).agg(*picks) if keys else ranked.agg(*picks)


class Fold:
    """A state machine run over the ordered rows of one key.

    ``run(state, columns)`` gets numpy arrays of consecutive rows and returns the next state (a tuple of
    plain numbers and text, or None before the first row) and the output arrays.
    """

    inputs: list[str] = []
    output: dict[str, str] = {}      # name -> double, bigint, string or boolean

    def run(self, state, columns):
        raise NotImplementedError

    def variants(self, state: tuple, settled: tuple) -> list[tuple]:
        """States a chunk may start from, given a guess and the last state of the key that is certain.

        Rows may leave a level as it is, and an average that starts elsewhere may come to rest one last digit apart.
        """
        return [settled]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Fold,
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Run ``fold`` per key in order, keeping all columns and adding the fold's output columns.

    Chunks of a large key run at once. Each starts from an assumed state; chunks whose assumed state
    differs from what the chunk before ended with run again until all agree, so the result is that of
    one sequential pass. State machines with resets, decaying averages, and timers cut at their hold times agree after two or
    three rounds, quiet keys included; a throttle whose grants follow one another without a pause may take more.
    """
    c = chunked(df, keys, order, rows_per_chunk)
    chunk = ["_chunk"] if c.split else []
    groups = [*keys, *chunk]
    # without keys and cuts the whole (small) table is one sequence
    placed = (c.df.repartition(*groups) if groups else c.df.coalesce(1)).sortWithinPartitions(*groups, *order)
    entry: dict = {}
    if c.split:
        needed = list(dict.fromkeys([*keys, "_chunk", *order, *fold.inputs]))
        hot = cut_lineage(c.df.filter("_hot").select(*needed).repartition(*keys, "_chunk")
                          .sortWithinPartitions(*keys, "_chunk", *order))
        entry = _agree_on_states(hot, keys, fold)
    kept = [f for f in placed.schema.fields if f.name not in ("_chunk", "_hot")]
    schema = T.StructType(kept + [T.StructField(n, _SPARK[t]) for n, t in fold.output.items()])
    return placed.mapInArrow(_emit(fold, keys, chunk, [f.name for f in kept], entry), schema)


def _agree_on_states(hot: DataFrame, keys: list[str], fold: Fold) -> dict:
    """Entry state of every chunk of the cut keys.

    Each round runs only chunks that still lack the exit for their entry state; Spark filters the others out. The driver
    holds one small row per chunk and tried state. From the third round on a chunk is tried with all the
    fold's variants of the state, so that a level which nothing resets does not cost a round per chunk.
    """
    schema = "id string, at bigint, entry string, state string"
    marked = hot.withColumn("_at", F.xxhash64(*keys, "_chunk"))
    tried: dict[str, dict] = {}
    place: dict[str, int] = {}
    wanted: dict[str, list] | None = None
    rounds = 0
    while wanted is None or wanted:
        rows = marked if wanted is None else marked.filter(F.col("_at").isin([place[name] for name in wanted]))
        for row in rows.mapInArrow(_exits(fold, keys, wanted), schema).collect():
            tried.setdefault(row.id, {})[row.entry] = row.state
            place[row.id] = row.at
        rounds += 1
        entry, wanted = {}, {}
        chunks: dict = {}
        for name in tried:
            *key, number = json.loads(name)
            chunks.setdefault(json.dumps(key), []).append((number, name))
        for numbered in chunks.values():
            state, *_ = tried[min(numbered)[1]].values()
            settled = None
            for _, name in sorted(numbered)[1:]:
                entry[name], known = state, tried[name]
                if state not in known:
                    settled = settled or state
                if settled:                              # this chunk or one before lacks its exit
                    likely = [json.dumps(v) for v in fold.variants(_load(state), _load(settled))] if rounds > 1 else []
                    new = [v for v in dict.fromkeys([state, *likely]) if v not in known]
                    if new:
                        wanted[name] = new
                state = known.get(state, [*known.values()][-1])      # an exit, or a guess for the chunks that follow
    return entry


def _segments(batch: pa.RecordBatch, names: list[str]):
    """(id, first row, end row) of the runs of equal key in sorted rows; NULL equals NULL."""
    if not batch.num_rows:
        return
    if not names:
        yield "[]", 0, batch.num_rows
        return
    columns = [batch.column(n) for n in names]
    new = np.zeros(batch.num_rows, dtype=bool)
    for column in columns:
        codes = pd.factorize(column.to_pandas())[0]
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
    for first, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield json.dumps([c[first].as_py() for c in columns], default=str), first, end


def _inputs(batch: pa.RecordBatch, fold: Fold) -> dict:
    return {n: batch.column(n).to_pandas().to_numpy() for n in fold.inputs}


_SPARK = {"double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
          "bigint": T.LongType()}
_ARROW = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}


def _emit(fold: Fold, keys: list[str], chunk: list[str], kept: list[str], entry: dict):
    def run(batches):
        current, state = None, None
        for batch in batches:
            values, pieces = _inputs(batch, fold), []
            for name, first, end in _segments(batch, keys + chunk):
                if name != current:
                    current, state = name, _load(entry.get(name))
                state, out = fold.run(state, {n: v[first:end] for n, v in values.items()})
                pieces.append(out)
            if pieces:
                added = [pa.array(np.concatenate([np.asarray(p[n]) for p in pieces]), _ARROW[t], from_pandas=True)
                         for n, t in fold.output.items()]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + added, kept + list(fold.output))
    return run


def _exits(fold: Fold, keys: list[str], wanted: dict[str, list] | None):
    """(id, _at, entry, exit) of every chunk for each state it is tried with; the first round knows none."""
    def run(batches):
        current, states, ends = None, {}, []

        def close():
            ends.extend((current, at, entry, json.dumps(state)) for entry, state in states.items())

        for batch in batches:
            values, ats = _inputs(batch, fold), batch.column("_at")
            for name, first, end in _segments(batch, keys + ["_chunk"]):
                if wanted is not None and name not in wanted:
                    continue
                if name != current:
                    close()
                    current, at = name, ats[first].as_py()
                    states = {e: _load(e) for e in ([None] if wanted is None else wanted[name])}
                rows = {n: v[first:end] for n, v in values.items()}
                states = {e: fold.run(s, rows)[0] for e, s in states.items()}
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[i] for e in ends], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))],
            ["id", "at", "entry", "state"])
    return run


def _load(state: str | None):
    return None if state is None else tuple(json.loads(state))
