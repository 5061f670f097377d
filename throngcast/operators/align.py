"""Bringing sources of different rates together: as-of and interval joins on hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .ordered import ROWS_PER_CHUNK, with_last_known


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, name: str, within: int | None = None,
          rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``name``: the latest ``on`` of ``right`` per key that is not after the row's own, NULL when there is none or it is over
    ``within`` older. Rows of ``right`` are then an equi join away.

    Both sides are ordered together and the last stamp is carried forward, chunk by chunk, so a key may hold any share of the rows.
    """
    row = F.struct(*[F.col(c) for c in left.columns])
    stamps = right.select(*keys, on).where(F.col(on).isNotNull()).distinct()
    both = left.select(*keys, on, F.lit(1).alias("_side"), row.alias("_row")) \
        .unionByName(stamps.withColumn("_side", F.lit(0)).withColumn("_row", F.lit(None).cast(left.select(row).schema[0].dataType)))
    both = both.withColumn("_stamp", F.when(F.col("_side") == 0, F.col(on)))
    known = with_last_known(both, keys, [on, "_side"], "_stamp", "_latest", rows_per_chunk=rows_per_chunk).where("_side = 1")
    stamp = F.col("_latest")
    if within is not None:
        stamp = F.when(F.col(on) - stamp <= within, stamp)
    return known.select("_row.*", stamp.alias(name))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the intervals [start, end) of their key that hold them; both keep their columns (keys once).

    Intervals are entered into every bin of ``width`` they touch and points into the one they lie in, so the pairing is an equi join on
    (keys, bin). Choose ``width`` near the length of the intervals: then each is entered about twice and a bin holds few of them.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    entered = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    on = reduce(lambda a, b: a & b, [placed[k] == entered[k] for k in [*keys, "_bin"]])
    held = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return placed.join(entered, on & held).select(*[placed[c] for c in points.columns], *[entered[c] for c in intervals.columns if c not in keys])
