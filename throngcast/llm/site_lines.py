"""Lines of incident texts that many maps (sites) repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import content, fresh, written

MIN_SITES = 10
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _line_key(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), line).alias("k2")]


def spread_lines(incidents: DataFrame, description: str = "description", map_id: str = "map_id", min_sites: int = MIN_SITES,
                 lg_k: int = 12, margin: float = 0.25) -> DataFrame:
    """Keys (k1, k2) of the lines that at least `min_sites` distinct maps use, exactly.

    Lines are the pieces between \\n with at least one visible character, whole. One aggregate drops lines of a single map and
    lines with fewer occurrences than min_sites. For the rest, HyperLogLog sketches of the maps merge by aggregation. An estimate
    further than `margin` (15 standard errors at lg_k 12) from the threshold decides; nearer lines get exact distinct counts.
    A NULL map is no site; NULL and empty texts have no lines; repeated rows change nothing.
    """
    lines = written(incidents.where(F.col(map_id).isNotNull())
                    .select(F.xxhash64(F.col(map_id).cast("string")).alias("site"), F.explode(F.split(content(description), "\n", -1)).alias("line"))
                    .where(F.col("line").rlike(_HAS_WORD)).select(*_line_key(F.col("line")), "site"), "lines")
    if min_sites <= 1:
        return lines.select("k1", "k2").distinct()
    shared = lines.groupBy("k1", "k2").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.count("*").alias("uses")) \
        .where((F.col("lo") != F.col("hi")) & (F.col("uses") >= min_sites)).select("k1", "k2")
    candidates = lines.join(written(shared, "shared"), ["k1", "k2"], "left_semi")
    sketched = written(candidates.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("about")), "sketches")
    sure = sketched.where(F.col("about") >= min_sites * (1 + margin)).select("k1", "k2")
    near = sketched.where((F.col("about") < min_sites * (1 + margin)) & (F.col("about") > min_sites * (1 - margin))).select("k1", "k2")
    exact = lines.join(near, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("k1", "k2")
    return sure.unionAll(exact)


def remove_spread_lines(incidents: DataFrame, description: str = "description", map_id: str = "map_id", min_sites: int = MIN_SITES) -> DataFrame:
    """Incidents whose descriptions lack the lines that `min_sites` or more maps share; adds n_lines and n_removed.

    Lines without a visible character stay. Every row and column stays; columns named n_lines or n_removed are replaced; a NULL text stays NULL with 0
    lines. What is removed depends on the text alone, so repeated rows and NULL ids need no rule.

    Texts with a shared line are found by joining line keys, and only line numbers travel. They come back to the rows by the
    text's hash; a text with many copies is a skewed key that adaptive execution splits (the other side has one row per text).
    """
    spread = written(spread_lines(incidents, description, map_id, min_sites), "spread")
    text = content(description)
    key = [F.xxhash64(text), F.xxhash64(F.lit("text"), text)]
    t1, t2, gone = (fresh(incidents, s) for s in ("t1", "t2", "gone"))
    lines = incidents.select(key[0].alias(t1), key[1].alias(t2), F.posexplode(F.split(text, "\n", -1)).alias("no", "line")) \
        .where(F.col("line").rlike(_HAS_WORD)).select(t1, t2, "no", *_line_key(F.col("line")))
    # copies of a text repeat its hits, hence the set
    hits = written(lines.join(spread, ["k1", "k2"], "left_semi").groupBy(t1, t2).agg(F.collect_set("no").alias(gone)), "hits")
    joined = incidents.withColumns({t1: key[0], t2: key[1]}).join(hits, [t1, t2], "left")
    parts = F.split(F.col(description), "\n", -1)
    # a map of the numbers keeps the test per line constant
    lost = F.map_from_arrays(F.col(gone), F.col(gone))
    left = F.array_join(F.filter(parts, lambda _, i: ~F.map_contains_key(lost, i)), "\n")
    return joined.withColumns({
        "n_lines": F.when(F.col(description).isNull(), 0).otherwise(F.size(parts)).cast("long"),
        "n_removed": F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long"),
        description: F.when(F.col(gone).isNull(), F.col(description)).otherwise(left)}).drop(t1, t2, gone)
