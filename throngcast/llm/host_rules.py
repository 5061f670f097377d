"""Quality rules of incident texts, and verdicts on the maps (sites, hosts) that report them."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import content, fresh, small_batches, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rules that judge maps alone: symbols per hundred words, repeated lines per hundred.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: A map is rejected when a rule's failure rate there is certainly above this and above what maps have on average;
#: certainly: by so many standard deviations of its posterior.
MAX_FAILURE_RATE, DEVIATIONS = 0.5, 2.0
_SPACE, _SYMBOL = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[#*$%&|<>]")


def text_stats(text: str) -> tuple[int, ...]:
    """STATS of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()                                  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            reach = 0                                    # first word position not counted yet
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 3 - max(reach, i)
                    reach = i + 3
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return n, len(text) - len(_SPACE.findall(raw)), len(_SYMBOL.findall(raw)), len(lines) - len(set(lines)), repeated, len(lines)


def _stats(texts: pa.Array) -> pa.Array:
    rows = [text_stats(t) for t in texts.to_pylist()]
    columns = list(zip(*rows)) if rows else [[] for _ in STATS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(STATS))


def base_failure() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_stats(incidents: DataFrame, description: str = "description") -> DataFrame:
    """Adds STATS and base_failed; NULL and empty texts have no words and fail. Columns of these names are replaced."""
    name = fresh(incidents, "stats")
    out = small_batches(incidents).withColumn(name, F.arrow_udf(_stats, "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">")(content(description)))
    return out.withColumns({s: F.col(name)[s] for s in STATS}).drop(name).withColumn("base_failed", base_failure())


def rules() -> dict[str, Column]:
    """Whether a text fails each rule; the first two are the base rules."""
    return {"few_words": F.col("n_words") < MIN_WORDS, "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
            "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"), "repeated_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")}


def rule_failures(marked: DataFrame, map_id: str = "map_id") -> DataFrame:
    """(map_id, rule, n, failed) from texts with STATS, one pre-aggregated count per map and rule; maps that are NULL are left out."""
    tests = rules()
    wide = marked.where(F.col(map_id).isNotNull()).groupBy(F.col(map_id).alias("map_id")).agg(F.count("*").alias("n"), *[F.count_if(t).alias(f"_{r}") for r, t in tests.items()])
    return wide.select("map_id", "n", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("failed")) for r in tests])))


def map_verdicts(failures: DataFrame, max_failure_rate: float = MAX_FAILURE_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """(map_id, rule, n, failed, rate, low, rejected) from counts per map and rule (map_id, rule, n, failed).

    The prior of a rule is a beta distribution fitted to the maps' own rates by moments; each rate is shrunk towards its mean. `low` lies
    `deviations` posterior standard deviations below the shrunken rate, and a map is rejected when that is above `max_failure_rate` and the
    prior's mean: few incidents, or what all maps do alike, are no reason. With equal rates, or with one map alone, the prior
    weighs as much as an average map. The fit is one row per rule; nothing is collected.
    """
    rates = failures.withColumn("p", F.col("failed") / F.col("n"))
    prior = rates.groupBy("rule").agg(F.avg("p").alias("m"), F.coalesce(F.var_pop("p"), F.lit(0.0)).alias("v"), F.avg("n").alias("size"))
    # variance of a beta: m (1 - m) / (strength + 1)
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(F.col("size"))
    prior = prior.select("rule", "m", strength.alias("s"))
    rate = (F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    both = failures.join(F.broadcast(prior), "rule").withColumn("rate", rate)          # a row per rule
    low = F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("s") + 1))
    return both.withColumn("low", low).select("map_id", "rule", "n", "failed", "rate", "low", (low > F.greatest(F.lit(max_failure_rate), F.col("m"))).alias("rejected"))


def judge(incidents: DataFrame, description: str = "description", map_id: str = "map_id", max_failure_rate: float = MAX_FAILURE_RATE,
          salts: int = 16) -> DataFrame:
    """Incidents with STATS, base_failed, map_rejected and kept (columns of these names are replaced); no row is dropped here.

    kept is false when the text fails the base rules or its map is rejected by any rule (rules, map_verdicts). Incidents without a map (NULL)
    belong to none and are judged by their own text. Every row counts, repeated ones too; an empty table gives an empty result.

    The failure counts are pre-aggregated per map. Rejected maps are joined back on (map, salt), with each map repeated for every salt,
    so that a map with a large share of all incidents does not meet in one task.
    """
    marked = with_stats(incidents, description)
    verdicts = map_verdicts(written(rule_failures(marked, map_id), "maps"), max_failure_rate)
    key, salt, hit = (fresh(marked, s) for s in ("map", "salt", "hit"))
    rejected = written(verdicts.where("rejected").select("map_id").distinct().select(F.col("map_id").alias(key), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt), F.lit(True).alias(hit)), "maps")
    own_salt = F.pmod(F.xxhash64(content(description)), F.lit(salts)).cast("int")
    joined = marked.withColumns({key: F.col(map_id), salt: own_salt}).join(rejected, [key, salt], "left")
    return joined.withColumn("map_rejected", F.coalesce(F.col(hit), F.lit(False))) \
        .withColumn("kept", ~F.col("base_failed") & ~F.col("map_rejected")).drop(key, salt, hit)
