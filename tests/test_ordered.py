"""Chunked windows and folds give what one ordered pass per key gives, also on a hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from throngcast import constants as K
from throngcast.config import RiskStateConfig
from throngcast.operators import folds, ordered as O

SMALL = 40


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        if rng.random() < 0.02:
            key = None
        level = [0.15, 0.5, 0.95, 0.5][(i // 90) % 4]
        rows.append((key, i * 150, i, level + rng.uniform(-0.1, 0.1), rng.choice([None, float(rng.randrange(9))])))
    return spark.createDataFrame(rows, "zone string, ts bigint, id bigint, risk_raw double, maybe double").cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_hot_key_is_cut(series):
    c = O.chunked(series, ["zone"], ["ts", "id"], SMALL)
    sizes = c.df.filter("zone = 'hot'").groupBy("_chunk").count().collect()
    assert c.split and len(sizes) > 10 and max(r["count"] for r in sizes) < 3 * SMALL
    assert not O.chunked(series, ["zone"], ["ts", "id"]).split


@pytest.mark.parametrize("keys", [["zone"], []])
def test_chunked_windows(series, keys):
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy("ts", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = series.select("id", F.lag("maybe").over(w).alias("p"), (F.row_number().over(w) - 1).alias("i"),
                         F.sum("id").over(up).alias("s"), F.last("maybe", True).over(up).alias("l"))
    got = O.with_previous(series, keys, ["ts", "id"], {"p": "maybe"}, SMALL)
    got = O.with_row_index(got, keys, ["ts", "id"], "i", SMALL)
    got = O.with_running_sum(got, keys, ["ts", "id"], F.col("id"), "s", SMALL)
    got = O.with_last_known(got, keys, ["ts", "id"], "maybe", "l", rows_per_chunk=SMALL)
    cols = ["id", "p", "i", "s", "l"]
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("keys", [["zone"], []])
@pytest.mark.parametrize("value", ["risk_raw", "maybe"])
def test_exact_percentiles(series, keys, value):
    ranks = {"a": (value, 0.01), "b": (value, 0.5), "c": (value, 0.95), "d": ("id", 1.0)}
    small = O.exact_percentiles(series, keys, ranks)
    cut = O.exact_percentiles(series, keys, ranks, SMALL)
    plain = {tuple(r[k] for k in keys): r for r in small.collect()}
    for r in cut.collect():
        for name in ranks:
            assert r[name] == pytest.approx(plain[tuple(r[k] for k in keys)][name], abs=1e-12)


def oracle_risk(values, cfg=RiskStateConfig()):
    """Direct restatement of the state machine for one key."""
    out, s = [], None
    for ts, x in values:
        x = min(1, max(0, x))
        if s is None:
            s = dict(e=x, sl=0.0, sev="critical" if x >= .8 else "warn" if x >= .55 else "info", t0=ts, t=ts,
                     aw=0, ac=0, bw=0, bc=0)
            out.append((x, "flat", s["sev"], False))
            continue
        dt = max(0, ts - s["t"])
        e = .35 * x + (1 - .35) * s["e"]
        sl = (e - s["e"]) / (dt / 1000) if dt else s["sl"]
        for k, on in (("aw", e >= .55), ("ac", e >= .8), ("bw", e <= .45), ("bc", e <= .65)):
            s[k] = s[k] + dt if on else 0
        sev = s["sev"]
        if ts - s["t0"] >= 1200:
            if sev == "info":
                sev = "warn" if s["aw"] >= 1200 else sev
            elif sev == "warn":
                sev = "critical" if s["ac"] >= 900 else "info" if s["bw"] >= 2000 else sev
            else:
                sev = "warn" if s["bc"] >= 1500 else sev
        changed = sev != s["sev"]
        s.update(e=e, sl=sl, sev=sev, t=ts, t0=ts if changed else s["t0"])
        out.append((e, "rising" if sl > .05 else "falling" if sl < -.05 else "flat", sev, changed))
    return out


@pytest.mark.parametrize("limit", [SMALL, O.ROWS_PER_CHUNK])
def test_risk_state_fold(series, limit):
    got = O.ordered_fold(series, ["zone"], ["ts", "id"], folds.RiskState(), limit).collect()
    by_key = {}
    for r in sorted(got, key=lambda r: (r.ts, r.id)):
        by_key.setdefault(r.zone, []).append(r)
    assert len(got) == 1500
    changes = 0
    for part in by_key.values():
        want = oracle_risk([(r.ts, r.risk_raw) for r in part])
        assert [(r.risk_ema, r.trend, r.severity, r.changed) for r in part] == want
        changes += sum(r.changed for r in part)
    assert changes > 10


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_other_folds_do_not_depend_on_chunks_or_batches(spark, series, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        machines = [folds.Ewma("maybe", "ewma"), folds.Cooldown("ts", None, 9500),
                    folds.AltRisk("risk_raw", "risk_raw", "maybe")]
        data = series.withColumn("magnitude", F.when(F.col("id") % 50 < 2, .1).when(F.col("id") % 50 < 6, 3.)
                                 .otherwise(1.0))
        machines.append(folds.FallDetector())
        for fold in machines:
            names = ["id", *fold.output]
            assert rows(O.ordered_fold(data, ["zone"], ["ts", "id"], fold, SMALL), *names) == \
                rows(O.ordered_fold(data, ["zone"], ["ts", "id"], fold), *names)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("keep, start", [(0.0, "first"), (1e-3, 2.0), (0.7, "first"), (0.7, "zero"), (0.99, "first"), (0.99999, 2.0), (1.0, "first")])
def test_average_equals_the_recurrence(spark, keep, start):
    """Blocks, blocks of blocks, chunks, NULLs at the beginning and between, equal times, and no Python in the plan."""
    data = spark.range(3000).select("id", F.floor(F.col("id") / 3).alias("ts"), F.when(F.col("id") % 7 == 0, "B").otherwise("A").alias("zone"),
                                    F.when((F.col("id") > 40) & (F.col("id") % 5 > 0), F.sin(F.col("id") * 1.7) + 2).alias("v"))
    whole = O.with_average(data, ["zone"], ["ts", "id"], "v", "y", keep, start)
    cut = O.with_average(data, ["zone"], ["ts", "id"], "v", "y", keep, start, rows_per_chunk=300)
    fold = {r.id: r.y for r in O.ordered_fold(data, ["zone"], ["ts", "id"], folds.Ewma("v", "y", keep, start)).collect()}
    assert whole.columns == [*data.columns, "y"] == cut.columns
    for got in (whole, cut):
        found = {r.id: r.y for r in got.collect()}
        assert len(found) == 3000 and all((found[i] is None) == (y is None or y != y) for i, y in fold.items())
        assert all(found[i] == pytest.approx(y, rel=1e-11) for i, y in fold.items() if found[i] is not None)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def run(fold, **columns):
    return fold.run(None, {k: np.array(v, dtype=object if any(x is None for x in v) else None)
                           for k, v in columns.items()})[1]


def test_hold_timer_edges():
    fold = folds.RiskState(cfg=RiskStateConfig(ema_alpha=1.0))
    out = run(fold, ts=[0, 1200, 1300, 2399], risk_raw=[.1, .1, .6, .6])
    assert out["severity"].tolist() == ["info"] * 4                         # held 1199 ms
    out = run(fold, ts=[0, 1200, 1200, 2400], risk_raw=[.1, .1, .6, .6])
    assert out["severity"].tolist() == ["info", "info", "info", "warn"]     # held 1200 ms
    assert run(fold, ts=[0], risk_raw=[.8])["severity"].tolist() == ["critical"]
    back = run(fold, ts=[1000, 500, 500], risk_raw=[.1, .2, .3])            # time going backwards keeps the slope
    assert back["slope_per_sec"].tolist() == [0, 0, 0]


def test_fall_detector():
    fold = folds.FallDetector()
    still = list(range(2500, 13000, 500))
    at = lambda hit: run(fold, ts=[0, 100, hit] + [t + hit for t in still],
                         magnitude=[1.0, .2, 3.0] + [1.0] * len(still))["fall_event"].tolist()
    assert "prompt" in at(2300)          # 2200 ms after free fall
    assert "prompt" not in at(2301)
    moving = run(fold, ts=[0, 100, 300] + [300 + 500 * i for i in range(1, 40)],
                 magnitude=[1.0, .2, 3.0] + [1.0, 1.3] * 19 + [1.0])
    assert "prompt" not in moving["fall_event"].tolist() and moving["phase"][-1] == "idle"


def test_ewma_start_modes():
    for start, want in (("first", [1.0, .7]), ("zero", [.3, .21]), (2.0, [1.7, 1.19])):
        assert run(folds.Ewma("v", "e", start=start), v=[1.0, 0.0])["e"] == pytest.approx(want)


def test_cooldown_edge():
    fold = folds.Cooldown("ts", "want", K.REROUTE_COOLDOWN_MS)
    out = run(fold, ts=[0, 2999, 3000, 3001], want=[True, True, True, True])
    assert out["granted"].tolist() == [True, False, True, False]


@pytest.mark.parametrize("level", [.1, .6, .5, .9])
def test_quiet_hot_zone_needs_few_rounds(spark, monkeypatch, level):
    """64 chunks of a zone that stays in one level after a short start; each state round is one collect of exits."""
    n = 64 * 200
    first = F.when(F.col("id") < 20, .7).otherwise(level)      # .5 then keeps the warn of the start
    quiet = spark.range(n).select("id", (F.col("id") * 1000).alias("ts"), F.lit("A").alias("zone"), first.alias("risk_raw"), F.lit(1.0).alias("magnitude"))
    quiet = quiet.withColumn("want", F.col("id") % 4000 == 7)
    rounds, exits = [], O._exits
    monkeypatch.setattr(O, "_exits", lambda *a: rounds.append(1) or exits(*a))
    for fold in (folds.RiskState(), folds.FallDetector(), folds.AltRisk("risk_raw", "risk_raw", "risk_raw"), folds.Cooldown("ts", "want", 3000)):
        rounds.clear()
        names = ["id", *fold.output]
        assert rows(O.ordered_fold(quiet, ["zone"], ["ts", "id"], fold, 200), *names) == rows(O.ordered_fold(quiet, ["zone"], ["ts", "id"], fold), *names)
        assert 1 <= len(rounds) <= 3, type(fold).__name__


def test_null_risk_carries_the_average():
    out = run(folds.RiskState(), ts=[0, 1000, 2000, 3000], risk_raw=[None, .5, None, .5])
    assert out["risk_ema"].tolist() == pytest.approx([0, .175, .175, .28875])
    assert out["severity"].tolist() == ["info"] * 4
