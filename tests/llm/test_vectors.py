"""Operators on clip features against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from throngcast.llm import hard_negatives, value_codes, vector_copies

NAN, INF = float("nan"), float("inf")
CLIPS = "clip_id {}, label int, features array<double>, code string, n_links string, tree string, error int, kept string"
EXTRA = ("mine", "mine", "mine", -1, "mine")


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], CLIPS.format(kind))


def crowds(seed=1, n=400, dims=16, labels=3):
    """Scattered vectors, and groups of near copies of several sizes, one of them crowded."""
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dims) for _ in range(n)]
    for size, blur in ((2, 0.02), (3, 0.08), (25, 0.05), (180, 0.04)):
        centre = rng.standard_normal(dims)
        rows += [centre + blur * rng.standard_normal(dims) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), int(rng.integers(0, labels)) if at < n else 1, [float(x) for x in rows[at]]) for i, at in enumerate(order)]


EDGES = [(0, None, [1.0, 2.0, 3.0, 4.0]), (1, 1, None), (2, 1, []), (3, 1, [NAN, 1.0, 1.0, 1.0]), (4, 1, [INF, 0.0, 0.0, 0.0]), (5, 1, [None, 1.0, 0.0, 0.0]), (6, 1, [0.0, 0.0, 0.0, 0.0]),
         (7, 1, [1.0, 0.0, 0.0, 0.5]), (8, 1, [1.0, 0.0, 0.0, 0.5]), (8, 1, [1.0, 0.0, 0.0, 0.5]), (None, 1, [2.0, 0.0, 0.0, 1.0]), (9, 1, [1.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0]),
         (10, 2, [1.0, 0.0, 0.0, 0.5]), (11, None, [1.0, 0.0, 0.0, 0.5]), (12, 2, [-0.0, 1e200, 0.0, 0.0]), (13, 2, [0.0, 1e-200, 0.0, 0.0]), (14, 1, [-1.0, 0.0, 0.0, -0.5])]


def good(row):
    return bool(row[2]) and all(x is not None and math.isfinite(x) for x in row[2])


def links(rows, similarity=0.93):
    """Per row (links, least id reachable)."""
    def unit(v):
        v = np.array(v)
        v = v / np.abs(v).max()
        return v / np.sqrt((v * v).sum())
    units = [unit(r[2]) if r[1] is not None and good(r) and any(r[2]) else None for r in rows]
    near = [[j for j, (s, w) in enumerate(zip(rows, units)) if i != j and u is not None and w is not None and r[1] == s[1] and len(u) == len(w) and u @ w >= similarity]
            for i, (r, u) in enumerate(zip(rows, units))]
    least = [math.inf if r[0] is None else r[0] for r in rows]
    while True:
        lower = [min([least[i], *[least[j] for j in near[i]]]) for i in range(len(rows))]
        if lower == least:
            return [(len(n), None if low == math.inf else low) for n, low in zip(near, least)]
        least = lower


@pytest.mark.parametrize("rows", [crowds(), EDGES, []])
def test_close_vectors_equal_brute_force(spark, rows):
    got = vector_copies.close_vectors(frame(spark, rows))
    assert got.columns == ["clip_id", "label", "features", "code", "tree", "error", "n_links", "component_id", "kept"]
    key = lambda t: str(t)
    found = sorted(((r.clip_id, r.label, str(r.features), r.n_links, r.component_id, r.kept, r.code, r.error) for r in got.collect()), key=key)
    assert found == sorted(((i, l, str(v), n, c, i == c, "mine", -1) for (i, l, v), (n, c) in zip(rows, links(rows))), key=key)


def test_text_ids_of_clips(spark):
    rows = [(f"clip_{i}", 1, [1.0, i / 100]) for i in range(12)]
    got = {r.clip_id: r.component_id for r in vector_copies.close_vectors(frame(spark, rows, "string")).collect()}
    assert set(got.values()) == {"clip_0"}
    coded, _ = value_codes.compress(frame(spark, rows, "string"), parts=2)
    assert coded.count() == 12
    mined = hard_negatives.mine_hard_negatives(frame(spark, [(i, n % 2, v) for n, (i, _, v) in enumerate(rows)], "string"), F.col("clip_id") == "clip_3")
    assert {r.anchor_id for r in mined.collect()} <= {"clip_3"}


def test_balls_cover_crowds(spark):
    rows = crowds(5)
    nodes = spark.createDataFrame([(i, (l, 16), [float(x) for x in np.array(v) / np.linalg.norm(v)]) for i, l, v in rows], "node long, class struct<label:int,d:int>, u array<double>")
    balls, members = vector_copies.cover(nodes, math.acos(0.93))
    centres, placed = {b.ball: b for b in balls.collect()}, members.collect()
    assert sorted(m.node for m in placed) == [i for i, *_ in rows] and len(centres) < len(rows) - 100
    vectors = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    for m in placed:
        far = math.acos(min(1.0, vectors[m.node] @ np.array(centres[m.ball].c)))
        assert far <= centres[m.ball].r + 1e-6 and far <= math.acos(0.93) / 2


def mined(rows, anchors, window=(80, 100)):
    out = []
    rows = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and good((i, l, v))]
    last = lambda i: (i is None, i if i is not None else 0)
    for a, label, head in rows:
        if a not in anchors:
            continue
        scored = sorted(((sum(x * y for x, y in zip(head, v)), i, l) for i, l, v in rows if len(v) == len(head)), key=lambda s: (-s[0], last(s[1])))
        for p, i, _ in [s for s in scored if s[2] == label and s[1] != a][:5]:
            hard = [s for s in scored if s[2] != label and window[0] * p <= 100 * s[0] <= window[1] * p][:5]
            out += [(a, i, n + 1, j, p, s) for n, (s, j, _) in enumerate(hard)]
    return sorted(out, key=str)


TIED = [(i, i % 3, [float(i % 2), 1.0, 0.5]) for i in range(40)] + [(50, 1, [-1.0, -1.0, -1.0]), (51, 1, [0.0, 0.0, 0.0])]


@pytest.mark.parametrize("rows, anchors", [(crowds(2, 300, 8), set(range(0, 500, 20))), (TIED, {0, 7, 50, 51}), ([r for r in EDGES if r[0] not in (12, 13)] + [(20, 3, [1.0, 0.1, 0.0, 0.5]), (None, 3, [1.0, 0.1, 0.0, 0.5])], {0, 1, 5, 6, 7, 9, 14, 20}),
                                           (crowds(2, 50), set()), ([], {1})])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, rows, anchors):
    got = hard_negatives.mine_hard_negatives(frame(spark, rows), F.col("clip_id").isin(*anchors) if anchors else F.lit(None).cast("boolean"))
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, anchors)


def test_spanning_tree_is_minimal_and_ordered():
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 50, (40, 6)).astype(float)
    order, parents, edges = hard_negatives.spanning_tree(rows)
    assert sorted(order) == list(range(40)) and parents[0] == -1 and all(0 <= p < n for n, p in enumerate(parents) if n)
    assert np.allclose(edges[1:], [np.linalg.norm(rows[order[n]] - rows[order[parents[n]]]) for n in range(1, 40)])
    up, total = list(range(40)), 0.0                  # Kruskal
    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for d, i, j in sorted((np.linalg.norm(rows[i] - rows[j]), i, j) for i in range(40) for j in range(i)):
        if top(i) != top(j):
            up[top(i)], total = top(j), total + d
    assert math.isclose(total, edges.sum())


def test_bounds_spare_scores():
    """Anchors close together leave most clips unscored, and the result is the same."""
    import pyarrow as pa
    rng = random.Random(4)
    head = [100, 0, 0]
    anchors = pa.table({"id": [0, 1, 2], "label": ["a"] * 3, "v": [head, [101, 0, 0], [101, 1, 0]], "number": [0, 1, 2], "tree": [0, 0, 0], "place": [0, 1, 2], "parent": [-1, 0, 1],
                        "edge": [0.0, 1.0, 1.0], "positives": [[9000], [9100], [9100]]})
    clips = pa.table({"id": list(range(10, 1010)), "label": ["b"] * 1000, "v": [[rng.randint(-100, 100), 0, 0] for _ in range(1000)]})
    scored = []
    def wanted(a, rows, low, high):
        mask = (high >= 7200) & (low <= 9100)
        return mask, lambda chosen, scores: scored.append(len(chosen))
    hard_negatives._scored(anchors, clips, wanted)
    assert scored[0] == 1000 and max(scored[1:]) < 300


def coded(rows, parts=4, entries=256, rounds=4, scale=1024):
    rows = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows if good((i, l, v)) and len(v) % parts == 0]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    rows = [r for r in rows if len(r[2]) == len(rows[0][2])]
    width = len(rows[0][2]) // parts
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in rows[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min((square(x, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, _, v in rows:
                members.setdefault(best(cut(v)[p], book)[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(members[n]) for c in zip(*members[n])] if n in members else e for n, e in enumerate(book)]
    found = [[best(x, books[p]) for p, x in enumerate(cut(v))] for _, _, v in rows]
    total = {}
    for (_, l, _), some in zip(rows, found):
        total[l] = total.get(l, 0) + sum(d for d, _ in some)
    return [(i, [n for _, n in some], sum(d for d, _ in some), total[l]) for (i, l, _), some in zip(rows, found)], books


@pytest.mark.parametrize("rows, entries", [(crowds(6, 60, 8), 16), ([r for r in EDGES if r[0] not in (12, 13)], 256), ([(i, None, [float(i % 3)] * 4) for i in range(9)], 4)])
def test_value_codes_equal_brute_force(spark, rows, entries):
    got, books = value_codes.compress(frame(spark, rows), entries=entries)
    want, wanted = coded(rows, entries=entries)
    assert got.columns == ["clip_id", "label", "features", "n_links", "tree", "kept", "code", "error", "label_error"] and books.tolist() == wanted
    assert sorted(((r.clip_id, r.code, r.error, r.label_error) for r in got.collect()), key=str) == sorted(want, key=str)


def test_value_codes_without_rows(spark):
    got, books = value_codes.compress(frame(spark, [(1, 1, None), (2, 1, [1.0])]))
    assert got.collect() == [] and books.size == 0
    with pytest.raises(Exception, match="too large"):
        value_codes.compress(frame(spark, [(1, 1, [1e9] * 4), (2, 1, [-1e9] * 4)]))[0].collect()
