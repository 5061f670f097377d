"""Repeats, fingerprints, components and site lines against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from throngcast.llm import components, repeats, similar, simhash, site_lines

DOCS = "incident_id long, map_id string, description string, kept string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def generated(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        cut = rng.randint(0, len(text))
        text = text[:cut] + rng.choice(["", "X", " " + rng.choice(base)[:rng.randint(0, 120)], "\n"]) + text[cut:]
        rows.append((i, f"m{i % 5}", text, "x"))
    return rows


EDGE = [(None, "m", "a" * 120, None), (1, None, None, None), (2, "m", "", None), (3, "m", "a" * 120, "k"), (3, "m", "a" * 120, "k"), (4, "m", "b" * 49, None),
        (5, "m", "b" * 49, None), (6, "m", "é" * 60, None), (7, "m", "é" * 60, None), (8, "m", " \n\t ", None)]


@pytest.mark.parametrize("rows", [generated(), EDGE, [], generated(5, 25) + [(99, "m", "lorem ipsum " * 20000, "x"), (100, "m", "dolor " * 9 + "lorem ipsum " * 9, "x")]])
def test_repeats_equal_brute_force(spark, rows):
    got = sorted(((r.incident_id is None, r.incident_id or 0), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    want = sorted(((i is None, i or 0), *w) for (i, *_), w in zip(rows, brute.repeats([(r[0], r[2]) for r in rows])))
    assert got == want


def test_repeats_do_not_depend_on_parts(spark):
    rows = generated(9)
    small = repeats.remove_repeats(frame(spark, rows).repartition(5), part_bytes=700, unit_bytes=900).collect()
    assert {r.incident_id: bytes(r.kept) for r in small} == {i: w[3] for (i, *_), w in zip(rows, brute.repeats([(r[0], r[2]) for r in rows]))}


def test_maximal_repeats_lists_all_occurrences():
    text = b"xabcdyabcdzabcdxabcd"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [next((n for n in range(len(text)) if text[a:a + n + 1] != text[b:b + n + 1]), 0) for a, b in zip(order, order[1:])]
    left = np.array([text[i - 1] if i else -1 for i in order])
    groups = {(text[order[a]:order[a] + n], tuple(sorted(order[a:b + 1]))) for a, b, n in repeats.maximal_repeats(np.array(order), np.array(lcp), left, 2)}
    assert groups == {(b"abcd", (1, 6, 11, 16)), (b"xabcd", (0, 15))}


@pytest.mark.parametrize("rows", [generated(), EDGE, []])
def test_near_duplicates_equal_brute_force(spark, rows):
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [brute.fingerprint(r[2]) for r in rows]
    roots = brute.components(prints)
    least = {}
    for root, row in zip(roots, rows):
        ids = [x for x in (least.get(root), row[0]) if x is not None]
        least[root] = min(ids) if ids else None
    want = sorted((str(r[0]), p - (p >> 63 << 64), str(least[root])) for r, p, root in zip(rows, prints, roots))
    assert sorted((str(r.incident_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_one_row_of_each_component_stays(spark):
    rows = EDGE + generated()
    kept = simhash.one_per_component(simhash.near_duplicates(frame(spark, rows))).collect()
    assert len(kept) == len({r.component_root for r in kept}) == len(set(brute.components([brute.fingerprint(r[2]) for r in rows])))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_dense_groups_link_like_all_pairs(spark, hot):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    prints = sorted({c ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 3)))) for c in centres for _ in range(40)})
    signed = [p - (p >> 63 << 64) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), hot=hot)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in links.collect())
    root = {r.node: r.root for r in components.connected(links).collect()}
    want = brute.components(prints)
    pairs = {(root.get(s, s), prints[w]) for s, w in zip(signed, want)}
    assert len(pairs) == len(set(want)) == len({a for a, _ in pairs})


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(50)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 7), (1, 0)], "a long, b long")
    root = {r.node: r.root for r in components.connected(edges).collect()}
    assert len(root) == 301 + 51 and len({root[i] for i in range(301)}) == 1 and len(set(root.values())) == 2
    assert components.connected(edges.where("a > 9999")).count() == 0


@pytest.mark.parametrize("sites", [1, 2, 3])
@pytest.mark.parametrize("rows", [EDGE, [], [(i, f"m{i % 4}", "\n".join(f"line {j}" for j in range(i % 7)) + "\n\n  ", "x") for i in range(30)] + [(None, None, "line 1", "x")]])
def test_site_lines_equal_brute_force(spark, rows, sites):
    got = site_lines.remove_spread_lines(frame(spark, rows), min_sites=sites).collect()
    want = brute.without_spread_lines([(r[1], r[2]) for r in rows], sites)
    assert sorted((str(r.incident_id), str(r.description)) for r in got) == sorted((str(r[0]), str(w)) for r, w in zip(rows, want))
    assert all(r.kept is None or r.kept in ("x", "k") for r in got)


def edited(seed=4):
    """Texts of four bases with a few words replaced, a large group of copies, short and empty texts."""
    rng = random.Random(seed)
    bases = [[f"b{b}w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 160))] for b in range(4)]
    rows = []
    for i in range(160):
        words = list(bases[0 if i < 90 else i % 4])
        for at in rng.choices(range(len(words)), k=rng.randint(0, 4)):
            words[at] = f"x{rng.randint(0, 9999)}"
        rows.append((i, "m", " ".join(words), "x"))
    return rows + [(500, "m", None, "x"), (501, "m", " \n", "x"), (502, "m", "One two", "x"), (503, "m", "one  TWO", "x"), (None, "m", rows[3][2], "x"), (3, "m", rows[3][2], "x")]


@pytest.mark.parametrize("small", [16, 2])
def test_near_copies_equal_brute_force_jaccard(spark, small, monkeypatch):
    monkeypatch.setattr(similar, "SMALL", small)
    rows = edited()
    sets = [brute.shingles(r[2], 5) for r in rows]
    linked = [[j for j in range(len(rows)) if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    low = list(range(len(rows)))
    for _ in rows:
        low = [min(low[j] for j in near) for near in linked]
    assert any(simhash.MAX_BITS < bin(brute.fingerprint(rows[i][2]) ^ brute.fingerprint(rows[j][2])).count("1") for i in range(160) for j in linked[i])
    least = {c: min(r[0] for r, x in zip(rows, low) if x == c and r[0] is not None) for c in set(low)}
    got = similar.near_copies(frame(spark, rows)).collect()
    assert sorted((str(r.incident_id), str(r.component_id)) for r in got) == sorted((str(r[0]), str(least[c])) for r, c in zip(rows, low))
    assert similar.near_copies(frame(spark, [])).count() == 0


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    """Texts of one long shared passage and some own words are not near copies; hardly any pair of them is compared, however many they are."""
    compared = []
    whole = similar._similar

    def counted(similarity):
        acc = spark.sparkContext.accumulator(0)
        compared.append(acc)
        run = whole(similarity)
        return lambda left, right: (acc.add(len(left)), run(left, right))[1]
    monkeypatch.setattr(similar, "_similar", counted)
    shared = " ".join(f"s{i}" for i in range(70))
    sizes = {}
    for n in (200, 400, 800):
        rows = [(i, "m", shared + " " + " ".join(f"o{i}w{j}" for j in range(10)), "x") for i in range(n)]
        assert len({r.component_root for r in similar.near_copies(frame(spark, rows)).collect()}) == n
        sizes[n] = compared[-1].value
    assert sizes[800] <= 2 * sizes[400] + 100 and sizes[400] <= 2 * sizes[200] + 100


def test_near_copies_go_through_the_index(spark, monkeypatch):
    """Sets whose SimHash fingerprints differ in few bits are put together by the index of op6, and only whole sets make links of them."""
    said = [f"w{i}" for i in range(6000)]
    rows = [(i, "m", " ".join([*said[:3000], f"x{i}", *said[3000:]]), "x") for i in range(3)] + [(9, "m", "other words than the ones before it", "x"), (10, "m", None, "x")]
    near = lambda i, j: bin(simhash.majority(similar.shingles(rows[i][2])) ^ simhash.majority(similar.shingles(rows[j][2]))).count("1") <= simhash.MAX_BITS
    assert near(0, 1) and near(1, 2) and not near(0, 3)
    found, pairs = [], similar._index_pairs
    monkeypatch.setattr(similar, "_index_pairs", lambda sketches: (found.append(pairs(sketches).collect()), pairs(sketches))[1])
    got = similar.near_copies(frame(spark, rows)).collect()
    assert len(found) == 1 and len(found[0]) == 2
    assert {r.incident_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0, 9: 9, 10: 10}


def test_one_of_near_copies_is_the_first_of_each(spark):
    rows = edited() + [(None, "m", "a text that nobody else has here", "x"), (None, "m", "a text that nobody else has here", "x")]
    want = simhash.one_per_component(similar.near_copies(frame(spark, rows))).collect()
    got = similar.one_of_near_copies(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted(str(r.incident_id) for r in got.collect()) == sorted(str(r.incident_id) for r in want)
    assert similar.one_of_near_copies(frame(spark, [])).count() == 0


def test_bits_rule_out_no_similar_sets_and_most_long_others():
    """Bits never differ in more places than sets differ in shingles, whatever the sizes; unrelated long sets are told apart without moving them."""
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in (0, 1, 40, 1023, 1025, 5000, 9000, 9000)]
    sets += [np.unique(np.concatenate((s[:len(s) * 9 // 10], sets[4][:50]))) for s in sets]
    texts = iter(sets)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(similar, "shingles", lambda text, words: next(texts))
        bits = similar._sketches(5)(pa.array([""] * len(sets))).field("bits").to_pylist()
    for a, x in zip(sets, bits):
        for b, y in zip(sets, bits):
            assert similar._apart(x, y) <= len(np.setxor1d(a, b))
    room = similar._may_be_similar(0.8)(pa.array([bits[6], bits[6]]), pa.array([bits[7], bits[14]]), pa.array([18000, 17150]))
    assert room.to_pylist() == [False, True]


def test_only_wanted_texts_move(spark):
    texts = spark.createDataFrame([(i, f"text {i % 500}") for i in range(1000)], "t long, said string").withColumn("t", F.xxhash64("said"))
    prints = texts.limit(20).select("t", F.col("t").alias("p")).distinct()
    wanted = similar._wanted(texts, prints)
    assert sorted(r.p for r in wanted.collect()) == sorted(r.p for r in prints.collect())
    assert similar._wanted(texts, prints.where("false")).count() == 0


def test_text_ids(spark):
    """The project's ids are text: the smallest one is the smallest text."""
    shared = "the north gate is blocked by a fallen fence and people turn back towards the hall " * 2
    rows = [("inc_10", "m", shared, "x"), ("inc_9", "m", shared, "x"), (None, "m", shared, "x"), ("inc_1", "m", "short", "x")]
    texts = spark.createDataFrame(rows, "incident_id string, map_id string, description string, kept string")
    cut = {r.incident_id: r.n_removed for r in repeats.remove_repeats(texts).collect()}
    assert cut == {"inc_10": 0, "inc_9": len(shared), None: len(shared), "inc_1": 0}
    for operator in (simhash.near_duplicates, similar.near_copies):
        assert {r.incident_id: r.component_id for r in operator(texts).collect()} == {"inc_10": "inc_10", "inc_9": "inc_10", None: "inc_10", "inc_1": "inc_1"}
