"""Near-duplicates and nearest neighbours against all pairs."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from histlake.llm.near_dups import components, keep_first_of_groups, near_duplicates
from histlake.llm.neighbours import search, search_work


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([(d, shingles(t)) for d, t in rows if d is not None], 2):
        find(i), find(j)
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {d: find(d) for d, _ in rows if d is not None}


def copies(rng, n_groups, n):
    rows, doc = [], 0
    for _ in range(n_groups):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 5, 40, 120]))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            rows.append((doc, " ".join(w)))
            doc += 1
    rng.shuffle(rows)
    return rows


def test_groups_match_all_pairs(spark):
    rows = copies(random.Random(4), 12, 9)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)
    text = dict(rows)
    assert all(r["n_shingles"] == len(shingles(text[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_large_group_of_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for doc in range(300):
        w = list(base)
        if doc % 2:
            w[rng.randrange(60)] = f"y{doc}"
        rows.append((doc, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_recall_near_the_bound(spark):
    """Pairs of similarity 0.70 to 0.80: none is linked wrongly, and few are missed; with no sketch, too."""
    rng = random.Random(9)
    rows = []
    for doc in range(0, 500, 2):
        base = [f"w{doc}_{i}" for i in range(200)]
        other = list(base)
        for at in range(rng.randint(2, 12) * 15 - 15, 195, 25):
            other[at] = f"x{at}"
        while len(rows) <= doc + 1:
            rows.append((len(rows), " ".join(base if len(rows) == doc else other)))
    # edits spaced so that each takes five shingles: 5 to 6 of them are just around the bound
    rows += [(1000 + 2 * k + side, " ".join(f"v{k}_{i}" if not side or i % 33 or not i else f"y{k}_{i}" for i in range(196 + k % 8))) for k in range(250) for side in (0, 1)]
    sets = {d: shingles(t) for d, t in rows}
    similar = {d: len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in sets if d % 2 == 0}
    near = [d for d, s in similar.items() if 0.70 <= s <= 0.80]
    assert len(near) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for sketch in (512, 0):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, sketch=sketch).collect()}
        linked = {d for d in similar if got[d] == got[d + 1]}
        true = {d for d in similar if 100 * len(sets[d] & sets[d + 1]) >= 75 * len(sets[d] | sets[d + 1])}
        assert linked <= true
        assert len(linked & set(near)) >= 0.97 * len(true & set(near))


def test_odd_rows(odd, odd_rows, empty):
    got = near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[22] == {(0, 22, True)} and by[23] == {(0, 23, True)} and by[24] == {(0, 24, True)}
    assert by[None] == {(0, None, True), (len(shingles(odd_rows[1][1])), None, True)}
    assert {c for _, c, _ in by[20]} == {0} and {c for _, c, _ in by[21]} == {0}
    kept = keep_first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and 20 not in ids and 21 not in ids and ids.count(26) == 1 and ids.count(None) == 2
    assert near_duplicates(empty).count() == 0 and keep_first_of_groups(empty).count() == 0


def test_sketches_estimate_similarity():
    from histlake.llm.near_dups import bin_sketch

    rng = np.random.default_rng(2)
    for n in (40, 400, 4000):
        for part in (0.5, 0.75, 0.95):
            seen = []
            for _ in range(60):
                both, more = rng.integers(0, 2**63, int(n * part), dtype=np.uint64), rng.integers(0, 2**63, (2, (n - int(n * part)) // 2), dtype=np.uint64)
                x, y = (np.array([int(b) for b in bin_sketch(np.concatenate([both, m]), 256).view(np.uint8)]) for m in more)
                x, y = (np.concatenate([c & 15, c >> 4]) for c in (x, y))
                held = (x | y) > 0
                seen.append((x == y)[held].mean())
            assert abs(np.mean(seen) - (1 + 14 * part) / 15) < 0.03


def test_an_id_with_several_texts_joins_their_groups(spark):
    rng = random.Random(11)
    a, b, c = ([f"{x}{i}" for i in range(50)] for x in "abc")
    rows = [(3, a), (5, b), (26, a), (26, b), (7, c), (30, c[:-1] + ["z"]), (30, a[:-1] + ["y"]), (40, []), (40, b[:-1] + ["x"]), (50, []), (60, ["w"]), (60, ["v"])]
    rows = [(d, " ".join(w)) for d, w in rows] + [(100 + k, " ".join(rng.choice([a, b, c])[k:])) for k in range(5)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(rows)
    assert want[26] == want[5] == want[40] == want[7] == want[30] == 3 and want[50] == 50
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((d, len(shingles(t)), want[d], want[d] == d) for d, t in rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def vectors(rng, n, d=16):
    centres = rng.normal(size=(20, d))
    x = centres[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, d))
    return (x * rng.uniform(0.7, 1.3, (n, 1))).astype(np.float32)


def exact(rows, q, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    me = x[ids == q][0]
    score = np.zeros(len(x))
    for j in range(x.shape[1]):  # one product after the other, without compensation
        score = score + me[j] * x[:, j]
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(rng, 1500))]
    rows += [(2000 + i, rows[3][1]) for i in range(200)]  # one common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in search(df, list_rows=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in [i for i, _ in rows if i % 20 == 0]:
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        want = exact(rows, q, 20)
        scores = dict(exact(rows, q, len(rows)))
        assert all(scores[i] == s for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for i, _ in want} & {i for _, i, _ in found})
        total += 20
    assert hit / total >= 0.9


def test_neighbours_leave_out_what_has_no_place(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0)]
    assert search(df.where("vec_id > 100")).count() == 0
    assert search(df.where("vec_id = 20")).count() == 0


def recall_of(got, x, every, k=20):
    queries = np.arange(0, len(x), every)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    want = np.argsort(-score, axis=1)[:, :k]
    return sum(len(got[q] & set(w.tolist())) for q, w in zip(queries.tolist(), want, strict=True)) / want.size


def test_neighbours_recall_holds_without_clusters(spark):
    """The number of opened lists is not bounded: it is what the recall takes."""
    x = np.random.default_rng(3).normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for r in search(df, every=60, list_rows=24, sample_rows=5000, block_values=2**15).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert recall_of(got, x, 60) >= 0.92


def test_neighbours_open_few_lists_of_clusters(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 32))[rng.integers(0, 300, 15_000)] + 0.3 * rng.normal(size=(15_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    options = {"every": 100, "sample_rows": 5000, "block_values": 2**13, "slice_rows": 5}
    got = defaultdict(set)
    for r in search(df, **options).collect():
        got[r["query_id"]].add(r["vec_id"])
    work = [r["scanned"] for r in search_work(df, **{k: v for k, v in options.items() if k != "slice_rows"}).collect()]
    share = sum(work) / len(work) / len(x)
    print(f"recall {recall_of(got, x, 100):.3f}, {100 * share:.1f} % of the vectors scanned")
    assert len(work) == 150 and share < 0.1 and recall_of(got, x, 100) >= 0.9


def test_walks_find_the_nearest_centroids():
    from histlake.llm.neighbours import build_index

    rng = np.random.default_rng(6)
    for x in (rng.normal(size=(6000, 16)), rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.01 * rng.normal(size=(6000, 16))):
        index = build_index(x, float((x * x).sum(1).max()), list_rows=8, max_centroids=10_000)
        q = index.lift(x[:200])
        dist = index.dense(q)
        ids, near = index.nearest(q, 3)
        assert (ids[:, 0] == dist.argmin(1)).mean() > 0.97 and np.allclose(near, np.take_along_axis(dist, ids, 1), atol=1e-8)
        row, lists = index.within(q, 1.3, 4)
        limit = np.maximum(dist.min(1) * 1.3, np.partition(dist, 3, axis=1)[:, 3])
        true = set(zip(*map(np.ndarray.tolist, np.nonzero(dist <= limit[:, None])), strict=True))
        found = set(zip(row.tolist(), lists.tolist(), strict=True))
        assert len(found) == len(row) and len(found & true) >= 0.97 * len(true)


def test_an_id_with_several_vectors_has_the_least(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 3.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [5.0, 5.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, LIST string, cell int")
    assert sorted(tuple(r) for r in search(df).collect()) == [(0, 1, 2, 3.0), (0, 2, 1, 1.0)]


def test_sketch_loses_nothing_at_the_bound_and_cuts_well_below(spark):
    """Of random sets of similarity 0.75, sketches leave out one in 1,000 at most; of 0.6, most."""
    from histlake.llm.near_dups import _may_link, bin_sketch

    rng = np.random.default_rng(7)
    rows = []
    for union, trials in ((8, 1500), (16, 1500), (60, 1500), (180, 1500), (600, 1500), (4000, 400)):
        for alike in (0.75, 0.6):
            for _ in range(trials):
                x = rng.integers(0, 2**63, union, dtype=np.uint64)
                both = int(union * alike)
                cut = both + (union - both) // 2
                a, b = x[:cut], np.concatenate([x[:both], x[cut:]])
                rows.append((union, alike, len(a), len(b), bin_sketch(a, 512).tolist(), bin_sketch(b, 512).tolist()))
    df = spark.createDataFrame(rows, "u int, alike double, an long, bn long, ak array<long>, bk array<long>")
    got = {(r["u"], r["alike"]): r["n"] for r in df.where(_may_link("a", "b", 75, 512)).groupBy("u", "alike").agg(F.count("*").alias("n")).collect()}
    for union, trials in ((8, 1500), (16, 1500), (60, 1500), (180, 1500), (600, 1500), (4000, 400)):
        assert got[union, 0.75] >= trials - 1
        assert union < 60 or got.get((union, 0.6), 0) < 0.2 * trials
