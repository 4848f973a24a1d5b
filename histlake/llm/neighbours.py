"""Approximate nearest neighbours with balanced posting lists, by largest inner product.

Largest inner product is nearest distance once every vector gets one more component,
sqrt(longest^2 - length^2) (0 for queries). Centroids come from a bounded, documented sample
(``sample_rows``): k-means whose lists above their fair share are split, so lists stay
balanced. Every vector goes to its nearest centroid's list and, near a boundary, to those
whose squared distance is within ``replicate_ratio`` of the nearest's, at most ``max_copies``.
A query, scaled to the longest length (which changes no order and leaves its distances without
a common offset), opens the lists whose squared distance is within a ratio of the nearest's,
however many, and ``min_lists`` at least. Vectors and queries find their lists by walks of a graph
in memory: each centroid's nearest others, and a few at random that keep it in one piece; a walk
that is still within the ratio at its end goes on with twice the breadth. The ratio is measured:
the least at which ``recall`` of the true neighbours within a sample lie in opened lists.

The posting list is what is scanned: a query meets the vectors of the lists that it opens, in
exact inner products of double precision, and no others. Lists near one another are exchanged as
one group (a cell), with one row per query that opens any of them; ``search_work`` tells how many
lists each query opens and how many vectors it is held against.

Scale: a cell that outgrows ``block_values`` components (the sample is bounded, the table is
not) is cut into blocks by a hash of the id, and the queries of a cell into slices of
``slice_rows``; only such cells' vectors and queries are exchanged more than once, and cells of
which no query opens a list not at all. Where vectors have no clusters, many lists open: recall is kept, not
time. Equal vectors are one candidate: of each, only the k + 1 least ids can ever be among a
query's k nearest, so a vector that a third of all rows share costs k + 1 rows. The broadcast
holds centroids and graph only: at most ``max_centroids`` times the dimension.

Defined cases: vectors that are null, empty, zero, or hold a null, NaN or infinite component,
or whose length differs from the most common one, and rows with a null id, take no part. Of an
id with several vectors, the least (component by component) counts, as query and as candidate.
Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty table gives none.
Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histlake.sources import read_table, write_and_read


@dataclass(frozen=True)
class Index:
    """Centroids in the lifted space, and the graph in which they are searched."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    longest2: float

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            x = x * np.sqrt(self.longest2 / (x * x).sum(1))[:, None]
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest2 - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    def dense(self, lifted: np.ndarray) -> np.ndarray:
        """All squared distances."""
        c = self.centroids
        return np.maximum(0.0, (lifted * lifted).sum(1)[:, None] + (c * c).sum(1) - 2 * lifted @ c.T)

    def walk(self, x: np.ndarray, beam: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of about the ``beam`` nearest centroids, ascending, by best-first walks,
        ``step`` centroids of each at a time."""
        k = len(self.centroids)
        beam, row = min(beam, k), np.arange(len(x))[:, None]
        seen = np.zeros((len(x), k), bool)
        seen[:, self.entries] = True
        entry = self.centroids[self.entries]
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        dist = np.maximum(0.0, (x * x).sum(1)[:, None] + (entry * entry).sum(1) - 2 * x @ entry.T)
        done = np.zeros(ids.shape, bool)
        while True:
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = (np.take_along_axis(v, keep, 1) for v in (ids, dist, done))
            open_ = np.where(done, np.inf, dist)
            at = np.argpartition(open_, min(step, open_.shape[1]) - 1, axis=1)[:, :step]
            use = np.isfinite(np.take_along_axis(open_, at, 1))
            if not use.any():
                break
            np.put_along_axis(done, at, True, 1)
            near = self.graph[np.take_along_axis(ids, at, 1)]
            near = np.sort(np.where(use[:, :, None], near, -1).reshape(len(x), -1), axis=1)
            fresh = (near >= 0) & ~seen[row, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(fresh)
            found = near[r, c]
            seen[r, found] = True
            d = np.full(near.shape, np.inf)
            away = self.centroids[found] - x[r]
            d[r, c] = np.einsum("ij,ij->i", away, away)
            ids, dist, done = np.hstack([ids, near]), np.hstack([dist, d]), np.hstack([done, ~fresh])
        order = np.lexsort((ids, dist), axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return ids[:, :beam], dist[:, :beam]

    def nearest(self, lifted: np.ndarray, n: int, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest of a walk (infinitely far where there are fewer)."""
        parts = [self.walk(lifted[a : a + 256], max(n, beam)) for a in range(0, len(lifted), 256)]
        ids, dist = (np.vstack([p[j] for p in parts]) for j in (0, 1))
        return ids[:, :n], dist[:, :n]

    def within(self, lifted: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the centroids within ``ratio`` of each row's nearest, ``least`` at least."""
        k = len(self.centroids)
        left, beam = np.arange(len(lifted)), max(64, 2 * least)
        rows, lists = [], []
        while len(left):
            again = []
            for a in range(0, len(left), 256):
                part = left[a : a + 256]
                if 2 * beam >= k:  # as good as all of them
                    dist = self.dense(lifted[part])
                    ids = np.argsort(dist, axis=1, kind="stable")
                    dist = np.take_along_axis(dist, ids, 1)
                else:
                    ids, dist = self.walk(lifted[part], beam)
                limit = np.maximum(dist[:, :1] * ratio, dist[:, min(least, dist.shape[1]) - 1][:, None]) + 1e-12
                more = (dist[:, -1] <= limit[:, 0]) & (dist.shape[1] < k)
                r, c = np.nonzero((dist <= limit) & ~more[:, None])
                rows.append(part[r])
                lists.append(ids[r, c])
                again.append(part[more])
            left, beam = np.concatenate(again), 2 * beam
        return np.concatenate(rows), np.concatenate(lists)


def _balanced_kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """k or a few more centroids; lists of over twice the fair share are split in two."""
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for turn in range(rounds):
        near = _nearest_dense(x, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = sums[counts > 0] / counts[counts > 0, None]
        if turn < rounds - 2:
            full = np.flatnonzero(counts[counts > 0] > 2 * max(2, len(x) // k))
            parts = []
            used = np.flatnonzero(counts > 0)
            for c in full:
                inside = x[near == used[c]]
                spread = inside.std(0)
                if spread.max() > 0:
                    axis = int(spread.argmax())
                    upper = inside[:, axis] > np.median(inside[:, axis])
                    if 0 < upper.sum() < len(inside):
                        centroids[c] = inside[~upper].mean(0)
                        parts.append(inside[upper].mean(0))
            if parts:
                centroids = np.vstack([centroids, *parts])
    return centroids


def _nearest_dense(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids * centroids).sum(1)
    return np.concatenate([np.argmax(x[a : a + 4096] @ centroids.T - half, axis=1) for a in range(0, len(x), 4096)])


def build_index(sample: np.ndarray, longest2: float, *, list_rows: int, max_centroids: int, degree: int = 24, far: int = 4, seed: int = 11, total: int | None = None) -> Index:
    """``degree``: nearest others of a centroid in the graph; ``far``: others at random."""
    rng = np.random.default_rng(seed)
    lifted = Index(np.zeros((1, 1)), np.zeros((1, 0), np.int64), np.zeros(1, np.int64), longest2).lift(sample)
    k = int(min(max_centroids, max(1, (total or len(sample)) // list_rows), max(1, len(sample) // 4)))
    centroids = _balanced_kmeans(lifted, k, rng)
    k = len(centroids)
    degree = min(degree, k - 1)
    half = 0.5 * (centroids * centroids).sum(1)
    graph = np.zeros((k, degree + far), np.int64)
    graph[:, degree:] = rng.integers(0, k, (k, far))
    for a in range(0, k, 1024):
        score = centroids[a : a + 1024] @ centroids.T - half
        score[np.arange(len(score)), a + np.arange(len(score))] = -np.inf
        if degree:
            graph[a : a + 1024, :degree] = np.argpartition(-score, degree - 1, axis=1)[:, :degree]
    entries = np.sort(rng.choice(k, min(k, 2 * int(np.ceil(np.sqrt(k)))), replace=False))
    return Index(centroids, graph, entries, longest2)


@dataclass(frozen=True)
class Lists:
    """Which lists vectors are posted to and queries open; lists near one another have one cell."""

    index: Index
    cell: np.ndarray
    max_copies: int
    replicate_ratio: float
    min_lists: int

    def post(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the lists that hold them."""
        ids, dist = self.index.nearest(self.index.lift(x), self.max_copies)
        row, copy = np.nonzero(dist <= dist[:, :1] * self.replicate_ratio + 1e-12)
        return row, ids[row, copy]

    def open(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the lists that they open."""
        return self.index.within(self.index.lift(x, query=True), ratio, self.min_lists)


def make_lists(index: Index, n_cells: int, *, seed: int = 12, **options) -> Lists:
    pick = np.random.default_rng(seed).choice(len(index.centroids), min(n_cells, len(index.centroids)), replace=False)
    cell = np.unique(_nearest_dense(index.centroids, index.centroids[pick]), return_inverse=True)[1].ravel()
    return Lists(index, cell, **options)


def calibrate(lists: Lists, sample: np.ndarray, *, k: int, total: int, recall: float) -> float:
    """The least ratio at which queries of the sample meet ``recall`` of their neighbours.

    Of ``total`` vectors' k nearest, about k * len(sample) / total lie in the sample.
    """
    if len(lists.index.centroids) == 1 or len(sample) < 2:
        return 1.0
    near = int(np.clip(round(k * len(sample) / total), 1, len(sample) - 1))
    n = min(len(sample), int(np.clip(4000 // near, 200, 2000)))
    found, ratios = [], []
    for a in range(0, n, 256):
        q = sample[a : min(n, a + 256)]
        score = q @ sample.T
        score[np.arange(len(q)), a + np.arange(len(q))] = -np.inf
        found.append(np.argpartition(-score, near - 1, axis=1)[:, :near])
        dist = lists.index.dense(lists.index.lift(q, query=True))
        base = np.partition(dist, min(lists.min_lists, dist.shape[1]) - 1, axis=1)
        first = base.min(1, keepdims=True)
        # those open at any ratio count as 1
        ratios.append(np.where(dist <= base[:, [min(lists.min_lists, dist.shape[1]) - 1]], 1.0, dist / np.maximum(first, 1e-300)))
    found, ratios = np.vstack(found), np.vstack(ratios)
    asked, where = np.unique(found, return_inverse=True)
    row, held = lists.post(sample[asked])
    homes = np.full((len(asked), lists.max_copies), -1)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    homes[row, place] = held
    homes = homes[where.reshape(found.shape)]
    needed = np.where(homes >= 0, np.take_along_axis(ratios[:, None, :], homes.reshape(len(found), 1, -1) * (homes.reshape(len(found), 1, -1) >= 0), 2).reshape(homes.shape), np.inf).min(2)
    return float(np.quantile(needed, recall, method="higher"))


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, of one length."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    # 0 * x is 0 unless x is null, NaN or infinite; a sum over none is null
    finite = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * 0.0) == 0.0
    length2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.abs(c))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & finite & (length2 > 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 0))


@dataclass
class _Plan:
    """What a search is made of: vectors by id, groups of equal ones, lists, and who opens which."""

    vectors: DataFrame
    groups: DataFrame
    lists: Lists
    ratio: float
    block_rows: int


def _plan(vectors: DataFrame, *, k: int, id_col: str, vector_col: str, sample_rows: int, list_rows: int, max_centroids: int, replicate_ratio: float, max_copies: int, min_lists: int, recall: float, block_values: int) -> _Plan | None:
    one = _valid(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    one = write_and_read(one, "vectors")
    facts = one.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("longest2")).first()
    if not facts["n"]:
        return None
    # Of equal vectors, the k + 1 least ids; first within hashed shares, so that no task meets them all.
    mine = Window.partitionBy("v", "share").orderBy("vec_id")
    all_of = Window.partitionBy("v").orderBy("vec_id")
    shares = one.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = shares.withColumn("r", F.row_number().over(mine)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(all_of)).where(F.col("r") <= k + 1)
    groups = write_and_read(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vector-groups")
    n_groups = groups.count()

    # A bounded sample of distinct vectors, by hash: the first are fitted, those after them measure the ratio.
    sample = _stack(groups.select("v").orderBy(F.xxhash64(F.lit("sample"), "v")).limit(2 * sample_rows).toPandas()["v"])
    index = build_index(sample[:sample_rows], facts["longest2"], list_rows=list_rows, max_centroids=max_centroids, total=n_groups)
    block_rows = max(1, block_values // sample.shape[1])
    lists = make_lists(index, -(-n_groups // block_rows), max_copies=max_copies, replicate_ratio=replicate_ratio, min_lists=min_lists)
    # fitted vectors lie nearer to the centroids than others: they measure it in their share of the table
    fitted, unseen = sample[:sample_rows], sample[sample_rows:]
    n_fitted = round(len(unseen) * len(fitted) / (n_groups - len(fitted))) if len(unseen) else len(fitted)
    measured = np.random.default_rng(13).permutation(np.vstack([unseen, fitted[:n_fitted]]))
    return _Plan(one, groups, lists, calibrate(lists, measured, k=k, total=n_groups, recall=recall), block_rows)


def _posted(plan: _Plan) -> DataFrame:
    """cell, list, ids, v: the posting lists."""
    shared = plan.vectors.sparkSession.sparkContext.broadcast(plan.lists)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, found = shared.value.post(_stack(pdf["v"]))
                yield pd.DataFrame({"cell": shared.value.cell[found], "list": found, "ids": pdf["ids"].to_numpy()[row], "v": pdf["v"].to_numpy()[row]})

    return write_and_read(plan.groups.mapInPandas(post, "cell long, list long, ids array<long>, v array<double>"), "postings")


def _asked(plan: _Plan, every: int) -> DataFrame:
    """cell, query_id, lists: the lists that each query opens, a row per cell."""
    spark = plan.vectors.sparkSession
    shared, ratio = spark.sparkContext.broadcast(plan.lists), plan.ratio

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                row, found = shared.value.open(_stack(part["v"]), ratio)
                cell = shared.value.cell[found]
                order = np.lexsort((found, cell, row))
                row, cell, found = row[order], cell[order], found[order]
                head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                yield pd.DataFrame({"cell": cell[head], "query_id": part["vec_id"].to_numpy()[row[head]], "lists": np.split(found, head[1:])})

    # a number of partitions of its own, else the few bytes of all queries are put into one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = plan.vectors.where(F.col("vec_id") % every == 0).repartition(tasks, "vec_id")
    return write_and_read(chosen.mapInPandas(ask, "cell long, query_id long, lists array<long>"), "opened")


DEFAULTS = {"sample_rows": 20_000, "list_rows": 64, "max_centroids": 16_384, "replicate_ratio": 1.03, "max_copies": 3, "min_lists": 4, "recall": 0.96, "block_values": 2**20, "id_col": "vec_id", "vector_col": "embedding"}


def search_work(vectors: DataFrame, *, k: int = 20, every: int = 20, **options) -> DataFrame:
    """query_id, lists, scanned: how many lists a query opens, and how many stored vectors it is held against."""
    plan = _plan(vectors, k=k, **{**DEFAULTS, **options})
    if plan is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, lists long, scanned long")
    sizes = _posted(plan).groupBy("list").agg(F.count("*").alias("n"))
    return _asked(plan, every).select("query_id", F.explode("lists").alias("list")).join(sizes, "list", "left").groupBy("query_id").agg(F.count("*").alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scanned"))


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, slice_rows: int = 16_384, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by ``every``, their k nearest others. ``options``: see DEFAULTS."""
    plan = _plan(vectors, k=k, **{**DEFAULTS, **options})
    if plan is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted, asked = _posted(plan), _asked(plan, every)
    sizes = posted.groupBy("cell").agg(F.ceil(F.count("*") / plan.block_rows).cast("int").alias("blocks"))
    needs = asked.groupBy("cell").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
    parts = write_and_read(sizes.join(needs, "cell"), "cell-parts")  # cells with vectors that a query opens
    block = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")
    held = posted.join(parts, "cell").select("cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "list", "ids", "v")
    wanted = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("slice"), "query_id", "lists")
    wanted = wanted.join(plan.vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def scan(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        order = np.argsort(right["list"].to_numpy(), kind="stable")
        home, ids = right["list"].to_numpy()[order], right["ids"].to_numpy()[order]
        v = _stack(right["v"])[order]
        names, firsts = np.unique(home, return_index=True)
        ends = np.append(firsts[1:], len(home))
        found = []
        for name, q, opened in zip(left["query_id"].to_numpy(), _stack(left["q"]), left["lists"], strict=True):
            at = np.searchsorted(names, opened)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == opened)]
            rows = np.concatenate([np.arange(firsts[j], ends[j]) for j in at]) if len(at) else np.zeros(0, np.int64)
            if not len(rows):
                continue
            scores = v[rows] @ q
            # copies of a vector may lie in several of these lists
            most = min(len(scores), (k + 1) * plan_copies)
            least = np.partition(scores, len(scores) - most)[len(scores) - most]
            keep = np.flatnonzero(scores >= least - 1e-9)
            counts = np.array([len(ids[j]) for j in rows[keep]])
            near, s = np.concatenate([ids[j] for j in rows[keep]]), np.repeat(scores[keep], counts)
            near, first = np.unique(near, return_index=True)
            s = s[first]
            near, s = near[near != name], s[near != name]
            best = np.lexsort((near, -s))[: 2 * k]
            found.append((np.full(len(best), name), near[best], s[best]))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    plan_copies = plan.lists.max_copies
    group = ("cell", "block", "slice")
    rough = wanted.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(scan, "query_id long, vec_id long, score double")
    # a vector in several cells is found several times
    rough = rough.groupBy("query_id", "vec_id").agg(F.max("score").alias("rough"))
    per_query = Window.partitionBy("query_id")
    close = rough.withColumn("r", F.row_number().over(per_query.orderBy(F.desc("rough"), "vec_id"))).where(F.col("r") <= 2 * k)
    # exactly the measure, in one fixed order of summing
    exact = (
        close.join(plan.vectors, "vec_id")
        .join(plan.vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        .withColumn("score", F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c))
    )
    ranked = exact.withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark, sf_dir):
    return search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
