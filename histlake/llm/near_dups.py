"""MinHash near-duplicates by tensored banding, with every link confirmed on full sets.

A text's set is its distinct 5-word shingles, hashed to 64 bits. The table keys of banded
MinHash are formed by tensoring: from two collections of ``halves`` small hashes each (of
``rows`` minhashes), every pair of one from each collection makes a key. ``halves**2`` tables
of ``2 * rows`` minhashes thus take only ``2 * halves * rows`` minhash functions instead of
``2 * halves**2 * rows``: 11 and 3 here, so 121 tables of 6 rows from 66 functions. Two sets
of similarity s share a key with probability (1 - (1 - s^3)^11)^2: 0.995 at 0.75. A sketch of
one more function, the least hash in each of ``sketch`` bins as four bits, estimates a pair's
similarity; a pair whose estimate is four standard deviations below the bound is no candidate.
Bins draw from a set without replacement, so of small sets the estimate is nearly exact.
``sketch=0`` leaves this filter out: then every pair that shares a key is held against its full
sets.

Candidates become links only if 100 * intersection >= 75 * union on the full sets. Components
of the links are groups; a group keeps its smallest id.

Skew and blow-up:
* Equal sets are one node (its smallest id), found by a pre-aggregated hash of the set; so a
  text copied a million times is one node.
* Half keys that no second node has are dropped before keys are formed, which is lossless and
  leaves only documents that resemble another.
* No pairs are emitted within a bucket. Each bucket first links its members to one of them,
  the one that shares most half keys with others (a star, whose centre is thus central). Each
  node's most frequent centre is verified first, and components are formed; then the other
  star pairs between different components.
* Only then, so that no link between different texts is lost to the stars, come the pairs
  that share a key across components: of a bucket's largest component, only with the
  bucket's other members. A pair arises at the first key that it shares, not once per table.
* Components are found by alternating large and small stars over written tables, never on
  the driver.

One path serves every size: texts and links are exchanged by key, nothing is broadcast by
this code, and each step's shuffle files and the tables it replaces go before the next one.

Defined cases: a null text, or one without words, has an empty set (n_shingles 0) and is
linked with nothing; texts of any length are taken whole; a null id is linked with nothing,
has a null component and is kept; rows that repeat an id count as one document that has each
of their sets: it joins the groups of all of them, and its rows are kept all, or none; an empty
table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histlake.llm.common import OWN, without
from histlake.sources import read_table, write_and_read

OUTPUTS = ("n_shingles", "component_id", "kept")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Shingle sets of texts as sorted distinct 64-bit hashes."""

    def __init__(self, words: int = 5, cache_words: int = 300_000):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.words, self.cache, self.cache_words = words, {}, cache_words

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        cache, hash_ = self.cache, self.hash
        if len(cache) > self.cache_words:
            cache.clear()
        for w in set(found).difference(cache):
            cache[w] = hash_(w)
        h = np.array([cache[w] for w in found], dtype=np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            out = (out ^ h[j : len(h) - k + 1 + j]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minhash_parameters(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minhashes(shingles: np.ndarray, params: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = params
    least = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 1024):
        h = low[None, at : at + 1024] * a[:, None]
        h ^= b[:, None]
        least = np.minimum(least, h.min(1))
    return least


def half_keys(least: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """2 * halves small hashes: the first collection's, then the second's."""
    out = np.arange(2 * halves, dtype=np.uint64)
    for part in least[: 2 * halves * rows].reshape(2 * halves, rows).T:
        out = (out ^ part.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(31)
    return out


def bin_sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Of each bin's least hash four bits, 1 to 15, or 0 where a bin is empty; 16 bins to a long."""
    bits = bins.bit_length() - 1
    h = ((shingles * _MIX) >> np.uint64(32)).astype(np.uint32)
    h = np.sort((h & np.uint32(bins - 1)) << np.uint32(32 - bits) | h >> np.uint32(bits))
    first = np.searchsorted(h, np.arange(bins, dtype=np.uint32) << np.uint32(32 - bits))
    there = np.append(first[1:], len(h)) > first
    least = h[np.minimum(first, len(h) - 1)]
    code = np.where(there, 1 + (least * np.uint32(0x9E3779B1) >> np.uint32(16)) % 15, 0).astype(np.uint8)
    return (code[::2] | code[1::2] << 4).view("<i8")


def signatures(docs: DataFrame, *, words: int, halves: int, rows: int, sketch: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), s1, s2 (128-bit hash of the set), h (half keys), k (sketch); empty sets have nulls."""
    import hashlib

    long, longs = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("id", long), ("n", long), ("s1", long), ("s2", long), ("h", longs), ("k", longs)])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, params = Shingler(words), minhash_parameters(2 * halves * rows, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle(t)
                    if not len(s):
                        out.append((i, 0, None, None, None, None))
                        continue
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    s1, s2 = np.frombuffer(digest, "<i8").tolist()
                    least = minhashes(s, params)
                    out.append((i, len(s), s1, s2, half_keys(least, halves, rows).view(np.int64), bin_sketch(s, sketch) if sketch else []))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return narrow.mapInArrow(sign, "id long, n long, s1 long, s2 long, h array<long>, k array<long>")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its smallest node) for edges (a, b), by alternating large and small stars."""
    edges = write_and_read(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: what is larger than the node hangs on its smallest neighbour
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: what is smaller, and the node itself, hang on the smallest
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = write_and_read(small.union(down.select("a", F.col("m").alias("b"))).distinct(), label, replaces=[edges])
        # a sum of hashes changes if any edge does (decimal: no overflow)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _may_link(a: str, b: str, percent: int, sketch: int) -> Column:
    """Whether sizes and sketches allow the similarity. ``a``, ``b``: prefixes of n and k."""
    na, nb, ka, kb = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}k"), F.col(f"{b}k")
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    if not sketch:
        return sizes

    def nibbles(longs: Column) -> Column:
        """How many groups of four bits have one set."""
        two = F.transform(longs, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)))
        return F.aggregate(two, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))))

    differ = nibbles(F.zip_with(ka, kb, lambda x, y: x.bitwiseXOR(y)))
    held = nibbles(F.zip_with(ka, kb, lambda x, y: x.bitwiseOR(y)))
    # at the bound: bins that agree, four bits of different hashes by chance, and how far their number strays;
    # drawn without replacement from a union of so many
    alike = percent / 100
    union = (na + nb) / (1 + alike)
    rest = F.greatest(F.lit(0.0), 1 - held / union)
    strays = held * (F.lit(alike * (1 - alike) * (14 / 15) ** 2) * rest + F.lit((1 - alike) * 14 / 225))
    return sizes & (held - differ >= held * F.lit((1 + 14 * alike) / 15) - 4 * F.sqrt(strays) - 0.5)


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 75,
    halves: int = 11,
    rows: int = 3,
    sketch: int = 512,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``sketch``: 0, or a power of two from 16 on.
    """
    if sketch and (sketch < 16 or sketch & (sketch - 1)):
        raise ValueError(f"sketch must be 0 or a power of two from 16 on, not {sketch}")
    signed = write_and_read(
        signatures(docs, words=words, halves=halves, rows=rows, sketch=sketch, seed=seed, id_col=id_col, text_col=text_col), "signatures"
    )
    full = signed.where("n > 0 and id is not null")
    # one node per distinct set; all that is derived of equal sets is equal
    nodes = write_and_read(
        full.groupBy("s1", "s2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("h").alias("h"), F.first("k").alias("k")), "nodes"
    )
    names = full.select("s1", "s2", "id").join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    names = write_and_read(names.select("id", "node").distinct(), "members")
    links = _links(docs, nodes, words=words, percent=percent, halves=halves, sketch=sketch, id_col=id_col, text_col=text_col)
    # the nodes of one id are one document
    several = names.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("id", "b")
    of_one = names.join(several, "id").where("node > b").select(F.col("node").alias("a"), "b")
    found = components(links.union(of_one))
    by_id = names.join(found, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    by_id = write_and_read(by_id, "by-id", replaces=[links, names])
    own = signed.select("id", "n").join(by_id, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return own.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(docs: DataFrame, nodes: DataFrame, *, words: int, percent: int, halves: int, sketch: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: verified links between nodes."""
    # half keys that several nodes have, and how many
    single = nodes.select("node", F.posexplode("h").alias("place", "half"))
    shared = single.groupBy("place", "half").agg(F.count("*").alias("nodes")).where("nodes > 1")
    pieces = (
        single.join(shared, ["place", "half"])
        .groupBy("node")
        .agg(
            F.collect_list(F.when(F.col("place") < halves, F.struct("place", "half"))).alias("first"),
            F.collect_list(F.when(F.col("place") >= halves, F.struct("place", "half"))).alias("second"),
            F.sum("nodes").alias("central"),
        )
        .where((F.size("first") > 0) & (F.size("second") > 0))
    )
    pieces = write_and_read(pieces, "half-keys")
    keys = pieces.select("node", "central", F.explode("first").alias("x"), "second").select("node", "central", "x", F.explode("second").alias("y"))
    keys = keys.select("node", "central", F.col("x.place").alias("i"), F.col("y.place").alias("j"), F.xxhash64("x.place", "x.half", "y.place", "y.half").alias("key"))
    keys = write_and_read(keys, "keys", replaces=[pieces])
    several = keys.groupBy("key").agg(F.count("*").alias("members"), F.max_by("node", F.struct("central", "node")).alias("star")).where("members > 1").select("key", "star")
    keys = write_and_read(keys.join(several, "key").select("key", "star", "node", "i", "j"), "shared-keys", replaces=[keys])
    stars = write_and_read(keys.groupBy(F.col("node").alias("a"), F.col("star").alias("b")).agg(F.count("*").alias("times")), "stars")
    inside = stars.select(F.col("a").alias("node")).distinct()  # every member of a shared bucket, centres too

    facts = write_and_read(nodes.join(inside, "node", "left_semi").select("node", "n", "k", "h"), "facts", replaces=[nodes])
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
    wanted = texts.join(facts.select("node").hint("merge"), "node", "left_semi").dropDuplicates()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [shingle(t).view(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["node", "s"])

    # full sets of these nodes: from whole texts, once
    full = write_and_read(wanted.mapInArrow(sets, "node long, s array<long>"), "sets")

    def possible(pairs: DataFrame) -> DataFrame:
        a, b = (facts.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("k").alias(f"{x}k")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(_may_link("a", "b", percent, sketch)).select(*pairs.columns)

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (full.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    def labelled(found: DataFrame) -> DataFrame:
        return facts.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c"))

    # 1. each node with its most frequent star
    stars = write_and_read(possible(stars.where("a <> b")), "star-pairs", replaces=[stars])
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    links = write_and_read(verified(best), "links")

    # 2. star pairs between different components
    names = write_and_read(labelled(components(links)), "names")
    across = (
        stars.select("a", "b")
        .join(names.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a")
        .join(names.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        .where("ca <> cb")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    links = write_and_read(links.union(verified(across)), "links", replaces=[links, stars, names])

    # 3. pairs that share a key across components, at the first key that both have
    names = labelled(components(links))
    placed = keys.select("key", "node", "i", "j").join(names, "node")
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main")).where("parts > 1").drop("parts")
    rows_ = placed.join(main, "key").join(facts, "node")
    rows_ = write_and_read(rows_.select("key", "i", "j", "node", "c", (F.col("c") == F.col("main")).alias("main"), "n", "k", "h"), "mixed", replaces=[keys])
    left, right = (rows_.select(*[F.col(c).alias(f"{x}{c}") for c in rows_.columns]) for x in "ab")
    same = F.zip_with("ah", "bh", lambda p, q: p == q)
    once = (F.array_position(F.slice(same, 1, halves), True) == F.col("ai") + 1) & (F.array_position(F.slice(same, halves + 1, halves), True) == F.col("aj") + 1 - halves)
    other = ~F.col("amain") & (F.col("bmain") | (F.col("anode") < F.col("bnode"))) & (F.col("ac") != F.col("bc"))
    rest = left.join(right, (F.col("akey") == F.col("bkey")) & other & _may_link("a", "b", percent, sketch) & once).select(F.col("anode").alias("a"), F.col("bnode").alias("b"))
    rest = write_and_read(rest.distinct(), "rest", replaces=[rows_])
    return write_and_read(links.union(verified(rest)), "links", replaces=[links, rest, facts, full])


def keep_first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the smallest id (of its rows, one), columns unchanged.

    Documents without an id are kept. Rows that repeat an id are one document, even if their
    texts differ, and one of them stays (that of the least text hash).
    """
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col(id_col).alias(f"{OWN}id")).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col(f"{OWN}id"), "left_anti")
    text = F.xxhash64(F.col(options.get("text_col", "text")))
    first = Window.partitionBy(F.col(id_col), F.when(F.col(id_col).isNull(), text)).orderBy(text)
    numbered = kept.withColumn(f"{OWN}n", F.when(F.col(id_col).isNull(), F.lit(1)).otherwise(F.row_number().over(first)))
    return numbered.where(F.col(f"{OWN}n") == 1).select(*docs.columns)


def op3_near_dups(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
