"""How the sources of a language differ: divergences of smoothed term frequencies, exact whole numbers.

Terms are runs of letters as bytes see them: A-Z (lower-cased), a-z and everything beyond
ASCII. A table of 256 entries over the concatenated UTF-8 buffer of a batch marks them; where
the marks begin and end, and where documents do, are the slices. xxhash gathers equal slices,
and every slice is compared with the first of its hash byte by byte; those that differ are told
apart by their bytes. Documents by terms, the counts of a block are a sparse matrix, of which
only its sums by (lang, source, term) leave the task.

A language keeps the terms that ``min_docs`` of its documents hold. A (lang, source) group with
count c of a term has p = 1 + floor(10^9 (c + 2) / (N + 2 V)); the divergence of p and q is
floor((p - q)^2 / (p + q)). Part ``pair`` adds it up over all kept terms for each two sources of a
language, part ``term`` ranks a group's terms against its language. Kept terms are dealt into
slices, each a compressed sparse row matrix of all the language's sources: a source is laid out
densely once, its divergences from the others' entries are added up by ``reduceat``, and what
the others lack is one product per base frequency. A slice's sums are exact, so they add up.

Scale: a block of ``BLOCK_BYTES`` text is in memory at once; longer documents are cut between
terms, and their counts put together again. Counts are pre-aggregated per task, then by term,
so no source, language or word is gathered in one task. A slice has ``slice_entries`` counts on
average, and a row for each source of its language. Rows for pairs of sources are as many as
the result's, times slices.

Defined cases: null text, lang and source are ''; every group counts, one without terms with
0 occurrences; a language without kept terms has pairs of value 0; repeated rows are documents
each; ids are not read; an empty table gives no rows; of clashing names only the three columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histlake.llm.common import text_or_empty
from histlake.sources import read_table, write_and_read

BLOCK_BYTES = 4 << 20
SCALE = 1_000_000_000


def _letters() -> np.ndarray:
    """By byte: 0 outside terms, else the byte in lower case."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


LETTERS = _letters()
digest = xxhash.xxh3_64_intdigest


def term_slices(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the terms in a buffer of looked-up bytes; document d is bounds[d] to bounds[d + 1]."""
    inside = low != 0
    edge = np.zeros(len(low) + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def equal_slices(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's term, and for each term one slice: by hash, verified on all bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    term = term.astype(np.int64)
    lengths, shown = ends - starts, first[term]
    same = lengths == lengths[shown]
    alike = np.flatnonzero(same)
    n = lengths[alike]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    equal = low[np.repeat(starts[alike], n) + at] == low[np.repeat(starts[shown[alike]], n) + at]
    same[alike] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    if not same.all():
        others: dict[bytes, int] = {}
        first = first.tolist()
        for i in np.flatnonzero(~same).tolist():
            word = raw[starts[i] : ends[i]]
            if word not in others:
                others[word] = len(first)
                first.append(i)
            term[i] = others[word]
        first = np.array(first)
    return term, first


def _take(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices as an array of strings."""
    n = ends - starts
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], n)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(low[np.repeat(starts, n) + at]))


def count_block(low: np.ndarray, bounds: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, occurrences and documents, a row per (term, group) of a block. ``groups``: number by document."""
    starts, ends, docs = term_slices(low, bounds)
    term, first = equal_slices(low, starts, ends)
    n_docs, n_groups = len(bounds) - 1, int(groups.max(initial=0)) + 1
    cells, n = np.unique(term * n_docs + docs, return_counts=True)  # the matrix: terms by documents
    by = cells // n_docs * n_groups + groups[cells % n_docs]
    order = np.argsort(by, kind="stable")
    by, n = by[order], n[order]
    head = np.flatnonzero(np.diff(by, prepend=-1))
    found = first[by[head] // n_groups]
    sums = np.add.reduceat(n, head) if len(head) else n
    return _take(low, starts[found], ends[found]), by[head] % n_groups, sums, np.diff(head, append=len(by))


def _cut(low: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long document in parts of about ``most`` bytes, cut outside terms."""
    at = 0
    while at < len(low):
        end = min(at + most, len(low))
        while end < len(low):
            gap = np.flatnonzero(low[end : end + most] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + most, len(low))
        yield low[at:end]
        at = end


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lang, source, text to rows of COUNTS, which may repeat."""
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in (0, 1))
        pairs, numbers = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        langs, sources = (d.take(pa.array(k)) for d, k in zip((lang.dictionary, source.dictionary), divmod(pairs, max(1, len(source.dictionary))), strict=True))
        texts = batch.column(2).cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

        def rows(terms, group, n, docs, langs=langs, sources=sources) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=COUNTS)

        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, side="right")) - 1)
            low = LETTERS[data[bounds[at] : bounds[end]]]
            if len(low) <= BLOCK_BYTES:
                terms, group, n, docs = count_block(low, bounds[at : end + 1] - bounds[at], numbers[at:end])
            else:
                words: dict[str, int] = {}
                for part in _cut(low, BLOCK_BYTES):
                    found, _, ns, _ = count_block(part, np.array([0, len(part)]), np.zeros(1, np.int64))
                    for word, k in zip(found.to_pylist(), ns.tolist(), strict=True):
                        words[word] = words.get(word, 0) + k
                terms, n = pa.array(words.keys(), pa.string()), np.array(list(words.values()), np.int64)
                group, docs = np.full(len(n), numbers[at]), np.ones(len(n), np.int64)
            if len(terms):
                yield rows(terms, group, n, docs)
            at = end


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits."""
    d = p - q
    return d * d // (p + q)


def pair_sums(indptr: np.ndarray, terms: np.ndarray, p: np.ndarray, base: np.ndarray, n_terms: int, most: int = 1 << 21) -> np.ndarray:
    """Divergences of each two rows of a CSR matrix whose missing entries are ``base`` by row: upper triangle of a square."""
    n = len(base)
    out = np.zeros((n, n), np.int64)
    dense = np.empty(n_terms, np.int64)
    for i in range(n - 1):
        own = slice(indptr[i], indptr[i + 1])
        dense[:] = base[i]
        dense[terms[own]] = p[own]
        # as if the others had no entry ...
        others = base[i + 1 :]
        out[i, i + 1 :] = (n_terms - (own.stop - own.start)) * _f(base[i], others)
        step = max(1, most // len(others))
        for at in range(own.start, own.stop, step):
            out[i, i + 1 :] += _f(p[at : min(at + step, own.stop), None], others).sum(axis=0)
        # ... and what their entries change
        heads, sizes = indptr[i + 1 : -1], np.diff(indptr[i + 1 :])
        full = np.flatnonzero(sizes)
        if len(full):
            theirs = slice(indptr[i + 1], indptr[-1])
            here = dense[terms[theirs]]
            change = _f(here, p[theirs]) - _f(here, np.repeat(others, sizes))
            out[i, i + 1 + full] += np.add.reduceat(change, heads[full] - theirs.start)
    return out


PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _diverge(top_terms: int):
    def of_slice(table: pa.Table) -> pa.Table:
        """Rows of a slice: a group's base (term null), or a kept term's p in a group and q in its language."""
        table = table.combine_chunks()
        lang = table.column("lang")[0].as_py()
        of_group = pc.is_null(table.column("term"))
        facts, rows = table.filter(of_group), table.filter(pc.invert(of_group))
        names = facts.column("source").combine_chunks()
        base = facts.column("p").to_numpy()
        source = pc.index_in(rows.column("source"), value_set=names).to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(rows.column("term")).combine_chunks() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        term, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        place = np.empty(len(words), np.int64)
        place[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))
        p, q = rows.column("p").to_numpy(), rows.column("q").to_numpy()
        order = np.lexsort((term, source))
        source, term, p, q = source[order], term[order], p[order], q[order]
        indptr = np.searchsorted(source, np.arange(len(names) + 1))
        sums = pair_sums(indptr, term, p, base, len(words))
        a, b = np.triu_indices(len(names), 1)
        more = np.flatnonzero(p > q)
        value = _f(p[more], q[more])
        order = np.lexsort((place[term[more]], -value, source[more]))
        more, value = more[order], value[order]
        best = np.arange(len(more)) - np.searchsorted(source[more], source[more]) < top_terms
        more, value = more[best], value[best]
        n, m = len(a), len(more)
        columns = [
            pa.array([lang] * (n + m), pa.string()),
            pa.concat_arrays([names.take(pa.array(a)), names.take(pa.array(source[more]))]),
            pa.array(["pair"] * n + ["term"] * m, pa.string()),
            pa.concat_arrays([names.take(pa.array(b)), words.take(pa.array(term[more]))]),
            pa.array(np.concatenate([sums[a, b], value]), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, schema=PARTS)

    return of_slice


def _smoothed(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 V)), in decimals wide enough for any corpus."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + 2)
    return F.call_function("div", above, total.cast("decimal(19,0)") + 2 * n_terms.cast("decimal(19,0)")) + 1


def audit_sources(
    docs: DataFrame,
    *,
    min_docs: int = 10,
    top_terms: int = 10,
    slice_entries: int = 1 << 14,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank (from 1 per group and part)."""
    named = docs.select(*[text_or_empty(F.col(c).cast("string")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = named.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    all_of_it = {"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "once": (F.min("source").over(of_term) == F.col("source")).cast("long")}
    kept = counts.withColumns(all_of_it).where(F.col("lang_docs") >= min_docs)
    kept = write_and_read(kept.select("lang", "source", "term", "n", "lang_n", "once"), "audit-terms")
    of_lang = Window.partitionBy("lang")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("once").alias("once"), F.count("*").alias("entries"))
    groups = named.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(sums, ["lang", "source"], "left").na.fill(0)
    groups = groups.select("lang", "source", F.col("n").alias("total"), F.sum("n").over(of_lang).alias("lang_total"), F.sum("once").over(of_lang).alias("v"), F.sum("entries").over(of_lang).alias("entries"))
    slices = F.greatest(F.ceil(F.col("entries") / slice_entries), F.lit(1)).cast("int")
    groups = write_and_read(groups.withColumn("slices", slices), "audit-groups")
    entries = kept.join(groups, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "source", "term",
        _smoothed(F.col("n"), F.col("total"), F.col("v")).alias("p"), _smoothed(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    base = F.when(F.col("v") > 0, _smoothed(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)
    facts = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "source", F.lit(None).cast("string").alias("term"), base.alias("p"), F.lit(0).cast("long").alias("q"))
    parts = entries.unionByName(facts).groupBy("lang", "slice").applyInArrow(_diverge(top_terms), "lang string, source string, part string, item string, value long")
    parts = write_and_read(parts, "audit-parts", replaces=[kept, groups])
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("two"), "part", "value").select("lang", "two.source", "part", "two.item", "value")
    first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(first)), parts.where("part = 'term'").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top_terms)]
    return ranked[0].unionByName(ranked[1])


def op12_divergence(spark, sf_dir):
    return audit_sources(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT lang, source, doc, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT doc) AS docs FROM words GROUP BY ALL),
kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
groups AS (
  SELECT DISTINCT lang, source FROM d),
held AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT h.lang, h.source, h.term, h.n, 1 + 1000000000::HUGEINT * (h.n + 2) // (sum(h.n) OVER (PARTITION BY h.lang, h.source) + 2 * l.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (h.lang_n + 2) // (l.total + 2 * l.v) AS q
  FROM held h JOIN langs l ON h.lang = l.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
