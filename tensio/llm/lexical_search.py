"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through the normaliser ``m``, so documents of equal
``m`` form a stratum in which a term's impact depends on its frequency ``tf`` alone.  The index has
one row for a stratum (or a bounded piece of it): the documents, and for each term and ``tf`` the
list of documents holding the term so often.  A search works out one impact per stratum and
``tf``, bounds every stratum by its terms' largest impacts, visits the strata by falling bound
and leaves out those that cannot reach an item's 50th score so far.

The items are sent to the tasks in blocks of bounded size; every document is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensio.llm import words as W
from tensio.llm.batches import map_arrow, map_slices, partitions, staged, text_buffer
from tensio.operators.partitioning import share

TOP = 50
#: Share of a document's length in its normaliser, in percent.
LENGTH_PERCENT = 50
#: Item text sent at once; postings and documents of a stratum row; postings searched together.
BLOCK_BYTES = 16 << 20
ROW_POSTINGS = 200_000
ROW_DOCS = 16_384
SHARD_POSTINGS = 2_000_000
#: Documents visited before the first cut, and by how much the visits grow.
FIRST_VISIT = 512
GROWTH = 8
_U = np.uint64


def terms_of(column: pa.Array) -> W.Words:
    """Terms: runs of ASCII letters and digits and characters beyond ASCII; only A-Z lower-cased."""
    data, offsets = text_buffer(column)
    lower = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    return W.split(lower, offsets, letters=True)


@dataclass
class Items:
    """A block of items: their terms as numbers into the sorted hashes of the vocabulary."""

    keys: pa.Array
    vocabulary: np.ndarray
    first: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, keys: pa.Array, texts: pa.Array) -> Items:
        """Rows of equal key are one item with all their terms, each once."""
        coded = keys.dictionary_encode(null_encoding="encode")
        w = terms_of(texts)
        vocabulary, term = np.unique(w.hashes(), return_inverse=True)
        item = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), w.counts)
        pairs = np.unique(item * max(len(vocabulary), 1) + term)
        item, term = pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1)
        return cls(coded.dictionary, vocabulary, np.searchsorted(item, np.arange(len(coded.dictionary) + 1)), term)


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    rows = items.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        table = part.toArrow().combine_chunks()  # about BLOCK_BYTES
        if table.num_rows:
            found = Items.of(table.column("key").combine_chunks(), table.column("text").combine_chunks())
            if len(found.vocabulary):
                yield found


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """``key, n, terms, tfs`` for every document with a term: its length and the vocabulary's terms in it."""
    key_type = docs.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        maybe = np.zeros(1 << 20, bool)
        maybe[known >> _U(44)] = True
        for batch in batches:
            w = terms_of(batch.column(1))
            h = w.hashes()
            at = np.flatnonzero(maybe[h >> _U(44)])
            term = np.searchsorted(known, h[at])
            term[term == len(known)] = 0
            real = known[term] == h[at]
            pairs, tf = np.unique(w.doc[at[real]] * len(known) + term[real], return_counts=True)
            doc = pairs // len(known)
            some = np.flatnonzero(w.counts > 0)
            ends = np.append(0, np.searchsorted(doc, some, side="right"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)),
                    pa.array(w.counts[some], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs % len(known), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tf, pa.int64())),
                ],
                names=["key", "n", "terms", "tfs"],
            )

    return map_slices(docs, "text", f"key {key_type}, n long, terms array<int>, tfs array<long>", work)


def build_index(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index: ``m, keys, term, tf, ends, docs`` per stratum or piece of one.

    ``term[i], tf[i]`` is a run, its documents are ``docs[ends[i-1]:ends[i]]`` as places in
    ``keys``.  Documents are dealt out by ranges of ``m`` (a hash splits a crowded one), so a
    task's strata are dense.  Documents without any of the terms are not held: they score 0.
    """
    long = F.col("n").cast("decimal(20,0)") * LENGTH_PERCENT * F.lit(n_docs).cast("decimal(15,0)")
    m = F.lit(100 - LENGTH_PERCENT).cast("long") + F.call_function("div", long, F.lit(n_terms).cast("decimal(20,0)"))
    held = counted.where(F.size("terms") > 0).select("key", m.alias("m"), "terms", "tfs")
    dealt = held.repartitionByRange(partitions(counted.sparkSession), "m", F.xxhash64("key", "terms")).sortWithinPartitions("m")
    key_type = counted.schema["key"].dataType.simpleString()

    def stratum(m: int, rows: pa.Table) -> pa.RecordBatch:
        size = np.asarray(rows["terms"].combine_chunks().value_lengths())
        term = rows["terms"].combine_chunks().flatten().to_numpy()
        tf = rows["tfs"].combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), size)
        order = np.lexsort((doc, tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))

        def one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        keys = rows["key"].combine_chunks()
        keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        columns = [pa.array([m], pa.int64()), keys, one(term[first], pa.int32()), one(tf[first], pa.int64()), one(np.append(first[1:], len(doc)), pa.int32()), one(doc, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["m", "keys", "term", "tf", "ends", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        m, docs, postings = None, 0, 0
        for batch in batches:
            ms = batch.column(1).to_numpy()
            sizes = np.cumsum(batch.column(2).value_lengths().to_numpy())
            start = 0
            while start < batch.num_rows:
                if held and (ms[start] != m or docs >= ROW_DOCS or postings >= ROW_POSTINGS):
                    yield stratum(m, pa.Table.from_batches(held))
                    held, docs, postings = [], 0, 0
                m, before = ms[start], sizes[start - 1] if start else 0
                stop = min(np.searchsorted(ms, m, side="right"), start + ROW_DOCS - docs, np.searchsorted(sizes, before + ROW_POSTINGS - postings) + 1)
                stop = max(int(stop), start + 1)
                held.append(batch.slice(start, stop - start))
                docs, postings, start = docs + stop - start, postings + sizes[stop - 1] - before, stop
        if held:
            yield stratum(m, pa.Table.from_batches(held))

    return map_arrow(dealt, work, f"m long, keys array<{key_type}>, term array<int>, tf array<long>, ends array<int>, docs array<int>")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the ranges ``first[i]:last[i]``, one after the other."""
    n = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Shard:
    """Some strata in memory, runs ordered by term and stratum."""

    def __init__(self, rows: pa.Table, vocabulary: int):
        m = rows["m"].to_numpy()
        keys = rows["keys"].combine_chunks()
        self.keys = keys.flatten()
        self.sizes = keys.value_lengths().to_numpy().astype(np.int64)
        base = np.concatenate([[0], np.cumsum(self.sizes)])
        runs = rows["term"].combine_chunks().value_lengths().to_numpy()
        stratum = np.repeat(np.arange(len(m)), runs)
        term, tf, ends = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("term", "tf", "ends"))
        postings = rows["docs"].combine_chunks()
        lengths = postings.value_lengths().to_numpy().astype(np.int64)
        self.docs = postings.flatten().to_numpy() + np.repeat(base[:-1], lengths)
        starts = np.concatenate([[0], ends[:-1]])
        starts[np.concatenate([[0], np.cumsum(runs)[:-1]])] = 0
        before = (np.cumsum(lengths) - lengths)[stratum]
        starts, ends = starts + before, ends + before
        # One impact for each stratum and tf.
        most = int(tf.max()) + 1
        kinds, of = np.unique(stratum * most + tf, return_inverse=True)
        hit = impact(kinds % most, m[kinds // most])[of]
        order = np.lexsort((stratum, term))
        self.stratum, self.impact, self.starts, self.ends = stratum[order], hit[order], starts[order], ends[order]
        term = term[order]
        self.first = np.searchsorted(term, np.arange(vocabulary + 1))
        # The largest impact of each term in each stratum.
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(self.stratum, prepend=-1) != 0))
        self.top_stratum, self.top_impact = self.stratum[new], np.maximum.reduceat(self.impact, new)
        self.top_first = np.searchsorted(term[new], np.arange(vocabulary + 1))
        self.rank = np.empty(len(self.keys), np.int64)
        self.rank[pc.sort_indices(self.keys, null_placement="at_end").to_numpy()] = np.arange(len(self.keys))

    def best(self, terms: np.ndarray, weights: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` documents of at least ``least`` (ties by key) and their scores.

        Sums stay below 2**53, so adding in doubles is exact.
        """
        low, high = self.top_first[terms], self.top_first[terms + 1]
        at = _ranges(low, high)
        bound = np.bincount(self.top_stratum[at], weights=self.top_impact[at] * np.repeat(weights, high - low), minlength=len(self.sizes))
        order = np.argsort(-bound, kind="stable")
        low, high = self.first[terms], self.first[terms + 1]
        runs, weight = _ranges(low, high), np.repeat(weights, high - low)
        kept, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen, budget = 0, FIRST_VISIT
        while seen < len(order) and bound[order[seen]] >= max(least, 1):
            stop = seen + int(np.searchsorted(np.cumsum(self.sizes[order[seen:]]), budget)) + 1
            chosen = np.zeros(len(order), bool)
            visit = order[seen:stop]
            chosen[visit[bound[visit] >= max(least, 1)]] = True
            mine = chosen[self.stratum[runs]]
            run = runs[mine]
            first, last = self.starts[run], self.ends[run]
            total = np.bincount(self.docs[_ranges(first, last)], weights=np.repeat(self.impact[run] * weight[mine], last - first), minlength=len(self.keys))
            found = np.flatnonzero(total >= max(least, 1))
            kept, scores = np.concatenate([kept, found]), np.concatenate([scores, total[found].astype(np.int64)])
            if len(kept) > top:
                first_ones = np.lexsort((self.rank[kept], -scores))[:top]
                kept, scores = kept[first_ones], scores[first_ones]
            if len(kept) == top:
                least = max(least, int(scores.min()))
            seen, budget = stop, budget * GROWTH
        return kept, scores


def search_index(index: DataFrame, items, weights, top: int) -> DataFrame:
    """``item, key, score``: the best documents of each task's shards (``items``, ``weights`` broadcast)."""
    key_type = index.schema["keys"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = items.value, weights.value
        high = [np.zeros(0, np.int64)] * len(wanted.keys)  # the best scores of each item so far
        held: list[pa.RecordBatch] = []
        size = 0

        def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            shard = Shard(rows, len(wanted.vocabulary))
            item, doc, score = [], [], []
            for q in range(len(wanted.keys)):
                terms = wanted.terms[wanted.first[q] : wanted.first[q + 1]]
                least = int(high[q][0]) if len(high[q]) == top else 1
                kept, found = shard.best(terms, weight[terms], least, top)
                high[q] = np.sort(np.concatenate([high[q], found]))[-top:]
                item.append(np.full(len(kept), q))
                doc.append(kept)
                score.append(found)
            item, doc, score = (np.concatenate(x) for x in (item, doc, score))
            if len(item):
                columns = [pa.array(item, pa.int32()), shard.keys.take(pa.array(doc)), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "key", "score"])

        for batch in batches:
            for i, postings in enumerate(batch.column(5).value_lengths().to_numpy()):
                held.append(batch.slice(i, 1))
                size += postings
                if size >= SHARD_POSTINGS:
                    yield from search(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield from search(pa.Table.from_batches(held))

    return map_arrow(index, work, f"item int, key {key_type}, score long")


def search(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """``item_key, rank, key, score``: the ``top`` best documents of each item, ranked.

    Equal scores go by ascending ``key`` (NULL last).  Rows of ``benchmark`` with one key are one
    item with all their terms; items without terms, or whose terms no document holds, have no
    rows, like an empty table.  NULL texts have no terms.  Every row of ``documents`` is a
    document of its own, so repeated rows rank one after the other.  A text is counted whole.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = None
    for items in _blocks(benchmark, item_key, item_text):
        counted = staged(_counted(docs, share(spark, items.vocabulary)), "lexical-terms")
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weights = _weights(counted, len(items.vocabulary), n_docs)
        index = staged(build_index(counted, n_docs, n_terms), "lexical-index")
        found = search_index(index, share(spark, items), share(spark, weights), top)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        part = _named(spark, ranked, items.keys, benchmark.schema[item_key].dataType.simpleString())
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = benchmark.schema[item_key].dataType.simpleString(), docs.schema["key"].dataType.simpleString()
        out = spark.createDataFrame([], f"item {kinds[0]}, rank int, key {kinds[1]}, score long")
    return out.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def _weights(counted: DataFrame, vocabulary: int, n_docs: int) -> np.ndarray:
    """Each term's weight by the number of documents that hold it."""
    held = np.zeros(vocabulary, np.int64)
    # One row for each term of the block at most.
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        held[term] = df
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def _named(spark: SparkSession, ranked: DataFrame, keys: pa.Array, key_type: str) -> DataFrame:
    """The item's own key in place of its number."""
    sent = share(spark, keys)
    kind = ranked.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([sent.value.take(batch.column(0)), *batch.columns[1:]], names=["item", "rank", "key", "score"])

    return map_arrow(ranked.select("item", "rank", "key", "score"), work, f"item {key_type}, rank int, key {kind}, score long")
