"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages.

Words are runs of ASCII letters and digits and of characters beyond ASCII, Latin-1 lower-cased.
Benchmark items are cut into passages of at most ``PASSAGE`` words that overlap, so that a copy of
the least share of a passage lies whole in one wherever it begins.  A passage's seeds are
its 3-word n-grams that are rare: going by how often their words occur in the corpus, they would
hardly meet by chance (how often the n-gram itself occurs does not matter, so an item that has
leaked into thousands of texts keeps its seeds).  Wherever a text has a seed, the words
around it are aligned with the passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensio.llm import words as W
from tensio.llm.batches import map_slices, text_buffer
from tensio.operators.partitioning import share

SEED = 3
#: Most chance meetings of a rare seed's words per corpus word.
RARE = 1e-8
#: Seeds that every passage keeps, its rarest ones, even if none is rare.
LEAST_SEEDS = 4
PASSAGE = 96
#: Passages of a longer item begin this often in the length of one.
SHIFTS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score, as a share of a verbatim copy's.
LEAST_SCORE = 0.6
#: Benchmark text that is sent to the tasks at once; a larger benchmark goes block by block.
BLOCK_BYTES = 16 << 20
#: Alignment cells of one batch.
CELLS = 1 << 21
_U = np.uint64


@dataclass
class Passages:
    """Benchmark passages of one block: word hashes, and the seeds sorted by hash."""

    words: np.ndarray
    first: np.ndarray
    item: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    @classmethod
    def cut(cls, texts: pa.Array) -> Passages:
        w = W.split(*text_buffer(texts), lower=True, letters=True)
        n = w.counts
        parts = -(-n // PASSAGE)
        cuts = np.where(parts > 1, SHIFTS * (parts - 1) + 1, parts)
        item = np.repeat(np.arange(len(n)), cuts)
        k = np.arange(len(item)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        width = np.where(parts[item] > 1, SHIFTS, 1)
        begin, end = (x * n[item] // (width * parts[item]) for x in (k, k + width))
        first = np.append(0, np.cumsum(end - begin))
        index = np.repeat(w.first[:-1][item] + begin - first[:-1], end - begin) + np.arange(first[-1])
        return cls(w.hashes()[index], first, item)

    def seeds(self, vocabulary: np.ndarray, share_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, passage and place of each seed, ordered by hash."""
        sizes, n = self.sizes, len(self.words)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(n) - np.repeat(self.first[:-1], sizes)
        whole = np.flatnonzero(place + SEED <= sizes[owner])
        chance = share_of[np.searchsorted(vocabulary, self.words)]
        meet = np.ones(len(whole))
        for i in range(SEED):
            meet *= chance[whole + i]
        order = np.lexsort((meet, owner[whole]))
        own = owner[whole][order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        chosen = whole[order[(meet[order] <= RARE) | (rank < LEAST_SEEDS)]]
        hashes = W.ngrams(self.words, SEED)[chosen]
        by_hash = np.argsort(hashes, kind="stable")
        return hashes[by_hash], owner[chosen][by_hash], place[chosen][by_hash]


def _word_shares(df: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each of these words is met per word of the corpus."""
    known = share(df.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        maybe = np.zeros(1 << 20, bool)
        maybe[words >> _U(44)] = True
        seen, total = np.zeros(len(words), np.int64), 0
        for batch in batches:
            h = W.split(*text_buffer(batch.column(0)), lower=True, letters=True).hashes()
            total += len(h)
            h = h[maybe[h >> _U(44)]]
            if len(words):
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                seen += np.bincount(at[words[at] == h], minlength=len(words))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], names=["word", "n"])

    counted = map_slices(df, "__text", "word long, n long", count).groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most one row per benchmark word of the block
    out = np.zeros(len(vocabulary))
    total = 1
    for word, n in counted:
        if word < 0:
            total = max(n, 1)
        else:
            out[word] = n
    return out / total


def align(item: np.ndarray, item_sizes: np.ndarray, text: np.ndarray, text_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair of rows and the column after its last word.

    Rows are padded word hashes.  Row by row of the item, all pairs and columns at once; the gap
    along a row is a running maximum of the scores less their columns.
    """
    pairs, width = text.shape
    slope = np.arange(width + 1) * -GAP
    inside = np.arange(width) < text_sizes[:, None]
    score = np.zeros((pairs, width + 1), np.int32)
    best, end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    for i in range(item.shape[1]):
        live = i < item_sizes
        step = np.where(inside & (text == item[:, i : i + 1]), MATCH, MISMATCH)
        row = np.maximum(score + GAP, 0)
        np.maximum(row[:, 1:], score[:, :-1] + step, out=row[:, 1:])
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        score = np.where(live[:, None], row, score).astype(np.int32)
        top = score.argmax(axis=1)
        high = score[np.arange(pairs), top]
        better = high > best
        best[better], end[better] = high[better], top[better]
    return best, end


def _candidates(w: W.Words, h: np.ndarray, passages: Passages, seeds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Passage, and first and last word, of every stretch of text that has a seed of the passage."""
    hashes, owner, place = seeds
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(h):
        return none, none, none
    maybe = np.zeros(1 << 20, bool)
    maybe[hashes >> _U(44)] = True
    grams = W.ngrams(h, SEED)
    at = np.flatnonzero(maybe[grams >> _U(44)] & (w.room() >= SEED))
    low, high = np.searchsorted(hashes, grams[at]), np.searchsorted(hashes, grams[at], side="right")
    n = high - low
    which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    passage = owner[which]
    size = passages.sizes[passage]
    slack = 4 + size // 4
    doc = w.doc[at]
    begin = at - place[which]
    # Seeds of one copy lie on about the same diagonal: one stretch for each step of the slack.
    step = (begin - w.first[doc]) // slack
    _, one = np.unique(np.column_stack([doc, passage, step]), axis=0, return_index=True)
    passage, begin, size, slack, doc = passage[one], begin[one], size[one], slack[one], doc[one]
    return passage, np.maximum(begin - 2 * slack, w.first[doc]), np.minimum(begin + size + 2 * slack, w.first[doc + 1])


def _scores(h: np.ndarray, passages: Passages, passage: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, stop = np.zeros(len(passage)), np.zeros(len(passage), np.int64)
    sizes, widths = passages.sizes[passage], end - begin
    order = np.argsort(widths, kind="stable")
    start = 0
    while start < len(order):
        upto = start + 1
        while upto < len(order) and (upto - start + 1) * int(widths[order[upto]]) <= CELLS // 64:
            upto += 1
        rows = order[start:upto]

        def padded(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
            index = at[:, None] + np.arange(int(n.max()))
            return np.where(index < (at + n)[:, None], values[np.minimum(index, len(values) - 1)], _U(0))

        best, last = align(padded(passages.words, passages.first[passage[rows]], sizes[rows]), sizes[rows], padded(h, begin[rows], widths[rows]), widths[rows])
        out[rows] = best / (MATCH * sizes[rows])
        stop[rows] = begin[rows] + last
        start = upto
    return out, stop


def _words_of(item_text: str) -> Column:
    return F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit(""))


def _blocks(documents: DataFrame, benchmark: DataFrame, item_text: str) -> Iterator[tuple]:
    """For each block of the benchmark: passages, seeds and the hashes of the item texts, ready to be
    sent to tasks.  Each distinct item text is sent once, however many items have it.

    ``documents`` has the column ``__text``.
    """
    items = benchmark.select(_words_of(item_text).alias("words")).distinct().withColumn("item", F.xxhash64("words"))
    # The words of an item of several passages are sent up to SHIFTS times; it has over 2 * PASSAGE bytes.
    bytes_sent = F.octet_length("words") * F.when(F.octet_length("words") > 2 * PASSAGE, SHIFTS).otherwise(1)
    size = items.agg(F.sum(bytes_sent + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod("item", F.lit(blocks)) == block)
        table = part.toArrow().combine_chunks()  # about BLOCK_BYTES
        if not table.num_rows:
            continue
        passages = Passages.cut(table.column("words").combine_chunks())
        vocabulary = np.unique(passages.words)
        if len(vocabulary):
            seeds = passages.seeds(vocabulary, _word_shares(documents.select("__text"), vocabulary))
            yield passages.words, passages.first, passages.item, seeds, table.column("item").combine_chunks()


def _matches(texts: pa.Array, block: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, item, score and end of every copy in a batch, one for each text and item."""
    words, first, item, seeds, _ = block
    passages = Passages(words, first, item)
    w = W.split(*text_buffer(texts), lower=True, letters=True)
    h = w.hashes()
    passage, begin, end = _candidates(w, h, passages, seeds)
    score, stop = _scores(h, passages, passage, begin, end)
    good = score >= least
    doc = np.searchsorted(w.first, begin[good], side="right") - 1
    whose, score, stop = item[passage[good]], score[good], stop[good] - w.first[doc]
    order = np.lexsort((stop, -score, whose, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (whose[order][1:] != whose[order][:-1])
    top = order[new]
    return doc[top], whose[top], score[top], stop[top]


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE
) -> DataFrame:
    """``key, item_id, score, end_word``: rows of ``documents`` that hold a copy of an item.

    ``score`` is the best alignment of one of the item's passages as a share of a verbatim
    copy's, ``end_word`` the place in the text (in words) where it ends.  One row per text and
    item.  Items of fewer words than a seed, NULL and empty texts match nothing; repeated
    items and rows are found each for itself.
    """
    spark = documents.sparkSession
    source = documents.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"), F.col(f"`{key}`").alias("key"))
    fields = f"key {source.schema['key'].dataType.simpleString()}, code long, score double, end_word long"
    out = None
    for block in _blocks(source, benchmark, item_text):
        sent = share(spark, block)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, item, score, stop = _matches(batch.column(0), sent.value, least)
                columns = [batch.column(1).take(pa.array(doc)), sent.value[4].take(pa.array(item)), pa.array(score), pa.array(stop)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "code", "score", "end_word"])

        found = map_slices(source, "__text", fields, work)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], fields)
    items = benchmark.select(F.xxhash64(_words_of(item_text)).alias("code"), F.col(f"`{item_key}`").alias("item"))
    return out.join(items, "code").select(F.col("key").alias(key), F.col("item").alias(item_key), "score", "end_word")


def without_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``documents``, all columns, whose text holds no copy of an item.

    The same search as ``find_leaks``; each row is judged by its own text where it is read, so
    nothing is joined or shuffled.
    """
    spark, columns = documents.sparkSession, documents.columns
    out = documents.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c != text])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    for block in _blocks(out, benchmark, item_text):
        sent = share(spark, block)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[_matches(batch.column(0), sent.value, least)[0]] = False
                yield batch.filter(pa.array(clean))

        out = map_slices(out, "__text", fields, work)
    return out.select(*[F.col("__text" if c == text else f"c{i}").alias(c) for i, c in enumerate(columns)])
