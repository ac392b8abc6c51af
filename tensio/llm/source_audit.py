"""How far the sources of a language differ in their words, by chunk factorization.

1. One pass counts the white-space chunks of each document and adds them up over a slice of
   documents: per language and chunk, its documents.
2. Each chunk that occurs anywhere is cut into terms once.  A term's documents are at most the
   sum of its chunks' documents, so most rare terms are out before anything is joined; the
   others' chunks are looked up through a bit map that may let others pass but loses none.
3. A term is kept if it is in ``min_docs`` documents of its language or more.  Its document count
   lies between the largest and the sum of its chunks' counts.  Only where these bounds leave
   it open are the documents themselves compared: no such chunk has ``min_docs`` documents,
   so the slices' lists of row numbers are short and complete.
4. A second pass counts the chunks of the remaining terms per source; the terms are joined back,
   which gives every source's occurrences of every kept term.
5. Shares of all kept terms are compared source by source in blocks of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.llm import words as W
from tensio.llm.batches import filled, map_arrow, partitions, ship_package, slices, staged, text_buffer
from tensio.operators.partitioning import share

MIN_DOCS = 30
TOP_TERMS = 50
#: Added to each count, and the scale of a share.
PSEUDO = 5
SCALE = 1_000_000_000
#: Terms a block (about) and sources a tile: what one task holds at once.
BLOCK_TERMS = 1024
TILE = 256
#: Text bytes counted together.
COUNT_BYTES = 32 << 20
#: Size of a bit map (its logarithm); a fuller map lets more through, which is settled later.
MAP_LOG = 26

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64


def _chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Chunks of each document with their counts: ``(document, chunk number, count)`` and the chunks."""
    lists = pc.ascii_split_whitespace(filled(texts))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")  # white space at an end of a text leaves an empty chunk there
    chunks = flat.filter(real).dictionary_encode()
    codes, k = chunks.indices.to_numpy().astype(np.int64), max(len(chunks.dictionary), 1)
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())[real.to_numpy(zero_copy_only=False)]
    pairs, counts = np.unique(doc * k + codes, return_counts=True)
    return pairs // k, pairs % k, counts, chunks.dictionary


def _counts_of(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (below ``size``) and how often each occurs."""
    if size > 1 << 24:
        return np.unique(keys, return_counts=True)
    times = np.bincount(keys, minlength=size)
    met = np.flatnonzero(times)
    return met, times[met]


def _count_documents(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents of a slice that hold each chunk, by language."""
    langs = filled(batch.column(1)).dictionary_encode()
    doc, codes, _, chunks = _chunks_of(batch.column(3))
    k = max(len(chunks), 1)
    key, docs = _counts_of(langs.indices.to_numpy().astype(np.int64)[doc] * k + codes, k * max(len(langs.dictionary), 1))
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // k)), chunks.take(pa.array(key % k)), pa.array(docs, pa.int64())], names=["lang", "chunk", "docs"])


_SLICE_FIELDS = "lang string, source string, chunk string, occurrences long, rows array<long>"


def _string_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings (those of a few bytes' difference differ as surely as any)."""
    data, offsets = text_buffer(values)
    w = W.Words(data, offsets, offsets[:-1], offsets[1:], offsets)
    return w.hashes() if len(values) else np.zeros(0, np.uint64)


def _pair_hashes(langs: pa.Array, lang_of: np.ndarray, chunks: pa.Array, chunk_of: np.ndarray) -> np.ndarray:
    codes = np.array([zlib.crc32(x.encode()) for x in langs.to_pylist()], np.uint64)
    return W.mix(_string_hashes(chunks)[chunk_of] ^ (codes[lang_of] * _U(0x9E3779B97F4A7C15)))


def _bits_of(hashes: np.ndarray) -> np.ndarray:
    """The two bits of the map that stand for each hash."""
    mask = _U((1 << MAP_LOG) - 1)
    return np.stack([hashes & mask, hashes >> _U(64 - MAP_LOG)], axis=-1).astype(np.int64)


def _in_map(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits_of(hashes)
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).all(axis=-1)


def _bit_map(bits: DataFrame) -> np.ndarray:
    """The map of all places in column ``bit``: at most 2**(MAP_LOG - 5) words reach the driver."""
    word = F.floor(F.col("bit") / 32).cast("int")
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(32)).cast("int"))
    out = np.zeros(1 << (MAP_LOG - 5), np.uint32)
    table = bits.groupBy(word.alias("word")).agg(F.bit_or(value).alias("value")).toArrow()
    out[table["word"].to_numpy()] = table["value"].to_numpy().astype(np.uint32)
    return out


def _count_slice(batch: pa.RecordBatch, min_docs: int, wanted: np.ndarray, unsure: np.ndarray) -> pa.RecordBatch:
    """Occurrences of a slice by language, source and chunk, for chunks in the map ``wanted``; for those
    in ``unsure`` the row numbers too, where they are few."""
    rows = batch.column(0).to_numpy()
    langs, sources = (filled(batch.column(i)).dictionary_encode() for i in (1, 2))
    width = max(len(sources.dictionary), 1)
    lang = langs.indices.to_numpy().astype(np.int64)
    group = lang * width + sources.indices.to_numpy()
    doc, codes, counts, chunks = _chunks_of(batch.column(3))
    k = max(len(chunks), 1)
    kinds, _ = _counts_of(lang[doc] * k + codes, k * max(len(langs.dictionary), 1))
    hashes = _pair_hashes(langs.dictionary, kinds // k, chunks, kinds % k)
    there = _in_map(wanted, hashes)
    kinds, is_open = kinds[there], _in_map(unsure, hashes[there])
    at = np.searchsorted(kinds, lang[doc] * k + codes)
    at[at == len(kinds)] = 0
    keep = kinds[at] == lang[doc] * k + codes if len(kinds) else np.zeros(len(doc), bool)
    doc, codes, counts, is_open = doc[keep], codes[keep], counts[keep], is_open[at[keep]] if len(kinds) else at[keep].astype(bool)
    # One sort by (group, chunk, document), with the count and the flag in the low bits where they fit.
    key, n = group[doc] * k + codes, max(len(rows), 1)
    low = int(counts.max(initial=1)).bit_length()
    if (int(key.max(initial=0)) * n + n).bit_length() + low + 1 < 63:
        packed = np.sort((((key * n + doc) << low) | counts) << 1 | is_open)
        is_open, counts, both = (packed & 1).astype(bool), packed >> 1 & ((1 << low) - 1), packed >> (low + 1)
        key, doc = both // n, both % n
    else:
        order = np.lexsort((doc, key))
        key, doc, counts, is_open = key[order], doc[order], counts[order], is_open[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(first, append=len(key))
    few = is_open[first] & (size < min_docs) if len(first) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(np.where(few, size, 0))])
    at, which = key[first] % k, key[first] // k
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(which // width)),
            sources.dictionary.take(pa.array(which % width)),
            chunks.take(pa.array(at)),
            pa.array(np.add.reduceat(counts, first) if len(first) else counts[:0], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows[doc[np.repeat(few, size)]], pa.int64())),
        ],
        names=["lang", "source", "chunk", "occurrences", "rows"],
    )


def _by_slice(numbered: DataFrame, count, fields: str) -> DataFrame:
    """``count`` of slices of ``row, lang, source, text``, several Arrow batches together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, "text", COUNT_BYTES):
            held.append(batch)
            size += batch.column(3).nbytes
            if size >= COUNT_BYTES:
                yield count(_joined(held))
                held, size = [], 0
        if held:
            yield count(_joined(held))

    return map_arrow(numbered, work, fields)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def with_terms(chunks: DataFrame) -> DataFrame:
    """The columns of a table of distinct ``chunk``, and ``terms``: its distinct terms and how often it
    holds them.  Chunks without a term go."""
    rest = [c for c in chunks.columns if c != "chunk"]
    found = F.array_sort(F.call_function("regexp_extract_all", F.translate("chunk", _UPPER, _LOWER), F.lit(_TERM), F.lit(0)))
    out = chunks.select("chunk", *rest, found.alias("found")).where(F.size("found") > 0)
    # Equal terms stand together once sorted: a run's length is how often the chunk holds the term.
    starts = F.filter(F.sequence(F.lit(0), F.size("found") - 1), lambda i: (i == 0) | (F.get("found", i) != F.get("found", i - 1)))
    out = out.select("chunk", *rest, "found", starts.alias("starts"))
    runs = F.transform("starts", lambda b, j: F.struct(F.get("found", b).alias("term"), (F.coalesce(F.get("starts", j + 1), F.size("found")) - b).cast("long").alias("times")))
    return out.select("chunk", *rest, runs.alias("terms"))


def _candidates(numbered: DataFrame, min_docs: int) -> DataFrame:
    """``lang, chunk, term, times, low, high``: the chunks of every term that may be kept, with the bounds
    of the term's documents."""
    spark = numbered.sparkSession
    counted = _by_slice(numbered, _count_documents, "lang string, chunk string, docs long")
    # Dealt by chunk, so a chunk's languages meet in one task and it is cut into terms there.
    sums = counted.repartition(partitions(spark), "chunk").groupBy("chunk", "lang").agg(F.sum("docs").alias("docs"))
    chunks = sums.groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs"))  # one entry a language
    terms = staged(with_terms(chunks), "chunk-terms")
    held = terms.select("chunk", "terms", F.explode("langs").alias("l")).select("chunk", F.col("l.lang").alias("lang"), F.col("l.docs").alias("docs"), F.explode("terms").alias("t"))
    held = held.select("lang", "chunk", "docs", F.col("t.term").alias("term"), F.col("t.times").alias("times"), F.xxhash64("lang", "t.term").alias("code"))
    # Sums by hash are sums of one term or more, so none that may be kept is lost here.
    likely = held.groupBy("code").agg(F.sum("docs").alias("high")).where(F.col("high") >= min_docs).select("code")
    mask = (1 << MAP_LOG) - 1
    places = F.array(F.col("code").bitwiseAND(mask), F.shiftrightunsigned("code", 64 - MAP_LOG))
    words = share(spark, _bit_map(likely.select(F.explode(places).alias("bit"))))

    @F.arrow_udf(TY.BooleanType())
    def may_stay(code: pa.Array) -> pa.Array:
        return pa.array(_in_map(words.value, code.to_numpy(zero_copy_only=False).view(np.uint64)))

    left = staged(held.where(may_stay("code")).drop("code"), "likely-terms")
    bounds = left.groupBy("lang", "term").agg(F.max("docs").alias("low"), F.sum("docs").alias("high")).where(F.col("high") >= min_docs)
    return staged(left.drop("docs").join(bounds, ["lang", "term"]), "likely-chunks")


def _counted_again(numbered: DataFrame, candidates: DataFrame, min_docs: int) -> DataFrame:
    """The second pass: slices' counts by source of the chunks of ``candidates`` (and a few others)."""
    spark = numbered.sparkSession

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, chunks = (batch.column(i).dictionary_encode() for i in (0, 1))
            hashes = _pair_hashes(langs.dictionary, langs.indices.to_numpy(), chunks.dictionary, chunks.indices.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(_bits_of(hashes).ravel())], names=["bit"])

    wanted = share(spark, _bit_map(map_arrow(candidates.select("lang", "chunk"), places, "bit long")))
    unsure = share(spark, _bit_map(map_arrow(candidates.where(F.col("low") < min_docs).select("lang", "chunk"), places, "bit long")))
    return _by_slice(numbered, lambda batch: _count_slice(batch, min_docs, wanted.value, unsure.value), _SLICE_FIELDS)


def _kept_terms(by_slice: DataFrame, candidates: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term`` of the terms in ``min_docs`` documents of the language or more."""
    sure = candidates.where(F.col("low") >= min_docs).select("lang", "term").distinct()
    in_question = candidates.where(F.col("low") < min_docs).select("lang", "chunk", "term")
    listed = by_slice.where(F.size("rows") > 0).select("lang", "chunk", "rows")
    met = listed.join(in_question, ["lang", "chunk"]).select("lang", "term", F.explode("rows").alias("row")).distinct()
    enough = met.groupBy("lang", "term").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return sure.unionByName(enough.select("lang", "term"))


def _share(count: Column | str, total: str = "total", kept: str = "kept") -> Column:
    """1 + floor(SCALE * (count + PSEUDO) / (total + PSEUDO * kept)) in exact integers."""
    count = F.col(count) if isinstance(count, str) else count
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PSEUDO).cast("decimal(20,0)")
    below = (F.col(total) + PSEUDO * F.col(kept)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _pair_sums(counts: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, a, b, value``: summed differences of all kept terms for sources ``a < b`` by number.

    ``counts``: ``lang, source, term, count``; ``groups``: ``lang, source, number, sources, total,
    kept``; ``kept``: ``lang, term``.  A task gets one block of terms for two tiles of sources, whose
    empty cells have the share of a count of 0; terms that none of them holds are only counted.
    """
    ship_package(counts.sparkSession)
    blocks = F.ceil(F.col("kept") / BLOCK_TERMS).cast("int")
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    own = F.floor(F.col("number") / TILE).cast("int")
    base = groups.where("kept > 0").withColumns({"blocks": blocks, "tiles": tiles, "tile": own, "zero": _share(F.lit(0).cast("long"))})
    used = counts.join(base, ["lang", "source"])
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    nothing = F.lit(None).cast("long").alias("terms")
    cells = used.select("lang", block, "number", "tile", "tiles", "term", _share("count").alias("share"), nothing)
    sizes = kept.join(base.select("lang", "blocks").distinct(), "lang").groupBy("lang", block).agg(F.count("*").alias("terms"))
    empty = base.select("lang", "number", "tile", "tiles", F.lit(None).cast("string").alias("term"), F.col("zero").alias("share")).join(sizes, "lang")
    rows = cells.unionByName(empty).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "number", "tile", "term", "share", "terms")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, left, right = (k.as_py() for k in key)
        zero = table.filter(pc.is_null(table["term"]))
        number = zero["number"].to_numpy()
        order = np.argsort(number)
        number, tile, share = number[order], zero["tile"].to_numpy()[order], zero["share"].to_numpy()[order]
        full = table.filter(pc.is_valid(table["term"]))
        term = full["term"].combine_chunks().dictionary_encode()
        grid = np.repeat(share[:, None], len(term.dictionary), axis=1)
        grid[np.searchsorted(number, full["number"].to_numpy()), term.indices.to_numpy()] = full["share"].to_numpy()
        unseen = zero["terms"][0].as_py() - len(term.dictionary)
        a, b, value = [], [], []
        for i in np.flatnonzero(tile == left):
            others = np.flatnonzero((tile == right) & (number > number[i]))
            a.append(np.full(len(others), number[i]))
            b.append(number[others])
            value.append(np.abs(grid[others] - grid[i]).sum(axis=1) + unseen * np.abs(share[others] - share[i]))
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value)]
        return pa.table({"lang": pa.array([lang] * len(columns[0]), pa.string()), "a": pa.array(columns[0], pa.int32()), "b": pa.array(columns[1], pa.int32()), "value": pa.array(columns[2], pa.int64())})

    parts = rows.groupBy("lang", "block", "left", "right").applyInArrow(compare, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language stands out.

    Part ``pair``: ``item`` is every other source of the language, ``value`` the summed absolute
    difference of the two sources' shares over all kept terms (0 if none is kept).  Part
    ``term``: ``item`` is a kept term that the source holds and uses more than its language does,
    ``value`` the difference; the ``top`` largest.  Ranks go by falling value, then by item.

    NULL texts, languages and sources count as empty strings; a text without terms still makes
    its source appear.  Every row is a document of its own, repeated or not.  Empty table: no
    rows.  Other columns do not matter.  A text is worked on whole; a single chunk of any
    length is one row.
    """
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(value(lang).alias("lang"), value(source).alias("source"), value(text).alias("text"))
    # The written table fixes the row numbers: a task that runs again before that reads the same
    # rows in the same order.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "lang", "source", "text")
    candidates = _candidates(numbered, min_docs)
    by_slice = staged(_counted_again(numbered, candidates, min_docs), "chunk-slices")
    kept = staged(_kept_terms(by_slice, candidates, min_docs), "kept-terms")
    # Dealt by what the terms are joined on, so the sums need no exchange of their own.
    dealt = by_slice.select("lang", "source", "chunk", "occurrences").repartition(partitions(df.sparkSession), "lang", "chunk")
    sums = dealt.groupBy("lang", "source", "chunk").agg(F.sum("occurrences").alias("occurrences"))
    terms = candidates.join(kept, ["lang", "term"], "left_semi").select("lang", "chunk", "term", "times")
    counted = sums.join(terms, ["lang", "chunk"]).groupBy("lang", "source", "term").agg(F.sum(F.col("occurrences") * F.col("times")).alias("count"))
    counts = staged(counted, "term-counts")

    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    of_lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("number"), F.count("*").over(of_lang).alias("sources")
    )
    groups = staged(groups, "source-groups")

    sums_of_pairs = _pair_sums(counts, groups, kept)
    one = groups.select("lang", "source", F.col("number").alias("n"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("m"))
    pairs = one.join(other, "lang").where("n <> m").select("lang", "source", "item", F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b"))
    pairs = pairs.join(sums_of_pairs, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("kept").alias("kept"))
    usual = counts.groupBy("lang", "term").agg(F.sum("count").alias("count")).join(whole, "lang").select("lang", "term", _share("count").alias("usual"))
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("count").alias("share"))
    above = shares.join(usual, ["lang", "term"]).where("share > usual")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    words = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("usual")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ordered)).unionByName(words)
