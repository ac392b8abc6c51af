"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

1. Texts are coded chunk by chunk (a chunk is one slice of texts: its distinct word hashes and
   the texts as codes into them) and written once.
2. Chunks deal their distinct words and bigrams out by hash.  Each bucket sums the training counts
   and builds one segment of the filter from what training has met: an n-gram of level ``q`` (the
   logarithm of its count) is entered with every level from 1 to ``q``.  The segments are written;
   of the counts only those of single words go back to the chunks, for the base score.
3. The filter is the segments together.  It has no bound, so it is broadcast segment group by
   segment group, pass after pass: a pass sends at most ``GROUP_BYTES`` (or one segment) to the
   workers, which probe it with the n-grams of all texts, met in training or not, level after
   level until one is missing.
4. The score is a bigram probability smoothed towards the unigram one (Dirichlet prior), all
   counts as the filter gives them back.

There are about as many rows of a chunk and a bucket as the square of the input, so no Python runs
per such row: their binary columns are cut from, and read back as, one array per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.llm import words as W
from tensio.llm.batches import map_arrow, map_slices, partitions, stage_path, staged, text_buffer
from tensio.operators.partitioning import share

TENTHS = 10
#: Least count of a bigram that the model keeps: every bigram that training has met.
MIN_BIGRAM = 1
#: Counts are kept as powers of this base.
BASE = 1.25
HASHES = 4
#: Least filter bits per entered (n-gram, level), and a segment's least size in bits (its logarithm).
BITS_PER_ENTRY = 10
LEAST_LOG = 16
#: Segment bytes that one pass broadcasts, text bytes a bucket stands for at most (on average), and
#: buckets whose rows are written together.
GROUP_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
FOLDER_BUCKETS = 16
#: Weight of the unigram prior, in words.
PRIOR = 20.0
_START = np.uint64(0x53544152545F5F31)
_END = np.uint64(0x454E445F5F5F5F32)
_U = np.uint64


def _level_means() -> np.ndarray:
    """The mean of the counts of each level (0: not met); an empty level has its lower bound."""
    out = [0.0]
    for q in range(1, 180):
        low, high = np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


_MEANS = _level_means()


def _levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes (high planes are mostly zero)."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def _from_planes(blob: bytes, kind: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _sorted_planes(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=_U(0)))


def _from_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, np.uint64), dtype=np.uint64)


def _places_planes(values: np.ndarray) -> bytes:
    """Places that mostly grow, as steps (which wrap where they fall)."""
    return _planes(np.diff(values.astype(np.uint32), prepend=np.uint32(0)))


def _from_places(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, np.uint32), dtype=np.uint32)


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column whose rows are ``values[edges[i]:edges[i + 1]]``."""
    ends = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _uncut(columns: list[pa.Array], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of the binary columns, and their number per row (none where NULL)."""
    values, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for column in columns:
        _, ends, data = column.buffers()
        offsets = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if offsets[-1] > offsets[0]:
            values.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind))
        sizes.append(np.diff(offsets) // np.dtype(kind).itemsize)
    return np.concatenate(values), np.concatenate(sizes)


def _cut_small(values: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """Integers that are mostly small as two columns: a byte each, and those of 255 or more."""
    low = np.minimum(values, 255).astype(np.uint8)
    large = np.flatnonzero(low == 255)
    return [_cut(low, edges), _cut(values[large].astype(np.uint64), np.searchsorted(large, edges))]


def _uncut_small(low: list[pa.Array], large: list[pa.Array]) -> np.ndarray:
    values = _uncut(low, np.uint8)[0].astype(np.uint64)
    values[values == 255] = _uncut(large, np.uint64)[0]
    return values


_CHUNK = "chunk long, keys binary, held binary, counts binary, codes binary, hashes binary, times binary"


def _coded(df: DataFrame) -> DataFrame:
    """Chunks of ``df (__text, key, held)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            w = W.split(*text_buffer(batch.column(0)), lower=True)
            hashes, codes = np.unique(w.hashes(), return_inverse=True)
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            learnt = np.repeat(~held, w.counts)
            times = np.bincount(codes[learnt], minlength=len(hashes)).astype(np.uint32)
            sink = pa.BufferOutputStream()
            keys = pa.RecordBatch.from_arrays([batch.column(1)], names=["key"])
            with pa.ipc.new_stream(sink, keys.schema) as out:
                out.write_batch(keys)
            parts = [sink.getvalue().to_pybytes(), np.packbits(held).tobytes(), _planes(w.counts.astype(np.uint32)), _planes(codes.astype(np.uint32)), _sorted_planes(hashes), _planes(times)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), *[pa.array([p], pa.binary()) for p in parts]], names=[f.split()[0] for f in _CHUNK.split(", ")])
            chunk += 1

    return map_slices(df, "__text", _CHUNK, work)


def _sequences(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hashes of all texts, each with a start before it and an end after it, and their
    number per text."""
    n = len(counts)
    first = np.cumsum(counts) - counts
    heads = first + 2 * np.arange(n)
    line = np.empty(len(hashes) + 2 * n, np.uint64)
    line[np.arange(len(hashes)) + 2 * np.repeat(np.arange(n), counts) + 1] = hashes
    line[heads] = _START
    line[heads + counts + 1] = _END
    inner = np.ones(max(len(line) - 1, 0), bool)
    inner[heads[1:] - 1] = False
    return W.joined(line[:-1], line[1:])[inner], counts + 1


def _pairs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct bigrams, the place of each bigram among them, and their number per text.

    48 bits are enough for what only goes into the filter.
    """
    grams, each = _sequences(hashes, counts)
    distinct, at = np.unique(grams >> _U(16), return_inverse=True)
    return distinct, at, each


def _pair_times(hashes: np.ndarray, counts: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same distinct bigrams, and how often the learnt texts have each."""
    grams, each = _sequences(hashes, counts)
    marked = np.sort(grams >> _U(16) << _U(1) | np.repeat(learnt, each).astype(np.uint64))
    keys = marked >> _U(1)
    heads = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[heads], np.add.reduceat(marked & _U(1), heads)


_DEALT = "bucket int, chunk long, hashes binary, times binary, more_times binary, pairs binary, steps binary, more_steps binary, pair_times binary, more_pair_times binary"
_DEALT_NAMES = [f.split()[0] for f in _DEALT.split(", ")]


def _dealt(chunks: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's words and bigrams (48-bit hashes) of a bucket with their training counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hashes, times = _from_sorted(r["hashes"]), _from_planes(r["times"], np.uint32)
                counts = _from_planes(r["counts"], np.uint32).astype(np.int64)
                learnt = ~np.unpackbits(np.frombuffer(r["held"], np.uint8), count=len(counts)).astype(bool)
                pairs, met = _pair_times(hashes[_from_planes(r["codes"], np.uint32)], counts, learnt)
                edges = np.searchsorted(_buckets(hashes, buckets), np.arange(buckets + 1))
                ends = np.searchsorted(_buckets(pairs << _U(16), buckets), np.arange(buckets + 1))
                own = np.flatnonzero((np.diff(edges) > 0) | (np.diff(ends) > 0))
                edges, ends = np.append(edges[own], len(hashes)), np.append(ends[own], len(pairs))
                # The upper 16 bits grow slowly along a row: as steps, the first from 0.
                steps = np.diff(pairs >> _U(32), prepend=_U(0))
                heads = ends[:-1][np.diff(ends) > 0]
                steps[heads] = pairs[heads] >> _U(32)
                columns = [pa.array(own.astype(np.int32)), pa.array(np.full(len(own), r["chunk"])), _cut(hashes, edges), *_cut_small(times, edges)]
                columns += [_cut(pairs.astype(np.uint32), ends), *_cut_small(steps, ends), *_cut_small(met, ends)]
                yield pa.RecordBatch.from_arrays(columns, names=_DEALT_NAMES)

    return map_arrow(chunks, work, _DEALT)


_SUMMED = (
    "folder int, bucket int, bits binary, log int, total long, kinds long, "
    "chunks binary, word_counts binary, pair_counts binary, words binary, times binary, word_at binary, pairs binary, pair_at binary"
)


def _summed(dealt: DataFrame) -> DataFrame:
    """Per bucket: its segment of the filter and its figures; its chunks with the number of their
    words and bigrams; the distinct words and bigrams (48 bits of each are all that the filter asks),
    the words' exact corpus counts, and each chunk's places among them, chunk after chunk."""
    names = [f.split()[0] for f in _SUMMED.split(", ")]
    kinds = [*[pa.int32()] * 2, pa.binary(), pa.int32(), *[pa.int64()] * 2, *[pa.binary()] * 8]

    def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct, at = np.unique(keys, return_inverse=True)
        return distinct, at, np.bincount(at, times, len(distinct)).astype(np.int64)

    def bucket(b: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        of = dict(zip(_DEALT_NAMES, zip(*(r.columns for r in rows), strict=True), strict=True))
        hashes, word_counts = _uncut(of["hashes"], np.uint64)
        words, word_at, times = summed(hashes, _uncut_small(of["times"], of["more_times"]))
        low, pair_counts = _uncut(of["pairs"], np.uint32)
        steps = _uncut_small(of["steps"], of["more_steps"])
        high = np.cumsum(steps, dtype=np.uint64)
        heads = (np.cumsum(pair_counts) - pair_counts)[pair_counts > 0]
        high -= np.repeat(high[heads] - steps[heads], pair_counts[pair_counts > 0])
        grams, pair_at, met = summed(high << _U(32) | low, _uncut_small(of["pair_times"], of["more_pair_times"]))
        known, often = times > 0, met >= MIN_BIGRAM
        keys = np.concatenate([words[known] >> _U(16), grams[often]])
        levels = np.concatenate([_levels(times[known]), _levels(met[often])])
        log = segment_log(int(levels.sum()))
        chunks = np.concatenate([c.to_numpy() for c in of["chunk"]])
        out = [b // FOLDER_BUCKETS, b, segment(keys, levels, log).tobytes(), log, int(times.sum()), int(known.sum()), _planes(chunks.astype(np.int64))]
        out += [_planes(word_counts.astype(np.uint32)), _planes(pair_counts.astype(np.uint32)), _sorted_planes(words >> _U(16)), _planes(times)]
        out += [_places_planes(word_at), _sorted_planes(grams), _places_planes(pair_at)]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(out, kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of one bucket
        last = None
        for batch in batches:
            own = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if stop == start:
                    continue
                if held and last != own[start]:
                    yield bucket(last, held)
                    held = []
                last = int(own[start])
                held.append(batch.slice(start, stop - start))
        if held:
            yield bucket(last, held)

    ordered = dealt.repartition(partitions(dealt.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(ordered, work, _SUMMED)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside the ``with`` block drop their shuffle files at their end.  The written table needs
    them no more, and else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def filter_passes(segments: list[tuple[int, int]]) -> list[list[int]]:
    """Buckets of each pass, from ``(bucket, log)``: at most ``GROUP_BYTES`` of segments, or one."""
    out: list[list[int]] = []
    size = 0
    for b, log in sorted(segments):
        more = 1 << max(log - 3, 0)
        if not out or size + more > GROUP_BYTES or b // FOLDER_BUCKETS != out[-1][0] // FOLDER_BUCKETS:
            out.append([])
            size = 0
        out[-1].append(b)
        size += more
    return out


_PROBED = "bucket int, chunk long, times binary, more_times binary, levels binary, pairs binary"


def _probed(summed: DataFrame) -> DataFrame:
    """What the filter says of each chunk's words and bigrams, broadcast by segment groups, and the
    words' exact counts.

    Every pass is a job of its own, so no two groups are held at once; its rows are appended to
    one written table.
    """
    spark = summed.sparkSession
    segments = summed.select("folder", "bucket", "log", "bits")
    path = stage_path(spark, "probed")

    def probing(sent):
        names = [f.split()[0] for f in _PROBED.split(", ")]

        def bucket(r: dict) -> pa.RecordBatch:
            bits, log = sent.value[r["bucket"]]
            levels, pairs = (probe(bits, log, 1, _from_sorted(r[c])).astype(np.uint8) for c in ("words", "pairs"))
            chunks, word_at = _from_planes(r["chunks"], np.int64), _from_places(r["word_at"])
            edges, ends = (np.append(0, np.cumsum(_from_planes(r[c], np.uint32).astype(np.int64))) for c in ("word_counts", "pair_counts"))
            times = _from_planes(r["times"], np.int64)[word_at]
            columns = [pa.array(np.full(len(chunks), r["bucket"], np.int32)), pa.array(chunks), *_cut_small(times, edges)]
            columns += [_cut(levels[word_at], edges), _cut(pairs[_from_places(r["pair_at"])], ends)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield bucket(batch.slice(i, 1).to_pylist()[0])

        return work

    passes = filter_passes([tuple(r) for r in segments.select("bucket", "log").collect()])  # one row a bucket
    for buckets in passes:
        mine = (F.col("folder") == buckets[0] // FOLDER_BUCKETS) & F.col("bucket").between(buckets[0], buckets[-1])
        table = segments.where(mine).toArrow()  # at most GROUP_BYTES, or one segment
        group = {b: (np.frombuffer(bits, np.uint8), log) for b, log, bits in zip(*(table.column(c).to_pylist() for c in ("bucket", "log", "bits")), strict=True)}
        sent = share(spark, group)
        rows = summed.where(mine).drop("folder", "bits", "log", "total", "kinds")
        map_arrow(rows, probing(sent), _PROBED).write.mode("append").parquet(path)
        if hasattr(sent, "destroy"):
            sent.destroy()  # its file too: the segments together have no bound
    return spark.read.schema(_PROBED).parquet(path) if passes else spark.createDataFrame([], _PROBED)


def _places(keys: np.ndarray, level: int, log: int) -> Iterator[np.ndarray]:
    """Bits of a segment that stand for each key at this level."""
    mixed = W.mix(keys * _U(0x9E3779B97F4A7C15) + _U(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    step = (mixed >> _U(32)) | _U(1)
    for j in range(HASHES):
        yield ((mixed + step * _U(j)) & _U((1 << log) - 1)).astype(np.int64)


def segment_log(entries: int) -> int:
    """The bits of a segment with so many entries, as a power of two."""
    return max(LEAST_LOG, (max(entries, 1) * BITS_PER_ENTRY - 1).bit_length())


def segment(keys: np.ndarray, levels: np.ndarray, log: int) -> np.ndarray:
    """A bucket's part of the filter: every key entered with each level up to its own."""
    bits = np.zeros(1 << log, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _places(keys[levels >= q], q, log):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, log: int, buckets: int, keys: np.ndarray) -> np.ndarray:
    """The level of each 48-bit key: probe level after level until one is missing."""
    out = np.zeros(len(keys), np.int64)
    base = _buckets(keys << _U(16), buckets) << log
    live, q = np.arange(len(keys)), 1
    while len(live) and q < len(_MEANS):
        there = np.ones(len(live), bool)
        for at in _places(keys[live], q, log):
            at += base[live]
            there &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        live = live[there]
        out[live] = q
        q += 1
    return out


def with_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose crc32 of the id's text leaves a remainder modulo ``TENTHS`` (a NULL id
    is held out) and scores every row.  A text's tokens are its words and one end; NULL and
    empty texts are the end alone.  Repeated rows count and are scored each for itself.  If
    nothing is learnt, the base counts are 0 and every word is as likely as any other.
    """
    spark = df.sparkSession
    own = F.col(f"`{key}`")
    held = F.coalesce(F.crc32(own.cast("string").cast("binary")) % TENTHS == 0, F.lit(True))
    source = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"), own.alias("key"), held.alias("held"))
    kind = source.schema["key"].dataType.simpleString()
    size = source.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-int(size) // BUCKET_BYTES))
    chunks = staged(_coded(source), "chunks")
    path = stage_path(spark, "summed")
    with _shuffles_dropped(spark):
        _summed(_dealt(chunks, buckets)).write.partitionBy("folder").parquet(path)
    summed = spark.read.schema(_SUMMED).parquet(path)
    probed = _probed(summed)
    figures = summed.agg(F.sum("total"), F.sum("kinds")).first()
    words, kinds = (int(x or 0) for x in figures)
    texts = source.where("NOT held").count()  # each learnt text has one end
    tokens, kinds = words + texts, kinds + (texts > 0)
    mass = tokens + 0.1 * (kinds + 1)

    def score(row: dict, exact: np.ndarray, levels: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
        counts = _from_planes(row["counts"], np.uint32).astype(np.int64)
        codes = _from_planes(row["codes"], np.uint32).astype(np.int64)
        hashes = _from_sorted(row["hashes"])
        n, first = len(counts), np.cumsum(counts) - counts
        doc = np.repeat(np.arange(n), counts)
        known = np.bincount(doc, exact[codes] > 0, n).astype(np.int64) + (texts > 0)
        base = np.bincount(doc, np.log10((exact + 0.1) / mass)[codes], n) + np.log10((texts + 0.1) / mass)
        met = _MEANS[levels]
        # Before and after each word: the start and the end are met once in every learnt text.
        met = np.minimum(met, float(max(words, 1)))  # a level's mean may pass the total of a tiny corpus
        after = np.insert(met[codes], first + counts, float(texts))
        before = np.insert(met[codes], first, float(texts))
        _, at, each = _pairs(hashes[codes], counts)
        pair = np.minimum(_MEANS[pairs[at]], np.minimum(before, after))
        p = (pair + PRIOR * (after + 0.1) / mass) / (before + PRIOR)
        total = np.bincount(np.repeat(np.arange(n), each), np.log10(p), n)
        keys = pa.ipc.open_stream(row["keys"]).read_all().column("key").combine_chunks()
        flags = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=n).astype(bool)
        columns = [keys, pa.array(flags), pa.array(each), pa.array(known), pa.array(np.full(n, tokens)), pa.array(base), pa.array(total)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a chunk follow each other: the chunk first, then bucket by bucket its exact counts
        # and what the filter says.
        row, parts = None, []

        def done() -> pa.RecordBatch:
            times, more, levels, pairs = ([p.column(c) for p in parts] for c in ("times", "more_times", "levels", "pairs"))
            return score(row, _uncut_small(times, more).astype(np.float64), _uncut(levels, np.uint8)[0], _uncut(pairs, np.uint8)[0])

        for batch in batches:
            heads = np.flatnonzero(batch.column("bucket").to_numpy() < 0).tolist()
            if row is not None:
                parts.append(batch.slice(0, heads[0] if heads else batch.num_rows))
            for head, stop in zip(heads, [*heads, batch.num_rows][1:], strict=True):
                if row is not None:
                    yield done()
                row, parts = batch.slice(head, 1).to_pylist()[0], [batch.slice(head + 1, stop - head - 1)]
        if row is not None:
            yield done()

    empty = F.lit(None).cast("binary")
    nothing = {c: empty.alias(c) for c in ("keys", "held", "counts", "codes", "hashes", "times", "more_times", "levels", "pairs")}
    coded = chunks.select("chunk", F.lit(-1).alias("bucket"), *list(nothing)[:5], *list(nothing.values())[5:])
    found = probed.select("chunk", "bucket", *list(nothing.values())[:5], *list(nothing)[5:])
    both = coded.unionByName(found).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "bucket")
    fields = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return map_arrow(both, work, fields).withColumnRenamed("key", key)
