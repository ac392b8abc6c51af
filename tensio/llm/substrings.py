"""Substring deduplication: drop the words of every word window that starts twice in the corpus.

1. Each task counts marker n-grams of its texts in a count-min sketch of saturating counters; the
   sketches are merged block by block.  A window's marker is the leftmost smallest hash
   among its inner n-grams, so it follows from the window's words alone, and two starts of
   one window have their markers at two places: the marker's count is never below the window's.
2. Windows whose marker is estimated to occur once are unique.  Only the others are dealt out by
   their 96-bit hash and counted exactly; those that turn out to occur once are
   sent back to their text.
3. Each text drops the words covered by the windows that remain.

The sketch has a fixed largest size.  Fuller than that it lets more unique windows through to
the exact count; it never loses a repeated one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.llm import words as W
from tensio.llm.batches import map_arrow, map_slices, partitions, staged, text_buffer
from tensio.operators.partitioning import share

WINDOW = 35
#: Words of a marker n-gram; a window holds WINDOW - MARKER + 1 = 16 of them.
MARKER = 20
ROWS = 2
#: Counters of a sketch row: a power of two between these, about CELLS_PER_BYTE per text byte.
LEAST_LOG = 16
MOST_LOG = 27
CELLS_PER_BYTE = 0.08
_BLOCK_LOG = 16
#: Windows that a task gathers before it sends them on.
GATHER = 2_000_000
_U = np.uint64


def _sliding_low(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` values from each position (beyond the end: the largest value)."""
    have, out = 1, values
    while have < n:
        by = min(have, n - have)
        moved = np.full_like(out, np.iinfo(out.dtype).max)
        moved[: max(len(out) - by, 0)] = out[by:]
        out = np.minimum(out, moved)
        have += by
    return out


def _windows(w: W.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all whole windows, the place of each one's marker, and all n-gram hashes."""
    starts = np.flatnonzero(w.room() >= WINDOW)
    grams = W.ngrams(h, MARKER)
    # The upper hash bits decide, then the place: the leftmost of equals.
    ranked = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    low = _sliding_low(ranked, WINDOW - MARKER + 1)[starts]
    return starts, (low & _U(0xFFFFFFFF)).astype(np.int64), grams


def _cells(hashes: np.ndarray, log: int) -> list[np.ndarray]:
    """A marker's counter in each row."""
    mixed = W.mix(hashes ^ _U(0x5851F42D4C957F2D))
    width = _U((1 << log) - 1)
    return [((mixed >> _U(32 * r)) & width).astype(np.int64) for r in range(ROWS)]


def _sketch_log(df: DataFrame, text: str) -> int:
    """Sketch size from the bytes of all texts, within the fixed bounds."""
    total = df.select(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    return int(min(max(np.ceil(np.log2(max(total * CELLS_PER_BYTE, 1))), LEAST_LOG), MOST_LOG))


def _sketch(df: DataFrame, log: int) -> list[np.ndarray]:
    """Bit maps (one per row) of the counters that reach two."""
    block = min(_BLOCK_LOG + max(0, log - 22), log)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for batch in batches:
            if cells is None:
                cells = np.zeros((ROWS, 1 << log), np.uint8)
            w = W.split(*text_buffer(batch.column(0)))
            starts, place, grams = _windows(w, w.hashes())
            if len(starts):
                markers = grams[place[np.concatenate([[True], place[1:] != place[:-1]])]]
                for row, at in zip(cells, _cells(markers, log), strict=True):
                    at = np.sort(at)
                    new = np.concatenate([[True], at[1:] != at[:-1]])
                    times = np.diff(np.append(np.flatnonzero(new), len(at)))
                    row[at[new]] = np.minimum(row[at[new]] + np.minimum(times, 2), 2)
        if cells is not None:
            pack = zstandard.ZstdCompressor(level=1)
            parts = cells.reshape(ROWS, -1, 1 << block)
            for r in range(ROWS):
                for b in range(parts.shape[1]):
                    four = parts[r, b].reshape(-1, 4)
                    packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
                    if packed.any():
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([pack.compress(packed.tobytes())], pa.binary())], names=["row", "block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Holds the blocks dealt to this task, whatever the number of sketches.
        held: dict[tuple[int, int], np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r, b, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                packed = np.frombuffer(unpack.decompress(blob), np.uint8)
                one, two = packed & 0x55, packed >> 1 & 0x55
                if (r, b) not in held:
                    held[r, b] = np.zeros((2, len(packed)), np.uint8)
                seen = held[r, b]
                seen[1] |= two | one & seen[0]
                seen[0] |= one | two
        for (r, b), seen in held.items():
            two = seen[1]
            bits = np.stack([two & 1, two >> 2 & 1, two >> 4 & 1, two >> 6 & 1], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["row", "block", "bits"])

    schema = "row int, block int, {} binary"
    counted = map_slices(df, "__text", schema.format("cells"), count)
    merged = map_arrow(counted.repartition(partitions(df.sparkSession), "row", "block"), add, schema.format("bits"))
    maps = [np.zeros(1 << (log - 3), np.uint8) for _ in range(ROWS)]
    step = 1 << (block - 3)
    # At most ROWS * 2**(MOST_LOG - 3) bytes in all.
    for r, b, bits in merged.collect():
        maps[r][b * step : (b + 1) * step] = np.frombuffer(bits, np.uint8)
    return maps


def _suspects(w: W.Words, h: np.ndarray, maps: list[np.ndarray], log: int) -> np.ndarray:
    """Starts of the windows whose marker is estimated to occur twice or more."""
    starts, place, grams = _windows(w, h)
    if not len(starts):
        return starts
    new = np.concatenate([[True], place[1:] != place[:-1]])
    twice = np.ones(int(new.sum()), bool)
    for bits, at in zip(maps, _cells(grams[place[new]], log), strict=True):
        twice &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return starts[twice[np.cumsum(new) - 1]]


_BLOB = "bucket int, high binary, low binary, twice binary, owner binary, place binary, keys binary, hashes binary"


def _once(df: DataFrame, maps, log: int, buckets: int, kind: str) -> DataFrame:
    """``(key, th, at)``: windows sent to the exact count that occur only once in the corpus.

    ``df`` has ``__text, key, th``.  Each task first merges equal windows of its own texts, so a
    window of a third of all texts costs one entry per task; entries travel as packed arrays.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        held, waiting = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            high, low, owner, place = (np.concatenate([x[i] for x in held]) for i in range(4))
            keys, hashes = pa.concat_arrays([x[4] for x in held]), np.concatenate([x[5] for x in held])
            held, waiting = [], 0
            order = np.lexsort((low, high))
            new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
            at = np.flatnonzero(new)
            twice = np.diff(np.append(at, len(order))) > 1
            first = order[at]
            bucket = (high[first] >> _U(32)).astype(np.int64) * buckets >> 32
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                part, flag = first[edges[b] : edges[b + 1]], twice[edges[b] : edges[b + 1]]
                if not len(part):
                    continue
                walk = np.argsort(part, kind="stable")  # in text order owners and places compress well
                part, flag = part[walk], flag[walk]
                whose, inverse = np.unique(owner[part], return_inverse=True)
                blob = [high[part], low[part].astype(np.uint32), np.packbits(flag), inverse.astype(np.uint32), np.diff(place[part], prepend=0).astype(np.int32)]
                sink = pa.BufferOutputStream()
                names = pa.RecordBatch.from_arrays([keys.take(pa.array(whose))], names=["key"])
                with pa.ipc.new_stream(sink, names.schema) as out:
                    out.write_batch(names)
                parts = [pack.compress(x.tobytes()) for x in blob] + [pack.compress(sink.getvalue().to_pybytes()), pack.compress(hashes[whose].tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], names=[f.split()[0] for f in _BLOB.split(", ")])

        texts = 0
        for batch in batches:
            w = W.split(*text_buffer(batch.column(0)))
            h = w.hashes()
            at = _suspects(w, h, maps.value, log)
            if len(at):
                doc = w.doc[at]
                low = W.ngrams(w.hashes(1), WINDOW)[at] & _U(0xFFFFFFFF)
                held.append((W.ngrams(h, WINDOW)[at], low, texts + doc, at - w.first[doc], batch.column(1), batch.column(2).to_numpy().astype(np.int64)))
                texts += batch.num_rows
                waiting += len(at)
            if waiting >= GATHER:
                yield from sent()
                texts = 0
        if held:
            yield from sent()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [unpack.decompress(x) for x in row[1:]]
                high, low = np.frombuffer(parts[0], np.uint64), np.frombuffer(parts[1], np.uint32)
                flag = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=len(high)).astype(bool)
                owner, place = np.frombuffer(parts[3], np.uint32), np.cumsum(np.frombuffer(parts[4], np.int32))
                by_bucket.setdefault(row[0], []).append((high, low, flag, owner, place, parts[5], np.frombuffer(parts[6], np.int64)))
        while by_bucket:
            _, blobs = by_bucket.popitem()
            high, low, flag = (np.concatenate([x[i] for x in blobs]) for i in range(3))
            order = np.lexsort((low, high))
            same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
            lone = ~flag[order]
            lone[1:] &= ~same
            lone[:-1] &= ~same
            single = np.zeros(len(order), bool)
            single[order[lone]] = True
            start = 0
            for blob in blobs:
                mine = np.flatnonzero(single[start : start + len(blob[0])])
                start += len(blob[0])
                if len(mine):
                    keys = pa.ipc.open_stream(blob[5]).read_all().column("key").combine_chunks()
                    whose = blob[3][mine]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(whose)), pa.array(blob[6][whose]), pa.array(blob[4][mine].astype(np.int32))], names=["key", "th", "at"])

    spark = df.sparkSession
    sent = map_slices(df, "__text", _BLOB, gather)
    return map_arrow(sent.repartition(partitions(spark), "bucket"), judge, f"key {kind}, th long, at int")


def drop_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, names: tuple[str, str, str] = ("kept_text", "n_words", "n_removed")) -> DataFrame:
    """All columns of ``df``, ``text`` only if asked for, and (under ``names``) the kept text, its
    words joined by one space, the number of words and of removed words.

    Windows are judged on the input.  NULL, empty and short texts have no window and keep their
    words; of repeated rows every window repeats, so all of them lose those words.  Columns of the input named like a result are left out.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in (text, *names)]
    named = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    own_key = F.col(f"c{rest.index(key)}")
    source = named.select("__text", own_key.alias("key"), F.xxhash64("__text").alias("th"))
    kind = source.schema["key"].dataType.simpleString()
    log = _sketch_log(source, "__text")
    maps = share(spark, _sketch(source.select("__text"), log))
    once = staged(_once(source, maps, log, 4 * partitions(spark), kind), "once")
    unique = once.groupBy(F.col("key").alias("__key"), F.col("th").alias("__hash")).agg(F.collect_list("at").alias("__once"))
    same = (F.xxhash64("__text") == F.col("__hash")) & own_key.eqNullSafe(F.col("__key"))
    judged = named.join(unique, same, "left")
    carried = [f"c{i}" for i in range(len(rest))]
    judged = judged.select("__text", "__once", *carried)
    fields = ", ".join([*[f"{c} {named.schema[c].dataType.simpleString()}" for c in carried], *(["__own string"] if keep_text else []), "kept_text string, n_words long, n_removed long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = W.split(*text_buffer(batch.column(0)))
            flagged = np.zeros(len(w.starts), bool)
            flagged[_suspects(w, w.hashes(), maps.value, log)] = True
            lists = batch.column(1)
            lone = lists.flatten().to_numpy().astype(np.int64)
            many = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            flagged[np.repeat(w.first[:-1], many) + lone] = False
            gone = W.covered(flagged, WINDOW)
            kept, ends = _rebuilt(w, ~gone)
            texts = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept))
            own = [batch.column(0)] if keep_text else []
            columns = [*batch.columns[2:], *own, texts, pa.array(w.counts), pa.array(W.by_doc(gone, w.first))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[2:], *["__own"] * keep_text, "kept_text", "n_words", "n_removed"])

    out = map_slices(judged, "__text", fields, work)
    own = [F.col("__own").alias(text)] if keep_text else []
    return out.select(*[F.col(c).alias(name) for c, name in zip(carried, rest, strict=True)], *own, *[F.col(c).alias(name) for c, name in zip(("kept_text", "n_words", "n_removed"), names, strict=True)])


def _rebuilt(w: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every text joined by one space, as bytes and text ends."""
    starts, sizes = w.starts[keep], (w.ends - w.starts)[keep]
    doc = w.doc[keep]
    counts = np.bincount(doc, minlength=len(w.counts))
    lead = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(doc) else np.zeros(0, bool)
    size = sizes + lead
    total = np.cumsum(size)
    out = np.full(int(total[-1]) if len(total) else 0, 32, np.uint8)
    begin = total - sizes
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(begin, sizes) + at] = w.data[np.repeat(starts, sizes) + at]
    ends = np.concatenate([[0], np.concatenate([[0], total])[np.cumsum(counts)]])
    return out, ends
