"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

The fingerprint of a text is taken over the XXH64 (seed 42) of its shingles.  Fingerprints
link at ``distance`` or fewer differing bits.  They are cut into 8 blocks of 8 bits; two that
differ in at most ``d <= 2`` bits agree in at least 6 blocks, so each fingerprint is
dealt out under its 28 choices of 6 blocks and only members of one choice are compared.  48
bits are then fixed, so a group holds at most 2**16 distinct fingerprints whatever the
data; copies collapse to one fingerprint before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.llm import words as W
from tensio.llm.batches import map_arrow, map_slices, partitions, staged, text_buffer
from tensio.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
BLOCKS = 8

_U = np.uint64
#: For a byte, its 8 bits as 8 one-byte lanes of a 64-bit value.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
#: The bits that are free (not compared) under each choice of agreeing blocks.
_FREE = [sum(0xFF << (8 * b) for b in pair) for pair in combinations(range(BLOCKS), MAX_BITS)]
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _popcount(x: np.ndarray) -> np.ndarray:
    return _POP[x.view(np.uint16).reshape(-1, 4)].sum(axis=1)


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle and the shingle count of every text."""
    w = W.split(data, offsets, lower=True)
    word = ~W.is_space(w.data)
    after = np.zeros(len(word) + 1, bool)
    after[w.ends] = True
    kept = word | after[:-1]  # the words and one byte after each
    place = np.concatenate([[0], np.cumsum(kept)])
    joined = np.where(word, w.data, np.uint8(32))[kept]
    counts = w.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    index = np.repeat(w.first[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    last = index + np.repeat(np.minimum(counts, size), n) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    # A word that ends its text without a space is followed at once by the next text's first
    # word; no shingle reaches over that place.
    pairs = zip(place[w.starts[index]].tolist(), place[w.ends[last]].tolist(), strict=True)
    return np.fromiter((digest(raw[a:b], SEED) for a, b in pairs), np.uint64, len(index)), n


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of every text; a bit is 1 if set in over half of the shingle hashes."""
    h, n = _shingle_hashes(data, offsets, size)
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    # Runs of at most 255 shingles, so that one-byte lanes cannot overflow.
    runs = -(-n // 255)
    first = np.cumsum(n) - n
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    filled = np.flatnonzero(n)
    of_text = (np.cumsum(runs) - runs)[filled]
    octets = h.view(np.uint8).reshape(-1, 8)
    for i in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, i]], at)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
        bits = (2 * ones > n[filled, None]).astype(np.uint64)
        out[filled] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << _U(8 * i)
    return out


def with_fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's bits as a signed long)."""
    source = df.select(F.col(f"`{text}`").cast("string").alias("__text"), F.col(f"`{key}`").alias("key"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(*text_buffer(batch.column(0)), size)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found.view(np.int64))], names=["key", "fp"])

    return map_slices(source, "__text", f"key {source.schema['key'].dataType.simpleString()}, fp long", work)


def _forest(fp: np.ndarray, free: int, most: int) -> np.ndarray:
    """For each of these fingerprints (equal outside ``free``), a smaller member of its component.

    Two differ in at most ``most`` bits if they are equal once some ``most`` of the free bits are
    cleared.  Every such clearing groups the members, and each group takes its smallest label.
    """
    bits = [1 << i for i in range(64) if free >> i & 1]
    clear = [_U(~sum(c) & 0xFFFFFFFFFFFFFFFF) for c in combinations(bits, most)]
    label, before = np.arange(len(fp)), None
    groups = []
    for c in clear:
        masked = fp & c
        order = np.argsort(masked, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], masked[order][1:] != masked[order][:-1]]))
        if len(starts) < len(fp):
            groups.append((order, starts, np.diff(starts, append=len(fp))))
    while before is None or (label != before).any():
        before = label.copy()
        for order, starts, sizes in groups:
            label[order] = np.repeat(np.minimum.reduceat(label[order], starts), sizes)
    return label


def _links(choice: np.ndarray, block: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints of one group that are within ``most`` bits; the rows come
    ordered by group, and every group is whole."""
    new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (block[1:] != block[:-1])])
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(fp))
    left, right = [], []
    few = np.flatnonzero((sizes > 1) & (sizes <= 8))
    for gap in range(1, 8):
        groups = few[sizes[few] > gap]
        if not len(groups):
            break
        n = sizes[groups] - gap
        i = np.repeat(starts[groups], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = _popcount(fp[i] ^ fp[i + gap]) <= most
        left.append(fp[i[near]])
        right.append(fp[i[near] + gap])
    for g in np.flatnonzero(sizes > 8):
        members = fp[starts[g] : starts[g] + sizes[g]]
        label = _forest(members, _FREE[int(choice[starts[g]])], most)
        moved = label != np.arange(len(members))
        left.append(members[moved])
        right.append(members[label[moved]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def links(distinct: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within ``most <= 2`` bits.

    ``distinct`` has one row per fingerprint (column ``fp``).  In a block group every pair is
    joined by links within that group, either directly or through a smaller member, so
    no pair is lost and a group of ``g`` members gives at most ``7 g`` links.
    """
    if not 0 <= most <= MAX_BITS:
        raise ValueError(f"blocks are laid out for at most {MAX_BITS} differing bits")
    signed = [f - (1 << 64) if f >> 63 else f for f in (~m & 0xFFFFFFFFFFFFFFFF for m in _FREE)]
    dealt = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "block")
    spark = distinct.sparkSession
    groups = distinct.select("fp", dealt).repartition(partitions(spark), "choice", "block").sortWithinPartitions("choice", "block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            a, b = _links(rows[0], rows[1], rows[2].view(np.uint64), most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("choice", "block", "fp"), strict=True)]
            cut = len(rows[0])
            if cut:  # the last group may go on in the next batch
                same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
                cut = int(np.argmax(same))
            if cut:
                yield from out([r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
        if len(held[0]):
            yield from out(held)

    return map_arrow(groups.select("choice", "block", "fp"), run, "a long, b long")


def _rooted(found: DataFrame, most: int) -> DataFrame:
    """``(fp, low, root)``: each fingerprint's smallest key and its component, from ``(key, fp)``."""
    distinct = staged(found.groupBy("fp").agg(F.min("key").alias("low")), "distinct")
    roots = connected_components(links(distinct.select("fp"), most))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """Per row: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest
    key that is reachable over links, the row's own included.

    NULL and wordless texts have fingerprint zero and link like any other; a text of
    fewer words than a shingle is one shingle.  Repeated rows stay; a NULL key takes part but
    is never a smallest key unless it is alone.
    """
    found = staged(with_fingerprint(df, key, text, size), "fingerprints")
    rooted = _rooted(found, most)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    out = found.join(named, "fp")
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay: of each component one row, that with the smallest key.

    Of rows that share that key in one component the first by a hash of the text stays, and of
    rows that share both key and text one.  A row goes only if another row of its own component
    stays, whatever other rows have its key.  All columns are kept.  Rows with a NULL key are
    their component's last choice.
    """
    own, code = F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`").cast("string"))
    row = F.struct(own.isNull().alias("none"), own.alias("key"), code.alias("code"))
    found = with_fingerprint(df.select(row.alias("row"), F.col(f"`{text}`").alias("text")), "row", "text", size)
    rooted = _rooted(found, most)
    chosen = rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias("__chosen"), F.col("low.code").alias("__code"))
    kept = df.join(chosen, own.eqNullSafe(F.col("__chosen")) & (code == F.col("__code")), "left_semi")
    first = kept.groupBy(own.alias("__key"), code.alias("__code")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"))
    return first.select(*[F.col(f"__row.`{c}`") for c in df.columns])
