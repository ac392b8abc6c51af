"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Each task packs its own pieces by best fit, longest first, and emits the bins that are
nearly full.  What is left underfull goes on as items of a tree of merge rounds: every round
deals the underfull bins to fewer tasks, which best-fit them into one another.  No round
brings more than ``GROUP_BINS`` bins into one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.llm.batches import map_arrow, map_slices, staged
from tensio.llm.token_ids import encoder

CAPACITY = 1024
#: A bin with at most this much room left is nearly full and is emitted.
SLACK = 4
#: Pieces that one local packing takes at once.
LOCAL_PIECES = 1 << 18
#: Underfull bins that one task of a merge round takes at most, and tasks whose bins meet in one.
GROUP_BINS = 100_000
FAN_IN = 8
#: Merge rounds end once a round over several tasks saves less than this share of its bins.
LEAST_SAVED = 0.01


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each item, longest first into the fullest bin it fits.

    Bins are kept by the room they have left; a bit mask of the rooms in use gives the smallest
    room that is large enough.
    """
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            which = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, which = capacity, count
            count += 1
        bins[i], places[i] = which, capacity - room
        left = room - size
        if left:
            by_room[left].append(which)
            mask |= 1 << left
    return bins, places


@dataclass
class Members:
    """Pieces with the place that each has in its bin; ``first[b]:first[b+1]`` is bin ``b``."""

    first: np.ndarray
    key: pa.Array
    numbers: dict[str, np.ndarray]

    def batch(self, tag: int) -> pa.RecordBatch:
        used = np.add.reduceat(self.numbers["length"], self.first[:-1]) if len(self.first) > 1 else np.zeros(0, np.int64)
        fields = [self.key, *[pa.array(v) for v in self.numbers.values()]]
        inner = pa.StructArray.from_arrays(fields, ["key", *self.numbers])
        lists = pa.ListArray.from_arrays(pa.array(self.first.astype(np.int32)), inner)
        ids = tag + np.arange(len(used))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(CAPACITY - used <= SLACK), pa.array(used), lists], names=["bin", "done", "used", "members"])


def _grouped(bins: np.ndarray, places: np.ndarray, key: pa.Array, numbers: dict[str, np.ndarray]) -> Members:
    order = np.lexsort((places, bins))
    ordered = bins[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    numbers = {c: v[order] for c, v in numbers.items()} | {"offset": places[order]}
    return Members(np.append(first, len(order)), key.take(pa.array(order)), numbers)


_NUMBERS = ["piece", "start", "length", "crc"]


def _schema(kind: str) -> str:
    inner = ", ".join([f"key: {kind}", *[f"{c}: bigint" for c in _NUMBERS], "offset: bigint"])
    return f"bin long, done boolean, used long, members array<struct<{inner}>>"


def _tag(level: int) -> int:
    """The first bin number of this task; numbers of different tasks and rounds differ."""
    from pyspark import TaskContext

    return (level << 56) + (TaskContext.get().partitionId() << 32)


def _cut(ids: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of at most ``CAPACITY`` ids; only the first of a text may be shorter."""
    n = -(-counts // CAPACITY)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    head = counts - (n - 1) * CAPACITY
    length = np.where(piece == 0, head[doc], CAPACITY)
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * CAPACITY)
    begin = (np.cumsum(counts) - counts)[doc] + start
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), length.tolist(), strict=True)]
    return {"doc": doc, "piece": piece, "start": start, "length": length, "crc": np.array(crc, np.int64)}


def _local(df: DataFrame, tokenizer_path: str, end_id: int, key: str, text: str) -> DataFrame:
    source = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"), F.col(f"`{key}`").alias("key"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tag, held, waiting = None, None, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal tag, held, waiting
            numbers = {c: np.concatenate([x[c] for _, x in held]) for c in _NUMBERS}
            keys = pa.concat_arrays([k for k, _ in held])
            found = _grouped(*best_fit(numbers["length"], CAPACITY), keys, numbers).batch(tag)
            tag, held, waiting = tag + found.num_rows, [], 0
            for at in range(0, found.num_rows, 20_000):
                yield found.slice(at, 20_000)

        for batch in batches:
            if coder is None:
                coder, tag = encoder(tokenizer_path), _tag(0)
            ids, counts = coder.encode(batch.column(0))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            pieces = _cut(ids, counts + 1)
            keys = batch.column(1).take(pa.array(pieces.pop("doc")))
            held.append((keys, pieces))
            waiting += len(keys)
            if waiting >= LOCAL_PIECES:
                yield from packed()
        if held:
            yield from packed()

    return map_slices(source, "__text", _schema(source.schema["key"].dataType.simpleString()), work)


def _merged(bins: DataFrame, level: int, tasks: int) -> DataFrame:
    """Best-fit whole underfull bins into one another, within each of ``tasks`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Bins of one task are bounded by GROUP_BINS, their members by the capacity.
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        used = table.column("used").to_numpy().astype(np.int64)
        which, places = best_fit(used, CAPACITY)
        members = table.column("members").combine_chunks()
        inner = members.flatten()
        sizes = np.diff(members.offsets.to_numpy())
        numbers = {c: inner.field(c).to_numpy() for c in _NUMBERS}
        inside = inner.field("offset").to_numpy() + np.repeat(places, sizes)
        found = _grouped(np.repeat(which, sizes), inside, inner.field("key"), numbers).batch(_tag(level))
        for at in range(0, found.num_rows, 20_000):
            yield found.slice(at, 20_000)

    kind = bins.schema["members"].dataType.elementType["key"].dataType.simpleString()
    return map_arrow(bins.repartition(tasks), run, _schema(kind))


def pack(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    A text's ids, then ``end_id``, stay whole up to ``CAPACITY`` ids; longer ones are cut.  Pieces
    lie in their sequence without gaps from 0.  NULL and empty texts are the end id alone.
    Repeated rows are packed each for itself; an empty table gives no rows.  Every round
    is written to the shared folder once, so a lost executor repeats only its own tasks.
    """
    level = 0
    found = staged(_local(df, tokenizer_path, end_id, key, text), "packed")
    rounds = [found.where("done")]
    open_bins = found.where("NOT done")
    waiting = open_bins.count()
    tasks = max(1, open_bins.rdd.getNumPartitions())
    while waiting:
        tasks = max(-(-tasks // FAN_IN), -(-waiting // GROUP_BINS))
        level += 1
        found = staged(_merged(open_bins, level, tasks), "packed")
        rounds.append(found.where("done"))
        open_bins = found.where("NOT done")
        left, saved = open_bins.count(), waiting - found.count()
        if tasks == 1 or (tasks * GROUP_BINS <= 2 * waiting and saved < LEAST_SAVED * waiting):
            break
        waiting = left
    rounds.append(open_bins)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    m = F.explode("members").alias("m")
    return out.select(F.col("bin").alias("sequence_id"), m).select(
        F.col("m.key").alias(key),
        F.col("m.piece").cast("int").alias("piece"),
        F.col("m.start").alias("start"),
        F.col("m.length").alias("length"),
        F.col("m.crc").alias("ids_crc32"),
        "sequence_id",
        F.col("m.offset").alias("offset"),
    )
