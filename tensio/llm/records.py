"""Token ids as length-delimited binary records with an offset index.

A data file is a run of records: length (8 bytes, little-endian), masked CRC-32C of those 8
bytes (4 bytes), payload, masked CRC-32C of the payload (4 bytes).  A payload is a document's
ids as little-endian unsigned integers, 2 bytes each where the vocabulary allows it, else 4.
The index is a separate Parquet table with a row per record (file, key, byte offset, payload
length), so a reader can take records in any order with one ranged read each.

Tasks write a file under a name of their own (a retried task writes another) and name it in
their index rows; only files that the committed index names count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wn
from pyspark.sql import functions as F

from tensio.llm.batches import map_arrow, partitions, slices, staged
from tensio.llm.token_ids import encoder

_POLY = 0x82F63B78
#: Most bytes that one ranged read takes at once (a longer record is read whole).
READ_BYTES = 8 << 20
#: Payloads are checksummed in blocks of ``2**_BLOCK_LOG`` bytes, all blocks of a batch together.
_BLOCK_LOG = 9


def _one_byte() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> np.uint32(1) ^ np.uint32(_POLY), c >> np.uint32(1))
    return c


_T = _one_byte()


def _move(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    low = np.uint32(0xFF)
    parts = [tables[p][register >> np.uint32(8 * p) & low] for p in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def _moves() -> list[np.ndarray]:
    """Tables that move a CRC register over 1, 2, 4, ... zero bytes."""
    value = np.arange(256, dtype=np.uint32)
    one = np.array([(value << np.uint32(8 * p)) >> np.uint32(8) ^ (_T if p == 0 else np.uint32(0)) for p in range(4)])
    out = [one]
    while len(out) < 40:
        out.append(np.array([_move(out[-1], out[-1][p]) for p in range(4)]))
    return out


_MOVES = _moves()


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each ``data[offsets[i]:offsets[i+1]]``.

    Zero bytes in front leave an empty register empty, so records are cut into equal blocks
    from their ends and all blocks step through the table together; block results then
    fold from left to right, and the initial all-ones register is moved over each length.
    """
    sizes = np.diff(offsets)
    size = 1 << _BLOCK_LOG
    blocks = np.maximum(-(-sizes // size), 1)
    first = np.cumsum(blocks) - blocks
    room = np.zeros(int(blocks.sum()) * size, np.uint8)
    place = (first + blocks) * size - sizes - offsets[:-1]
    room[np.arange(len(data)) + np.repeat(place, sizes)] = data
    columns = np.ascontiguousarray(room.reshape(-1, size).T)
    register = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        register = register >> np.uint32(8) ^ _T[(register ^ column) & np.uint32(0xFF)]
    out = register[first]
    for k in range(1, int(blocks.max(initial=1))):
        more = np.flatnonzero(blocks > k)
        out[more] = _move(_MOVES[_BLOCK_LOG], out[more]) ^ register[first[more] + k]
    start, left, k = np.full(len(sizes), 0xFFFFFFFF, np.uint32), sizes.copy(), 0
    while left.any():
        odd = (left & 1).astype(bool)
        start[odd] = _move(_MOVES[k], start[odd])
        left >>= 1
        k += 1
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as stored: rotated by 15 bits, plus a constant of the format."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def frame(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The records of a batch."""
    sizes = np.diff(offsets)
    heads = sizes.astype("<u8").view(np.uint8)
    head_crc = masked(crc32c(heads, np.arange(len(sizes) + 1) * 8)).astype("<u4").tobytes()
    body_crc = masked(crc32c(payload, offsets)).astype("<u4").tobytes()
    head, body = heads.tobytes(), payload.tobytes()
    edges = offsets.tolist()
    return [b"".join((head[8 * i : 8 * i + 8], head_crc[4 * i : 4 * i + 4], body[edges[i] : edges[i + 1]], body_crc[4 * i : 4 * i + 4])) for i in range(len(sizes))]


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a Hadoop-style path and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pa.fs.FileSystem.from_uri(path)


def write_records(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Write every text's ids and ``end_id`` below ``folder`` and return the written offset index
    ``(shard int, file string, key, offset long, size long, width int)``.

    Rows are dealt to ``files`` ranges of the key and written in key order (repeated keys by
    text, NULL keys first); ``shard`` counts the ranges.  ``folder`` must be storage that driver and
    executors share.  NULL and empty texts give a record of the end id only; an empty
    table gives an empty index and no file.
    """
    spark = df.sparkSession
    files = files or partitions(spark)
    source = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    source = source.repartitionByRange(files, "key", F.xxhash64("__text")).sortWithinPartitions("key", "__text")
    data, index = f"{folder}/data", f"{folder}/index"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{data}/part-{shard:06d}-{uuid.uuid4().hex}.rec"
        stream, at, coder, width = None, 0, None, 0
        for batch in slices(batches, "__text"):
            if stream is None:
                store, place = _store(name)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                stream, coder = store.open_output_stream(place), encoder(tokenizer_path)
                width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            ids, counts = coder.encode(batch.column(1))
            edges = np.concatenate([[0], np.cumsum(counts)])
            ids = np.insert(ids, edges[1:], np.uint32(end_id)).astype(f"<u{width}")
            edges = (edges + np.arange(len(edges))) * width
            framed = frame(ids.view(np.uint8), edges)
            stream.write(b"".join(framed))
            ends = at + np.cumsum([len(r) for r in framed])
            n = len(framed)
            columns = [pa.array([shard] * n, pa.int32()), pa.array([name] * n), batch.column(0), pa.array(np.concatenate([[at], ends[:-1]])), pa.array(np.diff(edges)), pa.array([width] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "file", "key", "offset", "size", "width"])
            at = int(ends[-1])
        if stream is not None:
            stream.close()

    kind = source.schema["key"].dataType.simpleString()
    written = map_arrow(source, run, f"shard int, file string, key {kind}, offset long, size long, width int")
    written.write.parquet(index)
    return spark.read.schema(written.schema).parquet(index)


def read_records(index: DataFrame) -> DataFrame:
    """``(shard, key, offset, ids binary)``: the payloads of the indexed records as little-endian
    unsigned 32-bit ids; a wrong length or checksum raises.

    Records that lie side by side are fetched with one ranged read of bounded size.
    """
    spark = index.sparkSession
    rows = index.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "offset")

    def fetch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files = batch.column("file").to_pylist()
        offset, size, width = (batch.column(c).to_numpy().astype(np.int64) for c in ("offset", "size", "width"))
        ends = offset + size + 16
        start = 0
        while start < len(files):
            stop = start + 1
            while stop < len(files) and files[stop] == files[start] and offset[stop] == ends[stop - 1] and width[stop] == width[start] and ends[stop] - offset[start] <= READ_BYTES:
                stop += 1
            store, place = _store(files[start])
            with store.open_input_file(place) as f:
                raw = np.frombuffer(f.read_at(int(ends[stop - 1] - offset[start]), int(offset[start])), np.uint8)
            base, sizes = offset[start:stop] - offset[start], size[start:stop]
            edges = np.concatenate([[0], np.cumsum(sizes)])

            def cut(shift: int, length: np.ndarray, raw: np.ndarray = raw, base: np.ndarray = base) -> np.ndarray:
                begin = np.cumsum(length) - length
                return raw[np.arange(length.sum()) + np.repeat(base + shift - begin, length)]

            n = stop - start
            eight, four = np.full(n, 8), np.full(n, 4)
            heads = cut(0, eight)
            body = cut(12, sizes)
            tails = cut(0, four, base=base + 12 + sizes)
            good = (heads.view("<u8") == sizes) & (cut(8, four).view("<u4") == masked(crc32c(heads, np.arange(n + 1) * 8))) & (tails.view("<u4") == masked(crc32c(body, edges)))
            if not good.all():
                raise OSError(f"damaged record in {files[start]} at byte {int(offset[start:stop][~good][0])}")
            w = int(width[start])
            ids = body.view(f"<u{w}").astype("<u4")
            ends32 = pa.py_buffer((edges // w * 4).astype(np.int32))
            payload = pa.Array.from_buffers(pa.binary(), n, [None, ends32, pa.py_buffer(ids.tobytes())])
            part = batch.slice(start, n)
            yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("key"), part.column("offset"), payload], names=["shard", "key", "offset", "ids"])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fetch(batch)

    kind = index.schema["key"].dataType.simpleString()
    return map_arrow(rows, run, f"shard int, key {kind}, offset long, ids binary")


def with_start(read: DataFrame) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of records read back, in file order.

    Counts run within a file's range and are shifted by the totals of the ranges before it,
    one number per file.
    """
    counted = staged(read.select("shard", "key", "offset", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "counted")
    totals = counted.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Wn.orderBy("shard")) - F.col("total")).alias("before"))
    inner = F.sum("n_tokens").over(Wn.partitionBy("shard").orderBy("offset")) - F.col("n_tokens")
    return counted.withColumn("inner", inner).join(before, "shard").select("key", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
