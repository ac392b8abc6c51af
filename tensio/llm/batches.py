"""Helpers around Arrow batches and staged tables, shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.session import ensure_checkpoint_dir, ship_package

#: Text bytes that one numpy pass works on; a longer single text is worked on whole.
SLICE_BYTES = 6 << 20


def filled(column: pa.Array) -> pa.Array:
    """The string column with NULL as the empty text."""
    return pc.fill_null(column, "") if column.null_count else column


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their ``n + 1`` offsets (NULL counts as empty)."""
    column = filled(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(df: DataFrame, text: str, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` whose function gets slices of bounded text size, one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(slices(batches, text))

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_results(df: DataFrame, text: str, keep: list[str], results: str, start: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``keep`` columns of ``df`` and the columns ``results`` (as a schema) computed from ``text``.

    ``start`` is called once per task and gives the function of a slice of texts.  Kept
    columns pass through under neutral names, so any name will do; those named like a
    result are left out.
    """
    names = [f.split()[0] for f in results.split(", ")]
    keep = [c for c in keep if c not in names]
    source = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    carried = [f.name for f in source.schema.fields[1:]]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]], results])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            compute = compute or start()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *compute(batch.column(0))], names=[*carried, *names])

    out = map_slices(source, "__text", schema, work)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *names)


def bounded_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` rows, the same ones on every run: the first by a hash of ``columns``.

    On a large table a cut on the hash leaves about twice as many rows before they are
    ordered, so tasks hand on a few rows each, however many tasks there are.
    """
    code = F.xxhash64(*columns)
    total = df.count()
    if total > 4 * most:
        width = 1 << 40
        df = df.where(F.pmod(code, F.lit(width)) < F.lit(int(2 * most / total * width)))
    return df.orderBy(F.pmod(code, F.lit(1 << 40)), *columns).limit(most)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the written table.

    Cuts the lineage: a lost executor costs a re-read, not the work behind the table.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
