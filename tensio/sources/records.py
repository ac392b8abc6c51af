"""Records of quoted CSV files, with each file read by many tasks.

A quoted field may hold newlines, so a task that starts in the middle of a file cannot tell from
its own lines whether it is inside a field.  What a line does to that question can be told,
though, for either answer: it keeps it, flips it, or settles it.  So:

1. every task sums up its split: is a quoted field open at its end, if one was (not) open at
   its start; one row per split reaches the driver;
2. a running composition over the splits of each file gives every split its true start;
3. a second pass joins the lines of each record.  A record that crosses splits leaves a fragment
   in each, and the fragments (a few per split) are put together by a small shuffle.

Quotes count as readers count them: one opens a field only where the field begins, a doubled one
inside a quoted field stands for itself, and any other is a plain character.  Lines end at
``\\n``; a ``\\r`` before it belongs to the line end, except inside a quoted field.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.operators.partitioning import materialize, share
from tensio.session import ship_package

#: Where a scan stands: at a field's start, in plain text, behind a closing quote, in a quoted field.
_START, _PLAIN, _CLOSED, _QUOTED = range(4)
#: What a line does to "a quoted field is open": keeps it, flips it, closes it, opens it.
KEEP, FLIP, CLOSE, OPEN = range(4)
#: Room for positions within a file; files are numbered above it.
FILE_BITS = 43

#: windows-1252 beyond ISO-8859-1: the characters of the bytes 0x80 to 0x9F, in order (five are
#: not assigned and stay).  Fixed values of the code page.
CP1252_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_C1 = "".join(map(chr, range(0x80, 0xA0)))


def _scan(text: Column, sep: str, quoted: bool) -> Column:
    """``state, seps`` behind the text: where the scan stands, separators outside quoted fields."""

    def behind(state: Column, part: Column) -> Column:
        ends, holds = F.endswith(part, F.lit(sep)), F.contains(part, F.lit(sep))
        return F.when((state == _QUOTED) | (part == ""), state).when(ends, _START).when(holds, _PLAIN).otherwise(_PLAIN)

    def count(state: Column, part: Column) -> Column:
        return F.when(state == _QUOTED, 0).otherwise(F.length(part) - F.length(F.replace(part, F.lit(sep), F.lit(""))))

    def step(acc: Column, part: Column) -> Column:
        state = acc["state"]
        turned = F.when(state == _START, _QUOTED).when(state == _QUOTED, _CLOSED).when(state == _CLOSED, _QUOTED).otherwise(_PLAIN)
        return F.struct(behind(turned, part).alias("state"), (acc["seps"] + count(turned, part)).alias("seps"))

    parts = F.split(text, '"')
    first = F.lit(_QUOTED if quoted else _START)
    begin = F.struct(behind(first, parts[0]).alias("state"), count(first, parts[0]).alias("seps"))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), begin, step)


def line_effect(line: Column, sep: str) -> Column:
    """KEEP, FLIP, CLOSE or OPEN."""
    from_out = _scan(line, sep, False)["state"] == _QUOTED
    from_in = _scan(line, sep, True)["state"] == _QUOTED
    effect = F.when(from_out, F.when(from_in, OPEN).otherwise(FLIP)).otherwise(F.when(from_in, KEEP).otherwise(CLOSE))
    return F.when(F.contains(line, F.lit('"')), effect).otherwise(KEEP)


def field_count(record: Column, sep: str) -> Column:
    """Number of fields of a whole record; an empty one behind the last separator counts."""
    plain = F.length(record) - F.length(F.replace(record, F.lit(sep), F.lit("")))
    return F.when(F.contains(record, F.lit('"')), _scan(record, sep, False)["seps"]).otherwise(plain) + 1


def _open_after(effects: np.ndarray, opened: bool) -> np.ndarray:
    """Is a quoted field open behind each line, if one is (``opened``) before the first."""
    at = np.arange(len(effects))
    settled = np.maximum.accumulate(np.where(effects >= CLOSE, at, -1))
    flips = np.cumsum(effects == FLIP)
    base = np.where(settled >= 0, effects[settled] == OPEN, opened)
    since = flips - np.where(settled >= 0, flips[settled], 0)
    return base ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The pieces of a batch that belong to one split each."""
    file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield (int(file[a]), int(block[a])), batch.slice(int(a), int(b - a))


_SUM = "file long, block long, path string, lines long, open_if_closed boolean, open_if_open boolean, start_if_open boolean, not_utf8 long, c1 long"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split.  ``start_if_open``: does a record start in it, if a field is open before it."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        file, block = now
        values = [file, block, *state]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[f.split()[0] for f in _SUM.split(", ")])

    for batch in batches:
        for split, part in _runs(batch) if batch.num_rows else ():
            if split != now:
                if now is not None:
                    yield row()
                now, state = split, [part.column(2)[0].as_py(), 0, False, True, False, 0, 0]
            effects = part.column(3).to_numpy()
            closed, opened = _open_after(effects, state[2]), _open_after(effects, state[3])
            before = np.append(state[3], opened[:-1])
            state[4] = state[4] or not bool(before.all())
            state[1] += part.num_rows
            state[2], state[3] = bool(closed[-1]), bool(opened[-1])
            state[5] += pc.sum(part.column(4)).as_py()
            state[6] += pc.sum(part.column(5)).as_py()
    if now is not None:
        yield row()


@dataclass
class Splits:
    """The splits of all files in order: what is open before each, and whose record that is."""

    file: np.ndarray
    block: np.ndarray
    opened: np.ndarray
    owner: np.ndarray
    number: np.ndarray

    def find(self, file: int, block: int) -> int:
        low, high = np.searchsorted(self.file, [file, file + 1])
        at = low + int(np.searchsorted(self.block[low:high], block))
        if at >= high or self.block[at] != block:
            raise RuntimeError("the file was cut differently on the second pass")
        return at


def _compose(rows: list) -> Splits:
    """Walk the splits of every file; ``number`` is the file's place in path order."""
    rows = sorted(rows, key=lambda r: (r["file"], r["block"]))
    places = {p: i for i, p in enumerate(sorted({r["path"] for r in rows}))}
    opened, owner = np.zeros(len(rows), bool), np.full(len(rows), -1, np.int64)
    now, last, whose = False, None, -1
    for i, r in enumerate(rows):
        if r["file"] != last:
            now, last, whose = False, r["file"], -1
        opened[i], owner[i] = now, whose if now else -1
        starts = r["start_if_open"] if now else True
        now = r["open_if_open"] if now else r["open_if_closed"]
        whose = (r["block"] if starts else whose) if now else -1
    return Splits(
        np.array([r["file"] for r in rows], np.int64), np.array([r["block"] for r in rows], np.int64), opened, owner, np.array([places[r["path"]] for r in rows], np.int64)
    )


_RECORD = "file long, owner long, pos long, record string"


def _records(splits) -> callable:
    """Lines to records.  ``owner`` is -1 for a whole record; the fragments of one record share the
    split in which it starts.  ``pos`` rises within a file, and from file to file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = splits.value
        now = None
        at, line, opened, held, pos = 0, 0, False, [], 0  # held: lines of the record that is open

        def out(owners, places, records) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.int64()), pa.array(owners, pa.int64()), pa.array(places, pa.int64()), records], names=["file", "owner", "pos", "record"])

        def text(parts: list) -> pa.Array:
            lines = pa.concat_arrays(parts)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")

        def close(whole: bool) -> pa.RecordBatch:
            """The record held back: whole, or the fragment that ends with the split."""
            owner = table.owner[at] if pos < 0 else (-1 if whole else now[1])
            return out([owner], [base if pos < 0 else pos], text(held))

        base = 0
        for batch in batches:
            for split, part in _runs(batch) if batch.num_rows else ():
                if split != now:
                    if held:
                        yield close(False)
                    now, at, line = split, table.find(*split), 0
                    base = (int(table.number[at]) << FILE_BITS) + split[1]
                    opened, held = bool(table.opened[at]), []
                    pos = -1 if opened else base  # -1: the lines of an earlier split's record
                lines = part.column(2)
                after = _open_after(part.column(3).to_numpy(), opened)
                starts = np.flatnonzero(~np.append(opened, after[:-1]))
                first = int(starts[0]) if len(starts) else len(lines)
                if first:
                    held.append(lines.slice(0, first))
                    if not after[first - 1]:
                        yield close(True)
                        held = []
                if len(starts):
                    ends = np.append(starts[1:], len(lines))
                    whole = len(starts) if not after[-1] else len(starts) - 1
                    if whole:
                        offsets = pa.array(np.append(starts[:whole], ends[whole - 1]), pa.int32())
                        yield out(np.full(whole, -1), base + line + starts[:whole], pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n"))
                    if whole < len(starts):
                        held, pos = [lines.slice(int(starts[-1]))], base + line + int(starts[-1])
                opened, line = bool(after[-1]), line + len(lines)
        if held:
            yield close(False)

    return work


def _decoded(raw: Column, charset: str) -> Column:
    if charset == "UTF-8":
        return F.make_valid_utf8(raw)
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    return F.translate(latin, _C1, CP1252_HIGH) if charset == "windows-1252" else latin


def choose_charset(not_utf8: int, c1: int) -> str:
    """By content: UTF-8 if every line is valid in it; else windows-1252 if bytes occur that are
    control characters in ISO-8859-1; else ISO-8859-1."""
    if not not_utf8:
        return "UTF-8"
    return "windows-1252" if c1 else "ISO-8859-1"


def read_records(spark: SparkSession, path: str | list[str], sep: str = ",", charset: str | None = None) -> tuple[DataFrame, str]:
    """``(pos, record, first)`` and the charset: the records of the files at ``path``, none of them empty.

    ``pos`` orders the records of a file, and the files by path; ``first`` marks a file's first
    record.  ``charset`` is UTF-8, ISO-8859-1, US-ASCII, windows-1252 or None (chosen by content,
    for all files together).  A quote that is never closed makes the rest of its file one record,
    as it does for any reader.  The records are written once, so they are not joined again on
    every use; missing files raise Spark's error.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path)
    split = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = F.col("value")
    bad = ~F.is_valid_utf8(raw)
    c1 = F.when(bad, F.decode(raw.cast("binary"), "ISO-8859-1").rlike("[\x80-\x9f]")).otherwise(False)
    coded = lines.select(*split, F.col("_metadata.file_path").alias("path"), line_effect(raw, sep).alias("effect"), bad.cast("long").alias("bad"), c1.cast("long").alias("c1"))
    # One row of some 60 bytes for each split of spark.sql.files.maxPartitionBytes.
    rows = coded.mapInArrow(_sum_up, _SUM).collect()
    if charset is None:
        charset = choose_charset(sum(r["not_utf8"] for r in rows), sum(r["c1"] for r in rows))
    splits = share(spark, _compose(rows))
    decoded = lines.select(*split, _decoded(raw, charset).alias("value"), line_effect(raw, sep).alias("effect"))
    joined = materialize(decoded.mapInArrow(_records(splits), _RECORD))
    whole = joined.where("owner = -1").select("pos", "record")
    pieces = F.array_sort(F.collect_list(F.struct("pos", "record")))
    crossing = joined.where("owner <> -1").groupBy("file", "owner").agg(pieces.alias("p"))
    crossing = crossing.select(F.element_at("p", 1)["pos"].alias("pos"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    first = F.col("pos").bitwiseAND((1 << FILE_BITS) - 1) == 0
    record = F.regexp_replace(F.when(first, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record")), r"\r\z", "")
    return whole.unionByName(crossing).select("pos", record.alias("record"), first.alias("first")).where("record <> ''"), charset
