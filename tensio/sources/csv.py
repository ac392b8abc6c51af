"""CSV readers with the reading rules the source files need.

* quoted fields may hold newlines (``multiLine``), ``"`` escapes ``"``;
* missing tokens (``NA``, ``null``, ``''``, …) become NULL in string columns;
* a tolerant mode skips lines with *more* fields than the schema (and counts them) while
  short lines are kept with NULLs;
* column lookup by exact name, else the first column whose lowercase name contains one
  of the given substrings.

A file with quoted newlines is read by many tasks (``records.read_records``); only charsets in
which a newline is not one byte go through Spark's ``multiLine`` reader, one task per file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions.lexicons import NA_TOKENS
from tensio.functions.text import na_to_null
from tensio.operators.partitioning import materialize
from tensio.sources.records import CP1252_HIGH, field_count, read_records

#: Charsets in which quotes, separators and newlines are the bytes of ASCII; ``auto`` looks at the
#: content (UTF-8, else windows-1252 or ISO-8859-1).
CP1252 = {0x80 + i: c for i, c in enumerate(CP1252_HIGH)}
SPLITTABLE = {"UTF-8": "UTF-8", "UTF8": "UTF-8", "US-ASCII": "UTF-8", "ISO-8859-1": "ISO-8859-1", "LATIN-1": "ISO-8859-1", "LATIN1": "ISO-8859-1", "AUTO": None}

# Empty header cells read as NULL make Spark's header check fail; with a null marker that
# never occurs they stay '' (Spark then names them _c<i>) and '' becomes NULL afterwards
# through the missing-token step.
_NO_NULL_MARKER = "\u0000tensio-no-null\u0000"


class SourceError(Exception):
    """A source could not be read (missing, empty or without the needed columns)."""


def _reader(spark: SparkSession, sep: str, header: bool, encoding: str, multiline: bool):
    return (
        spark.read.option("header", header)
        .option("sep", sep)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("nullValue", _NO_NULL_MARKER if header else "")
        .option("emptyValue", "")
    )


def normalise_missing(df: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Whole-value missing tokens → NULL in every string column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, TY.StringType):
            cols.append(na_to_null(F.col(f"`{f.name}`"), na_tokens).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _encodings(encoding: str | Sequence[str]) -> list[str]:
    return [encoding] if isinstance(encoding, str) else list(encoding)


def _parsed(spark: SparkSession, path: str | list[str], sep: str, header: bool, encoding: str, schema: TY.StructType | None) -> DataFrame:
    """The records of the files, split between tasks and parsed one by one: the columns and ``_pos``,
    ``_fields`` (number of fields)."""
    records, charset = read_records(spark, path, sep, SPLITTABLE[encoding.upper()])
    if schema is None:
        names = _reader(spark, sep, header, "UTF-8" if charset == "UTF-8" else "ISO-8859-1", True).csv(path).columns
        if not names:
            raise SourceError(f"{path}: empty file")
        if charset == "windows-1252":
            names = [n.translate(CP1252) for n in names]
        schema = TY.StructType([TY.StructField(n.lstrip("\ufeff"), TY.StringType()) for n in names])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "emptyValue": "", "nullValue": _NO_NULL_MARKER if header else ""}
    # Fields under numbers: names may repeat or hold anything.
    numbered = TY.StructType([TY.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    if header:
        records = records.where(~F.col("first"))
    parsed = records.select("pos", field_count(F.col("record"), sep).alias("fields"), F.from_csv("record", numbered.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)], F.col("pos").alias("_pos"), F.col("fields").alias("_fields"))


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    schema: TY.StructType | None = None,
    encoding: str | Sequence[str] = "UTF-8",
    multiline: bool = True,
    na_tokens: Sequence[str] = NA_TOKENS,
    position: str | None = None,
) -> DataFrame:
    """Read a delimited file; all columns are strings unless ``schema`` is given.

    ``encoding`` may be a list tried in order; a charset the reader does not support is
    skipped (e.g. ``windows-1252``: ISO-8859-1 decodes every byte and differs only in
    0x80–0x9F, which text cleaning drops anyway).  ``auto`` chooses by content, windows-1252
    included.  ``position`` names a column to add that rises in file order.
    """
    problems = []
    for enc in _encodings(encoding):
        try:
            if multiline and enc.upper() in SPLITTABLE:
                df = _parsed(spark, path, sep, header, enc, schema).drop("_fields")
                df = df.withColumnRenamed("_pos", position) if position else df.drop("_pos")
            else:
                reader = _reader(spark, sep, header, enc, multiline)
                df = (reader if schema is None else reader.schema(schema)).csv(path)
                if not df.columns:
                    raise SourceError(f"{path}: empty file")
                df = df.withColumn(position, F.monotonically_increasing_id()) if position else df
        except IllegalArgumentException as e:  # unsupported charset: try the next one
            problems.append(f"{enc}: {str(e).splitlines()[0]}")
            continue
        except AnalysisException as e:
            raise SourceError(f"{path}: {e}") from e
        return normalise_missing(df, na_tokens)
    raise SourceError(f"{path}: no usable encoding ({'; '.join(problems)})")


def read_csv_tolerant(
    spark: SparkSession,
    path: str,
    schema: TY.StructType,
    sep: str = ",",
    header: bool = False,
    encoding: str | Sequence[str] = "UTF-8",
    na_tokens: Sequence[str] = NA_TOKENS,
    multiline: bool = True,
    position: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read with ``schema``; records with too many fields are dropped, short ones kept.

    A quoted field may hold newlines; ``multiline=False`` reads line by line instead.

    The fields of each record are counted as they stand, by a scan that knows quotes: a record
    with more of them than ``schema`` goes, whatever they hold, and an empty field behind a last
    separator counts.  Every field is read as text; the kept ones are then cast to ``schema``'s
    types (a value that does not parse becomes NULL).  Returns ``(rows, report)``; ``report`` is a
    one-row DataFrame with the number of records read and of records skipped.  ``position`` names
    a column to add to ``rows`` that rises in file order.
    """
    text_schema = TY.StructType([TY.StructField(f.name, TY.StringType()) for f in schema.fields])
    raw = None
    problems = []
    for enc in _encodings(encoding):
        try:
            if multiline and enc.upper() in SPLITTABLE:
                raw = _parsed(spark, path, sep, header, enc, text_schema)
            else:
                raw = _counted_by_reader(spark, path, sep, header, enc, multiline, text_schema)
            break
        except IllegalArgumentException as e:  # unsupported charset: try the next one
            problems.append(f"{enc}: {str(e).splitlines()[0]}")
        except AnalysisException as e:
            raise SourceError(f"{path}: {e}") from e
    if raw is None:
        raise SourceError(f"{path}: no usable encoding ({'; '.join(problems)})")
    too_long = F.col("_fields") > len(schema.fields)
    typed = [
        (F.col(f.name) if isinstance(f.dataType, TY.StringType) else F.trim(F.col(f.name)).try_cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    kept = normalise_missing(raw.filter(~too_long).drop("_fields"), na_tokens)
    rows = kept.select(*typed, *([F.col("_pos").alias(position)] if position else []))
    report = raw.agg(F.count(F.lit(1)).alias("lines"), F.count_if(too_long).alias("skipped_lines"))
    return rows, report


def _counted_by_reader(spark: SparkSession, path: str, sep: str, header: bool, encoding: str, multiline: bool, schema: TY.StructType) -> DataFrame:
    """Spark's own reader with the raw record beside the columns, for ``_fields``; ``_pos`` by scan order.

    The reader keeps the raw record only of those whose number of fields is not the schema's.
    """
    record = "_record"
    wide = TY.StructType([*schema.fields, TY.StructField(record, TY.StringType())])
    reader = _reader(spark, sep, header, encoding, multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", record)
    raw = reader.schema(wide).csv(path)
    fields = F.when(F.col(record).isNull(), len(schema.fields)).otherwise(field_count(F.col(record), sep))
    # Spark answers no query that reads the raw record alone, so the parsed rows are written once.
    return materialize(raw.withColumns({"_fields": fields, "_pos": F.monotonically_increasing_id()}).drop(record))


def peek_columns(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of a headed file (reads the header only)."""
    try:
        names = _reader(spark, sep, True, encoding, True).csv(path).columns
    except AnalysisException as e:
        raise SourceError(f"{path}: {e}") from e
    if not names:
        raise SourceError(f"{path}: empty file")
    return [n.lstrip("\ufeff") for n in names]


def resolve_column(df: DataFrame, exact: str, substrings: Sequence[str]) -> DataFrame:
    """Make sure column ``exact`` exists: keep it, or rename the first column (file order)
    whose lowercase name contains one of ``substrings``; raise ``SourceError`` otherwise."""
    if exact in df.columns:
        return df
    for c in df.columns:
        if any(s in c.lower() for s in substrings):
            return df.withColumnRenamed(c, exact)
    raise SourceError(f"no column {exact!r} or one containing {list(substrings)}; have {df.columns}")


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SourceError(f"missing required columns {missing}; have {df.columns}")
    return df


def read_many(
    spark: SparkSession,
    paths: Sequence[str],
    load: Callable[[SparkSession, str], DataFrame],
) -> list[tuple[str, DataFrame]]:
    """Load each path with ``load``; a path that fails is skipped, none left is an error."""
    if not paths:
        raise SourceError("no files given")
    out, errors = [], []
    for p in paths:
        try:
            out.append((p, load(spark, p)))
        except (SourceError, AnalysisException) as e:
            errors.append(f"{p}: {e}")
    if not out:
        raise SourceError("no valid data files: " + "; ".join(errors))
    return out
