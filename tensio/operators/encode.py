"""Vocabulary, token-id sequences, padding, label index and one-hot labels.

The vocabulary keeps the ``max_words - 1`` most frequent tokens (ids 1 …, 1 = most
frequent, ties by word).  Its size is bounded by ``max_words``, which is what makes the
single-partition numbering and the broadcast to executors safe.  It is fitted once and
then reused (it is not re-fitted on the texts being encoded).

Exploding every token and joining would shuffle every token of the corpus to regroup the
sequences; instead the bounded vocabulary is broadcast and an Arrow function looks up the
distinct tokens of each batch at once and rebuilds the rows from their offsets (no shuffle, no
Python loop over tokens).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions import text as T
from tensio.operators import arrow_text
from tensio.operators.partitioning import materialize, share
from tensio.functions.lexicons import MAX_LEN, MAX_WORDS
from tensio.session import ship_package

#: Text bytes whose words are counted together before they are handed on.
COUNTED_BYTES = 16 << 20


def word_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """``(word, count)`` over all token occurrences, combined map-side."""
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def keras_word_counts(df: DataFrame, text_col: str, group: str | None = None) -> DataFrame:
    """``(g, word, n)`` over all ``keras_tokens`` of each ``group`` (numbers; without it, all rows are group 0).

    Tasks count the words of some megabytes of text at once and hand on the distinct ones.
    """
    ship_package(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column(0).to_numpy(), pc.fill_null(batch.column(1), "")
            for start, stop in arrow_text.slices(texts, COUNTED_BYTES):
                own = numbers[start:stop]
                for g in np.unique(own):
                    words, n = arrow_text.word_counts(texts.take(pa.array(start + np.flatnonzero(own == g))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), g, np.int32)), words, n], names=["g", "word", "n"])

    number = F.lit(0) if group is None else F.col(group).cast("int")
    parts = df.select(number.alias("g"), T.lowercase(text_col).alias("lowered")).mapInArrow(count, "g int, word string, n long")
    return parts.groupBy("g", "word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text_col: str, max_words: int = MAX_WORDS) -> DataFrame:
    """``(word, count, id)`` for the ``max_words - 1`` most frequent words of ``text_col``.

    A histogram of counts gives the count at which the list is full: words above it are all
    in, and only words with that very count are put in order.
    """
    counts = materialize(keras_word_counts(df, text_col).select("word", F.col("n").alias("count")))
    room = max_words - 1
    # One row per distinct count; running totals from the largest down.
    above = F.sum("_n").over(Window.orderBy(F.desc("count")))
    steps = counts.groupBy("count").agg(F.count(F.lit(1)).alias("_n")).withColumn("_total", above)
    edge = steps.where(F.col("_total") > room).orderBy(F.desc("count")).limit(1).select("count", (F.lit(room) - F.col("_total") + F.col("_n")).alias("room")).first()
    if edge is not None:
        ties = counts.where(F.col("count") == edge["count"]).orderBy("word").limit(edge["room"])
        counts = counts.where(F.col("count") > edge["count"]).unionByName(ties)
    # ≤ max_words - 1 rows: numbering them in one partition is bounded
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "word"))
    return counts.withColumn("id", rank.cast("int"))


def ids_of(tokens: pa.ListArray, words: pa.Array, limit: int | None = None) -> pa.ListArray:
    """Ids of the known words of each row, in order: ``words[i]`` has id ``i + 1``, others go.

    The distinct tokens of a batch are looked up once, whatever the rows hold.
    """
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    table = pc.fill_null(pc.add(pc.index_in(flat.dictionary, value_set=words), pa.scalar(1, pa.int32())), 0).to_numpy()
    codes = pc.fill_null(flat.indices, -1).to_numpy()
    ids = np.append(table, 0)[codes]  # -1 (a NULL token) reads the 0 at the end
    known = ids > 0
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if limit is not None:
        upto = np.concatenate([[0], np.cumsum(known)])
        known &= upto[1:] - upto[np.concatenate([[0], np.cumsum(lengths)[:-1]])][owner] <= limit if len(owner) else known
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[known], minlength=len(lengths)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[known], pa.int32()))


def _mapper(bc, limit: int | None = None):
    @F.arrow_udf(TY.ArrayType(TY.IntegerType()))
    def to_ids(tokens: pa.Array) -> pa.Array:
        return ids_of(tokens, bc.value, limit)

    return to_ids


def sequences(df: DataFrame, text_col: str, vocab: DataFrame, out: str = "seq", max_words: int = MAX_WORDS, limit: int | None = None) -> DataFrame:
    """Token ids in text order; words outside the vocabulary are dropped.  ``limit`` stops a row
    after so many ids (for sequences that are padded and cut to that length anyway)."""
    # one bounded fetch: at most max_words rows come back, which also checks the size
    rows = vocab.filter(F.col("id") < F.lit(max_words)).select("word", "id").limit(max_words).collect()
    if len(rows) >= max_words:
        raise ValueError(f"vocabulary has {len(rows)} entries, more than max_words={max_words}")
    by_id = {int(r["id"]): r["word"] for r in rows}
    # Ids without a word (in a vocabulary with gaps) hold NULL, which no token equals.
    words = pa.array([by_id.get(i) for i in range(1, max(by_id, default=0) + 1)], pa.string())
    return df.withColumn(out, _mapper(share(df.sparkSession, words), limit)(T.keras_tokens(text_col)))


def pad(seq: Column | str, max_len: int = MAX_LEN, value: int = 0) -> Column:
    """Pad with ``value`` and truncate, both at the end, to exactly ``max_len``."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.slice(F.concat(s, F.array_repeat(F.lit(value), F.lit(max_len))), 1, max_len)


def label_index(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """Index of each label in the sorted distinct labels (0-based); every row is kept.

    A NULL label comes last and has the index after all others.  The distinct labels are dealt to
    sorted ranges and numbered within each, so any number of them can be indexed.
    """
    ranges = df.select(label).distinct().repartitionByRange(F.asc_nulls_last(label))
    distinct = materialize(ranges.withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in distinct.groupBy("_range").count().collect())  # one row per range
    before, total = [], 0
    for number, size in sizes:
        before.append((number, total))
        total += size
    starts = df.sparkSession.createDataFrame(before, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(label))) - 1
    indexed = distinct.join(starts, "_range").select(F.col(label).alias("_label"), (F.col("_before") + place).cast("int").alias(out))
    return df.join(indexed, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def one_hot(idx: Column | str, num_classes: int = 3) -> Column:
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.array(*[(i == k).cast("double") for k in range(num_classes)])
