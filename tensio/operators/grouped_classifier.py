"""One classifier per group (platform), all trained by the same passes over the data.

Every pass is one job for all groups: tasks add up each group's loss and gradient over their rows
(and the loss over its validation rows, which come in the same table), a few reducers add up the
tasks' sums, and the driver takes one quasi-Newton step per group.  Nothing is collected but those
sums: at most ``SLOTS`` of them per group, each the size of the model.

Training follows the original's budget and callbacks: at most 20 passes; when the validation
loss has not fallen for 3 passes the step shrinks to a fifth and the optimiser starts again from
the best weights (warm restart); after 5 passes without a gain it stops; the weights with the
least validation loss are kept.

A row's features are its words' counts over the group's own vocabulary, divided by the square root
of its length, so a long text does not outweigh many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions import text as T
from tensio.functions.lexicons import CLASS_WEIGHTS, MAX_WORDS
from tensio.operators import arrow_text
from tensio.operators.classify import weight_column
from tensio.operators.encode import ids_of, keras_word_counts
from tensio.operators.evaluate import argmax_first
from tensio.operators.partitioning import materialize, share

CLASSES = 3
#: Fixed training budget: passes, passes without gain before a restart and before the end, shrinking.
MAX_PASSES = 20
RESTART_AFTER, STOP_AFTER = 3, 5
SHRINK = 0.2
LEAST_STEP = 1e-4
RIDGE = 0.01
MEMORY = 7
#: Groups trained together at most, and partial sums per group that reach the driver at most.
MAX_GROUPS = 64
SLOTS = 4
ID_BYTES = 4
#: Columns of coded rows.
NUMBER, IDS = "_no", "_ids"


@dataclass
class GroupState:
    """The optimiser of one group: its place, its best place so far, and what it remembers."""

    weights: np.ndarray
    best: np.ndarray | None = None
    best_loss: float = np.inf
    best_pass: int = 0
    step: float = 1.0
    at: np.ndarray | None = None  # where the last accepted gradient was taken
    gradient: np.ndarray | None = None
    loss: float = np.inf
    pairs: list = field(default_factory=list)
    waited: int = 0
    done: bool = False

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        """Two-loop recursion over the remembered steps."""
        q, parts = gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            parts.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s * y).sum() / (y * y).sum()
        else:
            q /= max(1.0, np.sqrt((gradient * gradient).sum()))
        for (s, y), a in zip(self.pairs, reversed(parts), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return -q

    def restart(self) -> None:
        self.step = max(self.step * SHRINK, LEAST_STEP)
        self.pairs.clear()

    def take(self, number: int, loss: float, gradient: np.ndarray, valid: float) -> bool:
        """One pass's sums; moves the weights.  Was this the best place so far?"""
        better = valid < self.best_loss
        if better:
            self.best, self.best_loss, self.best_pass, self.waited = self.weights.copy(), valid, number, 0
        else:
            self.waited += 1
            if self.waited >= STOP_AFTER:
                self.done = True
                return False
        if loss > self.loss:  # the step went too far: back, and a shorter one
            self.restart()
            self.weights = self.at + self.step * self.direction(self.gradient)
            return better
        if self.at is not None:
            s, y = self.weights - self.at, gradient - self.gradient
            if (s * y).sum() > 1e-12:
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.at, self.gradient, self.loss = self.weights, gradient, loss
        if self.waited and self.waited % RESTART_AFTER == 0:
            self.restart()
        self.weights = self.at + self.step * self.direction(gradient)
        return better


@dataclass
class GroupedModel:
    groups: list
    words: list[pa.Array]  # of each group, by id
    weights: list[np.ndarray]  # (classes, words + 1); the first column is the intercept
    history: list[tuple]  # (group, pass, train_loss, validation_loss, best so far)


def group_vocabularies(df: DataFrame, group: str, text: str, max_words: int = MAX_WORDS) -> dict:
    """The ``max_words - 1`` most frequent words of every group, most frequent first, ties by word.

    ``group`` holds numbers.  A histogram of counts gives each group's count at which its list is
    full: words above it are all in, and only words with that very count are put in order.
    """
    counts = materialize(keras_word_counts(df, text, group))
    room = max_words - 1
    total = F.sum("_words").over(Window.partitionBy("g").orderBy(F.desc("n")))
    steps = counts.groupBy("g", "n").agg(F.count(F.lit(1)).alias("_words")).withColumn("_total", total)
    full = steps.where((F.col("_total") > room) & (F.col("_total") - F.col("_words") <= room))
    edges = [(r["g"], r["n"], room - r["_total"] + r["_words"]) for r in full.collect()]  # one row a group at most
    above = F.broadcast(df.sparkSession.createDataFrame([e[:2] for e in edges], "_g int, _edge long"))
    top = counts.join(above, F.col("g") == F.col("_g"), "left").where(F.col("_edge").isNull() | (F.col("n") > F.col("_edge"))).select("g", "word", "n")
    for g, n, left in edges:
        if left > 0:
            top = top.unionByName(counts.where((F.col("g") == g) & (F.col("n") == n)).orderBy("word").limit(left))
    out: dict = {}
    for r in sorted(top.collect(), key=lambda r: (r["g"], -r["n"], r["word"])):  # fewer than max_words rows a group
        out.setdefault(r["g"], []).append(r["word"])
    return out


def _ids(no: np.ndarray, lowered: pa.Array, words: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts, one after the other, and the ids per text; a text of no group (-1) has none."""
    lowered = pc.fill_null(lowered, "")
    flat, lengths = [], []
    for start, stop in arrow_text.slices(lowered):
        own, ids, rows = no[start:stop], [], []
        for g in np.unique(own[own >= 0]):
            at = np.flatnonzero(own == g)
            ids.append(ids_of(arrow_text.keras_words(lowered.take(pa.array(start + at))), words[g]))
            rows.append(at)
        rest = np.flatnonzero(own < 0)
        ids.append(pa.ListArray.from_arrays(pa.array(np.zeros(len(rest) + 1), pa.int32()), pa.array([], pa.int32())))
        inorder = pa.concat_arrays(ids).take(pa.array(np.argsort(np.concatenate([*rows, rest]), kind="stable")))
        flat.append(inorder.flatten().to_numpy())
        lengths.append(inorder.value_lengths().to_numpy().astype(np.int64))
    if not flat:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(flat), np.concatenate(lengths)


def _ids_udf(words):
    """Word ids as the bytes of 32-bit integers: rows of bytes pass between Spark and Python whole."""

    @F.arrow_udf(TY.BinaryType())
    def ids(no: pa.Array, lowered: pa.Array) -> pa.Array:
        flat, lengths = _ids(pc.fill_null(no, -1).to_numpy(), lowered, words.value)
        ends = np.concatenate([[0], np.cumsum(lengths)]) * ID_BYTES
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype(np.int32).tobytes())])

    return ids


def _held_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``_ids_udf`` wrote."""
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // ID_BYTES
    flat = np.frombuffer(data, np.int32, int(ends[-1])) if data is not None and ends[-1] else np.zeros(0, np.int32)
    return flat[ends[0] :].astype(np.intp), np.diff(ends)


def _logits(flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each row and class, and what each of a row's words counts."""
    value = 1 / np.sqrt(np.maximum(lengths, 1))
    z = np.zeros((len(lengths), CLASSES))
    filled = np.flatnonzero(lengths)
    if len(filled):
        starts = (np.cumsum(lengths) - lengths)[filled]
        for c, w in enumerate(weights):
            z[filled, c] = np.add.reduceat(w[flat], starts)
    return z * value[:, None] + weights[:, 0], value


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pass(coded: DataFrame, weights) -> list[tuple]:
    """``(group number, validation?, loss, weight, gradient)`` sums of one pass."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            no, valid = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for g in np.unique(no):
                w = weights.value[g]
                if w is None:
                    continue
                for fold in (False, True):
                    rows = np.flatnonzero((no == g) & (valid == fold))
                    if not len(rows):
                        continue
                    part = batch.take(pa.array(rows))
                    y, weight = part.column(2).to_numpy(), part.column(3).to_numpy()
                    flat, lengths = _held_ids(part.column(4))
                    z, value = _logits(flat, lengths, w)
                    p = _probabilities(z)
                    sums = held.setdefault((int(g), fold), [0.0, 0.0, None if fold else np.zeros_like(w)])
                    sums[0] -= float((weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
                    sums[1] += float(weight.sum())
                    if not fold:
                        p[np.arange(len(y)), y] -= 1
                        p *= weight[:, None]
                        for c in range(CLASSES):
                            sums[2][c] += np.bincount(flat, weights=np.repeat(p[:, c] * value, lengths), minlength=w.shape[1])
                            sums[2][c, 0] += p[:, c].sum()
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (g, fold), (loss, weight, gradient) in held.items():
            blob = b"" if gradient is None else gradient.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([fold]), pa.array([loss]), pa.array([weight]), pa.array([blob], pa.binary())], names=["no", "valid", "loss", "weight", "gradient"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.select(["no", "valid", "loss", "weight", "gradient"]).to_pylist():
                gradient = np.frombuffer(r["gradient"]) if r["gradient"] else None
                sums = held.setdefault((r["no"], r["valid"]), [0.0, 0.0, None if gradient is None else np.zeros(len(gradient))])
                sums[0] += r["loss"]
                sums[1] += r["weight"]
                if gradient is not None:
                    sums[2] += gradient
        yield from out(held)

    fields = "no int, valid boolean, loss double, weight double, gradient binary"
    parts = coded.mapInArrow(add_up, fields).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
    summed = parts.repartition(SLOTS, "slot").mapInArrow(reduce, fields)
    return [tuple(r) for r in summed.collect()]


@dataclass
class Coded:
    """Rows with their words as ids, written once: every pass and the prediction read them."""

    rows: DataFrame  # the rows with NUMBER (NULL for a group that has no training row) and IDS
    groups: list
    words: list[pa.Array]


def code(df: DataFrame, group: str, text: str, label: str, validation: str, max_words: int = MAX_WORDS) -> Coded:
    """Learn the groups' vocabularies from the training rows and code all rows of ``df``."""
    spark = df.sparkSession
    fit_rows = df.where(F.col(label).isin(list(range(CLASSES))) & ~F.col(validation))
    met = fit_rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(met) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    groups = sorted((r[group] for r in met), key=lambda g: (g is None, g))
    vocabularies = group_vocabularies(_numbered(fit_rows, group, groups), NUMBER, text, max_words) if groups else {}
    words = [pa.array(vocabularies.get(i, []), pa.string()) for i in range(len(groups))]
    ids = _ids_udf(share(spark, words))
    rows = _numbered(df, group, groups).withColumn(IDS, ids(NUMBER, T.lowercase(text)))
    return Coded(materialize(rows), groups, words)


def _numbered(df: DataFrame, group: str, groups: list) -> DataFrame:
    kind = TY.StructType([TY.StructField("_g", df.schema[group].dataType), TY.StructField(NUMBER, TY.IntegerType())])
    numbers = F.broadcast(df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(groups)], kind))
    return df.join(numbers, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def train(
    df: DataFrame,
    group: str,
    text: str,
    label: str,
    validation: str,
    class_weights: Mapping[int, float] = CLASS_WEIGHTS,
    max_words: int = MAX_WORDS,
    max_passes: int = MAX_PASSES,
) -> GroupedModel:
    """Train one model per value of ``group``; rows with ``validation`` true only measure.

    A group without validation rows is judged by its training loss.  Rows whose label is not one of
    the classes are left out, as are NULL texts' words.  Groups without training rows get no
    model; more than ``MAX_GROUPS`` groups raise ``ValueError``.
    """
    return fit(code(df, group, text, label, validation, max_words), label, validation, class_weights, max_passes)


def fit(coded: Coded, label: str, validation: str, class_weights: Mapping[int, float] = CLASS_WEIGHTS, max_passes: int = MAX_PASSES) -> GroupedModel:
    """``train`` on coded rows."""
    spark, groups, words = coded.rows.sparkSession, coded.groups, coded.words
    if not groups:
        return GroupedModel([], [], [], [])
    known = coded.rows.where(F.col(label).isin(list(range(CLASSES))) & F.col(NUMBER).isNotNull() & F.col(validation).isNotNull())
    rows = known.select(F.col(NUMBER).alias("no"), F.col(validation).alias("valid"), F.col(label).cast("int").alias("y"), weight_column(label, class_weights).alias("weight"), F.col(IDS).alias("ids"))

    states = [GroupState(np.zeros((CLASSES, len(w) + 1))) for w in words]
    history = []
    for number in range(1, max_passes + 1):
        weights = share(spark, [None if s.done else s.weights for s in states])
        sums: dict = {}
        for g, fold, loss, weight, blob in _pass(rows.where(F.col("no").isin([i for i, s in enumerate(states) if not s.done])), weights):
            held = sums.setdefault((g, fold), [0.0, 0.0, 0.0])
            held[0], held[1] = held[0] + loss, held[1] + weight
            if blob:
                held[2] = held[2] + np.frombuffer(bytes(blob)).reshape(states[g].weights.shape)
        for i, s in enumerate(states):
            if s.done:
                continue
            loss, weight, gradient = sums[i, False]
            free = s.weights.copy()
            free[:, 0] = 0  # the intercepts are not held down
            loss = loss / weight
            valid = sums[i, True][0] / sums[i, True][1] if (i, True) in sums else loss
            better = s.take(number, loss + RIDGE / 2 * (free * free).sum(), gradient / weight + RIDGE * free, valid)
            history.append((groups[i], number, float(loss), float(valid), bool(better)))
        if all(s.done for s in states):
            break
    return GroupedModel(groups, words, [s.best for s in states], history)


def predict(model: GroupedModel, df: DataFrame, group: str, text: str) -> DataFrame:
    """Input columns plus ``p0, p1, p2``, ``predicted`` (first max wins) and ``confidence``.

    A row of a group without a model has equal probabilities.  Rows that ``code`` has coded for this
    model are scored by their ids.
    """
    words, weights = share(df.sparkSession, model.words), share(df.sparkSession, model.weights)

    def scores(group: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
        owner = np.repeat(np.arange(len(group)), lengths)
        p = np.full((len(group), CLASSES), 1 / CLASSES)
        for g in np.unique(group[group >= 0]):
            own = group == g
            p[own] = _probabilities(_logits(flat[own[owner]], lengths[own], weights.value[g])[0])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1) * CLASSES, pa.int32()), pa.array(p.ravel()))

    @F.arrow_udf(TY.ArrayType(TY.DoubleType()))
    def score(no: pa.Array, lowered: pa.Array) -> pa.Array:
        group = pc.fill_null(no, -1).to_numpy()
        return scores(group, *_ids(group, lowered, words.value))

    @F.arrow_udf(TY.ArrayType(TY.DoubleType()))
    def score_ids(no: pa.Array, ids: pa.Array) -> pa.Array:
        return scores(pc.fill_null(no, -1).to_numpy(), *_held_ids(ids))

    if IDS in df.columns:
        rows = df.withColumn("_p", score_ids(NUMBER, IDS))
    else:
        rows = _numbered(df, group, model.groups).withColumn("_p", score(NUMBER, T.lowercase(text)))
    kept = [c for c in df.columns if c not in (IDS, NUMBER)]
    out = rows.select(*[F.col(f"`{c}`") for c in kept], *[F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(CLASSES)])
    p = [F.col(f"p{i}") for i in range(CLASSES)]
    return out.withColumn("predicted", argmax_first(p)).withColumn("confidence", F.greatest(*p))
