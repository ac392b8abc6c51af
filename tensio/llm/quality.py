"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed on Spark in one pass over whole texts.  The trees are fitted on
the driver from the statistics of at most ``MAX_FIT_ROWS`` labelled rows (a bounded table of
numbers) and flattened into arrays, which go to the tasks for a vectorised traversal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.llm import words as W
from tensio.llm.batches import bounded_sample, map_slices, text_buffer
from tensio.operators.partitioning import share

#: Labelled rows that the fit takes at most, the first by a hash of their id.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
L2 = 1.0
MIN_CHILD = 1.0
FOLDS = 5

FEATURES = [
    "log_words", "log_chars", "mean_word_chars", "upper_share", "digit_share", "symbol_share", "pipe_share", "mark_share", "other_punct_share",
    "long_word_share", "short_word_share", "distinct_share", "repeat_3_share", "dup_line_share", "words_per_line", "stopless_share", "bare_word_share",
]


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_SYMBOL = _flags("#*$%&<>{}[]=~^@\\_/")
_PIPE = _flags("|")
_MARK = _flags("!?")
_PUNCT = _flags(".,;:'\"()-")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text gives zeros."""
    w = W.split(data, offsets)
    n, chars = w.counts, w.chars()
    words, total = np.maximum(n, 1), np.maximum(W.by_doc(chars, w.first), 1)
    edges = offsets[1:], offsets[:-1]

    def share_of(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        return (run[edges[0]] - run[edges[1]]) / total

    h, doc = w.hashes(), w.doc
    own = W.mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    fresh = np.ones(len(own), bool)
    fresh[order[1:]] = own[order[1:]] != own[order[:-1]]
    at = np.flatnonzero(w.room() >= 3)
    grams = W.mix(W.ngrams(h, 3)[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    again = np.zeros(len(h), bool)
    again[at[W.repeated(grams)]] = True
    ln = W.lines(data, offsets)
    first, last = np.searchsorted(w.starts, ln.starts), np.searchsorted(w.starts, ln.ends)
    filled = last > first
    key = W.mix(ln.hash[filled] ^ (ln.doc[filled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    dup = np.zeros(len(key), bool)
    dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    texts = len(n)
    n_lines = np.maximum(np.bincount(ln.doc[filled], minlength=texts), 1)
    n_dup = np.bincount(ln.doc[filled][dup], minlength=texts)
    plain = np.zeros(len(h), bool)
    if len(h):  # words whose last byte is a letter (or part of a character beyond ASCII)
        end = data[w.ends - 1]
        plain = (end >= 0x80) | ((end | 0x20) >= 97) & ((end | 0x20) <= 122)
    columns = [
        np.log1p(n), np.log1p(total * (n > 0)), np.where(n > 0, total / words, 0), share_of(_UPPER), share_of(_DIGIT), share_of(_SYMBOL), share_of(_PIPE),
        share_of(_MARK), share_of(_PUNCT), W.by_doc(chars > 12, w.first) / words, W.by_doc(chars <= 3, w.first) / words, W.by_doc(fresh, w.first) / words,
        W.by_doc(W.covered(again, 3), w.first) / words, n_dup / n_lines, n / n_lines, W.by_doc(chars == 1, w.first) / words, W.by_doc(plain, w.first) / words,
    ]
    return np.column_stack(columns).astype(np.float64)


class Trees:
    """A boosted ensemble as flat arrays: node ``i`` of a tree asks whether feature
    ``feature[i]`` is at most ``cut[i]`` and goes on to ``left[i]`` or ``left[i] + 1``;
    leaves point to themselves, so a fixed number of vector steps reaches them."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int):
        self.base, self.feature, self.cut, self.left, self.value, self.roots, self.depth = base, feature, cut, left, value, roots, depth

    def arrays(self) -> tuple:
        return self.base, self.feature, self.cut, self.left, self.value, self.roots, self.depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                leaf = self.left[at] < 0
                at = np.where(leaf, at, self.left[at] + (x[rows, self.feature[at]] > self.cut[at]))
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost depth-limited trees on the logistic loss, splits searched on histograms.

    With no rows the score is 1/2 everywhere; with one class it is that class's smoothed share.
    """
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    feature, cut, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        cut.append(0.0)
        left.append(-1)
        value.append(0.0)
        return len(feature) - 1

    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(1) for j in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j]) for j in range(width)]) if len(y) else np.zeros((0, width), np.int64)
    flat = binned + np.arange(width) * bins
    raw = np.full(len(y), base)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), 0)]
        while open_nodes:
            i, rows, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and hs >= 2 * MIN_CHILD:
                cells = flat[rows].ravel()
                hist_g = np.bincount(cells, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                hist_h = np.bincount(cells, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                right_h = hs - hist_h
                gain = hist_g**2 / (hist_h + L2) + (gs - hist_g) ** 2 / (right_h + L2) - gs**2 / (hs + L2)
                gain[(hist_h < MIN_CHILD) | (right_h < MIN_CHILD)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-3 and b < len(cuts[j]):
                    best = int(j), int(b)
            if best is None:
                value[i] = float(-rate * gs / (hs + L2))
                raw[rows] += value[i]
                continue
            j, b = best
            feature[i], cut[i] = j, float(cuts[j][b])
            below = binned[rows, j] <= b
            left[i] = node()
            node()
            open_nodes += [(left[i], rows[below], level + 1), (left[i] + 1, rows[~below], level + 1)]
    return Trees(base, np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), depth)


def held_out(key: str) -> F.Column:
    """Whether crc32 of the id's text leaves no remainder modulo ``FOLDS``; NULL ids are held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_FIT_ROWS) -> Trees:
    """Fit on the labelled rows outside the held-out fold, at most ``most`` of them.

    Rows with a NULL id or label teach nothing; an id with several labels teaches the
    label that most of them have (ties: 1).
    """
    told = labels.where(f"`{key}` IS NOT NULL AND `{label}` IS NOT NULL").where(~held_out(key))
    told = told.groupBy(F.col(f"`{key}`").alias("__key")).agg((F.avg(F.col(f"`{label}`").cast("double")) >= 0.5).cast("int").alias("__label"))
    told = bounded_sample(told, most, "__key")
    source = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(told), "__key")  # at most ``most`` rows
    names = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = statistics(*text_buffer(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), *[pa.array(got[:, i]) for i in range(got.shape[1])]],
                names=["key", "label", *[f"f{i}" for i in range(got.shape[1])]],
            )

    kind = source.schema["__key"].dataType.simpleString()
    table = map_slices(source.select(F.col("__text").cast("string").alias("__text"), "__key", "__label"), "__text", f"key {kind}, label int, {names}", work)
    # A repeated id may have several texts; the fit takes ``2 * most`` rows at most.
    rows = table.orderBy(F.xxhash64("key"), "key", *[f"f{i}" for i in range(len(FEATURES))]).limit(2 * most).toPandas()
    x = rows[[f"f{i}" for i in range(len(FEATURES))]].to_numpy(np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(np.float64))


def with_score(df: DataFrame, model: Trees, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (default: all) and the score ``name`` in [0, 1], higher for better texts.

    NULL and empty texts are scored from zero statistics.  Repeated rows get equal scores.  A
    column of the input that is called ``name`` is left out.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    model_arrays = share(df.sparkSession, model.arrays())
    columns = [F.col(f"`{c}`").cast("string").alias("__text") if c == text else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    named = df.select(*columns, *([] if text in keep else [F.col(f"`{text}`").cast("string").alias("__text")]))
    kept = [f for f in named.schema.fields if f.name != "__text" or text in keep]
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "__score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(*model_arrays.value)
        for batch in batches:
            score = trees.score(statistics(*text_buffer(batch.column("__text"))))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(score)], names=[*[f.name for f in kept], "__score"])

    scored = map_slices(named, "__text", fields, work)
    return scored.select(*[F.col("__text" if c == text else f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("__score").alias(name))
