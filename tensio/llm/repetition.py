"""Quality rules by repetition coverage (rolling hashes of several n-gram lengths)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.llm import words as W
from tensio.llm.batches import text_buffer, with_results

#: Largest share of word characters inside n-grams equal to an earlier one of
#: the text, for n of 5 to 10, and of lines (and their characters) equal to an earlier line.
MAX_COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_DUP_LINES = 0.30
MAX_DUP_LINE_CHARS = 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_U = np.uint64

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, dup_line_chars long, n_repeat_words long, " + ", ".join(
    f"dup_chars_{n} long" for n in MAX_COVERAGE
)


def _within_text(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same text."""
    return W.mix(hashes ^ (doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of ``MEASURES`` for every text of the buffer."""
    n = len(offsets) - 1
    w = W.split(data, offsets)
    chars, doc, room = w.chars(), w.doc, w.room()
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {"n_words": w.counts, "word_chars": W.by_doc(chars, w.first), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    ln = W.lines(data, offsets)
    filled = np.searchsorted(w.starts, ln.ends) > np.searchsorted(w.starts, ln.starts)
    key, line_doc = _within_text(ln.hash[filled], ln.doc[filled]), ln.doc[filled]
    order = np.argsort(key, kind="stable")
    dup = np.zeros(len(key), bool)
    dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = (lead[ln.ends] - lead[ln.starts])[filled]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[dup], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc[dup], weights=size[dup], minlength=n).astype(np.int64)

    h = w.hashes()
    at = np.flatnonzero(room >= 3)
    grams, length = W.ngrams(h, 3)[at], 3
    for longer in (3, *MAX_COVERAGE):
        # A repeated n-gram starts where a repeated shorter one starts, so each length only
        # looks at the starts that the length before it found, and extends their hashes.
        inner = room[at] >= longer
        at, grams = at[inner], grams[inner]
        for step in range(length, longer):
            grams = W.joined(grams, h[at + step])
        length = longer
        key = _within_text(grams, doc[at])
        twice = W.repeated(key)
        at, grams, key = at[twice], grams[twice], key[twice]
        flagged = np.zeros(len(h), bool)
        if longer == 3:
            flagged[at] = True
            out["n_repeat_words"] = W.by_doc(W.covered(flagged, longer), w.first)
        else:
            order = np.argsort(key, kind="stable")
            later = np.zeros(len(key), bool)
            later[order[1:]] = key[order[1:]] == key[order[:-1]]
            flagged[at[later]] = True
            out[f"dup_chars_{longer}"] = W.by_doc(chars * W.covered(flagged, longer), w.first)
    return out


def with_repetition(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but ``text``) and the columns of ``MEASURES``.

    One pass, no shuffle; memory is bounded by a text slice or the longest single text.
    NULL and empty texts measure 0 everywhere.  Columns of the input that share a name with
    a measure are left out.
    """
    names = [f.split()[0] for f in MEASURES.split(", ")]

    def start():
        def compute(texts: pa.Array) -> list[pa.Array]:
            got = measure(*text_buffer(texts))
            return [pa.array(got[c].astype(np.int64)) for c in names]

        return compute

    return with_results(df, text, [c for c in df.columns if c != text] if keep is None else keep, MEASURES, start)


def with_verdict(measured: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the columns of ``with_repetition``.

    A text is kept if it has 50 words or more, at most half of its words lie in repeated
    3-word windows, and no coverage exceeds its share.
    """
    c = F.col
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    worse = (c("n_dup_lines") > MAX_DUP_LINES * c("n_lines")) | (c("dup_line_chars") > MAX_DUP_LINE_CHARS * c("word_chars"))
    for n, share in MAX_COVERAGE.items():
        worse = worse | (c(f"dup_chars_{n}") > share * c("word_chars"))
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~worse})
