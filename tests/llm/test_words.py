import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tensio.llm import words as W
from tensio.llm.batches import slices, text_buffer

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t 梦.,x", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.booleans())
def test_split_equals_bytes_split(texts, lower):
    w = W.split(*text_buffer(pa.array(texts, pa.string())), lower=lower)
    raw = w.data.tobytes()
    got = [[raw[a:b] for a, b in zip(w.starts[f:t], w.ends[f:t], strict=True)] for f, t in zip(w.first[:-1], w.first[1:], strict=True)]
    want = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()) if lower else (t or "").encode() for t in texts]
    assert got == [t.split() for t in want]
    assert w.chars().tolist() == [len(x.decode()) for d in got for x in d]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_equal_ngrams_and_only_those_share_a_hash(texts, n):
    w = W.split(*text_buffer(pa.array(texts, pa.string())))
    raw, h = w.data.tobytes(), W.ngrams(w.hashes(), n)
    seen = {}
    for i in np.flatnonzero(w.room() >= n):
        gram = tuple(raw[w.starts[j] : w.ends[j]] for j in range(i, i + n))
        assert seen.setdefault(int(h[i]), gram) == gram
    assert len(set(seen.values())) == len(seen)


def test_repeated_and_covered():
    keys = np.array([5, 7, 5, 9, 7, 1], np.uint64) << np.uint64(40)
    assert W.repeated(keys).tolist() == [True, True, True, False, True, False]
    assert W.covered(np.array([1, 0, 0, 0, 1, 0], bool), 2).tolist() == [True, True, False, False, True, True]


def test_lines():
    data, offsets = text_buffer(pa.array(["a\nb\na", "", "\n\nb\n", None, "b"]))
    ln = W.lines(data, offsets)
    raw = data.tobytes()
    assert [(d, raw[a:b]) for d, a, b in zip(ln.doc, ln.starts, ln.ends, strict=True)] == [(0, b"a"), (0, b"b"), (0, b"a"), (2, b""), (2, b""), (2, b"b"), (4, b"b")]
    assert ln.hash[0] == ln.hash[2] != ln.hash[1] == ln.hash[5] == ln.hash[6]


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "y" * 500, "", "z"]), pa.array([1, 2, 3, 4, 5])], names=["t", "i"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "t", 100))
    assert [i for p in parts for i in p.column(1).to_pylist()] == [1, 2, 3, 4, 5] and len(parts) > 1
