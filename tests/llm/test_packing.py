import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from cases import TEXTS, documents, edge_rows, no_rows
from conftest import SF001
from tokenizers import Tokenizer

from tensio.llm import packing, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts):
    """Pieces are right, lie without gaps, and the sequences are few."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    library = Tokenizer.from_file(BYTES)
    want = defaultdict(list)
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want[i] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    return len(sequences), -(-sum(r.length for r in rows) // 1024)


def test_query(spark):
    n, least = check(queries.op5_best_fit_packing(spark, SF001).collect(), documents(spark, SF001).items())
    assert n <= least * 1.02 + 1


def test_merge_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BINS", 8)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").repartition(12)
    n, least = check(packing.pack(docs, BYTES, 2).collect(), documents(spark, SF001).items())
    assert n <= least * 1.06 + 2


def test_best_fit_takes_the_fullest_bin_that_fits():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 400)
    bins, places = packing.best_fit(sizes, 100)
    rooms = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [b for b, room in enumerate(rooms) if room >= sizes[i]]
        if fits:
            best = min(rooms[b] for b in fits)
            assert places[i] == 100 - best
            rooms[next(b for b in fits if rooms[b] == best)] -= sizes[i]
        else:
            rooms.append(100 - sizes[i])
            assert places[i] == 0
    assert bins.max() + 1 == len(rooms)


def test_edges(spark):
    check(packing.pack(edge_rows(spark), BYTES, 2).collect(), TEXTS)
    assert packing.pack(no_rows(spark), BYTES, 2).collect() == []
