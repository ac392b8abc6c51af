import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from cases import LONG, TEXTS, documents, edge_rows, no_rows
from conftest import SF001
from tokenizers import Tokenizer

from tensio.llm import piece_counts, queries
from tensio.llm.token_ids import Encoder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", "th", "'s", "'", "'ll", " ", "  ", "   ", "\n", "\t", " ", "　", " ", "\x85", "1", "23", ".", ",", "!!", "|", "$", "▁", "<|endoftext|>", "<|endof", "text|>", "<s>", "</s>",
         "<0x41>", "梦", "\U0001f600", "\x1c", "\x00", "the", " the", "\r\n", "²", "ü,", "×,", "÷.", "»,", "Œ;", "aaaa", "====", "----"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " " * 500, "a" * 2000, "=-" * 300, "\n\n", " a", "a "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_of_random_texts(library):
    table = piece_counts.PieceTable(PIECES)
    for t in random_texts(1500, 3):
        tokens, _ = piece_counts._pretokens(*piece_counts.text_buffer(pa.array([t])))
        assert piece_counts._count(table, tokens.to_pylist()).sum() == len(library.encode(t)), repr(t)


def test_count_query(spark, library):
    texts = documents(spark, SF001)
    rows = queries.op2_token_counts(spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_count_edges(spark, library):
    rows = piece_counts.with_token_counts(edge_rows(spark), PIECES).collect()
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows))
    assert got == sorted((i or 0, len((t or "").encode()), len(library.encode(t or ""))) for i, t in TEXTS)
    assert rows[0].key == "extra" and LONG
    assert piece_counts.with_token_counts(no_rows(spark), PIECES).collect() == []


def test_ids_of_random_texts():
    texts = random_texts(6000, 7)
    encoder, library = Encoder(BYTES), Tokenizer.from_file(BYTES)
    assert encoder.apart
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for t, a, b, e in zip(texts, ends - counts, ends, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids[a:b].tolist() == e.ids, repr(t)


def test_other_tokenizer_files_see_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    texts = random_texts(200, 9)
    ids, counts = encoder.encode(pa.array([*texts, None]))
    assert not encoder.apart and counts[-1] == 0
    assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_long_sequences_equal_the_library():
    """Texts without spaces: letters, characters beyond ASCII, repeats; also many of them at once."""
    import random
    import time

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    from tensio.llm import piece_counts as P

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, table = sentencepiece.SentencePieceProcessor(model_file=path), P.PieceTable(path)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (1500, 4000, 20_000)]
    texts += ["the" * 3000, "a" * 5001, "=" * 2000, "".join(rng.choices("梦想家的é日本語한", k=3000)), "".join(rng.choices("etaoin ", k=4000)), "x" * 1025 + "é" * 1030]
    data, offsets = P.text_buffer(pa.array(texts))
    tokens, counts = P._pretokens(data, offsets)
    each = P._count(table, tokens.to_pylist())
    edge = np.concatenate([[0], np.cumsum(counts)])
    run = np.concatenate([[0], np.cumsum(each)])
    assert (run[edge[1:]] - run[edge[:-1]]).tolist() == [len(library.encode(t)) for t in texts]
    start = time.time()
    P._count(table, [b" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)).encode()])
    assert time.time() - start < 20


def test_memory_is_bounded_by_bytes(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from tensio.llm import token_ids

    monkeypatch.setattr(token_ids, "MEMORY_BYTES", 100_000)
    encoder = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(20):
        texts = ["".join(chr(0x4E00 + (i * 7919 + j * 31 + k) % 8000) for k in range(700)) for j in range(10)]
        ids, counts = encoder.encode(pa.array(texts))
        assert len(ids) == counts.sum() and encoder.held < 400_000
        assert counts.tolist() == [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
