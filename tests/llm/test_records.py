import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, documents, edge_rows, no_rows
from conftest import SF001
from tokenizers import Tokenizer

from tensio.llm import queries, records

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    rng = np.random.default_rng(1)
    parts = [b"123456789", b"", b"\0", b"\0" * 600, *[rng.integers(0, 256, n, np.uint8).tobytes() for n in (1, 3, 511, 512, 513, 1024, 5000)]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = records.crc32c(data, offsets)
    assert got[0] == 0xE3069283 and got.tolist() == [slow_crc32c(p) for p in parts]


def ids_of(texts):
    return [np.array([*e.ids, 2], "<u4") for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]


def test_query_equals_brute_force(spark):
    texts = sorted(documents(spark, SF001).items())
    want, at = set(), 0
    for (i, _), ids in zip(texts, ids_of([t for _, t in texts]), strict=True):
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    rows = queries.op3_token_records(spark, SF001).collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(texts)


def test_round_trip_in_any_order_and_damage(spark, tmpdir_path):
    index = records.write_records(edge_rows(spark), f"file:{tmpdir_path}/r", BYTES, 2, files=3)
    got = sorted((r.key or 0, bytes(r.ids)) for r in records.read_records(index).collect())
    assert got == sorted((i or 0, x.tobytes()) for (i, _), x in zip(TEXTS, ids_of([t or "" for _, t in TEXTS]), strict=True))
    one = index.where("key = 5")
    assert [bytes(r.ids) for r in records.read_records(one).collect()] == [ids_of(["Two words"])[0].tobytes()]
    row = one.first()
    path = row.file.removeprefix("file:")
    raw = bytearray(open(path, "rb").read())
    assert int.from_bytes(raw[row.offset : row.offset + 8], "little") == row.size
    raw[row.offset + 12] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(one).collect()


def test_order_and_empty(spark, tmpdir_path):
    rows = records.with_start(records.read_records(records.write_records(edge_rows(spark), f"{tmpdir_path}/a", BYTES, 2, files=2))).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.key for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    assert records.with_start(records.read_records(records.write_records(no_rows(spark), f"{tmpdir_path}/b", BYTES, 2))).collect() == []
    assert not os.path.exists(f"{tmpdir_path}/b/data")
