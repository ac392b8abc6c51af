import random

import numpy as np
from cases import documents, edge_rows, no_rows
from conftest import SF001

from tensio.llm import decontaminate, queries


def plain_alignment(a, b):
    score = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            score[i + 1, j + 1] = max(0, score[i, j] + (2 if x == y else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
    return score.max()


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(1, 6, rng.integers(1, 14)), rng.integers(1, 6, rng.integers(1, 25))) for _ in range(200)]
    pad = lambda rows: np.array([[*r, *[0] * (max(map(len, rows)) - len(r))] for r in rows], np.uint64)
    a, b = zip(*pairs, strict=True)
    best, _ = decontaminate.align(pad(a), np.array(list(map(len, a))), pad(b), np.array(list(map(len, b))))
    assert best.tolist() == [plain_alignment(x, y) for x, y in pairs]


def test_query_finds_every_verbatim_copy(spark):
    texts = documents(spark, SF001)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x in t}
    rows = queries.op1_decontamination(spark, SF001).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.score == 1} == want and want
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})


def edited(rng, words, share, other):
    out = []
    for w in words:
        kind = rng.random()
        if kind < share * 0.6:
            out.append(rng.choice(other))
        elif kind < share * 0.8:
            out += [w, rng.choice(other)]
        elif kind >= share:
            out.append(w)
    return out


def cases(spark):
    rng = random.Random(6)
    texts = list(documents(spark, SF001).values())
    other = [w for t in texts[:20] for w in t.split()]
    benchmark = spark.read.parquet(f"{SF001}/benchmark.parquet")
    docs, leaks = [], set()
    for n, r in enumerate(benchmark.collect()):
        words = r.text.split()
        around = [rng.choice(other) for _ in range(60)], [rng.choice(other) for _ in range(80)]
        for k, share in enumerate((0.0, 0.08, 0.15)):
            body = edited(rng, words, share, other)
            if k == 1:
                body = [w.upper().strip(".,") for w in body]
            docs.append((n * 10 + k, " ".join([*around[0], *body, *around[1]])))
            leaks.add((n * 10 + k, r.item_id))
        docs.append((n * 10 + 5, " ".join([*around[0], *words[: len(words) // 3], *around[1]])))  # a third is no copy
        docs.append((n * 10 + 6, " ".join([*around[0], *around[1]])))
    return docs, leaks, benchmark


def test_edited_copies_are_found_and_clean_texts_left(spark, monkeypatch):
    docs, leaks, benchmark = cases(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert len(leaks - found) <= 0.03 * len(leaks) and not {i for i, _ in found} - {i for i, _ in leaks}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)  # the same, block by block
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()} == found
    kept = {r.doc_id for r in decontaminate.without_leaks(df, benchmark).collect()}
    assert {i for i, _ in docs if i % 10 in (5, 6)} <= kept and not kept & {i for i, _ in leaks if i % 10 == 0}


def test_edges(spark):
    docs = edge_rows(spark)
    benchmark = spark.createDataFrame([(1, "same text here for two rows same text here for two rows", "x"), (2, None, "x"), (3, "", "x"), (4, "One", "x"), (None, "a row without an id of some words", "x"),
                                       (5, "same text here for two rows same text here for two rows", "x")], "item_id long, text string, key string")
    rows = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in rows) == sorted([(i, k) for i in (7, 8, 8, 10) for k in (1, 5)] + [(0, 0)])
    kept = decontaminate.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 9]
    assert decontaminate.find_leaks(no_rows(spark), benchmark).collect() == []
    for nothing in (benchmark.where("false"), benchmark.where("text = ''")):
        assert decontaminate.find_leaks(docs, nothing).collect() == []
        assert decontaminate.without_leaks(docs, nothing).count() == 12


def test_copies_across_the_cuts_of_long_items(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (96, 97, 192, 300)}
    around = [f"other{k}" for k in range(50)]
    docs, want = [], set()
    for n, words in items.items():
        parts = -(-n // decontaminate.PASSAGE)
        least = int(0.6 * -(-n // parts)) + 2
        for begin in range(0, n - least + 1, 3):
            docs.append((len(docs), " ".join([*around, *words[begin : begin + least], *around])))
            want.add((len(docs) - 1, n))
    docs.append((len(docs), " ".join([*around, *items[192][38:152], *around])))
    want.add((len(docs) - 1, 192))
    docs += [(len(docs) + i, " ".join(around)) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    rows = decontaminate.find_leaks(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert decontaminate.without_leaks(df, benchmark).count() == 3


def test_repeated_items_are_sent_once(spark, monkeypatch):
    words = " ".join(f"w{k}" for k in range(30))
    benchmark = spark.createDataFrame([*[(i, words) for i in range(200)], (None, words), (500, "another " + words)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "nothing of it")], "doc_id long, text string")
    sent, cut = [], decontaminate.Passages.cut
    monkeypatch.setattr(decontaminate.Passages, "cut", lambda texts: sent.append(len(texts)) or cut(texts))
    rows = decontaminate.find_leaks(docs, benchmark).collect()
    assert sent == [2]
    assert sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in rows) == [(1, i) for i in [-1, *range(200), 500]]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()] == [2]
