import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import TEXTS, documents, edge_rows, no_rows
from conftest import SF001

from tensio.llm import language_model as L
from tensio.llm import queries


PRIOR = 20.0


def brute(texts):
    """Base figures, and the score of the same model with exact counts of all words and bigrams."""
    words = [(i, bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()) for i, t in texts]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in words}
    count, pairs = Counter(), Counter()
    for i, w in words:
        if not held[i]:
            line = ["<s>", *w, "</s>"]
            count.update(line[1:])
            pairs.update(zip(line, line[1:], strict=False))
    total, mass = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    out = []
    for i, w in words:
        line = [*w, "</s>"]
        base = sum(math.log10((count[x] + 0.1) / mass) for x in line)
        model = 0.0
        for a, b in zip(["<s>", *line], line, strict=False):
            met = count["</s>"] if a == "<s>" else count[a]
            model += math.log10((pairs[a, b] + PRIOR * (count[b] + 0.1) / mass) / (met + PRIOR))
        out.append((i, held[i], len(line), sum(count[x] > 0 for x in line), total, base, model))
    return out


def check(rows, texts, apart):
    want = brute(texts)
    order = lambda r: (r[0] is None, r[0], r[2], r[5])
    rows = sorted(map(tuple, rows), key=order)
    assert len(rows) == len(want)
    for r, w in zip(rows, sorted(want, key=order), strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert abs(r[6] - w[6]) <= apart * w[2]  # counts are kept as powers of 1.25, with rare false hits


def test_query(spark):
    rows = queries.op6_lm_scoring(spark, SF001).collect()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    check(rows, documents(spark, SF001).items(), 0.05)
    fold = [r for r in rows if r.held_out]
    assert sum(r.score for r in fold) > sum(r.base_score for r in fold)


def test_edges(spark):
    check(L.with_scores(edge_rows(spark)).collect(), TEXTS, 0.05)
    assert L.with_scores(no_rows(spark)).collect() == []
    held = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = L.with_scores(held).collect()  # nothing to learn from
    assert {(r.train_tokens, r.n_known, r.held_out) for r in rows} == {(0, 0, True)} and all(math.isfinite(r.score) for r in rows)


def test_filter_reads_back_levels():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 48, 4000, np.uint64))
    levels = rng.integers(1, 12, len(keys))
    buckets = 4
    mine = L._buckets(keys << np.uint64(16), buckets)
    bits = np.concatenate([L.segment(keys[mine == b], levels[mine == b], 17) for b in range(buckets)])
    got = L.probe(bits, 17, buckets, keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    other = rng.integers(0, 1 << 48, 4000, np.uint64)
    assert (L.probe(bits, 17, buckets, other) == 0).mean() > 0.97


def test_level_means():
    counts = np.arange(1, 3000)
    mean = L._MEANS[L._levels(counts)]
    assert mean[:3].tolist() == [1, 2, 3] and (np.abs(mean - counts) <= 0.26 * counts).all()


def docs_of(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")


def test_many_passes(spark, monkeypatch):
    """One segment a pass, one bucket a folder, many small buckets."""
    for name, value in {"GROUP_BYTES": 1, "FOLDER_BUCKETS": 1, "BUCKET_BYTES": 20_000}.items():
        monkeypatch.setattr(L, name, value)
    sent = []
    share = L.share
    monkeypatch.setattr(L, "share", lambda s, v: sent.append(v) or share(s, v))
    check(L.with_scores(docs_of(spark)).collect(), documents(spark, SF001).items(), 0.05)
    assert len(sent) >= 20 and all(len(group) == 1 for group in sent)


def test_passes_are_bounded():
    segments = [(b, 16 + b % 9) for b in range(300)]
    passes = L.filter_passes(segments)
    assert [b for p in passes for b in p] == list(range(300))
    assert all(len(p) == 1 or sum(1 << (16 + b % 9 - 3) for b in p) <= L.GROUP_BYTES for p in passes)
    assert all(1 << L.segment_log(n) >= L.BITS_PER_ENTRY * n for n in (0, 1, 10**6, 10**9, 10**11))


def test_scores_come_from_the_filter(spark, monkeypatch):
    """An empty filter leaves the base score's counts alone, and none of the model's."""
    want = {r.doc_id: r for r in L.with_scores(docs_of(spark)).collect()}
    monkeypatch.setattr(L, "_probed", lambda summed, probed=L._probed: probed(summed.withColumn("bits", L.F.expr("if(bits is null, null, cast(repeat(char(0), length(bits)) as binary))"))))
    empty = {r.doc_id: r for r in L.with_scores(docs_of(spark)).collect()}
    assert all(empty[i].base_score == r.base_score and empty[i].n_known == r.n_known for i, r in want.items())
    assert sum(abs(empty[i].score - r.score) > 0.5 * r.n_tokens for i, r in want.items()) > 0.9 * len(want)


def test_probabilities_sum_to_one(spark):
    """Over all words that may follow, for every word, from the scores of two-word texts."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)]
    learnt = [(i, " ".join(rng.choice(words, 30, p=np.arange(1, 13) / 78))) for i in range(1, 400) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(10**6, 10**6 + 4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    probes = [(a, b) for a in words for b in words]
    texts = learnt + [(i, f"{a} {b}") for i, (a, b) in zip(held, probes, strict=False)] + [(i, a) for i, a in zip(held[len(probes) :], words, strict=False)]
    score = {r.doc_id: r.score for r in L.with_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    pair = {p: score[i] for i, p in zip(held, probes, strict=False)}
    one = {a: score[i] for i, a in zip(held[len(probes) :], words, strict=False)}
    # log p(a b) - log p(a) = log p(b|a) + log p(end|b) - log p(end|a); p(end|a) is found from the counts.
    count, last = Counter(w for _, t in learnt for w in t.split()), Counter(t.split()[-1] for _, t in learnt)
    mass = sum(count.values()) + len(learnt) + 0.1 * (len(count) + 2)
    end = {a: (last[a] + PRIOR * (len(learnt) + 0.1) / mass) / (count[a] + PRIOR) for a in words}
    for a in words:
        total = end[a] + sum(10 ** (pair[a, b] - one[a]) * end[a] / end[b] for b in words)
        assert abs(total - 1) < 0.2, (a, total)


def test_bigrams_met_once_count(spark):
    """Against exact counts of all bigrams, on texts whose bigrams training has met once."""
    texts = [(i, " ".join(f"w{(i * 37 + k * (i + 1)) % 97}" for k in range(40))) for i in range(1, 61)]
    learnt = [t.split() for i, t in texts if zlib.crc32(str(i).encode()) % 10]
    count, pairs = Counter(), Counter()
    for w in learnt:
        count.update([*w, "</s>"])
        pairs.update(zip(["<s>", *w], [*w, "</s>"], strict=True))
    mass = sum(count.values()) + 0.1 * (len(count) + 1)
    assert sum(n == 1 for n in pairs.values()) > 0.5 * len(pairs)
    for r in L.with_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        w = dict(texts)[r.doc_id].split()
        met = {**count, "<s>": len(learnt)}
        want = sum(math.log10((pairs[a, b] + L.PRIOR * (count[b] + 0.1) / mass) / (met[a] + L.PRIOR)) for a, b in zip(["<s>", *w], [*w, "</s>"], strict=True))
        assert abs(r.score - want) <= 0.05 * r.n_tokens


def test_columns_are_cut_and_read_back():
    rng = np.random.default_rng(8)
    values = rng.choice(np.array([0, 1, 254, 255, 256, 1 << 40], np.uint64), 500)
    sizes = rng.integers(0, 9, 100)
    edges = np.append(0, np.cumsum(sizes))
    values = values[: edges[-1]]
    low, large = L._cut_small(values, edges)
    parts = [(0, 0), (0, 37), (37, 1), (38, 62)]
    assert L._uncut_small([low.slice(*p) for p in parts], [large.slice(*p) for p in parts]).tolist() == values.tolist()
    back, each = L._uncut([L._cut(values, edges).slice(*p) for p in parts], np.uint64)
    assert back.tolist() == values.tolist() and each.tolist() == sizes.tolist()
    assert [len(x) for x in L._uncut([], np.uint8)] == [0, 0]
    places = np.concatenate([np.arange(3, 2000, 7), [0, 0, 5], np.arange(50)])
    assert L._from_places(L._places_planes(places)).tolist() == places.tolist()


def test_a_bucket_is_one_row(spark):
    """However many chunks there are, each n-gram of a bucket is stored, and probed, once."""
    buckets, n = 6, 40
    texts = [(i, " ".join(f"w{(i * 37 + k * (i + 1)) % 97}" for k in range(60)), i % 3 == 0) for i in range(n)]
    df = spark.createDataFrame(texts, "key long, __text string, held boolean").repartition(n, "key").select("__text", "key", "held")
    chunks = L._coded(df).cache()
    assert chunks.count() > 2 * buckets
    rows = L._summed(L._dealt(chunks, buckets)).collect()
    assert sorted(r.bucket for r in rows) == list(range(buckets))
    count, pairs, words = Counter(), set(), set()
    for _, t, held in texts:
        words |= set(t.split())
        pairs |= set(zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True))
        count.update([] if held else t.split())
    assert sum(len(L._from_sorted(r.words)) for r in rows) == len(words)
    assert sum(len(L._from_sorted(r.pairs)) for r in rows) == len(pairs)
    assert sorted(np.concatenate([L._from_planes(r.times, np.int64) for r in rows])) == sorted(count[w] for w in words)
    assert sum(r.total for r in rows) == count.total() and sum(r.kinds for r in rows) == len(count)


def test_segments_do_not_stay(spark, monkeypatch):
    """The files of a pass's broadcast go with the pass: the segments together have no bound."""
    sent = []
    share = L.share
    monkeypatch.setattr(L, "share", lambda s, v: sent.append(share(s, v)) or sent[-1])
    L.with_scores(docs_of(spark)).collect()
    assert sent and not any(os.path.exists(b._path) for b in sent)


def test_chunks_longer_than_a_batch(spark):
    """A chunk's rows may fill several batches, with none of its first row in the last ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        check(L.with_scores(edge_rows(spark)).collect(), TEXTS, 0.05)
    finally:
        spark.conf.set(name, before)


def test_shuffles_do_not_stay(spark, monkeypatch):
    """What buckets are summed from is gone when they are written."""
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    seen = []
    dealt, probed = L._dealt, L._probed

    def until_none(summed):
        for _ in range(50):  # files go in the background
            if not (left := shuffles() - seen[0]):
                break
            time.sleep(0.1)
        seen.append(left)
        return probed(summed)

    monkeypatch.setattr(L, "_dealt", lambda chunks, buckets: seen.append(shuffles()) or dealt(chunks, buckets))
    monkeypatch.setattr(L, "_probed", until_none)
    L.with_scores(docs_of(spark))
    assert seen[1] == set()
