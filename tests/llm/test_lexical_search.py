import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import LONG, edge_rows, no_rows
from conftest import SF001

from tensio.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=50):
    """``docs``: (key, text), ``items``: (key, text); every document scored for every item."""
    found = [(k, Counter(TERM.findall((t or "").translate(LOWER)))) for k, t in docs]
    found = [(k, c) for k, c in found if c]
    total, n_docs = sum(sum(c.values()) for _, c in found), len(found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for k, t in items:
        wanted[k] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for key, c in found:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((key, score))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0]))
        out += [(item, i, key, score) for i, (key, score) in enumerate(scored[:top], start=1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    result = queries.op12_lexical_search(spark, SF001)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(result) == brute(docs, items)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(rng.randint(0, n // 2), " ".join(rng.choices(words, k=rng.choice([1, 3, 8, 8, 8, 30, 200])))) for _ in range(n)]
    copies = docs[0][1]
    docs += [(n + i, copies) for i in range(n // 3)]  # one stratum holds a crowd of equal scores
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 20])))) for i in range(25)] + [(3, "W1 w2"), (None, "w1"), (90, copies), (91, ""), (92, None), (93, "nowhere")]
    return docs, items


def test_small_pieces_equal_brute_force(spark, monkeypatch):
    """Strata in many pieces and shards, so bounds and cuts of every kind are met; items in blocks."""
    for name, value in {"ROW_POSTINGS": 60, "ROW_DOCS": 20, "SHARD_POSTINGS": 300, "FIRST_VISIT": 4, "GROWTH": 2, "BLOCK_BYTES": 400}.items():
        monkeypatch.setattr(lexical_search, name, value)
    for seed, top in ((1, 50), (2, 5), (3, 1)):
        docs, items = corpus(seed, 600)
        result = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id int, text string"), top=top)
        assert got(result) == brute(docs, items, top)


def test_index_holds_every_posting(spark):
    docs, items = corpus(5, 400)
    frame = spark.createDataFrame(docs, "key long, text string")
    wanted = lexical_search.Items.of(pa.array([i for i, _ in items]), pa.array([t for _, t in items]))
    counted = lexical_search._counted(frame, lexical_search.share(spark, wanted.vocabulary)).cache()
    n_docs, n_terms = len(docs), sum(len(t.split()) for _, t in docs)
    index = lexical_search.build_index(counted, n_docs, n_terms).collect()
    postings = Counter()
    for r in index:
        assert len(set(zip(r.term, r.tf, strict=True))) == len(r.term)
        for term, tf, first, last in zip(r.term, r.tf, [0, *r.ends[:-1]], r.ends, strict=True):
            postings.update((r.m, r.keys[d], term, tf) for d in r.docs[first:last])
    want = Counter((50 + 50 * r.n * n_docs // n_terms, r.key, term, tf) for r in counted.collect() for term, tf in zip(r.terms, r.tfs, strict=True))
    assert postings == want


def test_bounds_leave_strata_out(monkeypatch):
    """Strata below the bound are not added up: the visits stop."""
    monkeypatch.setattr(lexical_search, "FIRST_VISIT", 20)
    monkeypatch.setattr(lexical_search, "GROWTH", 2)
    keys = pa.array([[i] for i in range(200)], pa.list_(pa.int64()))
    rows = pa.table({"m": np.arange(60, 260), "keys": keys, "term": [[0]] * 200, "tf": [[1]] * 200, "ends": [[1]] * 200, "docs": [[0]] * 200})
    shard = lexical_search.Shard(rows, 1)
    shard.ends[150:] = 10**9  # reading these would fail
    kept, scores = shard.best(np.array([0]), np.array([7]), 1, 5)
    assert shard.keys.take(pa.array(kept)).to_pylist() == [0, 1, 2, 3, 4]
    assert scores.tolist() == [7 * (10**9 // (1000 + 20 * m)) for m in range(60, 65)]


def test_edges(spark):
    docs = edge_rows(spark)
    items = spark.createDataFrame([("a", "text row THIS"), ("b", None), ("c", "word1 é 梦"), ("a", "same")], "item_id string, text string").selectExpr("*", "'x' as score", "'y' as `rank`")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(lexical_search.search(docs, items)) == want
    assert any(len(LONG) and r[2] == 6 for r in want)
    for d, i in ((no_rows(spark), items), (docs, items.where("false")), (no_rows(spark), items.where("false"))):
        empty = lexical_search.search(d, i)
        assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
