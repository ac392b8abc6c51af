import hashlib
import random
from collections import Counter

from cases import TEXTS, documents, edge_rows, no_rows, same_rows
from conftest import SF001

from tensio.llm import queries, substrings


def brute(texts):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def rows(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()]


def test_query_equals_brute_force(spark):
    got = [tuple(r) for r in queries.op8_substring_dedup(spark, SF001).collect()]
    same_rows(got, [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(documents(spark, SF001).items())])


def planted():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(n) for n in (34, 35, 36, 50, 120)]
    texts = []
    for i in range(80):
        w = words(rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        texts.append((i, rng.choice([" ", "\n"]).join(w)))
    texts.append((80, " ".join(["again"] * 100)))  # a window that repeats within its own text
    texts.append((81, " ".join(["ab", "cd"] * 18)))
    return texts


def test_planted_passages(spark):
    texts = planted()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    same_rows(rows(substrings.drop_repeated(df)), brute(texts))


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_sketch_log", lambda df, text: 6)
    monkeypatch.setattr(substrings, "GATHER", 500)
    texts = planted()
    same_rows(rows(substrings.drop_repeated(spark.createDataFrame(texts, "doc_id long, text string"))), brute(texts))


def test_edges(spark):
    got = substrings.drop_repeated(edge_rows(spark), keep_text=True)
    same_rows([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], brute(TEXTS))
    first = got.where("doc_id = 4").first()
    assert first.th == first.key == "extra" and first.text == "One"
    assert rows(substrings.drop_repeated(no_rows(spark))) == []
