import random
import re
from collections import Counter, defaultdict

from cases import LONG, edge_rows, no_rows
from conftest import SF001

from tensio.llm import queries, source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=30, top=50):
    """``rows``: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = sorted(s for x, s in counts if x == lang)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in groups}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in groups}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in groups) + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            words = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", words)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked[: top if part == "term" else None], start=1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("lang", "source", "text").collect()]
    want = brute(rows)
    assert got(queries.op13_source_audit(spark, SF001)) == want
    assert {r[2] for r in want} == {"pair", "term"}


def some_rows(seed, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "É", "y1z", "-q-Q", "梦", "", "X'x")]
    rows = []
    for _ in range(n):
        size = rng.choice([0, 1, 5, 40])
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", " ", "\t\t"]) for _ in range(size))
        text = text.upper() if rng.random() < 0.2 else text
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "", None, "é", "zz"]), rng.choice([text, text, text, None])))
    return rows


def test_random_texts_equal_brute_force(spark, monkeypatch):
    """Small blocks and tiles, small slices, several thresholds: terms of several chunks near the threshold."""
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", 7)
    monkeypatch.setattr(source_audit, "TILE", 2)
    for seed, least in ((1, 30), (2, 12), (3, 2), (4, 1)):
        rows = some_rows(seed)
        df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
        assert got(source_audit.audit(df, min_docs=least, top=4)) == brute(rows, least, 4)


def test_terms_whose_documents_must_be_compared(spark):
    """29 documents with "Word" and 29 with "word,": 30 or more only if not the same ones."""
    both = [("en", "a", "Word word, other")] * 29
    apart = [("fr", "a", "Word other")] * 29 + [("fr", "b", "word, other")] * 29 + [("fr", "a", "other")] * 9 + [("de", "a", "Word")] * 15 + [("de", "b", "word,")] * 15 + [("es", "a", "Word")] * 15 + [("es", "b", "word")] * 14
    rows = both + apart
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    result = got(source_audit.audit(df))
    assert result == brute(rows)
    assert not any(r[2] == "term" for r in result if r[0] in ("en", "es"))
    assert any(r[3] == "word" for r in result if r[0] == "fr")


def test_edges(spark):
    rows = edge_rows(spark).selectExpr("*", "key as source", "cast(null as string) as lang", "'x' as term", "'y' as `count`")
    result = got(source_audit.audit(rows, min_docs=2))
    want = brute([(None, "extra", r.text) for r in rows.select("text").collect()], 2)
    assert result == want
    assert source_audit.audit(no_rows(spark).selectExpr("*", "key as source", "key as lang")).collect() == []


def test_one_very_long_chunk(spark):
    text = "Ab1cd2" * 50_000
    rows = [("en", "a", text), ("en", "b", "ab " + LONG), ("en", "b", "ef")]
    assert got(source_audit.audit(spark.createDataFrame(rows, "lang string, source string, text string"), min_docs=1)) == brute(rows, 1)
