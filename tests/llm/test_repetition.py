import re
from collections import Counter

from cases import LONG, documents, edge_rows, no_rows
from conftest import SF001

from tensio.llm import queries, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup, lines, dup_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            dup_chars += len(line) if line in seen else 0
            seen.add(line)
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    bad = dup > 0.30 * lines or dup_chars > 0.20 * chars
    for n, share in repetition.MAX_COVERAGE.items():
        met, covered = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in met:
                covered |= set(range(i, i + n))
            met.add(g)
        bad = bad or sum(len(words[i]) for i in covered) > share * chars
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed, not failed and not bad


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_query_equals_brute_force(spark):
    texts = documents(spark, SF001)
    rows = queries.op10_quality_rules(spark, SF001).collect()
    assert len(rows) == len(texts) and {r.kept for r in rows} == {True, False}
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])


def test_edges(spark):
    rows = repetition.with_verdict(repetition.with_repetition(edge_rows(spark))).collect()
    assert len(rows) == 12 and {"key", "hash", "n tokens.x"} <= set(rows[0].asDict())
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert (by[i].n_words, by[i].word_chars, by[i].base_failed, by[i].kept) == (0, 0, True, False)
    assert tuple(by[6][c] for c in COLUMNS) == brute(LONG)
    assert by[7].asDict() | {"doc_id": 8} == by[8].asDict()
    assert repetition.with_verdict(repetition.with_repetition(no_rows(spark))).collect() == []
