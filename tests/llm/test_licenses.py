import random
import re
from re import _constants as C
from re import _parser

from cases import LONG, documents, edge_rows, no_rows
from conftest import SF001, SF01

from tensio.llm import license_rules, licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = license_rules.all_rules()


def places(words, phrase):
    want = phrase.split()
    return [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]


def matches(text):
    """Every rule on the whole text, without gates; suppression by comparing all pairs."""
    words = WORD.findall((text or "").translate(LOWER))
    body = "".join(f" {w} " for w in words)
    found = []
    for r in RULES:
        for m in re.finditer(license_rules.spaced(r.pattern), body):
            found.append((r.label, r.number, r.priority, body[: m.start()].count(" ") // 2, body[: m.end()].count(" ") // 2))

    def beaten(d, e):
        inside = e[3] <= d[3] and e[4] >= d[4]
        longer = e[4] - e[3] > d[4] - d[3]
        return inside and (e[2] <= d[2] if longer else (e[2], e[1]) < (d[2], d[1]))

    return words, [(*d, not any(beaten(d, e) for e in found if e is not d)) for d in found]


def digest(text):
    words, found = matches(text)
    at = {p: places(words, p) for p in licenses.BASE}
    every = [i for p in at for i in at[p]]
    base = {licenses.BASE[p] for p in at if at[p]}
    labels = base | {f[0] for f in found if f[5]}
    score = max([licenses.WEIGHTS[f[2]] for f in found if f[5]], default=0.0)
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def samples(tree, rng):
    """A text that a rule's pattern matches."""
    out = ""
    for op, arg in tree:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.NOT_LITERAL:
            out += rng.choice("qz")
        elif op is C.IN:
            options = [chr(c) for o, a in arg for c in (range(a[0], a[1] + 1) if o is C.RANGE else [a])]
            out += rng.choice(options)
        elif op is C.SUBPATTERN:
            out += samples(arg[3], rng)
        elif op is C.BRANCH:
            out += samples(rng.choice(arg[1]), rng)
        else:
            low, high, inner = arg
            out += "".join(samples(inner, rng) for _ in range(rng.randint(low, min(high, low + 3))))
    return out


def test_every_match_holds_its_gate_and_a_root():
    rng = random.Random(3)
    assert len(RULES) > 300
    for rule in RULES:
        tree = _parser.parse(license_rules.spaced(rule.pattern))
        for _ in range(30):
            text = samples(tree, rng)
            assert license_rules.spaced(rule.gate) in text, rule
            assert any(licenses.spaced_root(root) in text for root in licenses.ROOTS), rule


def test_query_equals_brute_force(spark):
    for sf, every in ((SF001, True), (SF01, False)):
        texts = documents(spark, sf)
        rows = queries.op11_license_scan(spark, sf).collect()
        assert len(rows) == len(texts)
        for r in rows:
            if every or "licen" in texts[r.doc_id].lower() or r.labels:
                assert row(r) == digest(texts[r.doc_id]), r.doc_id
    assert {"mit", "apache", "gpl"} <= {b for r in rows for b in r.base_labels.split(",")}


def test_samples_of_all_rules_equal_brute_force(spark):
    """Texts made of several rules' samples, words between them or none, cased and punctuated at random."""
    rng = random.Random(8)
    texts = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(samples(_parser.parse(license_rules.spaced(rng.choice(RULES).pattern)), rng))
            parts.append(" word " * rng.randint(0, 2))
        words = [w.upper() if rng.random() < 0.2 and w.isascii() else w for w in "".join(parts).split()]
        texts.append((i, "".join(w + rng.choice([" ", "-", ",\n", ". ", "/", "  "]) for w in words)))
    got = licenses.with_digest(licenses.with_licenses(spark.createDataFrame(texts, "doc_id long, text string"))).collect()
    by = dict(texts)
    assert len(got) == len(texts)
    for r in got:
        assert row(r) == digest(by[r.doc_id]), by[r.doc_id]


def test_overlaps(spark):
    texts = [
        (0, "Licensed under the Apache License, Version 2.0."),
        (1, "GNU Lesser General Public License, version 2.1"),
        (2, "the MIT License and, once more, the mit LICENSE; SPDX-License-Identifier: GPL-2.0-or-later"),
        (3, "mitlicense mit. licenses MİT LICENSE"),
        (4, "All rights reserved."),
        (5, "MIT licensé mit-license mit_license mit2 license"),
    ]
    found = licenses.with_licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    by = {r.doc_id: r for r in licenses.with_digest(found).collect()}
    assert (by[0].base_labels, by[0].labels, by[0].n_base, by[0].first_word) == ("apache", "apache,apache-2.0,license-hint", 1, 3)
    assert (by[1].base_labels, by[1].labels) == ("gpl", "gpl,lgpl-2.1")
    assert (by[2].n_base, by[2].first_word, by[2].last_word, by[2].labels, by[2].score) == (2, 1, 7, "gpl-2.0-or-later,mit", 1.0)
    assert (by[3].n_base, by[3].first_word, by[3].labels, by[3].score) == (0, None, "", 0.0)
    assert (by[4].labels, by[4].score) == ("all-rights-reserved", 0.2)
    assert (by[5].n_base, by[5].first_word, by[5].last_word) == (2, 2, 4)
    spans = {r.doc_id: r.licenses for r in found.collect()}
    assert [(m.label, m.first_word, m.end_word) for m in spans[1] if m.kept] == [("lgpl-2.1", 0, 8)]
    assert all(a.first_word <= b.first_word for ms in spans.values() for a, b in zip(ms, ms[1:], strict=False))


def test_many_matches_in_one_text(spark):
    text = "MIT License, Apache License 2.0; " * 4_000
    got = licenses.with_digest(licenses.with_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.labels) == (24_000, 8_000, 0, 23_996, "apache,apache-2.0,mit")


def test_edges(spark):
    found = licenses.with_licenses(edge_rows(spark))
    assert {"key", "hash", "score", "n tokens.x"} <= set(found.columns)
    rows = licenses.with_digest(found.drop("score")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[6].n_words == len(LONG.split())
    for i in (1, 2, 3):
        assert row(by[i]) == (0, 0, None, None, "", "", 0.0)
    assert by[7].asDict() | {"doc_id": 8} == by[8].asDict()
    assert licenses.with_licenses(no_rows(spark)).collect() == []


def test_no_python_and_no_shuffle(spark):
    plan = queries.op11_license_scan(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
