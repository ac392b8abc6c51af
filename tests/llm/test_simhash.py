import random

import xxhash
from cases import documents, edge_rows, no_rows
from conftest import SF001

from tensio.llm import queries, simhash
from tensio.llm.components import connected_components


def fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def near(a, b):
    return (a ^ b).bit_count() <= 2


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_query_equals_brute_force(spark):
    fps = {i: fingerprint(t) for i, t in documents(spark, SF001).items()}
    want = components(sorted(fps), lambda a, b: near(fps[a], fps[b]))
    rows = queries.op7_simhash(spark, SF001).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(rows) == len(fps)


def test_links_keep_every_component(spark):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for size in (2, 5, 30, 250):  # clusters around a centre, some chained
        centre = rng.getrandbits(64)
        for _ in range(size):
            fps.add(centre)
            flipped = centre
            for _ in range(rng.randint(0, 3)):
                flipped ^= 1 << rng.randrange(64 if size < 100 else 16)
            fps.add(flipped)
            if rng.random() < 0.1:
                centre = flipped
    fps |= {rng.getrandbits(64) for _ in range(100)}
    want = components(sorted(fps), near)
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3))
    found = {r.node: r.root for r in connected_components(edges).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(found.get(signed(f), signed(f)), set()).add(f)
    truth = {}
    for f, r in want.items():
        truth.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1 and got[0] != got[1000]
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges(spark):
    rows = simhash.near_duplicates(edge_rows(spark)).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert {by[i].component_id for i in (7, 8, 10)} == {7}
    assert by[5].fingerprint == f"{xxhash.xxh64_intdigest(b'two words', 42):016x}"
    assert simhash.near_duplicates(no_rows(spark)).collect() == []


def test_representatives(spark):
    rows = simhash.representatives(edge_rows(spark)).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 4, 5, 6, 7, 9]
    assert rows[0].asDict().keys() == edge_rows(spark).first().asDict().keys()
    assert simhash.representatives(no_rows(spark)).collect() == []


def test_a_row_goes_only_for_another_of_its_component(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c"))]  # NULL ids, three texts
    rows += [(1, text("d")), (2, text("d")), (2, text("e")), (3, text("f")), (3, text("g")), (None, text("g"))]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (1, text("d")), (2, text("e")), (3, text("f")), (3, text("g"))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
