"""Balancing, seeded samples and the stratified split, checked against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tensio.operators import sampling


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def labelled(spark, sizes):
    rows, i = [], 0
    for cls, n in sizes.items():
        for _ in range(n):
            rows.append((i, cls))
            i += 1
    return spark.createDataFrame(rows, "id long, y int"), rows


def brute_balance(rows, seed=42, floor_=10):
    by = {}
    for i, c in rows:
        by.setdefault(c, []).append(i)
    sizes = sorted(len(v) for v in by.values())
    m = len(sizes)
    med = sizes[m // 2] if m % 2 else (sizes[m // 2 - 1] + sizes[m // 2]) / 2
    target = max(int(med), floor_)
    out = set()
    for c, ids in by.items():
        k = math.ceil(target / len(ids))
        cand = sorted((md5(f"{seed}:{i}:{r}"), i, r) for i in ids for r in range(1, k + 1))
        out |= {(c, i, r) for _, i, r in cand[:target]}
    return target, out


@pytest.mark.parametrize("sizes", [{0: 22, 1: 20, 2: 9}, {0: 3, 1: 4}, {0: 5000, 1: 1200, 2: 37}])
def test_balance_matches_brute_force(spark, sizes):
    df, rows = labelled(spark, sizes)
    target, expect = brute_balance(rows)
    got = sampling.balance_classes(df.repartition(7), "y", "id")
    got_set = {(r["y"], r["id"], r["replica"]) for r in got.collect()}
    assert got_set == expect
    counts = {c: sum(1 for g in got_set if g[0] == c) for c in sizes}
    assert set(counts.values()) == {target}


def test_balance_known_sizes(spark):
    df, rows = labelled(spark, {0: 22, 1: 20, 2: 9})
    got = sampling.balance_classes(df, "y", "id").collect()
    assert len(got) == 60
    assert max(r["replica"] for r in got if r["y"] == 2) <= 3
    assert max(r["replica"] for r in got if r["y"] != 2) == 1


def test_seeded_sample(spark):
    df = spark.range(20000).withColumnRenamed("id", "k").repartition(9)
    got = {r["k"] for r in sampling.seeded_sample(df, 777, "k").collect()}
    expect = {k for _, k in sorted((md5(f"42:{k}"), k) for k in range(20000))[:777]}
    assert got == expect
    assert sampling.seeded_sample(df.limit(5), 100, "k").count() == 5


def approximate_mode(counts, n_draws):
    total = sum(counts.values())
    cont = {c: n / total * n_draws for c, n in counts.items()}
    fl = {c: math.floor(v) for c, v in cont.items()}
    need = n_draws - sum(fl.values())
    for c in sorted(cont, key=lambda c: (-(cont[c] - fl[c]), c))[:need]:
        fl[c] += 1
    return fl


@pytest.mark.parametrize("sizes", [{0: 20, 1: 20, 2: 20}, {0: 7, 1: 13, 2: 101}, {0: 1, 1: 2}])
def test_stratified_split_counts_and_disjoint(spark, sizes):
    df, rows = labelled(spark, sizes)
    df = df.withColumn("key", F.col("id").cast("string"))
    out = sampling.stratified_split(df, "y", "key").collect()
    assert len(out) == len(rows) and len({r["id"] for r in out}) == len(rows)
    n = len(rows)
    n_test = math.ceil(0.2 * n)
    train = approximate_mode(sizes, n - n_test)
    for c, size in sizes.items():
        tests = sorted((md5(f"42:{r['key']}"), r["key"]) for r in out if r["y"] == c)
        got_test = {r["key"] for r in out if r["y"] == c and r["fold"] == "test"}
        assert len(got_test) == size - train[c]
        assert got_test == {k for _, k in tests[: size - train[c]]}


def test_replicate_chunked_equals_direct(spark):
    df = spark.createDataFrame([(1, 3), (2, 10000), (3, 1)], "k long, c int")
    direct = sampling.replicate(df, F.col("c"), 3, ["k"]).collect()
    assert sorted((r["k"], r["replica"]) for r in direct if r["k"] != 2) == [(1, 1), (1, 2), (1, 3), (3, 1)]
    chunked = sampling.replicate(df, F.col("c"), 10000, ["k"])
    got = sorted((r["k"], r["replica"]) for r in chunked.collect())
    expect = sorted([(1, i) for i in range(1, 4)] + [(2, i) for i in range(1, 10001)] + [(3, 1)])
    assert got == expect


def test_balance_tiny_class_large_target(spark):
    sizes = {0: 9000, 1: 9000, 2: 2}
    df, rows = labelled(spark, sizes)
    got = sampling.balance_classes(df, "y", "id")
    counts = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert counts == {0: 9000, 1: 9000, 2: 9000}
    assert got.filter("y = 2").select("id", "replica").distinct().count() == 9000


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "id long, y int")
    assert sampling.balance_classes(df, "y", "id").count() == 0
    assert "replica" in sampling.balance_classes(df, "y", "id").columns
    keyed = df.withColumn("key", F.col("id").cast("string"))
    assert sampling.stratified_split(keyed, "y", "key").count() == 0
    assert sampling.seeded_sample(df, 10, "id").count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    """Recomputation after a lost executor sees other partitions; the choices must not move."""
    df, rows = labelled(spark, {0: 700, 1: 300, 2: 45})
    keyed = df.withColumn("key", F.col("id").cast("string"))
    outs = []
    for parts in (1, 5, 13):
        d = keyed.repartition(parts)
        bal = {(r["id"], r["replica"]) for r in sampling.balance_classes(d, "y", "id").collect()}
        split = {(r["key"], r["fold"]) for r in sampling.stratified_split(d, "y", "key").collect()}
        sample = {r["id"] for r in sampling.seeded_sample(d, 99, "id").collect()}
        outs.append((bal, split, sample))
    assert outs[0] == outs[1] == outs[2]
