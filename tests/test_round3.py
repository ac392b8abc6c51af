"""Order statistics, the ordered keyword bag, one-pass sampling, vectorised ids, models per platform."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensio.operators import encode, grouped_classifier, quantiles, sampling, topics
from tensio.plans import sentiment_flow


# ---- exact quantiles -------------------------------------------------------------------


def test_order_bits_keep_the_order():
    values = np.array([-math.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e10, math.inf])
    keys = quantiles.order_bits(values).view(np.uint64)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == len(values) - 1


@pytest.mark.parametrize("kind", ["distinct", "few", "spread", "one"])
def test_quantiles_equal_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "FEW_ROWS", 20)
    rng = np.random.default_rng(3)
    values = {
        "distinct": rng.normal(0, 1, 20_001),
        "few": rng.choice([-1.5, 0.0, 0.25, 7.0], 5_000),
        "spread": np.ldexp(rng.random(4_000) - 0.3, rng.integers(-1000, 1000, 4_000)),
        "one": np.array([4.5]),
    }[kind]
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "`a b` double").repartition(7)
    got = quantiles.describe_column(df, "a b", (0.0, 0.25, 0.5, 0.9, 1.0)).first()
    assert got["count"] == len(values) and got["min"] == got["p0"] == values.min() and got["max"] == got["p100"] == values.max()
    for q in (0.25, 0.5, 0.9):
        assert got[f"p{q * 100:g}"] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=0)


def test_quantiles_of_nothing(spark):
    got = quantiles.describe_column(spark.createDataFrame([(None,), (float("nan"),)], "v double"), "v").first()
    assert tuple(got) == (0, None, None, None, None, None, None, None)


# ---- keyword bag -----------------------------------------------------------------------


def test_keyword_bag_keeps_order_and_repeats(spark):
    rng = random.Random(5)
    words = ["exam", "class", "friend", "x", "y"]
    kinds = {"school": ["exam", "class"], "social": ["friend", "class"], "none": ["zzz"]}
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(9)
    got = topics.keyword_bag(df, "t", ["k"], kinds).collect()
    for topic, keywords in kinds.items():
        want = [w for _, t in rows for w in (t or "").split() if w in keywords]
        mine = sorted((r.ordinal, r.keyword) for r in got if r.topic == topic)
        assert [w for _, w in mine] == want and [o for o, _ in mine] == list(range(1, len(want) + 1))
    assert topics.keyword_bag(df.where("k >= 300"), "t", ["k"], kinds).collect() == []


# ---- sampling --------------------------------------------------------------------------


def jobs_of(spark, work):
    """Jobs that a call runs, before its result is read."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    work()
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(ids)


def test_few_jobs_a_call(spark):
    df = spark.range(0, 5000, 1, 6).select("id", (F.col("id") % 3).cast("int").alias("y"), F.col("id").cast("string").alias("k"))
    assert jobs_of(spark, lambda: sampling.stratified_split(df, "y", "k")) <= 6
    assert jobs_of(spark, lambda: sampling.balance_classes(df, "y", "id")) <= 6
    assert jobs_of(spark, lambda: sampling.seeded_sample(df, 20_000, "id")) <= 6


def test_band_holds_the_wanted_hash():
    rng = random.Random(1)
    for rows, limit in ((50, 7), (1000, 999), (20_000, 4_000), (20_000, 1)):
        low, high = sampling.hash_band(rows, limit)
        for seed in range(3):
            hashes = sorted(hashlib.md5(f"{seed}:{rng.random()}:{i}".encode()).hexdigest() for i in range(rows))
            assert low <= hashes[limit - 1] < high


def test_repeated_keys_miss_the_band_and_are_still_right(spark, monkeypatch):
    """A key that half of the rows hold has one hash: the band may miss, the exact pass decides."""
    rows = [(0 if i % 2 else i, i % 2, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, y int, id long").repartition(5)
    asked = []
    exact = sampling.cut_values
    monkeypatch.setattr(sampling, "cut_values", lambda *a: asked.append(1) or exact(*a))
    for n in (10, 2500, 5000):
        hashed = df.withColumn(sampling.HASH, sampling.row_hash(42, F.col("k")))
        got = sampling.flag_smallest(hashed.withColumn("g", F.lit(1)), "g", [(1, 6000, n)], ["k"], "f").where("f")
        ordered = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k, _, _ in rows)
        assert got.count() == sum(x <= ordered[n - 1] for x in ordered)
    assert asked


def test_null_keys_come_first(spark):
    rows = [(None if i < 3 else i, 1) for i in range(3000)] + [(None, 2)]
    df = spark.createDataFrame(rows, "k long, y int").withColumn(sampling.HASH, sampling.row_hash(42, F.col("k")))
    got = sampling.flag_smallest(df, "y", [(1, 3000, 100), (2, 1, 0)], ["k"], "f").where("f").collect()
    assert len(got) == 100 and sum(r.k is None for r in got) == 3 and {r.y for r in got} == {1}


def test_many_classes_give_the_same_rows(spark, monkeypatch):
    df = spark.range(4000).select("id", (F.col("id") % 7).cast("int").alias("y"), F.col("id").cast("string").alias("k"))
    few = ({(r.id, r.fold) for r in sampling.stratified_split(df, "y", "k").collect()}, {(r.id, r.replica) for r in sampling.balance_classes(df, "y", "id", min_per_class=900).collect()})
    monkeypatch.setattr(sampling, "MAX_CLASSES", 3)
    many = ({(r.id, r.fold) for r in sampling.stratified_split(df, "y", "k").collect()}, {(r.id, r.replica) for r in sampling.balance_classes(df, "y", "id", min_per_class=900).collect()})
    assert few == many


def test_groups_are_split_and_balanced_each_for_itself(spark):
    rows = [(g, f"{g}{i}", i % m) for g, n, m in (("a", 500, 3), ("b", 90, 2), (None, 40, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k string, y int").repartition(4)
    split = {(r.g, r.k, r.fold) for r in sampling.split_groups(df, "g", "y", "k").collect()}
    balanced = {(r.g, r.k, r.replica) for r in sampling.balance_groups(df, "g", "y", "k").collect()}
    for g in ("a", "b", None):
        one = df.where(F.col("g").eqNullSafe(F.lit(g)))
        assert {(k, f) for h, k, f in split if h == g} == {(r.k, r.fold) for r in sampling.stratified_split(one, "y", "k").collect()}
        assert {(k, n) for h, k, n in balanced if h == g} == {(r.k, r.replica) for r in sampling.balance_classes(one, "y", "k").collect()}


# ---- token ids -------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [None, 0, 1, 3])
def test_ids_of_equals_a_loop(limit):
    rng = random.Random(7)
    words = ["a", "b", "é", "dd"]
    rows = [None, [], ["z"], [None, "a"]] + [[rng.choice([*words, "x", None]) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    got = encode.ids_of(pa.array(rows, pa.list_(pa.string())).slice(1), pa.array(words), limit).to_pylist()
    want = [[words.index(w) + 1 for w in r or [] if w in words][:limit] for r in rows[1:]]
    assert got == want
    assert encode.ids_of(pa.array([], pa.list_(pa.string())), pa.array(words)).to_pylist() == []
    assert encode.ids_of(pa.array([["a"]]), pa.array([], pa.string())).to_pylist() == [[]]


# ---- models per platform ---------------------------------------------------------------


def posts(spark, sizes, seed=2):
    """Posts whose label a word of their platform gives away, the word's sense differing by platform."""
    rng = random.Random(seed)
    rows = []
    for p, (platform, n) in enumerate(sizes.items()):
        for i in range(n):
            y = rng.randrange(3)
            words = [f"w{rng.randrange(30)}" for _ in range(rng.randint(3, 12))] + [f"sense{(y + p) % 3}"]
            rng.shuffle(words)
            rows.append((platform, f"{platform}:{i}", " ".join(words), y))
    return spark.createDataFrame(rows, "platform string, key string, cleaned_text string, sentiment int")


def test_platform_models_learn_their_own_senses(spark):
    run = sentiment_flow.run_platforms(posts(spark, {"a": 900, "b": 600, "c": 60}), "key")
    got = {r.platform: (r.test_rows, r.accuracy) for r in run.accuracy.collect()}
    assert {p: n for p, (n, _) in got.items()} == {"a": 180, "b": 120, "c": 12}
    assert got["a"][1] > 0.9 and got["b"][1] > 0.9
    assert run.predictions.columns[:3] == ["Platform", "Text", "Predicted_Sentiment"]
    for r in run.test.collect():
        assert abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 and r.confidence == max(r.p0, r.p1, r.p2)


def test_training_stops_and_keeps_the_best(spark):
    """Noise labels: the validation loss soon rises; the kept weights are those of its lowest pass."""
    rng = random.Random(4)
    rows = [("p", " ".join(f"v{rng.randrange(400)}" for _ in range(6)), rng.randrange(3), i % 3 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "platform string, t string, y int, held boolean")
    model = grouped_classifier.train(df, "platform", "t", "y", "held")
    losses = [v for _, _, _, v, _ in model.history]
    assert len(losses) < grouped_classifier.MAX_PASSES and len(losses) - 1 - int(np.argmin(losses)) == grouped_classifier.STOP_AFTER
    scored = grouped_classifier.predict(model, df.where("held"), "platform", "t").collect()
    weight = [1.2 if r.y == 2 else 1.0 for r in scored]
    loss = sum(-w * math.log((r.p0, r.p1, r.p2)[r.y]) for w, r in zip(weight, scored, strict=True)) / sum(weight)
    assert loss == pytest.approx(min(losses), abs=1e-9)


def test_passes_are_the_same_however_the_rows_lie(spark):
    df = posts(spark, {"a": 200, "b": 100}).withColumn("held", F.crc32("key") % 4 == 0)
    histories = [grouped_classifier.train(df.repartition(n), "platform", "cleaned_text", "sentiment", "held", max_passes=6).history for n in (1, 5)]
    for x, y in zip(*histories, strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-9) and x[3] == pytest.approx(y[3], rel=1e-9)


def test_platforms_without_rows_or_models(spark):
    df = posts(spark, {"a": 50}).withColumn("held", F.lit(False))
    model = grouped_classifier.train(df, "platform", "cleaned_text", "sentiment", "held", max_passes=2)
    other = spark.createDataFrame([("zz", "w1 w2"), ("a", None), (None, "w1")], "platform string, cleaned_text string")
    rows = {r.platform: (r.p0, r.p1, r.p2) for r in grouped_classifier.predict(model, other, "platform", "cleaned_text").collect()}
    assert rows["zz"] == rows[None] == (1 / 3, 1 / 3, 1 / 3) and sum(rows["a"]) == pytest.approx(1)
    empty = grouped_classifier.train(df.where("false"), "platform", "cleaned_text", "sentiment", "held")
    assert empty.groups == [] and grouped_classifier.predict(empty, other, "platform", "cleaned_text").count() == 3
