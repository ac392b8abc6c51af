import corpus_pipeline as P
import pytest
import test_packing
import test_simhash
import test_substrings
from cases import edge_rows, no_rows, same_rows
from conftest import SF001, SF01
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tensio.llm import decontaminate, quality
from tensio.llm.batches import staged


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF01}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = staged(stage(spark, docs, SF01), "test")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_columns_and_act(spark, stages):
    for name, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes, name
        assert after.count() <= before.count()
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    _, before, after = stages[0]
    model = quality.train(before, labels)
    want = quality.with_score(before, model, keep=["doc_id"]).where(F.col("score") >= 0.3)
    assert texts(after).keys() == {r.doc_id for r in want.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - texts(after).keys()) <= 0.03 * len(good)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    own = texts(before)
    fps = {i: test_simhash.fingerprint(t) for i, t in own.items()}
    roots = test_simhash.components(sorted(fps), lambda a, b: test_simhash.near(fps[a], fps[b]))
    assert texts(after) == {i: own[i] for i in set(roots.values())}


def test_repeated_windows_go(stages):
    _, before, after = stages[2]
    own = texts(before)
    want = {i: (t if m else own[i]) for i, _, m, t in test_substrings.brute(own.items())}
    assert texts(after) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_leaks_go(spark, stages):
    _, before, after = stages[3]
    items = spark.read.parquet(f"{SF01}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.find_leaks(before, items).collect()}
    own = texts(before)
    assert {i for i, t in own.items() if any(r.text in t for r in items.collect())} <= leaks
    assert texts(after) == {i: t for i, t in own.items() if i not in leaks}


def test_packed(stages):
    _, before, after = stages[4]
    n, least = test_packing.check(after.collect(), texts(before).items())
    assert n <= least * 1.02 + 1


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in P.STAGES:
        docs = staged(stage(spark, docs, SF001), "test")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same_rows(P.run(spark, SF001).select(*columns).collect(), docs.select(*columns).collect())


def test_edges(spark):
    for rows, kept in ((edge_rows(spark), True), (no_rows(spark), False)):
        docs = rows.withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in P.STAGES:
            after = staged(stage(spark, docs, SF001), "test")
            assert name == P.STAGES[-1][0] or after.dtypes == docs.dtypes
            docs = after
        assert kept or docs.count() == 0
