import zlib

import numpy as np
from cases import edge_rows, no_rows
from conftest import SF01

from tensio.llm import quality, queries


def test_held_out_fold(spark):
    rows = queries.op9_quality_classifier(spark, SF01).collect()
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    fold = [(r.predicted, told[r.doc_id]) for r in rows if r.held_out and r.doc_id in told]
    good = [p for p, y in fold if y == 1]
    bad = [p for p, y in fold if y == 0]
    assert good and bad and np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_trees_separate_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.7)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    # One row at a time gives the same answers.
    one = np.array([quality.Trees(*model.arrays()).score(r[None])[0] for r in x[:20]])
    assert np.allclose(one, model.score(x)[:20])


def test_little_to_learn_from():
    none = quality.fit(np.zeros((0, 4)), np.zeros(0))
    assert np.allclose(none.score(np.ones((2, 4))), 0.5)
    ones = quality.fit(np.ones((9, 4)), np.ones(9))
    assert (ones.score(np.zeros((3, 4))) > 0.9).all()


def test_edges(spark):
    docs = edge_rows(spark)
    labels = spark.createDataFrame([(7, 1), (7, 0), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.with_score(docs, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows) and rows[0].text is None
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] and by[7] == by[8]
    empty = quality.train(no_rows(spark), labels.where("false"))
    assert quality.with_score(no_rows(spark), empty).collect() == []
    assert {r.score for r in quality.with_score(docs, empty).collect()} == {0.5}
    assert [r.h for r in spark.createDataFrame([(None,)], "doc_id long").select(quality.held_out("doc_id").alias("h")).collect()] == [True]
