"""The streaming cleaning flow and the driver contract."""

import os

from pyspark.sql import types as TY

import __spark_entry__ as E
from tensio.plans.catalog import QUERIES
from tensio.plans.oracle import ORACLE
from tensio.functions.lexicons import PROFILE_V2
from tensio.operators import cleaning
from tensio.streaming import relevance

from conftest import SF001

SCHEMA = TY.StructType([TY.StructField("id", TY.LongType()), TY.StructField("text", TY.StringType())])


def test_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    rows1 = [(1, "teenage stress"), (2, "hello"), (3, "stress exam teen")]
    rows2 = [(4, "teenage stress"), (5, "teen adolescent")]
    spark.createDataFrame(rows1, SCHEMA).write.parquet(os.path.join(src, "b1"))
    stream = relevance.relevance_stream(relevance.read_post_stream(spark, os.path.join(src, "*"), SCHEMA), "text", PROFILE_V2)
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    q = relevance.start_parquet_sink(stream, out, ck)
    q.processAllAvailable()
    spark.createDataFrame(rows2, SCHEMA).write.parquet(os.path.join(src, "b2"))
    q.processAllAvailable()
    q.stop()
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    batch = cleaning.clean_dataset(spark.createDataFrame(rows1 + rows2, SCHEMA), "text", ["id"], PROFILE_V2)
    assert got == sorted(r["id"] for r in batch.collect()) == [1, 3, 5]


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "relevance_score" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 45
    assert set(QUERIES) <= set(qs) and set(ORACLE) <= set(sql)


def test_every_query_plans_on_smoke_data(spark):
    for name, fn in QUERIES.items():
        if name == "classify_posts":
            continue
        df = fn(spark, SF001)
        assert df.columns, name


def test_stream_watermark_dedupe(spark, tmpdir_path):
    import datetime as dt

    schema = TY.StructType(
        [TY.StructField("id", TY.LongType()), TY.StructField("text", TY.StringType()), TY.StructField("ts", TY.TimestampType())]
    )
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([(1, "teenage stress", t0), (2, "teen adolescent", t0)], schema).write.parquet(os.path.join(src, "b1"))
    posts = relevance.read_post_stream(spark, os.path.join(src, "*"), schema)
    stream = relevance.relevance_stream(posts, "text", PROFILE_V2, event_time="ts", watermark="10 minutes")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    q = relevance.start_parquet_sink(stream, out, ck)
    q.processAllAvailable()
    # a repeat five minutes later is inside the watermark: dropped
    spark.createDataFrame([(3, "teenage stress", t0 + dt.timedelta(minutes=5))], schema).write.parquet(os.path.join(src, "b2"))
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in rows) == [1, 2]
    assert {r["id"]: r["relevance_score"] for r in rows} == {1: 0.65, 2: 0.5}  # 0.15 + 0.5; 0.5
