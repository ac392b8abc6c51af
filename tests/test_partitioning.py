"""Partition helpers: conditional spreading, reliable checkpoints, shared values."""

from tensio.operators import partitioning as P


def test_spread_only_when_it_doubles_parallelism(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(1000).coalesce(1)
    assert P.spread_for_cpu(few).rdd.getNumPartitions() == cores
    many = spark.range(1000).repartition(cores)
    assert P.spread_for_cpu(many) is many


def test_materialize_is_reliable_and_equal(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    m = P.materialize(df)
    assert sorted(r["twice"] for r in m.collect()) == [2 * i for i in range(100)]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan  # read back from the checkpoint, lineage cut
    assert spark.sparkContext.getCheckpointDir()


def test_share_gives_value(spark):
    b = P.share(spark, {"a": 1})
    assert b.value == {"a": 1}


def test_stage_scope_removes_its_tables(spark):
    import os

    from tensio.operators import topics
    from tensio.operators.partitioning import materialize
    from tensio.session import ensure_checkpoint_dir, stage_scope

    df = spark.createDataFrame([(1, "exam friend exam")], "k long, t string")
    outside = ensure_checkpoint_dir(spark)
    with stage_scope(spark) as folder:
        bag = topics.keyword_bag(df, "t", ["k"], {"school": ["exam"]}).collect()
        materialize(df)
        local = folder.removeprefix("file:")
        assert len(bag) == 2 and len(os.listdir(local)) == 2 and folder.startswith(outside)
        with stage_scope(spark) as inner:
            assert materialize(df).count() == 1 and inner.startswith(folder)
        assert materialize(df).count() == 1
    assert not os.path.exists(local) and ensure_checkpoint_dir(spark) == outside
