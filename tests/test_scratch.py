from types import SimpleNamespace

import pytest

from lodestone import scratch


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))


def test_a_cluster_needs_a_shared_folder():
    assert scratch.shared_dir(session("spark://host:7077", "file:///shared")) == "file:///shared"
    assert scratch.shared_dir(session("local[2]"))
    with pytest.raises(ValueError):
        scratch.shared_dir(session("spark://host:7077"))


def test_tables_keep_their_schema_and_go(spark):
    s = scratch.Scratch(spark, "t")
    df = s.save(spark.range(5).selectExpr("id", "cast(null as string) as x"))
    assert df.count() == 5 and df.dtypes == [("id", "bigint"), ("x", "string")]
    s.drop(df)
    with pytest.raises(Exception):
        df.count()


def test_few_known_rows_get_few_files(spark):
    s, key = scratch.Scratch(spark, "t"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = spark.range(500).repartition(60, "id")
        few = s.save(df, 500)
        assert few.count() == 500 and len(few.inputFiles()) <= spark.sparkContext.defaultParallelism < len(s.save(df).inputFiles())
    finally:
        spark.conf.unset(key)
