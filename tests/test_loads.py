import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from corpusloom.operators import incremental
from corpusloom.session import drop_stages, new_folder, run_dir, stage
from corpusloom.streaming import ingest

T = dt.datetime(2025, 1, 1)


def counts(df):
    return {r.change: r.n for r in df.collect()}


def test_loads_against_a_stored_state(spark):
    schema = "chunk_id string, text string, ingested_at timestamp_ntz, hash string"
    first = spark.createDataFrame([("a", "x", T, "c"), ("b", None, T, "c"), ("c", "", T, "c"), (None, "x", T, "c"), ("a", "x", T, "c")], schema)
    second = spark.createDataFrame([("a", "y", T, "c"), ("b", None, T, "c"), ("d", "z" * 100_000, T, "c")], schema)
    folder = new_folder(spark, "test")
    assert counts(incremental.load(first, folder, 1)) == {"new": 3}
    assert counts(incremental.load(second, folder, 2)) == {"changed": 1, "same": 1, "new": 1}
    assert sorted(r.chunk_id for r in spark.read.parquet(f"{folder}/rows/load=2").collect()) == ["a", "d"]
    # what was not delivered stays known; a repeated load has the same effect
    for _ in range(2):
        assert counts(incremental.load(first, folder, 3)) == {"changed": 1, "same": 2}
    assert counts(incremental.load(first.limit(0), folder, 4)) == {}


def test_stream_compacts_and_restarts(spark):
    folder = new_folder(spark, "test")
    schema = "k string, t long, v string"
    want = {}
    for day in range(3):
        rows = [(f"k{j % 7}", day * 100 + j, f"v{day}-{j}") for j in range(20)] + [("null", None, "late")]
        want |= {k: v for k, _, v in rows}
        for part in range(4):
            spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = ingest.upsert_stream(ingest.read_files(spark, f"{folder}/in", 1), ["k"], ["t"], f"{folder}/state", f"{folder}/checkpoint")
        assert {r.k: r.v for r in got.collect()} == want
    assert ingest._folders(spark, f"{folder}/state", "upto")


def test_stream_refuses_a_repeated_key(spark):
    folder = new_folder(spark, "test")
    spark.createDataFrame([("a", 1), ("a", 2)], "k string, t long").coalesce(1).write.parquet(f"{folder}/in")
    with pytest.raises(StreamingQueryException, match="RepeatedKey"):
        ingest.upsert_stream(ingest.read_files(spark, f"{folder}/in"), ["k"], ["t"], f"{folder}/state", f"{folder}/checkpoint", unique=True)
    assert not ingest._folders(spark, f"{folder}/state", "batch")


def test_stages_can_be_dropped(spark):
    import os

    stage(spark.range(3))
    assert os.path.isdir(run_dir(spark))
    drop_stages(spark)
    assert not os.path.exists(run_dir(spark))
