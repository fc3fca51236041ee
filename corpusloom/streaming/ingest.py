"""Incremental ingestion with Structured Streaming: restartable batches, last row of each key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.documents import latest


#: So many batches are put together into one.
COMPACT_AFTER = 8


class RepeatedKey(ValueError):
    """A batch has a key more than once, though keys are to be unique."""


def _folders(spark: SparkSession, state: str, name: str) -> list[int]:
    """The numbers of the complete folders ``name=number`` under ``state``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
    of = [p for p in found if p.getName().startswith(f"{name}=")]
    return sorted(int(p.getName().partition("=")[2]) for p in of if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def upsert_stream(stream: DataFrame, key: list[str], order: list[str], state: str, checkpoint: str, unique: bool = False) -> DataFrame:
    """Run what has arrived so far and give the last row of each key.

    Every batch writes its own last rows to a folder named by the batch, overwriting it, so a batch that is
    repeated after a failure has the same effect. When COMPACT_AFTER batches have come since the last time, the
    last rows of all are written together, and older folders aren't read again. Late rows count by their own
    order. With ``unique``, a batch that has a key twice fails before it is written.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if unique and not batch.groupBy(*key).count().where("count > 1").isEmpty():
            raise RepeatedKey(f"batch {number} repeats {', '.join(key)}")
        latest(batch, key, order).write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    whole = _folders(spark, state, "upto")[-1:]
    batches = [k for k in _folders(spark, state, "batch") if not whole or k > whole[0]]
    paths = [f"{state}/upto={k}" for k in whole] + [f"{state}/batch={k}" for k in batches]
    rows = latest(spark.read.schema(stream.schema).parquet(*paths), key, order) if paths else spark.createDataFrame([], stream.schema)
    if len(batches) >= COMPACT_AFTER:
        rows.write.mode("overwrite").parquet(f"{state}/upto={batches[-1]}")
        rows = spark.read.schema(stream.schema).parquet(f"{state}/upto={batches[-1]}")
    return rows


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str, lateness: str) -> DataFrame:
    """Rows by window of event time and kind, as a stream; rows later than ``lateness`` are left out by the watermark. Repeated ids count once."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("_t", width).alias("w"), kind).agg(F.count("*").alias("n"))


def read_files(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files under ``path``."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
