"""Loading again only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(df: DataFrame, key: str, text: str, arrived: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.sha2(text, 256).alias("hash"), F.col(arrived).alias("t"))
    return rows.groupBy("key").agg(F.max_by(F.struct("hash"), F.struct("t", "hash")).alias("s")).select("key", "s.hash")


def changed_rows(stored: DataFrame, delivered: DataFrame, key: str = "chunk_id", text: str = "text", arrived: str = "ingested_at") -> DataFrame:
    """Of every key of ``delivered`` whether it is new, changed or the same, by hashes of the last row of each side. Null keys are left out; only hashes are shuffled."""
    old, new = _state(stored, key, text, arrived), _state(delivered, key, text, arrived)
    joined = new.join(old.select("key", F.col("hash").alias("old"), F.lit(True).alias("known")), "key", "left")
    change = F.when(F.col("known").isNull(), "new").when(~F.col("old").eqNullSafe(F.col("hash")), "changed").otherwise("same")
    return joined.select(F.col("key").alias(key), change.alias("change"))


def changes(stored: DataFrame, delivered: DataFrame, key: str = "chunk_id", text: str = "text", arrived: str = "ingested_at") -> DataFrame:
    """How many keys are new, changed and the same."""
    return changed_rows(stored, delivered, key, text, arrived).groupBy("change").agg(F.count("*").alias("n"))


def load(delivered: DataFrame, folder: str, number: int, key: str = "chunk_id", text: str = "text", arrived: str = "ingested_at") -> DataFrame:
    """Load number ``number`` (from 1) into ``folder``: rows of new and changed keys are written, and the state (key, hash) for the next load. Gives how many keys are new, changed and the same.

    A load that is repeated after a failure overwrites what it wrote. Keys that are not delivered stay in the state.
    """
    spark = delivered.sparkSession
    new = _state(delivered, key, text, arrived)
    old = spark.read.parquet(f"{folder}/state/load={number - 1}") if number > 1 else spark.createDataFrame([], new.schema)
    both = new.withColumn("here", F.lit(True)).join(old.withColumnRenamed("hash", "old").withColumn("known", F.lit(True)), "key", "full")
    change = F.when(F.col("here").isNull(), "kept").when(F.col("known").isNull(), "new").when(~F.col("old").eqNullSafe(F.col("hash")), "changed").otherwise("same")
    both.select("key", F.when(F.col("here").isNull(), F.col("old")).otherwise(F.col("hash")).alias("hash"), change.alias("change")).write.mode("overwrite").parquet(f"{folder}/changes/load={number}")
    judged = spark.read.parquet(f"{folder}/changes/load={number}")
    judged.select("key", "hash").write.mode("overwrite").parquet(f"{folder}/state/load={number}")
    fresh = judged.where("change in ('new', 'changed')").select(F.col("key").alias(key))
    delivered.join(fresh, key, "left_semi").write.mode("overwrite").parquet(f"{folder}/rows/load={number}")
    return judged.where("change <> 'kept'").groupBy("change").agg(F.count("*").alias("n"))
