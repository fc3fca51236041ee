"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import documents
from corpusloom.plans import sql as S
from corpusloom.session import new_folder, stage, table
from corpusloom.sources import jsonl
from corpusloom.streaming import ingest


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "io")


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The raw documents, published as JSON lines and read back strictly."""
    folder = _folder(spark)
    rows = table(spark, d, "corpus_docs").select(*[F.col(c).cast("string").alias(c) for c in jsonl.DOCUMENT.names])
    jsonl.publish(rows, f"{folder}/published", f"{folder}/staging")
    back = jsonl.read_strict(spark, f"{folder}/published")
    return back.select("doc_id", "title", "wikipedia_pageid", "approx_tokens", F.sha2("text", 256).alias("hash"))


def streaming_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user, by a stream over files."""
    folder = _folder(spark)
    table(spark, d, "events").repartition(4).write.parquet(f"{folder}/in")
    rows = ingest.upsert_stream(ingest.read_files(spark, f"{folder}/in", 2), ["user_id"], ["ts", "event_id"], f"{folder}/state", f"{folder}/checkpoint")
    return stage(rows.select("user_id", "ts", "event_id", "event_type", "value"), "stream")


def streaming_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The last delivered row of every chunk, by a stream over files."""
    folder = _folder(spark)
    table(spark, d, "chunks").repartition(4).write.parquet(f"{folder}/in")
    rows = ingest.upsert_stream(ingest.read_files(spark, f"{folder}/in", 2), ["chunk_id"], ["ingested_at"], f"{folder}/state", f"{folder}/checkpoint")
    return stage(rows.select("chunk_id", "doc_id", "ingested_at", F.sha2("text", 256).alias("hash")), "stream")


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, by a stream with a watermark; days that the watermark has closed."""
    folder = _folder(spark)
    table(spark, d, "events").repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    counts = ingest.windowed_counts(ingest.read_files(spark, f"{folder}/in", 4), "ts", "event_type", "1 day", "2 days")
    query = counts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(counts.schema).parquet(f"{folder}/out")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def daily_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, as a batch."""
    return table(spark, d, "events").dropDuplicates(["event_id"]).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def live_corpus(spark: SparkSession, d: str) -> DataFrame:
    return documents.live_documents(table(spark, d, "corpus_docs")).select("doc_id", "title", "loaded_at")


def queries() -> dict:
    names = "jsonl_roundtrip streaming_ingest streaming_chunks windowed_events daily_events live_corpus"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    return {
        "jsonl_roundtrip": "select doc_id, title, wikipedia_pageid, approx_tokens::varchar as approx_tokens, sha256(text) as hash from corpus_docs",
        "streaming_ingest": "select user_id, ts, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where user_id is not null) where n = 1",
        "streaming_chunks": "select distinct on (chunk_id) chunk_id, doc_id, ingested_at, sha256(text) as hash from chunks where chunk_id is not null order by chunk_id, ingested_at desc, doc_id desc, title desc, wikidata_qid desc, wikipedia_pageid desc",
        "windowed_events": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(distinct event_id) as n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 2 day from events) group by all",
        "daily_events": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(distinct event_id) as n from events group by all",
        "live_corpus": f"select doc_id, title, loaded_at from (select distinct on (doc_id) * from corpus_docs where doc_id is not null order by doc_id, loaded_at desc, title desc, text desc) where deleted_at is null and {S.strip('doc_id')} = {S.strip('doc_id')}",
    }
