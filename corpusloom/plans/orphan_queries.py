"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import orphans
from corpusloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "relationships")
    refs = orphans.references(chunks, "chunks", "chunk_id", "doc_id", "document")
    for field in ("source", "target"):
        refs = refs.unionByName(orphans.references(edges, "relationships", "rel_id", field, "entity"))
    recs = orphans.records(table(spark, sf_dir, "corpus_docs"), "document", "doc_id", "loaded_at")
    recs = recs.unionByName(orphans.records(table(spark, sf_dir, "entities"), "entity", "id", "extracted_at"))
    return orphans.find_orphans(refs, recs)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(p4_found(spark, sf_dir))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_report": p4_report}


_FOUND = """
with refs as (
  select 'chunks' as table_name, chunk_id as ref_key, 'doc_id' as field, 'd' as parent, lower(trim(doc_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as k, ingested_at as t from chunks
  union all select 'relationships', cast(rel_id as varchar), 'source', 'e', lower(trim(source, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), ingested_at from relationships
  union all select 'relationships', cast(rel_id as varchar), 'target', 'e', lower(trim(target, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), ingested_at from relationships
), recs as (
  select 'd' as parent, lower(trim(doc_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as k, loaded_at as a, deleted_at as d from corpus_docs
  union all select 'e', lower(trim(id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), extracted_at, deleted_at from entities
), judged as (
  select r.table_name, r.ref_key, r.field, r.t, count(p.k) as n, count(*) filter (where p.a <= r.t) as n_arrived,
    count(*) filter (where p.a <= r.t and (p.d is null or p.d > r.t)) as n_live
  from (select distinct * from refs where k is not null and k <> '') r left join recs p on p.parent = r.parent and p.k = r.k
  group by all
)
select distinct table_name, ref_key, field, case when n = 0 then 'missing' when n_arrived = 0 then 'late' else 'deleted' end as kind, strftime(t, '%Y-%m') as period
from judged where n_live = 0
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _FOUND, "p4_report": f"select table_name, field, kind, period, count(*) as n_orphans from ({_FOUND}) group by all"}
