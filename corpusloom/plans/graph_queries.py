"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.plans import sql as S
from corpusloom.schemas import ENTITY_TYPES, LABELS, RELATIONS
from corpusloom.session import new_folder, table
from corpusloom.sources import contract


#: How many mentions of a type go with a chunk to be extracted.
CAPS = {"Athlete": 10, "Event": 5, "Country": 10}


def _e(spark, d):
    return table(spark, d, "entities")


def _r(spark, d):
    return table(spark, d, "relationships")


def _texts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "text").where("text is not null").distinct()


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).where("name is not null").select("name", T.slug("name").alias("slug")).distinct()


def entity_dedup(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_rows(_e(spark, d)).where("name is not null").select(F.lower("name").alias("name"), "type").distinct()


def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.merged_entities(_e(spark, d))


def entity_attributes(spark: SparkSession, d: str) -> DataFrame:
    return G.merged_attributes(_e(spark, d))


def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.merged_relations(_r(spark, d))


def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return G.vertices(_e(spark, d))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(_e(spark, d), _r(spark, d))


def graph_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.vertices(_e(spark, d)).groupBy("type").agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions"))


def graph_contract_check(spark: SparkSession, d: str) -> DataFrame:
    return G.contract_errors(_r(spark, d))


def graph_contract_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The same check by a contract that was written to a file and loaded again."""
    path = new_folder(spark, "contract")
    spark.createDataFrame([(contract.to_json(ENTITY_TYPES, RELATIONS),)], "value string").coalesce(1).write.text(path)
    return G.contract_errors(_r(spark, d), contract.load(spark, path)[1])


def entity_recognised(spark: SparkSession, d: str) -> DataFrame:
    """The stored mentions read as a recogniser's: types are labels."""
    return G.recognised(_e(spark, d).withColumn("label", F.trim("type")))


def graph_endpoint_check(spark: SparkSession, d: str) -> DataFrame:
    return G.endpoint_errors(_e(spark, d), _r(spark, d))


def graph_verify(spark: SparkSession, d: str) -> DataFrame:
    return G.missing_vertices(G.edges(_e(spark, d), _r(spark, d)), G.vertices(_e(spark, d)))


def edge_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return G.rewrite_event_edges(_r(spark, d), G.vertices(_e(spark, d)))


def rule_part_of(spark: SparkSession, d: str) -> DataFrame:
    return G.games_named(_e(spark, d), _texts(spark, d))


def rule_at_venue(spark: SparkSession, d: str) -> DataFrame:
    return G.venues_named(_e(spark, d), _texts(spark, d))


def rule_in_sport(spark: SparkSession, d: str) -> DataFrame:
    return G.sports_of_events(_e(spark, d))


def rule_participated(spark: SparkSession, d: str) -> DataFrame:
    return G.participants(_e(spark, d))


def llm_gate(spark: SparkSession, d: str) -> DataFrame:
    return G.worth_extracting(_e(spark, d))


def entity_chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.chunks_of_entities(_e(spark, d))


def extraction_input(spark: SparkSession, d: str) -> DataFrame:
    return G.capped_mentions(_e(spark, d), CAPS)


def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    return G.winners_by_country(_r(spark, d))


def region_of_largest_order(spark: SparkSession, d: str) -> DataFrame:
    """Three steps over the star schema: of each nation's largest order the customer, nation and region."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    best = rows.groupBy("c_nationkey").agg(F.max_by(F.struct("o_orderkey", "c_name", "o_totalprice"), F.struct("o_totalprice", F.negate("o_orderkey"))).alias("b"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return best.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "b.o_orderkey", "b.c_name", "b.o_totalprice")


def queries() -> dict:
    names = "slugify entity_dedup entity_merge entity_attributes relation_merge graph_vertices graph_edges graph_type_counts graph_contract_check graph_contract_loaded entity_recognised graph_endpoint_check graph_verify edge_rewrite rule_part_of rule_at_venue rule_in_sport rule_participated llm_gate entity_chunks extraction_input multi_hop region_of_largest_order"
    return {n: globals()[n] for n in names.split()}


def _type(c: str) -> str:
    return f"case lower({S.strip(c)}) " + " ".join(f"when '{t.lower()}' then '{t}'" for t in ENTITY_TYPES) + " end"


_ENT = f"""e as (select * from (select {S.key('id')} as id, nullif({S.collapse('name')}, '') as name, {_type('type')} as type, {S.strip('source_chunk_id')} as chunk_id, {S.strip('document_id')} as doc_id, extracted_at, deleted_at, attributes from entities) where id is not null)"""
_REL = f"""r as (select distinct on (rel_id) * from (select rel_id, {S.key('source')} as source, {_type('source_type')} as source_type, upper({S.strip('relationship')}) as relation, {S.key('target')} as target, {_type('target_type')} as target_type, nullif(upper({S.strip('medal')}), '') as medal, {S.strip('source_chunk_id')} as chunk_id, ingested_at from relationships) where rel_id is not null
  order by rel_id, ingested_at desc, source desc, source_type desc, relation desc, target desc, target_type desc, medal desc, chunk_id desc)"""
_VERT = "v as (select id, max(type) as type, arg_max(name, (extracted_at, name)) filter (where name is not null) as name, min(extracted_at) as first_seen, count(*) as mentions, bool_or(deleted_at is null) as live from e group by all)"
_EDGES = "g as (select chunk_id as src, 'MENTIONS_' || upper(type) as rel, id as dst, null::varchar as medal from e where chunk_id <> '' and type is not null union select doc_id, 'HAS_CHUNK', chunk_id, null from e where chunk_id <> '' and doc_id <> '' union select source, relation, target, medal from r where source is not null and target is not null)"
_SLUG = "regexp_replace(left(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), 40), '^-+|-+$', '', 'g')"
_CONTRACT = f"""with {_REL} select rel_id, case when source is null or target is null then 'end' when source_type is null or target_type is null then 'type' when relation is null or relation not in ({S.quoted(RELATIONS)}) then 'relation'
            when relation || ':' || source_type || ':' || target_type not in ({S.quoted(f'{r}:{s}:{t}' for r, (s, t) in RELATIONS.items())}) then 'signature' when medal is not null and (relation <> 'WON_BY' or medal not in ('GOLD', 'SILVER', 'BRONZE')) then 'medal' else 'ok' end as error from r"""


def _rule(pattern: str, relation: str) -> str:
    return f"""with {_ENT}, t as (select distinct chunk_id, text from chunks where text is not null), m as (select {S.strip('chunk_id')} as chunk_id, unnest(regexp_extract_all(text, '{pattern}', 1)) as m from t), s as (select distinct chunk_id, {_SLUG.format(c='m')} as target from m)
      select distinct e.id as source, '{relation}' as relation, s.target from e join s using (chunk_id) where e.type = 'Event' and e.chunk_id <> '' and s.target <> ''"""


def oracle_sql() -> dict[str, str]:
    return {
        "slugify": f"select distinct name, {_SLUG.format(c='name')} as slug from entities where name is not null",
        "entity_dedup": f"with {_ENT} select distinct lower(name) as name, type from e where name is not null",
        "entity_merge": f"with {_ENT} select type, lower(name) as key, arg_min(name, (extracted_at, name)) as name, count(distinct id) as n_ids, count(distinct chunk_id) as n_chunks from e where name is not null group by type, lower(name)",
        "entity_attributes": f"with {_ENT}, a as (select type, lower(name) as key, extracted_at, unnest(map_entries(attributes)) as x from e where name is not null) select type, key, x.key as attribute, arg_max(x.value, (extracted_at, x.value)) as value from a group by all",
        "relation_merge": f"with {_REL} select source, relation, target, medal, count(*) as n, count(distinct chunk_id) as n_chunks from r where source is not null and target is not null group by all",
        "graph_vertices": f"with {_ENT}, {_VERT} select * from v",
        "graph_edges": f"with {_ENT}, {_REL}, {_EDGES} select * from g",
        "graph_type_counts": f"with {_ENT}, {_VERT} select type, count(*) as n, sum(mentions) as mentions from v group by all",
        "graph_contract_check": _CONTRACT,
        "graph_contract_loaded": _CONTRACT,
        "entity_recognised": f"""with m as (select distinct lower({S.strip('name')}) as name, case lower(trim(type)) {' '.join(f"when '{x}' then '{t}'" for x, t in LABELS.items())} else 'Event' end as type from entities) select name, type, {_SLUG.format(c='name')} as slug from m where name <> ''""",
        "graph_endpoint_check": f"""with {_ENT}, {_REL}, s as (select relation, chunk_id, 'source' as side, source as id, source_type as type from r union all select relation, chunk_id, 'target', target, target_type from r), m as (select distinct id, type, chunk_id from e)
            select relation, side, case when exists (select 1 from m where m.id = s.id and m.type = s.type and m.chunk_id = s.chunk_id) then 'same_chunk' when exists (select 1 from m where m.id = s.id) then 'elsewhere' else 'nowhere' end as found, count(*) as n from s where id is not null group by all""",
        "graph_verify": f"with {_ENT}, {_REL}, {_VERT}, {_EDGES}, n as (select rel, 'source' as side, src as id from g where rel in ({S.quoted(RELATIONS)}) union all select rel, 'target', dst from g where rel in ({S.quoted(RELATIONS)})) select rel, side, count(*) as n_edges, count(distinct id) as n_ids from n where id not in (select id from v) group by all",
        "edge_rewrite": f"with {_ENT}, {_REL}, {_VERT} select distinct source, case when relation = 'PART_OF' and s.type = 'Event' and t.type = 'Event' then 'SUB_EVENT_OF' else relation end as relation, target from r join v s on s.id = source join v t on t.id = target",
        "rule_part_of": _rule(G.GAMES, "PART_OF"),
        "rule_at_venue": _rule(G.VENUE, "AT_VENUE"),
        "rule_in_sport": f"with {_ENT} select distinct a.id as source, 'IN_SPORT' as relation, b.id as target from e a join e b using (chunk_id) where chunk_id <> '' and a.type = 'Event' and b.type = 'Sport' and contains(lower(a.name), lower(b.name))",
        "rule_participated": f"with {_ENT}, v as (select chunk_id, id, row_number() over (partition by chunk_id order by id) as n from (select distinct chunk_id, id from e where type = 'Event' and chunk_id <> '')) select distinct e.id as source, 'PARTICIPATED_IN' as relation, v.id as target from e join v using (chunk_id) where e.type = 'Athlete' and n <= 2",
        "llm_gate": f"with {_ENT} select chunk_id from e where chunk_id <> '' group by all having bool_or(coalesce(type = 'Athlete', false)) and (bool_or(coalesce(type = 'Event', false)) or bool_or(coalesce(type = 'Country', false)))",
        "entity_chunks": f"with {_ENT} select type, lower(name) as key, chunk_id, min(extracted_at) as first_seen from e where name is not null and chunk_id <> '' group by all",
        "extraction_input": f"with {_ENT}, g as (select chunk_id from e where chunk_id <> '' group by all having bool_or(coalesce(type = 'Athlete', false)) and (bool_or(coalesce(type = 'Event', false)) or bool_or(coalesce(type = 'Country', false)))), m as (select distinct chunk_id, type, id from e where chunk_id <> '' and type in ('Athlete', 'Event', 'Country')) select chunk_id, type, id from m where chunk_id in (select chunk_id from g) qualify row_number() over (partition by chunk_id, type order by id) <= case type when 'Event' then 5 else 10 end",
        "multi_hop": f"with {_REL}, w as (select distinct source as event, target as athlete, medal from r where relation = 'WON_BY' and source is not null and target is not null), p as (select distinct source as athlete, target as country from r where relation = 'REPRESENTS' and source is not null and target is not null) select country, medal, count(distinct event) as n_events, count(distinct athlete) as n_athletes from w join p using (athlete) group by all",
        "region_of_largest_order": "select n_name, r_name, o_orderkey, c_name, o_totalprice from (select c_nationkey, o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey qualify row_number() over (partition by c_nationkey order by o_totalprice desc, o_orderkey) = 1) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    }
