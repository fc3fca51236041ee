"""The property graph: entities and relations checked against the contract, merged, and walked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.documents import latest
from corpusloom.schemas import ENTITY_TYPES, LABELS, MEDALS, RELATIONS

#: How texts name games and venues.
GAMES = r"(?i)([0-9]{4}\s+(?:Summer|Winter)(?:\s+(?:Olympics?|Games))?)"
VENUE = r"(?i)(?:held at|took place at|staged at|at the)\s+([a-z0-9 \-]+?(?:stadium|arena|gymnasium|oval|velodrome|pool|hall|center|centre|park|complex|track|palace))"


def type_name(c: str) -> Column:
    """A type as the contract writes it, whatever the case; null for others."""
    names = F.create_map(*[F.lit(x) for t in ENTITY_TYPES for x in (t.lower(), t)])
    return names[F.lower(T.strip(c))]


def entity_rows(entities: DataFrame) -> DataFrame:
    """Mentions with cleaned id, name and type; those without an id apart."""
    rows = entities.select(T.clean_key("id").alias("id"), F.nullif(T.collapse("name"), F.lit("")).alias("name"), type_name("type").alias("type"), T.strip("source_chunk_id").alias("chunk_id"), T.strip("document_id").alias("doc_id"), "extracted_at", "deleted_at", "attributes")
    return rows.where("id is not null")


def relation_rows(edges: DataFrame) -> DataFrame:
    """Relations with cleaned ends and medal, one row for each rel_id (the last delivered)."""
    rows = edges.select("rel_id", T.clean_key("source").alias("source"), type_name("source_type").alias("source_type"), F.upper(T.strip("relationship")).alias("relation"), T.clean_key("target").alias("target"), type_name("target_type").alias("target_type"), F.nullif(F.upper(T.strip("medal")), F.lit("")).alias("medal"), T.strip("source_chunk_id").alias("chunk_id"), "ingested_at")
    return latest(rows, ["rel_id"], ["ingested_at"])


def recognised(mentions: DataFrame, name: str = "name", label: str = "label", score: str | None = None, least: float = 0.4) -> DataFrame:
    """Distinct ``name`` (lower case), ``type`` and ``slug`` of what a recogniser has found; a label that isn't known is an event.

    Mentions that score below ``least``, or have no score where there is one to be had, and blank or null names
    are left out.
    """
    types = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    rows = mentions if score is None else mentions.where(F.col(score) >= least)
    rows = rows.select(F.lower(T.strip(name)).alias("name"), F.coalesce(types[F.lower(label)], F.lit("Event")).alias("type")).where("name <> ''")
    return rows.distinct().withColumn("slug", T.slug("name"))


def vertices(entities: DataFrame) -> DataFrame:
    """One row for each id: the type and name of its last mention that has them, first mention, number of mentions, whether any is live."""
    rows = entity_rows(entities)
    named = F.col("name").isNotNull()
    order = F.struct("extracted_at", "name")
    return rows.groupBy("id").agg(F.max("type").alias("type"), F.max_by("name", F.when(named, order)).alias("name"), F.min("extracted_at").alias("first_seen"), F.count("*").alias("mentions"), F.max(F.col("deleted_at").isNull()).alias("live"))


def edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """src, rel, dst, medal of all relations, HAS_CHUNK and MENTIONS edges, each once."""
    rows = entity_rows(entities)
    mentions = rows.where("chunk_id <> '' and type is not null").select(F.col("chunk_id").alias("src"), F.concat(F.lit("MENTIONS_"), F.upper("type")).alias("rel"), F.col("id").alias("dst"), F.lit(None).cast("string").alias("medal"))
    has = rows.where("chunk_id <> '' and doc_id <> ''").select(F.col("doc_id").alias("src"), F.lit("HAS_CHUNK").alias("rel"), F.col("chunk_id").alias("dst"), F.lit(None).cast("string").alias("medal"))
    rel = relation_rows(relations).where("source is not null and target is not null").select(F.col("source").alias("src"), F.col("relation").alias("rel"), F.col("target").alias("dst"), "medal")
    return mentions.unionByName(has).unionByName(rel).distinct()


def contract_errors(relations: DataFrame, contract: dict[str, tuple[str, str]] = RELATIONS) -> DataFrame:
    """rel_id and the first breach of the contract: ``end`` missing, unknown ``type`` or ``relation``, ``signature``, ``medal`` or ``ok``."""
    rows = relation_rows(relations)
    allowed = F.array(*[F.lit(f"{r}:{s}:{t}") for r, (s, t) in contract.items()])
    medal = F.col("medal")
    error = (
        F.when(F.col("source").isNull() | F.col("target").isNull(), "end")
        .when(F.col("source_type").isNull() | F.col("target_type").isNull(), "type")
        .when(F.col("relation").isNull() | ~F.col("relation").isin(*contract), "relation")
        .when(~F.array_contains(allowed, F.concat_ws(":", "relation", "source_type", "target_type")), "signature")
        .when(medal.isNotNull() & ((F.col("relation") != "WON_BY") | ~medal.isin(*MEDALS)), "medal")
        .otherwise("ok")
    )
    return rows.select("rel_id", error.alias("error"))


def endpoint_errors(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """By side and relation: ends that are mentioned in the relation's own chunk, elsewhere only, or nowhere."""
    rows = relation_rows(relations)
    sides = rows.select("relation", "chunk_id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("id"), F.col("source_type").alias("type")), F.struct(F.lit("target").alias("side"), F.col("target").alias("id"), F.col("target_type").alias("type")))).alias("e")).select("relation", "chunk_id", "e.*").where("id is not null")
    mentions = entity_rows(entities).select("id", "type", "chunk_id").distinct()
    # counted before the joins: many relations have one end
    counted = sides.groupBy("relation", "side", "id", "type", "chunk_id").agg(F.count("*").alias("n"))
    here = mentions.withColumn("here", F.lit(True))
    known = mentions.select("id").distinct().withColumn("known", F.lit(True))
    where = F.when(F.col("here"), "same_chunk").when(F.col("known"), "elsewhere").otherwise("nowhere")
    return counted.join(here, ["id", "type", "chunk_id"], "left").join(known, "id", "left").groupBy("relation", "side", where.alias("found")).agg(F.sum("n").alias("n"))


def missing_vertices(all_edges: DataFrame, all_vertices: DataFrame) -> DataFrame:
    """Relations whose ends are no vertices, by relation and side: what a load would have to report."""
    rel = all_edges.where(F.col("rel").isin(*RELATIONS))
    ends = rel.select("rel", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("src").alias("id")), F.struct(F.lit("target").alias("side"), F.col("dst").alias("id")))).alias("e")).select("rel", "e.*")
    return ends.join(all_vertices.select("id"), "id", "left_anti").groupBy("rel", "side").agg(F.count("*").alias("n_edges"), F.countDistinct("id").alias("n_ids"))


def rewrite_event_edges(relations: DataFrame, all_vertices: DataFrame) -> DataFrame:
    """source, relation, target, once each, of relations between known vertices; PART_OF between two events becomes SUB_EVENT_OF."""
    types = all_vertices.select("id", "type")
    rows = relation_rows(relations).select("source", "relation", "target").distinct()
    rows = rows.join(types.withColumnsRenamed({"id": "source", "type": "s"}), "source").join(types.withColumnsRenamed({"id": "target", "type": "t"}), "target")
    return rows.select("source", F.when((F.col("relation") == "PART_OF") & (F.col("s") == "Event") & (F.col("t") == "Event"), "SUB_EVENT_OF").otherwise(F.col("relation")).alias("relation"), "target").distinct()


def merged_entities(entities: DataFrame) -> DataFrame:
    """Mentions put together by type and name in lower case: first written name, ids, chunks."""
    rows = entity_rows(entities).where("name is not null")
    return rows.groupBy("type", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("extracted_at", "name")).alias("name"), F.countDistinct("id").alias("n_ids"), F.countDistinct("chunk_id").alias("n_chunks"))


def merged_attributes(entities: DataFrame) -> DataFrame:
    """Of each merged entity and attribute the value written last."""
    rows = entity_rows(entities).where("name is not null and attributes is not null").select("type", F.lower("name").alias("key"), "extracted_at", F.explode("attributes").alias("attribute", "value"))
    return rows.groupBy("type", "key", "attribute").agg(F.max_by("value", F.struct("extracted_at", "value")).alias("value"))


def chunks_of_entities(entities: DataFrame) -> DataFrame:
    """Of each merged entity its different chunks, each with the time of its first mention there, by which they are ordered. A row each, so a much mentioned entity is no single row."""
    rows = entity_rows(entities).where("name is not null and chunk_id <> ''")
    return rows.groupBy("type", F.lower("name").alias("key"), "chunk_id").agg(F.min("extracted_at").alias("first_seen"))


def capped_mentions(entities: DataFrame, caps: dict[str, int]) -> DataFrame:
    """chunk_id, type, id of the chunks worth extracting: of each chunk the first ids of the types in ``caps``, so many at most."""
    rows = entity_rows(entities).where("chunk_id <> ''").select("chunk_id", "type", "id").where(F.col("type").isin(list(caps))).distinct()
    most = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("type")]
    kept = rows.selectExpr("*", "row_number() over (partition by chunk_id, type order by id) as n").where(F.col("n") <= most)
    return kept.join(worth_extracting(entities), "chunk_id", "left_semi").select("chunk_id", "type", "id")


def merged_relations(relations: DataFrame) -> DataFrame:
    """Relations put together by ends, name and medal: how many say so, and in how many chunks."""
    rows = relation_rows(relations).where("source is not null and target is not null")
    return rows.groupBy("source", "relation", "target", "medal").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


def _in_chunks(entities: DataFrame, kind: str) -> DataFrame:
    return entity_rows(entities).where((F.col("type") == kind) & (F.col("chunk_id") != "")).select("chunk_id", "id", "name").distinct()


def _named_in_text(entities: DataFrame, passages: DataFrame, pattern: str, relation: str) -> DataFrame:
    events = _in_chunks(entities, "Event").select("chunk_id", F.col("id").alias("source")).distinct()
    found = passages.select(T.strip("chunk_id").alias("chunk_id"), F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("m"))
    found = found.select("chunk_id", T.slug("m").alias("target")).where("target <> ''").distinct()
    return events.join(found, "chunk_id").select("source", F.lit(relation).alias("relation"), "target").distinct()


def games_named(entities: DataFrame, passages: DataFrame, pattern: str = GAMES) -> DataFrame:
    """PART_OF from every event of a chunk to the games that its text names."""
    return _named_in_text(entities, passages, pattern, "PART_OF")


def venues_named(entities: DataFrame, passages: DataFrame, pattern: str = VENUE) -> DataFrame:
    """AT_VENUE from every event of a chunk to the venues that its text names."""
    return _named_in_text(entities, passages, pattern, "AT_VENUE")


def sports_of_events(entities: DataFrame) -> DataFrame:
    """IN_SPORT where an event's name has the name of a sport mentioned in the same chunk."""
    events, sports = _in_chunks(entities, "Event"), _in_chunks(entities, "Sport")
    joined = events.select("chunk_id", F.col("id").alias("source"), F.lower("name").alias("event")).join(sports.select("chunk_id", F.col("id").alias("target"), F.lower("name").alias("sport")), "chunk_id")
    return joined.where(F.col("event").contains(F.col("sport"))).select("source", F.lit("IN_SPORT").alias("relation"), "target").distinct()


def participants(entities: DataFrame) -> DataFrame:
    """PARTICIPATED_IN from every athlete of a chunk to its first two events."""
    athletes = _in_chunks(entities, "Athlete").select("chunk_id", F.col("id").alias("source")).distinct()
    events = _in_chunks(entities, "Event").select("chunk_id", "id").distinct().selectExpr("chunk_id", "id as target", "row_number() over (partition by chunk_id order by id) as n").where("n <= 2")
    return athletes.join(events, "chunk_id").select("source", F.lit("PARTICIPATED_IN").alias("relation"), "target").distinct()


def worth_extracting(entities: DataFrame) -> DataFrame:
    """Chunks that name an athlete and an event or a country."""
    kinds = entity_rows(entities).where("chunk_id <> ''").groupBy("chunk_id").agg(*[F.max(F.coalesce(F.col("type") == k, F.lit(False))).alias(k) for k in ("Athlete", "Event", "Country")])
    return kinds.where("Athlete and (Event or Country)").select("chunk_id")


def winners_by_country(relations: DataFrame) -> DataFrame:
    """Two steps: events to the athletes who won them, and these to the countries they represent. Edges are made distinct before each join."""
    rows = relation_rows(relations).where("source is not null and target is not null")
    won = rows.where("relation = 'WON_BY'").select(F.col("source").alias("event"), F.col("target").alias("athlete"), "medal").distinct()
    of = rows.where("relation = 'REPRESENTS'").select(F.col("source").alias("athlete"), F.col("target").alias("country")).distinct()
    return won.join(of, "athlete").groupBy("country", "medal").agg(F.countDistinct("event").alias("n_events"), F.countDistinct("athlete").alias("n_athletes"))
