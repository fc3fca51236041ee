"""Queries over raw documents and chunks: profiles, audits, validation, incremental loads."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, documents, incremental, integrity
from corpusloom.plans import sql as S
from corpusloom.schemas import CHUNK_TYPES, MOST_TOKENS, SECTION_NAMES, WORDS_PER_PIECE
from corpusloom.session import new_folder, spread, table

FIELDS = ["doc_id", "title", "text", "url", "wikidata_qid", "wikipedia_pageid", "approx_tokens"]


def _docs(spark, d):
    return table(spark, d, "documents")


def approx_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.approx_tokens("text").alias("tokens"))


def profile_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.lower(F.trim("source")).alias("source"), T.approx_tokens("text").alias("t"), F.col("n_chars").alias("c"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), *[x.alias(f"{n}_{k}") for k, c in (("tokens", "t"), ("chars", "c")) for n, x in (("sum", F.sum(c)), ("min", F.min(c)), ("max", F.max(c)), ("mean", F.round(F.avg(c), 6)), ("median", F.median(c)))])


def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_docs").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"), F.count_if(T.strip("text") == "").alias("n_blank"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"))


def profile_missing(spark: SparkSession, d: str) -> DataFrame:
    return documents.missing_fields(table(spark, d, "corpus_docs"), FIELDS)


def profile_dups(spark: SparkSession, d: str) -> DataFrame:
    return documents.repeated_values(table(spark, d, "corpus_docs"), ["doc_id", "title", "wikidata_qid"])


def structure_audit(spark: SparkSession, d: str) -> DataFrame:
    return documents.structure(_docs(spark, d).withColumn("source", F.lower(F.trim("source"))), "source")


def profile_structure(spark: SparkSession, d: str) -> DataFrame:
    return documents.structure(table(spark, d, "corpus_docs").withColumn("deleted", F.col("deleted_at").isNotNull()), "deleted")


def longest_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "title", T.approx_tokens("text").alias("tokens"))
    return rows.orderBy(F.desc_nulls_last("tokens"), "doc_id").limit(10)


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


def ingest_corrupt(spark: SparkSession, d: str) -> DataFrame:
    """The JSON in events, parsed leniently: rows and sums by type, and how many don't parse."""
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k BIGINT, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("p._corrupt").isNotNull()).alias("n_corrupt"), F.sum("p.k").alias("sum_k"))


def record_validation(spark: SparkSession, d: str) -> DataFrame:
    return documents.record_errors(table(spark, d, "corpus_docs"))


def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = T.clean_lines("text")
    return _docs(spark, d).select("doc_id", F.size(lines).alias("n_lines"), F.length(F.array_join(lines, "\n")).alias("n_chars")).where("n_lines >= 0")


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select(F.explode(T.clean_lines("text")).alias("line")).where(chunking.is_heading(F.col("line")))
    return lines.groupBy(F.lower("line").alias("heading")).agg(F.count("*").alias("n"))


def table_like(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", "text", T.once(T.clean_lines("text")).alias("lines"))
    n = F.size(F.filter("lines", T.is_table_row))
    return rows.select("doc_id", n.alias("n_rows"), ((n >= 2) | ((n >= 1) & F.col("text").contains("Results table"))).alias("table_like"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", T.once(T.paragraphs("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", T.once(T.sentences("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


def pack_words(spark: SparkSession, d: str) -> DataFrame:
    """Every text in pieces of as many words as have the target number of tokens."""
    rows = _docs(spark, d).select("doc_id", T.word_count("text").alias("n")).where("n > 0")
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / WORDS_PER_PIECE))).alias("piece"))
    return rows.select("doc_id", "piece", F.least(F.lit(WORDS_PER_PIECE).cast("long"), F.col("n") - F.col("piece") * WORDS_PER_PIECE).alias("n_words"))


def _corpus_chunks(spark, d):
    docs = spread(_docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return docs, chunking.chunk_documents(docs)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all documents, their texts as hashes."""
    return _corpus_chunks(spark, d)[1].select("chunk_id", "doc_id", "chunk_index", "chunk_type", "section", F.element_at("section_path", 1).alias("path"), "approx_tokens", F.sha2("text", 256).alias("hash"))


def corpus_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the live rows of corpus_docs."""
    return chunking.chunk_documents(documents.live_documents(table(spark, d, "corpus_docs")))


def infobox_split(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.split_box(_docs(spark, d).select("doc_id", "text"))
    return rows.where("text is not null").select("doc_id", F.size("box").alias("box_lines"), F.size("body").alias("body_lines"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.with_sections(chunking.split_box(_docs(spark, d).select("doc_id", "text")))
    rows = rows.select("doc_id", F.posexplode("sections").alias("section_no", "s"))
    return rows.select("doc_id", "section_no", F.col("s.section").alias("section"), F.size("s.lines").alias("n_lines"), F.length(F.array_join(F.transform("s.lines", T.strip), "\n")).alias("n_chars"))


def chunk_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_chunks(spark, d)[1].groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("approx_tokens").alias("tokens"))


def dataset_metadata(spark: SparkSession, d: str) -> DataFrame:
    kinds = [F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in CHUNK_TYPES]
    return _corpus_chunks(spark, d)[1].agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.sum("approx_tokens").alias("tokens"), *kinds)


def chunk_validation(spark: SparkSession, d: str) -> DataFrame:
    return integrity.chunk_errors(table(spark, d, "chunks"), table(spark, d, "corpus_docs"))


def chunk_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a hundred chunks in their order."""
    rows = table(spark, d, "chunks").select("doc_id", "chunk_index", "chunk_id").distinct()
    return rows.orderBy("doc_id", "chunk_index", "chunk_id").offset(100).limit(100)


def chunk_point(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("chunk_id = 'Q4100_chunk_0001'").select("chunk_id", "doc_id", "chunk_type", "text").distinct()


def _sized(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", "doc_id", "chunk_type", "section", "text").dropDuplicates(["chunk_id", "text"]).withColumn("tokens", T.approx_tokens("text")).withColumn("n_words", T.word_count("text"))


def chunk_size_buckets(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tokens")
    buckets = {"tiny": t < 10, "small": t < 50, "large": t > 1000, "huge": t > 2000, "few_words": F.col("n_words") < 10}
    return _sized(spark, d).groupBy("chunk_type").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in buckets.items()])


def token_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return integrity.floor_percentiles(_sized(spark, d), "chunk_type", "tokens", [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])


def chunks_per_doc(spark: SparkSession, d: str) -> DataFrame:
    per = _sized(spark, d).groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return per.groupBy("n_chunks").agg(F.count("*").alias("n_docs"))


def section_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _sized(spark, d).groupBy(F.lower(T.collapse("section")).alias("section")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "section").limit(15)


def coverage_anti(spark: SparkSession, d: str) -> DataFrame:
    return integrity.uncovered(table(spark, d, "corpus_docs"), table(spark, d, "chunks"))


def integrity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return integrity.token_differences(*_corpus_chunks(spark, d))


def integrity_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of live documents against the stored chunks, as bags."""
    return integrity.line_differences(documents.live_documents(table(spark, d, "corpus_docs")), table(spark, d, "chunks"))


def integrity_chars(spark: SparkSession, d: str) -> DataFrame:
    return integrity.character_ratio(*_corpus_chunks(spark, d))


def loss_classes(spark: SparkSession, d: str) -> DataFrame:
    return integrity.loss_classes(documents.live_documents(table(spark, d, "corpus_docs")), table(spark, d, "chunks"))


def results_class(spark: SparkSession, d: str) -> DataFrame:
    return documents.results_classes(_docs(spark, d))


def first_diff(spark: SparkSession, d: str) -> DataFrame:
    return documents.first_difference(table(spark, d, "corpus_docs"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return documents.latest(table(spark, d, "corpus_docs"), ["doc_id"], ["loaded_at"]).select("doc_id", "title", "loaded_at", "deleted_at", F.sha2("text", 256).alias("hash"))


def hash_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that arrived by the end of June 2025 as the stored state, all of them as the new delivery."""
    rows = table(spark, d, "chunks")
    return incremental.changes(rows.where("ingested_at < timestamp_ntz'2025-07-01 00:00:00'"), rows)


def corpus_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = chunking.with_pieces(chunking.with_sections(chunking.split_box(docs)))
    return rows.select("doc_id", F.posexplode("pieces").alias("k", "p")).select("doc_id", "p.section", "p.type", T.approx_tokens("p.text").alias("tokens"), F.sha2("p.text", 256).alias("hash"))


def chunk_prose(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of prose before small ones are merged."""
    return corpus_pieces(spark, d).where("type = 'text'").drop("type")


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of tables before small ones are merged."""
    return corpus_pieces(spark, d).where("type = 'table'").drop("type")


def merge_small(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces each chunk has after small ones are merged, and their words."""
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = chunking.with_groups(chunking.with_pieces(chunking.with_sections(chunking.split_box(docs))))
    return rows.select("doc_id", F.posexplode("groups").alias("chunk_index", "g")).select("doc_id", "chunk_index", (F.col("g.hi") - F.col("g.lo") + 1).alias("n_pieces"), F.col("g.words").alias("n_words"))


def pack_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every text packed to size."""
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.posexplode(T.pack(T.sentences("text"), MOST_TOKENS, " ")).alias("piece", "x"))
    return rows.select("doc_id", "piece", T.approx_tokens("x").alias("tokens"), F.sha2("x", 256).alias("hash"))


def content_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether the chunks of each document have its words in its order (headings apart), how many, and whether its characters are kept."""
    return integrity.ordered_content(*_corpus_chunks(spark, d))


def smallest_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", "title", T.approx_tokens("text").alias("tokens"))
    return rows.orderBy("tokens", "doc_id").limit(10)


def largest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _sized(spark, d).select("chunk_id", "tokens").groupBy("chunk_id").agg(F.max("tokens").alias("tokens")).orderBy(F.desc("tokens"), "chunk_id").limit(10)


def char_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.char_tokens("text").alias("tokens"))


def section_path_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("section_path is not null").select("chunk_id", F.to_json("section_path").alias("path")).distinct()


def whole_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Page ids in mixed notations, as numbers where they are ones."""
    return table(spark, d, "corpus_docs").select("doc_id", "wikipedia_pageid", T.whole_number("wikipedia_pageid").alias("page")).distinct()


def sanitized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("name").distinct().select("name", T.sanitize("name", 40).alias("plain"))


def title_allowlist(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose title is that of a document that some question names."""
    named = table(spark, d, "questions").select(F.explode("gold_doc_ids").alias("k")).distinct()
    titles = table(spark, d, "corpus_docs").select(T.strip("doc_id").alias("k"), "title").join(named, "k", "left_semi").select("title").where("title is not null").distinct()
    return table(spark, d, "chunks").select("chunk_id", "title").join(titles, "title", "left_semi").select("chunk_id", "title").distinct()


def state_loads(spark: SparkSession, d: str) -> DataFrame:
    """Three loads one after the other against a stored state: chunks that arrived by the end of June 2025, all of them, all of them again."""
    rows, folder = table(spark, d, "chunks"), new_folder(spark, "loads")
    early = rows.where("ingested_at < timestamp_ntz'2025-07-01 00:00:00'")
    loads = [incremental.load(delivered, folder, k) for k, delivered in enumerate((early, rows, rows), 1)]
    return functools.reduce(DataFrame.unionByName, [x.withColumn("load", F.lit(k)) for k, x in enumerate(loads, 1)])


def events_latest(spark: SparkSession, d: str) -> DataFrame:
    return documents.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_id", "event_type", "value")



def queries() -> dict:
    names = "approx_tokens profile_tokens profile_summary profile_missing profile_dups structure_audit profile_structure longest_docs content_hash ingest_corrupt record_validation normalize_lines heading_lines table_like paragraphs sentences pack_words chunks corpus_chunks infobox_split sections chunk_type_counts dataset_metadata chunk_validation chunk_page chunk_point chunk_size_buckets token_percentiles chunks_per_doc section_topk coverage_anti integrity_tokens integrity_lines integrity_chars loss_classes results_class first_diff upsert_latest hash_incremental events_latest chunk_prose chunk_table merge_small pack_sentences content_order smallest_docs largest_chunks char_tokens section_path_json whole_numbers sanitized title_allowlist state_loads"
    return {n: globals()[n] for n in names.split()}


_HEADS = S.quoted(SECTION_NAMES)
_HEADING = f"(not contains(x, '|') and not contains(x, '!!') and lower({S.collapse('x')}) in ({_HEADS}))"
_SIZED = f"""(select *, {S.tokens('text')} as tokens, {S.words('text')} as n_words from (select distinct on (chunk_id, text) chunk_id, doc_id, chunk_type, section, text from chunks where text is not null))"""
_LIVE = "(select * from (select distinct on (doc_id) * from corpus_docs where doc_id is not null order by doc_id, loaded_at desc, title desc, text desc, url desc nulls last, wikidata_qid desc nulls last) where deleted_at is null)"
_STRUCTURE = f"""count(*) as n, count(*) filter (where contains(text, '[Infobox')) as with_box, count(*) filter (where contains(text, chr(10) || 'Results') or starts_with(text, 'Results')) as with_results,
  count(*) filter (where contains(text, 'Results table')) as with_results_table, count(*) filter (where len(list_filter({S.clean_lines('text')}, lambda x: {S.table_row('x')})) > 0) as with_rows,
  count(*) filter (where contains(text, '!!')) as with_bangs, count(*) filter (where contains(text, chr(10) || '|')) as with_pipe_line, count(*) filter (where contains(text, chr(10) || '==') or starts_with(text, '==')) as with_wiki_heading,
  count(*) filter (where contains(text, chr(10) || chr(10))) as with_paragraphs"""
_STATS = ", ".join(f"sum({c}) as sum_{k}, min({c}) as min_{k}, max({c}) as max_{k}, round(avg({c}), 6) as mean_{k}, median({c}) as median_{k}" for k, c in (("tokens", "t"), ("chars", "c")))
_BOX = f"""
with l as (select doc_id, text, string_split_regex(text, '{S.LINES}') as ls from documents where text is not null),
o as (select *, coalesce(list_position(list_transform(ls, lambda x: starts_with({S.strip('x')}, '[Infobox')), true), 0) as o from l),
c as (select *, case when o = 0 then 0 else coalesce(list_min(list_filter(range(o + 1, len(ls) + 1), lambda k: not ({S.strip('ls[k]')} = '' or starts_with(ls[k], '  ') or starts_with({S.strip('ls[k]')}, '[Infobox')))), len(ls) + 1) end as c from o),
b as (select doc_id, list_filter(ls[greatest(o, 1) : c - 1], lambda x: o > 0 and {S.strip('x')} <> '') as box, list_filter(list_transform(list_filter(range(1, len(ls) + 1), lambda k: o = 0 or k < o or k >= c), lambda k: ls[k]), lambda x: {S.strip('x')} <> '') as body from c)
"""
_SECTIONS = f"""{_BOX}, n as (select doc_id, unnest(body) as x, unnest(range(1, len(body) + 1)) as k from b),
h as (select *, {_HEADING.replace('(x', f"({S.strip('x')}")} as h from n),
g as (select *, sum(h::int) over (partition by doc_id order by k) as g from h),
s as (select doc_id, g, coalesce(max(case when h then {S.strip('x')} end), 'introduction') as section, count(*) filter (where not h) as n_lines, sum(len({S.strip('x')})) filter (where not h) + count(*) filter (where not h) - 1 as n_chars from g group by all)
select doc_id, row_number() over (partition by doc_id order by g) - 1 as section_no, section, n_lines, n_chars from s where n_lines > 0"""


def _packed(name: str, items: str) -> str:
    """Recursive packing of ``items`` (id, i from 1, size): adds the group ``g`` of each."""
    return f"""{name} as (select id, i, 0 as g, size::bigint as used from {items} where i = 1
    union all select t.id, t.i, r.g + (r.used + t.size > 800)::int, case when r.used + t.size > 800 then t.size else r.used + t.size end from {name} r join {items} t on t.id = r.id and t.i = r.i + 1)"""


_CHUNKS = f"""{_BOX.replace('with l as', 'with recursive l as', 1)}, n as (select doc_id, unnest(body) as x, unnest(range(1, len(body) + 1)) as k from b),
h as (select *, {_HEADING.replace('(x', f"({S.strip('x')}")} as h from n),
g as (select *, sum(h::int) over (partition by doc_id order by k) as g from h),
sec as (select doc_id, g as sno, coalesce(max(case when h then {S.strip('x')} end), 'introduction') as section, list(x order by k) filter (where not h) as ls from g group by all having count(*) filter (where not h) > 0),
kind as (select *, len(list_filter(list_transform(ls, lambda x: {S.strip('x')}), lambda x: {S.table_row('x')})) as rows, {S.strip("array_to_string(ls, chr(10))")} as whole from sec),
unit as (select doc_id || '/' || sno as id, doc_id, sno, section, ls, whole, rows >= 2 or (rows >= 1 and contains(whole, 'Results table')) as tab,
  list_filter(list_transform(string_split(regexp_replace(whole, '([.!?])[{S.BLANKS}]+([A-Z0-9\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {S.strip('x')}), lambda x: x <> '') as st,
  string_split_regex(whole, '[{S.BLANKS}]+') as ws from kind),
how as (select *, case when tab then 'rows' when {S.tokens('whole')} <= 800 then 'whole' when len(st) > 1 then 'sentences' else 'words' end as how from unit),
lists as (select id, how, case how when 'rows' then list_transform(ls, lambda x: regexp_replace(x, '[{S.BLANKS}]+$', '')) when 'whole' then [whole] when 'sentences' then st
  else list_transform(range(0, (len(ws) - 1) // {WORDS_PER_PIECE} + 1), lambda k: array_to_string(ws[k * {WORDS_PER_PIECE} + 1 : (k + 1) * {WORDS_PER_PIECE}], ' ')) end as items from how),
items as (select id, how, unnest(items) as x, unnest(range(1, len(items) + 1)) as i from lists),
sizes as (select id, i, {S.tokens('x')} as size from items where how in ('rows', 'sentences')),
{_packed('packed', 'sizes')},
pieces as (select id, how, coalesce(p.g, i) as g, case any_value(how) when 'rows' then array_to_string(list(x order by i), chr(10)) else array_to_string(list(x order by i), ' ') end as x from items left join packed p using (id, i) group by all),
numbered as (select *, row_number() over (partition by id order by g) as i from pieces),
again as (select id, i, {S.tokens('x')} as size from numbered where how <> 'rows'),
{_packed('repacked', 'again')},
texts as (select id, how, coalesce(r.g, i) as g, array_to_string(list(x order by i), chr(10) || chr(10)) as x from numbered left join repacked r using (id, i) group by all),
parts as (select u.doc_id, u.sno, t.g, case when tab then 'table' else 'text' end as type, section, {S.strip('x')} as text from texts t join unit u using (id) where {S.strip('x')} <> ''
  union all select doc_id, -1, 0, 'infobox', 'infobox', array_to_string(list_transform(box, lambda x: {S.strip('x')}), chr(10)) from b where len(box) > 0),
sized as (select *, {S.words('text')} as words, {S.tokens('text')} as tokens, row_number() over (partition by doc_id order by sno, g) as k from parts),
total as (select doc_id, count(*) as n, sum(tokens) as total from sized group by all),
look as (select s.*, n <= 1 or total <= 400 as plain, lead(type) over w as ntype, lead(tokens) over w as ntokens, lead(words) over w as nwords, lead(section) over w as nsection from sized s join total using (doc_id) window w as (partition by doc_id order by k)),
step as (select *, plain or type = 'infobox' or tokens >= 50 as keep, not plain and type is not distinct from ntype and tokens + ntokens <= 800 as fits, words + nwords as bwords from look),
fold as (select doc_id, k, 1 as m, type as mtype, case when not keep and fits then bwords else words end as mwords, case when not keep and fits and section <> nsection then section || ' + ' || nsection else section end as msection, case when not keep and fits then nsection else section end as path, not keep and fits as skip from step where k = 1
  union all select s.doc_id, s.k,
    case when f.skip then f.m when s.keep or s.fits then f.m + 1 when f.mtype = s.type and {{back}} + s.tokens <= 800 then f.m else f.m + 1 end,
    case when f.skip then f.mtype else s.type end,
    case when f.skip then f.mwords when s.keep then s.words when s.fits then s.bwords when f.mtype = s.type and {{back}} + s.tokens <= 800 then f.mwords + s.words else s.words end,
    case when f.skip then f.msection when s.keep then s.section when s.fits then case when s.section <> s.nsection then s.section || ' + ' || s.nsection else s.section end
      when f.mtype = s.type and {{back}} + s.tokens <= 800 then case when f.msection <> s.section then f.msection || ' + ' || s.section else f.msection end else s.section end,
    case when f.skip then f.path when s.keep then s.section when s.fits then s.nsection when f.mtype = s.type and {{back}} + s.tokens <= 800 then f.path else s.section end,
    not f.skip and not s.keep and s.fits
  from fold f join step s on s.doc_id = f.doc_id and s.k = f.k + 1),
merged as (select doc_id, m, max_by(mtype, k) as chunk_type, max_by(mwords, k) as words, max_by(msection, k) as section, max_by(path, k) as path, array_to_string(list(text order by k), chr(10) || chr(10)) as text from fold join sized using (doc_id, k) group by all)
select doc_id::varchar as doc_id, m - 1 as chunk_index, chunk_type, section, path, greatest(1, cast(floor(words * 1.3::double) as int)) as approx_tokens, sha256(text) as hash,
  doc_id || case when chunk_type = 'infobox' then '_infobox' else '_chunk_' || lpad((m - 1)::varchar, 4, '0') end as chunk_id from merged
""".replace("{back}", "greatest(1, cast(floor(f.mwords * 1.3::double) as int))")


_PARTS = _CHUNKS[: _CHUNKS.index("sized as (select *, ")].rstrip().rstrip(",")
_MERGED = _CHUNKS[: _CHUNKS.rindex("select doc_id::varchar as doc_id, m - 1")]
_STATES = """c as (select distinct on (chunk_id) chunk_id, text, ingested_at from chunks where chunk_id is not null order by chunk_id, ingested_at desc nulls last, sha256(text) desc nulls last),
  p as (select distinct on (chunk_id) chunk_id, text from chunks where chunk_id is not null and ingested_at < timestamp '2025-07-01' order by chunk_id, ingested_at desc nulls last, sha256(text) desc nulls last)"""


def oracle_sql() -> dict[str, str]:
    heading = _HEADING
    body_tokens = f"select doc_id::varchar as doc_id, sum({S.words('x')}) as n from (select doc_id, unnest({S.clean_lines('text')}) as x from documents) where not {heading} group by all"
    return {
        "approx_tokens": f"select doc_id, {S.tokens('text')} as tokens from documents",
        "profile_tokens": f"select source, count(*) as n, {_STATS} from (select lower(trim(source)) as source, {S.tokens('text')} as t, n_chars as c from documents) group by source",
        "profile_summary": f"select count(*) as n_rows, count(distinct doc_id) as n_ids, count(*) filter (where {S.strip('text')} = '') as n_blank, count(deleted_at) as n_deleted from corpus_docs",
        "profile_missing": " union all ".join(f"select '{c}' as field, count(*) filter (where {c} is null or {c}::varchar = '') as n_missing from corpus_docs" for c in FIELDS),
        "profile_dups": " union all ".join(f"select '{c}' as field, {c}::varchar as value, count(*) as n from corpus_docs where {c} <> '' group by all having count(*) > 1" for c in ("doc_id", "title", "wikidata_qid")),
        "structure_audit": f"select lower(trim(source)) as source, {_STRUCTURE} from documents group by 1",
        "profile_structure": f"select deleted_at is not null as deleted, {_STRUCTURE} from corpus_docs group by 1",
        "longest_docs": f"select doc_id, title, {S.tokens('text')} as tokens from documents order by tokens desc nulls last, doc_id limit 10",
        "content_hash": "select doc_id, sha256(text) as hash from documents",
        "ingest_corrupt": "select event_type, count(*) as n, count(*) filter (where not json_valid(props)) as n_corrupt, sum(case when json_valid(props) then (props->>'k')::bigint end)::bigint as sum_k from events group by all",
        "record_validation": f"select doc_id, title, case when doc_id is null or title is null or text is null then 'missing' when {S.strip('doc_id')} = '' or {S.strip('title')} = '' or {S.strip('text')} = '' then 'blank' when count(*) over (partition by doc_id) > 1 then 'duplicate' else 'ok' end as error from corpus_docs",
        "normalize_lines": f"select doc_id, len(l) as n_lines, len(array_to_string(l, chr(10))) as n_chars from (select doc_id, {S.clean_lines('text')} as l from documents where text is not null)",
        "heading_lines": f"select lower(x) as heading, count(*) as n from (select unnest({S.clean_lines('text')}) as x from documents) where {heading} group by all",
        "table_like": f"select doc_id, n as n_rows, n >= 2 or (n >= 1 and contains(text, 'Results table')) as table_like from (select doc_id, text, len(list_filter({S.clean_lines('text')}, lambda x: {S.table_row('x')})) as n from documents where text is not null)",
        "paragraphs": f"select doc_id, len(p) as n, coalesce(list_max(list_transform(p, lambda x: len(x))), 0) as longest from (select doc_id, list_filter(list_transform(string_split_regex({S.strip('text')}, '\\n[{S.BLANKS}]*\\n+'), lambda x: {S.strip('x')}), lambda x: x <> '') as p from documents where text is not null)",
        "sentences": f"select doc_id, len(p) as n, coalesce(list_max(list_transform(p, lambda x: len(x))), 0) as longest from (select doc_id, list_filter(list_transform(string_split(regexp_replace({S.strip('text')}, '([.!?])[{S.BLANKS}]+([A-Z0-9\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {S.strip('x')}), lambda x: x <> '') as p from documents where text is not null)",
        "pack_words": f"select doc_id, piece, least({WORDS_PER_PIECE}, n - piece * {WORDS_PER_PIECE}) as n_words from (select doc_id, n, unnest(range(0, (n - 1) // {WORDS_PER_PIECE} + 1)) as piece from (select doc_id, {S.words('text')} as n from documents) where n > 0)",
        "chunks": _CHUNKS,
        "corpus_chunks": _CHUNKS.replace("from documents where", f"from {_LIVE} where").replace("section, path, greatest", "section, [path] as section_path, greatest").replace("sha256(text) as hash", "text"),
        "chunk_prose": f"{_PARTS} select doc_id::varchar as doc_id, section, {S.tokens('text')} as tokens, sha256(text) as hash from parts where type = 'text'",
        "chunk_table": f"{_PARTS} select doc_id::varchar as doc_id, section, {S.tokens('text')} as tokens, sha256(text) as hash from parts where type = 'table'",
        "merge_small": f"{_MERGED} select doc_id::varchar as doc_id, m - 1 as chunk_index, count(*) as n_pieces, max_by(mwords, k) as n_words from fold group by doc_id, m",
        "pack_sentences": f"with recursive s as (select doc_id as id, list_filter(list_transform(string_split(regexp_replace({S.strip('text')}, '([.!?])[{S.BLANKS}]+([A-Z0-9\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {S.strip('x')}), lambda x: x <> '') as p from documents where text is not null), t as (select id, unnest(p) as x, unnest(range(1, len(p) + 1)) as i from s), z as (select id, i, {S.tokens('x')} as size from t), {_packed('packed', 'z')}, j as (select id, g, array_to_string(list(x order by i), ' ') as x from t join packed using (id, i) group by all) select id as doc_id, g as piece, {S.tokens('x')} as tokens, sha256(x) as hash from j",
        "content_order": f"{_MERGED}, kept as (select doc_id, {S.collapse('x')} as b from (select doc_id, array_to_string(list(text order by m), ' ') as x from merged group by all)), original as (select doc_id, {S.collapse('x')} as a from (select doc_id, array_to_string(list_filter({S.clean_lines('text')}, lambda x: not {_HEADING}), ' ') as x from documents where text is not null)) select doc_id::varchar as doc_id, a = coalesce(b, '') as same_order, round({S.words('b')} / {S.words('a')}, 6) as token_ratio, round(len(replace(b, ' ', '')) / len(replace(a, ' ', '')), 6) as char_ratio, len(replace(b, ' ', '')) / len(replace(a, ' ', '')) >= 0.995 as lossless from original left join kept using (doc_id) where a <> ''",
        "smallest_docs": f"select doc_id, title, {S.tokens('text')} as tokens from documents where text is not null order by tokens, doc_id limit 10",
        "largest_chunks": f"select chunk_id, max(tokens) as tokens from {_SIZED} group by all order by tokens desc, chunk_id limit 10",
        "char_tokens": "select doc_id, len(text) // 4 as tokens from documents",
        "section_path_json": "select distinct chunk_id, to_json(section_path)::varchar as path from chunks where section_path is not null",
        "whole_numbers": "select distinct doc_id, wikipedia_pageid, case when regexp_full_match(trim(wikipedia_pageid), '[+-]?[0-9]{1,18}') then trim(wikipedia_pageid)::bigint end as page from corpus_docs",
        "sanitized": "select distinct name, trim(left(regexp_replace(regexp_replace(strip_accents(replace(name, chr(160), ' ')), '[^\\x00-\\x7f]+', '', 'g'), '[ \\t]+', ' ', 'g'), 40)) as plain from entities where name is not null",
        "title_allowlist": f"select distinct chunk_id, title from chunks where title in (select title from corpus_docs where {S.strip('doc_id')} in (select unnest(gold_doc_ids) from questions) and title is not null)",
        "state_loads": f"with {_STATES} select 1 as load, 'new' as change, count(*) as n from p group by all union all select 2, case when p.chunk_id is null then 'new' when p.text is distinct from c.text then 'changed' else 'same' end, count(*) from c left join p using (chunk_id) group by all union all select 3, 'same', count(*) from c group by all",
        "chunk_type_counts": f"select chunk_type, count(*) as n, sum(approx_tokens)::bigint as tokens from ({_CHUNKS}) group by all",
        "dataset_metadata": f"select count(distinct doc_id) as n_documents, count(*) as n_chunks, sum(approx_tokens)::bigint as tokens, {', '.join(f"count(*) filter (where chunk_type = '{k}') as n_{k}" for k in CHUNK_TYPES)} from ({_CHUNKS})",
        "infobox_split": f"{_BOX} select doc_id, len(box) as box_lines, len(body) as body_lines from b",
        "sections": _SECTIONS,
        "chunk_validation": f"""select chunk_id, case when chunk_id is null or doc_id is null or title is null or chunk_index is null or chunk_type is null or section is null or section_path is null or approx_tokens is null or text is null then 'missing'
            when {S.strip('text')} = '' or {S.strip('chunk_id')} = '' or {S.strip('title')} = '' then 'blank' when chunk_type not in ('text', 'table', 'infobox') then 'type' when approx_tokens < 1 or chunk_index < 0 then 'range'
            when coalesce({S.key('doc_id')}, '') not in (select {S.key('doc_id')} from corpus_docs where doc_id is not null) then 'unknown_doc' when count(*) over (partition by chunk_id) > 1 then 'duplicate' else 'ok' end as error from chunks""",
        "chunk_page": "select distinct doc_id, chunk_index, chunk_id from chunks order by doc_id nulls first, chunk_index nulls first, chunk_id nulls first limit 100 offset 100",
        "chunk_point": "select distinct chunk_id, doc_id, chunk_type, text from chunks where chunk_id = 'Q4100_chunk_0001'",
        "chunk_size_buckets": f"select chunk_type, count(*) as n, count(*) filter (where tokens < 10) as tiny, count(*) filter (where tokens < 50) as small, count(*) filter (where tokens > 1000) as large, count(*) filter (where tokens > 2000) as huge, count(*) filter (where n_words < 10) as few_words from {_SIZED} group by all",
        "token_percentiles": f"select chunk_type, p, list_sort(v)[cast(floor((len(v) - 1) * p) as bigint) + 1] as value from (select chunk_type, list(tokens) as v from {_SIZED} group by all), (select unnest([0.25::double, 0.5::double, 0.75::double, 0.9::double, 0.95::double, 0.99::double]) as p)",
        "chunks_per_doc": f"select n_chunks, count(*) as n_docs from (select doc_id, count(distinct chunk_id) as n_chunks from {_SIZED} group by all) group by all",
        "section_topk": f"select lower({S.collapse('section')}) as section, count(*) as n from {_SIZED} group by 1 order by n desc, section nulls first limit 15",
        "coverage_anti": f"with d as (select distinct {S.key('doc_id')} as k from corpus_docs), c as (select distinct {S.key('doc_id')} as k from chunks) select 'document_without_chunk' as problem, k as doc_id from d where k is not null and k not in (select k from c where k is not null) union all select 'chunk_without_document', k from c where k is not null and k not in (select k from d where k is not null)",
        "integrity_tokens": f"select doc_id, n as n_original, n as n_chunks, 0 as n_differing from ({body_tokens}) where n > 0",
        "integrity_lines": f"""with a as (select {S.key('doc_id')} as doc_id, unnest({S.clean_lines('text')}) as x from {_LIVE}), b as (select {S.key('doc_id')} as doc_id, unnest({S.clean_lines('text')}) as x from (select distinct chunk_id, doc_id, text from chunks)),
            ca as (select doc_id, x, count(*) as n from a where not {heading} group by all), cb as (select doc_id, x, count(*) as m from b group by all)
            select doc_id, sum(n) as n_lines, sum(greatest(n - coalesce(m, 0), 0)) as n_lost from ca left join cb using (doc_id, x) where doc_id is not null group by all""",
        "integrity_chars": f"select doc_id, n as n_original, n as n_chunks, 1.0 as ratio from (select doc_id::varchar as doc_id, sum(len({S.strip('x')})) - sum(len({S.strip('x')}) - len(regexp_replace({S.strip('x')}, '[{S.BLANKS}]+', '', 'g'))) as n from (select doc_id, unnest({S.clean_lines('text')}) as x from documents) where not {heading} group by all) where n > 0",
        "loss_classes": f"""with a as (select {S.key('doc_id')} as doc_id, unnest({S.clean_lines('text')}) as x from {_LIVE}), b as (select distinct {S.key('doc_id')} as doc_id, unnest({S.clean_lines('text')}) as x from chunks)
            select case when {heading} then 'heading' when starts_with(x, '[Infobox') or {S.table_row('x')} then 'structural' else 'content' end as class, count(*) as n_lines, sum(len(x))::bigint as n_chars from a where doc_id is not null and not exists (select 1 from b where b.doc_id = a.doc_id and b.x = a.x) group by all""",
        "results_class": f"select doc_id, case when p = 0 then 'none' when len(l) = p then 'empty' when len(list_filter(l[p + 1 :], lambda x: {S.table_row('x')})) > 0 then 'rows' else 'prose' end as results from (select doc_id, l, coalesce(list_position(list_transform(l, lambda x: lower(x)), 'results'), 0) as p from (select doc_id, {S.clean_lines('text')} as l from documents where text is not null))",
        "first_diff": "with v as (select doc_id, count(*) as n, arg_min(text, (loaded_at, text)) as a, arg_max(text, (loaded_at, text)) as b from corpus_docs where doc_id is not null and text is not null group by all having count(*) > 1), s as (select *, string_split(a, chr(10)) as la, string_split(b, chr(10)) as lb from v) select doc_id, n as n_versions, coalesce(list_filter(range(1, greatest(len(la), len(lb)) + 1), lambda k: la[k] is distinct from lb[k])[1], 0) as first_line, len(b) - len(a) as longer_by from s",
        "upsert_latest": "select doc_id, title, loaded_at, deleted_at, sha256(text) as hash from (select distinct on (doc_id) * from corpus_docs where doc_id is not null order by doc_id, loaded_at desc, title desc, text desc)",
        "hash_incremental": """with c as (select distinct on (chunk_id) chunk_id, text, ingested_at from chunks where chunk_id is not null order by chunk_id, ingested_at desc nulls last, sha256(text) desc nulls last), p as (select distinct on (chunk_id) chunk_id, text from chunks where chunk_id is not null and ingested_at < timestamp '2025-07-01' order by chunk_id, ingested_at desc nulls last, sha256(text) desc nulls last)
            select case when p.chunk_id is null then 'new' when p.text is distinct from c.text then 'changed' else 'same' end as change, count(*) as n from c left join p using (chunk_id) group by all""",
        "events_latest": "select user_id, ts, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where user_id is not null) where n = 1",
    }
