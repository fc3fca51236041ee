"""Queries of question answering and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answering as A
from corpusloom.operators import documents
from corpusloom.plans import sql as S
from corpusloom.session import table


def _q(spark, d):
    return A.questions_once(table(spark, d, "questions"))


def _asked(spark, d):
    """The questions of searches: those whose number is divisible by 20."""
    return _q(spark, d).where(F.nullif(F.regexp_extract("qid", r"(\d+)$", 1), F.lit("")).try_cast("bigint") % 20 == 0)


def _docs(spark, d):
    return documents.live_documents(table(spark, d, "corpus_docs"))


def _p(spark, d):
    rows = table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "doc_id", "title", "chunk_index", "text", "ingested_at")
    return documents.latest(rows, ["chunk_id"], ["ingested_at"]).where(T.strip("text") != "").drop("ingested_at")


def router(spark: SparkSession, d: str) -> DataFrame:
    return A.route(_q(spark, d))


def candidate_docs(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(_asked(spark, d), _docs(spark, d))


def candidate_docs_v2(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates_by_text(_asked(spark, d), _docs(spark, d))


def candidate_docs_passages(spark: SparkSession, d: str) -> DataFrame:
    """As candidate_docs_v2, over the first two passages of each document instead of its whole text."""
    return A.candidates_by_text(_asked(spark, d), A.first_texts(_docs(spark, d), _p(spark, d)))


def candidate_docs_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their passages for the asked questions that candidate_docs finds none for."""
    questions = _asked(spark, d)
    return A.candidates_by_passages(questions.join(candidate_docs(spark, d).select("qid"), "qid", "left_anti"), _p(spark, d))


def competitor_extract(spark: SparkSession, d: str) -> DataFrame:
    return A.competitors(_p(spark, d))


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.summaries(_p(spark, d))


def agg_threshold(spark: SparkSession, d: str) -> DataFrame:
    questions = _q(spark, d)
    return A.above_threshold(questions, A.candidates(questions.where(A.threshold(F.col("question")).isNotNull()), _docs(spark, d)), A.competitors(_docs(spark, d)))


def superlative(spark: SparkSession, d: str) -> DataFrame:
    questions = _q(spark, d)
    return A.largest(questions, A.candidates(questions.where("qtype = 'superlative'"), _docs(spark, d)), A.competitors(_docs(spark, d)))


def superlative_routed(spark: SparkSession, d: str) -> DataFrame:
    """As superlative, for all questions that the router takes for one, whether their type says so or their wording."""
    questions = _q(spark, d)
    asked = questions.join(A.route(questions).where("intent = 'SUPERLATIVE'").select("qid"), "qid", "left_semi")
    return A.largest(questions, A.candidates(asked, _docs(spark, d)), A.competitors(_docs(spark, d)))


def gold_semijoin(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents that some question names, by qid or else doc_id."""
    gold = table(spark, d, "questions").select(F.explode("gold_doc_ids").alias("k")).distinct()
    rows = table(spark, d, "chunks").where(T.strip("text") != "").select("chunk_id", "doc_id", F.coalesce(F.nullif(F.trim("wikidata_qid"), F.lit("")), F.trim("doc_id")).alias("k"))
    return rows.join(gold, "k", "left_semi").select("chunk_id", "doc_id").distinct()


def gold_context(spark: SparkSession, d: str) -> DataFrame:
    rows = A.gold_context(_q(spark, d), _p(spark, d))
    return rows.select("qid", "n_passages", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("hash"))


def prompt_format(spark: SparkSession, d: str) -> DataFrame:
    rows = _q(spark, d).join(A.gold_context(_q(spark, d), _p(spark, d), 12, 12000), "qid")
    prompt = F.concat(F.lit("Question:\n"), "question", F.lit("\n\nEvidence:\n"), "context", F.lit("\n\nAnswer:"))
    return rows.select("qid", F.length(prompt).alias("n_chars"), F.sha2(prompt, 256).alias("hash"))


def doc_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _p(spark, d)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(T.approx_tokens("text")).alias("tokens"), F.min_by("title", F.struct("chunk_index", "chunk_id")).alias("title"), F.max("chunk_index").alias("last_index"))


def answer_match(spark: SparkSession, d: str) -> DataFrame:
    return A.judged(table(spark, d, "predictions"), _q(spark, d), 1)


def answer_match_v2(spark: SparkSession, d: str) -> DataFrame:
    return A.judged(table(spark, d, "predictions"), _q(spark, d), 2)


def answer_match_v3(spark: SparkSession, d: str) -> DataFrame:
    return A.judged(table(spark, d, "predictions"), _q(spark, d), 3)


def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    return A.accuracy(answer_match(spark, d))


def temporal_prev(spark: SparkSession, d: str) -> DataFrame:
    return A.previous_editions(table(spark, d, "entities"))


def temporal_next(spark: SparkSession, d: str) -> DataFrame:
    return A.next_editions(table(spark, d, "entities"))


def joined_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = A.joined_summaries(candidate_docs(spark, d), event_summary(spark, d))
    return rows.select("qid", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("hash"))


def fuse(spark: SparkSession, d: str) -> DataFrame:
    """The context of every asked question, by what is asked for."""
    asked = _asked(spark, d)
    rows = A.fuse(asked, A.joined_summaries(candidate_docs(spark, d), event_summary(spark, d)), A.gold_context(asked, _p(spark, d)))
    return rows.select("qid", "intent", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("hash"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer to every question that counts and maxima give, with what is said for the others."""
    return A.answered(_q(spark, d), agg_threshold(spark, d), superlative_routed(spark, d), _docs(spark, d))


def model_usage(spark: SparkSession, d: str) -> DataFrame:
    """Answers, tokens, cost and latency of every model; an answer logged again counts once."""
    rows = documents.latest(table(spark, d, "predictions"), ["pred_id"], ["logged_at"])
    return rows.groupBy("model_used").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("total_cost_usd"), 6).alias("cost"), F.median("latency_sec").alias("median_latency"), F.max("latency_sec").alias("max_latency"))


def queries() -> dict:
    names = "router candidate_docs candidate_docs_v2 candidate_docs_passages candidate_docs_fallback competitor_extract event_summary agg_threshold superlative superlative_routed gold_semijoin gold_context prompt_format doc_rollup answer_match answer_match_v2 answer_match_v3 eval_by_type temporal_prev temporal_next joined_summaries fuse answers model_usage"
    return {n: globals()[n] for n in names.split()}


def _has(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


_Q = "q as (select qid, question, lower(trim(qtype)) as qtype, answer, gold_doc_ids from (select distinct on (qid) * from questions where qid is not null order by qid, created_at, question, qtype))"
_A = "a as (select * from q where cast(regexp_extract(qid, '(\\d+)$', 1) as bigint) % 20 = 0)"
_D = "d as (select * from (select distinct on (doc_id) * from corpus_docs where doc_id is not null order by doc_id, loaded_at desc, title desc, text desc, url desc nulls last, wikidata_qid desc nulls last) where deleted_at is null)"
_P = f"p as (select * from (select distinct on (chunk_id) * from chunks where chunk_id is not null order by chunk_id, ingested_at desc nulls last, doc_id desc nulls last, title desc nulls last, chunk_index desc nulls last, text desc nulls last) where {S.strip('text')} <> '')"
_SPLIT = "string_split_regex({c}, '[^\\p{{L}}\\p{{N}}_]+')"
_YEARS = "list_filter(" + _SPLIT + ", lambda w: regexp_matches(w, '^(19|20)[0-9][0-9]$'))"
_INTENT = f"case when {_has('lower(question)', A.LOOKUP_PHRASES)} then 'LOOKUP' when {_has('lower(question)', A.COUNT_PHRASES)} then 'AGGREGATION' when {_has('lower(question)', A.MOST_WORDS)} then 'SUPERLATIVE' when {_has('lower(question)', A.TIME_WORDS)} then 'TEMPORAL' when {_has('lower(question)', A.HOP_WORDS)} then 'MULTI_HOP' else 'LOOKUP' end"
_THRESHOLD = f"coalesce(try_cast(nullif(regexp_extract(lower(question), '{A.THRESHOLD}', 1), '') as int), try_cast(nullif(regexp_extract(lower(question), '{A.THRESHOLD}', 2), '') as int))"


def _scored(asked: str, score: str) -> str:
    return f"""t as (select qid, list_filter({_SPLIT.format(c='lower(question)')}, lambda w: len(w) > 2 and w not in ({S.quoted(A.STOPWORDS)})) as terms, {_YEARS.format(c='question')} as ys,
      contains(lower(question), 'women') or contains(lower(question), 'female') as women, contains(lower(question), 'men') or (contains(lower(question), 'male') and not (contains(lower(question), 'women') or contains(lower(question), 'female'))) as men from {asked} where question is not null),
    s as (select qid, doc_id, {score} as score from t join (select doc_id, lower(title) as title, lower(text) as text from d where title <> '') on len(ys) = 0 or len(list_filter(ys, lambda y: contains(title, y))) > 0),
    c as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s where score > 0 qualify rank <= 15)"""


_SCORE = """len(list_filter(terms, lambda w: contains(title, w))) * 2
  + case when women and (contains(title, 'women') or contains(title, 'female')) then 5 when women and contains(title, 'men') and not contains(title, 'women') then -5 else 0 end
  + case when men and contains(title, 'men') and not contains(title, 'women') then 5 when men and contains(title, 'women') then -5 else 0 end"""
_SCORE_2 = "len(list_filter(terms, lambda w: contains(title, w))) * 3 + len(list_filter(terms, lambda w: contains(text, w)))"


def _counts(t: str) -> str:
    return f"n as (select doc_id, max(v) as competitors from (select doc_id, unnest(list_concat(regexp_extract_all(text, '{A.COUNT_AFTER}', 1), regexp_extract_all(text, '{A.COUNT_BEFORE}', 1)))::int as v from {t}) where v between 1 and 500 group by all)"


def _context(most: int, chars: int) -> str:
    return f"""k as (select *, row_number() over (partition by doc_id order by chunk_index, chunk_id) as nn from p qualify nn <= {most}), g as (select qid, x as doc_id, min(i) as pos from (select qid, unnest(gold_doc_ids) as x, unnest(range(1, len(gold_doc_ids) + 1)) as i from q) group by all),
      m as (select qid, 'Doc [' || doc_id || '] - ' || coalesce(title, '') || ':' || chr(10) || text as x, row_number() over (partition by qid order by pos, nn) as kk from g join k using (doc_id) qualify kk <= {most}),
      x as (select qid, count(*) as n_passages, left(array_to_string(list(x order by kk), chr(10) || chr(10)), {chars}) as context from m group by all)"""


def _match(version: int) -> str:
    a = f"lower({S.collapse('predicted_answer')})"
    numbers = lambda c: f"list_filter({_SPLIT.format(c=c)}, lambda w: regexp_matches(w, '^[0-9]+$'))"
    words = lambda n: f"list_filter({_SPLIT.format(c='g')}, lambda w: len(w) >= {n})"
    every = lambda ws: f"len(list_filter({ws}, lambda w: not contains(a, w))) = 0"
    number = f"list_has_any({numbers('g')}, {numbers('a')})"
    title = f"list_filter({words(3 if version == 1 else 4)}, lambda w: w not in ({S.quoted(A.TITLE_STOPWORDS)}))"
    most = f"(qtype = 'superlative' and len({title}) > 0 and {every(title)})"
    right = {
        1: f"contains(a, g) or (len({words(3)}) >= 3 and {every(words(3))}) or (qtype in ('aggregation', 'lookup') and {number}) or {most}",
        2: f"contains(a, g) or {number} or (len({words(3)}) > 0 and {every(words(3))})",
        3: f"contains(a, g) or (qtype = 'aggregation' and {number}) or {most}",
    }[version]
    usable = f"coalesce({S.strip('predicted_answer')} <> '', false)" + (" and not starts_with(predicted_answer, 'Failed') and not starts_with(predicted_answer, 'Error')" if version == 1 else "")
    return f"""with {_Q}, r as (select distinct on (pred_id) pred_id, qid, predicted_answer from predictions where pred_id is not null order by pred_id, logged_at desc, predicted_answer desc),
      j as (select pred_id, r.qid, coalesce(qtype, '') as qtype, {a} as a, {usable} as usable, answer from r join q using (qid)), u as (select pred_id, qtype, a, lower({S.collapse('x')}) as g from (select *, unnest(answer) as x from j where usable)),
      h as (select pred_id, bool_or({right}) as h from u group by all)
      select j.pred_id, j.qid, q.qtype, coalesce(h, false) as right from j join q using (qid) left join h using (pred_id)"""


_PREV = r"'^(.+) at the ([0-9]{4}) .* Games [–-] (.+)$'"


_SUMMARIES = f"{_counts('p')}, f as (select distinct on (doc_id) doc_id, coalesce(title, '') as title, text from p order by doc_id, chunk_index, chunk_id), z as (select doc_id, 'Event: ' || title || case when competitors is not null then ' | Total Competitors: ' || competitors else ' | Details: ' || left({S.strip("replace(split_part(text, '.', 1), chr(10), ' ')")}, 150) end as summary from f left join n using (doc_id))"
_JOINED = f"with {_Q}, {_A}, {_D}, {_P}, {_scored('a', _SCORE)}, {_SUMMARIES}, js as (select qid, left(array_to_string(list(summary order by rank), chr(10)), 6000) as context from c join z using (doc_id) group by all)"
_ROUTED = f"case when qtype in ({S.quoted(A.TYPES)}) then upper(qtype) else {_INTENT} end"


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    found["answers"] = f"""with {_Q}, {_D}, x1 as ({found['agg_threshold']}), x2 as ({found['superlative_routed']}), y as (select qid, {_ROUTED} as intent from q)
      select y.qid, intent, coalesce(case when intent = 'AGGREGATION' then n_above::varchar when intent = 'SUPERLATIVE' then title end, 'Failed to generate answer') as answer from y left join x1 using (qid) left join (select x2.qid, d.title from x2 join d using (doc_id)) t using (qid)"""
    return found


def _oracle_sql() -> dict[str, str]:
    return {
        "temporal_next": f"with n as (select {S.collapse('name')} as n from entities where name is not null), y as (select distinct regexp_extract(n, {_PREV}, 1) || ' / ' || regexp_extract(n, {_PREV}, 3) as series, nullif(regexp_extract(n, {_PREV}, 2), '')::int as year from n) select series, year, lead(year) over (partition by series order by year) as following from y where year is not null",
        "joined_summaries": f"{_JOINED} select qid, len(context) as n_chars, sha256(context) as hash from js",
        "fuse": f"{_JOINED}, {_context(8, 8000).replace('from q)', 'from a)')}, y as (select qid, {_ROUTED} as intent from a), w as (select y.qid, intent, left(coalesce(case when intent in ('AGGREGATION', 'SUPERLATIVE') then js.context else x.context end, ''), 12000) as context from y left join js using (qid) left join x using (qid)) select qid, intent, len(context) as n_chars, sha256(context) as hash from w",
        "router": f"with {_Q} select qid, case when qtype in ({S.quoted(A.TYPES)}) then upper(qtype) else {_INTENT} end as intent, {_INTENT} as routed, {_YEARS.format(c='question')}[1]::int as year, {_THRESHOLD} as threshold from q",
        "candidate_docs": f"with {_Q}, {_A}, {_D}, {_scored('a', _SCORE)} select * from c",
        "candidate_docs_v2": f"with {_Q}, {_A}, {_D}, {_scored('a', _SCORE_2)} select * from c",
        "candidate_docs_passages": f"with {_Q}, {_A}, {_D}, {_P}, k2 as (select *, row_number() over (partition by doc_id order by chunk_index, chunk_id) as nn from p qualify nn <= 2), dd as (select d.doc_id, d.title, array_to_string(list(k2.text order by nn), chr(10)) as text from d join k2 using (doc_id) group by d.doc_id, d.title), {_scored('a', _SCORE_2).replace('from d where', 'from dd where')} select * from c",
        "candidate_docs_fallback": f"with {_Q}, {_A}, {_D}, {_P}, {_scored('a', _SCORE)}, g as (select qid, doc_id, sum(len(list_filter(terms, lambda w: contains(x, w))) + case when len(list_filter(ys, lambda y: contains(x, y))) > 0 then 3 else 0 end)::bigint as score from t, (select doc_id, lower(text) as x from p where doc_id is not null) where qid not in (select qid from c) group by all) select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) as rank from g where score > 0 qualify rank <= 15",
        "competitor_extract": f"with {_P}, {_counts('p')} select * from n",
        "event_summary": f"with {_P}, {_counts('p')}, f as (select distinct on (doc_id) doc_id, coalesce(title, '') as title, text from p order by doc_id, chunk_index, chunk_id) select doc_id, 'Event: ' || title || case when competitors is not null then ' | Total Competitors: ' || competitors else ' | Details: ' || left({S.strip("replace(split_part(text, '.', 1), chr(10), ' ')")}, 150) end as summary from f left join n using (doc_id)",
        "agg_threshold": f"with {_Q}, b as (select *, {_THRESHOLD} as threshold from q where {_THRESHOLD} is not null), {_D}, {_scored('b', _SCORE)}, {_counts('d')} select qid, threshold, count(*) filter (where competitors > threshold) as n_above, count(*) as n_known from b join c using (qid) join n using (doc_id) group by all",
        "superlative": f"with {_Q}, b as (select * from q where qtype = 'superlative'), {_D}, {_scored('b', _SCORE)}, {_counts('d')} select qid, doc_id, competitors from c join n using (doc_id) qualify row_number() over (partition by qid order by competitors desc, doc_id) = 1",
        "superlative_routed": f"with {_Q}, b as (select * from q where case when qtype in ({S.quoted(A.TYPES)}) then upper(qtype) else {_INTENT} end = 'SUPERLATIVE'), {_D}, {_scored('b', _SCORE)}, {_counts('d')} select qid, doc_id, competitors from c join n using (doc_id) qualify row_number() over (partition by qid order by competitors desc, doc_id) = 1",
        "gold_semijoin": f"select distinct chunk_id, doc_id from chunks where {S.strip('text')} <> '' and coalesce(nullif(trim(wikidata_qid), ''), trim(doc_id)) in (select unnest(gold_doc_ids) from questions)",
        "gold_context": f"with {_Q}, {_P}, {_context(8, 8000)} select qid, n_passages, len(context) as n_chars, sha256(context) as hash from x",
        "prompt_format": f"with {_Q}, {_P}, {_context(12, 12000)}, y as (select qid, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Evidence:' || chr(10) || context || chr(10) || chr(10) || 'Answer:' as y from q join x using (qid)) select qid, len(y) as n_chars, sha256(y) as hash from y",
        "doc_rollup": f"with {_P} select doc_id, count(*) as n_chunks, sum({S.tokens('text')})::bigint as tokens, arg_min_null(title, (chunk_index, chunk_id)) as title, max(chunk_index) as last_index from p group by all",
        "answer_match": _match(1),
        "answer_match_v2": _match(2),
        "answer_match_v3": _match(3),
        "eval_by_type": f"select qtype, grouping(qtype) = 1 as overall, count(*) as n, count(*) filter (where \"right\") as n_right, round(count(*) filter (where \"right\") * 100.0::double / count(*), 2) as percent from ({_match(1)}) group by rollup (qtype)",
        "temporal_prev": f"with n as (select {S.collapse('name')} as n from entities where name is not null), y as (select distinct regexp_extract(n, {_PREV}, 1) || ' / ' || regexp_extract(n, {_PREV}, 3) as series, nullif(regexp_extract(n, {_PREV}, 2), '')::int as year from n) select series, year, lag(year) over (partition by series order by year) as previous from y where year is not null",
        "model_usage": "select model_used, count(*) as n, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(total_cost_usd), 6) as cost, median(latency_sec) as median_latency, max(latency_sec) as max_latency from (select distinct on (pred_id) * from predictions where pred_id is not null order by pred_id, logged_at desc, qid desc, question desc) group by all",
    }
