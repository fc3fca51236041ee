"""Queries of passage retrieval. Questions asked: those whose number is divisible by 20, against all passages; by ``hybrid`` all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieval as R
from corpusloom.operators.ranking import Rankings, word_hashes
from corpusloom.plans import sql as S
from corpusloom.session import exists, new_folder, stage, table


#: How many the reference takes of each ranking and after the fusion; the queries named _deep do so.
DEPTH = 300


#: What is written once for a data folder and kept for the session: its passages, their terms, their rankings for the questions.
_KEPT: dict[tuple[str, str, str], str] = {}


def _kept(spark, d, name, write) -> str:
    named = (spark.sparkContext.applicationId, d, name)
    if named not in _KEPT or not exists(spark, _KEPT[named]):
        path = new_folder(spark, name)
        write(path)
        _KEPT[named] = path
    return _KEPT[named]


def _passages(spark, d):
    rows = R.passages(table(spark, d, "chunks"))
    path = _kept(spark, d, "passages", lambda p: rows.write.option("compression", "zstd").parquet(p))
    return spark.read.schema(rows.schema).parquet(path)


def _rankings(spark, d) -> Rankings:
    questions = _questions(spark, d)
    return Rankings(_kept(spark, d, "rankings", lambda p: Rankings.build(_passages(spark, d), questions, p)), questions)


def _all_questions(spark, d):
    return table(spark, d, "questions").groupBy("qid").agg(F.min("question").alias("question")).where("qid is not null and question is not null")


def _questions(spark, d):
    return _all_questions(spark, d).where(F.try_to_number(F.regexp_extract("qid", r"(\d+)$", 1), F.lit("9999999999")) % 20 == 0)


def tfidf_index(spark: SparkSession, d: str) -> DataFrame:
    """The 50 terms in most passages."""
    passages = _passages(spark, d)
    index = R.Index(spark, _kept(spark, d, "index", lambda p: R.Index.build(passages, p)))
    return index.frequent(passages, 50).withColumn("idf", F.round("idf", 6))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rankings(spark, d).search(5)


def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rankings(spark, d).overlap(5)


def _fused(spark, d, depth, limit):
    rankings = _rankings(spark, d)
    return R.fuse_ranks([rankings.search(depth), rankings.overlap(depth)], limit=limit)


def rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, 50, 20)


def _one_a_document(spark, d, depth, limit):
    return R.cap_per_document(_fused(spark, d, depth, limit).join(_passages(spark, d).select("chunk_id", "doc_id"), "chunk_id"), 1)


def dedup_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return _one_a_document(spark, d, 50, 60).select("qid", "rank", "chunk_id", "doc_id")


def _context(spark, d, depth, limit):
    sizes = _passages(spark, d).select("chunk_id", T.approx_tokens("text").alias("tokens"))
    return R.within_budget(_one_a_document(spark, d, depth, limit).join(sizes, "chunk_id"), budget=1000, most=20)


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, 50, 60)


def _evidence(spark, d, depth, limit):
    taken = _context(spark, d, depth, limit)
    found = R.evidence(taken.join(_passages(spark, d), "chunk_id"))
    return found.select("qid", F.length("evidence").alias("n_chars"), F.sha2("evidence", 256).alias("hash"))


def evidence_format(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d, 50, 60)


def rerank(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of the fusion in the order of a stand-in for a scoring model: the part of the question's words that they have."""
    return _reranked(spark, d, 50, 20)


def _asked_words(spark, d):
    """qid and the question's different words, each between blanks; worked out once a question."""
    words = F.array_distinct(F.filter(F.split(T.keyword_text("question"), " "), lambda w: F.length(w) > 1))
    return _questions(spark, d).select("qid", T.once(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))).alias("words"))


def word_share(words: str, plain: str):
    """The stand-in for a scoring model: the part of the question's different words (each between blanks) that a text has, of which ``plain`` is the keyword text between blanks."""
    found = F.size(F.filter(words, lambda w: F.contains(F.col(plain), w)))
    return F.round(F.try_divide(found, F.size(words)), 6)


def _scored(spark, d, pairs):
    """Pairs (qid, chunk_id, prior) in the order of their word shares; a text that many questions have found is made plain once.

    Pairs are many times larger in memory than in the files that the planner goes by, so nothing is broadcast.
    """
    pairs = stage(pairs, "pairs")
    plain = F.concat(F.lit(" "), T.keyword_text("text"), F.lit(" "))
    texts = _passages(spark, d).select("chunk_id", "text").join(pairs.select("chunk_id").distinct().hint("merge"), "chunk_id", "left_semi").select("chunk_id", T.once(plain).alias("plain"))
    return R.reranked(pairs.join(_asked_words(spark, d).hint("merge"), "qid").join(texts.hint("merge"), "chunk_id"), word_share("words", "plain"))


def _reranked(spark, d, depth, limit):
    return _scored(spark, d, _fused(spark, d, depth, limit).select("qid", "chunk_id", F.col("rank").alias("prior")))


def dedup_per_doc_deep(spark: SparkSession, d: str) -> DataFrame:
    return _one_a_document(spark, d, DEPTH, DEPTH).select("qid", "rank", "chunk_id", "doc_id")


def context_budget_deep(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, DEPTH, DEPTH)


def evidence_format_deep(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d, DEPTH, DEPTH)


def rrf_deep(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, DEPTH, DEPTH)


def rerank_deep(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, DEPTH, DEPTH)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.vector_search(rows, rows.where("vec_id % 20 = 0"), 10).withColumn("distance", F.round("distance", 6))


def vector_topk_index(spark: SparkSession, d: str) -> DataFrame:
    """As vector_topk, by an index of cells: approximate, at least 0.9 of the exact neighbours."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.VectorIndex(rows).search(rows.where("vec_id % 20 = 0"), 10).withColumn("distance", F.round("distance", 6))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The whole way, for all questions: 300 passages by terms and 300 by vectors, fused to 300, the best of each document, scored, 20 kept. Vectors and scores are stand-ins for models'.

    Questions of the same text are asked once, under the smallest qid of theirs.
    """
    questions = stage(_all_questions(spark, d).withColumn("asked", F.min("qid").over(Window.partitionBy("question"))), "questions")
    asked = R.letter_vectors(questions.where("qid = asked"), "qid", "question", "question").withColumnRenamed("vec_id", "qid")
    texts = R.letter_vectors(_passages(spark, d).withColumn("doc", F.xxhash64("doc_id")), "chunk_id", "text", "text", "doc").withColumnRenamed("vec_id", "chunk_id")
    rankings = Rankings(_kept(spark, d, "rankings_all", lambda p: Rankings.build(texts, asked, p, more=("doc", "embedding"))), asked)
    best = rankings.best_of_both(DEPTH, 20)
    pairs = stage(best.withColumnRenamed("qid", "asked"), "pairs")
    words = questions.select("qid", "asked", T.once(F.array_distinct(F.filter(F.split(T.keyword_text("question"), " "), lambda w: F.length(w) > 1))).alias("words"))
    passages = _passages(spark, d).select("chunk_id", "text").where(_may_be_in("chunk_id", pairs))
    found = passages.join(pairs.select("chunk_id").distinct().hint("merge"), "chunk_id", "left_semi").select("chunk_id", T.once(F.array_distinct(word_hashes("text"))).alias("has"))
    shared = F.size(F.array_intersect(F.transform("words", lambda w: F.xxhash64(w)), "has"))
    rows = pairs.join(words.hint("merge"), "asked").join(found.hint("merge"), "chunk_id")
    share = F.when(F.size("words") > 0, F.round(shared / F.size("words"), 6)).otherwise(F.lit(float("nan")))  # no words: 0 / 0, as in SQL
    return R.reranked(rows, share).where("rank <= 20")


def _may_be_in(key, rows, buckets=1 << 16):
    """False only for keys that ``rows`` have not, by buckets of hashes: a filter before a shuffle, of a byte for each bucket."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    has = bytearray(buckets)
    for r in rows.select(bucket.alias("b")).distinct().collect():
        has[r.b] = 1
    return F.substring(F.lit(bytes(has)), bucket + 1, F.lit(1)) == F.lit(b"\x01")


def embed_validate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by length and by whether their norm is 1."""
    rows = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.groupBy(F.size("embedding").alias("dimension"), (F.abs(norm - 1) < 1e-3).alias("unit")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


def queries() -> dict:
    names = "tfidf_index tfidf_topk overlap_topk rrf dedup_per_doc context_budget evidence_format rerank rrf_deep dedup_per_doc_deep context_budget_deep evidence_format_deep rerank_deep vector_topk vector_topk_index hybrid embed_validate"
    return {n: globals()[n] for n in names.split()}


_EVERY_20TH = " having cast(regexp_extract(qid, '(\\d+)$', 1) as bigint) % 20 = 0"
_P = f"""p as (select * from (select distinct on (chunk_id) * from chunks where chunk_id is not null order by chunk_id, ingested_at desc nulls last, doc_id desc nulls last, title desc nulls last, section desc nulls last, chunk_type desc nulls last, text desc nulls last) where {S.strip('text')} <> ''),
q as (select qid, min(question) as question from questions group by qid{_EVERY_20TH})"""
_W = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) > 1)"
_T = """(select {k}, term, count(*) as tf from (select {k}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) as term from (select {k}, """ + _W + """ as w from {t})) group by all)"""
_IDF = "c as " + _T.format(k="chunk_id", c="text", t="p") + ", i as (select term, count(*) as df, ln((1.0::double + (select count(*) from p)) / (1.0::double + count(*))) + 1 as idf from c group by term)"
_TFIDF = f"""with {_P}, {_IDF}, w as (select chunk_id, term, tf * idf as w from c join i using (term)), n as (select chunk_id, sqrt(sum(w * w)) as n from w group by all),
a as (select qid, term, tf * idf as wq from {_T.format(k='qid', c='question', t='q')} join i using (term)), m as (select qid, sqrt(sum(wq * wq)) as m from a group by all),
s as (select qid, chunk_id, round(sum(w * wq) / any_value(n) / any_value(m), 8) as score from w join a using (term) join n using (chunk_id) join m using (qid) group by all),
t as (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from s)"""
_B = "list_distinct(" + _W + ")"
_OVER = f"""b as (select chunk_id, {_B.format(c='text')} as b from p), qb as (select qid, {_B.format(c='question')} as b from q),
bo as (select qid, chunk_id, round(m / sqrt(n), 8) as score from (select qid, chunk_id, count(*) as m, any_value(n) as n from (select chunk_id, len(b) as n, unnest(b) as term from b) join (select qid, unnest(b) as term from qb) using (term) group by all)),
o as (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from bo)"""
_RRF = f"""{_TFIDF}, {_OVER}, u as (select qid, chunk_id, round(sum(1.0::double / (60 + rank)), 8) as score from (select qid, chunk_id, rank from t where rank <= 50 union all select qid, chunk_id, rank from o where rank <= 50) group by all),
f as (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from u)"""
_HYBRID = f"""{_RRF}, k as (select f.qid, f.chunk_id, f.rank, p.doc_id, p.title, p.section, p.text from f join p using (chunk_id) where f.rank <= 60 qualify row_number() over (partition by f.qid, p.doc_id order by f.rank) = 1),
r as (select *, row_number() over (partition by qid order by rank) as pos from k)"""
_CONTEXT = _HYBRID.replace("with p as", "with recursive p as", 1) + f""", z as (select *, {S.tokens('text')} as tokens from r),
x as (select qid, pos, chunk_id, tokens, 1 as n, tokens::bigint as used, true as taken from z where pos = 1
  union all select z.qid, z.pos, z.chunk_id, z.tokens, x.n + (x.n < 20 and x.used + z.tokens <= 1000)::int, case when x.n < 20 and x.used + z.tokens <= 1000 then x.used + z.tokens else x.used end, x.n < 20 and x.used + z.tokens <= 1000 from x join z on z.qid = x.qid and z.pos = x.pos + 1)"""


_LETTERS = "list_transform(range(97, 123), lambda k: (len({c}) - len(replace(lower({c}), chr(k::int), '')))::double)"
_BY_VECTOR = f"""pv as (select chunk_id, {_LETTERS.format(c='text')} as e from p), qv as (select qid, {_LETTERS.format(c='question')} as e from q),
vs as (select qid, chunk_id, round(1 - list_cosine_similarity(qv.e, pv.e), 8) as distance from qv, pv where list_sum(pv.e) > 0 and list_sum(qv.e) > 0), vr as (select *, row_number() over (partition by qid order by distance, chunk_id) as rank from vs)"""


def _at_depth(sql: str) -> str:
    for shallow in ("where rank <= 50", "where f.rank <= 60", "where f.rank <= 20", "from f where rank <= 20"):
        sql = sql.replace(shallow, shallow.rsplit(" ", 1)[0] + f" {DEPTH}")
    return sql


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    return found | {f"{name}_deep": _at_depth(found[name]) for name in ("rrf", "dedup_per_doc", "context_budget", "evidence_format", "rerank")}


def _oracle_sql() -> dict[str, str]:
    return {
        "tfidf_index": f"with {_P}, {_IDF} select term, df, round(idf, 6) as idf from i order by df desc, term limit 50",
        "tfidf_topk": f"{_TFIDF} select qid, chunk_id, score, rank from t where rank <= 5",
        "overlap_topk": f"with {_P}, {_OVER} select qid, chunk_id, score, rank from o where rank <= 5",
        "rrf": f"{_RRF} select qid, chunk_id, score, rank from f where rank <= 20",
        "dedup_per_doc": f"{_HYBRID} select qid, pos as rank, chunk_id, doc_id from r",
        "context_budget": f"{_CONTEXT} select qid, row_number() over (partition by qid order by pos) as source_no, chunk_id, tokens from x where taken",
        "evidence_format": f"""{_CONTEXT}, e as (select qid, row_number() over (partition by x.qid order by x.pos) as source_no, chunk_id, doc_id, title, section, text from x join r using (qid, chunk_id) where taken),
            l as (select qid, array_to_string(list('[Source ' || source_no || ' | chunk_id=' || chunk_id || ' | document_id=' || doc_id || ' | title=' || coalesce(title, '') || ' | section=' || coalesce(section, '') || ']' || chr(10) || text order by source_no), chr(10) || chr(10)) as e from e group by all) select qid, len(e) as n_chars, sha256(e) as hash from l""",
        "rerank": f"{_RRF}, v as (select f.qid, f.chunk_id, f.rank as prior, round(len(list_intersect(b.b, qb.b)) / len(qb.b), 6) as score from f join b using (chunk_id) join qb using (qid) where f.rank <= 20) select *, row_number() over (partition by qid order by score desc, prior) as rank from v",
        "vector_topk": "with v as (select vec_id, embedding::double[] as e from embeddings), s as (select q.vec_id as query_id, v.vec_id, round(1 - list_cosine_similarity(q.e, v.e), 8) as distance from v join v q on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id), r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from s) select query_id, vec_id, round(distance, 6) as distance, rank from r where rank <= 10",
        "hybrid": f"""{_TFIDF.replace(_EVERY_20TH, '')}, {_BY_VECTOR}, u as (select qid, chunk_id, round(sum(1.0::double / (60 + rank)), 8) as score from (select qid, chunk_id, rank from t where rank <= 300 union all select qid, chunk_id, rank from vr where rank <= 300) group by all),
            f as (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from u), k as (select f.qid, f.chunk_id, f.rank, p.text from f join p using (chunk_id) where f.rank <= 300 qualify row_number() over (partition by f.qid, p.doc_id order by f.rank) = 1),
            r as (select *, row_number() over (partition by qid order by rank) as prior from k), b as (select chunk_id, {_B.format(c='text')} as b from p), qb as (select qid, {_B.format(c='question')} as b from q),
            v as (select r.qid, r.chunk_id, r.prior, round(len(list_intersect(b.b, qb.b)) / len(qb.b), 6) as score from r join b using (chunk_id) join qb using (qid))
            select * from (select *, row_number() over (partition by qid order by score desc, prior) as rank from v) where rank <= 20""",
        "embed_validate": "select len(embedding) as dimension, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) < 1e-3 as unit, count(*) as n, count(distinct label) as n_labels from embeddings group by all",
    }
