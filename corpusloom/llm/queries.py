"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import answers, encoding, language, mixing, names, near_duplicates, splitting
from corpusloom.operators.components import connected_components
from corpusloom.session import spread, stage, table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_limits"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).select("chunk_id").distinct()


def p1_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split text: its pieces, its words, and how many pieces are over the limit, leave words out or share fewer words than they should with the piece before."""
    pieces = p1_pieces(spark, sf_dir)
    kind = F.lower(F.trim("chunk_type"))
    limits = table(spark, sf_dir, "split_limits").select(F.lower(F.trim("chunk_type")).alias("kind"), F.col("overlap_tokens").alias("overlap"))
    rows = pieces.join(F.broadcast(limits), kind == F.col("kind"), "left").withColumn("n_words", F.regexp_count("piece", F.lit(r"(?U)[^\s\x1c-\x1f]+")))
    window = "over (partition by chunk_id, n_pieces, max_tokens order by piece_index)"
    rows = rows.selectExpr("*", f"lag(end_word) {window} as before")
    over = F.count_if((F.floor(F.col("n_words") * 13 / 10) > F.col("max_tokens")) | (F.col("n_words") != F.col("end_word") - F.col("start_word")))
    gaps = F.count_if(F.col("start_word") > F.coalesce("before", F.lit(0)))
    short = F.count_if(F.col("before").isNotNull() & (F.floor((F.col("before") - F.col("start_word")) * 13 / 10) < F.col("overlap")))
    return rows.groupBy("chunk_id").agg(F.max("end_word").alias("n_words"), over.alias("over"), gaps.alias("gaps"), short.alias("short_overlaps"))


def p2_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect that an answer shows."""
    profiles = language.learn(table(spark, sf_dir, "documents"), language.label_names(table(spark, sf_dir, "languages")))
    return answers.find_defects(table(spark, sf_dir, "predictions"), profiles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.first_defect(p2_defects(spark, sf_dir))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every id of an athlete or venue."""
    return names.resolve(table(spark, sf_dir, "entities"), {"athlete": "p", "venue": "v"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.id_pairs(p3_entities(spark, sf_dir))


def _near_chunks(spark: SparkSession, sf_dir: str):
    return near_duplicates.near_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "text", least=0.6, shingle=3, least_words=40)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs_of_keys(*_near_chunks(spark, sf_dir)).withColumnsRenamed({"key_a": "chunk_id_a", "key_b": "chunk_id_b"})


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk that has near copies or exact ones, with its class, its group and the links of its class."""
    pairs, members = _near_chunks(spark, sf_dir)
    pairs = stage(pairs, "pairs")
    groups = connected_components(pairs).withColumnsRenamed({"node": "class", "component": "group"})
    links = pairs.selectExpr("explode(array(a, b)) as class").groupBy("class").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    known = sizes.join(groups, "class", "left").join(links, "class", "left").where("copies > 1 or links > 0")
    known = known.select("class", "copies", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return members.withColumnRenamed("key", "chunk_id").join(known, "class")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_ids(_texts(spark, sf_dir))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as decoded from its ids."""
    return encoding.decode_ids(p6_ids(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str):
    docs = _texts(spark, sf_dir)
    return mixing.mixture(encoding.count_tokens(docs, ["source", "doc_id"]), table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1].withColumn("reached_share", F.round("reached_share", 6))


def _full_mixture(spark: SparkSession, sf_dir: str):
    docs = _texts(spark, sf_dir)
    counts = stage(encoding.count_tokens(docs, ["source", "doc_id"]), "counts")
    total = counts.agg(F.sum("n_tokens")).first()[0]
    return mixing.mixture(counts, table(spark, sf_dir, "mix_targets"), total=float(total or 0))


def p7_full_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the corpus has: small sources are used as often as they may be, the others give what those lack."""
    return _full_mixture(spark, sf_dir)[0]


def p7_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_mixture(spark, sf_dir)[1].withColumn("reached_share", F.round("reached_share", 6))


_P1_FOUND = r"""
select distinct c.chunk_id from chunks c join split_limits l on lower(trim(c.chunk_type)) = l.chunk_type
where floor(len(regexp_extract_all(c.text, '[^\s\v\x1c-\x1f\x{85}\p{Z}]+')) * 13 / 10) > l.max_tokens
"""

_P1_COVERED = r"""
select chunk_id, max(n) as n_words, 0 as "over", 0 as gaps, 0 as short_overlaps from (select c.chunk_id, len(regexp_extract_all(c.text, '[^\s\v\x1c-\x1f\x{85}\p{Z}]+')) as n, l.max_tokens as most
  from chunks c join split_limits l on lower(trim(c.chunk_type)) = l.chunk_type) where floor(n * 13 / 10) > most group by chunk_id
"""

_P5_FOUND = r"""
with w as (
  select distinct chunk_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from chunks where text is not null
), g as (
  select chunk_id, list_distinct([array_to_string(w[k : k + 2], ' ') for k in range(1, len(w) - 1)]) as g from w where len(w) >= 40
), n as (
  select chunk_id, len(g) as n, unnest(g) as gram from g
)
select a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b from n a join n b on a.gram = b.gram and a.chunk_id < b.chunk_id
group by a.chunk_id, b.chunk_id, a.n, b.n having count(*) >= 0.6 * (a.n + b.n - count(*))
"""


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of every document, with its words and a confidence."""
    docs = _texts(spark, sf_dir)
    profiles = language.learn(docs, language.label_names(table(spark, sf_dir, "languages")))
    judged = language.languages_of(docs, profiles, ["doc_id", "lang"])
    return judged.withColumn("confidence", F.round("confidence", 4))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_cases(p8_languages(spark, sf_dir), language.label_names(table(spark, sf_dir, "languages")))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_covered, p2_found, p2_defects, p3_found, p3_entities, p5_found, p5_groups, p6_ids, p6_roundtrip, p7_mixture, p7_shares, p7_full_mixture, p7_full_shares, p8_found, p8_languages)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_FOUND,
        "p1_covered": _P1_COVERED,
        "p5_found": _P5_FOUND,
        "p6_roundtrip": "select doc_id, coalesce(text, '') as text from documents",
    }
