"""Whether chunks are valid, cover their documents and keep their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.chunking import is_heading
from corpusloom.schemas import CHUNK_TYPES
from corpusloom.session import stage


def chunk_errors(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_id and the first error of each row: ``missing``, ``blank``, ``type``, ``range``, ``unknown_doc``, ``duplicate`` or ``ok``. Documents are looked up by cleaned key."""
    need = ["chunk_id", "doc_id", "title", "chunk_index", "chunk_type", "section", "section_path", "approx_tokens", "text"]
    known = docs.select(T.clean_key("doc_id").alias("k")).where("k is not null").distinct().withColumn("known", F.lit(True))
    times = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("times")).where("times > 1")
    error = (
        F.when(F.greatest(*[F.col(c).isNull() for c in need]), "missing")
        .when((T.strip("text") == "") | (T.strip("chunk_id") == "") | (T.strip("title") == ""), "blank")
        .when(~F.col("chunk_type").isin(*CHUNK_TYPES), "type")
        .when((F.col("approx_tokens") < 1) | (F.col("chunk_index") < 0), "range")
        .when(F.col("known").isNull(), "unknown_doc")
        .when(F.col("times") > 1, "duplicate")
        .otherwise("ok")
    )
    rows = chunks.withColumn("k", T.clean_key("doc_id")).join(known, "k", "left").join(times, "chunk_id", "left")
    return rows.select("chunk_id", error.alias("error"))


def uncovered(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without a chunk and documents that only chunks name, by cleaned key."""
    d = docs.select(T.clean_key("doc_id").alias("doc_id")).where("doc_id is not null").distinct()
    c = chunks.select(T.clean_key("doc_id").alias("doc_id")).where("doc_id is not null").distinct()
    none, unknown = d.join(c, "doc_id", "left_anti"), c.join(d, "doc_id", "left_anti")
    return none.select(F.lit("document_without_chunk").alias("problem"), "doc_id").unionByName(unknown.select(F.lit("chunk_without_document").alias("problem"), "doc_id"))


def floor_percentiles(df: DataFrame, by: str, value: str, parts: list[float]) -> DataFrame:
    """The value at the rounded-down place (n - 1) p in the order of each group.

    Values are counted first, so a group is as many rows as it has different values and no group is collected.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    placed = counted.selectExpr(f"`{by}`", f"`{value}` as value", f"sum(n) over (partition by `{by}` order by `{value}`) as upto", f"sum(n) over (partition by `{by}`) as total", "n")
    wanted = placed.select("*", F.explode(F.array(*[F.lit(float(p)) for p in parts])).alias("p")).withColumn("at", F.floor((F.col("total") - 1) * F.col("p")))
    return wanted.where("at < upto and at >= upto - n").select(by, "p", "value")


def body_lines(docs: DataFrame) -> DataFrame:
    """doc_id and every line of its text but headings and blank ones."""
    return docs.select("doc_id", F.explode(T.clean_lines("text")).alias("line")).where(~is_heading(F.col("line")))


def _bag_difference(original: DataFrame, kept: DataFrame, item: str) -> DataFrame:
    """Of each doc_id the number of items on each side and in one side only. One shuffle, after counting."""
    both = original.select("doc_id", item, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(kept.select("doc_id", item, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = both.groupBy("doc_id", F.xxhash64(item).alias("h"), item).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counted.groupBy("doc_id").agg(F.sum("a").alias("n_original"), F.sum("b").alias("n_chunks"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("n_differing"))


def _word_bag(c: Column | str) -> Column:
    """Of a text its number of words and two sums of hashes of them, which are the same for the same bag of words."""
    words = T.words(c)
    # 40 bits of each hash: the sums of millions of words fit into a long; beyond that they are null, which is never the same
    total = lambda seed: F.aggregate(words, F.lit(0).cast("long"), lambda s, w: F.try_add(s, F.shiftrightunsigned(F.xxhash64(w, F.lit(seed)), 24)))
    return F.struct(F.size(words).alias("n"), total(1).alias("one"), total(2).alias("two"))


def token_differences(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The words of each document (headings apart) against those of its chunks, as bags.

    Rows are summed up first, a few numbers each; the words themselves are only shuffled of documents whose sums differ.
    """
    bags = body_lines(docs).select("doc_id", _word_bag("line").alias("w"), F.lit(1).alias("side")).unionByName(chunks.select("doc_id", _word_bag("text").alias("w"), F.lit(-1).alias("side")))
    signed = lambda x: F.when(F.count_if(F.col(f"w.{x}").isNull()) == 0, F.try_sum(F.col(f"w.{x}") * F.col("side")))
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("w.n")).otherwise(0))
    sums = stage(bags.groupBy("doc_id").agg(side(1).alias("n_original"), side(-1).alias("n_chunks"), (F.coalesce(signed("one") == 0, F.lit(False)) & F.coalesce(signed("two") == 0, F.lit(False))).alias("same")), "bags")
    same = sums.where("same and n_original + n_chunks > 0").select("doc_id", "n_original", "n_chunks", F.lit(0).cast("long").alias("n_differing"))
    other = sums.where("not same").select("doc_id")
    words = lambda df, c: df.join(other, "doc_id", "left_semi").select("doc_id", F.explode(T.words(c)).alias("word"))
    return same.unionByName(_bag_difference(words(body_lines(docs), "line"), words(chunks, "text"), "word"))


def ordered_content(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, same_order, token_ratio, char_ratio, lossless: the text of each document (headings apart, white space collapsed) against that of its chunks in their order.

    A document's chunks are put together again, which is as much as its own text. Documents without words are left out.
    """
    original = docs.where("text is not null").select("doc_id", T.collapse(F.array_join(F.filter(T.clean_lines("text"), lambda x: ~is_heading(x)), " ")).alias("a")).where("a <> ''")
    kept = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("l"))
    kept = kept.select("doc_id", T.collapse(F.array_join(F.transform("l", lambda x: x["text"]), " ")).alias("b"))
    ratio = F.length(F.replace("b", F.lit(" "), F.lit(""))) / F.length(F.replace("a", F.lit(" "), F.lit("")))
    return original.join(kept, "doc_id", "left").select("doc_id", (F.col("a") == F.coalesce("b", F.lit(""))).alias("same_order"), F.round(T.word_count("b") / T.word_count("a"), 6).alias("token_ratio"), F.round(ratio, 6).alias("char_ratio"), (ratio >= 0.995).alias("lossless"))


def line_differences(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many lines of each document (headings apart) are in no chunk of it, as bags; chunks delivered again count once."""
    lines = body_lines(docs.withColumn("doc_id", T.clean_key("doc_id")))
    stored = chunks.select("chunk_id", T.clean_key("doc_id").alias("doc_id"), "text", F.col("doc_id").alias("raw")).distinct().select("doc_id", F.explode(T.clean_lines("text")).alias("line"))
    both = lines.select("doc_id", "line", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(stored.select("doc_id", "line", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = both.where("doc_id is not null").groupBy("doc_id", "line").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 0")
    return counted.groupBy("doc_id").agg(F.sum("a").alias("n_lines"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("n_lost"))


def _visible(c: Column | str) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", ""))


def character_ratio(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The characters of each document (headings and white space apart), those of its chunks, and their ratio."""
    a = body_lines(docs).select("doc_id", _visible("line").alias("a"), F.lit(0).alias("b"))
    b = chunks.select("doc_id", F.lit(0).alias("a"), _visible("text").alias("b"))
    sums = a.unionByName(b).groupBy("doc_id").agg(F.sum("a").alias("n_original"), F.sum("b").alias("n_chunks")).where("n_original > 0")
    return sums.select("*", F.round(F.col("n_chunks") / F.col("n_original"), 6).alias("ratio"))


def loss_classes(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines of documents that are in no chunk of them: how many and how long, by whether they are headings, structure or content."""
    lines = docs.select(T.clean_key("doc_id").alias("doc_id"), F.explode(T.clean_lines("text")).alias("line")).where("doc_id is not null")
    stored = chunks.select(T.clean_key("doc_id").alias("doc_id"), F.explode(T.clean_lines("text")).alias("line")).distinct()
    lost = lines.join(stored, ["doc_id", "line"], "left_anti")
    kind = F.when(is_heading(F.col("line")), "heading").when(F.col("line").startswith("[Infobox") | T.is_table_row(F.col("line")), "structural").otherwise("content")
    return lost.groupBy(kind.alias("class")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
