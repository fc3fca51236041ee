"""Raw documents: the live row of each, records that break the contract, profiles of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_lines, is_table_row, strip


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` and then by all other columns, so that ties have one outcome. Null keys are dropped.

    One aggregation with a partial step before the shuffle; no sort of a key's rows.
    """
    rest = [c for c in df.columns if c not in key and c not in order and not df.schema[c].dataType.simpleString().startswith("map")]
    kept = [c for c in df.columns if c not in key]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in key))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(*order, *rest)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def live_documents(docs: DataFrame) -> DataFrame:
    """The last loaded row of every document, unless that one is deleted."""
    return latest(docs, ["doc_id"], ["loaded_at"]).where("deleted_at is null")


def record_errors(docs: DataFrame) -> DataFrame:
    """doc_id, title and error of each row: the first of ``missing``, ``blank``, ``duplicate`` (its doc_id occurs again), or ``ok``.

    Duplicates are counted by an aggregation joined back, so a doc_id with many rows is no single task's work.
    """
    fields = ("doc_id", "title", "text")
    times = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1")
    missing = F.greatest(*[F.col(c).isNull() for c in fields])
    blank = F.greatest(*[strip(c) == "" for c in fields])
    error = F.when(missing, "missing").when(blank, "blank").when(F.col("times") > 1, "duplicate").otherwise("ok")
    return docs.join(times, "doc_id", "left").select("doc_id", "title", error.alias("error"))


def missing_fields(docs: DataFrame, fields: list[str]) -> DataFrame:
    """How many rows lack each field (null or empty)."""
    counts = docs.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in fields])
    return counts.unpivot([], fields, "field", "n_missing")


def repeated_values(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Every value of a field that several rows have, null and empty ones apart."""
    long = docs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])).alias("x")).select("x.*")
    return long.where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")


def structure(docs: DataFrame, by: str) -> DataFrame:
    """Counts of documents with boxes, result sections, tables and headings, by a column."""
    text = F.col("text")
    rows = F.size(F.filter(clean_lines(text), is_table_row))
    results = text.contains("\nResults") | text.startswith("Results")
    flags = {"with_box": text.contains("[Infobox"), "with_results": results, "with_results_table": text.contains("Results table"), "with_rows": rows > 0, "with_bangs": text.contains("!!"), "with_pipe_line": text.contains("\n|"), "with_wiki_heading": text.contains("\n==") | text.startswith("=="), "with_paragraphs": text.contains("\n\n")}
    return docs.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def results_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class of what follows the first line ``results``: ``none`` (no such line), ``empty``, ``rows`` or ``prose``."""
    lines = clean_lines("text")
    at = F.array_position(F.transform(lines, F.lower), "results").cast("int")
    after = F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))
    kind = F.when(at == 0, "none").when(F.size(after) == 0, "empty").when(F.exists(after, is_table_row), "rows").otherwise("prose")
    return docs.where("text is not null").select("doc_id", kind.alias("results"))


def first_difference(docs: DataFrame) -> DataFrame:
    """For documents loaded several times: the first line in which the last version differs from the first one, 0 if in none."""
    versions = docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min_by("text", F.struct("loaded_at", "text")).alias("a"), F.max_by("text", F.struct("loaded_at", "text")).alias("b"), F.count("*").alias("n")).where("n > 1")
    a, b = F.split("a", "\n"), F.split("b", "\n")
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b))), lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return versions.select("doc_id", F.col("n").alias("n_versions"), F.coalesce(F.try_element_at(differ, F.lit(1)), F.lit(0)).alias("first_line"), (F.length("b") - F.length("a")).alias("longer_by"))
