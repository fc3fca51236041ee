"""Queries that look as far as the reference does."""

import duckdb

from corpusloom.operators import ranking
from corpusloom.plans import catalogue
from tests.compared import DATA, connect, same_rows

D = f"{DATA}/sf0.01"


def test_deep_ranking_keeps_more_documents(spark):
    found = catalogue.queries()
    keep = {name: {(r.qid, r.doc_id) for r in found[name](spark, D).collect()} for name in ("dedup_per_doc", "dedup_per_doc_deep")}
    assert keep["dedup_per_doc"] < keep["dedup_per_doc_deep"]


#: Before, only questions whose number is divisible by 20 were asked: here one of ten.
def test_hybrid_asks_all_questions(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (from '{DATA}/sf0.001/chunks.parquet') to '{tmp_path}/chunks.parquet'")
    some = ["e-1", "e-19", "e-20", "e-21", "no number", "7", "e-3x", ""]
    con.sql("create table questions (qid varchar, question varchar)")
    con.executemany("insert into questions values (?, ?)", [(q, f"Who won the {n} metres at the {1960 + n} Games?") for n, q in enumerate(some)] + [("e-22", "Who won the 1 metres at the 1961 Games?"), ("e-22", "zz zz"), ("e-23", "zebra"), (None, "Who won?"), ("e-40x", None), ("e-41", "?!")])
    con.sql(f"copy questions to '{tmp_path}/questions.parquet'")
    con.sql(f"create view chunks as from '{tmp_path}/chunks.parquet'")
    df = catalogue.queries()["hybrid"](spark, str(tmp_path))
    same_rows(df, con, catalogue.oracle_sql()["hybrid"])
    assert {r.qid for r in df.select("qid").collect()} == {*some, "e-22", "e-23"}


#: A group of texts has not all of a ranking where there are more than ``GROUP_TEXTS``.
def test_hybrid_of_many_groups_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "GROUP_TEXTS", 60_000)
    groups, rows = [], ranking._fused_rows
    monkeypatch.setattr(ranking, "_fused_rows", lambda found, *a: groups.append(found) or rows(found, *a))
    (tmp_path / "d").symlink_to(f"{DATA}/sf0.001")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same_rows(catalogue.queries()["hybrid"](spark, str(tmp_path / "d")), connect("sf0.001"), catalogue.oracle_sql()["hybrid"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(groups) == 1
