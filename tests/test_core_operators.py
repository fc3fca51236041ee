"""Small cases of the core operators: examples, nulls, ties, empty tables."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answering, documents, graph, incremental, integrity, orphans, retrieval
from corpusloom.operators.components import connected_components
from corpusloom.sources import jsonl
from corpusloom.streaming import ingest


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def test_tokens(spark):
    rows = spark.createDataFrame([("",), (" \t",), ("one two",), ("a b c",), (None,)], "t string").select(T.approx_tokens("t").alias("n")).collect()
    assert [r.n for r in rows] == [0, 1, 2, 3, None]


def test_lines(spark):
    rows = spark.createDataFrame([("a\r\nb\n",), ("a\x85b c",), ("",)], "t string").select(T.lines("t").alias("l")).collect()
    assert [r.l for r in rows] == [["a", "b"], ["a", "b", "c"], []]


def orphan_model(refs, recs):
    out = set()
    for table, key, field, k, t in refs:
        k = k.strip().lower() if k else None
        if not k:
            continue
        own = [(a, d) for name, a, d in recs if name and name.strip().lower() == k]
        if t is None:
            if not own:
                out.add((table, key, field, "missing", None))
            continue
        arrived = [(a, d) for a, d in own if a is not None and a <= t]
        if any(d is None or d > t for a, d in arrived):
            continue
        kind = "missing" if not own else "late" if not arrived else "deleted"
        out.add((table, key, field, kind, t.strftime("%Y-%m")))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_orphans_against_model(spark, seed):
    rng = random.Random(seed)
    keys = ["A", " b", "c\t", "D", "e", "", None, "hot", "gone"]
    recs = [(rng.choice(keys[:-1]), day(rng.choice([None, *range(0, 120, 7)])), day(rng.choice([None, None, *range(0, 150, 7)]))) for _ in range(40)]
    refs = [("t", str(k), "f", rng.choice(["hot", "HOT ", *keys]), day(rng.choice([None, *range(0, 150)]))) for k in range(300)]
    df = spark.createDataFrame([(r[1], r[3], r[4], "x", 1) for r in refs], "id string, f string, t timestamp_ntz, key string, salt int")
    parents = spark.createDataFrame([(*r, 1) for r in recs], "k string, a timestamp_ntz, d timestamp_ntz, month int")
    found = orphans.find_orphans(orphans.references(df, "t", "id", "f", "p", "t"), orphans.records(parents, "p", "k", "a", "d"))
    assert {tuple(r) for r in found.collect()} == orphan_model(refs, recs)


def test_orphans_of_empty_tables(spark):
    df = spark.createDataFrame([], "id string, f string, t timestamp_ntz")
    parents = spark.createDataFrame([], "k string, a timestamp_ntz, d timestamp_ntz")
    recs = orphans.records(parents, "p", "k", "a", "d")
    assert orphans.find_orphans(orphans.references(df, "t", "id", "f", "p", "t"), recs).count() == 0
    one = spark.createDataFrame([("1", "x", day(3))], "id string, f string, t timestamp_ntz")
    assert [r.kind for r in orphans.find_orphans(orphans.references(one, "t", "id", "f", "p", "t"), recs).collect()] == ["missing"]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(None, 3), (200, 200)] + [(300, 301 + k) for k in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for e in edges for x in e if x is not None}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_rank_fusion_and_caps(spark):
    one = spark.createDataFrame([("q", "a1", 1), ("q", "b1", 2)], "qid string, chunk_id string, rank int")
    two = spark.createDataFrame([("q", "b1", 1), ("q", "a2", 2)], "qid string, chunk_id string, rank int")
    fused = retrieval.fuse_ranks([one, two])
    assert [r.chunk_id for r in fused.orderBy("rank").collect()] == ["b1", "a1", "a2"]
    rows = spark.createDataFrame([("q", "a1", "a", 1), ("q", "a2", "a", 2), ("q", "b1", "b", 3)], "qid string, chunk_id string, doc_id string, rank int")
    assert [r.chunk_id for r in retrieval.cap_per_document(rows).orderBy("rank").collect()] == ["a1", "b1"]
    with pytest.raises(ValueError):
        retrieval.cap_per_document(rows, 0)


def test_budget(spark):
    rows = spark.createDataFrame([("q", k + 1, f"c{k}", n) for k, n in enumerate([10, 10, 4])] + [("big", 1, "x", 99), ("big", 2, "y", 1)], "qid string, rank int, chunk_id string, tokens int")
    got = retrieval.within_budget(rows, 15).orderBy("qid", "source_no").collect()
    assert [(r.qid, r.chunk_id) for r in got] == [("big", "x"), ("q", "c0"), ("q", "c2")]


def test_vectors_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)] + [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, 2.0]), (304, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in retrieval.vector_search(df, df.where("vec_id in (0, 7, 303)"), 3, block=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    vec = dict(rows)
    for q in (0, 7):
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        best = sorted(range(200), key=lambda k: (-cos(vec[q], vec[k]), k))
        assert [v for _, v in sorted(got[q])] == [k for k in best if k != q][:3]
    assert got[303] == [(1, 304)]


def test_record_errors(spark):
    rows = [("a", "t", "x"), ("b", "t", "x"), ("b", "t", "x"), (None, "t", "x"), ("c", " ", "x"), ("d", "t", None)]
    got = documents.record_errors(spark.createDataFrame(rows, "doc_id string, title string, text string")).collect()
    assert sorted((r.doc_id or "", r.error) for r in got) == [("", "missing"), ("a", "ok"), ("b", "duplicate"), ("b", "duplicate"), ("c", "blank"), ("d", "missing")]


def test_latest_breaks_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n")]
    for order in itertools.permutations(rows):
        got = documents.latest(spark.createDataFrame(list(order), "k string, t int, v string"), ["k"], ["t"]).collect()
        assert [tuple(r) for r in got] == [("a", 2, "z")]
        break


def test_incremental(spark):
    old = spark.createDataFrame([("a", "x", day(1)), ("b", "y", day(1))], "chunk_id string, text string, ingested_at timestamp_ntz")
    new = spark.createDataFrame([("a", "x", day(2)), ("b", "z", day(2)), ("c", None, day(2)), (None, "q", day(2))], old.schema)
    assert {tuple(r) for r in incremental.changed_rows(old, new).collect()} == {("a", "same"), ("b", "changed"), ("c", "new")}


def test_percentiles(spark):
    df = spark.createDataFrame([("g", v) for v in [5, 1, 3, 3, 9]] + [("h", 2)], "k string, v int")
    got = {(r.k, r.p): r.value for r in integrity.floor_percentiles(df, "k", "v", [0.5, 0.9]).collect()}
    assert got == {("g", 0.5): 3, ("g", 0.9): 5, ("h", 0.5): 2, ("h", 0.9): 2}


def test_token_difference_is_seen(spark):
    docs = spark.createDataFrame([("d", "History\none two two")], "doc_id string, text string")
    chunks = spark.createDataFrame([("d", "one two three")], "doc_id string, text string")
    assert tuple(integrity.token_differences(docs, chunks).first()) == ("d", 3, 3, 2)


def test_contract(spark):
    rows = [(1, "e1", "event", "WON_BY", "a1", "Athlete", "Gold"), (2, "e1", "Event", "WON_BY", "a1", "Athlete", "TIN"), (3, "a1", "Athlete", "WON_BY", "e1", "Event", None), (4, " ", "Event", "WON_BY", "a1", "Athlete", None), (5, "e1", "Thing", "WON_BY", "a1", "Athlete", None), (6, "e1", "Event", "MET", "a1", "Athlete", None), (7, "a1", "Athlete", "REPRESENTS", "c1", "Country", "GOLD")]
    df = spark.createDataFrame([(*r, "c", day(1)) for r in rows], "rel_id long, source string, source_type string, relationship string, target string, target_type string, medal string, source_chunk_id string, ingested_at timestamp_ntz")
    assert {r.rel_id: r.error for r in graph.contract_errors(df).collect()} == {1: "ok", 2: "medal", 3: "signature", 4: "end", 5: "type", 6: "relation", 7: "medal"}


def test_competitor_numbers(spark):
    rows = [("a", "competitors: 24"), ("b", "24 competitors"), ("c", "competitors: 1988"), ("d", "2004 athletes"), ("e", "competitors: 900"), ("f", "none")]
    got = {r.doc_id: r.competitors for r in answering.competitors(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 24, "b": 24, "c": 198, "d": 4}


@pytest.mark.parametrize("question,intent", [("How many nations competed in x?", "LOOKUP"), ("how many biathlon events had > 73", "AGGREGATION"), ("how many sailing events had more than 4", "LOOKUP"), ("Which had the highest number?", "SUPERLATIVE"), ("held immediately before 2016", "TEMPORAL"), ("Who won it?", "MULTI_HOP"), ("Hm", "LOOKUP")])
def test_router(spark, question, intent):
    df = spark.createDataFrame([("q", question, None)], "qid string, question string, qtype string")
    assert answering.route(df).first().intent == intent


def test_matching(spark):
    rows = [("Answer is Paris.", ["paris"], "lookup", True), ("There are 15", ["5"], "lookup", True), ("7 of them", ["6"], "aggregation", False), ("Failed to generate", ["f"], "lookup", False), ("King, Laura; Trott", ["Laura Trott King"], "multi_hop", True), (None, ["x"], "lookup", False), ("x", [], "lookup", False), ("x", None, None, False)]
    df = spark.createDataFrame(rows, "predicted_answer string, answer array<string>, qtype string, want boolean")
    assert all(r.got == r.want for r in df.select("*", answering.matches().alias("got")).collect())


def test_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"doc_id": "a", "title": "t", "text": "x", "wikipedia_pageid": 5}\n\n{"doc_id": "b"}\n')
    rows = jsonl.read_strict(spark, str(tmp_path / "in.jsonl"))
    assert sorted((r.doc_id, r.wikipedia_pageid) for r in rows.collect()) == [("a", "5"), ("b", None)]
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "a"}\nnot-json\n')
    assert jsonl.read_lenient(spark, str(tmp_path / "bad.jsonl")).where("_corrupt is not null").count() == 1
    with pytest.raises(jsonl.CorruptInput):
        jsonl.read_strict(spark, str(tmp_path / "bad.jsonl"))
    jsonl.publish(rows, str(tmp_path / "out"), str(tmp_path / "staging"))
    assert jsonl.read_strict(spark, str(tmp_path / "out")).count() == 2 and not (tmp_path / "staging").exists()
    with pytest.raises(FileExistsError):
        jsonl.publish(rows, str(tmp_path / "out"), str(tmp_path / "staging"))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, "k string, t int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = ingest.read_files(spark, str(tmp_path / "in"))
        return {tuple(r) for r in ingest.upsert_stream(stream, ["k"], ["t"], str(tmp_path / "state"), str(tmp_path / "cp")).collect()}

    add([("a", 1, "x"), ("b", 5, "y")])
    assert run() == {("a", 1, "x"), ("b", 5, "y")}
    add([("a", 2, "z"), ("b", 3, "late")])
    assert run() == run() == {("a", 2, "z"), ("b", 5, "y")}


def test_slug(spark):
    df = spark.createDataFrame([(" Été 1984!",), ("x" * 50,), ("--",)], "s string").select(T.slug("s").alias("s"))
    assert [r.s for r in df.collect()] == ["t-1984", "x" * 40, ""]


def test_word_pairs(spark):
    df = spark.createDataFrame([("The cat, a sat",), ("x",), ("",)], "t string").select(F.array_sort(retrieval.terms(F.col("t"))).alias("w"))
    assert [r.w for r in df.collect()] == [["cat", "cat sat", "sat", "the", "the cat"], [], []]
