"""Rankings by arrays against a plain model, whatever the sizes of parts, ranges, groups and blocks."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from corpusloom.operators import ranking
from corpusloom.operators.retrieval import Nearest, letter_vectors
from corpusloom.plans import catalogue
from tests.compared import DATA


def terms(text):
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if len(w) > 1]
    return words, Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def model(texts, questions, k, by_words):
    counts = {key: terms(t or "") for key, t in texts.items()}
    df = Counter(x for _, c in counts.values() for x in c)
    idf = {x: math.log((1 + len(texts)) / (1 + n)) + 1 for x, n in df.items()}
    norm = lambda c: math.sqrt(sum((n * idf[x]) ** 2 for x, n in c.items() if x in idf))
    out = set()
    for qid, question in questions.items():
        words, asked = terms(question)
        found = []
        for key, (own, c) in counts.items():
            shared = len(set(words) & set(own)) if by_words else sum(n * c[x] * idf[x] ** 2 for x, n in asked.items() if x in c)
            if shared:
                found.append((-round(shared / math.sqrt(len(set(own))) if by_words else shared / norm(c) / norm(asked), 8), key))
        out |= {(qid, key, -s, rank) for rank, (s, key) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("by_words", [False, True])
def test_rankings_against_model(spark, tmp_path, monkeypatch, by_words):
    for name, n in (("RANGE_TEXTS", 10), ("GROUP_TEXTS", 10_000), ("ASKED", 5)):
        monkeypatch.setattr(ranking, name, n)
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice("the the The in in at games Games sail-ing foil é x 1964 row épée swim run".split()) for _ in range(n))
    texts = {f"c{i}_é" if i % 7 else f"C{i}": some(rng.randrange(1, 25)) for i in range(120)} | {"null": None, "none": "é", "copy": "games games", "copy2": "games games"}
    questions = {f"q{i}": some(i) for i in range(17)} | {"unknown": "zz yy", "half": "foil zz", "empty": ""}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame(list(questions.items()), "qid string, question string")
    index = ranking.Rankings.build(docs, asked, str(tmp_path / "index"))
    for k in (1, 7, 200):
        found = index.overlap(k) if by_words else index.search(k)
        assert {(r.qid, r.chunk_id, r.score, r["rank"]) for r in found.collect()} == model(texts, questions, k, by_words)


#: What the queries ask of the rankings: before, each 131,072 texts gave so many rows a question, now a group of many parts does.
@pytest.mark.parametrize("k, by_words", [(5, True), (50, False), (50, True), (300, False), (300, True)])
def test_candidates_do_not_grow_with_parts(spark, tmp_path, monkeypatch, k, by_words):
    found, meet = [], PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda *a, **x: found.append(meet(*a, **x)) or found[-1])
    monkeypatch.setattr(ranking.Rankings, "_texts", lambda self: 1_500_000)
    rng = random.Random(3)
    texts = {f"c{i * 7919 % 10_007:05}": " ".join(rng.choices("foil row swim run games 1964".split(), k=rng.randrange(2, 9))) for i in range(320 if k < 300 else 1400)}
    questions = {"q1": "foil row swim run games 1964", "q2": "games 1964"}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id string, text string").repartition(12)
    index = ranking.Rankings.build(docs, spark.createDataFrame(list(questions.items()), "qid string, question string"), str(tmp_path / "index"))
    rows = (index.overlap(k) if by_words else index.search(k)).collect()
    assert {(r.qid, r.chunk_id, r.score, r["rank"]) for r in rows} == model(texts, questions, k, by_words)
    assert index.parts.count() == 13 and found[0].count() <= 3 * k * len(questions)


def test_rankings_of_no_texts(spark, tmp_path):
    docs = spark.createDataFrame([], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "foil")], "qid string, question string")
    assert ranking.Rankings.build(docs, asked, str(tmp_path / "index")).search(3).count() == 0


def test_blobs():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(60), np.zeros(0), np.asarray([3, 70_000], dtype=np.uint32)]
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, ranking.unpack(ranking.pack(*arrays))))


def test_best_and_nearest_block_by_block():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, (9, 500)) / 40  # many ties
    best, near = ranking.Best(9, 12), Nearest(9, 12)
    ids = np.asarray([f"v{i:03}" for i in rng.permutation(500)])
    for at in range(0, 500, 64):
        best.add(values[:, at : at + 64], at)
        near.add(np.asarray(["v007"] * 9), ids[at : at + 64], values[:, at : at + 64].copy())
    row, column, _ = best.rows()
    assert list(zip(row, column)) == [(r, c) for r in range(9) for c in sorted(range(500), key=lambda c: (-values[r, c], c))[:12] if values[r, c] > 0]
    row, found, _ = near.rows()
    nearest = [[x for x in sorted(ids, key=lambda x: (values[r, list(ids).index(x)], x)) if x != "v007"][:12] for r in range(9)]
    assert list(zip(row, found)) == [(r, x) for r in range(9) for x in nearest[r]]


def test_letters(spark):
    df = spark.createDataFrame([("a", "Zaz é-{`"), ("b", None), ("c", ""), ("d", "bİ")], "id string, t string")
    found = {r.vec_id: r.embedding for r in letter_vectors(df, "id", "t").collect()}
    assert found["b"] is None and sum(found["c"]) == 0
    assert {k: {chr(97 + i): n for i, n in enumerate(found[k]) if n} for k in "ad"} == {"a": {"a": 1, "z": 2}, "d": {"b": 1, "i": 1}}


#: Before, each term of a question met each text that has it as a row of a join; these ask for so many rankings.
@pytest.mark.parametrize("name, rankings", [("rerank_deep", 2), ("hybrid", 1), ("evidence_format_deep", 2), ("context_budget", 2), ("rrf_deep", 2), ("tfidf_topk", 1), ("rerank", 2), ("context_budget_deep", 2), ("dedup_per_doc", 2), ("dedup_per_doc_deep", 2), ("evidence_format", 2), ("overlap_topk", 1), ("rrf", 2)])
def test_no_row_for_each_posting(spark, monkeypatch, name, rankings):
    asked, ranked = [], ranking.Rankings._ranked
    monkeypatch.setattr(ranking.Rankings, "_ranked", lambda *a, **k: asked.append(ranked(*a, **k)) or asked[-1])
    catalogue.queries()[name](spark, f"{DATA}/sf0.001")
    assert len(asked) == rankings
    assert all("FlatMapCoGroupsInPandas" in x._jdf.queryExecution().executedPlan().toString() for x in asked)


#: Before, found pairs and their ids were broadcast by the size of compressed files.
@pytest.mark.parametrize("name", ["rerank", "rerank_deep", "hybrid"])
def test_found_pairs_are_not_broadcast(spark, name):
    plan = catalogue.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan
