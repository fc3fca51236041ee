import unicodedata

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answering, integrity
from corpusloom.operators.retrieval import VectorIndex, vector_search

ODD = [None, "", " ", "Ångström ﬁve½", "a b", "漢字x", "x\n\n\n\ny", "a \t b", "é" * 2000]


def test_decomposed_and_sanitized(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "t string")
    got = df.select("t", T.nfkd(F.col("t")).alias("n"), T.sanitize("t", 50).alias("s")).collect()
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFKD", r.t)) for r in got)
    plain = {r.t: r.s for r in got}
    assert plain[None] is None and plain["a b"] == "a b" and plain["x\n\n\n\ny"] == "x\n\ny" and plain["漢字x"] == "x" and len(plain["é" * 2000]) == 50


def test_blanks_are_those_of_the_pattern(spark):
    df = spark.createDataFrame([(chr(k),) for k in range(1, 0xFFFF) if not 0xD800 <= k < 0xE000], "c string")
    blank = F.regexp_replace("c", rf"(?U){T.BLANK}", "") == ""
    assert df.where(blank != (T.strip("c") == "")).count() == 0
    assert df.where(blank).count() == len(T.BLANKS)
    odd = spark.createDataFrame([(x,) for x in ODD], "t string").select("t", T.strip("t").alias("s"), T.strip_end("t").alias("e")).collect()
    assert all((r.s, r.e) == ((None, None) if r.t is None else (r.t.strip(), r.t.rstrip())) for r in odd)


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("12", " -3 ", "1.0", "x", "", None, "9" * 30)], "t string")
    assert [r[0] for r in df.select(T.whole_number("t")).collect()] == [12, -3, None, None, None, None, None]
    assert [r[0] for r in df.select(T.char_tokens("t")).collect()] == [0, 1, 0, 0, 0, None, 7]


def test_bags_and_order(spark):
    docs = spark.createDataFrame([("same", "a b\nc a"), ("moved", "a b\nc"), ("lost", "a b c"), ("empty", ""), ("null", None), ("alone", "x y")], "doc_id string, text string")
    chunks = spark.createDataFrame([("same", 1, "c a"), ("same", 0, "a b"), ("moved", 0, "c"), ("moved", 1, "a b"), ("lost", 0, "a b b"), ("extra", 0, "q")], "doc_id string, chunk_index int, text string")
    got = {r.doc_id: (r.n_original, r.n_chunks, r.n_differing) for r in integrity.token_differences(docs, chunks).collect()}
    assert got == {"same": (4, 4, 0), "moved": (3, 3, 0), "lost": (3, 3, 2), "alone": (2, 0, 2), "extra": (0, 1, 1)}
    got = {r.doc_id: (r.same_order, r.token_ratio, r.lossless) for r in integrity.ordered_content(docs, chunks).collect()}
    assert got == {"same": (True, 1.0, True), "moved": (False, 1.0, True), "lost": (False, 1.0, True), "alone": (False, None, None)}


def test_candidates_of_questions_without_a_year(spark):
    titles = ["Women's epee", "Tournament of Masters", "MENTION", "Sportswomen today", "the foil", "", None, "zz"]
    docs = spark.createDataFrame([(f"d{k}", t, "x", 1) for k, t in enumerate(titles)], "doc_id string, title string, text string, qid int")
    questions = spark.createDataFrame([("q1", "Best women in epee?", None, [], []), ("q2", "A tournament for foil", None, [], []), ("q3", None, None, [], []), ("q4", "", None, [], []), ("q5", "zz zzz", None, [], [])], "qid string, question string, qtype string, answer array<string>, gold_doc_ids array<string>")
    got = {(r.qid, r.doc_id): r.score for r in answering.candidates(questions, docs).collect()}
    assert got and got == brute(questions.collect(), docs.collect())


def test_passages_of_questions_without_a_title(spark):
    passages = spark.createDataFrame([("c1", "a", 0, "The foils of 1988 and foil"), ("c2", "a", 1, "foil"), ("c3", "b", 0, "unfoiled 1988"), ("c4", None, 0, "foil"), ("c5", "d", 0, None), ("c6", "e", 0, "")], "chunk_id string, doc_id string, chunk_index int, text string")
    questions = spark.createDataFrame([("q1", "Foil foil in 1988?", None, [], []), ("q2", "xyz", None, [], []), ("q3", None, None, [], [])], "qid string, question string, qtype string, answer array<string>, gold_doc_ids array<string>")
    got = {(r.qid, r.doc_id): (r.score, r.rank) for r in answering.candidates_by_passages(questions, passages).collect()}
    assert got == {("q1", "a"): (2 + 1 + 3 + 2, 1), ("q1", "b"): (2 + 1 + 3, 2)}
    docs = spark.createDataFrame([("a", "A"), ("b", None), ("z", "Z")], "doc_id string, title string")
    assert {(r.doc_id, r.text) for r in answering.first_texts(docs, passages).collect()} == {("a", "The foils of 1988 and foil\nfoil"), ("b", "unfoiled 1988")}


def brute(questions, docs):
    import re

    out = {}
    for q in questions:
        low = (q.question or "").lower()
        terms = [w for w in re.split(r"[^\w]+", low) if len(w) > 2 and w not in answering.STOPWORDS]
        women = "women" in low or "female" in low
        men = "men" in low or ("male" in low and not women)
        for d in docs:
            t = (d.title or "").lower()
            if not t:
                continue
            score = 2 * sum(w in t for w in terms)
            about_women, about_men = "women" in t, "men" in t and "women" not in t
            score += 5 if women and (about_women or "female" in t) else -5 if women and about_men else 0
            score += 5 if men and about_men else -5 if men and about_women else 0
            if score > 0:
                out[q.qid, d.doc_id] = score
    return out


def test_vector_index_finds_nine_of_ten(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    # a third of all vectors in one place, some odd ones
    rows = [(k, (centres[0 if k % 3 == 0 else k % 12] + rng.normal(size=16) * 0.3).tolist(), "x") for k in range(1500)] + [(2000, None, "x"), (2001, [], "x"), (2002, [0.0] * 16, "x"), (2003, [1.0, 2.0], "x"), (2004, [2.0, 1.0], "x"), (2005, rows0(centres), "x"), (2006, rows0(centres), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    queries = df.where("vec_id % 20 = 0 or vec_id > 1999")
    exact = {(r.query_id, r.vec_id) for r in vector_search(df, queries, 5).collect()}
    found = {(r.query_id, r.vec_id) for r in VectorIndex(df).search(queries, 5, block=100).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and (2003, 2004) in found and (2005, 2006) in found
    assert VectorIndex(df.limit(0)).search(queries, 5).count() == 0


def rows0(centres):
    return centres[3].tolist()
