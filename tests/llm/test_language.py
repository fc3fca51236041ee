import pytest

from corpusloom.llm import language as L
from corpusloom.session import table

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learnt(spark):
    names = L.label_names(table(spark, D, "languages"))
    return names, L.learn(table(spark, D, "documents"), names)


EN = "The committee decided that the race would start again because the clock had failed. "
DE = "Der Verband bestätigte, dass die Mannschaft den Lauf wegen des Gegenwinds verloren hatte und nicht antreten wollte. "


def test_main_and_passages(learnt):
    _, profiles = learnt
    texts = [EN * 3, DE * 3, EN * 4 + DE + EN, DE * 4 + EN, EN + "„Der Weg“", None, "", "12 13 14", "1 | 2 | 3\n" * 20, EN * 400]
    got = L.judge(texts, profiles)
    assert [[(x[0], x[1]) for x in g] for g in got] == [[("en", True)], [("de", True)], [("en", True), ("de", False)], [("de", True), ("en", False)], [("en", True)], [], [], [], [], [("en", True)]]
    assert all(0 < x[3] <= 1 for g in got for x in g)
    assert L.judge([], profiles) == []


@pytest.mark.parametrize("label,code", [("en", "en"), (" EN-gb ", "en"), ("deu", "de"), ("Français", "fr"), ("pt_BR", "pt"), ("xx", None), ("", None), (None, None), ("und", None), ("english", "en")])
def test_labels(spark, learnt, label, code):
    df = spark.createDataFrame([(label,)], "lang string")
    assert df.select(L.label_code(df["lang"], learnt[0])).first()[0] == code


def test_held_out_labels(spark, learnt):
    """Labels are right for most rows: of the texts not used for learning nearly all plain labels are confirmed."""
    names, profiles = learnt
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    judged = L.languages_of(docs, profiles, ["doc_id", "lang"]).where("main")
    rows = [r for r in judged.withColumn("code", L.label_code(judged["lang"], names)).collect() if r.code]
    assert sum(r.code == r.language for r in rows) >= 0.85 * len(rows) > 30


def test_cases(spark, learnt):
    names, profiles = learnt
    rows = [(1, EN * 3, "en"), (2, EN * 3, "German"), (3, EN * 3, None), (4, EN * 4 + DE, "en"), (5, None, None), (6, "too short", "de"), (1, EN * 3, "en"), (None, EN * 3, " ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, language string")
    got = {tuple(r) for r in L.label_cases(L.languages_of(df, profiles, ["doc_id", "lang"]), names).collect()}
    assert got == {(2, "wrong", "en"), (3, "missing", "en"), (4, "segment", "de"), (None, "missing", "en")}
    assert L.languages_of(df.limit(0), profiles, ["doc_id", "lang"]).count() == 0


def test_nothing_learnt(spark):
    df = spark.createDataFrame([(1, EN, "en")], "doc_id long, text string, lang string")
    empty = L.learn(df.limit(0), {"en": "en"})
    assert empty.languages == [] and L.languages_of(df, empty, ["doc_id", "lang"]).count() == 0
