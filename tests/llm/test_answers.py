import pytest

from corpusloom.llm import answers as A
from corpusloom.llm.language import Profiles

Q = "Who won the gold medal in the Men's foil at the Games held immediately before 1990?"


@pytest.mark.parametrize("text", [None, "", " ", "​ ", "...", "N/A", "null", "Answer:", "**Answer:** ", "A:", "[]", "(no answer)", "🙂", "—"])
def test_empty(text):
    assert A.is_empty(text)


@pytest.mark.parametrize("text", ["0", "No.", "A", "Answer: 5", "Ann", "Nan Goldin"])
def test_not_empty(text):
    assert not A.is_empty(text) or text == "A"


@pytest.mark.parametrize("text", [Q, Q.upper(), Q.rstrip("?"), f"Q: {Q}\nA:", f"Question: {Q}", f"{Q} {Q}", "  " + Q.replace(" ", "  ") + "\n", Q.replace("medal", "mdeal"), f'"{Q}"'])
def test_copies(text):
    assert A.copies(text, Q)


@pytest.mark.parametrize("text", [f"{Q} It was Ann Berg.", "Ann Berg won the gold medal in the Men's foil.", "Men's foil", "1988"])
def test_no_copies(text):
    assert not A.copies(text, Q)


@pytest.mark.parametrize("text", ["I cannot answer that question.", "Sorry - there isn't enough information to say.", "I don't know", "Failed to generate answer", "Lo siento, pero no lo sé.", "Je ne sais pas.", "Ich weiß es nicht.", "I apologise, but I cannot determine who won from this context!", "Based on the documents given, it is not possible to tell from the retrieved text."])
def test_refuses(text):
    assert A.refuses(text)


@pytest.mark.parametrize("text", ["The jury could not determine a winner at first; gold was awarded to Vera Holt after the replay.", "Unfortunately for the hosts, Ann Berg won by 2 seconds.", "Ann Berg, who was unable to train that winter, won the gold.", "Ann Berg apologised to Eva Holt after winning."])
def test_does_not_refuse(text):
    assert not A.refuses(text)


@pytest.mark.parametrize("text", ["It was (Ann", 'He said "no', "**Gold:** Ann\n**Silver:**", "1. Ann\n2.", "| 1 | Ann | X |\n| 2 | Eva |", '{"gold": "Ann'])
def test_unclosed(text):
    assert A.unclosed(text)


@pytest.mark.parametrize("text", ["(Ann)", "34.", "Ann (OSL)", "«a» and “b”", '{"gold": "Ann"}'])
def test_closed(text):
    assert not A.unclosed(text)


def test_spark(spark):
    good = [(k, Q, f"The medal went to Ann{'b' * k} Berg of Norvask, who finished in {k}.5 seconds.") for k in range(30)]
    rows = [*good, (100, Q, None), (101, Q, Q), (102, Q, "I don't know."), (103, Q, "The medal went to Ann Berg of Norvask, who finished"), (104, Q, "The medal went to Ann Berg of Norvask, who finished in 3.5 seconds"), (105, None, "Ann Berg"), (106, None, None), (None, Q, ""), (107, Q, "The medal went to (Ann"), (107, Q, "The medal went to (Ann"), (109, Q, "Ann Berg, Norvask – 19.50 seconds"), (108, Q, "word " * 20_000 + "end.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "pred_id long, question string, predicted_answer string, found string")
    defects = A.find_defects(df, Profiles({}))
    got = {r.pred_id: r.defect for r in A.first_defect(defects).collect()}
    assert got == {100: "empty", 101: "copies_question", 102: "refusal", 103: "truncated", 106: "empty", None: "empty", 107: "truncated"}
    assert A.find_defects(df.limit(0), Profiles({})).count() == 0


def test_verdicts_do_not_depend_on_copies(spark):
    """Every answer under eight ids, and one of them under a third of all: each has the same defects as before."""
    ends = ["who finished in 3.5 seconds", "who finished in", "who finished in 3.5 seconds.", "ahead of the", "ahead of Eva Holt.", "ahead of Eva Holt"]
    rows = [(k, Q, f"The medal went to Ann Berg of Norvask, {e}") for k, e in enumerate(ends)]
    many = [(100 * j + k, q, a) for j in range(8) for k, q, a in rows] + [(10_000 + j, *rows[1][1:]) for j in range(24)]
    found = []
    for data in (rows, many):
        df = spark.createDataFrame(data, "pred_id long, question string, predicted_answer string")
        text = {k: a for k, _, a in data}
        found.append({(text[r.pred_id], r.defect) for r in A.find_defects(df, Profiles({})).collect()})
    assert found[0] == found[1] == {(rows[1][2], "truncated"), (rows[3][2], "truncated")}
