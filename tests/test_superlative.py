"""Questions for a maximum whose type is missing."""

from corpusloom.plans import catalogue
from tests.compared import DATA

D = f"{DATA}/sf0.01"


def test_questions_without_a_type_are_answered_too(spark):
    found = catalogue.queries()
    typed, routed = ({tuple(r) for r in found[n](spark, D).select("qid", "doc_id").collect()} for n in ("superlative", "superlative_routed"))
    assert typed < routed
