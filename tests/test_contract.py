import json

import pytest

from corpusloom.operators import graph
from corpusloom.schemas import ENTITY_TYPES, RELATIONS
from corpusloom.sources import contract

TYPES, JOINS = {"A": {"vertex_type": "A"}}, {"R": {"source_type": "A", "target_type": "A"}}


def test_contract_comes_back(spark, tmp_path):
    (tmp_path / "c.json").write_text(contract.to_json(ENTITY_TYPES, RELATIONS))
    types, relations = contract.load(spark, str(tmp_path / "c.json"))
    assert set(types) == set(ENTITY_TYPES) and relations == RELATIONS


@pytest.mark.parametrize("text", ["", "{", "[]", json.dumps({"entity_types": TYPES}), json.dumps({"entity_types": {}, "relationships": JOINS}), json.dumps({"entity_types": {"A": {}}, "relationships": JOINS}), json.dumps({"entity_types": TYPES, "relationships": {"R": {"source_type": "A", "target_type": "B"}}})])
def test_bad_contracts(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(contract.BadContract):
        contract.load(spark, str(tmp_path / "c.json"))


def test_recognised(spark):
    rows = [("Ann ", "Person", 0.9, "x"), ("ann", "athlete", 0.5, "x"), ("Bo", "athlete", 0.3, "x"), ("Cy", "what", 0.4, "x"), ("Di", None, None, "x"), (None, "sport", 0.9, "x"), ("  ", "sport", 0.9, "x")]
    df = spark.createDataFrame(rows, "name string, label string, score double, type string")
    assert {tuple(r) for r in graph.recognised(df, score="score").collect()} == {("ann", "Athlete", "ann"), ("cy", "Event", "cy")}
    assert graph.recognised(df).count() == 4
    assert graph.recognised(df.limit(0)).count() == 0
