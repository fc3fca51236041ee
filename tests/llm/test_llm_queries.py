import pytest

from corpusloom.llm import queries
from tests.compared import DATA, connect, same_rows

FOLDER = f"{DATA}/sf0.001"


def rows(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_as_in_sql(spark, name):
    same_rows(queries.queries()[name](spark, FOLDER), connect("sf0.001"), queries.oracle_sql()[name])


def test_defects(spark):
    one, every = rows(spark, "p2_found"), {tuple(r) for r in rows(spark, "p2_defects")}
    assert len({r.pred_id for r in one}) == len(one) > 0
    assert {tuple(r) for r in one} <= every and {r.pred_id for r in one} == {k for k, _ in every}


def test_pairs_are_those_of_entities(spark):
    of = {}
    for r in rows(spark, "p3_entities"):
        of.setdefault(r.entity, set()).add(r.id)
    want = {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    found = rows(spark, "p3_found")
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 0


def test_groups_are_the_components_of_pairs(spark):
    pairs = {tuple(r) for r in rows(spark, "p5_found")}
    of = {k: k for p in pairs for k in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    groups = {}
    for r in rows(spark, "p5_groups"):
        groups.setdefault(r.group, set()).add(r.chunk_id)
    want = {}
    for k, low in of.items():
        want.setdefault(low, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and want


def test_ids_of_every_document(spark):
    found = rows(spark, "p6_ids")
    assert len(found) == len({r.doc_id for r in found}) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.parametrize("kind", ["", "full_"])
def test_shares_are_those_of_the_mixture(spark, kind):
    used, report = rows(spark, f"p7_{kind}mixture"), {r.source: r for r in rows(spark, f"p7_{kind}shares")}
    total = sum(r.n_tokens * r.repeats for r in used)
    assert total > 0
    for source, r in report.items():
        own = [x for x in used if x.source == source]
        assert r.tokens == sum(x.n_tokens * x.repeats for x in own) and all(x.repeats <= r.max_repeats for x in own)
        assert r.reached_share == pytest.approx(r.tokens / total, abs=1e-5)
    if kind:
        # some source is used up, and the others have more than their share for it
        assert any(0 < r.reached_share < r.target_share - 0.005 for r in report.values())


def test_label_cases_follow_from_the_languages(spark):
    judged, cases = rows(spark, "p8_languages"), rows(spark, "p8_found")
    of = {(r.doc_id, r.language, r.main) for r in judged}
    assert len(cases) == len(set(cases)) > 0
    assert all((r.doc_id, r.lang, r.kind != "segment") in of for r in cases)
    assert all(0 <= r.confidence <= 1 for r in judged)
