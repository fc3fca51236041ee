"""Every core query against its SQL on the smallest tables."""

import pytest

from corpusloom.plans import catalogue
from tests.compared import DATA, connect, same_rows

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query(spark, con, name):
    same_rows(catalogue.queries()[name](spark, f"{DATA}/{SF}"), con, catalogue.oracle_sql()[name])


def test_only_the_approximate_search_has_no_sql(spark):
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"vector_topk_index"}
    exact, found = ({(r.query_id, r.vec_id) for r in catalogue.queries()[n](spark, f"{DATA}/{SF}").collect()} for n in ("vector_topk", "vector_topk_index"))
    assert len(exact & found) >= 0.9 * len(exact)
