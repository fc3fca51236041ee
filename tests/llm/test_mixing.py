import random

import pytest

from corpusloom.llm.mixing import fill, mixture


def test_largest_total_keeps_shares():
    given = fill({"a": 100, "b": 1000, "c": 50}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 2})
    total = sum(given.values())
    assert total == pytest.approx(200) and given["a"] == pytest.approx(100)
    assert all(given[s] / total == pytest.approx(p) for s, p in {"a": 0.5, "b": 0.3, "c": 0.2}.items())


def test_clamped_and_spread():
    given = fill({"a": 10, "b": 1000, "c": 1000, "none": 0}, {"a": 0.5, "b": 0.2, "c": 0.2, "none": 0.1}, {"a": 2, "b": 1, "c": 1, "none": 5}, total=500)
    assert given == {"a": 20, "b": pytest.approx(240), "c": pytest.approx(240), "none": 0}
    assert fill({"a": 10}, {"a": 1.0}, {"a": 3}, total=500) == {"a": 30}
    assert fill({}, {"a": 1.0}, {"a": 3}) == {"a": 0.0}


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", " A", "a "]), k, rng.randint(1, 50)) for k in range(3000)] + [("b", 10_000 + k, rng.randint(1, 50)) for k in range(200)] + [("c", 20_000, 7), (None, 1, 5), ("other", 2, 5), ("a", 3, 0), ("a", 4, None)]
    counts = spark.createDataFrame(rows, "source string, doc_id long, n_tokens long")
    targets = spark.createDataFrame([("A", 0.6, 1), ("b", 0.39, 4), ("c", 0.01, 50), ("d", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    used, report = mixture(counts, targets)
    used, report = used.collect(), {r.source: r for r in report.collect()}
    most = {"a": 1, "b": 4, "c": 50}
    assert all(1 <= r.repeats <= most[r.source] for r in used)
    assert len({(r.source, r.doc_id) for r in used}) == len(used)
    assert set(report) == {"a", "b", "c", "d"} and report["d"].tokens == 0 and report["d"].reached_share == 0
    for s in most:
        assert report[s].tokens == sum(r.n_tokens * r.repeats for r in used if r.source == s)
    for s, share in (("a", 0.6), ("b", 0.39), ("c", 0.01)):
        assert report[s].reached_share == pytest.approx(share, abs=0.01)
    again = mixture(counts.repartition(7), targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, used))


def test_empty(spark):
    counts = spark.createDataFrame([], "source string, doc_id long, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    used, report = mixture(counts, targets)
    assert used.count() == 0 and report.first().reached_share == 0
    used, report = mixture(counts, targets.limit(0))
    assert used.count() == report.count() == 0
