import random
import re

import numpy as np
import pytest

from corpusloom.llm import golay
from corpusloom.llm.near_duplicates import _dealt, near_pairs, pairs_of_keys


def test_code_is_perfect():
    words = np.arange(1 << golay.DATA, dtype=np.int64) << (golay.LENGTH - golay.DATA)
    code = words | golay.syndrome(words)
    assert (golay.syndrome(code) == 0).all()
    weights = np.array([bin(c).count("1") for c in code[1:]])
    assert weights.min() == 7


def test_words_near_each_other_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << golay.LENGTH, 5000)
    keys = golay.near_codewords(words)
    assert set((keys >= 0).sum(axis=1)) == {1, 6}
    for bits in (1, 2):
        other = words.copy()
        for k in range(len(words)):
            for b in rng.choice(golay.LENGTH, bits, replace=False):
                other[k] ^= 1 << int(b)
        shared = [bool(set(a[a >= 0]) & set(b[b >= 0])) for a, b in zip(keys, golay.near_codewords(other))]
        assert all(shared)


def grams(text, n):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return w, set(zip(*[w[k:] for k in range(n)]))


def brute(rows, least, n, least_words):
    out, sets = set(), [(k, *grams(t, n)) for k, t in rows if t]
    for i, (a, wa, ga) in enumerate(sets):
        for b, wb, gb in sets[:i]:
            if a != b and min(len(wa), len(wb)) >= least_words and len(ga & gb) >= least * len(ga | gb):
                out.add((min(a, b), max(a, b)))
    return out


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice(["again", "later", "nearly"]) if x < rate * 2 / 3 else w)
        if x > 1 - rate / 3:
            out.append(rng.choice(["so", "then"]))
    return out


@pytest.mark.parametrize("n,least", [(3, 0.6), (5, 0.8)])
def test_against_brute_force(spark, n, least):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(45, 160))]
        rows.append((f"k{k}", " ".join(words)))
        for j in range(rng.choice([0, 0, 1, 3])):
            rows.append((f"k{k}-{j}", ", ".join(edited(rng, words, rng.choice([0, 0.02, 0.05, 0.09]))).upper()))
    rows += [("null", None), ("empty", ""), ("short", "one two three"), (rows[0][0], rows[0][1]), ("long", " ".join(rng.choice(vocabulary) for _ in range(20_000)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, t string, class int, words string")
    got = {tuple(r) for r in pairs_of_keys(*near_pairs(df, "id", "t", least, n, 40)).collect()}
    want = brute(rows, least, n, 40)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_hot_groups_and_empty_tables(spark):
    rng = random.Random(4)
    hot = " ".join(f"w{k}" for k in range(60))
    rows = [(f"h{k}", hot) for k in range(60)] + [(f"o{k}", " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(60))) for k in range(60)] + [(None, hot)]
    df = spark.createDataFrame(rows, "id string, t string")
    pairs, members = near_pairs(df, "id", "t", 0.8, 5)
    assert pairs.count() == 0
    assert members.groupBy("class").count().where("count > 1").collect()[0]["count"] == 61
    assert pairs_of_keys(pairs, members).where("key_a is not null").count() == 60 * 59 // 2
    pairs, members = near_pairs(df.limit(0), "id", "t")
    assert pairs_of_keys(pairs, members).count() == 0


def test_family_of_a_third_of_the_rows(spark):
    """Each member has words of its own, the family's are common, and one member's copies are many rows."""
    rng = random.Random(8)
    base = [f"f{k}" for k in range(80)]
    rows = [("base", " ".join(base))] + [(f"c{k}", " ".join(base)) for k in range(40)]
    for k in range(200):
        words = list(base)
        for j in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"own{k}x{j}"
        rows.append((f"m{k}", " ".join(words)))
    rows += [(f"o{k}", " ".join(f"v{rng.randint(0, 3000)}" for _ in range(80))) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, t string")
    got = {tuple(r) for r in pairs_of_keys(*near_pairs(df, "id", "t", 0.6, 3, 40)).collect()}
    want = brute(rows, 0.6, 3, 40)
    assert len(want) > 20_000
    assert got <= want and len(got) >= 0.99 * len(want)
    # the same pairs when the family's keys are dealt out to many tasks
    assert got == {tuple(r) for r in pairs_of_keys(*near_pairs(df, "id", "t", 0.6, 3, 40, task_rows=16, asked=1)).collect()}


def test_cells_of_large_keys(spark):
    keys = spark.createDataFrame([(1, k) for k in range(50)] + [(2, k) for k in range(5)], "key bigint, class bigint")
    dealt = _dealt(keys, spark.createDataFrame([(1, 7)], "key bigint, parts bigint")).select("key", "class")
    pairs = dealt.alias("a").join(dealt.alias("b"), "key").where("a.class < b.class").select("a.class", "b.class").distinct()
    assert pairs.count() == 50 * 49 // 2
    assert dealt.groupBy("key").count().agg({"count": "max"}).first()[0] < 50
    assert dealt.where("key = 2").count() == 5
